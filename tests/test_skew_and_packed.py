from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators.packed_values import parse_packed, unpack_values
from graphloom.operators.positions import count_greater, global_position, join_heavy, with_position
from graphloom.operators.tree_aggregate import heavy_nodes, merge_rounds, node_degrees, tree_aggregate, tree_count

EDGE = "source_idx bigint, target_idx bigint, relation_type string, side string, __chunk int"


def edges(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], EDGE)


def test_rounds_are_logarithmic():
    assert [merge_rounds(n, 16) for n in (1, 16, 17, 256, 257, 4096)] == [1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("options", [{}, {"fan_in": 2, "chunk_rows": 3, "chunk_bytes": 64}])
def test_tree_matches_counter(spark, options):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(30), rng.choice([None, 1, 2]), rng.choice(["x", None])) for _ in range(2000)]
    df = edges(spark, rows).repartition(5)
    got = {(r["source_idx"], r["relation_type"]): r["n_rows"] for r in tree_count(df, ["source_idx", "relation_type"], **options).collect()}
    assert got == Counter((a, c) for a, _, c in rows)
    degree = {(r["side"], r["node_idx"]): r["degree"] for r in node_degrees(df, **options).collect()}
    assert degree == Counter([("source", a) for a, _, _ in rows] + [("target", b) for _, b, _ in rows if b is not None])


def test_heavy_share_is_of_all_rows(spark):
    rows = [(1, None, "r")] * 2 + [(k, 5, "r") for k in range(100, 198)]
    got = {tuple(r) for r in heavy_nodes(edges(spark, rows)).collect()}
    assert got == {("source", 1), ("target", 5)}


def test_tree_of_nothing_and_bad_calls(spark):
    none = edges(spark, [])
    assert tree_count(none, ["source_idx"]).collect() == [] and heavy_nodes(none).collect() == []
    with pytest.raises(ValueError, match="same names"):
        tree_aggregate(none, ["source_idx"], {"a": F.count("*")}, {})
    with pytest.raises(ValueError, match="fan_in"):
        tree_count(none, ["source_idx"], fan_in=1)


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []), ("", []), ("  \t", []), ("NA; None ,nan|NULL", []),
        ("Literature", ["Literature"]), (" a , b ;c/d|e\tf\ng，h；i ", list("abcdefghi")),
        ('"Literature, meta-analysis"', ["Literature, meta-analysis"]), ('a,"b; c" /d', ["a", "b; c", "d"]),
        ('"Clinical ""expert"" annotation"', ['Clinical "expert" annotation']), (r'["a \"b\" c", "d"]', ['a "b" c', "d"]),
        ("'Curator''s note','x, y'", ["Curator's note", "x, y"]), ("Author's remark, Pathway's review", ["Author's remark", "Pathway's review"]),
        ("“The \"blue\" file, 2nd ed.”|z", ['The "blue" file, 2nd ed.', "z"]), ("[ a ;b ;Curator's note ]", ["a", "b", "Curator's note"]), ('{"a, b";c;PMID:9}', ["a, b", "c", "PMID:9"]),
        ("a||b//c", ["a", "b", "c"]), ("a, a, a", ["a"] * 3), ("\xa0a\xa0,\xa0b", ["a", "b"]), (",a,", ["a"]), ("PMID:1; In-house (x). y", ["PMID:1", "In-house (x). y"]), ("[]", []), ('""', []),
    ],
)
def test_values(text, values):
    assert [v for v, _ in parse_packed(text)] == values
    assert all(not flag for _, flag in parse_packed(text))


@pytest.mark.parametrize("text", ['"open, b', 'a,"b" c,d', "[a, b", "a], b", "'x, y", '["a]', "{a;[b}"])
def test_malformed_values_are_flagged_and_nothing_hangs(text):
    got = parse_packed(text)
    assert got and any(flag for _, flag in got) or any(q in v for v, _ in got for q in "\"'")


@pytest.mark.parametrize(
    "unit, times, tail",
    [('"[a,', 10_000, ""), ("[", 100_000, ""), ("[a,", 50_000, ""), ("“a,", 50_000, "””"), ("{[ '", 20_000, ""), ('["a', 20_000, '"]' * 20_000), ("\\", 100_000, '"'), ("[ \u200b", 30_000, ""), ('"a""', 30_000, "x")],
)
def test_long_malformed_fields_take_linear_time(unit, times, tail):
    start = time.perf_counter()
    parse_packed(unit * times + tail)
    assert time.perf_counter() - start < 2


def test_deep_groups():
    assert [v for v, _ in parse_packed("[" * 3000 + "a, 'b, c'" + "]" * 3000 + "; d")] == ["a", "b, c", "d"]
    assert parse_packed("[x\u200b \u200b,y]") == [("x", ""), ("y", "")]


def test_random_fields_end(spark):
    rng = random.Random(5)
    for _ in range(3000):
        parse_packed("".join(rng.choice("ab ,;|'\"[]{}“”\\\n") for _ in range(rng.randrange(25))))


def test_unpack_rows(spark):
    long = ",".join(f"v{i}" for i in range(20000))
    df = spark.createDataFrame([(1, "a,b", "x"), (1, "a,b", "y"), (None, "c", "z"), (2, None, ""), (3, "nan", ""), (4, long, "")], "rel_id bigint, evidence string, value string")
    got = unpack_values(df, "rel_id", "evidence").collect()
    assert Counter((r["id"], r["pos"], r["value"]) for r in got if r["id"] != 4) == Counter({(1, 1, "a"): 2, (1, 2, "b"): 2, (None, 1, "c"): 1})
    assert sorted((r["pos"], r["value"]) for r in got if r["id"] == 4)[-1] == (20000, "v19999")
    assert unpack_values(df.limit(0), "rel_id", "evidence").collect() == []


def test_positions_are_a_permutation(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 300, "hot").when(F.col("id") < 310, None).otherwise("b"))
    got = with_position(df, ["g"], ["id"], "p", buckets=7).collect()
    for g in ("hot", "b", None):
        assert sorted(r["p"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))
    ordered = with_position(df, [], ["id"], "p", bucket=F.floor(F.col("id") / 64)).collect()
    assert all(r["id"] == r["p"] for r in ordered)
    assert [(r["id"], r["p"]) for r in global_position(df.repartition(6), ["id"], "p").orderBy("id").collect()] == [(i, i) for i in range(500)]
    assert global_position(df.limit(0), ["id"], "p").collect() == []


def test_count_greater_ignores_ties(spark):
    rows = [("a", s) for s in (0.1, 0.5, 0.5, 0.50001, 0.9, None, float("nan"))] + [("b", 3.0)]
    got = {(r["g"], r["s"]): r["n"] for r in count_greater(spark.createDataFrame(rows, "g string, s double"), ["g"], "s", F.lit(1), "n").collect()}
    assert got == {("a", 0.9): 0, ("a", 0.50001): 1, ("a", 0.5): 2, ("a", 0.1): 4, ("b", 3.0): 0}


def test_join_heavy_equals_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1), (9, 1)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, y string")
    heavy = spark.createDataFrame([(1,)], "k int")
    for how in ("inner", "left"):
        assert sorted(map(str, join_heavy(left, right, ["k"], heavy, how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    with pytest.raises(ValueError, match="how"):
        join_heavy(left, right, ["k"], heavy, "outer")


def test_count_greater_of_crowded_scores(spark):
    """Scores that differ in the last digits only, a hot group and weights of several rows."""
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), 0.5 + rng.randrange(300) * 1e-9, rng.randrange(3)) for _ in range(3000)]
    got = {(r["g"], r["s"]): r["n"] for r in count_greater(spark.createDataFrame(rows, "g string, s double, w int"), ["g"], "s", F.col("w"), "n").collect()}
    scores = {}
    for g, s, w in rows:
        if g is not None:
            scores.setdefault(g, Counter())[s] += w
    assert got == {(g, s): sum(w for other, w in of.items() if other > s) for g, of in scores.items() for s in of}
