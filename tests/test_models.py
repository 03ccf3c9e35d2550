from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.gnn import layers as gnn
from graphloom.operators import ranking as rk
from graphloom.operators import splits as sp
from graphloom.operators import stats
from graphloom.operators.block_scores import best_match_ranks, relation_ranks


def test_block_ranks_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(60, 4)).round(2), rng.integers(0, 4, 60)
    label[0] = 9  # alone in its label
    rows = [(i, x[i].tolist(), int(label[i]), "clash") for i in range(60)] + [(60, None, 1, ""), (61, [1.0] * 4, None, "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, best string")
    got = {r["query_id"]: (r["n_positives"], r["rank"]) for r in best_match_ranks(df, df.filter("vec_id % 4 = 0"), query_block=4, vector_block=10).collect()}
    want = {}
    for q in range(0, 60, 4):
        s = np.round(x @ x[q], 9)
        same = (label == label[q]) & (np.arange(60) != q)
        want[q] = (int(same.sum()), 1 + int((s[label != label[q]] > s[same].max()).sum()) if same.any() else None)
    assert got == want
    assert best_match_ranks(df.limit(0), df.limit(0)).collect() == []


def encode(spark, fingerprints):
    nodes = spark.createDataFrame([(0, "drug"), (1, "gene"), (2, "drug"), (3, "variant")], "node int, node_type string")
    identity = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "node int, x array<double>")
    kinds = {"drug": [10.0, 0.0], "gene": [20.0, 0.0], "variant": [30.0, 0.0]}
    if not fingerprints:
        return gnn.encode_nodes(nodes, identity, kinds)
    prints = spark.createDataFrame(fingerprints, "node int, fp array<double>")
    return gnn.encode_nodes(nodes, identity, kinds, prints, [[1.0, 0.0], [0.0, 2.0]], [0.5, 0.25])


def test_fingerprints_replace_drug_vectors_only(spark):
    plain = {r["node"]: r["x"] for r in encode(spark, None).collect()}
    assert plain == {0: [10.0, 1.0], 1: [21.0, 1.0], 2: [12.0, 1.0], 3: [33.0, 1.0]}
    made = {r["node"]: r["x"] for r in encode(spark, [(0, [1.0, 1.0])]).collect()}
    assert made[0] == pytest.approx([9.0, 1.0], abs=1e-4) and made[2] == [10.5, 0.25] and made[1] == plain[1] and made[3] == plain[3]


def test_molecular_mode_needs_all_parts(spark):
    nodes = spark.createDataFrame([(0, "drug")], "node int, node_type string")
    with pytest.raises(ValueError, match="molecular"):
        gnn.encode_nodes(nodes, nodes, {}, nodes)


def test_weighted_negatives_follow_degree(spark):
    positives = spark.createDataFrame([(i, 1) for i in range(400)], "drug_idx bigint, gene_idx bigint")
    degree = spark.createDataFrame([(1, 5), (2, 16), (3, 1), (4, 0)], "gene_idx bigint, degree bigint")
    got = [r["negative_idx"] for r in rk.weighted_negatives(positives, degree, positives, 2, 3).collect()]
    assert len(got) == 800 and set(got) == {2, 3} and 5 < got.count(2) / got.count(3) < 12  # 16 ** 0.75 = 8


def test_plain_split_sizes(spark):
    rows = sp.plain_split(spark.range(200).withColumnRenamed("id", "drug_idx"), 42).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"train": 140, "validation": 30, "test": 30}


def test_negatives_of_a_drug_that_knows_most_genes(spark):
    genes = spark.createDataFrame([(i, i - 100) for i in range(100, 600)], "gene_idx bigint, local_index bigint")
    known = spark.createDataFrame([(1, i) for i in range(100, 595)] + [(2, 100)], "drug_idx bigint, gene_idx bigint")
    got = rk.negative_samples(known, genes, known, 3, 7).collect()
    assert Counter((r["drug_idx"], r["gene_idx"]) for r in got) == {(r["drug_idx"], r["gene_idx"]): 3 for r in known.collect()}
    mine = Counter(r["negative_idx"] for r in got if r["drug_idx"] == 1)
    assert set(mine) == set(range(595, 600)) and min(mine.values()) > 200
    degree = spark.createDataFrame([(i, 50 if i < 595 else 1) for i in range(100, 600)], "gene_idx bigint, degree bigint")
    got = rk.weighted_negatives(known, degree, known, 3, 7)
    assert got.count() == 3 * known.count()
    assert sorted(got.collect()) == sorted(rk.weighted_negatives(known.repartition(7), degree, known, 3, 7).collect())
    with pytest.raises(ValueError, match="drug 1 knows all"):
        rk.negative_samples(known, genes.filter("gene_idx < 110"), known, 3, 7)


def test_ranks_are_the_same_in_memory_and_spread(spark):
    rng = np.random.default_rng(8)
    rows = [(int(d), g, float(rng.choice([0.0, -1.5, 0.25, rng.random()])), bool(rng.random() < 0.2), "x") for d in (1, 1, 2, 3) for g in range(int(rng.integers(1, 120)))] + [(None, 1, 0.5, True, "x")]
    pool = spark.createDataFrame(rows, "drug_idx bigint, gene_idx bigint, score double, known boolean, better string").dropDuplicates(["drug_idx", "gene_idx"]).cache()
    kept = [r for r in pool.collect() if r["drug_idx"] is not None]
    for filtered in (True, False):
        want = sorted((r["drug_idx"], r["gene_idx"], 1 + sum(q["drug_idx"] == r["drug_idx"] and q["score"] > r["score"] and not (filtered and q["known"]) for q in kept)) for r in kept if r["known"])
        for most in (0, 40, 1_000_000):
            assert sorted((r["drug_idx"], r["gene_idx"], r["rank"]) for r in rk.rank_known(pool.drop("better"), filtered=filtered, most=most).collect()) == want
    degree = spark.createDataFrame([(i, i % 7) for i in range(130)], "gene_idx bigint, degree bigint")
    grids = [sorted(map(tuple, rk.calibration_grid(pool.drop("better"), degree, most=most).collect())) for most in (0, 40, 1_000_000)]
    assert grids[0] == grids[1] == grids[2] and len(grids[0]) == 17
    assert rk.rank_known(pool.limit(0)).collect() == [] and rk.calibration_grid(pool.limit(0), degree).collect() == []


def test_paired_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(rng.normal())) for g in ("a", "b") for i in range(40)] + [("a", 99, None), (None, 1, 0.5), ("c", 1, 0.25)]
    df = spark.createDataFrame(rows, "g string, i bigint, v double")
    got = {r["g"]: r for r in stats.paired_bootstrap(df.repartition(5), "v", ["i"], ["g"], draws=200, seed=7).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"]["low"] == got["c"]["high"] == 0.25
    for g in ("a", "b"):
        x, again = np.array([v for h, _, v in sorted(rows, key=lambda r: r[1]) if h == g and v is not None]), np.random.default_rng(7)
        means = [x[again.integers(0, 40, size=40)].mean() for _ in range(200)]
        assert (got[g]["low"], got[g]["high"]) == pytest.approx(np.percentile(means, [2.5, 97.5]), abs=1e-6) and got[g]["n"] == 40
    spread = {r["g"]: r for r in stats.paired_bootstrap(df, "v", ["i"], ["g"], draws=400, most=10).collect()}
    assert all(spread[g]["mean"] == got[g]["mean"] and abs(spread[g]["low"] - got[g]["low"]) < 0.15 for g in ("a", "b"))


def test_relation_ranks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x, r = rng.normal(size=(40, 5)).round(1), rng.normal(size=(3, 5)).round(1)
    genes = list(range(10, 40))
    triples = [(int(d), int(g), int(k)) for d, g, k in zip(rng.integers(0, 10, 50), rng.integers(10, 40, 50), rng.integers(0, 3, 50), strict=True)]
    known = triples[:30] + triples[:3]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    asked = frame([*triples, triples[0], (0, 99, 0), (0, 10, 7)], ["drug_idx", "gene_idx", "rel"])  # no vectors for the last two
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node bigint, x array<double>")
    relations = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "rel bigint, r array<double>")
    told, marked = frame([t[:2] for t in known], ["drug_idx", "gene_idx"]), frame([(1,), (2,)], ["drug_idx"])
    for filtered in (True, False):
        want = {}
        for d, g, k in set(triples):
            s = {h: round(float((x[d] * r[k]) @ x[h]), 9) for h in genes if h == g or not (filtered and (d, h) in {t[:2] for t in known})}
            want[d, g, k] = (1 + sum(v > s[g] for v in s.values()), min(s, key=lambda h: (-s[h], h)), d in (1, 2))
        for size in (7, 8192):
            out = relation_ranks(asked, features, relations, frame([(g,) for g in genes], ["gene_idx"]), told if filtered else None, marked, query_block=size, gene_block=size).collect()
            assert {(q["drug_idx"], q["gene_idx"], q["rel"]): (q["rank"], q["best_gene"], q["marked"]) for q in out} == want
    assert relation_ranks(asked.limit(0), features, relations, frame([(10,)], ["gene_idx"])).collect() == []


def test_actions_in_order(spark):
    shares = [0.01, 0.05, 0.2, 0.5, 0.8, 0.94, 0.95, 1.0]
    got = spark.createDataFrame([(v,) for v in shares], "v double").select(rk.curator_action(F.col("v")).alias("a")).collect()
    assert [r["a"] for r in got] == ["upgrade_to_associated"] * 2 + ["lean_associated", "remains_ambiguous", "lean_not_associated", "lean_not_associated"] + ["downgrade_to_not_associated"] * 2
