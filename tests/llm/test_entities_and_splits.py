from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import entities as en
from graphloom.llm import entity_splits as es
from graphloom.llm import overlaps
from graphloom.llm.spanning_forest import spanning_forest
from graphloom.llm.top_n import top_n
from graphloom.session import estimated_bytes

NODE = "node_index bigint, node_id string, node_name string, node_type string, split string"
ROW = "row_id bigint, drug_idx bigint, gene_idx bigint, split string, record_source string, source_type string, target_type string, evidence string, association string, drug_entity string"


def components(pairs):
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(root)}


@pytest.mark.parametrize("seed", [0, 1])
def test_forest_spans_the_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, 200 + i) for i in range(1, 60)] + [(300 + i, 301 + i) for i in range(40)]
    df = spark.createDataFrame([*pairs, pairs[0], (5, 5), (None, 3), (4, None)], "u bigint, v bigint").withColumn("root", F.lit("clash"))
    forest = spanning_forest(df)
    want = {v: r for v, r in components([p for p in pairs if p[0] != p[1]]).items()}
    assert {r["v"]: r["root"] for r in forest.roots.collect()} == want
    edges = [(r["u"], r["v"]) for r in forest.edges.collect()]
    assert len(edges) == len(want) - len(set(want.values()))  # a tree has one edge less than vertices
    assert components(edges) == want


def test_forest_of_nothing(spark):
    forest = spanning_forest(spark.createDataFrame([], "u string, v string"))
    assert forest.roots.collect() == [] and forest.edges.collect() == []


def test_entities(spark):
    nodes = spark.createDataFrame(
        [(i, x, None, k, "c") for i, x, k in [(0, "PA01", "drug"), (1, "pharmgkb: pa-1\t", "drug"), (2, "PA2", "drug"), (3, "\xa0PA_3", "drug"), (4, "PA4", "drug"), (5, "none", "drug"), (6, None, "drug"), (7, "PA1", "gene"), (8, "PGKB-Pa 1", "gene"), (9, "PA5", "drug"), (10, "PA6", "drug")]],
        NODE,
    )
    chemicals = spark.createDataFrame(
        [("PA1", "CC O"), ("PA 2", "C\xa0CO\n"), ("PA2", "NN"), ("PA3", "N N"), ("PA4", "?"), ("PA5", "[not available]"), ("PA6", "n / a"), (None, "NN"), ("PA99", "CCO"), ("PA4", None)], "pharmgkb_accession_id string, smiles string"
    )
    got = {r["drug_idx"]: r["drug_entity"] for r in en.drug_entities(nodes, en.drug_forest(nodes, chemicals)).collect()}
    assert got[0] == got[1] == got[2] == got[3] and len(set(got.values())) == 6 and got[5] == "node:5" and got[6] == "node:6"
    genes = {r["gene_idx"]: r["gene_entity"] for r in en.gene_entities(nodes).collect()}
    assert genes == {7: "1", 8: "1"}


def test_labels(spark):
    raw = [" Train", "TRAINING", "Training context only", "training-context-only", "Val", "Valid ", "VALIDATION", "testing", "Test ", "", "NA", "null", None, "contest"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, s string").select("i", en.split_label(F.col("s")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in rows] == ["train"] * 4 + ["validation"] * 3 + ["test"] * 2 + [None] * 5


@pytest.fixture(scope="module")
def assignments(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        drug = 7 if rng.random() < 0.33 else rng.randrange(300)
        rows.append((i, rng.choice([drug, drug, drug, None]) if i % 50 == 0 else drug, rng.choice([0, 0, rng.randrange(60), None]) if i % 40 == 0 else rng.randrange(60) if rng.random() < 0.7 else 0,
                     rng.choice(["train"] * 8 + ["val", "Test ", "NA", None]), rng.choice(["a", "b", None]), "drug", "gene", rng.choice(["x", "y", None]), "associated", "clash"))
    return spark.createDataFrame(rows + rows[:20], ROW)


@pytest.fixture(scope="module")
def names(spark):
    drugs = spark.createDataFrame([(i, f"e{i // 3}") for i in range(290)], "drug_idx bigint, drug_entity string")
    return drugs, spark.createDataFrame([(i, f"g{i // 2}") for i in range(50)], "gene_idx bigint, gene_entity string")


def counted(assignments):
    label = {"train": "train", "val": "validation", "Test ": "test"}
    return [(r, label[r["split"]]) for r in assignments.collect() if r["drug_idx"] is not None and r["gene_idx"] is not None and r["split"] in label]


def entity(drug):
    return f"e{drug // 3}" if drug < 290 else f"node:{drug}"


def test_entities_across_splits(spark, assignments, names):
    splits = defaultdict(set)
    for r, s in counted(assignments):
        splits[entity(r["drug_idx"])].add(s)
    want = sorted({r["drug_idx"] for r, _ in counted(assignments) if len(splits[entity(r["drug_idx"])]) > 1})
    assert sorted(r["drug_idx"] for r in es.entities_across_splits(assignments, names[0]).collect()) == want
    assert es.entities_across_splits(assignments.limit(0), names[0]).collect() == []


def test_grouped_splits_keep_entities_whole(spark, assignments, names):
    got = es.grouped_splits(assignments, names[0]).collect()
    keyed = [r for r in assignments.collect() if r["drug_idx"] is not None and r["gene_idx"] is not None]
    assert Counter(r["row_id"] for r in got) == Counter(r["row_id"] for r in keyed)
    splits = defaultdict(set)
    for r in got:
        assert r["drug_entity"] == entity(r["drug_idx"])
        splits[r["drug_entity"]].add(r["split"])
    assert all(len(s) == 1 for s in splits.values())
    share = Counter(r["split"] for r in got)
    assert abs(share["train"] / len(got) - 0.8) < 0.05 and share["validation"] > 0 and share["test"] > 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, es.grouped_splits(assignments.repartition(7), names[0]).collect()))
    assert es.grouped_splits(assignments.limit(0), names[0]).collect() == []


def test_deal_is_proportional(spark):
    sizes = spark.createDataFrame([(f"e{i}", 1 + i % 5) for i in range(5000)], "drug_entity string, n_rows bigint")
    got = es.deal_splits(sizes).join(sizes, "drug_entity").groupBy("split").agg(F.sum("n_rows").alias("n")).collect()
    total = sum(r["n"] for r in got)
    assert {r["split"]: round(r["n"] / total, 2) for r in got} == {"train": 0.8, "validation": 0.1, "test": 0.1}
    with pytest.raises(ValueError, match="shares"):
        es.deal_splits(sizes, (0.5, 0.1, 0.1))


def test_top_n_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice([None, float("nan"), 0.5, 0.25, 1.0, float("inf"), rng.random()]), 5) for _ in range(4000)] + [(77, 1, 0.0, 5)]
    best = defaultdict(dict)
    for d, g, s, _ in rows:
        if d is not None and g is not None and s is not None and s == s:
            best[d][g] = max(s, best[d].get(g, s))
    want = {(d, g, s, i) for d, gs in best.items() for i, (g, s) in enumerate(sorted(gs.items(), key=lambda x: (-x[1], x[0]))[:10], 1)}
    df = spark.createDataFrame(rows, "drug_idx bigint, gene_idx bigint, s double, item int")
    for part_bytes in (estimated_bytes(df) // 24, 64 << 20):  # the first spreads a group by item as well
        assert {(r["drug_idx"], r["gene_idx"], r["s"], r["rank_no"]) for r in top_n(df, "drug_idx", "gene_idx", "s", 10, part_bytes).collect()} == want
    for parts in (1, 9):
        assert {(r["drug_idx"], r["gene_idx"], r["s"], r["rank_no"]) for r in top_n(df.repartition(parts), "drug_idx", "gene_idx", "s", 10).collect()} == want
    assert top_n(df.limit(0), "drug_idx", "gene_idx", "s", 10).collect() == []
    with pytest.raises(ValueError, match="n must"):
        top_n(df, "drug_idx", "gene_idx", "s", 0)


def test_top_n_over_many_batches(spark):
    """Groups and repeated items that go on over batches, at the smallest batch size."""
    rng = random.Random(4)
    rows = [(d, rng.randrange(30), rng.randrange(6) / 4) for d in (1, 2, 2, 2, 3) for _ in range(120)]
    best = defaultdict(dict)
    for d, g, s in rows:
        best[d][g] = max(s, best[d].get(g, s))
    want = {(d, g, i) for d, gs in best.items() for i, (g, _) in enumerate(sorted(gs.items(), key=lambda x: (-x[1], x[0]))[:7], 1)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 3, 50):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = top_n(spark.createDataFrame(rows, "a bigint, b bigint, c double").repartition(2), "a", "b", "c", 7).collect()
            assert {(r["a"], r["b"], r["rank_no"]) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_overlaps_match_brute_force(spark, assignments, names):
    keyed = [(r, s, entity(r["drug_idx"]), f"g{r['gene_idx'] // 2}" if r["gene_idx"] < 50 else f"node:{r['gene_idx']}") for r, s in counted(assignments)]
    train, held = defaultdict(list), defaultdict(list)
    for r, s, d, g in keyed:
        (train if s == "train" else held)[d, g].append(r["row_id"])
    want = Counter((min(a, b), max(a, b)) for k, xs in train.items() for a in xs for b in held.get(k, ()))
    rows = overlaps.record_texts(overlaps.named_rows(assignments, *names))
    assert Counter(tuple(r) for r in overlaps.overlap_pairs(rows).collect()) == want
    report = overlaps.overlap_report(rows).collect()
    assert sum(r["n_pairs"] for r in report) == sum(want.values())
    assert sum(r["n_overlapping"] for r in report) == sum(len(v) for k, v in held.items() if k in train)
    full = lambda r: (r["evidence"], r["source_type"], r["target_type"], r["association"])
    texts = {(d, g, full(r)) for r, s, d, g in keyed if s == "train"}
    assert sum(r["n_exact"] for r in report) == sum((d, g, full(r)) in texts for r, s, d, g in keyed if s != "train")
    assert all(r["n_exact"] + r["n_near"] == r["n_overlapping"] <= r["n_rows"] for r in report)
    assert overlaps.overlap_pairs(rows.limit(0)).collect() == []


def test_automata_decide_the_overlaps(spark, assignments, names, monkeypatch):
    rows = overlaps.record_texts(overlaps.named_rows(assignments, *names))
    scan = lambda **k: Counter(tuple(r) for r in overlaps.scan_overlaps(rows, **k).collect())
    routed = scan()
    assert routed and routed == scan(routed=False) == scan(shard_bytes=max(1, estimated_bytes(rows) // 20))  # every text past every shard finds no more
    texts = rows.select("split", "text").distinct().collect()
    for text, core, matched, exact in routed:
        trained = [r["text"].split("\x1f")[1:-1] for r in texts if r["split"] == "train" and r["text"].startswith(core)]
        mine = text.split("\x1f")[1:-1]
        shared = [f for i, f in enumerate(mine) if any(t[i] == f for t in trained)]
        assert matched == 1 + sum(len(f) + 1 for f in shared) and exact == (mine in trained)
    links = Counter()
    for a, b in ((r["row_id_a"], r["row_id_b"]) for r in overlaps.overlap_pairs(rows).collect()):
        links[a] += 1
        links[b] += 1
    assert {r["row_id"]: r["links"] for r in overlaps.overlap_classes(rows).collect()} == dict(links)
    monkeypatch.setattr(overlaps, "scan_overlaps", lambda rows: spark.createDataFrame([], "text string, train_core string, matched bigint, exact boolean"))
    assert overlaps.overlap_pairs(rows).collect() == []  # no pair comes from anything but the automata


def test_intervals_merge():
    spans = []
    for new in ((5, 9), (0, 2), (2, 4), (8, 12)):
        spans = overlaps._merge(spans, new)
    assert spans == [(0, 4), (5, 12)]
