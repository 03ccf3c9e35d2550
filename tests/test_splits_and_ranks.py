from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import quality as dq
from graphloom.operators import ranking as rk
from graphloom.operators import splits as sp
from graphloom.operators import stats

EDGE = "edge_index bigint, source_idx bigint, target_idx bigint, source_type string, target_type string, evidence string, association string"


@pytest.fixture(scope="module")
def edges(spark):
    rows, n = [], 0
    for drug in range(40):
        for k in range(2 + drug % 7):
            gene = 100 + (drug * 3 + k) % 25
            for s, t, a, b in ((drug, gene, "drug", "gene"), (gene, drug, "gene", "drug")):
                rows.append((n, s, t, a, b, "clinical", "associated"))
                n += 1
    for s, t, a, b in ((0, 200, "drug", "variant"), (200, 100, "variant", "gene"), (1, 201, "drug", "variant")):
        rows.append((n, s, t, a, b, "other", "associated"))
        n += 1
    return spark.createDataFrame([*rows, (n, None, 5, None, "gene", None, None)], EDGE).cache()


def test_largest_remainder_golden():
    sizes = {"2": 208, "3-4": 199, "5-9": 155, "10-19": 77, "20+": 55}
    first = sp.largest_remainder(sizes, 69, 0.1)
    second = sp.largest_remainder(sizes, 70, 0.1, {k: n - first[k] for k, n in sizes.items()})
    assert list(first.values()) == [21, 20, 15, 8, 5]
    assert list(second.values()) == [21, 20, 15, 8, 6]


def test_config():
    assert sp.SplitConfig().sizes(25) == (21, 2, 2)  # half-even
    for bad in ({"train": 0.9}, {"seeds": ()}, {"seeds": (1, 1)}, {"least_pairs": 1}, {"train": 1.0, "validation": 0.0, "test": 0.0}):
        with pytest.raises(ValueError):
            sp.SplitConfig(**bad)
    with pytest.raises(ValueError, match="room"):
        sp.largest_remainder({"2": 1}, 3, 1.0)


def test_cold_split_properties(spark, edges):
    drugs = sp.assign_drugs(sp.drug_strata(sp.pair_table(edges))).cache()
    for seed in (42, 123, 2026):
        rows = drugs.filter(F.col("seed") == seed).collect()
        assert len({r["drug_idx"] for r in rows}) == len(rows) == 40
        counts = {s: sum(r["split"] == s for r in rows) for s in sp.tx.STRATA + ("train", "validation", "test")}
        assert (counts["train"], counts["validation"], counts["test"]) == (32, 4, 4)
    for protocol in sp.PROTOCOLS:
        assigned = sp.assign_edges(edges, drugs, protocol)
        assert assigned.filter("in_training_graph AND is_drug_gene AND supervision_split IN ('validation', 'test')").isEmpty()
        left = assigned.filter("in_training_graph AND at_heldout_drug").count()
        assert left == 0 if protocol == "strict_cold" else left >= 0
    with pytest.raises(ValueError, match="protocol"):
        sp.assign_edges(edges, drugs, "warm")


def test_clashing_columns_are_replaced(spark, edges):
    more = edges.withColumn("drug_idx", F.lit("x")).withColumn("seed", F.lit(0)).withColumn("split", F.lit("y")).withColumn("removal_reason", F.lit(1))
    pairs = sp.pair_table(more)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, sp.pair_table(edges).collect()))
    drugs = sp.assign_drugs(sp.drug_strata(pairs))
    assert sp.assign_edges(more, drugs, "strict_cold").count() == 3 * edges.count()
    none = sp.assign_drugs(sp.drug_strata(sp.pair_table(more.limit(0))))
    assert none.collect() == []


def test_exposure_goes_through_the_variant(spark, edges):
    whole = edges.withColumn("in_training_graph", F.lit(True)).withColumn("seed", F.lit(1))
    pairs = spark.createDataFrame([(1, 0, 100), (1, 1, 100), (1, 0, 101)], "seed int, drug_idx bigint, gene_idx bigint")
    got = {(r["drug_idx"], r["gene_idx"]): r["mediating_variants"] for r in sp.variant_exposure(whole, pairs).collect()}
    assert got == {(0, 100): [200], (1, 100): [], (0, 101): []}


def test_quality_rules(spark, edges):
    pairs = sp.canonical_pairs(edges)
    assert dq.pair_invariants(pairs).isEmpty()
    assert [r["edge_index"] for r in dq.index_range(edges, spark.range(1).select(F.lit(1000).alias("n"))).collect()] == [edges.count() - 1]
    dq.enforce(dq.pair_invariants(pairs), "pairs")
    with pytest.raises(ValueError, match="range"):
        dq.enforce(dq.index_range(edges, spark.range(1).select(F.lit(1000).alias("n"))), "range")
    with pytest.raises(ValueError, match="missing columns"):
        dq.require_columns(edges, ["nope"])
    assert dq.contiguous(spark.createDataFrame([(0,), (1,), (3,)], "node_index bigint")).first()["is_contiguous"] is False


SCORED = "drug_idx bigint, gene_idx bigint, score double, association string, rank int"


def test_filtered_ranks_are_optimistic_and_mask_known_pairs(spark):
    rows = [(1, 10, 0.9, "associated"), (1, 11, 0.8, None), (1, 12, 0.7, "associated"), (1, 13, 0.7, None), (1, 14, 0.1, "associated"), (1, 12, 0.2, None), (2, 10, 0.5, "associated"), (None, 3, 1.0, None), (1, 15, float("nan"), None), (1, 16, None, "associated")]
    pool = rk.candidates(spark.createDataFrame([(*r, 5) for r in rows], SCORED))
    filtered = {(r["drug_idx"], r["gene_idx"]): r["rank"] for r in rk.rank_known(pool).collect()}
    raw = {(r["drug_idx"], r["gene_idx"]): r["rank"] for r in rk.rank_known(pool, filtered=False).collect()}
    assert filtered == {(1, 10): 1, (1, 12): 2, (1, 14): 3, (2, 10): 1}
    assert raw == {(1, 10): 1, (1, 12): 3, (1, 14): 5, (2, 10): 1}


def test_rank_metrics_golden(spark):
    got = rk.rank_metrics(spark.createDataFrame([(r,) for r in (1, 2, 4, 10, 20)], "rank bigint")).first()
    assert (got["mrr"], got["hits_at_1"], got["hits_at_3"], got["hits_at_10"], got["median_rank"], got["n"]) == (0.38, 0.2, 0.4, 0.8, 4.0, 5)
    none = rk.rank_metrics(spark.createDataFrame([], "rank bigint")).first()
    assert (none["mrr"], none["mean_rank"], none["median_rank"], none["n"]) == (0.0, 0.0, 0.0, 0)


def test_negative_samples(spark):
    positives = spark.createDataFrame([(0, 10), (0, 11), (1, 12)], "drug_idx bigint, gene_idx bigint")
    genes = spark.createDataFrame([(10 + i, i) for i in range(5)], "gene_idx bigint, local_index bigint")
    draw = lambda seed: sorted(tuple(r) for r in rk.negative_samples(positives, genes, positives, 2, seed).collect())
    got = draw(7)
    assert len(got) == 6 and not {(d, n) for d, _, _, n in got} & {(0, 10), (0, 11), (1, 12)}
    assert got == draw(7) != draw(8)


def test_calibration_prefers_small_alpha_then_order(spark):
    pool = spark.createDataFrame([(1, 10, 0.9, True, None), (1, 11, 0.1, False, None)], "drug_idx bigint, gene_idx bigint, score double, known boolean, label string")
    degree = spark.createDataFrame([(10, 3), (11, 3)], "gene_idx bigint, degree bigint")
    got = rk.calibration_grid(pool, degree).collect()
    assert len(got) == 17 and [r["alpha"] for r in got if r["chosen"]] == [0.0]


def test_early_stopping(spark):
    history = spark.createDataFrame([("a", e, m) for e, m in enumerate([0.1, 0.3, 0.2, 0.3, 0.4])], "run string, epoch bigint, metric double")
    got = sorted(rk.early_stopping(history, 2).collect(), key=lambda r: r["epoch"])
    assert [r["waited"] for r in got] == [0, 0, 1, 2, 0] and [r["stopped"] for r in got] == [False, False, False, True, True]


def test_tail_and_false_discovery(spark):
    assert stats.hypergeometric_tail(5, 10, 20, 100) == pytest.approx(0.025464546427, abs=1e-11)
    assert stats.hypergeometric_tail(0, 10, 20, 100) == 1 and stats.hypergeometric_tail(11, 10, 20, 100) == 0
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.03, 0.04, 0.04, 1.0])] + [(9, None)], "i int, p double")
    assert [round(r["q"], 9) for r in stats.bh_qvalues(df, "p").orderBy("i").collect()] == [0.05, 0.05, 0.05, 0.05, 1.0]


def test_bootstrap_interval_holds_the_mean_and_repeats(spark):
    df = spark.range(2000).select(F.lit("a").alias("g"), "id", (F.rand(3) - 0.3).alias("v"))
    once, twice = (stats.bootstrap_mean_ci(df, "v", "id", ["g"], draws=400).first() for _ in range(2))
    assert once == twice and once["low"] < once["mean"] < once["high"] and once["high"] - once["low"] == pytest.approx(2 * 1.96 * 0.2887 / 2000**0.5, rel=0.25)
