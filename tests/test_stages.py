from __future__ import annotations

import pytest

from graphloom import cli, stages
from graphloom.gnn.trainer import TrainConfig
from graphloom.operators.splits import SplitConfig
from graphloom.sources import results as rs


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    """20 drugs, 16 genes of four families and 4 variants; a drug goes with the genes of its family."""
    folder = tmp_path_factory.mktemp("study")
    nodes = [(i, f"n{i}", "drug" if i < 20 else "gene" if i < 36 else "variant") for i in range(40)]
    spark.createDataFrame(nodes, "node_index bigint, node_name string, node_type string").write.parquet(f"{folder}/graph/nodes")
    kind = lambda i: nodes[i][2]
    links = [(d, g, "associated") for d in range(20) for g in range(20, 36) if d % 4 == g % 4] + [(d, 20 + (d + 1) % 16, "ambiguous") for d in range(20)]
    links += [(d, 36 + d % 4, "associated") for d in range(20)] + [(36 + v, g, "associated") for v in range(4) for g in range(20, 36) if g % 4 == v]
    both = [(a, b, x, y, e) for a, b, e in links for x, y in ((a, b), (b, a))]
    rows = [(i, x, y, kind(x), kind(y), f"{kind(x)}_{kind(y)}_{e}", "literature", e, hash_of(kind(x), kind(y), e)) for i, (_, _, x, y, e) in enumerate(both)]
    spark.createDataFrame(rows, "edge_index bigint, source_idx bigint, target_idx bigint, source_type string, target_type string, relation_type string, evidence string, association string, rel_idx bigint").write.parquet(f"{folder}/graph/edges")
    cli.build_splits(spark, f"{folder}/graph", f"{folder}/splits", SplitConfig(train=0.6, validation=0.2, test=0.2, seeds=(42,)))
    return folder


def hash_of(a, b, e):
    return ["drug", "gene", "variant"].index(a) * 6 + ["drug", "gene", "variant"].index(b) * 2 + (e == "ambiguous")


@pytest.mark.parametrize("protocol", ["dg_context", "strict_cold"])
def test_training_writes_ranks_and_predictions(spark, study, protocol):
    out = f"{study}/runs"
    run = stages.train_stage(spark, f"{study}/graph", f"{study}/splits", out, protocol, 42, TrainConfig(model="rgcn", dim=16, epochs=30, rate=0.02, dropout=0.0))
    assert run == f"rgcn_{protocol}_42" and rs.read_model(spark, out, run).name == "rgcn"
    told = rs.read_json(spark, f"{out}/{run}/summary/part-*")
    ranks = rs.read_runs(spark, out, "ranks", run).collect()
    drugs = {r["drug_idx"] for r in ranks}
    assert told["test_pairs"] == len(ranks) == 4 * len(drugs) == 16 and told["validation_pairs"] == 16
    assert all(1 <= r["rank"] <= 13 for r in ranks)  # 16 genes, of which three other known ones don't count
    predicted = rs.read_runs(spark, out, "predictions", run).collect()
    assert {r["drug_idx"] for r in predicted} == drugs and len(predicted) == 12 * len(drugs)
    assert all(r["gene_idx"] % 4 != r["drug_idx"] % 4 for r in predicted)  # known genes aren't predicted
    history = spark.read.parquet(f"{out}/{run}/history").collect()
    assert sum(r["best"] for r in history) == 1 and rs.read_runs(spark, out, "report", run).first()["n"] == 16


def test_explanations_of_a_run(spark, study):
    out = f"{study}/runs"
    run = stages.train_stage(spark, f"{study}/graph", f"{study}/splits", out, "dg_context", 42, TrainConfig(dim=8, epochs=2))
    got = stages.explain_stage(spark, f"{study}/graph", out, run, top=5).collect()
    assert len(got) == 5 and all(r["shortest_path_length"] >= 1 and r["n_shared_genes"] > 0 for r in got)
    with pytest.raises(ValueError, match="too large"):
        stages.train_stage(spark, f"{study}/graph", f"{study}/splits", out, "dg_context", 42, TrainConfig(most_edges=5))
