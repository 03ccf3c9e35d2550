"""Stages of a study over stored graphs and splits: training with ranks and predictions, and explanations of the first predictions."""

from __future__ import annotations

from dataclasses import asdict, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import NODE_TYPES
from graphloom.gnn.trainer import Known, TrainConfig, Trained, train
from graphloom.operators import graph_build as gb
from graphloom.operators import paths, ranking
from graphloom.operators.splits import orient_pairs
from graphloom.sources import results


def training_bundle(spark: SparkSession, graph: str, splits: str, protocol: str, seed: int, most: int) -> dict[str, np.ndarray | int]:
    """The arrays of one protocol and seed: nodes, edges of the training graph, and associated pairs of each split; more than ``most`` edges are an error."""
    nodes = spark.read.parquet(f"{graph}/nodes").select("node_index", "node_type")
    rows = spark.read.parquet(f"{splits}/edge_assignments").filter((F.col("protocol") == protocol) & (F.col("seed") == seed))
    known = orient_pairs(rows.drop("drug_idx")).filter("association = 'associated'").select("drug_idx", "gene_idx", "supervision_split").distinct()
    edges = rows.filter("in_training_graph AND source_idx IS NOT NULL AND target_idx IS NOT NULL").select("source_idx", "target_idx", "rel_idx")
    if max(edges.count(), nodes.count()) > most:
        raise ValueError("the graph is too large for one machine; use the layers of graphloom.gnn.layers")
    table, kept = nodes.orderBy("node_index").toPandas(), edges.orderBy("source_idx", "target_idx", "rel_idx").toPandas()
    pairs = known.orderBy("drug_idx", "gene_idx", "supervision_split").toPandas()
    ids = table["node_index"].to_numpy()
    at = lambda values: np.searchsorted(ids, values)
    both = np.column_stack([at(pairs["drug_idx"]), at(pairs["gene_idx"])])
    split = pairs["supervision_split"].to_numpy()
    kind = table["node_type"].map({k: i for i, k in enumerate(NODE_TYPES)}).to_numpy()
    trained = np.isin(split, ("train", "training_context_only"))
    return {
        "n_nodes": len(ids), "edges": np.column_stack([at(kept["source_idx"]), at(kept["target_idx"])]), "relations": kept["rel_idx"].to_numpy(), "node_type": kind, "ids": ids,
        "positives": both[trained], "validation": both[split == "validation"], "test": both[split == "test"], "known": both, "genes": np.flatnonzero(kind == NODE_TYPES.index("gene")),
    }


def scored_candidates(spark: SparkSession, made: Trained, bundle: dict, pairs: np.ndarray) -> DataFrame:
    """(drug_idx, gene_idx, score, known) of every gene for every drug of pairs; known are all associated pairs."""
    told, genes, ids = Known(bundle["known"], bundle["n_nodes"]), bundle["genes"], bundle["ids"]
    drugs = np.unique(pairs[:, 0])
    query = spark.createDataFrame([(int(ids[d]), (made.embedding[d] * made.relation[0]).tolist(), ids[told.of(int(d))].tolist()) for d in drugs], "drug_idx bigint, q array<double>, known array<bigint>")
    y, g = made.embedding[genes], ids[genes]

    def score(batches):
        for pdf in batches:
            for drug, q, known in zip(pdf["drug_idx"], pdf["q"], pdf["known"], strict=True):
                yield pdf.__class__({"drug_idx": drug, "gene_idx": g, "score": y @ np.asarray(q), "known": np.isin(g, known)})

    return query.repartition("drug_idx").mapInPandas(score, "drug_idx bigint, gene_idx bigint, score double, known boolean")


def train_stage(spark: SparkSession, graph: str, splits: str, out: str, protocol: str, seed: int, config: TrainConfig | None = None) -> str:
    """Trains one model on one protocol and seed; writes configuration, model, history, filtered ranks of test pairs, their metrics and each test drug's 25 best unknown genes. Returns the run's name."""
    config = replace(config or TrainConfig(), seed=seed)
    bundle = training_bundle(spark, graph, splits, protocol, seed, config.most_edges)
    made = train(config=config, **{k: v for k, v in bundle.items() if k not in ("ids", "test")})
    run = results.write_run_config(spark, {**asdict(config), "protocol": protocol}, out, f"{config.model}_{protocol}_{seed}")
    results.write_model(spark, made.model, out, run)
    folder = f"{out}/{run}"
    history = [(e, float(x), float(m), e == made.best_epoch) for e, x, m in made.history]
    spark.createDataFrame(history, "epoch bigint, loss double, validation_mrr double, best boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/history")
    pool = scored_candidates(spark, made, bundle, bundle["test"])
    test = spark.createDataFrame([(int(bundle["ids"][d]), int(bundle["ids"][g])) for d, g in bundle["test"]], "drug_idx bigint, gene_idx bigint")
    ranks = ranking.rank_known(pool).join(test, ["drug_idx", "gene_idx"], "left_semi")
    results.write_ranks(ranks.select("drug_idx", "gene_idx", "score", "rank"), out, run)
    metrics = ranking.rank_metrics(spark.read.parquet(f"{folder}/ranks"))
    results.write_report(metrics, out, run)
    ranking.top_candidates(pool.filter("NOT known")).write.mode("overwrite").parquet(f"{folder}/predictions")
    results.write_json(spark, {**made.summary(), "protocol": protocol, "seed": seed, "train_pairs": len(bundle["positives"]), "validation_pairs": len(bundle["validation"]), "test_pairs": len(bundle["test"])}, f"{folder}/summary")
    return run


def explain_stage(spark: SparkSession, graph: str, out: str, run: str, top: int = 50) -> DataFrame:
    """Explanations of a run's first predictions, by place and drug: a top-k report, written beside them."""
    edges, nodes = spark.read.parquet(f"{graph}/edges"), spark.read.parquet(f"{graph}/nodes")
    first = spark.read.parquet(f"{out}/{run}/predictions").orderBy("place", "drug_idx", "gene_idx").limit(top)
    told = paths.explain_pairs(paths.symmetric(edges), gb.pair_relation(edges), nodes, gb.simple_degree(gb.undirected_edges(edges)), first.select("drug_idx", "gene_idx"))
    told.join(first.select("drug_idx", "gene_idx", "place", "score"), ["drug_idx", "gene_idx"]).write.mode("overwrite").parquet(f"{out}/{run}/explanations")
    return spark.read.parquet(f"{out}/{run}/explanations")
