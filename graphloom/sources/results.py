"""Tables of runs: ranks, model parameters, fingerprint matrices, run configurations and reports, written and read again.

A run is a folder; what is read from many runs has the run's name as a column.
"""

from __future__ import annotations

import json
import platform
from datetime import UTC, datetime

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.gnn.models import GraphModel

RUN = r"([^/]+)/[^/]+/[^/]+$"


def run_id(now: datetime | None = None) -> str:
    """A name for a run by its time in UTC."""
    return (now or datetime.now(UTC)).strftime("%Y%m%d_%H%M%S")


def read_json(spark: SparkSession, path: str) -> dict:
    """One small JSON document, from any file system Spark reads; no document, or several, is an error."""
    texts = [r["value"] for r in spark.read.text(path, wholetext=True).limit(2).collect()]
    if len(texts) != 1:
        raise ValueError(f"{len(texts) or 'no'} documents at {path}")
    return json.loads(texts[0])


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON document as a one-line text table."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run_config(spark: SparkSession, config: dict, folder: str, name: str | None = None) -> str:
    """The resolved configuration of a run, with versions and its time; returns the run's name."""
    name = name or run_id()
    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": np.__version__}
    write_json(spark, {"run": name, "config": config, "versions": versions, "started": datetime.now(UTC).isoformat()}, f"{folder}/{name}/config")
    return name


def write_ranks(ranks: DataFrame, folder: str, run: str) -> None:
    ranks.write.mode("overwrite").parquet(f"{folder}/{run}/ranks")


def write_report(report: DataFrame, folder: str, run: str) -> None:
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{run}/report")


def read_runs(spark: SparkSession, folder: str, what: str = "ranks", pattern: str = "*") -> DataFrame:
    """The tables ``what`` (ranks, report, model or fingerprints) of all runs whose name fits the pattern, with the column ``run``."""
    path = f"{folder}/{pattern}/{what}"
    read = spark.read.option("header", True).option("inferSchema", True).csv if what == "report" else spark.read.parquet
    df = read(path).drop("run")
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), RUN, 1))


def write_model(spark: SparkSession, model: GraphModel, folder: str, run: str) -> None:
    """Parameters by name, row by row, with what the model is; tables of any width."""
    rows = []
    for name, value in model.params.items():
        flat = value.reshape(-1, value.shape[-1])
        rows += [(name, i, list(value.shape), row.tolist()) for i, row in enumerate(flat)]
    about = {"name": model.name, "dim": model.dim, "dropout": model.dropout, "drug_type": model.drug_type, "parameters": model.count_parameters()}
    spark.createDataFrame(rows, "name string, row bigint, shape array<bigint>, value array<double>").write.mode("overwrite").parquet(f"{folder}/{run}/model")
    write_json(spark, about, f"{folder}/{run}/model_info")


def read_model(spark: SparkSession, folder: str, run: str) -> GraphModel:
    """A model as it was written; one machine holds it."""
    about = read_json(spark, f"{folder}/{run}/model_info/part-*")
    params: dict[str, list] = {}
    shapes = {}
    for r in spark.read.parquet(f"{folder}/{run}/model").orderBy("name", "row").toLocalIterator():
        params.setdefault(r["name"], []).append(r["value"])
        shapes[r["name"]] = r["shape"]
    return GraphModel(about["name"], about["dim"], about["dropout"], about["drug_type"], {k: np.array(v, float).reshape(shapes[k]) for k, v in params.items()})


def write_fingerprints(drugs: DataFrame, folder: str, run: str) -> DataFrame:
    """drugs (node, node_name, fp) as a table of vectors with a mark of who has one; returns the one-row summary, which is written too."""
    marked = drugs.select("node", "node_name", F.col("fp").isNotNull().alias("has_fingerprint"), F.col("fp").cast("array<double>").alias("fp"))
    marked.write.mode("overwrite").parquet(f"{folder}/{run}/fingerprints")
    stored = drugs.sparkSession.read.parquet(f"{folder}/{run}/fingerprints")
    summary = stored.agg(
        F.count(F.lit(1)).alias("n_drugs"), F.count_if(F.col("has_fingerprint")).alias("n_with_fingerprint"), F.coalesce(F.max(F.size("fp")), F.lit(0)).alias("n_bits"),
        F.count_distinct(F.when(F.col("has_fingerprint"), F.xxhash64("fp"))).alias("n_distinct"),
    )
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/{run}/fingerprint_summary")
    return drugs.sparkSession.read.json(f"{folder}/{run}/fingerprint_summary")


def bundle_sizes(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """One row: nodes, relations and edges of a training graph (edges with rel), pairs (split) of each split, and fingerprints."""
    counts = [
        nodes.agg(F.count(F.lit(1)).alias("n_nodes")), edges.agg(F.count_distinct("rel").alias("n_relations"), F.count(F.lit(1)).alias("n_edges")),
        pairs.agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}_pairs") for s in ("train", "validation", "test")]),
        fingerprints.agg(F.count_if(F.col("fp").isNotNull()).alias("n_fingerprints")) if fingerprints is not None else nodes.limit(0).agg(F.count(F.lit(1)).alias("n_fingerprints")),
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out
