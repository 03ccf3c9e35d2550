"""Writing graphs, splits, maps, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import write_file


def write_graph(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, folder: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("endpoint_aliases", aliases)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_splits(df: DataFrame, folder: str) -> None:
    """Partitioned by protocol and seed, so one run is read without the others."""
    df.repartition("protocol", "seed", F.pmod(F.xxhash64(*df.columns), F.lit(64))).write.mode("overwrite").partitionBy("protocol", "seed").parquet(folder)


def write_mapping(df: DataFrame, key: str, value: str, path: str, most: int = 100_000) -> None:
    """A small dimension as one JSON object; larger ones raise and belong in parquet."""
    rows = df.select(key, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries; write parquet instead")
    write_file(df.sparkSession, json.dumps({str(r[0]): r[1] for r in sorted(rows, key=lambda r: str(r[0]))}, indent=2, ensure_ascii=False), path)


def write_manifest(one_row: DataFrame, path: str) -> None:
    write_file(one_row.sparkSession, json.dumps(one_row.first().asDict(recursive=True), indent=2, default=str), path)


def write_report(df: DataFrame, folder: str) -> None:
    """An aggregate as a single CSV file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
