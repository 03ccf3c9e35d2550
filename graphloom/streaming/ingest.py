"""Incremental ingest of raw records. An extension: the batch engine has no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from graphloom.operators.graph_build import prepare_relationships


def stream_relationships(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New parquet files of raw records as typed records, by the same expressions as in batch."""
    return prepare_relationships(spark.readStream.schema(schema).parquet(folder))


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived, each file once, and stops."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)
