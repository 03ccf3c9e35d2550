"""Session helpers: building a session, shared storage for lineage cuts, table loading."""

from __future__ import annotations

import atexit
import math
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "graphloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE, Arrow): local, or under spark-submit on the master that it names."""
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    start = SparkSession.builder if submitted else SparkSession.builder.master(f"local[{cores}]")
    builder = (
        start.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in spark.checkpoint.dir; a cluster that names none is an error, since executors can't share a folder
    of one machine. Only a local session without the setting (tests, a laptop) gets a folder of its own, removed when Python ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-checkpoint-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return the stored copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame, partition_bytes: int = 16 << 20) -> int:
    """The size of the sources that df reads, from Catalyst's statistics and the files of stored checkpoints; costs no job.

    Estimates of joins are products of their sides and useless here, so the leaves of the plan are
    added up. What has neither statistics nor files counts by its partitions.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            stored = leaf.rdd().getCheckpointFile()
            total += _folder_bytes(df.sparkSession, stored.get()) if stored.isDefined() else leaf.rdd().getNumPartitions() * partition_bytes
        else:
            total += int(str(leaf.stats().sizeInBytes()))
    return total


def _folder_bytes(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def write_file(spark: SparkSession, text: str, path: str) -> None:
    """One small text file on any file system Spark writes, folders above it included."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def shuffle_parts(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for an explicit repartition of df: by size, at least the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(100_000, math.ceil(estimated_bytes(df) / bytes_each)))


SHUFFLED = re.compile(r"^[\s:+|\-]*(Join|Aggregate|Distinct|Repartition\w*|RebalancePartitions|Sort|Window|GlobalLimit|Deduplicate|Intersect|Except)\b", re.M)


def spread_input(df: DataFrame) -> DataFrame:
    """df with at least as many partitions as there are cores, for work that costs much more than moving the rows.

    Few large files make few input partitions; more than that are left as they are, without a shuffle. So is a plan that
    shuffles anyway: its partitions can't be counted without running it. The rows are the same in all cases.
    """
    if SHUFFLED.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
