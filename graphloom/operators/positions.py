"""Distributed positions and joins that don't gather a heavy key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, estimated_bytes


def with_position(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    bucket: Column | None = None,
    buckets: int | None = None,
    bucket_bytes: int = 4 << 20,
) -> DataFrame:
    """df with the 0-based position of each row in its group.

    Rows stand in the order of ``order`` if bucket, a coarse key that rises with it, is given; else
    in a fixed pseudo-random order by a hash of the order columns. Ties of all order columns get
    different positions in no fixed order. No window holds a group: rows are numbered within
    (group, bucket) and lifted by the sizes of the buckets before. df is read twice, so cut its
    lineage first if it is costly. Null groups are groups.
    """
    df = df.drop(name)
    n = buckets or max(16, min(100_000, -(-estimated_bytes(df) // bucket_bytes)))
    keyed = df.withColumn("__h", F.xxhash64(*order) if bucket is None else F.lit(0))
    keyed = keyed.withColumn("__bucket", F.pmod("__h", F.lit(n)) if bucket is None else bucket)
    by = [*groups, "__bucket"]
    sizes = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__bucket")
    lifts = sizes.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col("__bucket").alias("__b"),
        (F.sum("__n").over(before) - F.col("__n")).alias("__lift"),
    )
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = Window.partitionBy(*by).orderBy("__h", *order)
    numbered = keyed.withColumn("__row", F.row_number().over(within))
    return (
        numbered.join(lifts, same)
        .withColumn(name, F.col("__lift") + F.col("__row") - 1)
        .select(*df.columns, name)
    )


def global_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with the 0-based position of each row in the total order of the order columns.

    A range-partitioned sort, stored so that partitions keep their rows; a row's position is its
    place in its partition plus the sizes of the partitions before (one number a partition).
    Nulls come first. An empty input gives no rows.
    """
    df = df.drop(name)
    spread = cut_lineage(df.orderBy(*order)).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = spread.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    lifts = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__lift"))
    return (
        spread.withColumn("__p", part)
        .join(F.broadcast(lifts), "__p")  # a row a partition
        .withColumn(name, F.col("__lift") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .select(*df.columns, name)
    )


def count_greater(df: DataFrame, groups: Sequence[str], score: str, weight: Column, name: str) -> DataFrame:
    """(groups..., score, name): per distinct score of a group, the sum of weight over rows with a strictly greater score.

    Rows are first added up by (group, score) and spread over ranges of (group, score), whose bounds Spark takes from the data; the
    running sums are taken within a range and lifted by the ranges before, so no window holds more than a range, however scores
    or groups are distributed. Null and NaN scores, and rows with a null in groups, are left out.
    """
    clean = df.filter(F.col(score).isNotNull() & ~F.isnan(score)).dropna(subset=list(groups))
    by_score = clean.groupBy(*groups, score).agg(F.sum(weight).alias("__w"))
    ranges = by_score.repartitionByRange(*groups, F.desc(score)).select("*", F.spark_partition_id().alias("__range"))
    spread = cut_lineage(ranges)
    before = Window.partitionBy(*groups).orderBy("__range")
    sizes = spread.groupBy(*groups, "__range").agg(F.sum("__w").alias("__n"))
    lifts = sizes.select(*groups, "__range", (F.sum("__n").over(before) - F.col("__n")).alias("__lift"))
    within = Window.partitionBy(*groups, "__range").orderBy(F.desc(score))
    run = spread.withColumn("__run", F.sum("__w").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w"))
    return run.join(lifts, [*groups, "__range"]).select(*groups, score, (F.col("__run") + F.col("__lift")).alias(name))


def join_heavy(
    left: DataFrame, right: DataFrame, on: Sequence[str], heavy: DataFrame, how: str = "inner"
) -> DataFrame:
    """left ⋈ right on columns, where left holds a few heavy keys and right has each key once.

    heavy has the heavy keys (columns ``on``); the caller proves that they are few, as the keys with
    at least a given share of the rows are. Their rows of left stay where they are and meet a
    broadcast of their rows of right; all others meet in a shuffle. A null in ``on`` matches nothing.
    how is inner or left. Other columns of the same name must not stand on both sides.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    few = F.broadcast(heavy.select(*on).distinct())
    hot = left.join(few, list(on), "left_semi").join(
        F.broadcast(right.join(few, list(on), "left_semi")), list(on), how
    )
    cold = left.join(few, list(on), "left_anti").join(right, list(on), how)
    return hot.unionByName(cold)


def accession(col: Column) -> Column:
    """The digits after PA of an accession id, however it is written, without leading zeros; else null."""
    digits = F.regexp_extract(col, r"(?i)PA[^0-9A-Za-z]*0*([0-9]+)", 1)
    return F.when(digits != "", digits)
