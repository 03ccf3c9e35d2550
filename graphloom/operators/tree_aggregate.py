"""Aggregation over skewed keys as a tree of merges.

Input chunks of a fixed number of rows are combined locally, and the partial states are merged in
rounds of a bounded fan-in. A key that holds a third of all rows is therefore never sent to one
reducer in as many partials as there are chunks: a reducer sees at most ``fan_in`` states of a key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import estimated_bytes

CHUNK = "__chunk"


def merge_rounds(n_chunks: int, fan_in: int) -> int:
    """Rounds until n_chunks states of a key are one: the logarithm to the base fan_in, at least 1."""
    rounds, width = 1, fan_in
    while width < n_chunks:
        rounds, width = rounds + 1, width * fan_in
    return rounds


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: Mapping[str, Column],
    merge: Mapping[str, Column],
    *,
    fan_in: int = 16,
    chunk_rows: int = 1_000_000,
    chunk_bytes: int = 16 << 20,
) -> DataFrame:
    """Aggregate df by keys through local chunks and merge rounds.

    partial: aggregates over input rows, by state name. merge: aggregates over states, by the same
    names. Both must be associative and commutative (sum, min, max, collect-free sketches).

    Chunks are numbered by partition and by place in it, and neighbours in number are merged: at most fan_in states of a key
    in every round but the last, which takes what is left of partitions larger than estimated.

    Nulls: a null key is a key of its own, as in GROUP BY. An empty input gives no rows. Extra
    columns of df are ignored; a column of df named ``__chunk`` is dropped first.
    """
    if set(partial) != set(merge):
        raise ValueError("partial and merge must have the same names")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    n_chunks = max(1, math.ceil(estimated_bytes(df) / chunk_bytes))
    rounds = merge_rounds(n_chunks, fan_in)
    row_in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chunk = F.spark_partition_id() + F.lit(n_chunks) * F.floor(row_in_partition / chunk_rows)
    state = (
        df.drop(CHUNK)
        .withColumn(CHUNK, chunk)
        .groupBy(*keys, CHUNK)
        .agg(*[c.alias(name) for name, c in partial.items()])
    )
    merges = [c.alias(name) for name, c in merge.items()]
    for _ in range(rounds - 1):
        state = (
            state.withColumn(CHUNK, F.expr(f"{CHUNK} div {fan_in}")).groupBy(*keys, CHUNK).agg(*merges)
        )
    return state.groupBy(*keys).agg(*merges)


def tree_count(df: DataFrame, keys: Sequence[str], name: str = "n_rows", **options: int) -> DataFrame:
    """Rows per key by tree_aggregate."""
    return tree_aggregate(df, keys, {name: F.count(F.lit(1))}, {name: F.sum(name)}, **options)


def endpoint_rows(edges: DataFrame, *extra: str) -> DataFrame:
    """(side, node_idx, extra...) of both ends of every edge, in one scan."""
    return edges.select(
        F.expr("stack(2, 'source', source_idx, 'target', target_idx)").alias("side", "node_idx"), *extra
    )


def node_degrees(edges: DataFrame, **options: int) -> DataFrame:
    """(side, node_idx, degree): rows of edges per node and side; rows without a node are left out.

    Re-sent edges count as often as they stand in the table.
    """
    counts = tree_count(endpoint_rows(edges), ["side", "node_idx"], "degree", **options)
    return counts.filter(F.col("node_idx").isNotNull())


def node_relation_counts(edges: DataFrame, **options: int) -> DataFrame:
    """(side, node_idx, relation_type, n_rows); a null relation is a relation of its own."""
    counts = tree_count(
        endpoint_rows(edges, "relation_type"), ["side", "node_idx", "relation_type"], **options
    )
    return counts.filter(F.col("node_idx").isNotNull())


def heavy_nodes(edges: DataFrame, share: tuple[int, int] = (2, 100), **options: int) -> DataFrame:
    """(side, node_idx) of nodes with at least share[0]/share[1] of all rows of edges on that side.

    All rows count towards the total, also those without a node. An empty table has no heavy node.
    """
    counts = tree_count(endpoint_rows(edges), ["side", "node_idx"], **options)
    total = edges.agg(F.count(F.lit(1)).alias("total"))
    return (
        counts.filter(F.col("node_idx").isNotNull())
        .crossJoin(F.broadcast(total))  # one row
        .filter(F.col("n_rows") * share[1] >= F.col("total") * share[0])
        .select("side", "node_idx")
    )
