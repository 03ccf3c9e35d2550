"""Top N items within every group by secondary sort (problem 2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import shuffle_parts


def _emit(n: int, ranked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams sorted Arrow batches (group, score, item) and emits the first n distinct items of each group.

    Between batches only the items emitted for the last group are kept, at most n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            group, item = (batch.column(i).to_numpy() for i in (0, 1))
            at = np.arange(len(group))
            order = np.lexsort((at, item, group))
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(group[order]) != 0) | (np.diff(item[order]) != 0)
            fresh = np.zeros(len(at), bool)
            fresh[order[new]] = True  # the first, so the best, of equal items of a group
            carried = group == last if last is not None else np.zeros(len(at), bool)
            fresh &= ~(carried & np.isin(item, seen))
            count = np.cumsum(fresh)
            start = np.maximum.accumulate(np.where(np.diff(group, prepend=group[0] - 1) != 0, at, 0))
            rank = count - (count - fresh)[start] + carried * len(seen)
            kept = fresh & (rank <= n)
            end = int(group[-1])
            mine = item[kept & (group == end)]
            seen = np.concatenate([seen, mine]) if end == last else mine
            last = end
            out = batch.filter(pa.array(kept))
            columns, names = list(out.columns), ["group", "item", "score"]
            if ranked:
                columns, names = [*columns, pa.array(rank[kept], pa.int64())], [*names, "rank_no"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, part_bytes: int = 64 << 20) -> DataFrame:
    """(group, item, score, rank_no) with the n best distinct items of every group.

    Best is the highest score, then the smaller item. An item that stands more than once in a group
    counts once, with its highest score. Rows with a null group or item, or a null or NaN score,
    don't count; a group without other rows gives none. group and item are bigint; other columns,
    whatever their names, are ignored.

    Secondary sort: rows are sorted by (group, score, item) and streamed, n rows a group passing.
    First within the input partitions, without a shuffle, which leaves at most n rows a group and
    partition; then by hash of group and item, so that a group of millions of rows is spread; then by
    hash of the group, where rows of all parts of a group meet and are ranked. The middle step is left out where rows
    of part_bytes each make no more partitions than the session has; it changes no result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    rows = df.select(
        F.col(group).cast("bigint").alias("group"), F.col(item).cast("bigint").alias("item"), F.col(score).cast("double").alias("score")
    ).filter("group IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    order = [F.col("group"), F.col("score").desc(), F.col("item")]
    fields = "group bigint, item bigint, score double"
    parts = shuffle_parts(rows, part_bytes)
    local = rows.sortWithinPartitions(*order).mapInArrow(_emit(n, False), fields)
    width = max(1, parts // int(spark.conf.get("spark.sql.shuffle.partitions")))
    if width > 1:
        salt = F.pmod(F.xxhash64("item"), F.lit(width))
        local = local.repartition(parts, "group", salt).sortWithinPartitions(*order).mapInArrow(_emit(n, False), fields)
    return (
        local.repartition(parts, "group").sortWithinPartitions(*order).mapInArrow(_emit(n, True), f"{fields}, rank_no bigint")
        .select(F.col("group").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank_no")
    )
