"""Ranks within groups in one pass: rows are partitioned by group once, and whole groups are ranked as they stream by."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

MOST = 1_000_000


def better_before(group: np.ndarray, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each row: how many rows of its group that count have a strictly higher score. Rows of a group stand together."""
    order = np.lexsort((-score, group))
    g, s = group[order], score[order]
    before = np.concatenate([[0], np.cumsum(counts[order])])[:-1]
    at = np.arange(len(g))
    new_group = np.diff(g, prepend=-1) != 0
    new_run = new_group | (np.diff(s, prepend=np.nan) != 0)
    run, start = (np.maximum.accumulate(np.where(flag, at, 0)) for flag in (new_run, new_group))
    out = np.empty(len(g), np.int64)
    out[order] = before[run] - before[start]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the number of each row's group; rows come sorted by their first ``keys`` columns, none of which is null."""
    kept: list[pa.RecordBatch] = []

    def numbered(table: pa.Table) -> np.ndarray:
        change = np.zeros(len(table), bool)
        for i in range(keys):
            column = table.column(i).combine_chunks()
            change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if all(batch.column(i)[0] == batch.column(i)[-1] and batch.column(i)[0] == kept[0].column(i)[0] for i in range(keys)):
            continue  # still within one group
        table = pa.Table.from_batches(kept)
        group = numbered(table)
        last = int(np.searchsorted(group, group[-1]))
        yield table.slice(0, last), group[:last]
        kept = table.slice(last).combine_chunks().to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, numbered(table)


def light_and_heavy(df: DataFrame, groups: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """df's rows of groups of at most ``most`` rows, and of larger ones (None, if there are none). Rows with a null in groups drop out."""
    named = df.filter(" AND ".join(f"`{g}` IS NOT NULL" for g in groups))
    heavy = cut_lineage(named.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(*groups))
    if heavy.isEmpty():
        return named, None
    return named.join(heavy, list(groups), "left_anti"), named.join(heavy, list(groups), "left_semi")


def over_groups(df: DataFrame, groups: Sequence[str], columns: Sequence[str], function: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """function over tables of whole groups of df's groups and columns; a group is held in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, len(groups)):
            yield function(table, group)

    others = [c for c in columns if c not in groups]
    return df.select(*groups, *others).repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, schema)
