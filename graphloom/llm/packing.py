"""Filling fixed-capacity containers with items of varying length (problem 7).

Histogram packing: the lengths' histogram has at most as many rows as the capacity, so the plan is
made from it alone, however many items there are. Shallow combinations of length bins that fill the
capacity but for a small window are enumerated, non-negative least squares gives how often each is
repeated, and the repeats are rounded down; gaps and residual lengths are then filled greedily.
Items are dealt to the plan by their position among the items of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.positions import with_position
from graphloom.session import cut_lineage


@dataclass(frozen=True)
class Pattern:
    """repeat containers, each with the given multiset of lengths."""

    lengths: tuple[int, ...]
    repeat: int


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b| over x >= 0, by active sets (Lawson and Hanson).

    After ``rounds`` columns the best so far is taken: counts it leaves over are packed greedily, so only fill can suffer.
    """
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, atb = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0.0)))
    for _ in range(rounds):
        w = atb - gram @ x
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(on, on)], atb[on], rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[on] = z
                break
            down = z <= 0
            step = np.min(x[on][down] / np.maximum(x[on][down] - z[down], 1e-300))
            x[on] = np.maximum(x[on] + step * (z - x[on]), 0)
            dropped = on[x[on] <= 1e-12]
            if not len(dropped):
                dropped = on[down][:1]
            active[dropped] = False
            x[dropped] = 0
            if not active.any():
                break
    return x


def combinations_filling(bins: int, depth: int, window: int, present: set[int]) -> list[tuple[int, ...]]:
    """Multisets of at most depth present bins (sizes 1..bins) with a sum in (bins - window, bins]."""
    found: list[tuple[int, ...]] = []
    sizes = sorted(present, reverse=True)

    def grow(chosen: tuple[int, ...], total: int, at: int) -> None:
        if total > bins - window:
            found.append(chosen)
        if len(chosen) < depth:
            for i in range(at, len(sizes)):
                if total + sizes[i] <= bins:
                    grow((*chosen, sizes[i]), total + sizes[i], i)

    grow((), 0, 0)
    return found


class _Stock:
    """Counts by length, with the largest present length up to a limit."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.count[length] += n

    def largest(self, limit: int) -> int:
        hits = np.flatnonzero(self.count[1 : limit + 1])
        return int(hits[-1]) + 1 if len(hits) else 0

    def close(self, lengths: list[int], most: int, capacity: int) -> Pattern:
        """Fills the gap of a pattern greedily and takes it as often as the stock allows, at most ``most``."""
        gap = capacity - sum(lengths)
        used = dict.fromkeys(lengths, 0)
        for x in lengths:
            used[x] += 1
        while gap > 0:
            limit = gap
            while (x := self.largest(limit)) and self.count[x] <= used.get(x, 0):
                limit = x - 1
            if not x:
                break
            room = min(gap // x, max(1, int(self.count[x]) // max(1, most)))
            take = max(1, min(room, int(self.count[x]) - used.get(x, 0)))
            used[x] = used.get(x, 0) + take
            gap -= take * x
        repeat = min([most, *(int(self.count[x]) // n for x, n in used.items())])
        for x, n in used.items():
            self.count[x] -= n * repeat
        return Pattern(tuple(sorted((x for x, n in used.items() for _ in range(n)), reverse=True)), repeat)


def plan_containers(histogram: dict[int, int], capacity: int, bins: int = 64, depth: int = 3, window: int = 2) -> list[Pattern]:
    """Patterns that hold exactly the items of histogram (lengths 1..capacity).

    Each pattern uses up a length or a combination's share, so there are at most about capacity +
    2 * bins of them.
    """
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    stock = _Stock(histogram, capacity)
    patterns: list[Pattern] = []
    if stock.count[capacity]:
        patterns.append(Pattern((capacity,), int(stock.count[capacity])))
        stock.count[capacity] = 0
    width = -(-capacity // bins)
    of = lambda x: -(-x // width)  # noqa: E731  lengths are rounded up, so a combination always fits
    heights = np.zeros(bins + 1)
    for x in np.flatnonzero(stock.count):
        heights[of(int(x))] += stock.count[x]
    combos = combinations_filling(capacity // width, depth, window, {int(b) for b in np.flatnonzero(heights)})
    if combos:
        a = np.zeros((bins + 1, len(combos)))
        for j, combo in enumerate(combos):
            for b in combo:
                a[b, j] += 1
        scale = np.sqrt(np.arange(bins + 1) / bins)  # short lengths also fill gaps, so they may be off
        x = nnls(a * scale[:, None], heights * scale)
        for j in np.argsort(-x, kind="stable"):
            left = int(np.floor(x[j]))
            while left > 0:
                lengths: list[int] = []
                for b in combos[j]:
                    low, high = (b - 1) * width + 1, min(capacity, b * width)
                    held = [y for y in range(high, low - 1, -1) if stock.count[y] > lengths.count(y)]
                    if not held:
                        break
                    lengths.append(held[0])
                if len(lengths) < len(combos[j]):
                    break
                made = stock.close(lengths, left, capacity)
                patterns.append(made)
                left -= made.repeat
    while top := stock.largest(capacity):
        patterns.append(stock.close([top], int(stock.count[top]), capacity))
    return patterns


def pack_items(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(container_id, id, part, start, n_tokens): each item, or part of one, in its container.

    An item is split only if it is longer than a container: into full containers and a rest, which
    is packed like an item. The parts of a container add up to at most the capacity. Items of size 0
    or null take no room: one row with a null container_id. Repeated rows are items of their own.
    Container ids count from 0 without gaps. An empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    items = sizes.select(F.col(id_col).alias("__id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("size"))
    parts = cut_lineage(
        items.select("__id", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(size - 1) div {capacity}")).cast("int"))).alias("part"))
        .select("__id", "part", (F.col("part").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), F.expr(f"size - part * {capacity}L")).alias("n"))
    )
    histogram = {r["n"]: r["count"] for r in parts.filter("n > 0").groupBy("n").count().collect()}  # at most capacity rows
    patterns = plan_containers(histogram, capacity)
    starts, bases, times = [], [], []
    placed: dict[int, int] = {}
    container = 0
    for p in patterns:
        for length in sorted(set(p.lengths)):
            n = p.lengths.count(length)
            starts.append((length << 44) + placed.get(length, 0))
            bases.append(container)
            times.append(n)
            placed[length] = placed.get(length, 0) + n * p.repeat
        container += p.repeat
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    start, base, many = (np.array(v, np.int64)[order] for v in (starts, bases, times))
    numbered = with_position(parts.filter("n > 0"), ["n"], ["__id", "part"], "place")
    kind = sizes.schema[id_col].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("n").to_numpy().astype(np.int64) << 44) + batch.column("place").to_numpy()
            at = np.searchsorted(start, key, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(base[at] + (key - start[at]) // many[at]), batch.column("__id"), batch.column("part"), batch.column("start"), batch.column("n")],
                names=["container_id", "id", "part", "start", "n_tokens"],
            )

    fields = f"container_id bigint, id {kind}, part int, start bigint, n_tokens bigint"
    dealt = numbered.select("__id", "part", "start", F.col("n").cast("bigint").alias("n"), F.col("place").cast("bigint").alias("place")).mapInArrow(deal, fields)
    none = parts.filter("n <= 0").select(F.lit(None).cast("bigint").alias("container_id"), F.col("__id").alias("id"), "part", "start", F.lit(0).cast("bigint").alias("n_tokens"))
    return dealt.unionByName(none).withColumnRenamed("id", id_col)
