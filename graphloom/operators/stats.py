"""Tests and intervals: hypergeometric tails, false discovery rates, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from graphloom.operators.group_ranks import MOST, light_and_heavy, whole_groups
from graphloom.session import cut_lineage


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_tail(k: int, drawn: int, marked: int, total: int) -> float:
    """P(X >= k) for ``drawn`` draws without replacement from total of which ``marked`` are marked; 1 for k = 0."""
    if k <= 0:
        return 1.0
    top = min(drawn, marked)
    if k > top:
        return 0.0
    base = log_choose(total, drawn)
    terms = [log_choose(marked, i) + log_choose(total - marked, drawn - i) - base for i in range(max(k, drawn + marked - total), top + 1)]
    return min(1.0, math.fsum(math.exp(t) for t in terms))


@pandas_udf(DoubleType())
def tail_probability(k: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(*map(int, x)) for x in zip(k, drawn, marked, total, strict=True)], dtype=float)


def enrichment(sets: DataFrame, hits: DataFrame, universe: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Over-representation of hits (gene_idx) in sets (source, set_id, gene_idx), universe having one row and column n_universe.

    Per set: size, overlap, expectation, fold enrichment, p, and q and significance within its
    source. Sets without overlap have p 1. Sets are aggregated before the tail is computed.
    """
    distinct = sets.select("source", "set_id", "gene_idx").distinct()
    marked = distinct.join(hits.select("gene_idx").distinct().withColumn("hit", F.lit(1)), "gene_idx", "left")
    n_hits = hits.agg(F.count_distinct("gene_idx").alias("n_hits"))
    counts = marked.groupBy("source", "set_id").agg(F.count(F.lit(1)).alias("set_size"), F.count("hit").alias("overlap"))
    full = counts.crossJoin(F.broadcast(n_hits)).crossJoin(F.broadcast(universe))  # one row each
    full = full.withColumn("expected", F.col("n_hits") * F.col("set_size") / F.col("n_universe"))
    tested = full.withColumn("p", tail_probability("overlap", "n_hits", "set_size", "n_universe")).withColumn("fold", F.coalesce(F.try_divide("overlap", "expected"), F.lit(0.0)))
    return bh_qvalues(tested, "p", ["source"]).withColumn("significant", F.col("q") < fdr).select("source", "set_id", "set_size", "overlap", "fold", "p", "q", "significant")


def bh_qvalues(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """df with q, the Benjamini-Hochberg step-up values within ``by``; null p, and rows with a null in by, are left out.

    Equal p are added up first. With by, windows hold the distinct p values of a group. Without, distinct values are spread over
    ranges, whose counts and least values are carried from range to range, so no task holds them all.
    """
    keep = df.filter(F.col(p).isNotNull())
    levels = keep.groupBy(*by, p).agg(F.count(F.lit(1)).alias("__c"))
    if by:
        part = Window.partitionBy(*by)
        rank, total = F.sum("__c").over(part.orderBy(p)), F.sum("__c").over(part)
        stepped = levels.withColumn("__raw", F.col(p) * total / rank)
        q = F.least(F.lit(1.0), F.min("__raw").over(part.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)))
        return keep.join(stepped.withColumn("q", q).select(*by, p, "q"), [*by, p])
    spread = cut_lineage(levels.repartitionByRange(p).withColumn("__range", F.spark_partition_id()))
    own = Window.partitionBy("__range")
    every = Window.orderBy("__range")  # a row a range
    sizes = spread.groupBy("__range").agg(F.sum("__c").alias("__n"))
    lifts = sizes.select("__range", (F.sum("__n").over(every) - F.col("__n")).alias("__lift"), F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"))
    ranked = spread.join(F.broadcast(lifts), "__range").withColumn("__raw", F.col(p) * F.col("__total") / (F.col("__lift") + F.sum("__c").over(own.orderBy(p))))
    ranked = cut_lineage(ranked.withColumn("__least", F.min("__raw").over(own.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))))
    later = ranked.groupBy("__range").agg(F.min("__raw").alias("__m")).select("__range", F.min("__m").over(every.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    stepped = ranked.join(F.broadcast(later), "__range").select(p, F.least(F.lit(1.0), F.col("__least"), F.coalesce("__later", F.lit(1.0))).alias("q"))
    return keep.join(stepped, p)


def bootstrap_mean_ci(df: DataFrame, value: str, key: str, by: Sequence[str], draws: int = 2000, seed: int = 42, chunks: int = 64) -> DataFrame:
    """(by..., mean, low, high, n): mean with a 95 % percentile interval of a Poisson bootstrap.

    Rows are spread over chunks by a hash of the key; each chunk sends one weighted sum a draw, so
    groups of any size are bootstrapped without gathering them. Results depend on data and seed only.
    """
    spread = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), F.xxhash64(key).alias("__k"), F.pmod(F.xxhash64(key), F.lit(chunks)).alias("__c"))
    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__k", "__v"])
        rng = np.random.default_rng([seed, int(pdf["__c"].iloc[0])])
        x = pdf["__v"].to_numpy()
        sums, weights = np.zeros(draws), np.zeros(draws)
        for i in range(0, len(x), 2048):
            w = rng.poisson(1.0, (draws, len(x[i : i + 2048])))
            sums += w @ x[i : i + 2048]
            weights += w.sum(1)
        out = pd.DataFrame({"draw": np.arange(draws), "s": sums, "w": weights})
        for b in by:
            out.insert(0, b, pdf[b].iloc[0])
        return out[[*by, "draw", "s", "w"]]

    parts = spread.groupBy(*by, "__c").applyInPandas(resample, f"{kinds}, draw int, s double, w double")
    means = parts.groupBy(*by, "draw").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    ends = means.groupBy(*by).agg(F.expr("percentile(m, array(0.025, 0.975))").alias("ci"))
    stats = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return stats.join(ends, list(by)).select(*by, F.round("mean", 6).alias("mean"), F.round(F.col("ci")[0], 6).alias("low"), F.round(F.col("ci")[1], 6).alias("high"), "n")


def paired_bootstrap(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], draws: int = 10_000, seed: int = 42, most: int = MOST) -> DataFrame:
    """(by..., mean, low, high, n): mean with a 95 % percentile interval of resampled means, rows drawn with replacement.

    The rows of a group stand in the given order and are drawn by a NumPy generator of the seed, draw by draw, so equal
    seeds and orders give equal intervals anywhere. Groups of more than ``most`` rows take the Poisson bootstrap instead,
    which needs no group in memory. Null values don't count; rows with a null in by drop out.
    """
    clean = df.filter(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    light, heavy = light_and_heavy(clean, by, most)
    keys = [*by, *[c for c in order if c not in by]]
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, len(by)):
            values = table.column("__v").to_numpy()
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            rows = []
            for a, b in zip(starts, [*starts[1:], len(group)], strict=True):
                x, rng = values[a:b], np.random.default_rng(seed)
                means = np.array([x[rng.integers(0, len(x), size=len(x))].mean() for _ in range(draws)])
                rows.append((x.mean(), *np.percentile(means, [2.5, 97.5]), len(x)))
            first = table.select(list(by)).take(pa.array(starts)).combine_chunks().to_batches()
            numbers = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.float64(),) * 3 + (pa.int64(),), strict=True)]
            yield pa.RecordBatch.from_arrays([*first[0].columns, *numbers], names=[*by, "mean", "low", "high", "n"])

    placed = light.select(*keys, "__v").repartition(*by).sortWithinPartitions(*keys, "__v")
    out = placed.mapInArrow(resample, f"{kinds}, mean double, low double, high double, n bigint").select(*by, *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "n")
    if heavy is None:
        return out
    key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in order])
    return out.unionByName(bootstrap_mean_ci(heavy.withColumn("__key", key), value, "__key", by, draws, seed))
