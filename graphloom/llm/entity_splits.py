"""Splits that keep the records of an entity together (problem 1)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.entities import SPLITS, counted_rows, own_entity
from graphloom.operators.positions import join_heavy, with_position
from graphloom.session import cut_lineage

GOLDEN = 0.6180339887498949


def entities_across_splits(assignments: DataFrame, entities: DataFrame) -> DataFrame:
    """(drug_idx) of the counted rows whose drug entity has counted rows in more than one split.

    Rows without drug, gene or a label that names a split don't count. Rows are reduced to one a
    drug before anything is shuffled by drug, so a drug that holds a third of them does no harm.
    """
    bit = F.create_map(*[x for i, s in enumerate(SPLITS) for x in (F.lit(s), F.lit(1 << i))])
    drugs = counted_rows(assignments).groupBy("drug_idx").agg(F.bit_or(bit[F.col("split")]).alias("mask"))
    named = drugs.join(entities, "drug_idx", "left").select("drug_idx", "mask", own_entity("drug_entity", "drug_idx").alias("drug_entity"))
    mixed = named.groupBy("drug_entity").agg(F.bit_or("mask").alias("all")).filter(F.bit_count("all") > 1)
    return named.join(mixed, "drug_entity", "left_semi").select("drug_idx")


def deal_splits(sizes: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), head: int = 200) -> DataFrame:
    """(drug_entity, split) for sizes (drug_entity, n_rows).

    Entities are stratified by size band (powers of two). The few with more than 1/head of all rows
    (fewer than head of them, so the driver can hold them) are dealt first, largest first, each to
    the split that lacks most; within each band the others are dealt systematically, by a
    low-discrepancy walk over what the splits still lack. Proportions hold over rows as nearly as
    the largest entities allow. An empty input gives no rows. The result depends on the data only.
    """
    if abs(sum(shares) - 1) > 1e-9 or min(shares) < 0:
        raise ValueError("shares must be non-negative and add up to 1")
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    big = sizes.filter(F.col("n_rows") * head > total).collect() if total else []
    lacks = {s: share * total for s, share in zip(SPLITS, shares, strict=True)}
    dealt = []
    for row in sorted(big, key=lambda r: (-r["n_rows"], r["drug_entity"])):
        to = max(SPLITS, key=lambda s: lacks[s])
        lacks[to] -= row["n_rows"]
        dealt.append((row["drug_entity"], to))
    rest = {s: max(0.0, n) for s, n in lacks.items()}
    scale = sum(rest.values()) or 1.0
    first, second = rest["train"] / scale, (rest["train"] + rest["validation"]) / scale
    banded = sizes.filter(F.col("n_rows") * head <= total).withColumn("band", F.floor(F.log2("n_rows")))
    placed = with_position(banded, ["band"], ["drug_entity"], "place")
    walk = F.pmod((F.col("place") + 1) * F.lit(GOLDEN) + F.col("band") * F.lit(math.sqrt(2)), F.lit(1.0))
    split = F.when(walk < first, "train").when(walk < second, "validation").otherwise("test")
    tail = placed.select("drug_entity", split.alias("split"))
    return tail.unionByName(sizes.sparkSession.createDataFrame(dealt, "drug_entity string, split string")) if dealt else tail


def grouped_splits(assignments: DataFrame, entities: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(row_id, drug_idx, drug_entity, split) of every row with drug_idx and gene_idx, whatever its old label.

    All rows of one drug entity get the same split. A drug that nodes doesn't have is an entity of
    its own; re-sent rows go with their drug; rows without drug or gene get no split and no row.
    """
    rows = assignments.filter("drug_idx IS NOT NULL AND gene_idx IS NOT NULL").select("row_id", "drug_idx")
    counts = rows.groupBy("drug_idx").agg(F.count(F.lit(1)).alias("n_rows"))
    drugs = cut_lineage(
        counts.join(entities, "drug_idx", "left").select("drug_idx", "n_rows", own_entity("drug_entity", "drug_idx").alias("drug_entity"))
    )
    sizes = cut_lineage(drugs.groupBy("drug_entity").agg(F.sum("n_rows").alias("n_rows")))
    splits = deal_splits(sizes, shares)
    to_split = drugs.join(splits, "drug_entity").select("drug_idx", "drug_entity", "split")
    total = drugs.agg(F.sum("n_rows").alias("total"))
    heavy = drugs.crossJoin(F.broadcast(total)).filter("n_rows * 1000 > total").select("drug_idx")  # under 1,000 rows
    return join_heavy(rows, to_split, ["drug_idx"], heavy).select("row_id", "drug_idx", "drug_entity", "split")
