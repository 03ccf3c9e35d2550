"""Pairs, cold-drug splits, held-out edges and leakage audits. Seeds and protocols are columns."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators.graph_build import DRUG_GENE
from graphloom.operators.positions import with_position

PROTOCOLS = ("dg_context", "strict_cold")


@dataclass(frozen=True)
class SplitConfig:
    """Shares of train, validation and test, seeds, and the least number of positive pairs of a drug."""

    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1
    seeds: tuple[int, ...] = (42, 123, 2026)
    least_pairs: int = 2

    def __post_init__(self) -> None:
        if abs(self.train + self.validation + self.test - 1) > 1e-9:
            raise ValueError("the shares must add up to 1")
        if min(self.train, self.validation, self.test) <= 0:
            raise ValueError("the shares must be positive")
        if not self.seeds or len(set(self.seeds)) != len(self.seeds):
            raise ValueError("seeds must be given and distinct")
        if self.least_pairs < 2:
            raise ValueError("strata begin at 2 pairs")

    def sizes(self, n: int) -> tuple[int, int, int]:
        """Half-even rounded validation and test sizes; train has the rest."""
        validation, test = round(n * self.validation), round(n * self.test)
        return n - validation - test, validation, test


def orient_pairs(edges: DataFrame) -> DataFrame:
    """Drug-gene rows with drug_idx and gene_idx, whichever way they point. Rows with null types don't qualify.

    Columns of these names are replaced.
    """
    edges = edges.drop("drug_idx", "gene_idx")
    forward = F.col("source_type") == "drug"
    return edges.filter(DRUG_GENE).select(
        *edges.columns,
        F.when(forward, F.col("source_idx")).otherwise(F.col("target_idx")).alias("drug_idx"),
        F.when(forward, F.col("target_idx")).otherwise(F.col("source_idx")).alias("gene_idx"),
    )


def canonical_pairs(edges: DataFrame) -> DataFrame:
    """Per (drug, gene): row count, sorted distinct associations and evidence, sorted edge ids; association is the label if there is one only."""
    return (
        orient_pairs(edges).groupBy("drug_idx", "gene_idx")
        .agg(
            F.count(F.lit(1)).alias("directed_edge_count"), F.array_sort(F.collect_set("association")).alias("associations"),
            F.array_sort(F.collect_set("evidence")).alias("evidence_categories"), F.array_sort(F.collect_list("edge_index")).alias("directed_edge_indices"),
        )
        .withColumn("association", F.when(F.size("associations") == 1, F.col("associations")[0]))
    )


def pair_table(edges: DataFrame) -> DataFrame:
    """(drug, gene, association) without lists, for what needs no more."""
    label = F.when(F.min("association") == F.max("association"), F.min("association"))
    return orient_pairs(edges).groupBy("drug_idx", "gene_idx").agg(label.alias("association"))


def pair_label_priority(edges: DataFrame) -> DataFrame:
    """Strongest label of a pair: associated, then ambiguous, then not_associated."""
    order = F.array_position(F.array(*[F.lit(a) for a in tx.ASSOCIATIONS]), F.col("association"))
    return orient_pairs(edges).filter("association IS NOT NULL").groupBy("drug_idx", "gene_idx").agg(F.min_by("association", order).alias("label"))


def known_positives(edges: DataFrame) -> DataFrame:
    return orient_pairs(edges).filter("association = 'associated'").select("drug_idx", "gene_idx").distinct()


def training_positives(assigned: DataFrame) -> DataFrame:
    """Distinct pairs of forward associated rows of the training graph."""
    kept = "source_type = 'drug' AND target_type = 'gene' AND association = 'associated' AND in_training_graph"
    return assigned.filter(kept).select(F.col("source_idx").alias("drug_idx"), F.col("target_idx").alias("gene_idx"), "seed", "protocol").distinct()


def drug_strata(pairs: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Per drug of pairs: positive and all pairs, whether it has enough positive ones, and its stratum."""
    counts = pairs.groupBy("drug_idx").agg(F.count_if(F.col("association") == "associated").alias("associated_pair_count"), F.count(F.lit(1)).alias("all_pair_count"))
    enough = F.col("associated_pair_count") >= config.least_pairs
    return counts.withColumn("eligible", enough).withColumn("degree_stratum", F.when(enough, tx.degree_stratum("associated_pair_count")))


def stratum_sizes(strata: DataFrame) -> DataFrame:
    """Drugs in each of the five strata, 0 for none."""
    rows = strata.sparkSession.createDataFrame([(s, i) for i, s in enumerate(tx.STRATA)], "degree_stratum string, position int")
    counts = strata.filter("eligible").groupBy("degree_stratum").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts, "degree_stratum", "left").select("degree_stratum", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_drugs"))


def largest_remainder(sizes: dict[str, int], target: int, share: float, capacity: dict[str, int] | None = None) -> dict[str, int]:
    """How many of target each stratum gets: its whole part of size times share, and the seats left over in order of (round, remainder from high to low, label).

    A stratum has one seat a round as long as it has room below its capacity (its size, if none is given).
    Errors: whole parts beyond the target, or fewer seats than are left over.
    """
    whole = {s: min(math.floor(n * share), (capacity or sizes)[s]) for s, n in sizes.items()}
    over = target - sum(whole.values())
    if over < 0:
        raise ValueError("whole parts exceed the target")
    remainder = {s: n * share % 1 for s, n in sizes.items()}
    seats = ((turn, -remainder[s], s) for s in sizes for turn in range(min(over, (capacity or sizes)[s] - whole[s])))
    taken = Counter(s for _, _, s in heapq.nsmallest(over, seats))
    if taken.total() < over:
        raise ValueError("the strata have no room for the target")
    return {s: n + taken[s] for s, n in whole.items()}


def allocations(strata: DataFrame, config: SplitConfig = SplitConfig()) -> list[tuple[str, int, int]]:
    """(stratum, validation, test) drugs; five rows on the driver."""
    sizes = {r["degree_stratum"]: r["n_drugs"] for r in stratum_sizes(strata).collect()}
    _, validation, test = config.sizes(sum(sizes.values()))
    first = largest_remainder(sizes, validation, config.validation)
    second = largest_remainder(sizes, test, config.test, {s: n - first[s] for s, n in sizes.items()})
    return [(s, first[s], second[s]) for s in sizes]


def assign_drugs(strata: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """(drug_idx, seed, degree_stratum, split): per seed and stratum drugs in md5 order; validation, test, then train.

    Drugs that aren't eligible are training_context_only. Positions are counted by leading hex digits
    of the md5, so no stratum is gathered in one task.
    """
    spark = strata.sparkSession
    seeds = spark.createDataFrame([(s,) for s in config.seeds], "seed int")
    cuts = spark.createDataFrame(allocations(strata, config), "degree_stratum string, n_validation int, n_test int")
    keyed = strata.filter("eligible").select("drug_idx", "degree_stratum").crossJoin(F.broadcast(seeds)).withColumn(
        "key", F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.lpad(F.col("drug_idx").cast("string"), 9, "0")))
    )
    placed = with_position(keyed, ["seed", "degree_stratum"], ["key", "drug_idx"], "place", bucket=F.substring("key", 1, 3)).join(F.broadcast(cuts), "degree_stratum")
    split = F.when(F.col("place") < F.col("n_validation"), "validation").when(F.col("place") < F.col("n_validation") + F.col("n_test"), "test").otherwise("train")
    rest = strata.filter("NOT eligible").select("drug_idx").crossJoin(F.broadcast(seeds))
    return placed.select("drug_idx", "seed", "degree_stratum", split.alias("split")).unionByName(
        rest.select("drug_idx", "seed", F.lit(None).cast("string").alias("degree_stratum"), F.lit("training_context_only").alias("split"))
    )


def plain_split(drugs: DataFrame, seed: int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """(drug_idx, split) of all drugs in md5 order without strata: train, validation, then test, half-even sizes."""
    n = drugs.select("drug_idx").distinct().agg(F.count(F.lit(1)).alias("n"))
    keyed = drugs.select("drug_idx").distinct().withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lpad(F.col("drug_idx").cast("string"), 9, "0"))))
    placed = with_position(keyed, [], ["key", "drug_idx"], "place", bucket=F.substring("key", 1, 3)).crossJoin(F.broadcast(n))  # one row
    first, second = F.bround(F.col("n") * train), F.bround(F.col("n") * validation)
    split = F.when(F.col("place") < first, "train").when(F.col("place") < first + second, "validation").otherwise("test")
    return placed.select("drug_idx", split.alias("split"))


def assign_pairs(pairs: DataFrame, drugs: DataFrame) -> DataFrame:
    """Pairs with the split of their drug, per seed."""
    return pairs.join(drugs.select("drug_idx", "seed", "split"), "drug_idx")


def assign_edges(edges: DataFrame, drugs: DataFrame, protocol: str) -> DataFrame:
    """Edges per seed with supervision_split, in_training_graph and removal_reason.

    dg_context removes drug-gene rows of held-out drugs; strict_cold removes every row at a held-out drug.
    Columns of edges with the names of new ones are replaced.
    """
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol}")
    edges = edges.drop("seed", "protocol", "is_drug_gene", "drug_idx", "supervision_split", "in_training_graph", "removal_reason", "at_heldout_drug", "end_drug", "end_split")
    seeds = drugs.select("seed").distinct()  # the configured few

    rows = edges.withColumn("is_drug_gene", F.coalesce(F.expr(DRUG_GENE), F.lit(False)))
    drug = F.when(F.col("is_drug_gene"), F.when(F.col("source_type") == "drug", F.col("source_idx")).otherwise(F.col("target_idx")))
    end = F.coalesce(drug, F.when(F.col("source_type") == "drug", F.col("source_idx")), F.when(F.col("target_type") == "drug", F.col("target_idx")))
    rows = rows.withColumn("drug_idx", drug).withColumn("end_drug", end).crossJoin(F.broadcast(seeds))
    rows = rows.join(drugs.select(F.col("drug_idx").alias("end_drug"), "seed", F.col("split").alias("end_split")), ["end_drug", "seed"], "left")
    held_out = F.coalesce(F.col("end_split").isin("validation", "test"), F.lit(False))
    reason = F.when(held_out & F.col("is_drug_gene"), "heldout_drug_gene")
    if protocol == "strict_cold":
        reason = reason.when(held_out, "heldout_drug_context")

    reason = reason.otherwise("retained")
    return rows.select(
        *edges.columns, "seed", F.lit(protocol).alias("protocol"), "is_drug_gene", "drug_idx", F.when(F.col("is_drug_gene"), F.col("end_split")).alias("supervision_split"),
        (reason == "retained").alias("in_training_graph"), reason.alias("removal_reason"), (held_out & ~F.col("is_drug_gene")).alias("at_heldout_drug"),
    )


def evaluation_pairs(assigned: DataFrame, split: str, association: str = "associated") -> DataFrame:
    return assigned.filter((F.col("split") == split) & (F.col("association") == association)).select("seed", "drug_idx", "gene_idx")


def variant_exposure(training: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (seed, drug, gene) with the sorted variants that link them in the training graph; [] for none.

    Read from the pairs: each pair meets its drug's variants and keeps those with a row to its gene,
    so two hubs never make a product.
    """
    def sides(kind: str, name: str) -> DataFrame:
        return training.filter(f"in_training_graph AND ((source_type = '{kind}' AND target_type = 'variant') OR (source_type = 'variant' AND target_type = '{kind}'))").select(
            "seed", F.when(F.col("source_type") == kind, F.col("source_idx")).otherwise(F.col("target_idx")).alias(name),
            F.when(F.col("source_type") == kind, F.col("target_idx")).otherwise(F.col("source_idx")).alias("variant_idx"),
        ).distinct()
    via = pairs.join(sides("drug", "drug_idx"), ["seed", "drug_idx"]).join(sides("gene", "gene_idx"), ["seed", "gene_idx", "variant_idx"], "left_semi")
    found = via.groupBy("seed", "drug_idx", "gene_idx").agg(F.array_sort(F.collect_set("variant_idx")).alias("v"))
    return pairs.join(found, ["seed", "drug_idx", "gene_idx"], "left").select(
        "seed", "drug_idx", "gene_idx", F.coalesce("v", F.array().cast("array<bigint>")).alias("mediating_variants")
    ).withColumn("mediating_variant_count", F.size("mediating_variants").cast("bigint")).withColumn("variant_mediated_exposure", F.col("mediating_variant_count") > 0)


def leakage_audit(assigned: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """Per seed: held-out drug-gene rows left in training, context rows left at held-out drugs, and exposed evaluation pairs."""
    kept = assigned.filter("in_training_graph").groupBy("seed").agg(
        F.count_if(F.expr("is_drug_gene AND supervision_split IN ('validation', 'test')")).alias("heldout_edges_in_training"), F.count_if(F.col("at_heldout_drug")).alias("context_edges_retained")
    )
    exposed = variant_exposure(assigned, validation.withColumn("split", F.lit("validation")).unionByName(test.withColumn("split", F.lit("test"))).drop("split"))
    marked = exposed.join(test.withColumn("is_test", F.lit(True)), ["seed", "drug_idx", "gene_idx"], "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))
    def counts(name: str, hit) -> list:
        n, k = F.count_if(hit), F.count_if(hit & F.col("variant_mediated_exposure"))
        return [n.alias(f"{name}_pairs"), k.alias(f"{name}_exposed"), F.round(F.coalesce(k / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias(f"{name}_fraction")]
    pairs = marked.groupBy("seed").agg(*counts("validation", ~F.col("is_test")), *counts("test", F.col("is_test")))
    return kept.join(pairs, "seed", "left")


def heldout_in_training(assignments: DataFrame, first: int = 20) -> DataFrame:
    """One row: drugs with rows in test that also have rows in train, their number and the first few."""
    drugs = assignments.filter("drug_idx IS NOT NULL")
    both = drugs.filter("split = 'test'").select("drug_idx").distinct().join(drugs.filter("split = 'train'").select("drug_idx").distinct(), "drug_idx", "left_semi")
    some = both.orderBy("drug_idx").limit(first).agg(F.array_sort(F.collect_list("drug_idx")).alias("first_drugs"))
    return both.agg(F.count(F.lit(1)).alias("n_leaked")).crossJoin(F.broadcast(some))


def seen_relations(rows: DataFrame) -> DataFrame:
    """Evaluation rows whose relation also stands in train."""
    vocabulary = rows.filter("split = 'train'").select("relation_type").distinct()
    return rows.filter("split IN ('validation', 'test')").join(vocabulary, "relation_type", "left_semi")


def supervision_regimes(pairs: DataFrame, regimes: Sequence[str] = ("default", "ambig_as_pos", "nonassoc_excluded")) -> DataFrame:
    """(regime, drug_idx, gene_idx, positive): default takes associated as positive and keeps all; ambig_as_pos also takes
    ambiguous; nonassoc_excluded leaves not_associated pairs out."""
    named = pairs.filter("association IS NOT NULL").select("drug_idx", "gene_idx", "association", F.explode(F.array(*[F.lit(r) for r in regimes])).alias("regime"))
    positive = (F.col("association") == "associated") | ((F.col("regime") == "ambig_as_pos") & (F.col("association") == "ambiguous"))
    return named.filter("NOT (regime = 'nonassoc_excluded' AND association = 'not_associated')").select("regime", "drug_idx", "gene_idx", positive.alias("positive"))


def variant_path_audit(edges: DataFrame) -> DataFrame:
    """Per association of direct pairs: pairs, those also linked through a variant, their percentage, and distinct variants used."""
    pairs = pair_table(edges).filter("association IS NOT NULL")
    whole = edges.withColumn("in_training_graph", F.lit(True)).withColumn("seed", F.lit(0))
    exposed = variant_exposure(whole, pairs.select(F.lit(0).alias("seed"), "drug_idx", "gene_idx")).join(pairs, ["drug_idx", "gene_idx"])
    per = exposed.groupBy("association").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("variant_mediated_exposure")).alias("n_linked"), F.round(100.0 * F.avg(F.col("variant_mediated_exposure").cast("int")), 6).alias("percent_linked")
    )
    used = exposed.select("association", F.explode("mediating_variants").alias("v")).groupBy("association").agg(F.count_distinct("v").alias("n_variants"))
    return per.join(used, "association", "left").withColumn("n_variants", F.coalesce("n_variants", F.lit(0)))
