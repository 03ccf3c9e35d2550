"""Data-quality rules. Each returns its violations as rows; ``enforce`` raises if there are any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx


def enforce(violations: DataFrame, rule: str) -> None:
    """Raises with a few of the violations; reads no more than those."""
    some = violations.take(5)
    if some:
        raise ValueError(f"{rule}: {some}")


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "the table") -> DataFrame:
    """df, if it has all the columns; else an error that names the missing ones."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {label} lacks {missing}")
    return df


def blank_endpoints(relationships: DataFrame) -> DataFrame:
    """Records with a blank id, name or type at either end."""
    blank = F.lit(False)
    for c in ("entity1_id", "entity1_name", "entity1_type", "entity2_id", "entity2_name", "entity2_type"):
        blank = blank | tx.clean_text(c).isNull()
    return relationships.filter(blank).select("rel_id")


def unknown_labels(relationships: DataFrame) -> DataFrame:
    """Association labels outside the vocabulary, blanks included, with their records."""
    return relationships.filter(tx.normalise_association("association").isNull()).groupBy("association").agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """Nodes whose (type, accession-cleaned id) stands more than once; all of them."""
    keyed = nodes.select("node_index", "node_type", F.upper(F.regexp_replace("node_id", r"(?U)[^\p{L}\p{N}]", "")).alias("key"))
    often = keyed.groupBy("node_type", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(often, ["node_type", "key"])


def pair_invariants(pairs: DataFrame) -> DataFrame:
    """Pairs that don't have exactly two directed rows and one label."""
    return pairs.select("drug_idx", "gene_idx", "directed_edge_count", F.size("associations").cast("bigint").alias("n_labels")).filter("directed_edge_count <> 2 OR n_labels <> 1")


def graph_invariants(manifest: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(metric, expected, actual) of a one-row manifest where they differ."""
    items = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(v).cast("bigint").alias("expected"), F.col(k).alias("actual")) for k, v in expected.items()])
    return manifest.select(F.inline(items)).filter("NOT expected <=> actual")


def index_range(edges: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """Edges with an end outside 0 .. n-1, or none; n_nodes has one row and column n."""
    bad = "source_idx IS NULL OR target_idx IS NULL OR source_idx < 0 OR target_idx < 0 OR source_idx >= n OR target_idx >= n"
    return edges.crossJoin(F.broadcast(n_nodes)).filter(bad).select("edge_index", "source_idx", "target_idx")


def contiguous(nodes: DataFrame) -> DataFrame:
    """One row: least and greatest index, distinct ones, rows, and whether they are 0 .. n-1."""
    return nodes.agg(
        F.min("node_index").alias("least"), F.max("node_index").alias("greatest"), F.count_distinct("node_index").alias("n_distinct"), F.count(F.lit(1)).alias("n_rows")
    ).withColumn("is_contiguous", F.expr("least = 0 AND greatest = n_rows - 1 AND n_distinct = n_rows"))


def reverse_consistency(oriented: DataFrame) -> DataFrame:
    """Drug-gene pairs and relations' evidence without the same label in both directions."""
    return (
        oriented.groupBy("drug_idx", "gene_idx", "evidence")
        .agg(F.count_distinct("source_type").alias("n_directions"), F.count_distinct("association").alias("n_labels"))
        .filter("n_directions <> 2 OR n_labels <> 1")
    )


def one_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """One row: keys of left, those repeated in left, repeated in right, and without a match. Null keys don't count."""
    a = left.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("a"))
    b = right.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, on, "left").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("a") > 1).alias("repeated_left"), F.count_if(F.col("b") > 1).alias("repeated_right"), F.count_if(F.col("b").isNull()).alias("unmatched")
    )


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, repeats counted; side tells which has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def fingerprint_bits(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_bits): active bits of a vector taken as a fingerprint, a bit being a positive value."""
    bits = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda s, x: s + (x > 0).cast("bigint"))
    return vectors.select("vec_id", bits.alias("n_bits"))


def fingerprint_summary(vectors: DataFrame) -> DataFrame:
    """One row: vectors, missing ones, distinct bit patterns, and least, mean and most active bits."""
    pattern = F.array_join(F.transform("embedding", lambda x: (x > 0).cast("int").cast("string")), "")
    return vectors.select("vec_id", pattern.alias("p"), F.col("embedding").isNull().alias("missing")).join(fingerprint_bits(vectors), "vec_id").agg(
        F.count(F.lit(1)).alias("n_vectors"), F.count_if(F.col("missing")).alias("n_missing"), F.count_distinct("p").alias("n_distinct"),
        F.min("n_bits").alias("least_bits"), F.round(F.avg("n_bits"), 6).alias("mean_bits"), F.max("n_bits").alias("most_bits"),
    )


def fingerprint_join(nodes: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Drug nodes with has_fp: a structure is known under their lower-case trimmed name."""
    known = fingerprints.select(F.lower(F.trim("name")).alias("key")).filter("key IS NOT NULL").distinct().withColumn("has_fp", F.lit(True))
    return (
        nodes.filter("node_type = 'drug'").select("node_index", F.lower(F.trim("node_name")).alias("key")).join(known, "key", "left")
        .select("node_index", F.coalesce("has_fp", F.lit(False)).alias("has_fp"))
    )
