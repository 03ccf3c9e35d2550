"""Drug and gene entities, split labels and counted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import split_label, structure
from graphloom.llm.spanning_forest import SpanningForest, spanning_forest
from graphloom.operators.positions import accession

SPLITS = ("train", "validation", "test")


def counted_rows(assignments: DataFrame) -> DataFrame:
    """Rows with drug_idx, gene_idx and a label that names a split, which ``split`` then has plainly."""
    return assignments.withColumn("split", split_label(F.col("split"))).filter(
        "drug_idx IS NOT NULL AND gene_idx IS NOT NULL AND split IS NOT NULL"
    )


def _typed(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.lower(F.trim("node_type")) == kind).select("node_index", accession(F.col("node_id")).cast("decimal(38,0)").cast("string").alias("acc"))


def drug_links(nodes: DataFrame, chemicals: DataFrame) -> DataFrame:
    """(u, v): links between accession numbers of drug nodes that have a structure in common.

    All accessions of a structure are linked to the least of them: as many links as rows, not pairs.
    """
    known = _typed(nodes, "drug").filter("acc IS NOT NULL").select("acc").distinct()
    held = (
        chemicals.select(accession(F.col("pharmgkb_accession_id")).cast("decimal(38,0)").cast("string").alias("acc"), structure(F.col("smiles")).alias("s"))
        .filter("acc IS NOT NULL AND s IS NOT NULL")
        .select("acc", F.xxhash64("s").alias("h1"), F.md5("s").alias("s"))
        .distinct()
        .join(known, "acc", "left_semi")
    )
    hub = held.groupBy("h1", "s").agg(F.min("acc").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return held.join(hub, ["h1", "s"]).select(F.col("acc").alias("u"), F.col("hub").alias("v"))


def drug_forest(nodes: DataFrame, chemicals: DataFrame) -> SpanningForest:
    return spanning_forest(drug_links(nodes, chemicals))


def drug_entities(nodes: DataFrame, forest: SpanningForest) -> DataFrame:
    """(drug_idx, drug_entity) of all drug nodes.

    The entity is the least accession number of the component, or ``node:`` with the index for a
    node whose id has no accession number.
    """
    roots = forest.roots.select(F.col("v").alias("acc"), "root")
    return _typed(nodes, "drug").join(roots, "acc", "left").select(
        F.col("node_index").alias("drug_idx"),
        F.coalesce("root", "acc", F.concat(F.lit("node:"), F.col("node_index").cast("string"))).alias("drug_entity"),
    )


def gene_entities(nodes: DataFrame) -> DataFrame:
    """(gene_idx, gene_entity) of all gene nodes: gene nodes of one accession number are one gene."""
    return _typed(nodes, "gene").select(
        F.col("node_index").alias("gene_idx"),
        F.coalesce("acc", F.concat(F.lit("node:"), F.col("node_index").cast("string"))).alias("gene_entity"),
    )


def own_entity(entity: str, index: str) -> Column:
    """The entity, or for an index that nodes doesn't have an entity of its own."""
    return F.coalesce(F.col(entity), F.concat(F.lit("node:"), F.col(index).cast("string")))
