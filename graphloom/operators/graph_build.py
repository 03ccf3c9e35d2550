"""Building an indexed, multi-relational graph from raw records, and its profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators.positions import global_position

DRUG_GENE = "(source_type = 'drug' AND target_type = 'gene') OR (source_type = 'gene' AND target_type = 'drug')"
RAW = ("entity1_id", "entity1_name", "entity1_type", "entity2_id", "entity2_name", "entity2_type", "evidence", "association", "pk", "pd", "pmids")


def scope_filter(relationships: DataFrame) -> DataFrame:
    """Records without a haplotype at either end. A null type is no haplotype."""
    return relationships.filter(~tx.is_haplotype("entity1_type") & ~tx.is_haplotype("entity2_type"))


def prepare_relationships(relationships: DataFrame) -> DataFrame:
    """Typed records in scope: source_*, target_*, evidence, association, raw labels, relation_type.

    Fields are cleaned; ids lose white space only. Unknown types and labels become null, for the
    quality rules to report; no record in scope is dropped. Extra columns are ignored.
    """
    kept = scope_filter(relationships)
    return kept.select(
        "rel_id",
        tx.clean_text("entity1_id").alias("source_id"), tx.clean_text("entity1_name").alias("source_name"), tx.canonical_type("entity1_type").alias("source_type"),
        tx.clean_text("entity2_id").alias("target_id"), tx.clean_text("entity2_name").alias("target_name"), tx.canonical_type("entity2_type").alias("target_type"),
        tx.normalise_evidence("evidence").alias("evidence"), tx.normalise_association("association").alias("association"),
        F.col("evidence").alias("evidence_raw"), F.col("association").alias("association_raw"), "pk", "pd", "pmids",
    ).withColumn("relation_type", tx.relation_type("source_type", "target_type", "evidence", "association"))


def endpoints(typed: DataFrame) -> DataFrame:
    """(node_type, node_id, node_name) of both ends of typed records."""
    return typed.select(
        F.inline(F.array(*[F.struct(F.col(f"{s}_type").alias("node_type"), F.col(f"{s}_id").alias("node_id"), F.col(f"{s}_name").alias("node_name")) for s in ("source", "target")]))
    )


def endpoint_aliases(typed: DataFrame) -> DataFrame:
    """Per (type, id): sorted distinct names and their number. Null names don't count."""
    names = F.array_sort(F.collect_set("node_name"))
    return (
        endpoints(typed).filter("node_type IS NOT NULL AND node_id IS NOT NULL").groupBy("node_type", "node_id")
        .agg(names.alias("endpoint_names")).withColumn("endpoint_name_count", F.size("endpoint_names").cast("bigint"))
    )


def supplemental_nodes(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints that the node table lacks, named by their first name."""
    known = nodes.select("node_type", tx.clean_text("node_id").alias("node_id"))
    return aliases.join(known, ["node_type", "node_id"], "left_anti").select(
        "node_id", F.try_element_at("endpoint_names", F.lit(1)).alias("node_name"), "node_type", F.lit("relationships").alias("node_source"), F.lit(True).alias("is_supplemental")
    )


def index_nodes(nodes: DataFrame) -> DataFrame:
    """Contiguous index from 0 by (type order, id), without a single-task window."""
    ordered = nodes.select("node_id", "node_type").withColumn("__type", tx.type_order("node_type"))
    return global_position(ordered, ["__type", "node_id"], "new_index").select("node_id", "node_type", "new_index")


def local_index(nodes: DataFrame) -> DataFrame:
    """Index within the node type, by node_index: the global position less the first of the type."""
    placed = global_position(nodes.select("node_type", "node_index"), ["node_type", "node_index"], "__p")
    first = placed.groupBy("node_type").agg(F.min("__p").alias("__first"))
    return placed.join(F.broadcast(first), "node_type").select("node_index", "node_type", (F.col("__p") - F.col("__first")).alias("local_index"))


def edge_ordinal(edges: DataFrame) -> DataFrame:
    """A 0-based ordinal by edge_index."""
    return global_position(edges.select("edge_index", "source_idx", "target_idx"), ["edge_index"], "ordinal")


def index_edges(typed: DataFrame, nodes: DataFrame, how: str = "left") -> DataFrame:
    """Typed records with source_idx and target_idx looked up by (type, id); how="inner" drops unmapped ones.

    Where an id stands for several nodes, the least index is meant.
    """
    by_key = nodes.groupBy(F.col("node_type").alias("t"), tx.clean_text("node_id").alias("i")).agg(F.min("node_index").alias("x"))
    out = typed
    for side in ("source", "target"):
        side_key = by_key.select(F.col("t").alias(f"{side}_type"), F.col("i").alias(f"{side}_id"), F.col("x").alias(f"{side}_idx"))
        out = out.join(side_key, [f"{side}_type", f"{side}_id"], how)
    return out


def unmapped_audit(indexed: DataFrame) -> DataFrame:
    """Per type pair: records, and those with an unmapped source, target or either."""
    s, t = F.col("source_idx").isNull(), F.col("target_idx").isNull()
    return indexed.groupBy("source_type", "target_type").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(s).alias("unmapped_source"), F.count_if(t).alias("unmapped_target"), F.count_if(s | t).alias("unmapped_any")
    )


def relation_index(edges: DataFrame) -> DataFrame:
    """Distinct relation types with ids by sorted order; the vocabulary is closed and small."""
    distinct = edges.filter("relation_type IS NOT NULL").select("relation_type").distinct()
    return distinct.select("relation_type", (F.row_number().over(Window.orderBy("relation_type")) - 1).cast("bigint").alias("relation_idx"))


def graph_manifest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; for empty tables zeros."""
    n = nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.expr("is_supplemental")).alias("n_supplemental"),
        *[F.count_if(F.col("node_type") == t).alias(f"n_{t}") for t in tx.NODE_TYPES],
    )
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("relation_type").alias("n_relations"), F.count_if(F.expr(DRUG_GENE)).alias("n_drug_gene_edges"))
    return n.crossJoin(F.broadcast(e))  # one row each


def metagraph_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_type", "target_type").agg(F.count(F.lit(1)).alias("n_edges"))


def node_composition(nodes: DataFrame) -> DataFrame:
    """Nodes per type and their percentage of all."""
    counts = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n_nodes"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n_nodes") / F.sum("n_nodes").over(Window.partitionBy()), 6))


def node_expansion(nodes: DataFrame, indexed: DataFrame) -> DataFrame:
    """Nodes per type if every unmapped endpoint became a node."""
    def lost(side: str) -> DataFrame:
        return indexed.filter(F.col(f"{side}_idx").isNull()).select(F.col(f"{side}_type").alias("node_type"), F.col(f"{side}_id").alias("node_id"))
    every = nodes.select("node_type", tx.clean_text("node_id").alias("node_id")).union(lost("source")).union(lost("target"))
    return every.filter("node_type IS NOT NULL AND node_id IS NOT NULL").distinct().groupBy("node_type").agg(F.count(F.lit(1)).alias("n_nodes"))


def alias_collapse(aliases: DataFrame) -> DataFrame:
    """Per type: ids, ids of more than one name, most names of an id."""
    n = F.col("endpoint_name_count")
    return aliases.groupBy("node_type").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(n > 1).alias("n_aliased"), F.max(n).alias("max_names"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Edge keys that stand more than once, with their rows."""
    key = ["source_idx", "target_idx", "source_type", "target_type", "evidence", "association"]
    return edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def contradictory_labels(edges: DataFrame) -> DataFrame:
    """Node pairs and evidence with more than one association."""
    key = ["source_idx", "target_idx", "source_type", "target_type", "evidence"]
    return edges.groupBy(*key).agg(F.array_sort(F.collect_set("association")).alias("labels")).filter("size(labels) > 1")


def mapping_loss(relationships: DataFrame) -> DataFrame:
    """Per pair of raw types: records, records in scope, and those with both types known."""
    known = tx.canonical_type("entity1_type").isNotNull() & tx.canonical_type("entity2_type").isNotNull()
    hap = tx.is_haplotype("entity1_type") | tx.is_haplotype("entity2_type")
    return relationships.groupBy("entity1_type", "entity2_type").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(~hap).alias("n_in_scope"), F.count_if(known).alias("n_typed")
    )


def retention(relationships: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: raw, in scope and mapped records with percentages of the raw ones (null for none)."""
    hap = tx.is_haplotype("entity1_type") | tx.is_haplotype("entity2_type")
    a = relationships.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(~hap).alias("n_in_scope"))
    b = indexed.agg(F.count_if(F.expr("source_idx IS NOT NULL AND target_idx IS NOT NULL")).alias("n_mapped"))
    def percent(c: str) -> Column:
        return F.round(100.0 * F.col(c) / F.nullif(F.col("n_raw"), F.lit(0)), 6)
    return a.crossJoin(F.broadcast(b)).select("*", percent("n_in_scope").alias("in_scope_percent"), percent("n_mapped").alias("mapped_percent"))


def node_profile(nodes: DataFrame) -> DataFrame:
    """Per type: nodes, names missing after cleaning, names used more than once, distinct names."""
    cleaned = nodes.select("node_type", tx.clean_text("node_name").alias("name"))
    per_name = cleaned.groupBy("node_type", "name").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("name").isNotNull()
    return per_name.groupBy("node_type").agg(
        F.sum("n").alias("n_nodes"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count_if(named & (F.col("n") > 1)).alias("n_repeated_names"), F.count_if(named).alias("n_distinct_names"),
    )


def blank_id_profile(relationships: DataFrame) -> DataFrame:
    """Per raw type: endpoints with a blank id or name."""
    ends = relationships.select(
        F.inline(F.array(*[F.struct(F.col(f"entity{i}_type").alias("raw_type"), F.col(f"entity{i}_id").alias("id"), F.col(f"entity{i}_name").alias("name")) for i in (1, 2)]))
    )
    return ends.groupBy("raw_type").agg(
        F.count(F.lit(1)).alias("n_endpoints"), F.count_if(tx.clean_text("id").isNull()).alias("blank_ids"), F.count_if(tx.clean_text("name").isNull()).alias("blank_names")
    )


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Distinct unordered node pairs (a <= b) with the relation of the last row (highest edge_index)."""
    return (
        edges.filter("source_idx IS NOT NULL AND target_idx IS NOT NULL")
        .groupBy(F.least("source_idx", "target_idx").alias("a"), F.greatest("source_idx", "target_idx").alias("b"))
        .agg(F.max_by("relation_type", "edge_index").alias("relation_type"))
    )


def simple_degree(undirected: DataFrame) -> DataFrame:
    """Degree in the simple graph; a loop counts twice."""
    ends = undirected.select(F.explode(F.array("a", "b")).alias("node_idx"))
    return ends.groupBy("node_idx").agg(F.count(F.lit(1)).alias("degree"))


def pair_relation(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Relation per ordered pair, each row standing for both orders; the last row wins. Only of the pairs (u, v) of among, if given."""
    both = edges.filter("source_idx IS NOT NULL AND target_idx IS NOT NULL").select(
        F.inline(F.array(F.struct(F.col("source_idx").alias("u"), F.col("target_idx").alias("v")), F.struct(F.col("target_idx").alias("u"), F.col("source_idx").alias("v")))), "relation_type", "edge_index"
    )
    both = both if among is None else both.join(among, ["u", "v"], "left_semi")
    return both.groupBy("u", "v").agg(F.max_by("relation_type", "edge_index").alias("relation_type"))


def display_edges(edges: DataFrame) -> DataFrame:
    """First row per ordered pair by evidence, then edge_index."""
    first = F.min(F.struct("evidence", "edge_index", "association")).alias("m")
    return edges.groupBy("source_idx", "target_idx").agg(first).select("source_idx", "target_idx", "m.evidence", "m.edge_index", "m.association")


def association_flags(edges: DataFrame) -> DataFrame:
    """Forward drug-gene rows with their normalised label and three flags."""
    label = tx.normalise_association("association_raw")
    return edges.filter("source_type = 'drug' AND target_type = 'gene'").select(
        "edge_index", label.alias("label"),
        *[F.coalesce(label == a, F.lit(False)).alias(f"is_{a}") for a in tx.ASSOCIATIONS],
    )
