"""Queries over the raw and indexed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import graph_build as gb
from graphloom.plans.common import ASSIGNED, STRUCTURE, assignments
from graphloom.session import read_table as t
from graphloom.sources import results


def _typed(s: SparkSession, d: str) -> DataFrame:
    return gb.prepare_relationships(t(s, d, "relationships"))


def _indexed(s: SparkSession, d: str, how: str = "left") -> DataFrame:
    return gb.index_edges(_typed(s, d), t(s, d, "nodes"), how)


def bundle(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the training graph: train rows as edges, associated pairs of each split, drugs with a structure."""
    rows = assignments(s, d)
    edges = rows.filter("split = 'train' AND source_idx IS NOT NULL AND target_idx IS NOT NULL").select("source_idx", "target_idx", F.col("rel_idx").alias("rel")).distinct()
    pairs = rows.filter("association = 'associated' AND drug_idx IS NOT NULL AND gene_idx IS NOT NULL AND split IS NOT NULL").select("drug_idx", "gene_idx", "split").distinct()
    return results.bundle_sizes(t(s, d, "nodes"), edges, pairs, t(s, d, "chemicals").select(tx.structure("smiles").alias("fp")))


def audited_types(s: SparkSession, d: str) -> DataFrame:
    """Raw types of both ends with the audit's type and subtype, and the rows of each."""
    ends = t(s, d, "relationships").select(F.explode(F.array("entity1_type", "entity2_type")).alias("raw"))
    return ends.groupBy("raw", tx.audit_type("raw").alias("type"), tx.audit_subtype("raw").alias("subtype")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "bundle_sizes": bundle,
    "audit_types": audited_types,
    "node_keys": lambda s, d: t(s, d, "nodes").select("node_index", tx.node_key("node_type", "node_id").alias("key"), tx.title_case(F.concat_ws("_", "node_type", "node_source")).alias("label")),
    "scan_clean_nulls": lambda s, d: t(s, d, "nodes").select("node_index", tx.null_tokens("node_name").alias("as_read"), tx.clean_text("node_name").alias("node_name")),
    "canonical_type": lambda s, d: t(s, d, "relationships").groupBy("entity1_type").agg(F.count(F.lit(1)).alias("n")).select(
        "entity1_type", tx.canonical_type("entity1_type").alias("node_type"), tx.canonical_type("entity1_type", "keep").alias("older_type"), "n"),
    "evidence_category": lambda s, d: t(s, d, "edges").groupBy("evidence_raw").agg(F.count(F.lit(1)).alias("n")).select("evidence_raw", tx.normalise_evidence("evidence_raw").alias("category"), "n"),
    "relation_type": lambda s, d: _typed(s, d).select("rel_id", "relation_type"),
    "scope_filter": lambda s, d: gb.scope_filter(t(s, d, "relationships")).select("rel_id", "entity1_type", "entity2_type"),
    "prepare_relationships": lambda s, d: _typed(s, d).drop("pk", "pd", "pmids", "evidence_raw", "association_raw"),
    "retention": lambda s, d: gb.retention(t(s, d, "relationships"), _indexed(s, d)),
    "association_flags": lambda s, d: gb.association_flags(t(s, d, "edges")),
    "node_profile": lambda s, d: gb.node_profile(t(s, d, "nodes")),
    "blank_id_profile": lambda s, d: gb.blank_id_profile(t(s, d, "relationships")),
    "node_index": lambda s, d: gb.index_nodes(t(s, d, "nodes")),
    "edge_ordinal": lambda s, d: gb.edge_ordinal(t(s, d, "edges")),
    "local_index": lambda s, d: gb.local_index(t(s, d, "nodes")),
    "endpoint_aliases": lambda s, d: gb.endpoint_aliases(_typed(s, d)),
    "supplemental_nodes": lambda s, d: gb.supplemental_nodes(gb.endpoint_aliases(_typed(s, d)), t(s, d, "nodes").filter("NOT is_supplemental")),
    "edge_index_join": lambda s, d: _indexed(s, d).select("rel_id", "source_idx", "target_idx", "relation_type"),
    "edge_index_join_inner": lambda s, d: _indexed(s, d, "inner").select("rel_id", "source_idx", "target_idx", "relation_type"),
    "unmapped_audit": lambda s, d: gb.unmapped_audit(_indexed(s, d)),
    "relation_index": lambda s, d: gb.relation_index(t(s, d, "edges")),
    "graph_manifest": lambda s, d: gb.graph_manifest(t(s, d, "nodes"), t(s, d, "edges")),
    "metagraph_counts": lambda s, d: gb.metagraph_counts(t(s, d, "edges")),
    "node_composition": lambda s, d: gb.node_composition(t(s, d, "nodes")),
    "node_expansion": lambda s, d: gb.node_expansion(t(s, d, "nodes"), _indexed(s, d)),
    "alias_collapse": lambda s, d: gb.alias_collapse(gb.endpoint_aliases(_typed(s, d))),
    "duplicate_edges": lambda s, d: gb.duplicate_edges(t(s, d, "edges")),
    "contradictory_labels": lambda s, d: gb.contradictory_labels(t(s, d, "edges")),
    "mapping_loss": lambda s, d: gb.mapping_loss(t(s, d, "relationships")),
    "undirected_edges": lambda s, d: gb.undirected_edges(t(s, d, "edges")),
    "simple_degree": lambda s, d: gb.simple_degree(gb.undirected_edges(t(s, d, "edges"))),
    "pair_relation": lambda s, d: gb.pair_relation(t(s, d, "edges")),
    "display_edges": lambda s, d: gb.display_edges(t(s, d, "edges")),
}

WS = r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+"


def clean(c: str) -> str:
    x = f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"
    return f"(CASE WHEN lower({x}) NOT IN ('', 'nan', 'none', 'null') THEN {x} END)"


def ctype(c: str) -> str:
    return (
        f"(CASE WHEN lower({clean(c)}) IN ('chemical', 'chemicals', 'drug', 'compound') THEN 'drug' WHEN lower({clean(c)}) IN ('gene', 'genes') THEN 'gene' "
        f"WHEN lower({clean(c)}) IN ('phenotype', 'phenotypes', 'disease', 'diseases', 'clinical phenotype') THEN 'phenotype' WHEN lower({clean(c)}) IN ('variant', 'variants') THEN 'variant' END)"
    )


def evid(c: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({c}, '(?i)guideline|cpic') THEN 'guideline' WHEN regexp_matches({c}, '(?i)label|fda') THEN 'label' WHEN regexp_matches({c}, '(?i)pathway|reactome') THEN 'pathway' "
        f"WHEN regexp_matches({c}, '(?i)clinical|annotation') THEN 'clinical' WHEN regexp_matches({c}, '(?i)literature|pmid') THEN 'literature' ELSE 'other' END)"
    )


def assoc(c: str) -> str:
    x = f"regexp_replace(lower({clean(c)}), '[\\s-]+', '_', 'g')"
    return f"(CASE WHEN {x} IN ('associated', 'ambiguous', 'not_associated') THEN {x} END)"


_HAP = "coalesce(lower(trim(entity1_type)) IN ('haplotype', 'haplotypes'), false) OR coalesce(lower(trim(entity2_type)) IN ('haplotype', 'haplotypes'), false)"
TYPED = f"""typed AS (
    SELECT rel_id, {clean('entity1_id')} AS source_id, {clean('entity1_name')} AS source_name, {ctype('entity1_type')} AS source_type,
        {clean('entity2_id')} AS target_id, {clean('entity2_name')} AS target_name, {ctype('entity2_type')} AS target_type,
        {evid('evidence')} AS evidence, {assoc('association')} AS association,
        {ctype('entity1_type')} || '_' || {ctype('entity2_type')} || '_' || {evid('evidence')} || '_' || {assoc('association')} AS relation_type
    FROM relationships WHERE NOT ({_HAP}))"""
ALIASES = f"""{TYPED}, ends AS (
    SELECT source_type AS node_type, source_id AS node_id, source_name AS node_name FROM typed UNION ALL SELECT target_type, target_id, target_name FROM typed),
    aliases AS (
    SELECT node_type, node_id, coalesce(list_sort(list(DISTINCT node_name) FILTER (node_name IS NOT NULL)), []) AS endpoint_names,
        count(DISTINCT node_name) AS endpoint_name_count FROM ends WHERE node_type IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL)"""
INDEXED = f"""{TYPED}, nk AS (SELECT node_type AS t, {clean('node_id')} AS i, min(node_index) AS x FROM nodes GROUP BY ALL),
    indexed AS (SELECT typed.*, a.x AS source_idx, b.x AS target_idx FROM typed
        LEFT JOIN nk a ON a.t = source_type AND a.i = source_id LEFT JOIN nk b ON b.t = target_type AND b.i = target_id)"""
_UND = """und AS (SELECT least(source_idx, target_idx) AS a, greatest(source_idx, target_idx) AS b, arg_max(relation_type, edge_index) AS relation_type
    FROM edges WHERE source_idx IS NOT NULL AND target_idx IS NOT NULL GROUP BY ALL)"""
_DG = "((source_type = 'drug' AND target_type = 'gene') OR (source_type = 'gene' AND target_type = 'drug'))"
_ORD = "CASE node_type WHEN 'drug' THEN 0 WHEN 'gene' THEN 1 WHEN 'phenotype' THEN 2 WHEN 'variant' THEN 3 END"

ORACLE = {
    "bundle_sizes": f"""WITH r AS (SELECT * FROM {ASSIGNED}), e AS (SELECT DISTINCT source_idx, target_idx, rel_idx FROM r WHERE split = 'train' AND source_idx IS NOT NULL AND target_idx IS NOT NULL),
        p AS (SELECT DISTINCT drug_idx, gene_idx, split FROM r WHERE association = 'associated' AND drug_idx IS NOT NULL AND gene_idx IS NOT NULL)
        SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT rel_idx) FROM e) AS n_relations, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM p WHERE split = 'train') AS n_train_pairs,
            (SELECT count(*) FROM p WHERE split = 'validation') AS n_validation_pairs, (SELECT count(*) FROM p WHERE split = 'test') AS n_test_pairs, (SELECT count({STRUCTURE}) FROM chemicals) AS n_fingerprints""",
    "audit_types": """WITH e AS (SELECT unnest([entity1_type, entity2_type]) AS raw FROM relationships), m AS (SELECT raw, trim(raw, ' ') AS w FROM e)
        SELECT raw, CASE w WHEN 'Chemical' THEN 'drug' WHEN 'Disease' THEN 'phenotype' ELSE lower(w) END AS type, CASE w WHEN 'Variant' THEN 'sequence_variant' ELSE lower(w) END AS subtype, count(*) AS n FROM m GROUP BY ALL""",
    "node_keys": """SELECT node_index, concat_ws(':', node_type, node_id) AS key, list_aggregate(list_transform(string_split(regexp_replace(concat_ws('_', node_type, node_source), '_+', ' ', 'g'), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS label FROM nodes""",
    "scan_clean_nulls": f"""SELECT node_index, CASE WHEN node_name NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')
        THEN node_name END AS as_read, {clean('node_name')} AS node_name FROM nodes""",
    "canonical_type": f"""SELECT entity1_type, {ctype('entity1_type')} AS node_type, coalesce({ctype('entity1_type')},
        CASE WHEN lower({clean('entity1_type')}) IN ('haplotype', 'haplotypes') THEN 'variant' ELSE lower({clean('entity1_type')}) END) AS older_type, count(*) AS n FROM relationships GROUP BY ALL""",
    "evidence_category": f"SELECT evidence_raw, {evid('evidence_raw')} AS category, count(*) AS n FROM edges GROUP BY ALL",
    "relation_type": f"WITH {TYPED} SELECT rel_id, relation_type FROM typed",
    "scope_filter": f"SELECT rel_id, entity1_type, entity2_type FROM relationships WHERE NOT ({_HAP})",
    "prepare_relationships": f"WITH {TYPED} SELECT * FROM typed",
    "retention": f"""WITH {INDEXED}, a AS (SELECT count(*) AS n_raw, count(*) FILTER (NOT ({_HAP})) AS n_in_scope FROM relationships),
        b AS (SELECT count(*) FILTER (source_idx IS NOT NULL AND target_idx IS NOT NULL) AS n_mapped FROM indexed)
        SELECT *, round(100.0 * n_in_scope / n_raw, 6) AS in_scope_percent, round(100.0 * n_mapped / n_raw, 6) AS mapped_percent FROM a, b""",
    "association_flags": f"""SELECT edge_index, {assoc('association_raw')} AS label, coalesce({assoc('association_raw')} = 'associated', false) AS is_associated,
        coalesce({assoc('association_raw')} = 'ambiguous', false) AS is_ambiguous, coalesce({assoc('association_raw')} = 'not_associated', false) AS is_not_associated
        FROM edges WHERE source_type = 'drug' AND target_type = 'gene'""",
    "node_profile": f"""WITH a AS (SELECT node_type, {clean('node_name')} AS name FROM nodes), b AS (SELECT node_type, name, count(*) AS n FROM a GROUP BY ALL)
        SELECT node_type, sum(n)::BIGINT AS n_nodes, coalesce(sum(n) FILTER (name IS NULL), 0)::BIGINT AS n_missing, count(*) FILTER (name IS NOT NULL AND n > 1) AS n_repeated_names,
        count(*) FILTER (name IS NOT NULL) AS n_distinct_names FROM b GROUP BY ALL""",
    "blank_id_profile": f"""WITH e AS (SELECT entity1_type AS raw_type, entity1_id AS id, entity1_name AS name FROM relationships UNION ALL SELECT entity2_type, entity2_id, entity2_name FROM relationships)
        SELECT raw_type, count(*) AS n_endpoints, count(*) FILTER ({clean('id')} IS NULL) AS blank_ids, count(*) FILTER ({clean('name')} IS NULL) AS blank_names FROM e GROUP BY ALL""",
    "node_index": f"SELECT node_id, node_type, row_number() OVER (ORDER BY {_ORD}, node_id) - 1 AS new_index FROM nodes",
    "edge_ordinal": "SELECT edge_index, source_idx, target_idx, row_number() OVER (ORDER BY edge_index) - 1 AS ordinal FROM edges",
    "local_index": "SELECT node_index, node_type, row_number() OVER (PARTITION BY node_type ORDER BY node_index) - 1 AS local_index FROM nodes",
    "endpoint_aliases": f"WITH {ALIASES} SELECT * FROM aliases",
    "supplemental_nodes": f"""WITH {ALIASES} SELECT node_id, endpoint_names[1] AS node_name, node_type, 'relationships' AS node_source, true AS is_supplemental FROM aliases a
        WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE NOT n.is_supplemental AND n.node_type = a.node_type AND {clean('n.node_id')} = a.node_id)""",
    "edge_index_join": f"WITH {INDEXED} SELECT rel_id, source_idx, target_idx, relation_type FROM indexed",
    "edge_index_join_inner": f"WITH {INDEXED} SELECT rel_id, source_idx, target_idx, relation_type FROM indexed WHERE source_idx IS NOT NULL AND target_idx IS NOT NULL",
    "unmapped_audit": f"""WITH {INDEXED} SELECT source_type, target_type, count(*) AS n_records, count(*) FILTER (source_idx IS NULL) AS unmapped_source, count(*) FILTER (target_idx IS NULL) AS unmapped_target,
        count(*) FILTER (source_idx IS NULL OR target_idx IS NULL) AS unmapped_any FROM indexed GROUP BY ALL""",
    "relation_index": "SELECT relation_type, row_number() OVER (ORDER BY relation_type) - 1 AS relation_idx FROM (SELECT DISTINCT relation_type FROM edges WHERE relation_type IS NOT NULL)",
    "graph_manifest": f"""SELECT * FROM (SELECT count(*) AS n_nodes, count(*) FILTER (is_supplemental) AS n_supplemental, count(*) FILTER (node_type = 'drug') AS n_drug, count(*) FILTER (node_type = 'gene') AS n_gene,
        count(*) FILTER (node_type = 'phenotype') AS n_phenotype, count(*) FILTER (node_type = 'variant') AS n_variant FROM nodes),
        (SELECT count(*) AS n_edges, count(DISTINCT relation_type) AS n_relations, count(*) FILTER ({_DG}) AS n_drug_gene_edges FROM edges)""",
    "metagraph_counts": "SELECT source_type, target_type, count(*) AS n_edges FROM edges GROUP BY ALL",
    "node_composition": "SELECT node_type, count(*) AS n_nodes, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM nodes GROUP BY ALL",
    "node_expansion": f"""WITH {INDEXED}, e AS (SELECT node_type, {clean('node_id')} AS node_id FROM nodes UNION SELECT source_type, source_id FROM indexed WHERE source_idx IS NULL
        UNION SELECT target_type, target_id FROM indexed WHERE target_idx IS NULL) SELECT node_type, count(*) AS n_nodes FROM e WHERE node_type IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL""",
    "alias_collapse": f"WITH {ALIASES} SELECT node_type, count(*) AS n_ids, count(*) FILTER (endpoint_name_count > 1) AS n_aliased, max(endpoint_name_count) AS max_names FROM aliases GROUP BY ALL",
    "duplicate_edges": "SELECT source_idx, target_idx, source_type, target_type, evidence, association, count(*) AS n_rows FROM edges GROUP BY ALL HAVING count(*) > 1",
    "contradictory_labels": "SELECT source_idx, target_idx, source_type, target_type, evidence, list_sort(list(DISTINCT association)) AS labels FROM edges GROUP BY ALL HAVING count(DISTINCT association) > 1",
    "mapping_loss": f"""SELECT entity1_type, entity2_type, count(*) AS n_records, count(*) FILTER (NOT ({_HAP})) AS n_in_scope,
        count(*) FILTER ({ctype('entity1_type')} IS NOT NULL AND {ctype('entity2_type')} IS NOT NULL) AS n_typed FROM relationships GROUP BY ALL""",
    "undirected_edges": f"WITH {_UND} SELECT * FROM und",
    "simple_degree": f"WITH {_UND} SELECT node_idx, count(*) AS degree FROM (SELECT a AS node_idx FROM und UNION ALL SELECT b FROM und) GROUP BY ALL",
    "pair_relation": """SELECT u, v, arg_max(relation_type, edge_index) AS relation_type FROM (SELECT source_idx AS u, target_idx AS v, relation_type, edge_index FROM edges
        UNION ALL SELECT target_idx, source_idx, relation_type, edge_index FROM edges) WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL""",
    "display_edges": """SELECT source_idx, target_idx, evidence, edge_index, association FROM edges QUALIFY row_number() OVER (PARTITION BY source_idx, target_idx ORDER BY evidence, edge_index) = 1""",
}
