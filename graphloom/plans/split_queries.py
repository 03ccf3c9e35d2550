"""Queries over pairs, splits and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph_build as gb
from graphloom.operators import quality as dq
from graphloom.operators import splits as sp
from graphloom.plans.common import ASSIGNED, assignments
from graphloom.plans.graph_queries import assoc, clean
from graphloom.session import cut_lineage
from graphloom.session import read_table as t

SLIM = ["edge_index", "source_idx", "target_idx", "source_type", "target_type", "evidence", "association"]


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return sp.pair_table(t(s, d, "edges"))


def _strata(s: SparkSession, d: str) -> DataFrame:
    return sp.drug_strata(_pairs(s, d))


def _drugs(s: SparkSession, d: str) -> DataFrame:
    return cut_lineage(sp.assign_drugs(cut_lineage(_strata(s, d))))


def _edges(s: SparkSession, d: str, protocol: str) -> DataFrame:
    return sp.assign_edges(t(s, d, "edges").select(*SLIM), _drugs(s, d), protocol)


def _allocation(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(sp.allocations(_strata(s, d)), "degree_stratum string, n_validation bigint, n_test bigint")


def _audit(s: SparkSession, d: str, protocol: str) -> DataFrame:
    drugs, pairs = _drugs(s, d), _pairs(s, d)
    edges = cut_lineage(sp.assign_edges(t(s, d, "edges").select(*SLIM), drugs, protocol))
    assigned = sp.assign_pairs(pairs, drugs)
    return sp.leakage_audit(edges, sp.evaluation_pairs(assigned, "validation"), sp.evaluation_pairs(assigned, "test"))


def _exposure(s: SparkSession, d: str) -> DataFrame:
    drugs = _drugs(s, d)
    edges = sp.assign_edges(t(s, d, "edges").select(*SLIM), drugs, "dg_context")
    return sp.variant_exposure(edges, sp.evaluation_pairs(sp.assign_pairs(_pairs(s, d), drugs), "test"))


def _acc(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn("acc", F.nullif(F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", "")), F.lit("")))


QUERIES = {
    "orient_pairs": lambda s, d: sp.orient_pairs(t(s, d, "edges")).select("edge_index", "drug_idx", "gene_idx", "association"),
    "canonical_pairs": lambda s, d: sp.canonical_pairs(t(s, d, "edges")),
    "known_positives": lambda s, d: sp.known_positives(t(s, d, "edges")),
    "known_positives_by_drug": lambda s, d: sp.known_positives(t(s, d, "edges")).groupBy("drug_idx").agg(F.array_sort(F.collect_set("gene_idx")).alias("genes")),
    "training_positives": lambda s, d: sp.training_positives(_edges(s, d, "dg_context")),
    "pair_label_priority": lambda s, d: sp.pair_label_priority(t(s, d, "edges")),
    "drug_degree_strata": _strata,
    "stratum_sizes": lambda s, d: sp.stratum_sizes(_strata(s, d)),
    "largest_remainder": _allocation,
    "stratified_split_hash": _drugs,
    "stratum_split_pivot": lambda s, d: _drugs(s, d).filter("degree_stratum IS NOT NULL").groupBy("seed", "degree_stratum").agg(*[F.count_if(F.col("split") == x).alias(x) for x in ("train", "validation", "test")]),
    "assign_pairs": lambda s, d: sp.assign_pairs(_pairs(s, d), _drugs(s, d)).select("seed", "drug_idx", "gene_idx", "association", "split"),
    "assign_edges_context": lambda s, d: _edges(s, d, "dg_context").select("edge_index", "seed", "supervision_split", "in_training_graph", "removal_reason"),
    "assign_edges_strict": lambda s, d: _edges(s, d, "strict_cold").select("edge_index", "seed", "supervision_split", "in_training_graph", "removal_reason"),
    "removal_counts": lambda s, d: _edges(s, d, "strict_cold").groupBy("seed", "removal_reason").agg(F.count(F.lit(1)).alias("n_edges")),
    "evaluation_pairs": lambda s, d: sp.evaluation_pairs(sp.assign_pairs(_pairs(s, d), _drugs(s, d)), "test"),
    "evaluation_edges": lambda s, d: _edges(s, d, "dg_context").filter("is_drug_gene AND supervision_split = 'test' AND association = 'associated'").select("seed", "edge_index"),
    "relation_vocab_semi": lambda s, d: sp.seen_relations(assignments(s, d)).select("row_id", "relation_type"),
    "supervision_regimes": lambda s, d: sp.supervision_regimes(_pairs(s, d)),
    "variant_exposure": _exposure,
    "leakage_audit_context": lambda s, d: _audit(s, d, "dg_context"),
    "leakage_audit_strict": lambda s, d: _audit(s, d, "strict_cold"),
    "leakage_audit_legacy": lambda s, d: sp.heldout_in_training(assignments(s, d)),
    "variant_path_audit": lambda s, d: sp.variant_path_audit(t(s, d, "edges").select(*SLIM)),
    "dq_blank_endpoints": lambda s, d: dq.blank_endpoints(t(s, d, "relationships")),
    "dq_unknown_labels": lambda s, d: dq.unknown_labels(t(s, d, "relationships")),
    "dq_duplicate_keys": lambda s, d: dq.duplicate_keys(t(s, d, "nodes")),
    "dq_pair_invariants": lambda s, d: dq.pair_invariants(sp.canonical_pairs(t(s, d, "edges"))),
    "dq_graph_invariants": lambda s, d: dq.graph_invariants(gb.graph_manifest(t(s, d, "nodes"), t(s, d, "edges")), {"n_nodes": 39076, "n_edges": 47072, "n_relations": 56}),
    "dq_index_range": lambda s, d: dq.index_range(t(s, d, "edges"), t(s, d, "nodes").agg(F.count(F.lit(1)).alias("n"))),
    "dq_contiguous": lambda s, d: dq.contiguous(t(s, d, "nodes")),
    "dq_reverse_consistency": lambda s, d: dq.reverse_consistency(sp.orient_pairs(t(s, d, "edges"))),
    "one_to_one_join": lambda s, d: dq.one_to_one(_acc(t(s, d, "nodes").filter("node_type = 'drug'"), "node_id"), _acc(t(s, d, "chemicals"), "pharmgkb_accession_id"), "acc"),
    "fingerprint_join": lambda s, d: dq.fingerprint_join(t(s, d, "nodes"), t(s, d, "chemicals").filter("smiles IS NOT NULL")),
    "fingerprint_alignment": lambda s, d: dq.alignment(
        t(s, d, "nodes").filter("node_type = 'gene' AND NOT is_supplemental").select(F.col("node_index").alias("idx"), F.col("node_name").alias("label")),
        t(s, d, "core_genes").select(F.col("gene_idx").alias("idx"), F.col("symbol").alias("label"))),
    "fingerprint_summary": lambda s, d: dq.fingerprint_summary(t(s, d, "embeddings")),
}

_DG = "((source_type = 'drug' AND target_type = 'gene') OR (source_type = 'gene' AND target_type = 'drug'))"
_OR = f"""orient AS (SELECT *, CASE WHEN source_type = 'drug' THEN source_idx ELSE target_idx END AS drug_idx, CASE WHEN source_type = 'drug' THEN target_idx ELSE source_idx END AS gene_idx
    FROM edges WHERE {_DG}), pairs AS (SELECT drug_idx, gene_idx, CASE WHEN min(association) = max(association) THEN min(association) END AS association FROM orient GROUP BY ALL)"""
_CP = """cp AS (SELECT drug_idx, gene_idx, count(*) AS directed_edge_count, list_sort(list(DISTINCT association)) AS associations, list_sort(list(DISTINCT evidence)) AS evidence_categories,
    list_sort(list(edge_index)) AS directed_edge_indices FROM orient GROUP BY ALL)"""
_ST = f"""{_OR}, strata AS (SELECT drug_idx, count(*) FILTER (association = 'associated') AS associated_pair_count, count(*) AS all_pair_count,
        count(*) FILTER (association = 'associated') >= 2 AS eligible,
        CASE WHEN count(*) FILTER (association = 'associated') >= 20 THEN '20+' WHEN count(*) FILTER (association = 'associated') >= 10 THEN '10-19' WHEN count(*) FILTER (association = 'associated') >= 5 THEN '5-9'
            WHEN count(*) FILTER (association = 'associated') >= 3 THEN '3-4' WHEN count(*) FILTER (association = 'associated') = 2 THEN '2' END AS degree_stratum
        FROM pairs GROUP BY drug_idx),
    sizes AS (SELECT degree_stratum, count(drug_idx) AS n_drugs FROM (VALUES ('2'), ('3-4'), ('5-9'), ('10-19'), ('20+')) v(degree_stratum) LEFT JOIN (SELECT * FROM strata WHERE eligible) USING (degree_stratum) GROUP BY ALL)"""
_AL = f"""{_ST}, target AS (SELECT round_even(sum(n_drugs) * 0.1::DOUBLE, 0)::BIGINT AS k FROM sizes),
    v AS (SELECT degree_stratum, n_drugs, floor(n_drugs * 0.1::DOUBLE)::BIGINT AS f, row_number() OVER (ORDER BY n_drugs * 0.1::DOUBLE - floor(n_drugs * 0.1::DOUBLE) DESC, degree_stratum) AS r FROM sizes),
    v2 AS (SELECT *, f + (r <= (SELECT k FROM target) - (SELECT sum(f) FROM v))::BIGINT AS n_validation FROM v),
    w AS (SELECT *, sum((n_drugs - n_validation > f)::BIGINT) OVER (ORDER BY r) AS open_rank FROM v2),
    alloc AS (SELECT degree_stratum, n_validation, f + (n_drugs - n_validation > f AND open_rank <= (SELECT k FROM target) - (SELECT sum(f) FROM v))::BIGINT AS n_test FROM w)"""
_AS = f"""{_AL}, seeds AS (SELECT unnest([42, 123, 2026])::INTEGER AS seed),
    placed AS (SELECT drug_idx, seed, degree_stratum, row_number() OVER (PARTITION BY seed, degree_stratum ORDER BY md5(seed || ':' || lpad(drug_idx::VARCHAR, 9, '0')), drug_idx) - 1 AS p FROM strata, seeds WHERE eligible),
    drugs AS (SELECT drug_idx, seed, degree_stratum, CASE WHEN p < n_validation THEN 'validation' WHEN p < n_validation + n_test THEN 'test' ELSE 'train' END AS split FROM placed JOIN alloc USING (degree_stratum)
        UNION ALL SELECT drug_idx, seed, NULL, 'training_context_only' FROM strata, seeds WHERE NOT eligible)"""
_AE = f"""{_AS}, ae AS (SELECT e.*, seeds.seed, {_DG} AS is_drug_gene, d.split AS end_split, coalesce(d.split IN ('validation', 'test'), false) AS held
        FROM edges e CROSS JOIN seeds LEFT JOIN drugs d ON d.seed = seeds.seed AND d.drug_idx = CASE WHEN source_type = 'drug' THEN source_idx WHEN target_type = 'drug' THEN target_idx END),
    context AS (SELECT *, CASE WHEN is_drug_gene THEN end_split END AS supervision_split, CASE WHEN held AND is_drug_gene THEN 'heldout_drug_gene' ELSE 'retained' END AS removal_reason FROM ae),
    strict AS (SELECT *, CASE WHEN is_drug_gene THEN end_split END AS supervision_split, CASE WHEN held AND is_drug_gene THEN 'heldout_drug_gene' WHEN held THEN 'heldout_drug_context' ELSE 'retained' END AS removal_reason FROM ae)"""


def _exposed(table: str) -> str:
    side = lambda k, n: f"""{n} AS (SELECT DISTINCT seed, CASE WHEN source_type = '{k}' THEN source_idx ELSE target_idx END AS {k}_idx, CASE WHEN source_type = '{k}' THEN target_idx ELSE source_idx END AS v FROM {table}
        WHERE removal_reason = 'retained' AND ((source_type = '{k}' AND target_type = 'variant') OR (source_type = 'variant' AND target_type = '{k}')))"""  # noqa: E731
    return f"""{_AE}, evals AS (SELECT seed, drug_idx, gene_idx, split FROM pairs JOIN drugs USING (drug_idx) WHERE association = 'associated' AND split IN ('validation', 'test')),
        {side('drug', 'dv')}, {side('gene', 'vg')}, hit AS (SELECT seed, drug_idx, gene_idx, list_sort(list(DISTINCT v)) AS vs FROM evals JOIN dv USING (seed, drug_idx) JOIN vg USING (seed, gene_idx, v) GROUP BY ALL),
        exposed AS (SELECT e.*, coalesce(vs, []) AS mediating_variants, coalesce(len(vs), 0) AS mediating_variant_count FROM evals e LEFT JOIN hit USING (seed, drug_idx, gene_idx))"""


def _audit_sql(table: str) -> str:
    return f"""WITH {_exposed(table)}, a AS (SELECT seed, count(*) FILTER (is_drug_gene AND supervision_split IN ('validation', 'test')) AS heldout_edges_in_training,
            count(*) FILTER (held AND NOT is_drug_gene) AS context_edges_retained FROM {table} WHERE removal_reason = 'retained' GROUP BY ALL),
        b AS (SELECT seed, count(*) FILTER (split = 'validation') AS validation_pairs, count(*) FILTER (split = 'validation' AND mediating_variant_count > 0) AS validation_exposed,
            count(*) FILTER (split = 'test') AS test_pairs, count(*) FILTER (split = 'test' AND mediating_variant_count > 0) AS test_exposed FROM exposed GROUP BY ALL)
        SELECT *, round(validation_exposed / validation_pairs, 6) AS validation_fraction, round(test_exposed / test_pairs, 6) AS test_fraction FROM a LEFT JOIN b USING (seed)"""


_BLANK = " OR ".join(f"{clean(c)} IS NULL" for c in ("entity1_id", "entity1_name", "entity1_type", "entity2_id", "entity2_name", "entity2_type"))

ORACLE = {
    "dq_blank_endpoints": f"SELECT rel_id FROM relationships WHERE {_BLANK}",
    "dq_unknown_labels": f"SELECT association, count(*) AS n FROM relationships WHERE {assoc('association')} IS NULL GROUP BY ALL",
    "orient_pairs": f"WITH {_OR} SELECT edge_index, drug_idx, gene_idx, association FROM orient",
    "canonical_pairs": f"WITH {_OR}, {_CP} SELECT *, CASE WHEN len(associations) = 1 THEN associations[1] END AS association FROM cp",
    "known_positives": f"WITH {_OR} SELECT DISTINCT drug_idx, gene_idx FROM orient WHERE association = 'associated'",
    "known_positives_by_drug": f"WITH {_OR} SELECT drug_idx, list_sort(list(DISTINCT gene_idx)) AS genes FROM orient WHERE association = 'associated' GROUP BY ALL",
    "training_positives": f"""WITH {_AE} SELECT DISTINCT source_idx AS drug_idx, target_idx AS gene_idx, seed, 'dg_context' AS protocol FROM context
        WHERE removal_reason = 'retained' AND source_type = 'drug' AND target_type = 'gene' AND association = 'associated'""",
    "pair_label_priority": f"""WITH {_OR} SELECT drug_idx, gene_idx, arg_min(association, CASE association WHEN 'associated' THEN 1 WHEN 'ambiguous' THEN 2 ELSE 3 END) AS label FROM orient WHERE association IS NOT NULL GROUP BY ALL""",
    "drug_degree_strata": f"WITH {_ST} SELECT * FROM strata",
    "stratum_sizes": f"WITH {_ST} SELECT * FROM sizes",
    "largest_remainder": f"WITH {_AL} SELECT * FROM alloc",
    "stratified_split_hash": f"WITH {_AS} SELECT * FROM drugs",
    "stratum_split_pivot": f"""WITH {_AS} SELECT seed, degree_stratum, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test
        FROM drugs WHERE degree_stratum IS NOT NULL GROUP BY ALL""",
    "assign_pairs": f"WITH {_AS} SELECT seed, drug_idx, gene_idx, association, split FROM pairs JOIN drugs USING (drug_idx)",
    "assign_edges_context": f"WITH {_AE} SELECT edge_index, seed, supervision_split, removal_reason = 'retained' AS in_training_graph, removal_reason FROM context",
    "assign_edges_strict": f"WITH {_AE} SELECT edge_index, seed, supervision_split, removal_reason = 'retained' AS in_training_graph, removal_reason FROM strict",
    "removal_counts": f"WITH {_AE} SELECT seed, removal_reason, count(*) AS n_edges FROM strict GROUP BY ALL",
    "evaluation_pairs": f"WITH {_AS} SELECT seed, drug_idx, gene_idx FROM pairs JOIN drugs USING (drug_idx) WHERE split = 'test' AND association = 'associated'",
    "evaluation_edges": f"WITH {_AE} SELECT seed, edge_index FROM context WHERE is_drug_gene AND supervision_split = 'test' AND association = 'associated'",
    "relation_vocab_semi": f"""SELECT row_id, relation_type FROM {ASSIGNED} WHERE split IN ('validation', 'test') AND relation_type IN (SELECT relation_type FROM {ASSIGNED} WHERE split = 'train')""",
    "supervision_regimes": f"""WITH {_OR} SELECT regime, drug_idx, gene_idx, association = 'associated' OR (regime = 'ambig_as_pos' AND association = 'ambiguous') AS positive
        FROM pairs, (SELECT unnest(['default', 'ambig_as_pos', 'nonassoc_excluded']) AS regime) WHERE association IS NOT NULL AND NOT (regime = 'nonassoc_excluded' AND association = 'not_associated')""",
    "variant_exposure": f"""WITH {_exposed('context')} SELECT seed, drug_idx, gene_idx, mediating_variants, mediating_variant_count, mediating_variant_count > 0 AS variant_mediated_exposure FROM exposed WHERE split = 'test'""",
    "leakage_audit_context": _audit_sql("context"),
    "leakage_audit_strict": _audit_sql("strict"),
    "leakage_audit_legacy": f"""WITH b AS (SELECT DISTINCT drug_idx FROM {ASSIGNED} WHERE split = 'test' AND drug_idx IN (SELECT drug_idx FROM {ASSIGNED} WHERE split = 'train'))
        SELECT (SELECT count(*) FROM b) AS n_leaked, coalesce((SELECT list_sort(list(drug_idx)) FROM (SELECT drug_idx FROM b ORDER BY drug_idx LIMIT 20)), []) AS first_drugs""",
    "variant_path_audit": f"""WITH {_OR}, x AS (SELECT CASE WHEN source_type = 'variant' THEN target_idx ELSE source_idx END AS o, CASE WHEN source_type = 'variant' THEN source_idx ELSE target_idx END AS v,
            CASE WHEN source_type = 'variant' THEN target_type ELSE source_type END AS k FROM edges WHERE (source_type = 'variant') <> (target_type = 'variant')),
        h AS (SELECT DISTINCT p.drug_idx, p.gene_idx, p.association, a.v FROM pairs p JOIN x a ON a.k = 'drug' AND a.o = p.drug_idx JOIN x b ON b.k = 'gene' AND b.o = p.gene_idx AND b.v = a.v WHERE p.association IS NOT NULL)
        SELECT association, count(*) AS n_pairs, coalesce(any_value(n_linked), 0) AS n_linked, round(100.0 * coalesce(any_value(n_linked), 0) / count(*), 6) AS percent_linked, coalesce(any_value(n_variants), 0) AS n_variants
        FROM pairs LEFT JOIN (SELECT association, count(DISTINCT (drug_idx, gene_idx)) AS n_linked, count(DISTINCT v) AS n_variants FROM h GROUP BY ALL) USING (association) WHERE association IS NOT NULL GROUP BY association""",
    "dq_pair_invariants": f"WITH {_OR}, {_CP} SELECT drug_idx, gene_idx, directed_edge_count, len(associations)::BIGINT AS n_labels FROM cp WHERE directed_edge_count <> 2 OR len(associations) <> 1",
    "dq_graph_invariants": """SELECT * FROM (SELECT 'n_nodes' AS metric, 39076::BIGINT AS expected, count(*) AS actual FROM nodes UNION ALL SELECT 'n_edges', 47072, count(*) FROM edges
        UNION ALL SELECT 'n_relations', 56, count(DISTINCT relation_type) FROM edges) WHERE expected <> actual""",
    "dq_index_range": """SELECT edge_index, source_idx, target_idx FROM edges, (SELECT count(*) AS n FROM nodes) WHERE source_idx IS NULL OR target_idx IS NULL OR least(source_idx, target_idx) < 0 OR greatest(source_idx, target_idx) >= n""",
    "dq_contiguous": """SELECT min(node_index) AS least, max(node_index) AS greatest, count(DISTINCT node_index) AS n_distinct, count(*) AS n_rows,
        min(node_index) = 0 AND max(node_index) = count(*) - 1 AND count(DISTINCT node_index) = count(*) AS is_contiguous FROM nodes""",
    "dq_reverse_consistency": f"""WITH {_OR} SELECT drug_idx, gene_idx, evidence, count(DISTINCT source_type) AS n_directions, count(DISTINCT association) AS n_labels FROM orient GROUP BY ALL HAVING n_directions <> 2 OR n_labels <> 1""",
    "dq_duplicate_keys": r"""SELECT node_index, node_type, key, n FROM (SELECT node_index, node_type, upper(regexp_replace(node_id, '[^\p{L}\p{N}]', '', 'g')) AS key, count(*) OVER (PARTITION BY node_type, upper(regexp_replace(node_id, '[^\p{L}\p{N}]', '', 'g'))) AS n FROM nodes) WHERE n > 1""",
    "one_to_one_join": """WITH a AS (SELECT upper(regexp_replace(node_id, '[^A-Za-z0-9]', '', 'g')) AS acc, count(*) AS a FROM nodes WHERE node_type = 'drug' GROUP BY ALL),
        b AS (SELECT upper(regexp_replace(pharmgkb_accession_id, '[^A-Za-z0-9]', '', 'g')) AS acc, count(*) AS b FROM chemicals GROUP BY ALL)
        SELECT count(*) AS n_keys, count(*) FILTER (a > 1) AS repeated_left, count(*) FILTER (b > 1) AS repeated_right, count(*) FILTER (b IS NULL) AS unmatched FROM a LEFT JOIN b USING (acc) WHERE acc <> ''""",
    "fingerprint_join": """SELECT node_index, lower(trim(node_name, ' ')) IN (SELECT lower(trim(name, ' ')) FROM chemicals WHERE smiles IS NOT NULL AND name IS NOT NULL) IS TRUE AS has_fp FROM nodes WHERE node_type = 'drug'""",
    "fingerprint_alignment": """WITH a AS (SELECT node_index AS idx, node_name AS label FROM nodes WHERE node_type = 'gene' AND NOT is_supplemental), b AS (SELECT gene_idx AS idx, symbol AS label FROM core_genes)
        SELECT *, 'left' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT ALL FROM a)""",
    "fingerprint_summary": """WITH a AS (SELECT vec_id, embedding, len(list_filter(embedding, lambda x: x > 0)) AS n_bits, list_transform(embedding, lambda x: x > 0) AS p FROM embeddings)
        SELECT count(*) AS n_vectors, count(*) FILTER (embedding IS NULL) AS n_missing, count(DISTINCT p) AS n_distinct, min(n_bits) AS least_bits, round(avg(n_bits), 6) AS mean_bits, max(n_bits) AS most_bits FROM a""",
}
