"""Queries of the two general data-preparation problems: heavy keys (p3) and packed fields (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.packed_values import unpack_values
from graphloom.operators.tree_aggregate import heavy_nodes, node_degrees, node_relation_counts
from graphloom.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_nodes(read_table(spark, sf_dir, "edges"))


def p3_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_degrees(read_table(spark, sf_dir, "edges"))


def p3_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_relation_counts(read_table(spark, sf_dir, "edges"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = unpack_values(read_table(spark, sf_dir, "relationships"), "rel_id", "evidence")
    return values.select(F.col("id").alias("rel_id"), "pos", F.col("value").alias("evidence_value"))


QUERIES = {
    "p3_found": p3_found,
    "p3_degree": p3_degree,
    "p3_relation_counts": p3_relation_counts,
    "p4_found": p4_found,
}

_ENDS = """(SELECT 'source' AS side, source_idx AS node_idx, relation_type FROM edges
            UNION ALL SELECT 'target', target_idx, relation_type FROM edges)"""
ORACLE = {
    "p3_found": f"""
        SELECT side, node_idx FROM {_ENDS} WHERE node_idx IS NOT NULL GROUP BY ALL
        HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM edges)""",
    "p3_degree": f"""
        SELECT side, node_idx, count(*) AS degree FROM {_ENDS} WHERE node_idx IS NOT NULL GROUP BY ALL""",
    "p3_relation_counts": f"""
        SELECT side, node_idx, relation_type, count(*) AS n_rows FROM {_ENDS}
        WHERE node_idx IS NOT NULL GROUP BY ALL""",
    "p4_found": r"""
        WITH a AS (
            SELECT rel_id, regexp_replace(evidence, '^[\s\x{a0}]*[\[{](.*)[\]}][\s\x{a0}]*$', '\1', 's') AS e
            FROM relationships),
        b AS (
            SELECT rel_id, regexp_extract_all(e,
                '[ \x{a0}]*"(?:""|\\"|[^"])*"|[ \x{a0}]*“[^”]*”|[ \x{a0}]*''(?:''''|[^''])*''|[^,;/|\t\n\r，；]+') AS parts
            FROM a),
        c AS (
            SELECT rel_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM b),
        d AS (
            SELECT rel_id, n, regexp_replace(part, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS v FROM c),
        e AS (
            SELECT rel_id, n, CASE
                WHEN v LIKE '"%"' THEN replace(replace(v[2:-2], '""', '"'), '\"', '"')
                WHEN v LIKE '“%”' THEN v[2:-2]
                WHEN v LIKE '''%''' THEN replace(v[2:-2], '''''', '''')
                ELSE v END AS v FROM d)
        SELECT rel_id, row_number() OVER (PARTITION BY rel_id ORDER BY n) AS pos, v AS evidence_value
        FROM e WHERE lower(v) NOT IN ('', 'nan', 'na', 'none', 'null')""",
}
