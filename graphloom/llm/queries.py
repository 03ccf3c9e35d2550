"""Queries of the training-data problems, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import entities as en
from graphloom.llm import entity_splits, overlaps, packing, stuffed_pages, tokens, top_n
from graphloom.session import cut_lineage, read_table


def _drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, chemicals = read_table(spark, sf_dir, "nodes"), read_table(spark, sf_dir, "chemicals")
    return en.drug_entities(nodes, en.drug_forest(nodes, chemicals))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_splits.entities_across_splits(read_table(spark, sf_dir, "split_assignments"), _drugs(spark, sf_dir))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_splits.grouped_splits(read_table(spark, sf_dir, "split_assignments"), _drugs(spark, sf_dir))


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p1_splits must hold: rows, drugs and entities dealt, entities in several splits (none), and whether every share is within 0.02 of its target."""
    dealt = cut_lineage(p1_splits(spark, sf_dir).select("drug_idx", "drug_entity", "split"))
    parts = dealt.groupBy("drug_entity").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("a") != F.col("b")).alias("n_broken"))
    share = lambda s: F.count_if(F.col("split") == s) / F.count(F.lit(1))
    near = [F.abs(share(s) - target) <= 0.02 for s, target in zip(en.SPLITS, (0.8, 0.1, 0.1), strict=True)]
    rows = dealt.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("drug_idx").alias("n_drugs"), (near[0] & near[1] & near[2]).alias("balanced"))
    return rows.crossJoin(F.broadcast(parts))  # one row each


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n.top_n(read_table(spark, sf_dir, "test_pairs"), "drug_idx", "gene_idx", "score", 10)
    return best.select("drug_idx", "gene_idx", "rank_no")


def _records(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Counted rows with their texts."""
    genes = en.gene_entities(read_table(spark, sf_dir, "nodes"))
    rows = overlaps.named_rows(read_table(spark, sf_dir, "split_assignments"), _drugs(spark, sf_dir), genes)
    return cut_lineage(overlaps.record_texts(rows).select("row_id", "split", *extra, "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_pairs(_records(spark, sf_dir))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_report(_records(spark, sf_dir, "record_source"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per overlapping row its links; the class stays a name of our own."""
    return overlaps.overlap_classes(_records(spark, sf_dir)).select("row_id", "links")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.count_tokens(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack_items(sizes, "doc_id", "n_tokens", 2048)


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p7_pack must hold: every text there once and whole, no container over capacity, no text cut that would fit, and containers 0.99 full."""
    sizes = cut_lineage(tokens.count_tokens(read_table(spark, sf_dir, "documents"), "doc_id", "text"))
    packed = cut_lineage(packing.pack_items(sizes, "doc_id", "n_tokens", 2048))
    placed = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("parts"))
    texts = sizes.join(placed, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.coalesce("placed", F.lit(-1)) != F.col("n_tokens")).alias("n_lost"), F.count_if((F.col("n_tokens") <= 2048) & (F.col("parts") > 1)).alias("n_cut")
    )
    loads = packed.filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    full = loads.agg(F.count_if(F.col("load") > 2048).alias("n_over"), (F.sum("load") >= F.count(F.lit(1)) * 2048 * 0.99).alias("full"), (F.max("container_id") + 1 == F.count(F.lit(1))).alias("numbered"))
    return texts.crossJoin(F.broadcast(full))  # one row each


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages.stuffed_pages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "page_labels"))


QUERIES = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_bounds": p1_bounds,
    "p2_found": p2_found,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_classes": p5_classes,
    "p6_ids": p6_ids,
    "p7_pack": p7_pack,
    "p7_bounds": p7_bounds,
    "p8_found": p8_found,
}

def _plain_sql(column: str, name: str) -> str:
    return rf"regexp_replace(lower(coalesce({column}, '')), '[\s_\-\x1f]+', ' ', 'g') AS {name}"


_ENTITIES = r"""
    WITH RECURSIVE acc AS (
        SELECT node_index, node_type, nullif(regexp_extract(node_id, '(?i)PA[^0-9A-Za-z]*0*([0-9]+)', 1), '') AS a FROM nodes),
    held AS (
        SELECT DISTINCT nullif(regexp_extract(pharmgkb_accession_id, '(?i)PA[^0-9A-Za-z]*0*([0-9]+)', 1), '') AS a,
            regexp_replace(smiles, '[\s\x{a0}]+', '', 'g') AS s FROM chemicals),
    kept AS (
        SELECT a, s FROM held WHERE a IS NOT NULL AND regexp_matches(s, '[A-Za-z]')
            AND lower(s) NOT IN ('none', 'null', 'nan', 'na', 'n/a', 'n.a.', '[notavailable]', 'notavailable', 'unknown', 'missing')
            AND a IN (SELECT a FROM acc WHERE node_type = 'drug')),
    link AS (SELECT x.a AS u, y.a AS v FROM kept x JOIN kept y USING (s) WHERE x.a <> y.a),
    reach(u, v) AS (SELECT DISTINCT u, u FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
    root AS (SELECT u AS a, min(v) AS r FROM reach GROUP BY u),
    drug AS (
        SELECT node_index AS drug_idx, coalesce(r, a, 'node:' || node_index) AS drug_entity
        FROM acc LEFT JOIN root USING (a) WHERE node_type = 'drug'),
    gene AS (
        SELECT node_index AS gene_idx, coalesce(a, 'node:' || node_index) AS gene_entity FROM acc WHERE node_type = 'gene'),
    counted AS (
        SELECT s.row_id, s.drug_idx, s.gene_idx, s.record_source, s.source_type, s.target_type, s.evidence, s.association, p.split, coalesce(drug_entity, 'node:' || s.drug_idx) AS de,
            coalesce(gene_entity, 'node:' || s.gene_idx) AS ge
        FROM split_assignments s
        JOIN (SELECT DISTINCT split AS raw, CASE
                WHEN lower(trim(split)) LIKE 'train%' THEN 'train' WHEN lower(trim(split)) LIKE 'val%' THEN 'validation'
                WHEN lower(trim(split)) LIKE 'test%' THEN 'test' END AS split FROM split_assignments) p ON p.raw = s.split
        LEFT JOIN drug USING (drug_idx) LEFT JOIN gene USING (gene_idx)
        WHERE p.split IS NOT NULL AND s.drug_idx IS NOT NULL AND s.gene_idx IS NOT NULL)"""

ORACLE = {
    "p1_found": f"""{_ENTITIES}
        SELECT DISTINCT drug_idx FROM counted
        WHERE de IN (SELECT de FROM counted GROUP BY de HAVING count(DISTINCT split) > 1)""",
    "p1_bounds": f"""{_ENTITIES}
        SELECT count(*) AS n_rows, count(DISTINCT drug_idx) AS n_drugs, count(DISTINCT coalesce(drug_entity, 'node:' || drug_idx)) AS n_entities, 0 AS n_broken, true AS balanced
        FROM split_assignments LEFT JOIN drug USING (drug_idx) WHERE drug_idx IS NOT NULL AND gene_idx IS NOT NULL""",
    "p7_bounds": "SELECT count(*) AS n_docs, 0 AS n_lost, 0 AS n_cut, 0 AS n_over, true AS full, true AS numbered FROM documents",
    "p2_found": """
        WITH best AS (
            SELECT drug_idx, gene_idx, max(score) AS score FROM test_pairs
            WHERE drug_idx IS NOT NULL AND gene_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
        ranked AS (
            SELECT drug_idx, gene_idx, row_number() OVER (PARTITION BY drug_idx ORDER BY score DESC, gene_idx) AS rank_no FROM best)
        SELECT * FROM ranked WHERE rank_no <= 10""",
    "p5_found": f"""{_ENTITIES}
        SELECT least(t.row_id, h.row_id) AS row_id_a, greatest(t.row_id, h.row_id) AS row_id_b
        FROM counted t JOIN counted h USING (de, ge) WHERE t.split = 'train' AND h.split <> 'train'""",
    "p5_classes": f"""{_ENTITIES},
        n AS (SELECT de, ge, count(*) FILTER (split = 'train') AS t, count(*) FILTER (split <> 'train') AS h FROM counted GROUP BY ALL)
        SELECT row_id, CASE WHEN split = 'train' THEN h ELSE t END AS links FROM counted JOIN n USING (de, ge) WHERE t > 0 AND h > 0""",
    "p5_report": f"""{_ENTITIES},
        plain AS (SELECT *, {", ".join(_plain_sql(c, "f" + str(i)) for i, c in enumerate(overlaps.FIELDS))} FROM counted),
        seen AS (
            SELECT de, ge, count(*) AS n, {", ".join(f"list(DISTINCT f{i}) AS l{i}" for i in range(4))}, list(DISTINCT concat_ws(chr(31), f0, f1, f2, f3)) AS whole FROM plain WHERE split = 'train' GROUP BY ALL),
        outer_rows AS (
            SELECT h.split, record_source, n, list_contains(whole, concat_ws(chr(31), f0, f1, f2, f3)) AS exact, 7 + length(de) + length(ge) AS core,
                {" + ".join(f"(3 + length(f{i}))" for i in range(4))} AS rest, {" + ".join(f"CASE WHEN list_contains(l{i}, f{i}) THEN 3 + length(f{i}) ELSE 0 END" for i in range(4))} AS shared
            FROM plain h LEFT JOIN seen USING (de, ge) WHERE h.split <> 'train')
        SELECT split, record_source, count(*) AS n_rows, count(n) AS n_overlapping, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_near,
            coalesce(sum(core + rest) FILTER (n IS NOT NULL), 0)::BIGINT AS n_chars, coalesce(sum(core + shared) FILTER (n IS NOT NULL), 0)::BIGINT AS n_covered, coalesce(sum(n), 0)::BIGINT AS n_pairs
        FROM outer_rows GROUP BY ALL""",
}
