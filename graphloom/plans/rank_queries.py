"""Queries over ranks, baselines, comparisons and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import graph_build as gb
from graphloom.operators import ranking as rk
from graphloom.operators import splits as sp
from graphloom.operators import stats
from graphloom.operators.positions import accession
from graphloom.plans.common import ASSIGNED, STRUCTURE, accession_sql, assignments
from graphloom.session import cut_lineage
from graphloom.session import read_table as t

SEEDS = (42, 123, 2026)


def _pool(s: SparkSession, d: str) -> DataFrame:
    return rk.candidates(t(s, d, "test_pairs"))


def _genes(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "nodes").filter("node_type = 'gene'").select(F.col("node_index").alias("gene_idx"))


def _degree(s: SparkSession, d: str) -> DataFrame:
    return rk.gene_degree(assignments(s, d), _genes(s, d))


def _paired(s: SparkSession, d: str) -> DataFrame:
    pool = cut_lineage(_pool(s, d))
    return rk.compare_ranks(rk.rank_known(pool), rk.degree_baseline(pool, _degree(s, d)))


def _structured(s: SparkSession, d: str) -> DataFrame:
    """(drug_idx, has_structure, seen_in_train) of test drugs, by the structures of their nodes."""
    held = t(s, d, "chemicals").select(accession(F.col("pharmgkb_accession_id")).alias("acc"), tx.structure("smiles").alias("smiles")).filter("acc IS NOT NULL AND smiles IS NOT NULL").distinct()
    drugs = t(s, d, "nodes").filter("node_type = 'drug'").select(F.col("node_index").alias("drug_idx"), accession(F.col("node_id")).alias("acc")).join(held, "acc", "left").select("drug_idx", "smiles")
    trained = assignments(s, d).filter("split = 'train'").select("drug_idx").distinct()
    seen = drugs.join(trained, "drug_idx", "left_semi").filter("smiles IS NOT NULL").select("smiles").distinct().withColumn("seen", F.lit(True))
    return drugs.join(seen, "smiles", "left").groupBy("drug_idx").agg(F.max(F.col("smiles").isNotNull()).alias("has_structure"), F.coalesce(F.max("seen"), F.lit(False)).alias("seen_in_train"))


def subset_metrics(s: SparkSession, d: str) -> DataFrame:
    flags = _structured(s, d)
    marked = rk.rank_known(_pool(s, d)).join(flags, "drug_idx", "left").withColumn("h", F.coalesce("has_structure", F.lit(False)))
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("h"), "with_structure").otherwise("without_structure"), F.when(F.col("h") & ~F.col("seen_in_train"), "structure_clean")))
    return rk.rank_metrics(marked.withColumn("subset", F.explode(subsets)), ["subset"])


def _seeded(s: SparkSession, d: str) -> DataFrame:
    pool = cut_lineage(_pool(s, d))
    return (
        rk.random_baseline(pool, SEEDS).select("seed", "drug_idx", "gene_idx", F.col("rank").alias("rank_b"))
        .join(rk.rank_known(pool).select("drug_idx", "gene_idx", F.col("rank").alias("rank_a")), ["drug_idx", "gene_idx"])
        .withColumn("delta_rr", 1 / F.col("rank_a") - 1 / F.col("rank_b"))
    )


def seed_summary(s: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation over seeds of the per-seed figures."""
    per = _seeded(s, d).groupBy("seed").agg(F.avg("delta_rr").alias("delta"), F.avg(1 / F.col("rank_b")).alias("mrr_b"))
    return per.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.stddev_samp("delta"), 6).alias("sd_delta"), F.count_if(F.col("delta") > 0).alias("n_positive"),
        F.round(F.avg("mrr_b"), 6).alias("mean_mrr_b"), F.round(F.stddev_samp("mrr_b"), 6).alias("sd_mrr_b"))


def molecular_summary(s: SparkSession, d: str) -> DataFrame:
    """Per seed difference to the random ranker with its bootstrap interval, and the counts of seeds by sign of the interval."""
    ci = stats.paired_bootstrap(_seeded(s, d), "delta_rr", ["drug_idx", "gene_idx"], ["seed"], 2000)
    return ci.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("mean"), 6).alias("mean_delta"), F.count_if(F.col("mean") > 0).alias("n_positive"), F.count_if(F.col("low") > 0).alias("n_above"), F.count_if(F.col("high") < 0).alias("n_below"))


def degree_group_summary(s: SparkSession, d: str) -> DataFrame:
    groups = _degree(s, d).select("gene_idx", tx.degree_group("degree").alias("degree_group"))
    return rk.comparison_summary(_paired(s, d).join(groups, "gene_idx"), ["degree_group"])


def negative_pool(s: SparkSession, d: str) -> DataFrame:
    edges = t(s, d, "edges")
    known = sp.known_positives(edges)
    genes = gb.local_index(t(s, d, "nodes")).filter("node_type = 'gene'").select(F.col("node_index").alias("gene_idx"), "local_index")
    return rk.negative_samples(known, genes, known, 2, 42)


def early_stopping(s: SparkSession, d: str) -> DataFrame:
    history = t(s, d, "events").groupBy(F.col("event_type").alias("run"), F.dayofyear("ts").cast("bigint").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return rk.early_stopping(history, 3)


def step_up(s: SparkSession, d: str) -> DataFrame:
    """False discovery rates of all candidates together, 1 - score standing for a p value."""
    tested = _pool(s, d).filter("score >= 0 AND score <= 1").withColumn("p", F.round(1 - F.col("score"), 6))
    return stats.bh_qvalues(tested, "p").select("drug_idx", "gene_idx", "p", F.round("q", 6).alias("q"))


QUERIES = {
    "fdr_step_up": step_up,
    "ranking_candidates": _pool,
    "gene_degree": _degree,
    "degree_zscore": lambda s, d: rk.zscore(_degree(s, d), F.log1p("degree"), "z").select("gene_idx", F.round("z", 6).alias("z")),
    "hub_weights": lambda s, d: rk.hub_weights(_degree(s, d)),
    "raw_rank": lambda s, d: rk.rank_known(_pool(s, d), filtered=False).select("drug_idx", "gene_idx", "rank"),
    "filtered_rank": lambda s, d: rk.rank_known(_pool(s, d)).select("drug_idx", "gene_idx", "rank"),
    "degree_rank_ordinal": lambda s, d: rk.ordinal_rank(_degree(s, d)),
    "rank_metrics": lambda s, d: rk.rank_metrics(rk.rank_known(_pool(s, d))),
    "rank_metrics_legacy": lambda s, d: rk.rank_metrics(rk.rank_known(_pool(s, d), filtered=False), cuts=(1, 3, 5, 10)),
    "random_baseline": lambda s, d: rk.rank_metrics(rk.random_baseline(_pool(s, d), SEEDS), ["seed"]),
    "degree_baseline": lambda s, d: rk.degree_baseline(_pool(s, d), _degree(s, d)).select("drug_idx", "gene_idx", "rank"),
    "negative_pool": negative_pool,
    "topk_candidates": lambda s, d: rk.top_candidates(_pool(s, d)),
    "candidate_categories": lambda s, d: rk.top_candidates(_pool(s, d)).groupBy(F.when(F.col("known"), "rediscovered").otherwise("novel").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("drug_idx").alias("n_drugs")),
    "top5_alternatives": lambda s, d: rk.alternatives(_pool(s, d)),
    "recuration_actions": lambda s, d: rk.recuration(_pool(s, d)),
    "modal_relation": lambda s, d: rk.modal_relation(assignments(s, d)),
    "ambiguous_pairs": lambda s, d: t(s, d, "edges").filter(F.lower("association_raw").contains("ambiguous") & F.expr("source_type = 'drug' AND target_type = 'gene'")).select("source_idx", "target_idx", "relation_type").distinct(),
    "paired_rank_compare": lambda s, d: _paired(s, d).withColumn("delta_rr", F.round("delta_rr", 6)),
    "win_tie_loss": lambda s, d: rk.comparison_summary(_paired(s, d)),
    "degree_group": lambda s, d: _degree(s, d).groupBy(tx.degree_group("degree").alias("degree_group")).agg(F.count(F.lit(1)).alias("n_genes")),
    "degree_group_summary": degree_group_summary,
    "seed_summary": seed_summary,
    "molecular_summary": molecular_summary,
    "structure_clean": lambda s, d: _structured(s, d),
    "subset_metrics": subset_metrics,
    "calibration_grid": lambda s, d: rk.calibration_grid(cut_lineage(_pool(s, d)), cut_lineage(_degree(s, d))),
    "bootstrap_ci": lambda s, d: stats.paired_bootstrap(_paired(s, d).withColumn("one", F.lit(1)), "delta_rr", ["drug_idx", "gene_idx"], ["one"]),
    "early_stopping": early_stopping,
    "prefix_share": lambda s, d: _pool(s, d).filter("known").join(t(s, d, "nodes").select(F.col("node_index").alias("gene_idx"), "node_name"), "gene_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.upper("node_name").startswith("X").cast("int")), 6).alias("share")),
}

POOL = """pool AS (SELECT drug_idx, gene_idx, max(score) AS score, coalesce(bool_or(association = 'associated'), false) AS known, max(association) AS label FROM test_pairs
    WHERE drug_idx IS NOT NULL AND gene_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"""
DEG = f"""deg AS (SELECT node_index AS gene_idx, count(DISTINCT drug_idx) AS degree FROM nodes LEFT JOIN (SELECT * FROM {ASSIGNED} WHERE split = 'train' AND association = 'associated') s ON s.gene_idx = node_index
    WHERE node_type = 'gene' GROUP BY ALL)"""


def _rank(pool: str, name: str, filtered: bool = True, by: str = "drug_idx") -> str:
    hit = "q.score > p.score" + (" AND NOT q.known" if filtered else "")
    return f"""{name} AS (SELECT p.*, 1 + count(*) FILTER ({hit}) AS rank FROM {pool} p JOIN {pool} q USING ({by}) WHERE p.known GROUP BY ALL)"""


def _metrics(source: str, cuts: tuple = (1, 3, 10), by: str = "") -> str:
    hits = ", ".join(f"round(coalesce(avg((rank <= {k})::INT), 0), 6) AS hits_at_{k}" for k in cuts)
    return f"""SELECT {by + ',' if by else ''} round(coalesce(avg(1 / rank), 0), 6) AS mrr, {hits}, round(coalesce(avg(rank), 0), 6) AS mean_rank, coalesce(quantile_disc(rank, 0.5), 0)::DOUBLE AS median_rank, count(*) AS n
        FROM {source} {'GROUP BY ' + by if by else ''}"""


_SUM = """count(*) AS n, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'tie') AS ties, count(*) FILTER (outcome = 'loss') AS losses, round(avg(delta_rr), 6) AS delta_mrr,
    round(avg((rank_a <= 10)::INT - (rank_b <= 10)::INT), 6) AS delta_hits_at_10, round(median(rank_a), 6) AS median_a, round(median(rank_b), 6) AS median_b"""
_DPOOL = "dpool AS (SELECT drug_idx, gene_idx, known, degree::DOUBLE AS score FROM pool JOIN deg USING (gene_idx))"
_PAIRED = f"""{POOL}, {DEG}, {_DPOOL}, {_rank('pool', 'ra')}, {_rank('dpool', 'rb')}, paired AS (SELECT drug_idx, gene_idx, ra.rank AS rank_a, rb.rank AS rank_b, 1 / ra.rank - 1 / rb.rank AS delta_rr,
    CASE WHEN ra.rank < rb.rank THEN 'win' WHEN ra.rank > rb.rank THEN 'loss' ELSE 'tie' END AS outcome FROM ra JOIN rb USING (drug_idx, gene_idx))"""
_RAND = f"""{POOL}, rpool AS (SELECT seed, drug_idx, gene_idx, known, ('0x' || substr(md5(seed || ':' || gene_idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score FROM pool, (SELECT unnest([42, 123, 2026])::INTEGER AS seed)),
    {_rank('rpool', 'rr', by='seed, drug_idx')}"""
_STRUCT = f"""held AS (SELECT DISTINCT {accession_sql('pharmgkb_accession_id')} AS acc, {STRUCTURE} AS smiles FROM chemicals),
    sd AS (SELECT node_index AS drug_idx, smiles FROM nodes LEFT JOIN held ON acc = {accession_sql('node_id')} WHERE node_type = 'drug'),
    seen AS (SELECT DISTINCT smiles FROM sd WHERE smiles IS NOT NULL AND drug_idx IN (SELECT drug_idx FROM {ASSIGNED} WHERE split = 'train')),
    flags AS (SELECT drug_idx, bool_or(smiles IS NOT NULL) AS has_structure, coalesce(bool_or(smiles IN (SELECT smiles FROM seen)), false) AS seen_in_train FROM sd GROUP BY ALL)"""
_SEEDED = f"{_RAND}, {_rank('pool', 'ra')}, per AS (SELECT seed, avg(1 / ra.rank - 1 / rr.rank) AS delta, avg(1 / rr.rank) AS mrr_b FROM rr JOIN ra USING (drug_idx, gene_idx) GROUP BY seed)"

ORACLE = {
    "fdr_step_up": f"""WITH {POOL}, a AS (SELECT drug_idx, gene_idx, round(1 - score, 6) AS p FROM pool WHERE score BETWEEN 0 AND 1), r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM a)
        SELECT drug_idx, gene_idx, p, round(least(1.0, min(raw) OVER (ORDER BY p DESC)), 6) AS q FROM r""",
    "ranking_candidates": f"WITH {POOL} SELECT * FROM pool",
    "gene_degree": f"WITH {DEG} SELECT * FROM deg",
    "degree_zscore": f"WITH {DEG} SELECT gene_idx, round(coalesce((ln(1 + degree) - avg(ln(1 + degree)) OVER ()) / nullif(stddev_pop(ln(1 + degree)) OVER (), 0), 0), 6) AS z FROM deg",
    "hub_weights": f"WITH {DEG} SELECT gene_idx, round(pow(degree, 0.75) / sum(pow(degree, 0.75)) OVER (), 9) AS share, round(pow(degree, 0.75) / max(pow(degree, 0.75)) OVER (), 9) AS weight FROM deg",
    "raw_rank": f"WITH {POOL}, {_rank('pool', 'r', False)} SELECT drug_idx, gene_idx, rank FROM r",
    "filtered_rank": f"WITH {POOL}, {_rank('pool', 'r')} SELECT drug_idx, gene_idx, rank FROM r",
    "degree_rank_ordinal": f"WITH {DEG} SELECT gene_idx, degree, row_number() OVER (ORDER BY degree DESC, gene_idx) AS rank FROM deg",
    "rank_metrics": f"WITH {POOL}, {_rank('pool', 'r')} {_metrics('r')}",
    "rank_metrics_legacy": f"WITH {POOL}, {_rank('pool', 'r', False)} {_metrics('r', (1, 3, 5, 10))}",
    "random_baseline": f"WITH {_RAND} {_metrics('rr', by='seed')}",
    "degree_baseline": f"WITH {POOL}, {DEG}, {_DPOOL}, {_rank('dpool', 'r')} SELECT drug_idx, gene_idx, rank FROM r",
    "negative_pool": """WITH k AS (SELECT DISTINCT CASE WHEN source_type = 'drug' THEN source_idx ELSE target_idx END AS drug_idx, CASE WHEN source_type = 'drug' THEN target_idx ELSE source_idx END AS gene_idx FROM edges
            WHERE association = 'associated' AND ((source_type = 'drug' AND target_type = 'gene') OR (source_type = 'gene' AND target_type = 'drug'))),
        g AS (SELECT node_index AS negative_idx, row_number() OVER (ORDER BY node_index) - 1 AS li FROM nodes WHERE node_type = 'gene'),
        dr AS (SELECT drug_idx, gene_idx, attempt, ('0x' || substr(md5('42:' || drug_idx || ':' || gene_idx || ':' || attempt), 1, 8))::BIGINT % (SELECT count(*) FROM g) AS li FROM k, range(1, 17) r(attempt))
        SELECT drug_idx, gene_idx, attempt, negative_idx FROM dr JOIN g USING (li) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.drug_idx = dr.drug_idx AND k.gene_idx = g.negative_idx)
        QUALIFY row_number() OVER (PARTITION BY drug_idx, gene_idx ORDER BY attempt) <= 2""",
    "topk_candidates": f"WITH {POOL} SELECT drug_idx, gene_idx, score, known, row_number() OVER (PARTITION BY drug_idx ORDER BY score DESC, gene_idx) AS place FROM pool QUALIFY place <= 25",
    "candidate_categories": f"""WITH {POOL}, k AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY drug_idx ORDER BY score DESC, gene_idx) <= 25)
        SELECT CASE WHEN known THEN 'rediscovered' ELSE 'novel' END AS category, count(*) AS n, count(DISTINCT drug_idx) AS n_drugs FROM k GROUP BY ALL""",
    "top5_alternatives": f"""WITH {POOL}, a AS (SELECT p.drug_idx, p.gene_idx, 1 + count(*) FILTER (q.score > p.score) AS rank FROM pool p JOIN pool q USING (drug_idx) WHERE p.label = 'ambiguous' GROUP BY ALL),
        o AS (SELECT a.drug_idx, a.gene_idx, q.gene_idx AS alt, row_number() OVER (PARTITION BY a.drug_idx, a.gene_idx ORDER BY q.score DESC, q.gene_idx) AS n FROM a JOIN pool q ON q.drug_idx = a.drug_idx AND q.gene_idx <> a.gene_idx AND NOT q.known)
        SELECT a.*, coalesce((SELECT list(alt ORDER BY n) FROM o WHERE o.drug_idx = a.drug_idx AND o.gene_idx = a.gene_idx AND n <= 5), []) AS alternatives FROM a""",
    "recuration_actions": f"""WITH {POOL}, r AS (SELECT *, rank() OVER (PARTITION BY drug_idx ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY drug_idx) AS n_candidates FROM pool),
        o AS (SELECT a.drug_idx, a.gene_idx, q.gene_idx || ' (r=' || q.rank || ')' AS said, row_number() OVER (PARTITION BY a.drug_idx, a.gene_idx ORDER BY q.score DESC, q.gene_idx) AS n
            FROM r a JOIN r q ON q.drug_idx = a.drug_idx AND q.gene_idx <> a.gene_idx AND NOT q.known WHERE a.label = 'ambiguous' QUALIFY n <= 5),
        l AS (SELECT drug_idx, gene_idx, string_agg(said, '; ' ORDER BY n) AS t FROM o GROUP BY ALL)
        SELECT drug_idx, gene_idx, rank, n_candidates, round(rank / n_candidates, 6) AS rank_percentile, round(1 / rank, 6) AS priority,
            CASE WHEN rank / n_candidates <= 0.05 THEN 'upgrade_to_associated' WHEN rank / n_candidates <= 0.20 THEN 'lean_associated' WHEN rank / n_candidates >= 0.95 THEN 'downgrade_to_not_associated'
                WHEN rank / n_candidates >= 0.80 THEN 'lean_not_associated' ELSE 'remains_ambiguous' END AS action, coalesce(t, '') AS top_alternatives
        FROM r LEFT JOIN l USING (drug_idx, gene_idx) WHERE label = 'ambiguous'""",
    "modal_relation": f"SELECT relation_type, count(*) AS n FROM {ASSIGNED} WHERE split = 'train' AND source_type = 'drug' AND target_type = 'gene' GROUP BY ALL ORDER BY n DESC, relation_type LIMIT 1",
    "ambiguous_pairs": "SELECT DISTINCT source_idx, target_idx, relation_type FROM edges WHERE association_raw ILIKE '%ambiguous%' AND source_type = 'drug' AND target_type = 'gene'",
    "paired_rank_compare": f"WITH {_PAIRED} SELECT drug_idx, gene_idx, rank_a, rank_b, round(delta_rr, 6) AS delta_rr, outcome FROM paired",
    "win_tie_loss": f"WITH {_PAIRED} SELECT {_SUM} FROM paired",
    "degree_group": f"WITH {DEG} SELECT CASE WHEN degree = 0 THEN '0' WHEN degree <= 2 THEN '1-2' WHEN degree <= 9 THEN '3-9' ELSE '10+' END AS degree_group, count(*) AS n_genes FROM deg GROUP BY ALL",
    "degree_group_summary": f"WITH {_PAIRED} SELECT CASE WHEN degree = 0 THEN '0' WHEN degree <= 2 THEN '1-2' WHEN degree <= 9 THEN '3-9' ELSE '10+' END AS degree_group, {_SUM} FROM paired JOIN deg USING (gene_idx) GROUP BY degree_group",
    "seed_summary": f"""WITH {_SEEDED} SELECT count(*) AS n_seeds, round(avg(delta), 6) AS mean_delta, round(stddev_samp(delta), 6) AS sd_delta, count(*) FILTER (delta > 0) AS n_positive, round(avg(mrr_b), 6) AS mean_mrr_b,
        round(stddev_samp(mrr_b), 6) AS sd_mrr_b FROM per""",
    "structure_clean": f"WITH {_STRUCT} SELECT * FROM flags",
    "subset_metrics": f"""WITH {POOL}, {_rank('pool', 'r')}, {_STRUCT}, m AS (SELECT r.*, coalesce(has_structure, false) AS h, seen_in_train FROM r LEFT JOIN flags USING (drug_idx)),
        u AS (SELECT 'all' AS subset, rank FROM m UNION ALL SELECT CASE WHEN h THEN 'with_structure' ELSE 'without_structure' END, rank FROM m UNION ALL SELECT 'structure_clean', rank FROM m WHERE h AND NOT seen_in_train) {_metrics('u', by='subset')}""",
    "calibration_grid": f"""WITH {POOL}, {DEG}, zd AS (SELECT gene_idx, coalesce((ln(1 + degree) - avg(ln(1 + degree)) OVER ()) / nullif(stddev_pop(ln(1 + degree)) OVER (), 0), 0) AS zd FROM deg),
        g AS (SELECT i - 1 AS position, a[i] AS alpha FROM (SELECT {list(rk.ALPHAS)}::DOUBLE[] AS a), range(1, 18) r(i)),
        cpool AS (SELECT position, alpha, drug_idx, gene_idx, known, round(z + alpha * zd, 6) AS score FROM (SELECT *, coalesce((score - avg(score) OVER d) / nullif(stddev_pop(score) OVER d, 0), 0) AS z FROM pool WINDOW d AS (PARTITION BY drug_idx)) JOIN zd USING (gene_idx), g),
        {_rank('cpool', 'r', by='position, alpha, drug_idx')}, m AS (SELECT position, alpha, round(avg(1 / rank), 6) AS mrr FROM r GROUP BY ALL)
        SELECT alpha, position, mrr, row_number() OVER (ORDER BY mrr DESC, abs(alpha), position) = 1 AS chosen FROM m""",
    "early_stopping": """WITH h AS (SELECT event_type AS run, dayofyear(ts) AS epoch, round(avg(value), 6) AS metric FROM events GROUP BY ALL),
        a AS (SELECT *, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, row_number() OVER (PARTITION BY run ORDER BY epoch) AS place FROM h),
        b AS (SELECT *, place - max(CASE WHEN improved THEN place END) OVER (PARTITION BY run ORDER BY epoch) AS waited FROM a)
        SELECT run, epoch, metric, improved, waited, bool_or(waited >= 3) OVER (PARTITION BY run ORDER BY epoch) AS stopped FROM b""",
    "prefix_share": f"WITH {POOL} SELECT count(*) AS n, round(avg((upper(node_name) LIKE 'X%')::INT), 6) AS share FROM pool JOIN nodes ON node_index = gene_idx WHERE known",
}
