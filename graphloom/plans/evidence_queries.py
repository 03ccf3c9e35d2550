"""Queries over paths, propagation, enrichment, integrated evidence and message passing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.gnn import layers as gnn
from graphloom.operators import evidence as ev
from graphloom.operators import graph_build as gb
from graphloom.operators import paths, ranking, stats
from graphloom.plans.graph_queries import clean
from graphloom.session import cut_lineage
from graphloom.session import read_table as t

# Fixed example weights of the layers: small, so that SQL can state them too.
W = [[0.5, -0.2, 0.1, 0.0], [0.3, 0.4, -0.1, 0.2], [-0.3, 0.1, 0.6, 0.1], [0.2, 0.0, 0.3, -0.4]]
BASES = [[[((b * 31 + i * 7 + j * 13) % 11 - 5) / 10 for j in range(4)] for i in range(4)] for b in range(2)]
ATT_SRC, ATT_DST, RELATION = [0.4, -0.3, 0.2, 0.1], [-0.2, 0.5, 0.1, 0.3], [1.0, -0.5, 0.25, 2.0]


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Ambiguous scored pairs: the ones an explanation is asked for."""
    return cut_lineage(ranking.candidates(t(s, d, "test_pairs")).filter("label = 'ambiguous'").select("drug_idx", "gene_idx"))


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    return cut_lineage(paths.symmetric(t(s, d, "edges")))


def _degrees(s: SparkSession, d: str) -> DataFrame:
    return gb.simple_degree(gb.undirected_edges(t(s, d, "edges")))


def _shared(s: SparkSession, d: str) -> DataFrame:
    return paths.shared_by_type(_neighbours(s, d), _asked(s, d), t(s, d, "nodes"), _degrees(s, d), ["gene", "variant", "phenotype"])


def _top(s: SparkSession, d: str) -> DataFrame:
    return ranking.top_candidates(ranking.candidates(t(s, d, "test_pairs")))


def _propagated(s: SparkSession, d: str) -> DataFrame:
    return ev.propagate(_top(s, d), t(s, d, "edges"))


def _sampled(s: SparkSession, d: str) -> DataFrame:
    return _propagated(s, d).filter("evidence = 'guideline' AND NOT is_negative AND NOT is_ambiguous").orderBy("drug_idx", "gene_idx", "phenotype_idx").limit(5)


def _enriched(s: SparkSession, d: str) -> DataFrame:
    hits = ranking.candidates(t(s, d, "test_pairs")).filter("known").select("gene_idx")
    universe = t(s, d, "nodes").filter("node_type = 'gene'").agg(F.count(F.lit(1)).alias("n_universe"))
    return stats.enrichment(ev.gene_sets(t(s, d, "edges")), hits, universe)


def _flagged(s: SparkSession, d: str) -> DataFrame:
    hits = ev.gene_pathway_hits(ev.gene_sets(t(s, d, "edges")), _enriched(s, d))
    return _top(s, d).join(hits.select("gene_idx").distinct(), "gene_idx", "left_semi").select("drug_idx", "gene_idx")


def _integrated(s: SparkSession, d: str) -> DataFrame:
    edges = t(s, d, "edges")
    hits = ev.gene_pathway_hits(ev.gene_sets(edges), _enriched(s, d))
    return ev.integrated_scores(_top(s, d), ev.literature_counts(edges), hits)


def _predicted(s: SparkSession, d: str) -> DataFrame:
    """The 50 predictions to be explained: unknown candidates by place, then by drug; a top-k report."""
    return _top(s, d).filter("NOT known").orderBy("place", "drug_idx", "gene_idx").limit(50).select("drug_idx", "gene_idx")


def _explanations(s: SparkSession, d: str) -> DataFrame:
    return paths.explain_pairs(_neighbours(s, d), lambda links: gb.pair_relation(t(s, d, "edges"), links), t(s, d, "nodes"), _degrees(s, d), _predicted(s, d))


def _explained(s: SparkSession, d: str) -> DataFrame:
    edges = t(s, d, "edges")
    hits = ev.gene_pathway_hits(ev.gene_sets(edges), _enriched(s, d))
    articles = ev.literature_rows(edges).select("drug_idx", "gene_idx", *[F.col(c) if c == "pmid" else F.lit(None).cast("string").alias(c) for c in ev.ARTICLE])
    return ev.integrated_explanations(_integrated(s, d), _explanations(s, d), hits, articles, t(s, d, "nodes"))


def literature_search(s: SparkSession, d: str) -> DataFrame:
    """Documents published from 2015 on that name both ends of a scored pair."""
    names = t(s, d, "nodes").select(F.col("node_index").alias("node"), tx.clean_text("node_name").alias("name"))
    articles = t(s, d, "documents").select(F.col("doc_id").alias("article_id"), "text", F.year("published_at").alias("year"))
    return ev.find_articles(ranking.candidates(t(s, d, "test_pairs")).select("drug_idx", "gene_idx"), names, articles, 2015)


def article_digest(s: SparkSession, d: str) -> DataFrame:
    """Abstracts as articles of their drug, with citations and first sentences."""
    year = F.year("published_at").cast("string")
    articles = t(s, d, "documents").filter("doc_kind = 'abstract' AND drug_idx IS NOT NULL").select(
        "drug_idx", F.lit(0).cast("bigint").alias("gene_idx"), F.col("doc_id").cast("string").alias("pmid"), "title", F.col("source").alias("journal"), year.alias("year"),
        F.concat_ws("; ", "lang", "source").alias("authors"), F.lit("").alias("doi"), F.lit("").alias("url"), F.col("text").alias("abstract"),
    )
    return ev.article_lists(articles).drop("gene_idx")


def _graph(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "edges").filter("source_idx IS NOT NULL AND target_idx IS NOT NULL").select(F.col("source_idx").alias("src"), F.col("target_idx").alias("dst"), F.col("rel_idx").alias("rel"))


def _features(s: SparkSession, d: str) -> DataFrame:
    i = F.col("node_index")
    return t(s, d, "nodes").select(i.alias("node"), F.array(*[((i * k) % m / float(m)) for k, m in ((1, 7), (3, 11), (5, 13), (2, 17))]).alias("x"))


def _coefficients(s: SparkSession, d: str) -> DataFrame:
    r = F.col("rel")
    return _graph(s, d).select("rel").distinct().select("rel", F.array(*[((r * 7 + b * 3) % 5 - 2) / 2.0 for b in range(2)]).alias("a"))


def _columns(df: DataFrame) -> DataFrame:
    return df.select("node", *[F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(4)])


QUERIES = {
    "khop_distances": lambda s, d: paths.khop(_neighbours(s, d), _asked(s, d).select(F.col("drug_idx").alias("source")), 4),
    "shortest_paths": lambda s, d: paths.all_shortest_paths(_neighbours(s, d), _asked(s, d)),
    "shared_khop": _shared,
    "explanations": _explanations,
    "phenotype_one_hop": lambda s, d: ev.phenotype_one_hop(t(s, d, "edges")),
    "phenotype_two_hop": lambda s, d: ev.phenotype_two_hop(t(s, d, "edges")),
    "phenotype_propagation": lambda s, d: _propagated(s, d),
    "propagation_sample": lambda s, d: _sampled(s, d),
    "evidence_polarity": lambda s, d: ev.evidence_polarity(_propagated(s, d)),
    "literature_evidence": lambda s, d: ev.literature_rows(t(s, d, "edges")),
    "literature_counts": lambda s, d: ev.literature_counts(t(s, d, "edges")),
    "gene_set_explode": lambda s, d: t(s, d, "relationships").select("rel_id", F.explode(tx.split_symbols("pmids", r"[;,]")).alias("symbol")),
    "ora_enrichment": lambda s, d: _enriched(s, d).select("source", "set_id", "set_size", "overlap", *[F.round(c, 6).alias(c) for c in ("fold", "p", "q")], "significant"),
    "ora_by_source": lambda s, d: _enriched(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_sets"), F.count_if(F.col("significant")).alias("n_significant"), F.round(F.min("q"), 6).alias("least_q")),
    "gene_pathway_hits": lambda s, d: ev.gene_pathway_hits(ev.gene_sets(t(s, d, "edges")), _enriched(s, d)).drop("q"),
    "pathway_flag": lambda s, d: _flagged(s, d),
    "integrated_scores": lambda s, d: _integrated(s, d).drop("score", "hub_adjusted", "literature_signal"),
    "integrated_explanations": _explained,
    "pubdate_year": lambda s, d: t(s, d, "orders").select(tx.year_token(F.date_format("o_orderdate", "yyyy MMM d")).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n")),
    "article_digest": article_digest,
    "literature_search": literature_search,
    "first_sentence": lambda s, d: t(s, d, "documents").select("doc_id", tx.first_sentence("text").alias("sentence")),
    "gcn_layer": lambda s, d: _columns(gnn.gcn_layer(_graph(s, d), _features(s, d), W)),
    "rgcn_layer": lambda s, d: _columns(gnn.rgcn_layer(_graph(s, d), _features(s, d), _coefficients(s, d), BASES, W)),
    "rgat_layer": lambda s, d: _columns(gnn.rgat_layer(_graph(s, d), _features(s, d), W, ATT_SRC, ATT_DST, _coefficients(s, d).select("rel", F.col("a")[0].alias("bias")))),
    "distmult_scores": lambda s, d: gnn.distmult(t(s, d, "test_pairs").filter("drug_idx IS NOT NULL AND gene_idx IS NOT NULL").distinct(), _features(s, d), RELATION).distinct().withColumn("score", F.round("score", 6)),
    "relation_importance": lambda s, d: gnn.relation_importance(_coefficients(s, d), BASES).withColumn("norm", F.round("norm", 6)).orderBy(F.desc("norm"), "rel").limit(15),
}

_POOL = """pool AS (SELECT drug_idx, gene_idx, max(score) AS score, coalesce(bool_or(association = 'associated'), false) AS known, max(association) AS label FROM test_pairs
    WHERE drug_idx IS NOT NULL AND gene_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
    asked AS (SELECT drug_idx, gene_idx FROM pool WHERE label = 'ambiguous'),
    top AS (SELECT *, row_number() OVER (PARTITION BY drug_idx ORDER BY score DESC, gene_idx) AS place FROM pool QUALIFY place <= 25)"""
_SYM = """sym AS (SELECT DISTINCT u, v FROM (SELECT source_idx AS u, target_idx AS v FROM edges UNION ALL SELECT target_idx, source_idx FROM edges) WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v)"""


def _ball(source: str, p: str, hops: int) -> str:
    """Levels p0, p1, ... of a search from sources, and p with all; a neighbour of a level lies in the one before, in it or in the next."""
    levels = [f"{p}0 AS MATERIALIZED (SELECT DISTINCT source, source AS node, 0 AS distance, 1::BIGINT AS n_paths FROM ({source}))"]
    for k in range(1, hops + 1):
        met = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {p}{j} x WHERE x.source = b.source AND x.node = v)" for j in (k - 1, k - 2) if j >= 0)
        levels.append(f"{p}{k} AS MATERIALIZED (SELECT source, v AS node, {k} AS distance, sum(n_paths)::BIGINT AS n_paths FROM {p}{k - 1} b JOIN sym ON u = node WHERE true {met} GROUP BY source, v)")
    return ", ".join(levels) + f", {p} AS (" + " UNION ALL ".join(f"SELECT source, node, distance::BIGINT AS distance, n_paths FROM {p}{k}" for k in range(hops + 1)) + ")"


def _btw(a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN source_type = '{a}' THEN source_idx ELSE target_idx END AS {a}_idx, CASE WHEN source_type = '{a}' THEN target_idx ELSE source_idx END AS {b}_idx, relation_type, evidence, association, pmids
        FROM edges WHERE (source_type = '{a}' AND target_type = '{b}') OR (source_type = '{b}' AND target_type = '{a}'))"""


_ONE = f"one AS (SELECT DISTINCT gene_idx, phenotype_idx, relation_type, evidence, association, 1::BIGINT AS hops, NULL::BIGINT AS via_variant_idx FROM {_btw('gene', 'phenotype')})"
_TWO = f"""two AS (SELECT DISTINCT gene_idx, phenotype_idx, p.relation_type, p.evidence, p.association, 2::BIGINT AS hops, variant_idx AS via_variant_idx
    FROM (SELECT DISTINCT gene_idx, variant_idx FROM {_btw('gene', 'variant')}) g JOIN {_btw('variant', 'phenotype')} p USING (variant_idx))"""
_PROP = f"""{_POOL}, {_ONE}, {_TWO}, prop AS (SELECT drug_idx, gene_idx, phenotype_idx, evidence, hops, via_variant_idx, relation_type, association, coalesce(association = 'not_associated', false) AS is_negative, coalesce(association = 'ambiguous', false) AS is_ambiguous
    FROM top JOIN (FROM one UNION ALL BY NAME FROM two) USING (gene_idx) QUALIFY row_number() OVER (PARTITION BY drug_idx, gene_idx, phenotype_idx, evidence ORDER BY hops, via_variant_idx, relation_type, association) = 1)"""
_ART = f"""art AS (SELECT DISTINCT drug_idx, gene_idx, pmid FROM (SELECT drug_idx, gene_idx, unnest(CASE WHEN len(a) = 0 OR a IS NULL THEN [NULL] ELSE a END) AS pmid
    FROM (SELECT drug_idx, gene_idx, list_filter(regexp_split_to_array(pmids, '[;,|\\s]+'), lambda x: x <> '') AS a FROM {_btw('drug', 'gene')})))"""
_SETS = f"sets AS (SELECT DISTINCT evidence AS source, phenotype_idx AS set_id, gene_idx FROM {_btw('gene', 'phenotype')})"
_LC = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)"


def _lc(n: str, k: str) -> str:
    return "(" + _LC.format(n=n, k=k) + ")"


_ORA = f"""{_POOL}, {_SETS}, hits AS (SELECT DISTINCT gene_idx FROM pool WHERE known), c AS (SELECT source, set_id, count(*) AS set_size, count(h.gene_idx) AS overlap FROM sets LEFT JOIN hits h USING (gene_idx) GROUP BY ALL),
    f AS (SELECT *, (SELECT count(*) FROM hits) AS n_hits, (SELECT count(*) FROM nodes WHERE node_type = 'gene') AS n_universe FROM c),
    p AS (SELECT f.*, CASE WHEN overlap = 0 THEN 1.0 ELSE (SELECT sum(exp({_lc('set_size', 'i')} + {_lc('n_universe - set_size', 'n_hits - i')} - {_lc('n_universe', 'n_hits')})) FROM range(overlap, least(n_hits, set_size) + 1) r(i)) END::DOUBLE AS p,
        coalesce(overlap / nullif(n_hits * set_size / n_universe, 0), 0)::DOUBLE AS fold FROM f),
    k AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY round(p, 14)) + count(*) OVER (PARTITION BY source, round(p, 14)) - 1 AS r, count(*) OVER (PARTITION BY source) AS m FROM p),
    ora AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY source ORDER BY round(p, 14) DESC, r)) AS q FROM k)"""
_GPH = "gph AS (SELECT gene_idx, source, set_id, round(q, 12) AS q, row_number() OVER (PARTITION BY gene_idx ORDER BY round(q, 12), source, set_id) AS place FROM sets JOIN ora USING (source, set_id) WHERE q < 0.05 QUALIFY place <= 5)"
_X = """xs AS (SELECT node_index AS node, (node_index * 1) % 7 / 7.0::DOUBLE AS a0, (node_index * 3) % 11 / 11.0::DOUBLE AS a1, (node_index * 5) % 13 / 13.0::DOUBLE AS a2, (node_index * 2) % 17 / 17.0::DOUBLE AS a3 FROM nodes),
    g AS (SELECT source_idx AS src, target_idx AS dst, rel_idx AS rel FROM edges WHERE source_idx IS NOT NULL AND target_idx IS NOT NULL)"""


def _mul(prefix: str, w: list) -> list[str]:
    return ["(" + " + ".join(f"{prefix}{i} * ({w[i][j]})" for i in range(4)) + ")" for j in range(4)]


_GCN = f"""WITH {_X}, dg AS (SELECT node, 1 / sqrt(1 + count(dst)) AS r FROM xs LEFT JOIN g ON dst = node GROUP BY node),
    s AS (SELECT dst AS node, {', '.join(f'sum(r * a{i}) AS s{i}' for i in range(4))} FROM g JOIN xs ON src = xs.node JOIN dg ON dg.node = src GROUP BY dst),
    h AS (SELECT xs.node, {', '.join(f'(coalesce(s{i}, 0) + a{i} * r) * r AS h{i}' for i in range(4))} FROM xs JOIN dg USING (node) LEFT JOIN s USING (node))
    SELECT node, {', '.join(f'round(greatest({e}, 0), 6) AS x{j}' for j, e in enumerate(_mul('h', W)))} FROM h"""
_RGCN = f"""WITH {_X}, m AS (SELECT dst AS node, rel, {', '.join(f'avg(a{i}) AS m{i}' for i in range(4))} FROM g JOIN xs ON xs.node = src GROUP BY ALL),
    mix AS (SELECT node, {', '.join(f'sum(((rel * 7 + {b} * 3) % 5 - 2) / 2.0::DOUBLE * m{i}) AS t{b}_{i}' for b in range(2) for i in range(4))} FROM m GROUP BY node),
    j AS (SELECT xs.*, {', '.join(f'coalesce(t{b}_{i}, 0) AS t{b}_{i}' for b in range(2) for i in range(4))} FROM xs LEFT JOIN mix USING (node))
    SELECT node, {', '.join(f"round(greatest({_mul('a', W)[j]} + {_mul('t0_', BASES[0])[j]} + {_mul('t1_', BASES[1])[j]}, 0), 6) AS x{j}" for j in range(4))} FROM j"""
_RGAT = f"""WITH {_X}, y AS (SELECT node, {', '.join(f'{e} AS y{j}' for j, e in enumerate(_mul('a', W)))} FROM xs),
    l AS (SELECT node, y0, y1, y2, y3, {' + '.join(f'y{i} * ({v})' for i, v in enumerate(ATT_SRC))} AS ls, {' + '.join(f'y{i} * ({v})' for i, v in enumerate(ATT_DST))} AS ld FROM y),
    e AS (SELECT dst AS node, a.y0, a.y1, a.y2, a.y3, a.ls + b.ld + (rel * 7 % 5 - 2) / 2.0::DOUBLE AS z FROM g JOIN l a ON a.node = src JOIN l b ON b.node = dst),
    k AS (SELECT *, exp(CASE WHEN z > 0 THEN z ELSE z * 0.2 END) AS q FROM e), o AS (SELECT node, {', '.join(f'sum(q * y{i}) / sum(q) AS o{i}' for i in range(4))} FROM k GROUP BY node)
    SELECT node, {', '.join(f'round(greatest(coalesce(o{i}, 0), 0), 6) AS x{i}' for i in range(4))} FROM xs LEFT JOIN o USING (node)"""
_CELLS = " + ".join("pow(" + " + ".join(f"((rel * 7 + {b} * 3) % 5 - 2) / 2.0::DOUBLE * ({BASES[b][i][j]})" for b in range(2)) + ", 2)" for i in range(4) for j in range(4))

_NAMES = f"names AS (SELECT node_index AS node, coalesce({clean('node_name')}, node_index::VARCHAR) AS name, node_type FROM nodes)"
_DEGREE = """und AS (SELECT DISTINCT least(source_idx, target_idx) AS a, greatest(source_idx, target_idx) AS b FROM edges WHERE source_idx IS NOT NULL AND target_idx IS NOT NULL),
    dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM und UNION ALL SELECT b FROM und) GROUP BY ALL)"""
_SHARED = """shared AS (SELECT drug_idx, gene_idx, node_type, a.node, a.distance AS drug_distance, c.distance AS gene_distance, a.distance + c.distance AS distance, degree,
        row_number() OVER (PARTITION BY drug_idx, gene_idx, node_type ORDER BY a.distance + c.distance, degree DESC, a.node) AS place
    FROM {pairs} JOIN b a ON a.source = drug_idx AND a.distance <= 4 JOIN b c ON c.source = gene_idx AND c.node = a.node AND c.distance <= 4 JOIN nodes ON node_index = a.node JOIN dg ON dg.node = a.node
    WHERE node_type IN ('gene', 'variant', 'phenotype') AND a.node <> drug_idx AND a.node <> gene_idx QUALIFY place <= 10)"""
_EXPLAIN = f"""{_POOL}, {_SYM}, {_DEGREE}, {_NAMES}, said AS (SELECT drug_idx, gene_idx FROM top WHERE NOT known ORDER BY place, drug_idx, gene_idx LIMIT 50),
    {_ball('SELECT unnest([drug_idx, gene_idx]) AS source FROM said', 'b', 9)}, {_SHARED.format(pairs='said')},
    rel AS (SELECT u, v, arg_max(relation_type, edge_index) AS r FROM (SELECT source_idx AS u, target_idx AS v, relation_type, edge_index FROM edges UNION ALL SELECT target_idx, source_idx, relation_type, edge_index FROM edges)
        WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
    walk AS (
        SELECT drug_idx, gene_idx, gene_idx AS node, distance, [gene_idx] AS back FROM said JOIN b ON source = drug_idx AND node = gene_idx
        UNION ALL SELECT w.drug_idx, w.gene_idx, v, b.distance, list_append(back, v) FROM walk w JOIN sym ON u = w.node JOIN b ON b.source = w.drug_idx AND b.node = v AND b.distance = w.distance - 1),
    p3 AS (SELECT drug_idx, gene_idx, list_reverse(back) AS p, row_number() OVER (PARTITION BY drug_idx, gene_idx ORDER BY back) AS place FROM walk WHERE distance = 0 QUALIFY place <= 3),
    steps AS (SELECT drug_idx, gene_idx, place, i, p[i] AS node, p[i + 1] AS following FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p3)),
    txt AS (SELECT drug_idx, gene_idx, place, string_agg(coalesce(name, s.node::VARCHAR) || '[' || coalesce(node_type, '?') || ']', ' -> ' ORDER BY i) AS t, string_agg(coalesce(r, 'unknown'), ' | ' ORDER BY i) FILTER (following IS NOT NULL) AS r
        FROM steps s LEFT JOIN names USING (node) LEFT JOIN rel ON u = s.node AND v = following GROUP BY ALL),
    pt AS (SELECT drug_idx, gene_idx, count(*) AS n, string_agg(t, ' || ' ORDER BY place) AS t, string_agg(r, ' || ' ORDER BY place) AS r FROM txt GROUP BY ALL),
    lst AS (SELECT drug_idx, gene_idx, node_type, count(*) AS n, string_agg(name || '(d=' || drug_distance || ',g=' || gene_distance || ')', '; ' ORDER BY place) AS t FROM shared JOIN (SELECT node, name FROM names) USING (node) GROUP BY ALL),
    explained AS (SELECT drug_idx, gene_idx, b.distance AS shortest_path_length, coalesce(pt.n, 0) AS n_shortest_paths, coalesce(pt.t, '') AS shortest_paths, coalesce(pt.r, '') AS shortest_path_relations,
        {', '.join(f"coalesce({k}.t, '') AS shared_{k}s_within_khop, coalesce({k}.n, 0) AS n_shared_{k}s" for k in ('gene', 'variant', 'phenotype'))}, dn.name AS drug_name, gn.name AS gene_name
        FROM said LEFT JOIN b ON source = drug_idx AND node = gene_idx LEFT JOIN pt USING (drug_idx, gene_idx)
        {' '.join(f"LEFT JOIN (SELECT * FROM lst WHERE node_type = '{k}') {k} USING (drug_idx, gene_idx)" for k in ('gene', 'variant', 'phenotype'))}
        JOIN names dn ON dn.node = drug_idx JOIN names gn ON gn.node = gene_idx)"""

ORACLE = {
    "khop_distances": f"WITH {_POOL}, {_SYM}, {_ball('SELECT drug_idx AS source FROM asked', 'b', 4)} SELECT * FROM b",
    "shortest_paths": f"""WITH {_POOL}, {_SYM}, {_ball('SELECT drug_idx AS source FROM asked', 'b', 9)}
        SELECT drug_idx, gene_idx, distance AS length, coalesce(n_paths, 0)::BIGINT AS n_paths FROM asked LEFT JOIN b ON source = drug_idx AND node = gene_idx""",
    "shared_khop": f"""WITH {_POOL}, {_SYM}, {_DEGREE}, {_ball('SELECT unnest([drug_idx, gene_idx]) AS source FROM asked', 'b', 4)}, {_SHARED.format(pairs='asked')} SELECT * FROM shared""",
    "explanations": f"WITH RECURSIVE {_EXPLAIN} SELECT * FROM explained",
    "integrated_explanations": f"""WITH RECURSIVE {_ORA}, {_GPH}, {_ART}, {_EXPLAIN.replace(_POOL + ",", "", 1)}, n AS (SELECT drug_idx, gene_idx, count(pmid) AS n_articles, list_sort(list(pmid) FILTER (pmid IS NOT NULL)) AS ids FROM art GROUP BY ALL),
        sc AS (SELECT drug_idx, gene_idx, place, score, coalesce(n_articles, 0) AS n_articles, ids, (gene_idx IN (SELECT gene_idx FROM gph))::INT::DOUBLE AS pathway_signal, (1 / place) / max(1 / place) OVER () AS h,
            coalesce(ln(1 + coalesce(n_articles, 0)) / nullif(max(ln(1 + coalesce(n_articles, 0))) OVER (), 0), 0) AS l FROM top LEFT JOIN n USING (drug_idx, gene_idx)),
        best AS (SELECT *, round(0.4 * h + 0.3 * l + 0.3 * pathway_signal, 6) AS integrated_score FROM sc ORDER BY integrated_score DESC, drug_idx, gene_idx LIMIT 50),
        hs AS (SELECT gene_idx, list(source || '::' || set_id ORDER BY place) AS names, list(source || '::' || set_id || printf(' (q=%.2e)', q) ORDER BY place) AS said FROM gph GROUP BY gene_idx),
        j AS (SELECT b.*, dn.name AS drug_name, gn.name AS gene_name, e.shortest_path_length, coalesce(e.shortest_paths, '') AS shortest_paths, coalesce(e.shortest_path_relations, '') AS shortest_path_relations,
            coalesce(e.shared_genes_within_khop, '') AS shared_genes_within_khop, coalesce(e.n_shared_genes, 0) AS n_shared_genes, coalesce(e.n_shared_variants, 0) AS n_shared_variants, coalesce(e.n_shared_phenotypes, 0) AS n_shared_phenotypes,
            coalesce(len(hs.names), 0) AS n_sets, coalesce(array_to_string(hs.said, '; '), '') AS top_pathway_hits, array_to_string(hs.names[1:2], ', ') AS first_sets
            FROM best b JOIN names dn ON dn.node = b.drug_idx JOIN names gn ON gn.node = b.gene_idx LEFT JOIN explained e USING (drug_idx, gene_idx) LEFT JOIN hs USING (gene_idx))
        SELECT drug_idx, gene_idx, drug_name, gene_name, place AS model_rank, score AS model_score, round(h, 6) AS hub_adjusted, round(l, 6) AS literature_signal, pathway_signal, integrated_score, n_articles,
            CASE WHEN n_articles = 0 THEN 'No articles found for this pair.' ELSE array_to_string([format('[{{}}] Unknown authors (n.d.).  . PMID:{{}}. ', i, ids[i]) for i in range(1, len(ids) + 1)], chr(10)) END AS literature_citations, '' AS abstract_summary,
            n_sets AS n_significant_pathways_for_gene, top_pathway_hits, shortest_path_length, shortest_paths, shortest_path_relations, shared_genes_within_khop, n_shared_genes, n_shared_variants, n_shared_phenotypes,
            drug_name || ' and ' || gene_name || printf(': integrated score %.3f; ', integrated_score) || CASE WHEN shortest_path_length IS NULL THEN 'no path in the graph' ELSE 'connected by ' || shortest_path_length || ' steps' END || '; '
            || CASE WHEN n_articles > 0 THEN n_articles || ' articles name both' ELSE 'no article names both' END || CASE WHEN n_sets > 0 THEN '; the gene is in ' || n_sets || ' significant sets, among them ' || first_sets ELSE '' END
            || CASE WHEN n_shared_genes + n_shared_variants + n_shared_phenotypes > 0 THEN '; they share ' || n_shared_genes || ' genes, ' || n_shared_variants || ' variants and ' || n_shared_phenotypes || ' phenotypes' ELSE '' END || '.' AS explanation
        FROM j""",
    "literature_search": f"""WITH {_POOL}, {_NAMES.replace("coalesce(" + clean('node_name') + ", node_index::VARCHAR)", clean('node_name'))},
        n AS (SELECT node, ' ' || trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') || ' ' AS said FROM names WHERE node IN (SELECT unnest([drug_idx, gene_idx]) FROM pool)),
        a AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') || ' ' AS body FROM documents WHERE year(published_at) >= 2015),
        m AS (SELECT DISTINCT doc_id, node FROM a JOIN n ON contains(body, said) WHERE trim(said, ' ') <> '')
        SELECT drug_idx, gene_idx, x.doc_id AS article_id FROM pool JOIN m x ON x.node = drug_idx JOIN m y ON y.node = gene_idx AND y.doc_id = x.doc_id""",
    "article_digest": r"""WITH a AS (SELECT drug_idx, doc_id::VARCHAR AS pmid, coalesce(title, '') AS title, coalesce(source, '') AS journal, coalesce(year(published_at)::VARCHAR, '') AS y, list_filter([lang, source], lambda x: x <> '') AS who, trim(coalesce(text, ''), ' ') AS abs
            FROM documents WHERE doc_kind = 'abstract' AND drug_idx IS NOT NULL),
        b AS (SELECT *, row_number() OVER (PARTITION BY drug_idx ORDER BY pmid, title, journal, y, array_to_string(who, '; '), abs) AS i, regexp_extract(abs, '(?s)^(.*?\.)\s+\p{Lu}', 1) AS f FROM a)
        SELECT drug_idx, count(*) AS n_articles,
            string_agg('[' || i || '] ' || CASE len(who) WHEN 0 THEN 'Unknown authors' WHEN 1 THEN who[1] ELSE who[1] || ' et al.' END || ' (' || CASE WHEN y = '' THEN 'n.d.' ELSE y END || '). ' || title || ' ' || journal || '. PMID:' || pmid || '. ', chr(10) ORDER BY i) AS literature_citations,
            coalesce(string_agg('[' || i || '] ' || CASE WHEN f = '' THEN abs ELSE f END, chr(10) ORDER BY i) FILTER (abs <> ''), '') AS abstract_summary
        FROM b GROUP BY drug_idx""",
    "first_sentence": r"""SELECT doc_id, CASE WHEN regexp_extract(text, '(?s)^(.*?\.)\s+\p{Lu}', 1) = '' THEN text ELSE regexp_extract(text, '(?s)^(.*?\.)\s+\p{Lu}', 1) END AS sentence FROM documents""",
    "phenotype_one_hop": f"WITH {_ONE} SELECT * FROM one",
    "phenotype_two_hop": f"WITH {_TWO} SELECT * FROM two",
    "phenotype_propagation": f"WITH {_PROP} SELECT * FROM prop",
    "propagation_sample": f"WITH {_PROP} SELECT * FROM prop WHERE evidence = 'guideline' AND NOT is_negative AND NOT is_ambiguous ORDER BY drug_idx, gene_idx, phenotype_idx LIMIT 5",
    "evidence_polarity": f"""WITH {_PROP} SELECT evidence, priority, count(drug_idx) FILTER (NOT is_negative AND NOT is_ambiguous) AS positive, count(drug_idx) FILTER (is_ambiguous) AS ambiguous, count(drug_idx) FILTER (is_negative) AS negative
        FROM (VALUES ('guideline', 1::BIGINT), ('label', 2), ('clinical', 3), ('literature', 4), ('pathway', 5), ('other', 6)) v(evidence, priority) LEFT JOIN prop USING (evidence) GROUP BY ALL""",
    "literature_evidence": f"WITH {_ART} SELECT * FROM art",
    "literature_counts": f"WITH {_ART} SELECT drug_idx, gene_idx, count(pmid) AS n_articles FROM art GROUP BY ALL",
    "gene_set_explode": r"SELECT DISTINCT rel_id, symbol FROM (SELECT rel_id, upper(trim(unnest(regexp_split_to_array(pmids, '[;,]')), ' ')) AS symbol FROM relationships) WHERE lower(symbol) NOT IN ('', 'nan', 'none', 'null')",
    "ora_enrichment": f"WITH {_ORA} SELECT source, set_id, set_size, overlap, round(fold, 6) AS fold, round(p, 6) AS p, round(q, 6) AS q, q < 0.05 AS significant FROM ora",
    "ora_by_source": f"WITH {_ORA} SELECT source, count(*) AS n_sets, count(*) FILTER (q < 0.05) AS n_significant, round(min(q), 6) AS least_q FROM ora GROUP BY ALL",
    "pathway_flag": f"WITH {_ORA}, {_GPH} SELECT drug_idx, gene_idx FROM top WHERE gene_idx IN (SELECT gene_idx FROM gph)",
    "gene_pathway_hits": f"WITH {_ORA}, {_GPH} SELECT * EXCLUDE (q) FROM gph",
    "integrated_scores": f"""WITH {_ORA}, {_GPH}, {_ART}, n AS (SELECT drug_idx, gene_idx, count(pmid) AS n_articles FROM art GROUP BY ALL),
        b AS (SELECT drug_idx, gene_idx, place, coalesce(n_articles, 0) AS n_articles, (gene_idx IN (SELECT gene_idx FROM gph))::INT::DOUBLE AS pathway FROM top LEFT JOIN n USING (drug_idx, gene_idx))
        SELECT *, round(0.4 * (1 / place) / max(1 / place) OVER () + 0.3 * coalesce(ln(1 + n_articles) / nullif(max(ln(1 + n_articles)) OVER (), 0), 0) + 0.3 * pathway, 6) AS integrated_score FROM b""",
    "pubdate_year": "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY ALL",
    "gcn_layer": _GCN,
    "rgcn_layer": _RGCN,
    "rgat_layer": _RGAT,
    "distmult_scores": f"""WITH {_X} SELECT DISTINCT drug_idx, gene_idx, round({' + '.join(f'p.a{i} * ({r}) * q.a{i}' for i, r in enumerate(RELATION))}, 6) AS score FROM test_pairs JOIN xs p ON p.node = drug_idx JOIN xs q ON q.node = gene_idx""",
    "relation_importance": f"SELECT rel, round(sqrt({_CELLS}), 6) AS norm FROM (SELECT DISTINCT rel_idx AS rel FROM edges) ORDER BY norm DESC, rel LIMIT 15",
}
