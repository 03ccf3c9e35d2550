"""Propagation to phenotypes, literature, pathway evidence and integrated scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.session import cut_lineage


def _between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows between types a and b in either direction as (a_idx, b_idx, relation_type, evidence, association)."""
    forward = F.col("source_type") == a
    kept = edges.filter(((F.col("source_type") == a) & (F.col("target_type") == b)) | ((F.col("source_type") == b) & (F.col("target_type") == a)))
    return kept.select(
        F.when(forward, F.col("source_idx")).otherwise(F.col("target_idx")).alias(f"{a}_idx"), F.when(forward, F.col("target_idx")).otherwise(F.col("source_idx")).alias(f"{b}_idx"),
        "relation_type", "evidence", "association",
    )


def phenotype_one_hop(edges: DataFrame) -> DataFrame:
    return _between(edges, "gene", "phenotype").distinct().withColumn("hops", F.lit(1).cast("bigint")).withColumn("via_variant_idx", F.lit(None).cast("bigint"))


def phenotype_two_hop(edges: DataFrame) -> DataFrame:
    """Gene to phenotype through a variant, with the labels of the variant's row."""
    gv = _between(edges, "gene", "variant").select("gene_idx", F.col("variant_idx").alias("via_variant_idx")).distinct()
    vp = _between(edges, "variant", "phenotype").withColumnRenamed("variant_idx", "via_variant_idx").distinct()
    return gv.join(vp, "via_variant_idx").withColumn("hops", F.lit(2).cast("bigint"))


PHENOTYPES = 1_000  # of one gene in a chunk
DRUGS = 1_008  # in a block: a whole number of the runs of 504 in which parquet packs them, so that a block repeats byte by byte
LISTED = 50 * DRUGS  # drugs of a gene in one list
TASK = 20_000_000  # rows of the product in a task; partitions by what it is made of would be few


def propagate(predictions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per (drug, gene, phenotype, evidence) with the fewest hops, then the least variant, relation and label.

    Predictions (drug_idx, gene_idx) meet the phenotypes of their gene, reduced to one row per
    phenotype and evidence beforehand, so heavy genes are not multiplied by their repeats. A gene with more than
    PHENOTYPES such rows is dealt over chunks, to each of which its predictions go, so that a hub's product is not one task's.
    Its drugs go as blocks of DRUGS, and each chunk meets one block after another. A block's drugs come in the same order for each
    phenotype of the chunk: so what is stored of a row is little more than a reference to those before.
    """
    links = phenotype_one_hop(edges).unionByName(phenotype_two_hop(edges))
    first = F.min(F.struct("hops", F.coalesce("via_variant_idx", F.lit(-1).cast("bigint")).alias("v"), "relation_type", "association")).alias("m")
    asked = predictions.select("drug_idx", "gene_idx").distinct()
    best = cut_lineage(links.groupBy("gene_idx", "phenotype_idx", "evidence").agg(first))
    chunks = best.groupBy("gene_idx").agg(F.ceil(F.count(F.lit(1)) / PHENOTYPES).alias("chunks"))
    lists = asked.groupBy("gene_idx").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("lists")).join(chunks, "gene_idx")
    listed = asked.join(lists, "gene_idx").groupBy("gene_idx", "chunks", F.pmod(F.xxhash64("drug_idx"), F.col("lists")).alias("list")).agg(F.array_sort(F.collect_list(F.struct("drug_idx"))).alias("drugs"))
    cut = F.transform(F.sequence(F.lit(1), F.size("drugs"), F.lit(DRUGS)), lambda i: F.struct(i.alias("begin"), F.slice("drugs", i, DRUGS).alias("drugs")))
    blocks = cut_lineage(listed.select("gene_idx", "chunks", "list", F.inline(cut)))
    tiles = blocks.select("gene_idx", "list", "begin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "drugs")
    dealt = best.join(chunks, "gene_idx").withColumn("chunk", F.pmod(F.xxhash64("phenotype_idx", "evidence"), F.col("chunks"))).drop("chunks")
    dealt = dealt.join(blocks.select("gene_idx", "list", "begin"), "gene_idx")
    keys = ["gene_idx", "chunk", "list", "begin"]
    size = best.groupBy("gene_idx").count().join(blocks.select("gene_idx", F.size("drugs").alias("n")), "gene_idx").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
    tasks = max(int(best.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // TASK)))
    met = dealt.repartition(tasks, *keys).join(tiles.repartition(tasks, *keys).hint("merge"), keys).select("gene_idx", "phenotype_idx", "evidence", "m", F.inline("drugs"))
    return met.select(
        "drug_idx", "gene_idx", "phenotype_idx", "evidence", F.col("m.hops").alias("hops"), F.nullif(F.col("m.v"), F.lit(-1).cast("bigint")).alias("via_variant_idx"),
        F.col("m.relation_type").alias("relation_type"), F.col("m.association").alias("association"),
        (F.coalesce(F.col("m.association"), F.lit("")) == "not_associated").alias("is_negative"), (F.coalesce(F.col("m.association"), F.lit("")) == "ambiguous").alias("is_ambiguous"),
    )


def evidence_polarity(propagated: DataFrame) -> DataFrame:
    """Per evidence grade, absent ones included: positive, ambiguous and negative inferences."""
    grades = propagated.sparkSession.createDataFrame([(e, p) for e, p in tx.EVIDENCE_PRIORITY.items()], "evidence string, priority bigint")
    counts = propagated.groupBy("evidence").agg(
        F.count_if(~F.col("is_negative") & ~F.col("is_ambiguous")).alias("positive"), F.count_if(F.col("is_ambiguous")).alias("ambiguous"), F.count_if(F.col("is_negative")).alias("negative")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("positive", "ambiguous", "negative")]
    return grades.join(counts, "evidence", "left").select("evidence", "priority", *zero)


def literature_rows(edges: DataFrame) -> DataFrame:
    """(drug_idx, gene_idx, pmid): distinct articles of drug-gene rows; a pair without one has a row with a null."""
    ids = F.filter(F.transform(F.split("pmids", r"[;,|\s]+"), lambda x: F.trim(x)), lambda x: x != "")
    return _between_with(edges, "drug", "gene", F.explode_outer(ids).alias("pmid")).distinct()


def _between_with(edges: DataFrame, a: str, b: str, extra) -> DataFrame:
    forward = F.col("source_type") == a
    kept = edges.filter(((F.col("source_type") == a) & (F.col("target_type") == b)) | ((F.col("source_type") == b) & (F.col("target_type") == a)))
    return kept.select(
        F.when(forward, F.col("source_idx")).otherwise(F.col("target_idx")).alias(f"{a}_idx"), F.when(forward, F.col("target_idx")).otherwise(F.col("source_idx")).alias(f"{b}_idx"), extra
    )


def literature_counts(edges: DataFrame) -> DataFrame:
    return literature_rows(edges).groupBy("drug_idx", "gene_idx").agg(F.count("pmid").alias("n_articles"))


def gene_sets(edges: DataFrame) -> DataFrame:
    """(source, set_id, gene_idx): genes linked with a phenotype, by evidence."""
    return _between(edges, "gene", "phenotype").select(F.col("evidence").alias("source"), F.col("phenotype_idx").alias("set_id"), "gene_idx").distinct()


def gene_pathway_hits(sets: DataFrame, enriched: DataFrame, top: int = 5) -> DataFrame:
    """Per gene its ``top`` significant sets by q, then by set."""
    hit = sets.join(enriched.filter("significant").select("source", "set_id", "q"), ["source", "set_id"])
    best = Window.partitionBy("gene_idx").orderBy("q", "source", "set_id")
    return hit.withColumn("place", F.row_number().over(best).cast("bigint")).filter(F.col("place") <= top).select("gene_idx", "source", "set_id", "place", F.round("q", 12).alias("q"))


def integrated_scores(predictions: DataFrame, articles: DataFrame, flagged: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Weighted sum of reciprocal place, log article count (both scaled to a greatest of 1) and pathway flag."""
    base = (
        predictions.select("drug_idx", "gene_idx", "place", "score").join(articles, ["drug_idx", "gene_idx"], "left")
        .join(flagged.select("gene_idx").distinct().withColumn("flag", F.lit(1.0)), "gene_idx", "left")
        .select("drug_idx", "gene_idx", "place", "score", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), (1 / F.col("place")).alias("h"), F.log1p(F.coalesce("n_articles", F.lit(0)).cast("double")).alias("l"), F.coalesce("flag", F.lit(0.0)).alias("pathway"))
    )
    top = base.agg(F.max("h").alias("mh"), F.max("l").alias("ml"))
    def scaled(c: str, m: str):
        return F.coalesce(F.col(c) / F.nullif(F.col(m), F.lit(0.0)), F.lit(0.0))
    score = weights[0] * scaled("h", "mh") + weights[1] * scaled("l", "ml") + weights[2] * F.col("pathway")
    parts = [F.round(scaled("h", "mh"), 6).alias("hub_adjusted"), F.round(scaled("l", "ml"), 6).alias("literature_signal")]
    return base.crossJoin(F.broadcast(top)).select("drug_idx", "gene_idx", "place", "score", "n_articles", *parts, "pathway", F.round(score, 6).alias("integrated_score"))  # one row


def search_words(text: Column) -> Column:
    """Text as lower-case words with single spaces between and around, for searches of whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def find_articles(pairs: DataFrame, names: DataFrame, articles: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """(drug_idx, gene_idx, article_id): articles (article_id, text, year) that name both ends of a pair, as whole words in this order.

    names has (node, name). A node is looked for by the longest word of its name first, an equi-join with the distinct words
    of each article, and then by the whole name in the article's text, which is moved once; drugs and genes meet within an article before they
    are held against the pairs. So neither articles and names nor the articles and pairs of a common drug are multiplied. Names without a letter
    or digit are not found, nor are articles without year where a year is asked for.
    """
    if first_year is not None:
        articles = articles.filter(F.col("year") >= first_year)
    if last_year is not None:
        articles = articles.filter(F.col("year") <= last_year)
    wanted = pairs.select(F.explode(F.array("drug_idx", "gene_idx")).alias("node")).distinct()
    said = wanted.join(names.select("node", search_words(F.col("name")).alias("said")), "node").filter("trim(said) <> ''")
    longest = F.expr("array_max(transform(split(trim(said), ' '), w -> named_struct('n', length(w), 'w', w))).w")
    keyed = said.select("node", "said", longest.alias("word"))
    texts = articles.select("article_id", search_words(F.col("text")).alias("body"))
    words = texts.select("article_id", F.explode(F.array_distinct(F.split(F.trim("body"), " "))).alias("word"))
    looked = words.join(keyed, "word").groupBy("article_id").agg(F.collect_set(F.struct("node", "said")).alias("names"))
    met = texts.join(looked, "article_id").select("article_id", F.explode(F.filter("names", lambda x: F.contains(F.col("body"), x["said"]))["node"]).alias("node"))
    met = cut_lineage(met.distinct())
    asked = pairs.select("drug_idx", "gene_idx").distinct()
    drugs, genes = (met.withColumnRenamed("node", end).join(asked.select(end).distinct(), end, "left_semi") for end in ("drug_idx", "gene_idx"))
    return drugs.join(genes, "article_id").join(asked, ["drug_idx", "gene_idx"], "left_semi").select("drug_idx", "gene_idx", "article_id")


ARTICLE = ("pmid", "title", "journal", "year", "authors", "doi", "url", "abstract")


def article_lists(articles: DataFrame) -> DataFrame:
    """(drug_idx, gene_idx, n_articles, literature_citations, abstract_summary) of articles (drug_idx, gene_idx, pmid, title, journal,
    year, authors, doi, url, abstract), in order of pmid: one numbered line an article, and the first sentences of the abstracts.

    Articles without pmid don't count. Missing authors and years are said to be missing; other missing parts are empty.
    """
    empty = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ARTICLE}
    lists = articles.filter("pmid IS NOT NULL AND pmid <> ''").groupBy("drug_idx", "gene_idx").agg(F.array_sort(F.collect_list(F.struct(*[v.alias(c) for c, v in empty.items()]))).alias("a"))

    def line(x, i):
        who = F.when(x["authors"] == "", "Unknown authors").otherwise(tx.author_short(x["authors"]))
        year = F.when(x["year"] == "", "n.d.").otherwise(x["year"])
        doi = F.when(x["doi"] == "", "").otherwise(F.concat(F.lit(". DOI:"), x["doi"]))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), who, F.lit(" ("), year, F.lit("). "), x["title"], F.lit(" "), x["journal"], F.lit(". PMID:"), x["pmid"], doi, F.lit(". "), x["url"])

    def sentence(x, i):
        return F.when(F.trim(x["abstract"]) != "", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), tx.first_sentence(F.trim(x["abstract"]))))

    return lists.select(
        "drug_idx", "gene_idx", F.size("a").cast("bigint").alias("n_articles"), F.array_join(F.transform("a", line), "\n").alias("literature_citations"),
        F.array_join(F.array_compact(F.transform("a", sentence)), "\n").alias("abstract_summary"),
    )


def integrated_explanations(scored: DataFrame, explanations: DataFrame, hits: DataFrame, articles: DataFrame, nodes: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` integrated predictions, one row each with all their evidence.

    scored has (drug_idx, gene_idx, place, score, hub_adjusted, literature_signal, pathway, integrated_score), hits the significant sets of a gene (gene_idx,
    source, set_id, place, q), explanations what explain_pairs gives. Of several explanations of a pair, the greatest ``explained_at`` (last) counts, if
    there is such a column. A prediction without explanation, article or set has empty texts and zeros.
    """
    key = ["drug_idx", "gene_idx"]
    best = scored.orderBy(F.desc("integrated_score"), *key).limit(top)
    parts = ["shortest_path_length", "shortest_paths", "shortest_path_relations", "shared_genes_within_khop", "n_shared_genes", "n_shared_variants", "n_shared_phenotypes"]
    at = F.col("explained_at") if "explained_at" in explanations.columns else F.lit(0)
    last = explanations.groupBy(*key).agg(F.max_by(F.struct(*parts), at).alias("x")).select(*key, "x.*")
    name = F.concat_ws("::", "source", F.col("set_id").cast("string"))
    said = F.concat(name, F.format_string(" (q=%.2e)", "q"))
    sets = hits.groupBy("gene_idx").agg(F.array_sort(F.collect_list(F.struct("place", name.alias("s"), said.alias("t")))).alias("h"))
    sets = sets.select("gene_idx", F.size("h").cast("bigint").alias("n_sets"), F.array_join(F.transform("h", lambda x: x["t"]), "; ").alias("top_pathway_hits"), F.array_join(F.slice(F.transform("h", lambda x: x["s"]), 1, 2), ", ").alias("first_sets"))
    names = nodes.select("node_index", F.coalesce(tx.clean_text("node_name"), F.col("node_index").cast("string")).alias("name"))
    rows = best.drop("n_articles").join(last, key, "left").join(sets, "gene_idx", "left").join(article_lists(articles), key, "left")
    for end in ("drug", "gene"):
        rows = rows.join(names.select(F.col("node_index").alias(f"{end}_idx"), F.col("name").alias(f"{end}_name")), f"{end}_idx", "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", F.col(f"{end}_idx").cast("string")))
    rows = rows.fillna({"shortest_paths": "", "shortest_path_relations": "", "shared_genes_within_khop": "", "n_shared_genes": 0, "n_shared_variants": 0, "n_shared_phenotypes": 0, "n_sets": 0, "top_pathway_hits": "", "n_articles": 0,
                        "literature_citations": "No articles found for this pair.", "abstract_summary": ""})
    path = F.when(F.col("shortest_path_length").isNull(), "no path in the graph").otherwise(F.format_string("connected by %d steps", "shortest_path_length"))
    literature = F.when(F.col("n_articles") > 0, F.format_string("%d articles name both", "n_articles")).otherwise("no article names both")
    pathways = F.when(F.col("n_sets") > 0, F.format_string("; the gene is in %d significant sets, among them %s", "n_sets", "first_sets")).otherwise("")
    shared = F.when(F.col("n_shared_genes") + F.col("n_shared_variants") + F.col("n_shared_phenotypes") > 0, F.format_string("; they share %d genes, %d variants and %d phenotypes", "n_shared_genes", "n_shared_variants", "n_shared_phenotypes")).otherwise("")
    text = F.concat(F.format_string("%s and %s: integrated score %.3f; ", "drug_name", "gene_name", "integrated_score"), path, F.lit("; "), literature, pathways, shared, F.lit("."))
    return rows.select(
        *key, "drug_name", "gene_name", F.col("place").alias("model_rank"), F.col("score").alias("model_score"), "hub_adjusted", "literature_signal", F.col("pathway").alias("pathway_signal"), "integrated_score", "n_articles",
        "literature_citations", "abstract_summary", F.col("n_sets").alias("n_significant_pathways_for_gene"), "top_pathway_hits", "shortest_path_length", "shortest_paths", "shortest_path_relations",
        "shared_genes_within_khop", "n_shared_genes", "n_shared_variants", "n_shared_phenotypes", text.alias("explanation"),
    )
