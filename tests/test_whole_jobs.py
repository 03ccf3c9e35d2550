"""Searches without a limit, against a breadth-first search of our own; results of any size."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from graphloom.operators import evidence as ev
from graphloom.plans import evidence_queries as eq
from graphloom.sources.delimited import parse_gmt
from tests.test_oracle import TABLES, bag, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def searched(duck):  # noqa: F811
    """Of each asked pair its drug's and its gene's distances and path numbers, breadth first without a limit."""
    near = defaultdict(set)
    for u, v in duck.sql(f"WITH {eq._SYM} SELECT * FROM sym").fetchall():
        near[u].add(v)

    def reach(source):
        seen, ways, level, hop = {source: 0}, {source: 1}, [source], 0
        while level:
            hop, after = hop + 1, Counter()
            for u in level:
                for v in near[u]:
                    if v not in seen:
                        after[v] += ways[u]
            seen |= dict.fromkeys(after, hop)
            ways |= after
            level = list(after)
        return seen, ways

    pairs = duck.sql(f"WITH {eq._POOL} SELECT drug_idx, gene_idx FROM asked").fetchall()
    return {(d, g): (*reach(d), reach(g)[0]) for d, g in pairs}


def test_distances_and_paths_have_no_short_limit(spark, searched):
    got = {(r["source"], r["node"], r["distance"]) for r in eq.QUERIES["khop_distances"](spark, str(TABLES)).collect()}
    assert got == {(d, n, k) for (d, _), (seen, _, _) in searched.items() for n, k in seen.items() if k <= 4}
    found = {(r["drug_idx"], r["gene_idx"], r["length"], r["n_paths"]) for r in eq.QUERIES["shortest_paths"](spark, str(TABLES)).collect()}
    assert found == {(d, g, seen.get(g), ways.get(g, 0)) for (d, g), (seen, ways, _) in searched.items()}


def test_paths_longer_than_the_near_search(spark):
    steps = [(i, i + 1) for i in range(9)] + [(20, 21)]
    near = spark.createDataFrame([*steps, *((v, u) for u, v in steps)], "u bigint, v bigint")
    pairs = spark.createDataFrame([(0, 9), (0, 3), (0, 21)], "drug_idx bigint, gene_idx bigint")
    got = {tuple(r) for r in eq.paths.all_shortest_paths(near, pairs).collect()}
    assert got == {(0, 9, 9, 1), (0, 3, 3, 1), (0, 21, None, 0)}


def test_shared_nodes_of_three_types_within_four_hops(spark, duck, searched):  # noqa: F811
    kinds = dict(duck.sql("SELECT node_index, node_type FROM nodes").fetchall())
    got = defaultdict(list)
    for r in eq.QUERIES["shared_khop"](spark, str(TABLES)).collect():
        got[r["drug_idx"], r["gene_idx"], r["node_type"]].append(r["distance"])
    for (d, g), (a, _, b) in searched.items():
        for kind in ("gene", "variant", "phenotype"):
            want = sorted(a[n] + b[n] for n in a if n in b and a[n] <= 4 and b[n] <= 4 and kinds.get(n) == kind and n not in (d, g))[:10]
            assert sorted(got[d, g, kind]) == want


def test_paths_and_texts_of_pairs_at_any_distance(spark):
    steps = [(i, i + 1) for i in range(7)] + [(0, 11), (11, 2), (0, 12), (12, 2), (0, 13), (13, 2), (20, 21)]
    edges = spark.createDataFrame([(a, b, f"r{a}-{b}", i) for i, (a, b) in enumerate(steps)], "source_idx bigint, target_idx bigint, relation_type string, edge_index bigint")
    nodes = spark.createDataFrame([(i, f" n{i} " if i != 3 else "nan", "gene" if i % 2 else "drug") for i in range(22)], "node_index bigint, node_name string, node_type string")
    near, degree = eq.paths.symmetric(edges), eq.gb.simple_degree(eq.gb.undirected_edges(edges))
    pairs = spark.createDataFrame([(0, 7), (0, 2), (0, 21), (5, 5), (0, 1), (0, 1)], "drug_idx bigint, gene_idx bigint")
    got = {(r["drug_idx"], r["gene_idx"]): r for r in eq.paths.explain_pairs(near, eq.gb.pair_relation(edges), nodes, degree, pairs).collect()}
    assert set(got) == {(0, 7), (0, 2), (0, 21), (5, 5), (0, 1)}
    far, two, none, same = got[0, 7], got[0, 2], got[0, 21], got[5, 5]
    assert (far["shortest_path_length"], far["n_shortest_paths"]) == (7, 3)
    assert far["shortest_paths"].split(" || ")[0] == "n0[drug] -> n1[gene] -> n2[drug] -> 3[gene] -> n4[drug] -> n5[gene] -> n6[drug] -> n7[gene]"
    assert far["shortest_path_relations"].split(" || ")[1] == "r0-11 | r11-2 | r2-3 | r3-4 | r4-5 | r5-6 | r6-7"
    assert two["shortest_paths"] == "n0[drug] -> n1[gene] -> n2[drug] || n0[drug] -> n11[gene] -> n2[drug] || n0[drug] -> n12[drug] -> n2[drug]"
    assert none["shortest_path_length"] is None and none["shortest_paths"] == none["shared_genes_within_khop"] == "" and none["n_shortest_paths"] == 0
    assert same["shortest_path_length"] == 0 and same["shortest_paths"] == "n5[gene]" and same["shortest_path_relations"] in ("", None)
    assert eq.paths.explain_pairs(near, eq.gb.pair_relation(edges), nodes, degree, pairs.limit(0)).collect() == []


def test_articles_and_last_explanation(spark):
    row = dict.fromkeys(ev.ARTICLE)
    articles = [
        {"drug_idx": 1, "gene_idx": 2, **row, "pmid": "7", "title": "T", "journal": "J", "year": "2021", "authors": "A B; C D", "doi": "10/x", "url": "u", "abstract": "We saw 3.5 mg. It worked. Yes."},
        {"drug_idx": 1, "gene_idx": 2, **row, "pmid": "9", "authors": "Z"}, {"drug_idx": 1, "gene_idx": 2, **row, "pmid": ""}, {"drug_idx": 1, "gene_idx": 3, **row},
    ]
    df = spark.createDataFrame(articles, "drug_idx bigint, gene_idx bigint, " + ", ".join(f"{c} string" for c in ev.ARTICLE))
    lists = {(r["drug_idx"], r["gene_idx"]): r for r in ev.article_lists(df).collect()}
    assert set(lists) == {(1, 2)} and lists[1, 2]["n_articles"] == 2
    assert lists[1, 2]["literature_citations"] == "[1] A B et al. (2021). T J. PMID:7. DOI:10/x. u\n[2] Z (n.d.).  . PMID:9. "
    assert lists[1, 2]["abstract_summary"] == "[1] We saw 3.5 mg."
    scored = spark.createDataFrame([(1, 2, 1, 0.5, 1.0, 0.1, 1.0, 0.9), (1, 3, 2, 0.4, 0.5, 0.0, 0.0, 0.2)], "drug_idx bigint, gene_idx bigint, place bigint, score double, hub_adjusted double, literature_signal double, pathway double, integrated_score double")
    told = spark.createDataFrame([(1, 2, n, "p", "r", "s", 1, 0, 2, n) for n in (3, 4)], "drug_idx bigint, gene_idx bigint, shortest_path_length bigint, shortest_paths string, shortest_path_relations string, shared_genes_within_khop string, n_shared_genes bigint, n_shared_variants bigint, n_shared_phenotypes bigint, explained_at bigint")
    hits = spark.createDataFrame([(2, "S", i, i, 0.0123) for i in (1, 2, 3)], "gene_idx bigint, source string, set_id bigint, place bigint, q double")
    nodes = spark.createDataFrame([(1, "D"), (2, "G")], "node_index bigint, node_name string")
    out = ev.integrated_explanations(scored, told, hits, df, nodes)
    assert len(out.columns) == 23
    a, b = out.orderBy("gene_idx").collect()
    assert a["shortest_path_length"] == 4  # the last explanation of a pair counts
    assert a["explanation"] == "D and G: integrated score 0.900; connected by 4 steps; 2 articles name both; the gene is in 3 significant sets, among them S::1, S::2; they share 1 genes, 0 variants and 2 phenotypes."
    assert a["top_pathway_hits"] == "S::1 (q=1.23e-02); S::2 (q=1.23e-02); S::3 (q=1.23e-02)"
    assert b["gene_name"] == "3" and b["literature_citations"] == "No articles found for this pair." and b["explanation"] == "D and 3: integrated score 0.200; no path in the graph; no article names both."


def test_a_large_gene_set_is_whole(spark):
    line = "\t".join(["S", "about", *(f"G{i}" for i in range(100_005))])
    assert parse_gmt(spark.createDataFrame([(line,)], "value string"), "X").count() == 100_005


def test_articles_name_both_ends_as_whole_words(spark):
    names = spark.createDataFrame([(1, "Alpha-2 beta"), (2, "GEN1"), (3, "gen"), (4, None), (5, "--"), (6, "GEN1")], "node bigint, name string")
    texts = [(10, "Of ALPHA 2  beta and (gen1).", 2020), (11, "alpha 2 betas with gen1", 2020), (12, "gen1, alpha 2; beta", 2010), (13, None, 2020), (14, "", 2020), (10, "gen alpha-2-beta", 2021), (15, "alpha 2 beta gen1", None)]
    articles = spark.createDataFrame(texts, "article_id bigint, text string, year int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 2), (None, 2)], "drug_idx bigint, gene_idx bigint")
    got = sorted(tuple(r) for r in ev.find_articles(pairs, names, articles).collect())
    assert got == sorted([(1, 2, 10), (1, 6, 10), (1, 3, 10), (1, 2, 12), (1, 6, 12), (1, 2, 15), (1, 6, 15)])
    late = sorted(tuple(r) for r in ev.find_articles(pairs, names, articles, 2015, 2020).collect())
    assert late == [(1, 2, 10), (1, 6, 10)]
    assert ev.find_articles(pairs, names, articles.limit(0)).collect() == []


def test_articles_are_moved_once_and_met_within(spark, monkeypatch):
    """Texts aren't repeated for each of their words, and a common drug's pairs not for each of its articles."""
    kept = []
    monkeypatch.setattr(ev, "cut_lineage", lambda df: kept.append(df) or df)
    names = spark.createDataFrame([(i, f"name{i}") for i in range(60)], "node bigint, name string")
    articles = spark.createDataFrame([(i, f"name0 name{i % 60}", 2020) for i in range(1, 121)], "article_id bigint, text string, year int")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)], "drug_idx bigint, gene_idx bigint")
    out = ev.find_articles(pairs, names, articles)
    assert sorted(tuple(r) for r in out.collect()) == sorted((0, i % 60, i) for i in range(1, 121) if i % 60)

    def joins(df):
        plan = df._jdf.queryExecution().optimizedPlan()
        nodes = [plan.apply(i) for i in range(len(plan.toString().strip().split("\n")))]
        return [(n.condition().toString(), n.left().output().mkString(" "), n.right().output().mkString(" ")) for n in nodes if n is not None and n.nodeName() == "Join"]

    on_words = [j for j in joins(kept[0]) if "word#" in j[0]]
    assert on_words and not any("body#" in j[1] + j[2] for j in on_words)
    together = next(j for j in joins(out) if "article_id#" in j[0])
    assert "gene_idx" not in together[1] or "drug_idx" not in together[1]


def test_a_hub_gene_is_dealt_over_chunks_and_stored_by_phenotype(spark, monkeypatch):
    monkeypatch.setattr(ev, "PHENOTYPES", 10, raising=False)
    edges = spark.createDataFrame([(1, 1000 + i, "gene", "phenotype", "r", "label", "associated") for i in range(200)] + [(2, 1000, "gene", "phenotype", "r", "label", "ambiguous")],
                                  "source_idx bigint, target_idx bigint, source_type string, target_type string, relation_type string, evidence string, association string")
    predictions = spark.createDataFrame([(d, g) for d in range(50, 80) for g in (1, 2, 3)], "drug_idx bigint, gene_idx bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = ev.propagate(predictions, edges)
        rows = [[(r["gene_idx"], r["phenotype_idx"], r["drug_idx"]) for r in part] for part in made.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    flat = [r for part in rows for r in part]
    assert sorted(flat) == sorted([(1, 1000 + i, d) for i in range(200) for d in range(50, 80)] + [(2, 1000, d) for d in range(50, 80)])
    assert sum(any(r[0] == 1 for r in part) for part in rows) > 1  # not one task's
    assert sum(a[:2] != b[:2] for a, b in zip(flat, flat[1:], strict=False)) <= 201  # the drugs of a phenotype lie together


def test_a_block_of_drugs_repeats_for_each_phenotype_where_it_is_stored(spark, tmp_path):
    edges = spark.createDataFrame([(1, 10_000 + i, "gene", "phenotype", "r", "label", "associated") for i in range(120)], "source_idx bigint, target_idx bigint, source_type string, target_type string, relation_type string, evidence string, association string")
    drugs = [(7 * d * d) % 9_973 for d in range(4_900)]
    predictions = spark.createDataFrame([(d, 1) for d in drugs] + [(None, 1)], "drug_idx bigint, gene_idx bigint")
    ev.propagate(predictions, edges).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("drug_idx", "phenotype_idx").distinct().count() == 120 * (len(set(drugs)) + 1)
    stored = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert stored < 0.7 * got.count()  # bytes; an index of a drug alone would take 1.6
