"""Searches in blocks against the searches by joins, and that no rows are made of what isn't asked for."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import __spark_entry__
from graphloom.operators import block_search, paths
from graphloom.operators import graph_build as gb


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(1)
    links = {(rng.choice((rng.randrange(5), rng.randrange(300))), rng.randrange(300)) for _ in range(420)} | {(1000, 1001), (1001, 1002), (5, 5), (2000, 2000), (7, 1 << 40)}
    edges = spark.createDataFrame([(a, b, f"r{a % 7}", i) for i, (a, b) in enumerate(sorted(links))], "source_idx bigint, target_idx bigint, relation_type string, edge_index bigint").cache()
    nodes = spark.createDataFrame([(i, f"n{i}", ("gene", "variant", "phenotype", "drug")[i % 4]) for i in [*range(300), 1000, 1001, 1002, 2000]], "node_index bigint, node_name string, node_type string")
    asked = [(rng.randrange(310), rng.randrange(310)) for _ in range(150)] + [(1000, 1002), (3, 1000), (2000, 2000), (999, 999), (9, 9), (None, 3), (0, 1), (0, 1)]
    pairs = spark.createDataFrame(asked, "drug_idx bigint, gene_idx bigint")
    return edges, nodes, gb.simple_degree(gb.undirected_edges(edges)), paths.symmetric(edges).cache(), pairs


def both(monkeypatch, make):
    """Sorted rows of the search in blocks and of that by joins."""
    rows = lambda: sorted(map(repr, make().collect()))
    blocks = rows()
    monkeypatch.setattr(block_search, "MOST_LINKS", -1)
    return blocks, rows()


def test_distances(graph, monkeypatch):
    _, _, _, near, pairs = graph
    for hops in (0, 2, 4, None):
        blocks, joins = both(monkeypatch, lambda hops=hops: paths.khop(near, pairs.selectExpr("drug_idx AS source"), hops))
        monkeypatch.undo()
        assert blocks == joins and blocks


def test_a_nodes_rows_of_many_sources_are_stored_together(graph, monkeypatch, tmp_path, spark):
    """Nodes of two hubs and 128 sources at them: little is stored of a row, and a task that holds few numbers gives the same rows."""
    ends = [(1 << 20, n) for n in range(1, 2_001)] + [((1 << 20) + 1, n) for n in range(1_000, 3_001)]
    near = spark.createDataFrame([*ends, *((v, u) for u, v in ends)], "u bigint, v bigint")
    asked = spark.createDataFrame([(n,) for n in range(937, 1_065)], "source bigint")
    paths.khop(near, asked, 4).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 128 * 3_002
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.8 * got.count()  # bytes
    monkeypatch.setattr(block_search, "HELD", 1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    _, _, _, links, pairs = graph
    held = block_search.held(links)
    few = list(range(3, 90)) + [5_000]
    sources = spark.createDataFrame([(n,) for n in few], "source bigint")
    assert rows(block_search.khop(held, sources, 4)) == rows(paths.joined_khop(links, sources, 4))


def test_lengths_and_numbers_of_paths(graph, monkeypatch):
    _, _, _, near, pairs = graph
    blocks, joins = both(monkeypatch, lambda: paths.all_shortest_paths(near, pairs))
    assert blocks == joins and len(blocks) == pairs.distinct().count()


def test_shared_nodes(graph, monkeypatch):
    _, nodes, degree, near, pairs = graph
    blocks, joins = both(monkeypatch, lambda: paths.shared_by_type(near, pairs, nodes, degree, ["gene", "variant", "phenotype"]).select("drug_idx", "gene_idx", "node_type", "node", "drug_distance", "gene_distance", "distance", "degree", "place"))
    assert blocks == joins and blocks


def test_explanations(graph, monkeypatch):
    edges, nodes, degree, near, pairs = graph
    blocks, joins = both(monkeypatch, lambda: paths.explain_pairs(near, gb.pair_relation(edges), nodes, degree, pairs.dropna()))
    assert blocks == joins and blocks


def test_words_of_a_hub_are_read_in_parts(monkeypatch, graph):
    _, _, _, near, pairs = graph
    monkeypatch.setattr(block_search, "PART", 7)
    links = block_search.held(near)
    assert links.parts[0] == 0 and links.parts[-1] == len(links.ids) and len(links.parts) > 20
    got = [level.tolist() for level in links.levels(links.place([0, 1, 1000, 999]), None)]
    monkeypatch.setattr(block_search, "PART", 4_000_000)
    assert got == [level.tolist() for level in block_search.held(near).levels(links.place([0, 1, 1000, 999]), None)]


def test_joins_make_no_rows_in_a_search_by_blocks(graph, monkeypatch):
    _, _, _, near, pairs = graph
    monkeypatch.setattr(paths, "joined_khop", None)
    assert paths.all_shortest_paths(near, pairs).count() == pairs.distinct().count()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["explanation_diagnostics", "integrated_explanations"])
def test_queries_over_explanations_make_no_balls(spark, monkeypatch, name):
    monkeypatch.setattr(paths, "joined_khop", None)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count()


def test_relations_are_made_of_the_links_on_paths_only(graph):
    edges, nodes, degree, near, pairs = graph
    asked, seen = pairs.dropna(), []

    def made(links):
        seen.append(links.count())
        return gb.pair_relation(edges, links)

    got, want = (sorted(map(repr, paths.explain_pairs(near, r, nodes, degree, asked).collect())) for r in (made, gb.pair_relation(edges)))
    assert got == want and 0 < seen[0] < near.count()
