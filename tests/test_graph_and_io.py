from __future__ import annotations

import json
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.gnn import layers as gnn
from graphloom.gnn.trainer import TrainConfig, train
from graphloom.operators import evidence as ev
from graphloom.operators import graph_build as gb
from graphloom.operators import paths
from graphloom.sources import delimited as dl
from graphloom.sources import sinks
from graphloom.streaming import ingest

RAW = "rel_id bigint, entity1_id string, entity1_name string, entity1_type string, entity2_id string, entity2_name string, entity2_type string, evidence string, association string, pk string, pd string, pmids string, node_id int"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, " D1 ", "a", "Drug", "G1", "x", "Gene", "CPIC", "associated"), (2, "G1", "x2", "genes", "D1", "a", "chemical", None, "not-associated"), (3, "H", "h", "Haplotype", "G1", "x", "gene", "FDA", "associated"),
        (4, None, "n", "Drug", "G9", "y", "Gene", "PMID:3", "odd"), (4, None, "n", "Drug", "G9", "y", "Gene", "PMID:3", "odd"),
    ]
    return spark.createDataFrame([(*r, None, None, None, 0) for r in rows], RAW)


def test_graph_from_raw_records(spark, raw):
    nodes = spark.createDataFrame([(0, "D1", "a", "drug", "t", False), (1, "G1 ", "x", "gene", "t", False)], "node_index bigint, node_id string, node_name string, node_type string, node_source string, is_supplemental boolean")
    typed = gb.prepare_relationships(raw)
    assert sorted(r["relation_type"] or "" for r in typed.collect()) == ["", "", "drug_gene_guideline_associated", "gene_drug_other_not_associated"]
    aliases = gb.endpoint_aliases(typed)
    assert {(r["node_id"], tuple(r["endpoint_names"])) for r in aliases.collect()} == {("D1", ("a",)), ("G1", ("x", "x2")), ("G9", ("y",))}
    assert [r["node_id"] for r in gb.supplemental_nodes(aliases, nodes).collect()] == ["G9"]
    indexed = gb.index_edges(typed, nodes)
    assert indexed.count() == 4 and gb.index_edges(typed, nodes, "inner").count() == 2
    kept = gb.retention(raw, indexed).first()
    assert (kept["n_raw"], kept["n_in_scope"], kept["n_mapped"]) == (5, 4, 2)
    none = gb.retention(raw.limit(0), indexed.limit(0)).first()
    assert none["in_scope_percent"] is None
    assert gb.index_nodes(nodes.limit(0)).collect() == []


def brute(adjacent, source, limit):
    distance, count, queue = {source: 0}, {source: 1}, deque([source])
    while queue:
        u = queue.popleft()
        if distance[u] < limit:
            for v in adjacent.get(u, ()):
                if v not in distance:
                    distance[v], count[v] = distance[u] + 1, 0
                    queue.append(v)
                if distance[v] == distance[u] + 1:
                    count[v] += count[u]
    return {v: (d, count[v]) for v, d in distance.items()}


def test_paths_match_breadth_first_search(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.2 else rng.randrange(30), rng.randrange(45)) for _ in range(60)] + [(3, 3), (None, 4)]
    near = paths.symmetric(spark.createDataFrame(rows, "source_idx bigint, target_idx bigint"))
    adjacent: dict = {}
    for a, b in rows:
        if a is not None and a != b:
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
    got: dict = {}
    for r in paths.khop(near, spark.createDataFrame([(0,), (7,), (99,), (None,)], "source bigint"), 3).collect():
        got.setdefault(r["source"], {})[r["node"]] = (r["distance"], r["n_paths"])
    assert got == {s: brute(adjacent, s, 3) for s in (0, 7, 99)}
    asked = [(a, b) for a in (0, 5, 7, 99) for b in range(30, 45)]
    found = {(r["drug_idx"], r["gene_idx"]): (r["length"], r["n_paths"]) for r in paths.shortest_paths(near, spark.createDataFrame(asked, "drug_idx bigint, gene_idx bigint"), 4).collect()}
    assert found == {(a, b): brute(adjacent, a, 4).get(b, (None, 0)) for a, b in asked}


def test_propagation_keeps_the_fewest_hops(spark):
    rows = [(10, 30, "gene", "phenotype", "label", "not_associated"), (10, 20, "gene", "variant", "x", "associated"), (20, 30, "variant", "phenotype", "label", "associated"), (30, 20, "phenotype", "variant", "clinical", "ambiguous")]
    edges = spark.createDataFrame([(*r, "rel") for r in rows], "source_idx bigint, target_idx bigint, source_type string, target_type string, evidence string, association string, relation_type string")
    got = {r["evidence"]: (r["hops"], r["via_variant_idx"], r["is_negative"], r["is_ambiguous"]) for r in ev.propagate(spark.createDataFrame([(1, 10), (1, 99)], "drug_idx bigint, gene_idx bigint"), edges).collect()}
    assert got == {"label": (1, None, True, False), "clinical": (2, 20, False, True)}


GRAPH = ([0, 0, 1, 2, 3, 3, 4, 5, 5, 2], [3, 4, 2, 1, 0, 5, 0, 1, 1, 5], [0, 1, 1, 2, 2, 0, 0, 1, 1, 2])


@pytest.fixture(scope="module")
def toy(spark):
    x = np.random.default_rng(0).normal(size=(6, 3))
    edges = spark.createDataFrame(list(zip(*GRAPH, strict=True)), "src int, dst int, rel int")
    return edges, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "node int, x array<double>"), x


def rows_of(df):
    return np.array([r["x"] for r in df.orderBy("node").collect()])


def test_layers_match_numpy(spark, toy):
    edges, features, x = toy
    src, dst, rel = map(np.array, GRAPH)
    w = np.arange(9).reshape(3, 3) / 7 - 0.5
    loops = np.arange(6)
    s, t = np.r_[src, loops], np.r_[dst, loops]
    deg = np.bincount(t, minlength=6)
    out = np.zeros((6, 3))
    np.add.at(out, t, x[s] / np.sqrt(deg[s] * deg[t])[:, None])
    assert np.allclose(rows_of(gnn.gcn_layer(edges, features, w.tolist())), np.maximum(out @ w, 0), atol=1e-9)

    bases, a = [w, w.T + 0.1], {0: [0.5, -1.0], 1: [1.0, 0.25], 2: [-0.3, 0.7]}
    out = x @ w
    matrices = {k: np.array(v) for k, v in gnn.basis_matrices(a, [b.tolist() for b in bases]).items()}
    for r in range(3):
        for v in range(6):
            hit = (rel == r) & (dst == v)
            if hit.any():
                out[v] += x[src[hit]].mean(0) @ matrices[r]
    coefficients = spark.createDataFrame(list(a.items()), "rel int, a array<double>")
    assert np.allclose(rows_of(gnn.rgcn_layer(edges, features, coefficients, [b.tolist() for b in bases], w.tolist())), np.maximum(out, 0), atol=1e-9)

    h, us, ud, bias = x @ w, np.array([0.3, -0.2, 0.5]), np.array([0.1, 0.4, -0.6]), np.array([0.2, -0.1, 0.0])
    z = h[src] @ us + h[dst] @ ud + bias[rel]
    e = np.exp(np.where(z > 0, z, 0.2 * z))
    out, total = np.zeros((6, 3)), np.zeros(6)
    np.add.at(out, dst, e[:, None] * h[src])
    np.add.at(total, dst, e)
    got = gnn.rgat_layer(edges, features, w.tolist(), us.tolist(), ud.tolist(), spark.createDataFrame(list(enumerate(bias.tolist())), "rel int, bias double"))
    assert np.allclose(rows_of(got), np.maximum(out / np.maximum(total, 1e-300)[:, None], 0), atol=1e-9)
    norms = {r["rel"]: r["norm"] for r in gnn.relation_importance(coefficients, [b.tolist() for b in bases]).collect()}
    assert norms == pytest.approx({k: np.linalg.norm(v) for k, v in matrices.items()})


def test_trainer_learns_and_repeats():
    rng = np.random.default_rng(1)
    drugs, genes = np.arange(20), np.arange(20, 40)
    pairs = np.array([(d, g) for d in drugs for g in genes if d % 4 == g % 4])
    rng.shuffle(pairs)
    kept, held = pairs[10:], pairs[:10]
    edges = np.r_[kept, kept[:, ::-1]]
    config = TrainConfig(dim=16, epochs=120, rate=0.02)
    a, b = (train(40, edges, kept, held, genes, config) for _ in range(2))
    assert np.array_equal(a.embedding, b.embedding) and max(h[2] for h in a.history) > 0.5
    with pytest.raises(ValueError, match="too large"):
        train(40, edges, kept, held, genes, TrainConfig(most_edges=3))


def test_delimited_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/drugs_x.tsv").write_text('﻿PharmId\t Long   name \nPA1\tNA\nPA2\t"a\t""b"""\n', encoding="utf-8")
    path = dl.find_file(spark, str(tmp_path), "drugs")
    df = dl.read_delimited(spark, path)
    assert df.columns == ["PharmId", "Long name"] and sorted(tuple(r) for r in df.collect()) == [("PA1", None), ("PA2", 'a\t"b"')]
    assert dl.pick_column(df, ["x", "pharmid"], "id") == "PharmId"
    with pytest.raises(KeyError):
        dl.pick_column(df, ["y"], "y")
    with pytest.raises(FileNotFoundError):
        dl.find_file(spark, str(tmp_path), "nothing")


def test_gene_sets(spark, tmp_path):
    (tmp_path / "kegg_a.GMT").write_text("S1\td\tg1\tG2\tg1\nS2\td\nS3\td\tnan\tg9\n")
    (tmp_path / "PA12-Some-path.tsv").write_text("Id\tGenes\n1\tabc, DEF\n2\tabc\n")
    gmt, tables = dl.read_gmt(spark, str(tmp_path)), dl.read_pathway_tables(spark, str(tmp_path))
    assert {tuple(r) for r in gmt.collect()} == {("KEGG", "S1", "G1"), ("KEGG", "S1", "G2"), ("KEGG", "S3", "G9")}
    assert {tuple(r) for r in tables.collect()} == {("PGKB", "PGKB::PA12_Some-path", "ABC"), ("PGKB", "PGKB::PA12_Some-path", "DEF")}
    twice = spark.createDataFrame([("S\td\ta", 0), ("S\td\tb", 1)], "value string, line_no int")
    assert [tuple(r) for r in dl.parse_gmt(twice, "X").collect()] == [("X", "S", "B")]
    merged = dl.merge_gene_sets(gmt, spark.createDataFrame([("N", "S1", "Z")], gmt.schema))
    assert {(r["set_id"], r["gene"]) for r in merged.collect()} == {("S1", "Z"), ("S3", "G9")}


def test_literature(spark, tmp_path):
    lines = [{"pmid": "1", "title": "T", "journal": "J", "pubdate": "2020 Mar", "authors": ["A", "B"], "drug": "d", "gene": "g"}, {"pmid": "2", "title": None, "journal": "J"}]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, lines)))
    got = dl.read_summaries(spark, str(tmp_path / "s.json"))
    assert [(r["pmid"], r["citation"]) for r in got.collect()] == [("1", "A et al. (2020). T. J.")]
    pairs = spark.createDataFrame([("d", "g"), ("d", "h")], "drug string, gene string")
    assert {(r["gene"], r["pmid"]) for r in dl.literature_evidence(pairs, got).collect()} == {("g", "1"), ("h", None)}
    xml = spark.createDataFrame([('<a><PMID>7</PMID><AbstractText Label="AIM">x</AbstractText><AbstractText Label="END">y</AbstractText></a>',), ("<a><PMID>8</PMID><AbstractText>z</AbstractText></a>",)], "xml string")
    assert {tuple(r) for r in dl.parse_abstracts(xml).collect()} == {("7", "AIM: x END: y"), ("8", "z")}


def test_sinks_and_stream(spark, raw, tmp_path):
    sinks.write_mapping(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k", "v", str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="more than"):
        sinks.write_mapping(spark.range(5).select("id", F.col("id").alias("v")), "id", "v", str(tmp_path / "n.json"), most=3)
    df = spark.createDataFrame([("p", 1, 5), ("p", 2, 6)], "protocol string, seed int, x int")
    sinks.write_splits(df, str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).filter("seed = 2").first()["x"] == 6
    raw.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        ingest.write_stream(ingest.stream_relationships(spark, str(tmp_path / "in"), raw.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == gb.prepare_relationships(raw).count()
