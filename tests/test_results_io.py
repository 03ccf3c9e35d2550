from __future__ import annotations

import json
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions import text as tx
from graphloom.gnn.models import graph_model
from graphloom.sources import delimited as dl
from graphloom.sources import results as rs


def test_runs_are_read_together(spark, tmp_path):
    folder = str(tmp_path)
    ranks = spark.createDataFrame([(1, 2, 3), (1, 4, 1)], "drug_idx bigint, gene_idx bigint, rank bigint")
    for run in ("a_1", "a_2", "b_1"):
        rs.write_ranks(ranks, folder, run)
        rs.write_report(spark.createDataFrame([(run, 0.5)], "model string, mrr double"), folder, run)
    got = rs.read_runs(spark, folder, pattern="a_*")
    assert sorted({r["run"] for r in got.collect()}) == ["a_1", "a_2"] and got.count() == 4
    reports = {r["run"]: (r["model"], r["mrr"]) for r in rs.read_runs(spark, folder, "report").collect()}
    assert reports == {r: (r, 0.5) for r in ("a_1", "a_2", "b_1")}


def test_models_and_configs_come_back(spark, tmp_path):
    folder = str(tmp_path)
    for name, bits in (("rgcn", 6), ("rgat", None), ("gcn", None)):
        model = graph_model(name, 7, 3, 4, dim=5, fingerprint_bits=bits)
        rs.write_model(spark, model, folder, name)
        again = rs.read_model(spark, folder, name)
        assert (again.name, again.dim, again.dropout, again.molecular) == (name, 5, 0.2, bits is not None)
        assert again.params.keys() == model.params.keys() and all(np.array_equal(again.params[k], v) for k, v in model.params.items())
    run = rs.write_run_config(spark, {"epochs": 3, "path": tmp_path}, folder)
    told = rs.read_json(spark, f"{folder}/{run}/config/part-*")
    assert told["config"]["epochs"] == 3 and told["versions"]["pyspark"] and told["run"] == run
    (tmp_path / "c.json").write_text(json.dumps({"dim": 64}, indent=2))
    assert rs.read_json(spark, str(tmp_path / "c.json")) == {"dim": 64}
    with pytest.raises(ValueError, match="no documents"):
        rs.read_json(spark, f"{folder}/rgcn/model_info/_*")
    assert rs.run_id(datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)) == "20260102_030405"


def test_fingerprints_and_bundles(spark, tmp_path):
    drugs = spark.createDataFrame([(1, "a", [1, 0]), (2, "b", None), (3, "c", [1, 0])], "node bigint, node_name string, fp array<int>")
    summary = rs.write_fingerprints(drugs, str(tmp_path), "r").first()
    assert (summary["n_drugs"], summary["n_with_fingerprint"], summary["n_bits"], summary["n_distinct"]) == (3, 2, 2, 1)
    back = {r["node"]: r["fp"] for r in rs.read_runs(spark, str(tmp_path), "fingerprints").collect()}
    assert back == {1: [1.0, 0.0], 2: None, 3: [1.0, 0.0]}
    edges = spark.createDataFrame([(1, 2, 0), (2, 1, 1), (1, 3, 0)], "src bigint, dst bigint, rel bigint")
    pairs = spark.createDataFrame([("train",), ("train",), ("test",)], "split string")
    assert tuple(rs.bundle_sizes(drugs, edges, pairs, drugs).first()) == (3, 2, 3, 2, 0, 1, 2)
    assert tuple(rs.bundle_sizes(drugs.limit(0), edges.limit(0), pairs.limit(0)).first()) == (0,) * 7


def delivery(folder):
    rows = {
        "chemicals": "PharmGKB Accession Id\tName\tSMILES\nPA1\tdrug one\tCC\nPA1\tanother\tCC\n\tnameless\t\nPA2\t\t\n", "genes": "PharmGKB Accession Id\tSymbol\nPA3\tG1\n",
        "phenotypes": "PharmGKB Accession Id\tName\nPA4\tpain\n", "variants": "Variant ID\tVariant Name\nrs1\trs1\n",
        "relationships": "Entity1_id\tEntity1_name\tEntity1_type\tEntity2_id\tEntity2_name\tEntity2_type\tEvidence\tAssociation\tPK\tPD\tPMIDs\n"
        + "PA1\tdrug one\tChemical\tPA3\tG1\tGene\tClinicalAnnotation\tassociated\t\t\t12\n" * 2 + "PA3\tG1\tGene\tPA9\tnew\tDisease\tLiterature\tambiguous\t\t\t\n",
    }
    for name, text in rows.items():
        (folder / f"{name}.tsv").write_text(text)


def test_five_tables_make_a_graph(spark, tmp_path):
    delivery(tmp_path)
    nodes, relationships = dl.read_delivery(spark, str(tmp_path))
    assert {tuple(r) for r in nodes.collect()} == {("PA1", "another", "drug"), ("PA2", None, "drug"), ("PA3", "G1", "gene"), ("PA4", "pain", "phenotype"), ("rs1", "rs1", "variant")}
    assert sorted(r["rel_id"] for r in relationships.collect()) == [0, 1, 2]
    cli.build_graph(spark, str(tmp_path), str(tmp_path / "out"))
    built = spark.read.parquet(str(tmp_path / "out/nodes"))
    assert built.filter("is_supplemental").select("node_id").collect()[0][0] == "PA9" and built.count() == 6
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 3
    (tmp_path / "genes.tsv").write_text("PharmGKB Accession Id\tName\nPA3\tG1\n")
    with pytest.raises(ValueError, match="genes.tsv lacks"):
        dl.read_delivery(spark, str(tmp_path))


def test_small_texts(spark):
    row = spark.createDataFrame([("Chemical", "Haplotype ", None, "KEGG::a::b", "plain", "drug_gene__pairs")], "a string, b string, c string, d string, e string, f string").select(
        tx.audit_type("a"), tx.audit_subtype("a"), tx.audit_type("b"), tx.audit_type("c"), tx.source_of("d"), tx.source_of("e"), tx.title_case("f"), tx.node_key(F.lit("gene"), F.lit("PA1")), tx.structure(F.lit(" C CO ")), tx.structure(F.lit("n / a"))
    )
    assert tuple(row.first()) == ("drug", "chemical", "haplotype", None, "KEGG", "plain", "Drug Gene Pairs", "gene:PA1", "CCO", None)
