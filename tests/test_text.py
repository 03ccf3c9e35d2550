from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_clean_text(spark):
    assert column(spark, [" a \t b\n", " x ", "", "NaN", "None", "null", None, "nan x"], tx.clean_text) == ["a b", "x", None, None, None, None, None, "nan x"]


def test_null_tokens_are_those_of_a_reader(spark):
    assert column(spark, ["NA", "null", "N/A", "none", " ", "", None], tx.null_tokens) == [None, None, None, "none", " ", None, None]


def test_types(spark):
    assert column(spark, ["Chemical", " GENES ", "Disease", "variant", "Haplotype", "odd", None], tx.canonical_type) == ["drug", "gene", "phenotype", "variant", None, None, None]
    assert column(spark, ["Haplotype", "odd"], lambda c: tx.canonical_type(c, "keep")) == ["variant", "odd"]


@pytest.mark.parametrize(
    ("raw", "kind"),
    [("CPIC guideline", "guideline"), ("Label annotation", "label"), ("FDA x", "label"), ("Reactome y", "pathway"), ("VariantAnnotation", "clinical"), ("PMID:1", "literature"), ("VIP", "other"), (None, "other"), ("Guideline label", "guideline")],
)
def test_evidence(spark, raw, kind):
    assert column(spark, [raw], tx.normalise_evidence) == [kind]


def test_association(spark):
    assert column(spark, ["Not - associated", "not-associated", " Ambiguous ", "maybe", "", None], tx.normalise_association) == ["not_associated", "not_associated", "ambiguous", None, None, None]


def test_bins(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 9, 10, 19, 20)], "n int").select(tx.degree_stratum("n").alias("s"), tx.degree_group("n").alias("g")).collect()
    assert [r["s"] for r in rows] == [None, None, "2", "3-4", "3-4", "5-9", "5-9", "10-19", "10-19", "20+"]
    assert [r["g"] for r in rows] == ["0", "1-2", "1-2", "3-9", "3-9", "3-9", "3-9", "10+", "10+", "10+"]


def test_small_text_functions(spark):
    assert column(spark, ["2019 Mar", "Mar 2020 x", "no", None], tx.year_token) == ["2019", "2020", None, None]
    assert column(spark, ["One a. Two b. Three", "no stop", "e.g. this. Ünder", None], tx.first_sentence) == ["One a.", "no stop", "e.g. this.", None]
    assert column(spark, ["a, B ,a,,nan", None], tx.split_symbols) == [["A", "B"], None]
    assert column(spark, ["Ada;Bo", "Ada", ""], tx.author_short) == ["Ada et al.", "Ada", None]
