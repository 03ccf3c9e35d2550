"""What several query modules read, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.session import read_table


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split_assignments with the split each label names, however written; null where it names none."""
    return read_table(spark, sf_dir, "split_assignments").withColumn("split", tx.split_label(F.col("split")))


_WORD = "regexp_replace(lower(split), '[^a-z]', '', 'g')"
ASSIGNED = f"""(SELECT * REPLACE (CASE WHEN {_WORD} LIKE 'train%' THEN 'train' WHEN {_WORD} LIKE 'val%' THEN 'validation' WHEN {_WORD} LIKE 'test%' THEN 'test' END AS split) FROM split_assignments)"""

_BARE = r"regexp_replace(smiles, '[\s\x{a0}]+', '', 'g')"
STRUCTURE = f"""CASE WHEN regexp_matches({_BARE}, '[A-Za-z]')
    AND lower({_BARE}) NOT IN ('none', 'null', 'nan', 'na', 'n/a', 'n.a.', '[notavailable]', 'notavailable', 'unknown', 'missing') THEN {_BARE} END"""


def accession_sql(column: str) -> str:
    return f"nullif(regexp_extract({column}, '(?i)PA[^0-9A-Za-z]*0*([0-9]+)', 1), '')"
