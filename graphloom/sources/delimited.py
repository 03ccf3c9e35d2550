"""Delimited files, gene sets and literature records as DataFrames."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators.positions import global_position
from graphloom.operators.quality import require_columns


def clean_header(name: str) -> str:
    """A column name without byte-order mark, trimmed, with single spaces."""
    return re.sub(r"\s+", " ", name.replace("\ufeff", "")).strip()


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A file with header, every column a string, tokens for missing values as null.

    The separator is a tab for .tsv and .txt and a comma otherwise. Quotes are doubled within
    quoted fields, which may hold line breaks. No inference, so the file is read once.
    """
    sep = sep or ("\t" if path.endswith((".tsv", ".txt", ".tsv.gz", ".txt.gz")) else ",")
    raw = spark.read.options(sep=sep, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, encoding="UTF-8").csv(path)
    named = clean_columns(raw)
    return named.select(*[tx.null_tokens(F.col(f"`{c}`")).alias(c) for c in named.columns])


def find_file(spark: SparkSession, folder: str, stem: str, suffixes: Sequence[str] = (".tsv", ".csv", ".txt")) -> str:
    """The first file below folder, in order of path, whose name has the stem and one of the suffixes; on any file system Spark reads."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    hit = listed.filter(name.contains(stem) & F.lower(name).rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$")).agg(F.min("path")).first()[0]
    if hit is None:
        raise FileNotFoundError(f"no file for {stem} in {folder}")
    return hit


def pick_column(df: DataFrame, names: Sequence[str], label: str) -> str:
    """The column that matches names best: as written before whatever the case, then by the order of names."""
    matches = [(column != name, place, column) for place, name in enumerate(names) for column in df.columns if column.casefold() == name.casefold()]
    if not matches:
        raise KeyError(f"no column for {label}: tried {list(names)}")
    return min(matches)[2]


# The files of a delivery with the columns of id and name for each node type, and the columns of relationships.
NODE_FILES = {
    "drug": ("chemicals.tsv", "PharmGKB Accession Id", "Name"),
    "gene": ("genes.tsv", "PharmGKB Accession Id", "Symbol"),
    "phenotype": ("phenotypes.tsv", "PharmGKB Accession Id", "Name"),
    "variant": ("variants.tsv", "Variant ID", "Variant Name"),
}
RELATIONSHIPS = ("Entity1_id", "Entity1_name", "Entity1_type", "Entity2_id", "Entity2_name", "Entity2_type", "Evidence", "Association", "PK", "PD", "PMIDs")


def read_delivery(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, node_name, node_type) and relationships of the five tables of a delivery.

    A node without id is dropped, one without name keeps a null; an id that stands twice in its table keeps the least name. A missing
    column is an error that names it.
    """
    nodes = None
    for kind, (file, key, name) in NODE_FILES.items():
        table = require_columns(read_delimited(spark, f"{folder}/{file}"), (key, name), file)
        rows = table.select(tx.clean_text(F.col(f"`{key}`")).alias("node_id"), tx.clean_text(F.col(f"`{name}`")).alias("node_name"))
        one = rows.filter("node_id IS NOT NULL").groupBy("node_id").agg(F.min("node_name").alias("node_name")).withColumn("node_type", F.lit(kind))
        nodes = one if nodes is None else nodes.unionByName(one)
    table = require_columns(read_delimited(spark, f"{folder}/relationships.tsv"), RELATIONSHIPS, "relationships.tsv")
    relationships = table.select(*[F.col(f"`{c}`").alias(c.lower()) for c in RELATIONSHIPS])
    return nodes, global_position(relationships, relationships.columns, "rel_id")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def parse_gmt(lines: DataFrame, source: Column | str) -> DataFrame:
    """(source, set_id, gene) of lines (value): name, description, genes, tab-separated.

    Lines of fewer than three fields are skipped; a set that stands twice keeps its last line
    (by ``line_no`` where given); genes are upper-cased and distinct.
    """
    fields = lines.withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 3).withColumn("source", source if isinstance(source, Column) else F.lit(source))
    order = F.col("line_no") if "line_no" in lines.columns else F.monotonically_increasing_id()
    last = fields.withColumn("n", order).groupBy("source", F.trim(F.col("f")[0]).alias("set_id")).agg(F.max_by("f", "n").alias("f"))
    genes = F.array_distinct(F.filter(F.transform(F.slice("f", F.lit(3), F.size("f") - 2), lambda g: F.upper(F.trim(g))), lambda g: ~F.lower(g).isin(*tx.NULL_TEXT)))
    return last.select("source", "set_id", F.explode(genes).alias("gene"))


def read_gmt(spark: SparkSession, folder: str) -> DataFrame:
    """Gene sets of all .gmt files below folder; the source is told by the file name."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[gG][mM][tT]").text(folder).withColumn("path", F.upper(F.input_file_name()))
    source = F.when(F.col("path").contains("REACTOME"), "REACTOME").when(F.col("path").contains("KEGG"), "KEGG").otherwise("OTHER")
    return parse_gmt(lines, source)


def read_pathway_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(source, set_id, gene): the comma-separated genes column of each table PA<digits>-*.tsv below folder.

    All files are one read, a row each, parsed where they are read, since their columns differ; a table without a genes column is an error.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "PA*-*.tsv").text(folder, wholetext=True)
    named = files.select(_stem(F.col("_metadata.file_path")).alias("stem"), "value").filter(F.col("stem").rlike(r"^PA\d+-"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems, fields = [], []
            for stem, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = csv.reader(io.StringIO(text, newline=""), delimiter="\t")
                header = [clean_header(h).casefold() for h in next(rows, [])]
                if "genes" not in header:
                    raise KeyError(f"no column for genes in {stem}")
                at = header.index("genes")
                for row in rows:
                    if len(row) > at:
                        stems.append(stem)
                        fields.append(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(fields, pa.string())], names=["stem", "genes"])

    parsed = named.mapInArrow(parse, "stem string, genes string")
    set_id = F.concat(F.lit("PGKB::"), F.regexp_replace("stem", "^([^-]*)-", "$1_"))
    return parsed.select(F.lit("PGKB").alias("source"), set_id.alias("set_id"), F.explode(tx.split_symbols("genes")).alias("gene")).distinct()


def merge_gene_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both collections; a set of the second takes the place of one of the same name in the first."""
    return first.join(second.select("set_id").distinct(), "set_id", "left_anti").unionByName(second)


# Record layout of article summaries, as files hold them one JSON object a line.
SUMMARY = "pmid string, title string, journal string, pubdate string, authors array<string>, doi string, drug string, gene string"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Article summaries from JSON lines with year and citation; records without title or journal are dropped."""
    raw = spark.read.schema(SUMMARY).json(path)
    kept = raw.filter(tx.clean_text("title").isNotNull() & tx.clean_text("journal").isNotNull())
    named = kept.withColumn("year", tx.year_token("pubdate")).withColumn("author_list", F.array_join("authors", ";"))
    return named.withColumn("citation", tx.citation("author_list", "title", "journal", "year")).drop("author_list")


def parse_abstracts(xml: DataFrame) -> DataFrame:
    """(pmid, abstract) of documents (xml), one article each: sections joined, with their label before a colon."""
    texts = F.expr("xpath(xml, '//AbstractText/text()')")
    labels = F.expr("transform(xpath(xml, '//AbstractText/@Label'), x -> concat(x, ': '))")
    whole = F.when(F.size(labels) == F.size(texts), F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, b)), " ")).otherwise(F.array_join(texts, " "))
    return xml.select(F.expr("xpath_string(xml, '//PMID')").alias("pmid"), whole.alias("abstract"))


def literature_evidence(pairs: DataFrame, articles: DataFrame, most: int = 10) -> DataFrame:
    """One row per pair and article, the newest ``most`` of a pair; a pair without articles keeps a row of nulls."""
    best = Window.partitionBy("drug", "gene").orderBy(F.desc_nulls_last("year"), "pmid")
    kept = articles.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most).drop("n")
    return pairs.select("drug", "gene").distinct().join(kept, ["drug", "gene"], "left")
