"""Ranks of query vectors against all vectors, scored in blocks. The product of queries and vectors is never stored."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.positions import global_position
from graphloom.session import cut_lineage


def _pairs(queries: DataFrame, vectors: DataFrame, query_block: int, n_queries: int, vector_blocks: int) -> tuple[DataFrame, DataFrame]:
    placed = global_position(queries, ["vec_id"], "__p")
    q = placed.withColumn("qb", F.floor(F.col("__p") / query_block)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))))
    last = max(0, math.ceil(n_queries / query_block) - 1)
    v = vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(vector_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    renamed = v.select(F.col("qb").alias("vqb"), F.col("vb").alias("vvb"), F.col("vec_id").alias("v_id"), F.col("embedding").alias("v_embedding"), F.col("label").alias("v_label"))
    return q.drop("__p"), renamed


def best_match_ranks(vectors: DataFrame, queries: DataFrame, *, query_block: int = 512, vector_block: int = 8192) -> DataFrame:
    """(query_id, n_positives, best_score, rank) for queries and vectors (vec_id, embedding, label).

    A query's positives are the other vectors of its label; rank is 1 + the vectors of other labels
    with a greater dot product than its best positive. Null vectors or labels don't count, and a
    query without positives has null scores and rank. Each task holds one block of queries and one
    of vectors; per block only one number a query is kept.
    """
    clean = "vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL"
    vectors, queries = (d.filter(clean).select("vec_id", "embedding", "label") for d in (vectors, queries))
    n_queries, n_vectors = queries.count(), vectors.count()
    blocks = max(1, math.ceil(n_vectors / vector_block))
    q, v = _pairs(queries, vectors, query_block, n_queries, blocks)

    def scores(left: pd.DataFrame, right: pd.DataFrame):
        a, b = (np.array(c.tolist(), float) for c in (left["embedding"], right["v_embedding"]))
        same = left["label"].to_numpy()[:, None] == right["v_label"].to_numpy()[None, :]
        own = left["vec_id"].to_numpy()[:, None] == right["v_id"].to_numpy()[None, :]
        return np.round(a @ b.T, 9), same & ~own, ~same

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "n": [], "best": []})
        s, positive, _ = scores(left, right)
        return pd.DataFrame({"query_id": left["vec_id"], "n": positive.sum(1), "best": np.where(positive, s, -np.inf).max(1)})

    def better(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "n": []})
        s, _, negative = scores(left, right)
        return pd.DataFrame({"query_id": left["vec_id"], "n": (negative & (s > left["best"].to_numpy()[:, None])).sum(1)})

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("vqb", "vvb")).applyInPandas(best, "query_id bigint, n bigint, best double")
    top = found.groupBy("query_id").agg(F.sum("n").alias("n_positives"), F.max(F.when(F.col("n") > 0, F.col("best"))).alias("best_score"))
    asked = q.join(top.filter("n_positives > 0").select(F.col("query_id").alias("vec_id"), F.col("best_score").alias("best")), "vec_id")
    counts = asked.groupBy("qb", "vb").cogroup(v.groupBy("vqb", "vvb")).applyInPandas(better, "query_id bigint, n bigint").groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))
    return top.join(counts, "query_id", "left").select("query_id", "n_positives", "best_score", "rank")


def relation_ranks(triples: DataFrame, features: DataFrame, relations: DataFrame, genes: DataFrame, known: DataFrame | None = None, marked: DataFrame | None = None, *, query_block: int = 512, gene_block: int = 8192) -> DataFrame:
    """(drug_idx, gene_idx, rel, rank, best_gene, marked): each distinct triple's rank among all genes, scored with its own relation's vector.

    A gene's score is the sum of drug * relation * gene over features (node, x) and relations (rel, r); rank is 1 + genes with a strictly higher score. With
    known (drug_idx, gene_idx) the drug's other known genes don't count. best_gene has the highest score, the smaller of equal ones; marked tells
    whether the drug is in marked (drug_idx), for drugs with a fingerprint. Triples whose drug, gene or relation has no vector drop out. Queries meet
    genes in blocks, of which a few numbers a query are kept.
    """
    x = features.select("node", F.col("x").cast("array<double>").alias("x"))
    asked = triples.select("drug_idx", "gene_idx", "rel").distinct()
    asked = asked.join(relations.select("rel", F.col("r").cast("array<double>").alias("r")), "rel").join(x.select(F.col("node").alias("drug_idx"), F.col("x").alias("xd")), "drug_idx").join(x.select(F.col("node").alias("gene_idx"), F.col("x").alias("xg")), "gene_idx")
    query = F.zip_with("xd", "r", lambda a, b: a * b)
    asked = asked.select("drug_idx", "gene_idx", "rel", query.alias("q"), "xg")
    if known is None:
        asked = asked.withColumn("known", F.array().cast("array<bigint>"))
    else:
        lists = known.groupBy("drug_idx").agg(F.array_sort(F.collect_set(F.col("gene_idx").cast("bigint"))).alias("known"))  # a drug's distinct genes
        asked = asked.join(lists, "drug_idx", "left").withColumn("known", F.coalesce("known", F.array().cast("array<bigint>")))
    asked = cut_lineage(asked)
    pool = cut_lineage(genes.select("gene_idx").distinct().join(x.withColumnRenamed("node", "gene_idx"), "gene_idx"))
    n_queries, n_genes = asked.count(), pool.count()
    blocks, last = max(1, math.ceil(n_genes / gene_block)), max(0, math.ceil(n_queries / query_block) - 1)
    placed = global_position(asked, ["drug_idx", "gene_idx", "rel"], "__p").withColumn("qb", F.floor(F.col("__p") / query_block)).withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = pool.select(F.col("gene_idx").alias("g"), "x", F.pmod(F.xxhash64("gene_idx"), F.lit(blocks)).cast("int").alias("ggb")).withColumn("gqb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"drug_idx": [], "gene_idx": [], "rel": [], "n": [], "top": [], "best": []})
        right = right.sort_values("g")
        g, y = right["g"].to_numpy(), np.array(right["x"].tolist(), float)
        q = np.array(left["q"].tolist(), float)
        own = np.round((q * np.array(left["xg"].tolist(), float)).sum(1), 9)
        scores = np.round(q @ y.T, 9)
        for i, (mine, others) in enumerate(zip(left["gene_idx"], left["known"], strict=True)):
            others = np.asarray(others, np.int64)
            scores[i, np.isin(g, others[others != mine])] = -np.inf
        best = scores.argmax(1)
        return pd.DataFrame({"drug_idx": left["drug_idx"], "gene_idx": left["gene_idx"], "rel": left["rel"], "n": (scores > own[:, None]).sum(1), "top": scores[np.arange(len(q)), best], "best": g[best]})

    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in ("drug_idx", "gene_idx", "rel"))
    met = placed.groupBy("qb", "gb").cogroup(spread.groupBy("gqb", "ggb")).applyInPandas(compare, f"{kinds}, n bigint, top double, best bigint")
    ranks = met.groupBy("drug_idx", "gene_idx", "rel").agg((F.sum("n") + 1).alias("rank"), F.max_by("best", F.struct("top", -F.col("best"))).alias("best_gene"))
    if marked is None:
        return ranks.withColumn("marked", F.lit(False))
    return ranks.join(marked.select("drug_idx").distinct().withColumn("marked", F.lit(True)), "drug_idx", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
