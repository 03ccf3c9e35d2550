"""Connected components by minimum-edge contraction (Borůvka), with the forest kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

MAX_ROUNDS = 64


@dataclass(frozen=True)
class SpanningForest:
    """edges (u, v, round): a spanning forest. roots (v, root): each vertex with an edge; root is the least
    vertex of its component."""

    edges: DataFrame
    roots: DataFrame


def _resolve(hooks: DataFrame) -> DataFrame:
    """(c, root) of hooks (c, p), in which following p from any c ends in a pair that points at each other."""
    back = hooks.select(F.col("c").alias("p"), F.col("p").alias("back"))
    parent = cut_lineage(
        hooks.join(back, "p", "left").select(
            "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")
        )
    )
    for _ in range(MAX_ROUNDS):
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("q"))
        jumped = cut_lineage(parent.join(up, "p").select("c", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
        parent = jumped.select("c", "p")
        if jumped.filter("moved").isEmpty():
            return parent.select("c", F.col("p").alias("root"))
    raise RuntimeError("pointer jumping did not end")


def spanning_forest(edges: DataFrame) -> SpanningForest:
    """Spanning forest of the undirected graph of edges (u, v).

    In each round every component takes its minimum edge to another (a random but fixed total order
    of edges keeps the hooked chains short), hooked components are contracted by pointer jumping,
    and edges are relabelled; edges within a component and parallel edges go. The number of
    components that still have edges at least halves in a round. Every stage aggregates before it
    shuffles; a vertex that has a third of all edges is met by joins that adaptive execution splits.
    Each round is written to the shared checkpoint folder, and so is the forest.

    Null ends, loops and repeated edges are dropped; an empty input gives an empty forest. Extra
    columns are ignored. Vertices may be of any orderable type.
    """
    kind = edges.schema["u"].dataType
    clean = (
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("u").isNull().alias("a"), F.col("v").isNull().alias("b"))
        .filter("NOT a AND NOT b AND u <> v")
        .select("u", "v")
        .distinct()
    )
    # cu, cv: components of u and v; w: place of the edge in the total order
    live = cut_lineage(clean.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"), F.xxhash64("u", "v").alias("w")))
    spark = edges.sparkSession
    forest = spark.createDataFrame([], clean.schema).withColumn("round", F.lit(0))
    maps: list[DataFrame] = []
    for turn in range(1, MAX_ROUNDS + 1):
        if live.isEmpty():
            break
        pick = F.struct("w", "u", "v", "other")
        best = cut_lineage(
            live.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("cv").alias("other")), F.struct(F.col("cv").alias("c"), F.col("cu").alias("other")))).alias("e"), "u", "v", "w")
            .select("e.c", "e.other", "u", "v", "w")
            .groupBy("c")
            .agg(F.min(pick).alias("m"))
            .select("c", "m.other", "m.u", "m.v")
        )
        forest = forest.unionByName(best.select("u", "v").distinct().withColumn("round", F.lit(turn)))
        roots = _resolve(best.select("c", F.col("other").alias("p")))
        maps.append(roots)
        left, right = (roots.select(F.col("c").alias(k), F.col("root").alias(f"r{k}")) for k in ("cu", "cv"))
        live = cut_lineage(
            live.join(left, "cu").join(right, "cv").filter("rcu <> rcv")
            .select(F.least("rcu", "rcv").alias("cu"), F.greatest("rcu", "rcv").alias("cv"), F.struct("w", "u", "v").alias("m"))
            .groupBy("cu", "cv")
            .agg(F.min("m").alias("m"))
            .select("m.u", "m.v", "cu", "cv", "m.w")
        )
    if not maps:
        empty = spark.createDataFrame([], f"v {kind.simpleString()}, root {kind.simpleString()}")
        return SpanningForest(forest, empty)
    labels = maps[0].select(F.col("c").alias("v"), "root")
    for step in maps[1:]:
        labels = labels.join(step.select(F.col("c").alias("root"), F.col("root").alias("top")), "root", "left").select(
            "v", F.coalesce("top", "root").alias("root")
        )
    least = labels.groupBy("root").agg(F.min("v").alias("least"))
    labels = labels.join(least, "root").select("v", F.col("least").alias("root"))
    return SpanningForest(cut_lineage(forest), cut_lineage(labels))
