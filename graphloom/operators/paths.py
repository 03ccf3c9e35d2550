"""Distances, shortest paths and shared neighbourhoods for requested nodes and pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import block_search
from graphloom.session import cut_lineage


def symmetric(edges: DataFrame) -> DataFrame:
    """(u, v) in both directions, distinct, without loops and null ends."""
    ends = edges.filter("source_idx IS NOT NULL AND target_idx IS NOT NULL AND source_idx <> target_idx")
    both = F.array(F.struct(F.col("source_idx").alias("u"), F.col("target_idx").alias("v")), F.struct(F.col("target_idx").alias("u"), F.col("source_idx").alias("v")))
    return ends.select(F.inline(both)).distinct()


def khop(neighbours: DataFrame, sources: DataFrame, max_hops: int | None) -> DataFrame:
    """As joined_khop; in blocks of sources if a task can hold the graph."""
    if (links := block_search.held(neighbours)) is not None:
        return block_search.khop(links, cut_lineage(sources.select("source").dropna().distinct()), max_hops)
    return joined_khop(neighbours, sources, max_hops)


def joined_khop(neighbours: DataFrame, sources: DataFrame, max_hops: int | None) -> DataFrame:
    """(source, node, distance, n_paths) of all nodes within max_hops (None: any number) of each source, the source itself at 0.

    Breadth first from all sources at once: a frontier is joined with the neighbours, added up by
    (source, node), and nodes met before are dropped. Each hop is stored and later hops read that.
    n_paths counts the shortest paths. Sources that have no edge reach themselves; null sources are dropped.
    """
    start = sources.filter("source IS NOT NULL").select("source").distinct()
    level = cut_lineage(start.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("distance"), F.lit(1).cast("bigint").alias("n_paths")))
    reached = level
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        step = level.join(neighbours, level["node"] == neighbours["u"]).groupBy("source", F.col("v").alias("node")).agg(F.sum("n_paths").alias("n_paths"))
        fresh = step.join(reached.select("source", "node"), ["source", "node"], "left_anti")
        level = cut_lineage(fresh.select("source", "node", F.lit(hop).cast("bigint").alias("distance"), "n_paths"))
        if max_hops is None and level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def shortest_paths(neighbours: DataFrame, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """(drug_idx, gene_idx, length, n_paths): length and number of shortest paths up to max_hops; nulls and 0 beyond.

    The two ends are searched to half the length each and meet in the middle, so a hub is expanded
    to half the depth only.
    """
    half = (max_hops + 1) // 2
    ends = pairs.select(F.explode(F.array("drug_idx", "gene_idx")).alias("source"))
    ball = joined_khop(neighbours, ends, half)
    a = ball.select(F.col("source").alias("drug_idx"), "node", F.col("distance").alias("da"), F.col("n_paths").alias("ca"))
    b = ball.select(F.col("source").alias("gene_idx"), "node", F.col("distance").alias("db"), F.col("n_paths").alias("cb"))
    met = pairs.select("drug_idx", "gene_idx").distinct().join(a, "drug_idx").join(b, ["gene_idx", "node"]).filter(F.col("da") + F.col("db") <= max_hops)
    # every path is counted once, at its node ``half`` steps from the drug (or at the gene, if that is nearer)
    once = (F.col("da") == half) | ((F.col("da") < half) & (F.col("db") == 0))
    by_length = met.groupBy("drug_idx", "gene_idx", (F.col("da") + F.col("db")).alias("length")).agg(F.sum(F.when(once, F.col("ca") * F.col("cb")).otherwise(0)).alias("n"))
    best = by_length.groupBy("drug_idx", "gene_idx").agg(F.min(F.struct("length", "n")).alias("m"))
    return pairs.select("drug_idx", "gene_idx").distinct().join(best, ["drug_idx", "gene_idx"], "left").select("drug_idx", "gene_idx", "m.length", F.coalesce("m.n", F.lit(0)).alias("n_paths"))


def all_shortest_paths(neighbours: DataFrame, pairs: DataFrame, near: int = 4) -> DataFrame:
    """As shortest_paths, without a limit: in blocks of pairs, or on graphs that no task holds by joins, where pairs farther apart
    than ``near`` are searched from the drug to the end."""
    if (links := block_search.held(neighbours)) is not None:
        asked = cut_lineage(pairs.select("drug_idx", "gene_idx").distinct())
        nowhere = asked.filter("drug_idx IS NULL OR gene_idx IS NULL").select("drug_idx", "gene_idx", F.lit(None).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("n_paths"))
        return block_search.shortest_paths(links, asked.dropna()).unionByName(nowhere)
    first = cut_lineage(shortest_paths(neighbours, pairs, near))
    far = first.filter("length IS NULL").select("drug_idx", "gene_idx")
    ball = joined_khop(neighbours, far.select(F.col("drug_idx").alias("source")), None)
    ends = ball.select(F.col("source").alias("drug_idx"), F.col("node").alias("gene_idx"), F.col("distance").alias("length"), "n_paths")
    rest = far.join(ends, ["drug_idx", "gene_idx"], "left").select("drug_idx", "gene_idx", "length", F.coalesce("n_paths", F.lit(0)).alias("n_paths"))
    return first.filter("length IS NOT NULL").unionByName(rest)


def listed_paths(neighbours: DataFrame, pairs: DataFrame, ball: DataFrame, keep: int = 3) -> DataFrame:
    """(drug_idx, gene_idx, place, path): the first ``keep`` shortest paths of each pair as arrays of nodes, whatever their length.

    ball has (source, node, distance) of the drugs, as far as their genes are to be found. Paths are read from the gene back,
    always to a node one step nearer the drug, and are ordered by their nodes in that order; since every part of a
    path can be finished, ``keep`` parts of a pair are enough at each step.
    """
    toward = ball.select(F.col("source").alias("drug_idx"), "node", "distance")
    ends = pairs.select("drug_idx", "gene_idx").distinct().join(toward.withColumnRenamed("node", "gene_idx"), ["drug_idx", "gene_idx"])
    walk = cut_lineage(ends.select("drug_idx", "gene_idx", F.col("gene_idx").alias("node"), "distance", F.array("gene_idx").alias("path"), F.lit(1).alias("place")))
    done = walk.filter("distance = 0")
    first = Window.partitionBy("drug_idx", "gene_idx").orderBy("place", "node")
    for _ in range(walk.agg(F.max("distance")).first()[0] or 0):
        step = walk.filter("distance > 0").select("drug_idx", "gene_idx", F.col("node").alias("u"), (F.col("distance") - 1).alias("distance"), "path", "place").join(neighbours, "u")
        near = step.withColumnRenamed("v", "node").join(toward, ["drug_idx", "node", "distance"])
        ranked = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep)
        walk = cut_lineage(ranked.select("drug_idx", "gene_idx", "node", "distance", F.concat(F.array("node"), "path").alias("path"), F.col("n").alias("place")))
        done = done.unionByName(walk.filter("distance = 0"))
    return done.select("drug_idx", "gene_idx", F.col("place").cast("bigint").alias("place"), "path")


STEPS = "zip_with(slice(path, 1, size(path) - 1), slice(path, 2, size(path) - 1), (a, b) -> named_struct('u', a, 'v', b))"
FEW = 100_000  # rows that are sent to every task


def few(df: DataFrame) -> DataFrame:
    """df, stored, and sent to every task of a join if it has no more than FEW rows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= FEW else df


def path_texts(paths: DataFrame, names: DataFrame, relations: DataFrame) -> DataFrame:
    """(drug_idx, gene_idx, shortest_paths, shortest_path_relations) of listed_paths: ``name[type] -> ...`` and the relations along
    each path with bars between; paths are divided by double bars. names has (node, name, node_type), relations (u, v, relation_type)."""
    nodes = paths.select("drug_idx", "gene_idx", "place", F.posexplode("path").alias("step", "node")).join(names, "node", "left")
    said = F.format_string("%s[%s]", F.coalesce("name", F.col("node").cast("string")), F.coalesce("node_type", F.lit("?")))
    ends = paths.select("drug_idx", "gene_idx", "place", F.posexplode(F.expr(STEPS)).alias("step", "e"))
    links = ends.select("drug_idx", "gene_idx", "place", "step", "e.u", "e.v").join(relations, ["u", "v"], "left")

    def joined(df: DataFrame, text, between: str, name: str) -> DataFrame:
        """One text a pair: in order of step within a path, and of paths."""
        one = df.groupBy("drug_idx", "gene_idx", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", text.alias("t")))), lambda x: x["t"]), between).alias("t"))
        return one.groupBy("drug_idx", "gene_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), " || ").alias(name))

    walked = joined(nodes, said, " -> ", "shortest_paths")
    return walked.join(joined(links, F.coalesce("relation_type", F.lit("unknown")), " | ", "shortest_path_relations"), ["drug_idx", "gene_idx"], "left")


def explain_pairs(neighbours: DataFrame, relations: DataFrame | Callable[[DataFrame], DataFrame], nodes: DataFrame, degree: DataFrame, pairs: DataFrame, max_hops: int = 4, keep: int = 3, top: int = 10) -> DataFrame:
    """One row a pair: names, length and texts of its first shortest paths, and of three types the nodes that both ends
    have within max_hops, with their number (``top`` at most).

    Path length has no limit. Pairs that aren't connected have a null length, no paths and empty texts. nodes has (node_index, node_name, node_type).
    relations (u, v, relation_type) may be a function that makes them of the links (u, v) on the paths.
    """
    pairs = cut_lineage(pairs.select("drug_idx", "gene_idx").distinct())
    names = nodes.select(F.col("node_index").alias("node"), F.coalesce(tx.clean_text("node_name"), F.col("node_index").cast("string")).alias("name"), "node_type")
    types = ("gene", "variant", "phenotype")
    if (links := block_search.held(neighbours)) is not None:
        asked = cut_lineage(pairs.dropna())
        told = cut_lineage(block_search.listed_paths(links, asked, keep))
        found = pairs.join(told.select("drug_idx", "gene_idx", "length"), ["drug_idx", "gene_idx"], "left")
        listed = told.select("drug_idx", "gene_idx", F.posexplode("paths").alias("place", "path")).withColumn("place", (F.col("place") + 1).cast("bigint"))
        shared = block_search.shared_by_type(links, asked, nodes, degree, types, max_hops, top)
    else:
        found = all_shortest_paths(neighbours, pairs)
        longest = found.agg(F.max("length")).first()[0] or 0
        ball = joined_khop(neighbours, pairs.select(F.explode(F.array("drug_idx", "gene_idx")).alias("source")), max(max_hops, longest))
        listed = cut_lineage(listed_paths(neighbours, pairs, ball, keep))
        shared = _shared(ball.filter(F.col("distance") <= max_hops), pairs, nodes, degree, types, top)
    if not isinstance(relations, DataFrame):
        listed = cut_lineage(listed)
        relations = relations(few(listed.select(F.explode(F.expr(STEPS)).alias("e")).select("e.u", "e.v").distinct()))
    out = found.select("drug_idx", "gene_idx", F.col("length").alias("shortest_path_length")).join(listed.groupBy("drug_idx", "gene_idx").agg(F.count(F.lit(1)).alias("n_shortest_paths")), ["drug_idx", "gene_idx"], "left")
    out = out.join(path_texts(listed, names, relations), ["drug_idx", "gene_idx"], "left").fillna({"n_shortest_paths": 0, "shortest_paths": "", "shortest_path_relations": ""})
    shared = shared.join(names.select("node", "name"), "node")
    said = F.format_string("%s(d=%d,g=%d)", "name", "drug_distance", "gene_distance")
    lists = cut_lineage(shared.groupBy("drug_idx", "gene_idx", "node_type").agg(F.array_sort(F.collect_list(F.struct("place", said.alias("t")))).alias("l")))
    for kind in types:
        text, number = f"shared_{kind}s_within_khop", f"n_shared_{kind}s"
        one = lists.filter(F.col("node_type") == kind).select("drug_idx", "gene_idx", F.array_join(F.transform("l", lambda x: x["t"]), "; ").alias(text), F.size("l").cast("bigint").alias(number))
        out = out.join(one, ["drug_idx", "gene_idx"], "left").fillna({text: "", number: 0})
    for end in ("drug", "gene"):
        out = out.join(names.select(F.col("node").alias(f"{end}_idx"), F.col("name").alias(f"{end}_name")), f"{end}_idx", "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", F.col(f"{end}_idx").cast("string")))
    return out


def shared_by_type(neighbours: DataFrame, pairs: DataFrame, nodes: DataFrame, degree: DataFrame, types: Sequence[str], max_hops: int = 4, top: int = 10) -> DataFrame:
    """Nodes of each type within max_hops of both ends of a pair, ends left out: of a type the ``top`` nearest by summed
    distance, then by falling degree, then by index."""
    if (links := block_search.held(neighbours)) is not None:
        return block_search.shared_by_type(links, cut_lineage(pairs.select("drug_idx", "gene_idx").dropna().distinct()), nodes, degree, tuple(types), max_hops, top)
    ball = joined_khop(neighbours, pairs.select(F.explode(F.array("drug_idx", "gene_idx")).alias("source")), max_hops)
    return _shared(ball, pairs, nodes, degree, types, top)


def _shared(ball: DataFrame, pairs: DataFrame, nodes: DataFrame, degree: DataFrame, types: Sequence[str], top: int) -> DataFrame:
    wanted = ball.join(nodes.filter(F.col("node_type").isin(*types)).select(F.col("node_index").alias("node"), "node_type"), "node")
    a = wanted.select(F.col("source").alias("drug_idx"), "node", "node_type", F.col("distance").alias("drug_distance"))
    b = wanted.select(F.col("source").alias("gene_idx"), "node", F.col("distance").alias("gene_distance"))
    met = pairs.select("drug_idx", "gene_idx").distinct().join(a, "drug_idx").join(b, ["gene_idx", "node"]).filter("node <> drug_idx AND node <> gene_idx")
    ranked = met.join(degree.select(F.col("node_idx").alias("node"), "degree"), "node").withColumn("distance", F.col("drug_distance") + F.col("gene_distance"))
    best = Window.partitionBy("drug_idx", "gene_idx", "node_type").orderBy("distance", F.desc("degree"), "node")
    kept = ranked.withColumn("place", F.row_number().over(best).cast("bigint")).filter(F.col("place") <= top)
    return kept.select("drug_idx", "gene_idx", "node_type", "node", "drug_distance", "gene_distance", "distance", "degree", "place")
