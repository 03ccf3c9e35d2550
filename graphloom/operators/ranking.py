"""Candidates, ranks, rank metrics, baselines and calibration. Ranks are optimistic: 1 + strictly better candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.group_ranks import MOST, better_before, light_and_heavy, over_groups
from graphloom.operators.positions import count_greater, global_position, with_position
from graphloom.session import cut_lineage

# The calibration grid, in the order in which ties are broken.
ALPHAS = (-2.0, -1.0, -0.5, -0.25, -0.10, -0.05, 0.0, 0.05, 0.10, 0.25, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0)


def candidates(scored: DataFrame) -> DataFrame:
    """One row per (drug, gene) with its best score and whether the pair is known as associated.

    Rows with a null key, or a null or NaN score, don't count.
    """
    clean = scored.filter("drug_idx IS NOT NULL AND gene_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    known = F.coalesce(F.max((F.col("association") == "associated").cast("int")), F.lit(0)) == 1
    return clean.groupBy("drug_idx", "gene_idx").agg(F.max("score").alias("score"), known.alias("known"), F.max("association").alias("label"))


def rank_known(pool: DataFrame, groups: Sequence[str] = ("drug_idx",), score: str = "score", filtered: bool = True, most: int = MOST) -> DataFrame:
    """Known pairs of the pool with their rank in their group; rows with a null in groups have none.

    filtered masks other known pairs: only unknown candidates can stand before one. Groups of at most ``most`` rows are
    ranked in one pass over rows shuffled once; in larger ones better candidates are counted by pre-added
    scores, so a group of any size is spread. Both give the same ranks.
    """
    light, heavy = light_and_heavy(pool, groups, most)
    columns = [*groups, *[c for c in pool.columns if c not in groups]]
    at_known, at_score = columns.index("known"), columns.index(score)

    def rank(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        known = table.column(at_known).to_numpy()
        better = better_before(group, table.column(at_score).to_numpy().astype(float), ~known if filtered else np.ones(len(known), bool))
        out = table.append_column("rank", pa.array(better + 1)).filter(table.column(at_known)).combine_chunks()
        return out.to_batches()[0] if len(out) else pa.RecordBatch.from_pylist([], schema=out.schema)

    fields = ", ".join(f"`{c}` {pool.schema[c].dataType.simpleString()}" for c in columns)
    ranked = over_groups(light, groups, columns, rank, fields + ", rank bigint")
    if heavy is None:
        return ranked
    weight = (~F.col("known")).cast("bigint") if filtered else F.lit(1).cast("bigint")
    better = count_greater(heavy, groups, score, weight, "better")
    spread = heavy.filter("known").join(better, [*groups, score]).withColumn("rank", (F.col("better") + 1).cast("bigint")).drop("better")
    return ranked.unionByName(spread)


def rank_metrics(ranks: DataFrame, by: Sequence[str] = (), cuts: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """MRR, hits, mean and lower median rank and n; zeros for no ranks (without groups)."""
    zero = F.lit(0.0)
    return ranks.groupBy(*by).agg(
        F.round(F.coalesce(F.avg(1 / F.col("rank")), zero), 6).alias("mrr"),
        *[F.round(F.coalesce(F.avg((F.col("rank") <= k).cast("int")), zero), 6).alias(f"hits_at_{k}") for k in cuts],
        F.round(F.coalesce(F.avg("rank"), zero), 6).alias("mean_rank"),
        F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY rank)"), zero).alias("median_rank"),
        F.count(F.lit(1)).alias("n"),
    )


def gene_degree(assignments: DataFrame, genes: DataFrame) -> DataFrame:
    """Training degree of every gene: distinct associated training pairs, 0 for none."""
    pairs = assignments.filter("split = 'train' AND association = 'associated' AND drug_idx IS NOT NULL AND gene_idx IS NOT NULL").select("drug_idx", "gene_idx").distinct()
    return genes.join(pairs.groupBy("gene_idx").agg(F.count(F.lit(1)).alias("n")), "gene_idx", "left").select("gene_idx", F.coalesce("n", F.lit(0)).cast("bigint").alias("degree"))


def zscore(df: DataFrame, value: Column, name: str) -> DataFrame:
    """value standardised over all rows by the population deviation; zeros if it is constant."""
    stats = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, F.when(F.col("__s") > 0, (value - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")  # one row


def degree_baseline(pool: DataFrame, degree: DataFrame) -> DataFrame:
    """Filtered ranks of known pairs if every candidate's score is its gene's training degree."""
    scored = pool.select("drug_idx", "gene_idx", "known").join(degree, "gene_idx").select("drug_idx", "gene_idx", "known", F.col("degree").cast("double").alias("score"))
    return rank_known(scored)


def hash_score(seed: Column | int, gene: str = "gene_idx") -> Column:
    """A fixed pseudo-random score in [0, 1) of a gene for a seed, by md5."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.col(gene).cast("string"))), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") / 4294967296.0


def random_baseline(pool: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Filtered ranks under random gene scores shared by all queries, per seed."""
    rows = pool.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")
    scored = pool.select("drug_idx", "gene_idx", "known").crossJoin(F.broadcast(rows)).withColumn("score", hash_score(F.col("seed")))
    return rank_known(scored, ("seed", "drug_idx"))


def ordinal_rank(degree: DataFrame) -> DataFrame:
    """Rank of genes by falling degree, ties by the smaller index."""
    return global_position(degree.withColumn("__d", -F.col("degree")), ["__d", "gene_idx"], "__p").select("gene_idx", "degree", (F.col("__p") + 1).alias("rank"))


def hub_weights(degree: DataFrame, power: float = 0.75) -> DataFrame:
    """degree^power, divided by the sum (share) and by the greatest (weight)."""
    raw = degree.withColumn("__w", F.pow(F.col("degree").cast("double"), power))
    totals = raw.agg(F.sum("__w").alias("__t"), F.max("__w").alias("__m"))
    def over(total: str) -> Column:
        return F.round(F.coalesce(F.col("__w") / F.nullif(F.col(total), F.lit(0.0)), F.lit(0.0)), 9)
    return raw.crossJoin(F.broadcast(totals)).select("gene_idx", over("__t").alias("share"), over("__m").alias("weight"))


def negative_samples(positives: DataFrame, genes: DataFrame, known: DataFrame, k: int, seed: int, attempts: int = 16) -> DataFrame:
    """(drug_idx, gene_idx, attempt, negative_idx): k genes for each positive pair that are no known positives of its drug.

    genes has gene_idx and a contiguous ``local_index``. Draws are uniform with replacement and fixed
    by md5 of seed, pair and attempt; draws that hit a known positive are passed over. Of the given
    attempts the first k that stand are kept. A pair that has fewer gets the rest, as attempts beyond the given ones,
    by draws among the places its drug doesn't know; a drug that knows all genes is an error.
    """
    if k < 1 or attempts < k:
        raise ValueError("k must be at least 1 and attempts at least k")
    n = genes.agg(F.count(F.lit(1)).alias("n_genes"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("drug_idx").cast("string"), F.col("gene_idx").cast("string"), F.col("attempt").cast("string"))
    draws = (
        positives.select("drug_idx", "gene_idx", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt")).crossJoin(F.broadcast(n))
        .withColumn("local_index", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.col("n_genes"))
        .join(genes.select(F.col("gene_idx").alias("negative_idx"), "local_index"), "local_index")
        .join(known.select("drug_idx", F.col("gene_idx").alias("negative_idx")), ["drug_idx", "negative_idx"], "left_anti")
    )
    first = Window.partitionBy("drug_idx", "gene_idx").orderBy("attempt")  # at most ``attempts`` rows
    kept = cut_lineage(draws.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k).select("drug_idx", "gene_idx", F.col("attempt").cast("bigint").alias("attempt"), "negative_idx"))
    had = kept.groupBy("drug_idx", "gene_idx").agg(F.count(F.lit(1)).alias("had"))
    pairs = positives.filter("drug_idx IS NOT NULL AND gene_idx IS NOT NULL").select("drug_idx", "gene_idx").distinct()
    lacking = cut_lineage(pairs.join(had, ["drug_idx", "gene_idx"], "left").withColumn("had", F.coalesce("had", F.lit(0))).filter(F.col("had") < k))
    if lacking.isEmpty():
        return kept
    free = cut_lineage(
        lacking.select("drug_idx").distinct().crossJoin(genes.select(F.col("gene_idx").alias("negative_idx"), "local_index"))
        .join(known.select("drug_idx", F.col("gene_idx").alias("negative_idx")), ["drug_idx", "negative_idx"], "left_anti")
    )
    sizes = free.groupBy("drug_idx").agg(F.count(F.lit(1)).alias("n_free"))
    none = lacking.join(sizes, "drug_idx", "left_anti").select("drug_idx").head(1)
    if none:
        raise ValueError(f"drug {none[0]['drug_idx']} knows all genes; there is no negative for it")
    numbered = with_position(free, ["drug_idx"], ["local_index"], "__place", buckets=64)
    more = (
        lacking.select("drug_idx", "gene_idx", F.explode(F.sequence(F.lit(attempts + 1).cast("bigint"), F.lit(attempts + k) - F.col("had"))).alias("attempt")).join(sizes, "drug_idx")
        .withColumn("__place", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.col("n_free"))
        .join(numbered.select("drug_idx", "__place", "negative_idx"), ["drug_idx", "__place"])
    )
    return kept.unionByName(more.select("drug_idx", "gene_idx", "attempt", "negative_idx"))


def weighted_negatives(positives: DataFrame, degree: DataFrame, known: DataFrame, k: int, seed: int, attempts: int = 16, power: float = 0.75, grain: int = 16) -> DataFrame:
    """As negative_samples, genes being drawn in proportion to degree^power among those with a degree.

    A gene owns round(grain * degree^power) numbered slots and a draw names a slot, so drawing is an
    equi-join; weights are exact to 1/grain.
    """
    slots = degree.filter("degree > 0").select("gene_idx", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(grain * F.pow(F.col("degree").cast("double"), power)).cast("int")))).alias("slot"))
    numbered = global_position(slots, ["gene_idx", "slot"], "local_index").select("gene_idx", "local_index")
    return negative_samples(positives, numbered, known, k, seed, attempts)


def top_candidates(pool: DataFrame, k: int = 25) -> DataFrame:
    """The k best unknown genes of a drug; the limit is applied within input partitions first."""
    best = Window.partitionBy("drug_idx").orderBy(F.desc("score"), "gene_idx")
    return pool.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("drug_idx", "gene_idx", "score", "known", F.col("place").cast("bigint").alias("place"))


def alternatives(pool: DataFrame, k: int = 5) -> DataFrame:
    """Per ambiguous pair: its raw rank and the k best other genes of the drug that aren't known, best first."""
    asked = pool.withColumn("asked", F.col("label") == "ambiguous")
    ranks = rank_known(asked.drop("known").withColumnRenamed("asked", "known").withColumn("known", F.coalesce("known", F.lit(False))), filtered=False)
    best = Window.partitionBy("drug_idx").orderBy(F.desc("score"), "gene_idx")
    offered = pool.filter("NOT known").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).select("drug_idx", F.col("gene_idx").alias("alt"), "place")
    paired = ranks.select("drug_idx", "gene_idx", "rank").join(offered, "drug_idx", "left").filter("alt IS NULL OR alt <> gene_idx")
    lists = paired.groupBy("drug_idx", "gene_idx", "rank").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "alt"))), lambda x: x["alt"]), 1, k).alias("alternatives"))
    return ranks.select("drug_idx", "gene_idx", "rank").join(lists, ["drug_idx", "gene_idx", "rank"], "left").withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<bigint>")))


# The action for a rank as a share of the candidates, in the order in which they are tried.
ACTIONS = (("<=", 0.05, "upgrade_to_associated"), ("<=", 0.20, "lean_associated"), (">=", 0.95, "downgrade_to_not_associated"), (">=", 0.80, "lean_not_associated"))


def curator_action(share: Column) -> Column:
    out = F
    for sign, bound, action in ACTIONS:
        out = out.when(share <= bound if sign == "<=" else share >= bound, action)
    return out.otherwise("remains_ambiguous")


def recuration(pool: DataFrame, k: int = 5) -> DataFrame:
    """Per ambiguous pair: raw rank, number of candidates, rank as a share of them, 1 / rank, the action this suggests, and the k best other
    genes of the drug that aren't known, each with its own raw rank, best first."""
    sizes = pool.groupBy("drug_idx").agg(F.count(F.lit(1)).alias("n_candidates"))
    asked = alternatives(pool, k).join(sizes, "drug_idx")
    better = count_greater(pool, ["drug_idx"], "score", F.lit(1).cast("bigint"), "better")
    offered = asked.select("drug_idx", "gene_idx", F.posexplode("alternatives").alias("place", "alt"))
    scores = pool.select("drug_idx", F.col("gene_idx").alias("alt"), "score")
    ranked = offered.join(scores, ["drug_idx", "alt"]).join(better, ["drug_idx", "score"]).withColumn("said", F.concat(F.col("alt").cast("string"), F.lit(" (r="), (F.col("better") + 1).cast("string"), F.lit(")")))
    texts = ranked.groupBy("drug_idx", "gene_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "; ").alias("top_alternatives"))
    share = F.col("rank") / F.col("n_candidates")
    return asked.join(texts, ["drug_idx", "gene_idx"], "left").select(
        "drug_idx", "gene_idx", "rank", "n_candidates", F.round(share, 6).alias("rank_percentile"), F.round(1 / F.col("rank"), 6).alias("priority"), curator_action(share).alias("action"), F.coalesce("top_alternatives", F.lit("")).alias("top_alternatives")
    )


def modal_relation(assignments: DataFrame) -> DataFrame:
    """Most frequent forward drug-gene relation of the training rows, ties by name."""
    counts = assignments.filter("split = 'train' AND source_type = 'drug' AND target_type = 'gene'").groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "relation_type").limit(1)


def compare_ranks(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("drug_idx", "gene_idx")) -> DataFrame:
    """Paired ranks of two rankers with the difference of reciprocal ranks and the outcome for a."""
    joined = a.select(*keys, F.col("rank").alias("rank_a")).join(b.select(*keys, F.col("rank").alias("rank_b")), list(keys))
    return joined.withColumn("delta_rr", 1 / F.col("rank_a") - 1 / F.col("rank_b")).withColumn(
        "outcome", F.when(F.col("rank_a") < F.col("rank_b"), "win").when(F.col("rank_a") > F.col("rank_b"), "loss").otherwise("tie")
    )


def comparison_summary(paired: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("outcome") == o).alias(c) for o, c in (("win", "wins"), ("tie", "ties"), ("loss", "losses"))],
        F.round(F.avg("delta_rr"), 6).alias("delta_mrr"),
        F.round(F.avg((F.col("rank_a") <= 10).cast("int") - (F.col("rank_b") <= 10).cast("int")), 6).alias("delta_hits_at_10"),
        F.round(F.median("rank_a"), 6).alias("median_a"), F.round(F.median("rank_b"), 6).alias("median_b"),
    )


def calibration_grid(pool: DataFrame, degree: DataFrame, alphas: Sequence[float] = ALPHAS, most: int = MOST) -> DataFrame:
    """(alpha, position, mrr, chosen): z(score) + alpha * z(log1p degree) ranked for every alpha.

    The chosen alpha has the best MRR, then the least |alpha|, then the earliest position. Scores
    are standardised within a drug, and rounded so that equal inputs stay ties. The pool is shuffled by drug once; all alphas
    are tried on a drug's candidates where they are, and only counts leave. Drugs of more than ``most`` candidates are spread instead.
    """
    per_drug = pool.groupBy("drug_idx").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    z_degree = zscore(degree, F.log1p("degree"), "zd").select("gene_idx", "zd")
    grid = pool.sparkSession.createDataFrame(list(enumerate(alphas)), "position int, alpha double")
    standard = F.when(F.col("s") > 0, (F.col("score") - F.col("m")) / F.col("s")).otherwise(0.0)
    scored = pool.join(per_drug, "drug_idx").join(z_degree, "gene_idx").select("drug_idx", "gene_idx", "known", standard.alias("z"), "zd")
    light, heavy = light_and_heavy(scored, ["drug_idx"], most)

    def tried(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        known, z, zd = (table.column(i).to_numpy() for i in (1, 2, 3))
        rows = []
        for position, alpha in enumerate(alphas):
            better = better_before(group, np.round(z + alpha * zd, 6), ~known)[known]
            rows.append((position, alpha, float((1 / (1 + better)).sum()), len(better)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["position", "alpha", "rr", "n"])

    sums = over_groups(light, ["drug_idx"], ["known", "z", "zd"], tried, "position int, alpha double, rr double, n bigint")
    if heavy is not None:
        spread = heavy.crossJoin(F.broadcast(grid)).select("position", "alpha", "drug_idx", "gene_idx", "known", F.round(F.col("z") + F.col("alpha") * F.col("zd"), 6).alias("score"))
        ranks = rank_known(spread, ("position", "alpha", "drug_idx"), most=0)
        sums = sums.unionByName(ranks.groupBy("position", "alpha").agg(F.sum(1 / F.col("rank")).alias("rr"), F.count(F.lit(1)).alias("n")))
    mrr = sums.groupBy("position", "alpha").agg(F.round(F.sum("rr") / F.sum("n"), 6).alias("mrr")).filter("mrr IS NOT NULL")
    best = mrr.agg(F.max_by("position", F.struct("mrr", -F.abs("alpha"), -F.col("position"))).alias("best"))
    return mrr.crossJoin(F.broadcast(best)).select("alpha", F.col("position").cast("bigint").alias("position"), "mrr", (F.col("position") == F.col("best")).alias("chosen"))


def early_stopping(history: DataFrame, patience: int) -> DataFrame:
    """(run, epoch, metric) with the best metric so far, validations since, and whether training stops here or has stopped.

    A run's history is a few hundred validations at most.
    """
    w = Window.partitionBy("run").orderBy("epoch")
    best = F.max("metric").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("improved", F.coalesce(F.col("metric") > best, F.lit(True)))
    since = marked.withColumn("place", F.row_number().over(w)).withColumn("last", F.max(F.when(F.col("improved"), F.col("place"))).over(w))
    out = since.withColumn("waited", (F.col("place") - F.col("last")).cast("bigint"))
    return out.withColumn("stopped", F.coalesce(F.max((F.col("waited") >= patience).cast("int")).over(w), F.lit(0)) == 1).select("run", "epoch", "metric", "improved", "waited", "stopped")
