"""Records of evaluation splits that also stand in train (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.entities import counted_rows, own_entity
from graphloom.session import cut_lineage, estimated_bytes

SEP = "\x1f"


def named_rows(assignments: DataFrame, drugs: DataFrame, genes: DataFrame) -> DataFrame:
    """Counted rows with drug_entity and gene_entity.

    Entities are looked up for distinct (drug_idx, gene_idx), so a pair or a gene that holds a third
    of the rows is looked up once. Extra columns are dropped; re-sent rows are rows of their own; a drug
    or gene that has no node is an entity of its own.
    """
    rows = counted_rows(assignments).select("row_id", "drug_idx", "gene_idx", "split", "record_source", "source_type", "target_type", "evidence", "association")
    pairs = rows.select("drug_idx", "gene_idx").distinct()
    named = (
        pairs.join(drugs, "drug_idx", "left")
        .join(genes, "gene_idx", "left")
        .select("drug_idx", "gene_idx", own_entity("drug_entity", "drug_idx").alias("drug_entity"), own_entity("gene_entity", "gene_idx").alias("gene_entity"))
    )
    return rows.join(named, ["drug_idx", "gene_idx"])


# The fields of a record text after drug and gene.
FIELDS = ("source_type", "target_type", "evidence", "association")


def _plain(name: str):
    return F.regexp_replace(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), r"[\s_\-\x1f]+", " ")


def record_texts(rows: DataFrame) -> DataFrame:
    """rows with text: the record as a normalised passage of tagged fields, drug and gene first.

    Every field begins with its number and ends with a separator, so a part of one is never a part of another.
    """
    fields = [F.col("drug_entity"), F.col("gene_entity"), *(_plain(c) for c in FIELDS)]
    return rows.withColumn("text", F.concat(F.lit(SEP), *[c for i, f in enumerate(fields) for c in (F.lit(f"{i}:"), f, F.lit(SEP))]))


def core_of(text: str):
    """The beginning of a record text that names its drug and gene."""
    return F.concat(F.substring_index(text, SEP, 3), F.lit(SEP))


def _field(text: str, number: int):
    """A field of a record text."""
    return F.substring_index(F.substring_index(text, SEP, number + 2), SEP, -1)


def _merge(intervals: list[tuple[int, int]], new: tuple[int, int]) -> list[tuple[int, int]]:
    """Disjoint sorted intervals with one more merged in."""
    lo, hi = new
    out = []
    for a, b in intervals:
        if b < lo or a > hi:
            out.append((a, b))
        else:
            lo, hi = min(lo, a), max(hi, b)
    return sorted([*out, (lo, hi)])


class _Shard:
    """The automaton of one shard's evaluation passages and what training texts have covered of each so far.

    The patterns are the pieces of the passages: drug and gene together, and each other field with the separator before it.
    Wherever a training text holds the first piece of a passage, every further piece it shares is an interval of that passage.
    """

    def __init__(self, passages: list[str]) -> None:
        self.of_core: dict[str, list[tuple[str, dict[str, tuple[int, int]]]]] = {}
        self.spans: dict[str, list[tuple[int, int]]] = {}
        self.exact: set[str] = set()
        self.by: dict[str, set[str]] = {}
        self.automaton = ahocorasick.Automaton()
        for text in passages:
            ends = [i for i, c in enumerate(text) if c == SEP]
            pieces = {text[: ends[2] + 1]: (0, ends[2] + 1)} | {text[a : b + 1]: (a + 1, b + 1) for a, b in zip(ends[2:], ends[3:], strict=False)}
            self.of_core.setdefault(text[: ends[2] + 1], []).append((text, pieces))
            for piece in pieces:
                self.automaton.add_word(piece, piece)
        if passages:
            self.automaton.make_automaton()

    def scan(self, text: str) -> None:
        found = [piece for _, piece in self.automaton.iter(text)]
        for core in found:
            for passage, pieces in self.of_core.get(core, ()):
                hits = [pieces[p] for p in found if p in pieces]
                held = self.spans.get(passage, [])
                for hit in hits:
                    held = _merge(held, hit)
                self.spans[passage] = held
                self.by.setdefault(passage, set()).add(core)
                if len(hits) == len(pieces):
                    self.exact.add(passage)

    def covered(self) -> list[tuple[str, str, int, bool]]:
        return [(passage, core, sum(b - a for a, b in spans), passage in self.exact) for passage, spans in self.spans.items() for core in sorted(self.by[passage])]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's shards: per shard the evaluation passages come first, then the training texts, each scanned once and forgotten."""
    shard, passages, state = None, [], None

    def finish() -> Iterator[pa.RecordBatch]:
        met = state.covered() if state else []
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*met, strict=True), (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["text", "train_core", "matched", "exact"])

    for batch in batches:
        for s, trained, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                yield from finish()
                shard, passages, state = s, [], None
            if not trained:
                passages.append(text)
            elif passages:
                if state is None:
                    state = _Shard(passages)
                state.scan(text)
    yield from finish()


def scan_overlaps(rows: DataFrame, shard_bytes: int = 16 << 20, routed: bool = True) -> DataFrame:
    """(text, train_core, matched, exact): each distinct evaluation passage that training texts cover, the cores of the texts
    that do, the merged length of all that they cover, and whether one of them covers the whole.

    rows has split and text, of record_texts. Passages are sharded into automata of a bounded size by one of their fields, the drug, or for a drug with more
    than a shard's worth of texts the gene. A training text goes to the shard of the same field, since no
    other can hold a passage with both its drug and its gene; which passages it covers there, and how far, is for the automaton to
    say. routed=False sends every training text past every shard, with the same result and a cost that grows with the square of the data.
    Copies are dropped before the shuffle, so heavy pairs do no harm.
    """
    size = estimated_bytes(rows)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, min(100_000, size // shard_bytes))
    texts = rows.select((F.col("split") == "train").alias("trained"), "text").distinct()
    if routed:
        drug, gene = _field("text", 0), _field("text", 1)
        total = rows.select(F.count(F.lit(1)).alias("total"))
        many = rows.groupBy(drug.alias("drug")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).filter(F.col("n") * shards > F.col("total"))
        heavy = F.broadcast(many.select("drug", F.lit(True).alias("heavy")))  # fewer than shards
        texts = texts.withColumn("drug", drug).join(heavy, "drug", "left").withColumn("shard", F.pmod(F.xxhash64(F.when(F.col("heavy"), gene).otherwise(F.col("drug"))), F.lit(shards)))
    else:
        every = F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")
        own = F.array(F.pmod(F.xxhash64("text"), F.lit(shards)))
        texts = texts.withColumn("shard", F.explode(F.when(F.col("trained"), every).otherwise(own)))
    placed = texts.select("shard", "trained", "text").repartition(shards, "shard").sortWithinPartitions("shard", "trained")
    return placed.mapInArrow(_scan, "text string, train_core string, matched bigint, exact boolean")


def overlap_links(rows: DataFrame) -> DataFrame:
    """(train_core, core): of which training records each covered evaluation passage is a copy or nearly one; one row per class of records, not per pair."""
    return scan_overlaps(rows).select("train_core", core_of("text").alias("core")).distinct()


def overlap_classes(rows: DataFrame) -> DataFrame:
    """(row_id, class, links): each row that overlaps across splits, the class of records it belongs to, and with how many rows of the other side it does; rows of one row_id are added up."""
    links = overlap_links(rows)
    trained, kept = F.col("split") == "train", core_of("text")
    sizes = rows.groupBy(kept.alias("core")).agg(F.count_if(trained).alias("in_train"), F.count_if(~trained).alias("held"))
    train = rows.filter(trained).select("row_id", kept.alias("train_core")).join(links, "train_core")
    held = rows.filter(~trained).select("row_id", kept.alias("core")).join(links, "core")
    both = [
        train.join(sizes, "core").groupBy("row_id", F.col("train_core").alias("class")).agg(F.sum("held").alias("links")),
        held.join(sizes.withColumnRenamed("core", "train_core"), "train_core").groupBy("row_id", F.col("core").alias("class")).agg(F.sum("in_train").alias("links")),
    ]
    return both[0].unionByName(both[1])


def overlap_pairs(rows: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: one row in train, one in validation or test, of the same entities.

    The links that the automata found are expanded to rows last; adaptive execution splits the joins where one class holds many rows.
    """
    links = overlap_links(rows)
    trained = F.col("split") == "train"
    train = rows.filter(trained).select(F.col("row_id").alias("t"), core_of("text").alias("train_core"))
    held = rows.filter(~trained).select(F.col("row_id").alias("h"), core_of("text").alias("core"))
    met = held.join(links, "core").select("h", "train_core")
    return train.join(met, "train_core").select(F.least("t", "h").alias("row_id_a"), F.greatest("t", "h").alias("row_id_b"))


def overlap_report(rows: DataFrame) -> DataFrame:
    """Per split and record_source of the evaluation rows: rows, rows also in train, of these exact (one training record has every
    normalised field) and near (same entities), the characters of the overlapping rows' passages and of these the
    characters that training records cover, and the pairs they make with train rows."""
    scanned = cut_lineage(scan_overlaps(rows))
    met = scanned.groupBy("text").agg(F.max("matched").alias("matched"), F.max("exact").alias("exact"))
    trained = rows.filter("split = 'train'").groupBy(core_of("text").alias("train_core")).agg(F.count(F.lit(1)).alias("n_train"))
    linked = scanned.select("text", "train_core").join(trained, "train_core").groupBy("text").agg(F.sum("n_train").alias("n_train"))
    held = rows.filter("split <> 'train'").groupBy("split", "record_source", "text").agg(F.count(F.lit(1)).alias("n"))
    total = lambda value: F.coalesce(F.sum(value), F.lit(0))
    hit = F.col("exact").isNotNull()
    return (
        held.join(met, "text", "left").join(linked, "text", "left")
        .groupBy("split", "record_source")
        .agg(
            F.sum("n").alias("n_rows"),
            total(F.when(hit, F.col("n"))).alias("n_overlapping"),
            total(F.when(F.col("exact"), F.col("n"))).alias("n_exact"),
            total(F.when(~F.col("exact"), F.col("n"))).alias("n_near"),
            total(F.when(hit, F.col("n") * F.length("text"))).alias("n_chars"),
            total(F.col("n") * F.col("matched")).alias("n_covered"),
            total(F.col("n") * F.col("n_train")).alias("n_pairs"),
        )
    )
