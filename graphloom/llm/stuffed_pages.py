"""Keyword-stuffed and link-list pages (problem 8).

A page is flagged when most of its words stand in phrases that are replicated on other hosts, and the replicated words
are those of lists rather than of sentences. Phrases: each text is cut into segments, and every five-word shingle of
a segment, taken as the set of its words, is exploded over the whole corpus to count the distinct hosts (sources) that
use it; of a segment of under five words, all its words are one. List density is measured on the replicated words
alone: their shares in links, short or repeated segments, listings, sentences. A word that no other host's phrase covers adds to
no feature, so without replication no page is found.

No list of words is given. Which words keep their letters in a phrase is a matter of how many pages use them, and
which speak for lists or for prose is learned from a bounded sample of hand-labelled pages, as is the weight of each feature.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, spread_input

SHINGLE = 5
FOLDS = 3

SEGMENT = re.compile(r"\n+|\s(?:[|/»›>•·*\-–—~#]|::|->)\s|;\s|</?(?:p|li|br|ul|td|tr|div)/?>|(?<=[.!?])\s+")
LINK = re.compile(r"://|^\(?www\.|^\(?[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,8}/", re.I)
ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>|\[([^\]\n]*)\]\((?:https?:|www\.|/)[^)\s]*\)", re.S | re.I)
GLUED = re.compile(r"(?<=\w)(?=[#@]\w)")
MONEY = re.compile(r"^[€$£]|^(?:usd|eur|gbp|chf)$|[€$£]$", re.I)
EDGES = ".,;:!?()[]{}\"'“”„«»<>…*|"

URL, TAG, PRICE, NUMBER, RARE, BARE_MARK = range(6)
KEPT = 6
PACKED = ("doc_ids", "hosts", "segments", "lengths", "codes", "form", "number", "bares")
FEATURES = (
    "url tag price number rare mark listed_words prose_words linked short offered repeated repeated_sentences prose noted priced asked ended listed "
    "mean_weight distinct top_word mean_segment fresh_prose log_words replicated hosts5"
).split()


def _linked_words(found: re.Match) -> str:
    """Every word of a link's text as a link."""
    return " " + " ".join(["://"] * max(1, len((found[1] or found[2] or "").split()))) + " "


def _pack(values: np.ndarray | str) -> bytes:
    return zlib.compress(values.encode("utf-8", "surrogatepass") if isinstance(values, str) else values.tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


class _Codes(dict):
    """Numbers of tokens in the order of their first use."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def _token_table(tokens: dict[str, int]) -> tuple[np.ndarray, np.ndarray, str]:
    """Of each token its form (kind of word, and by sixteens 1 for an end of sentence or 2 for one of a question) and the number of its bare word; the bare words."""
    form, number, bares = np.empty(len(tokens), np.int8), np.empty(len(tokens), np.int32), {}
    for i, token in enumerate(tokens):
        bare = token.strip(EDGES).lower()
        number[i] = bares.setdefault(bare, len(bares))
        if LINK.search(token):
            kind = URL
        elif token[0] in "#@" and len(token) > 1:
            kind = TAG
        elif MONEY.search(token):
            kind = PRICE
        elif not bare:
            kind = BARE_MARK
        else:
            kind = RARE if bare.isalpha() or not any(c.isdigit() for c in bare) else NUMBER
        form[i] = kind + (32 if token[-1] == "?" else 16 if token[-1] in ".!" or token[-2:] in (".)", '."', ".”") else 0)
    return form, number, "\n".join(bares)


def page_blocks(documents: DataFrame, words_each: int = 1_000_000) -> DataFrame:
    """Tokenised pages, many to a row: block, pages (their number), and as packed arrays doc_ids, hosts, the number of
    segments of each page, the number of words of each segment, the code of each word, and of the tokens that codes stand for the form,
    the bare word's number and the bare words.

    A block ends with the page that fills it, so its size is bounded but for a single longer page. Texts are split once and
    stored; whatever is asked later runs on numbers.
    """
    source = spread_input(documents.select("doc_id", F.xxhash64(F.coalesce("source", F.lit(""))).alias("host"), F.col("text").cast("string").alias("text")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        doc_ids, hosts, segments, lengths, flat = [], [], array("i"), array("i"), array("i")

        def block() -> pa.RecordBatch:
            packed = [
                _pack(np.array(doc_ids, np.int64)), _pack(np.array(hosts, np.int64)), _pack(np.array(segments)), _pack(np.array(lengths)),
                _pack(np.array(flat)), *map(_pack, _token_table(codes)),
            ]
            return pa.RecordBatch.from_arrays([pa.array([len(doc_ids)], pa.int32()), *[pa.array([p], pa.binary()) for p in packed]], names=names)

        for batch in batches:
            for doc_id, host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids.append(doc_id)
                hosts.append(host)
                if text and ("<a " in text or "](" in text):
                    text = ANCHOR.sub(_linked_words, text)
                if text and ("#" in text or "@" in text):
                    text = GLUED.sub(" ", text)
                before = len(lengths)
                for part in SEGMENT.split(text) if text else ():
                    if part and (tokens := part.split()):
                        flat.extend(map(codes.__getitem__, tokens))
                        lengths.append(len(tokens))
                segments.append(len(lengths) - before)
                if len(flat) >= words_each or len(doc_ids) >= words_each:
                    yield block()
                    codes = _Codes()
                    doc_ids, hosts, segments, lengths, flat = [], [], array("i"), array("i"), array("i")
        if doc_ids:
            yield block()

    names = ["pages", *PACKED]
    made = source.filter("doc_id IS NOT NULL").mapInArrow(read, "pages int, " + ", ".join(f"{n} binary" for n in names[1:]))
    return cut_lineage(made.withColumn("block", F.monotonically_increasing_id()))


class _Block:
    """One row of page_blocks, unpacked, with its words read by a vocabulary."""

    def __init__(self, packed: list[bytes]) -> None:
        doc_ids, hosts, segments, lengths, codes, form, number, bares = packed
        self.doc_ids, self.hosts = _unpack(doc_ids, np.int64), _unpack(hosts, np.int64)
        self.segments, self.lengths, self.codes = (_unpack(d, np.int32) for d in (segments, lengths, codes))
        form = _unpack(form, np.int8)
        self.kind, self.tail, self.number = form & 15, form >> 4, _unpack(number, np.int32)
        self.bares = zlib.decompress(bares).decode("utf-8", "surrogatepass").split("\n") if len(form) else []
        self.page_of_segment = np.repeat(np.arange(len(self.doc_ids)), self.segments)
        self.page = np.repeat(self.page_of_segment, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def masks(self, vocabulary: dict[str, int]) -> np.ndarray:
        """Of each token: KEPT and its number in the vocabulary, or else the kind of word it is."""
        get = vocabulary.get
        known = np.fromiter((get(w, -1) for w in self.bares), np.int32, len(self.bares))[self.number]
        return np.where((self.kind == RARE) & (known >= 0), KEPT + known, self.kind).astype(np.int32)

    def phrases(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first word, key and number of words of every phrase; word has the mask of each word.

        The key doesn't depend on the order or the repetition of the words: each distinct one adds its hash once.
        """
        n = len(word)
        length = np.repeat(self.lengths, self.lengths)
        place = np.arange(n, dtype=np.int32) - np.repeat(self.starts, self.lengths).astype(np.int32)
        left = length - place
        with np.errstate(over="ignore"):
            mixed = (np.arange(int(word.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            hashed = (mixed ^ (mixed >> np.uint64(31)))[word]
            key = hashed.copy()
            for j in range(1, min(SHINGLE, n)):
                new = left[:-j] > j
                for k in range(j):
                    new &= word[j:] != word[k : n - j + k]
                key[:-j] += np.where(new, hashed[j:], np.uint64(0))
        first = np.flatnonzero((place == 0) | (left >= SHINGLE))
        return first, key[first].view(np.int64), np.minimum(left[first], SHINGLE)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, list]]:
    for batch in batches:
        for i in range(batch.num_rows):
            values = [c[i] for c in batch.columns]
            yield _Block([v.as_py() for v in values[: len(PACKED)]]), values[len(PACKED) :]


def word_table(blocks: DataFrame, hand: dict[int, tuple[int, int, int]], share: float = 0.005) -> tuple[dict[str, int], np.ndarray]:
    """The vocabulary, and the weight of each of its words for pages of each fold and (last row) of none.

    The vocabulary is the words without digits that at least ``share`` of all pages use: at most 1 / share times the words of a mean page.
    hand gives for labelled pages their fold and how often they are labelled stuffed and not. A word's weight is the log
    of its rate among stuffed pages over that among others, counted without the pages of the fold, so a page's own label
    doesn't weigh its words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in _each(batches):
            words, wide = b.bares, max(1, len(b.bares))
            used = pd.unique(b.page.astype(np.int64) * wide + b.number[b.codes])
            page, word = np.divmod(used, wide)
            columns = [np.bincount(word, minlength=len(words))]
            marks = np.zeros((2 * FOLDS, len(b.doc_ids)), np.int64)
            for i, doc_id in enumerate(b.doc_ids.tolist()):
                if doc_id in hand:
                    fold, yes, no = hand[doc_id]
                    marks[fold, i], marks[FOLDS + fold, i] = yes, no
            known = marks.any(axis=0)[page]
            columns += [np.bincount(word[known], m[page[known]], len(words)).astype(np.int64) for m in marks]
            keep = np.array([w != "" and not any(c.isdigit() for c in w) for w in words], bool)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).filter(pa.array(keep)), *[pa.array(c[keep], pa.int64()) for c in columns]], names=names)

    names = ["word", "n", *[f"c{k}" for k in range(2 * FOLDS)]]
    table = blocks.select(*PACKED).mapInArrow(count, "word string, " + ", ".join(f"{c} bigint" for c in names[1:]))
    pages = blocks.agg(F.sum("pages")).first()[0] or 0
    sums = table.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]]).filter(F.col("n") >= max(1.0, share * pages)).orderBy("word").collect()
    vocabulary = {r["word"]: i for i, r in enumerate(sums)}
    counts = np.array([r[2:] for r in sums], float).reshape(-1, 2, FOLDS)
    total = np.zeros((2, FOLDS))
    for fold, yes, no in hand.values():
        total[0, fold] += yes
        total[1, fold] += no
    weights = np.zeros((FOLDS + 1, len(vocabulary)))
    for k in range(FOLDS + 1):
        others = [f for f in range(FOLDS) if f != k]
        yes, no = counts[:, 0][:, others].sum(axis=1), counts[:, 1][:, others].sum(axis=1)
        weights[k] = np.log((yes + 0.5) / (total[0, others].sum() + 1)) - np.log((no + 0.5) / (total[1, others].sum() + 1))
    return vocabulary, np.clip(weights, -4, 4)


def page_evidence(b: _Block, mask: np.ndarray, weights: np.ndarray, fold: np.ndarray, level: np.ndarray, first: np.ndarray, span: np.ndarray) -> np.ndarray:
    """FEATURES of the pages of a block. level gives for each phrase 0, 1 (two hosts or more) or 2 (five or more)."""
    pages, n = len(b.doc_ids), len(b.codes)
    out = np.zeros((pages, len(FEATURES)))
    if not n:
        return out
    word = mask[b.codes]
    covered = []
    for least in (1, 2):
        hit = level >= least
        covered.append((np.bincount(first[hit], minlength=n + 1) - np.bincount(first[hit] + span[hit], minlength=n + 1)).cumsum()[:n] > 0)
    seen = covered[0]
    total = np.maximum(1, np.bincount(b.page, minlength=pages)).astype(float)
    per_page = lambda hit: np.bincount(b.page, hit, pages) / total
    kept = word >= KEPT
    weight = np.where(kept, weights[fold[b.page], np.where(kept, word - KEPT, 0)] if weights.shape[1] else 0.0, 0.0)
    listing, prosaic = weight >= 1, weight <= -1
    per_segment = lambda hit: np.add.reduceat(hit.astype(float), b.starts) / b.lengths
    url, tag, price, number = (per_segment(word == k) for k in (URL, TAG, PRICE, NUMBER))
    lists, prose_share = per_segment(listing), per_segment(prosaic)
    length = b.lengths
    linked = (url + tag >= 0.3) | ((url > 0) & (length <= 14))
    offered = lists >= 0.3
    noted = (number >= 0.2) & ~offered & (price == 0)
    priced = (price > 0) & (number + price + lists >= 0.3)
    prose = (prose_share >= 0.2) & (length >= 5) & ~linked & ~offered
    short = (length <= 4) & (prose_share == 0) & ~noted
    tails = b.tail[b.codes[b.starts + length - 1]]
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((word.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(9), b.starts) * np.uint64(0x94D049BB133111EB)
        whole ^= b.page_of_segment.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    at, kinds = pd.factorize(whole)
    times = np.bincount(at, minlength=len(kinds))[at]
    ended, many = tails > 0, times >= 3
    spread = lambda flag: per_page(seen & np.repeat(flag, length))
    free = seen & ~prosaic
    pair = b.page[free].astype(np.int64) * (1 << 32) + b.number[b.codes[free]]
    which, pairs = pd.factorize(pair)
    owner = pairs >> 32
    used = np.bincount(which, minlength=len(pairs))
    distinct = np.bincount(owner, minlength=pages)
    top = np.zeros(pages)
    np.maximum.at(top, owner, used)
    count = np.maximum(1, np.bincount(b.page[free], minlength=pages))
    replicated, segments = per_page(seen), np.maximum(1, b.segments)
    columns = [
        *(per_page(seen & (word == k)) for k in range(KEPT)), per_page(seen & listing), per_page(seen & prosaic),
        spread(linked), spread(short), spread(offered), spread(many & ~ended), spread(many & ended), spread(prose), spread(noted), spread(priced),
        spread(tails == 2), spread(ended), spread(linked | offered | priced | (short & ~prose)),
        per_page(seen * weight), distinct / count, top / count, np.minimum(50, total / segments) * replicated, per_page(~seen & np.repeat(prose, length)),
        np.log1p(total) * replicated, replicated, per_page(covered[1]),
    ]
    out[:] = np.column_stack(columns)
    out[np.bincount(b.page, minlength=pages) == 0] = 0
    return out


def page_features(documents: DataFrame, hand: dict[int, tuple[int, int, int]] | None = None, share: float = 0.005, words_each: int = 1_000_000) -> DataFrame:
    """(doc_id, features): the evidence of each page on words in phrases of at least two hosts, and the shares of words in
    phrases of two and of five hosts. Null, empty and blank texts have zeros throughout; a null host is a host; a null doc_id gives no row.

    A block's distinct phrases meet the corpus once, whatever number of its pages use them.
    """
    hand = hand or {}
    blocks = page_blocks(documents, words_each)
    vocabulary, weights = word_table(blocks, hand, share)

    def used_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (block,) in _each(batches):
            first, keys, _ = b.phrases(b.masks(vocabulary)[b.codes])
            at, phrases = pd.factorize(keys)
            which, hosts = pd.factorize(b.hosts)
            pairs = pd.unique(at.astype(np.int64) * max(1, len(hosts)) + which[b.page[first]])
            pairs.sort()
            phrase, host = np.divmod(pairs, max(1, len(hosts)))
            lead = np.diff(phrase, prepend=-1) > 0
            arrays = [pa.array(phrases[phrase]), pa.array(hosts[host]), pa.array(np.full(len(phrase), block.as_py(), np.int64)), pa.array(lead)]
            yield pa.RecordBatch.from_arrays(arrays, names=["phrase", "host", "block", "lead"])

    uses = blocks.select(*PACKED, "block").mapInArrow(used_by, "phrase bigint, host bigint, block bigint, lead boolean")
    hosts = uses.groupBy("phrase", "host").agg(F.lit(1).alias("one")).groupBy("phrase").agg(F.count("one").alias("hosts")).filter("hosts > 1")
    shared = (
        uses.filter("lead").select("block", "phrase").join(hosts, "phrase").groupBy("block")
        .agg(F.collect_list("phrase").alias("phrases"), F.collect_list(F.col("hosts") >= 5).alias("many"))
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (phrases, many) in _each(batches):
            mask = b.masks(vocabulary)
            first, keys, span = b.phrases(mask[b.codes])
            at, own = pd.factorize(keys)
            level = np.zeros(len(own), np.int8)
            if phrases.is_valid:
                known = phrases.values.to_numpy(zero_copy_only=False)
                order = np.argsort(known)
                place = np.clip(np.searchsorted(known[order], own), 0, len(known) - 1)
                hit = known[order][place] == own
                level[hit] = 1 + many.values.to_numpy(zero_copy_only=False)[order][place][hit]
            fold = np.array([hand[d][0] if d in hand else FOLDS for d in b.doc_ids.tolist()], np.int64)
            rows = page_evidence(b, mask, weights, fold, level[at], first, span).astype(np.float32)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(b.doc_ids), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["doc_id", "features"])

    return blocks.join(shared, "block", "left").select(*PACKED, "phrases", "many").mapInArrow(measure, "doc_id bigint, features array<float>")


class BoostedTrees:
    """Logistic boosting of small trees on a bounded sample, robust to a few wrong labels by shrinkage and leaf size."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.1, least: float = 4.0, ridge: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.trees = []
        p = float(np.clip(y.mean() if len(y) else 0.0, 0.02, 0.98))
        self.base = float(np.log(p / (1 - p)))
        if len(set(y.tolist())) < 2:
            return self
        score = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - q, q * (1 - q), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, x, g, h, rows, cuts, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(self.rate * gs / (hs + self.ridge))
        best = (1e-6, -1, 0.0)
        if depth and len(rows) >= 2 * self.least:
            for j, edges in enumerate(cuts):
                at = np.searchsorted(edges, x[rows, j], "left")
                gl, hl, nl = (np.bincount(at, v, len(edges) + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, float(edges[int(gain.argmax())]))
        if best[1] < 0:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], cuts, depth - 1), self._grow(x, g, h, rows[~left], cuts, depth - 1))

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._apply(low, x), self._apply(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += self._apply(tree, x)
        return total


def fit_trimmed(x: np.ndarray, y: np.ndarray, folds: int = 5, doubt: float = 2.0) -> BoostedTrees:
    """A model without the labels that a model of the other folds contradicts by log odds of ``doubt``: a few are wrong."""
    fold = np.arange(len(y)) % folds
    held = np.zeros(len(y))
    for k in range(folds):
        held[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).score(x[fold == k])
    keep = np.where(y == 1, held, -held) > -doubt
    if len(set(y[keep].tolist())) < 2:
        keep[:] = True
    return BoostedTrees().fit(x[keep], y[keep])


def labelled_pages(documents: DataFrame, labels: DataFrame, sample: int) -> list:
    """At most ``sample`` labels of pages there are: those with the least hash of doc_id, so always the same ones."""
    hand = labels.filter("doc_id IS NOT NULL AND is_stuffed IN (0, 1)").select("doc_id", "is_stuffed")
    there = hand.join(documents.select("doc_id"), "doc_id", "left_semi")
    return there.orderBy(F.xxhash64("doc_id"), "doc_id", "is_stuffed").limit(sample).collect()


def stuffed_pages(documents: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """(doc_id) of the pages of which more than half of the words stand in phrases replicated on other hosts, by list density
    in keywords, lists or listings.

    The words' weights and the model of list density are fitted on at most ``sample`` labels (those with the least hash of
    doc_id); every page is judged, copies like originals. Labels of unknown pages, and other than 0 and 1, are ignored; a page
    with several labels counts with each. Without labels of both kinds nothing is found. Pages without words are never
    found, nor is a row without doc_id. Extra columns are dropped.
    """
    sampled = labelled_pages(documents, labels, sample)
    hand: dict[int, tuple[int, int, int]] = {}
    for r in sampled:
        _, yes, no = hand.get(r["doc_id"], (0, 0, 0))
        hand[r["doc_id"]] = (zlib.crc32(str(r["doc_id"]).encode()) % FOLDS, yes + r["is_stuffed"], no + 1 - r["is_stuffed"])
    features = cut_lineage(page_features(documents, hand))
    known = features.filter(F.col("doc_id").isin(list(hand))) if hand else features.limit(0)
    rows = [(r["features"], y) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id", "features").collect() for y, k in ((1, hand[r["doc_id"]][1]), (0, hand[r["doc_id"]][2])) for _ in range(k)]
    x = np.array([f for f, _ in rows], float).reshape(-1, len(FEATURES))
    model = fit_trimmed(x, np.array([y for _, y in rows], float))
    at = FEATURES.index("replicated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).flatten().to_numpy().astype(float).reshape(-1, len(FEATURES))
            hit = (model.score(given) > 0) & (given[:, at] > 0.5) if model.trees else np.zeros(len(given), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], names=["doc_id"])

    return features.mapInArrow(run, "doc_id bigint")
