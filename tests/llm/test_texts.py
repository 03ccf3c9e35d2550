from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing, stuffed_pages, tokens
from graphloom.llm.bpe_transducer import Transducer, Utf8Stream, default_vocabulary, encoder

tokenizers = pytest.importorskip("tokenizers")
ODD = "a  b   c\n\n d \x1c e\x85f   g's don't I'LL <|endoftext|>   x 漢字 😀😀👩‍⚕️ ‮½ " + "z" * 5000 + " " * 60 + "q\t\t\r\n"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    made = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def enc():
    return encoder(default_vocabulary())


def test_odd_text(enc, reference):
    assert enc.encode(ODD) == reference(ODD) and enc.decode(enc.encode(ODD)) == ODD
    assert enc.encode(None) == enc.encode("") == [] and enc.decode([]) == ""


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t'.,1x é漢😀　\x1c\x85stTHE"), max_size=30))
def test_ids_equal_the_public_tokenizer(enc, reference, text):
    assert enc.encode(text) == reference(text)
    assert enc.decode(enc.encode(text)) == text


def test_transducer_equals_merges_and_survives_small_tables(enc):
    small = Transducer(enc.transducer.ranks, max_states=50)
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"aeinrst ghlo\xc3\xa9") for _ in range(rng.randrange(40)))
        assert small.encode(data) == enc.transducer.merge(data)


@given(st.binary(max_size=20))
def test_stream_decodes_broken_bytes_as_python_does(data):
    stream = Utf8Stream({i: bytes([i]) for i in range(256)})
    assert "".join(stream.feed_all(data)) == data.decode("utf-8", "replace")


def test_token_tables(spark, reference):
    texts = ["one two", None, "", " ", ODD, "one two"]
    df = spark.createDataFrame([(i % 5, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = tokens.encode_texts(df, "doc_id", "text").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i % 5, tuple(reference(t) if t else [])) for i, t in enumerate(texts))
    counts = tokens.count_tokens(df, "doc_id", "text").collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counts) == Counter((r["doc_id"], len(r["ids"])) for r in got)
    back = tokens.decode_ids(tokens.encode_texts(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i % 5, t or "") for i, t in enumerate(texts))
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").collect() == []


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_holds_exactly_the_items(histogram):
    plan = packing.plan_containers(histogram, 64, bins=16)
    held = Counter()
    for p in plan:
        assert 0 < sum(p.lengths) <= 64 and p.repeat > 0
        for x in p.lengths:
            held[x] += p.repeat
    assert held == Counter(histogram)


def test_plan_fills_nearly_everything():
    lengths = np.clip(np.random.default_rng(1).lognormal(5.3, 0.9, 50_000).astype(int), 1, 2048)
    u, c = np.unique(lengths, return_counts=True)
    plan = packing.plan_containers(dict(zip(u.tolist(), c.tolist(), strict=True)), 2048)
    assert lengths.sum() / (2048 * sum(p.repeat for p in plan)) > 0.995
    with pytest.raises(ValueError, match="lengths"):
        packing.plan_containers({0: 1}, 8)


def test_least_squares():
    rng = np.random.default_rng(2)
    a, x = rng.random((12, 30)), np.maximum(rng.normal(size=30), 0) * (rng.random(30) < 0.3)
    got = packing.nnls(a, a @ x)
    assert got.min() >= 0 and np.linalg.norm(a @ got - a @ x) < 1e-6


def test_packed_items_are_whole(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([None, 0, 5, 5, 5, 64, 65, 128, 200, rng.randrange(1, 90)]), 1) for i in range(2000)] + [(3, 9, 1), (3, 9, 1), (None, 4, 1)]
    got = packing.pack_items(spark.createDataFrame(sizes, "doc_id bigint, n bigint, part int"), "doc_id", "n", 64).collect()
    load, of = Counter(), defaultdict(Counter)
    for r in got:
        assert 0 <= r["n_tokens"] <= 64
        if r["n_tokens"]:
            load[r["container_id"]] += r["n_tokens"]
        else:
            assert r["container_id"] is None
        of[r["doc_id"]][r["start"], r["n_tokens"]] += 1
    assert max(load.values()) <= 64 and sorted(load) == list(range(len(load)))
    want = defaultdict(Counter)
    for i, n, _ in sizes:
        n = n or 0
        for start in range(0, max(1, n), 64):
            want[i][start, min(64, n - start)] += 1
    assert of == want
    assert sum(load.values()) / (64 * len(load)) > 0.97
    assert packing.pack_items(spark.createDataFrame([], "doc_id bigint, n bigint"), "doc_id", "n", 64).collect() == []


PROSE = "We tested {n} patients taking {d} and followed them for {m} months. The dose of {d} was raised at night, although the sample was small. It was not clear which of the groups had been measured."
OFFERS = "buy cheap discount pills online shipping free bonus generic sale price order tablets kit delivery overnight".split()


def pages(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        d = "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(4))
        kind = i % 5
        if kind == 0:
            yield i, " ".join(rng.choice([*OFFERS, d]) for _ in range(80)), 1
        elif kind == 1:
            yield i, "\n".join(f"https://www.{d}{k}.test/item/{rng.randrange(9999)}" for k in range(20)), 1
        else:
            yield i, " ".join(PROSE.format(n=rng.randrange(999), d=d, m=rng.randrange(60)) for _ in range(rng.randrange(1, 4))), 0


def test_stuffed_pages_are_found_held_out(spark):
    rows = list(pages(400, 1))
    extra = [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 200_000), (1004, rows[0][1])]
    docs = spark.createDataFrame([(i, t, f"host{i % 9}" if i % 7 else None, 5) for i, t in [(i, t) for i, t, _ in rows] + extra], "doc_id bigint, text string, source string, features int")
    labels = spark.createDataFrame([(i, 1 - y if i == 13 else y) for i, _, y in rows if i < 150] + [(99999, 1), (None, 0), (5, None)], "doc_id bigint, is_stuffed bigint")
    found = {r["doc_id"] for r in stuffed_pages.stuffed_pages(docs, labels).collect()}
    want = {i for i, _, y in rows if y} | {1004}
    assert len(found & want) / len(want) > 0.97 and len(found - want) <= 3
    assert not found & {1000, 1001, 1002}
    assert found == {r["doc_id"] for r in stuffed_pages.stuffed_pages(docs.repartition(6), labels).collect()}
    assert stuffed_pages.stuffed_pages(docs.limit(0), labels).collect() == []
    assert stuffed_pages.stuffed_pages(docs, labels.limit(0)).collect() == []


def test_phrases_count_hosts(spark):
    shared = "the starting dose was raised by ten every week\n"
    docs = spark.createDataFrame([(1, shared + "a b c d e f g h", "h1"), (2, shared, "h2"), (3, "nothing like any of the others here now", "h1"), (4, "nothing like any of the others here now", "h1")], "doc_id bigint, text string, source string")
    at = stuffed_pages.FEATURES.index("replicated")
    got = {r["doc_id"]: r["features"][at] for r in stuffed_pages.page_features(docs).collect()}
    assert got[2] == 1 and 0.5 < got[1] < 1 and got[3] == got[4] == 0


def test_every_shingle_of_a_segment_counts(spark):
    """Every word that a phrase of several hosts covers counts, a phrase being the set of its words; brute force by words."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 12, 50, 90]))] for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [p[(a := rng.randrange(len(p))) : a + rng.randrange(1, 60)] for p in rng.choices(pool, k=rng.randrange(4))]
        parts += [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 45))]]
        docs.append((i % 55, parts, f"host{rng.randrange(8)}" if i % 9 else None))
    shingles = lambda p: [(k, tuple(p[k : k + 5])) for k in range(max(1, len(p) - 4))]
    hosts = defaultdict(set)
    for _, parts, host in docs:
        for p in parts:
            for _, s in shingles(p):
                hosts[frozenset(s)].add(host)
    want = Counter()
    for i, parts, _ in docs:
        shares = []
        for least in (2, 5):
            hit = [{k + j for k, s in shingles(p) for j in range(len(s)) if len(hosts[frozenset(s)]) >= least} for p in parts]
            shares.append(round(sum(map(len, hit)) / sum(map(len, parts)), 4))
        want[i, *shares] += 1
    df = spark.createDataFrame([(i, "\n".join(" ".join(p) for p in parts), host) for i, parts, host in docs], "doc_id bigint, text string, source string")
    for given in (df, df.repartition(5)):
        assert Counter((r["doc_id"], *(round(x, 4) for x in r["features"][-2:])) for r in stuffed_pages.page_features(given).collect()) == want
    small = stuffed_pages.page_features(df, words_each=200).collect()
    assert Counter((r["doc_id"], *(round(x, 4) for x in r["features"][-2:])) for r in small) == want


def test_nothing_is_found_without_replication(spark):
    """The same pages on one host: no phrase is replicated elsewhere, so no page has any evidence."""
    rows = list(pages(200, 3))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 100], "doc_id bigint, is_stuffed bigint")
    on = lambda hosts: spark.createDataFrame([(i, t, f"h{i % hosts}") for i, t, _ in rows], "doc_id bigint, text string, source string")
    assert stuffed_pages.stuffed_pages(on(1), labels).collect() == []
    assert len(stuffed_pages.stuffed_pages(on(7), labels).collect()) > 60
    assert all(not any(r["features"]) for r in stuffed_pages.page_features(on(1)).collect() if r["doc_id"] % 5 < 1)


def test_page_columns_and_copies(spark):
    rows = [(1, "a b\u2028c d e f", None, "x"), (1, "a b\u2028c d e f", "h", "x"), (None, "a b c", "h", "y"), (2, "\ud83d\ude00 #x#y €5", "h", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, block string")
    got = [(r["doc_id"], round(r["features"][-2], 2)) for r in stuffed_pages.page_features(docs).collect()]
    assert sorted(got) == [(1, 1.0), (1, 1.0), (2, 0.0)]
