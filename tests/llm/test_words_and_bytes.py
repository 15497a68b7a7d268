"""Source divergence, importance resampling and byte-level BPE against brute force, and on odd inputs."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tickgrid.llm import byte_bpe, divergence, importance, queries, words
from tickgrid.llm.base import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, rank int, g string, p string, bucket int"


def frame(spark, rows):
    """Documents with more columns, whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "x", 1, "g", "p", 3) for r in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# words
@given(st.lists(st.text("aB9 .é\x00ß-", max_size=30), max_size=6), st.integers(0, 3), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_windows_hold_every_word_once(texts, carry, window):
    got = defaultdict(list)
    for own, rows, fresh in words.windows([t.encode() for t in texts], words.ALNUM, carry, window):
        assert len(own) == len(rows) == len(fresh)
        for w, r, f in zip(own, rows.tolist(), fresh.tolist(), strict=True):
            if f and w:
                got[r].append(w.decode())
    assert {i: v for i, v in got.items()} == {i: v for i, t in enumerate(texts) if (v := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)))}


# 11
def brute_audit(rows, least, terms):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: [counts[lang, s][t] for t in kept] for la, s in groups if la == lang}
        whole = [sum(c[i] for c in own.values()) for i in range(len(kept))]
        share = lambda c: [1 + 10**9 * (n + 5) // (sum(c) + 5 * len(kept)) for n in c]
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            far = sorted([(-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in own if o != s])
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(far)}
            marks = sorted([(b - a, t.encode(), t) for t, n, a, b in zip(kept, own[s], p[s], q, strict=True) if n and a > b])[:terms]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(marks)}
    return out


def corpus(seed, groups, n):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ab", "Zé", "q", "μ") for b in "abcdefghij"]
    some = {s: r.sample(vocabulary, 12) + vocabulary[:4] for s in groups}
    return [(i, " ".join(r.choices(some[s], k=r.randrange(0, 15))) + "9", r.choice(["en", None, "De"]), s) for i in range(n) for s in [r.choice(groups)]]


@pytest.mark.parametrize("block, tile, light", [(256, 1024, 64), (3, 4, 64), (4, 8, 2), (3, 4, 0)])
def test_divergence_matches_brute_force(spark, monkeypatch, block, tile, light):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "LIGHT_MOST", light)
    rows = [*corpus(3, [None, *"ABCDEFGHIJ"], 260), (900, None, "en", "void"), (901, "", "la", "s"), (902, "lonely words", "la", "t")]
    got = [tuple(r) for r in divergence.audit(frame(spark, rows), least_docs=6, terms=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 6, 5)


def test_divergence_odd(spark):
    same = [(4, "twice the same row", "en", "a")] * 40 + [(None, None, None, None), (5, "twice", "en", "b")]
    assert {tuple(r) for r in divergence.audit(frame(spark, same)).collect()} == brute_audit(same, 30, 50)
    assert divergence.audit(frame(spark, same[:1]).limit(0)).count() == 0
    long = [(1, "Wort " * 600_000 + "selten", "de", "a"), (2, "Wort selten", "de", "b")]
    assert {tuple(r) for r in divergence.audit(frame(spark, long), least_docs=2).collect()} == brute_audit(long, 2, 50)


def test_shares_are_exact_for_large_counts(spark):
    n, total = 8 * 10**14 + 7, 9 * 10**14 + 11
    assert spark.range(1).select(divergence.share(divergence.F.lit(n), divergence.F.lit(total))).first()[0] == 1 + 10**9 * n // total


# 12
def brute_resample(rows, items, orders, buckets, least, percent):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]
    own = [(i, w, grams(w)) for i, t in rows for w in [cut(t)]]
    s, t = Counter(b for _, _, g in own for b in g), Counter(b for x in items for b in grams(cut(x)))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, w, g in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        out.append([i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [k + 1 if k < len(able) * percent // 100 else None for k in range(len(able))]
    return Counter((*r, k) for r, k in [*zip(able, ranks, strict=True), *((r, None) for r in out if r[1] < least)])


@pytest.mark.parametrize("orders, window", [(1, 1 << 21), (2, 64), (3, 40), (5, 100)])
def test_runs_of_suffix_arrays_are_the_ngrams(orders, window):
    texts = [t.encode() for t in (" ".join(random.Random(orders).choices(["a", "B", "é9", "--", "a b"], k=n)) for n in range(60))] + [b"", None]
    n_words, n, found = importance.listed(texts, orders, 97, window)
    at = 0
    for t, k, m in zip(texts, n_words.tolist(), n.tolist(), strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered((t or b"").decode()))
        want = Counter(zlib.crc32(" ".join(w[i : i + o]).encode()) % 97 for o in range(1, orders + 1) for i in range(len(w) - o + 1))
        assert k == len(w) and Counter(found[at : at + m].tolist()) == want
        at += m
    assert at == len(found)


def test_suffix_order_is_by_depth():
    ids = np.random.default_rng(1).integers(0, 3, 200)
    for depth in (1, 2, 3, 5, 7, 8):
        padded = [*ids.tolist(), *[0] * depth]
        keys = [tuple(padded[i : i + depth]) for i in importance.suffix_order(ids, depth).tolist()]
        assert keys == sorted(keys) and sorted(importance.suffix_order(ids, depth).tolist()) == list(range(200))


@pytest.mark.parametrize("orders, least, percent", [(1, 3, 50), (3, 0, 100), (2, 5, 10)])
def test_resample_matches_brute_force(spark, orders, least, percent):
    r = random.Random(orders)
    rows = [(i, " ".join(r.choices(["the", "of", "Über", "x1", "?", "rare" + str(i)], k=r.randrange(12)))) for i in range(150)]
    rows += [(None, None), (7, ""), (8, rows[8][1]), (8, rows[8][1]), (None, "the of the of the of"), (999, "word " * 500_000)]
    items = ["of the x1", None, "über über"]
    got = importance.resample(frame(spark, [(i, t, None, None) for i, t in rows]), spark.createDataFrame([(t,) for t in items], "text string"), orders=orders, buckets=50, least_words=least, percent=percent)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == brute_resample(rows, items, orders, 50, least, percent)


def test_resample_odd(spark):
    docs, items = frame(spark, [(1, "one two", None, None)]), spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), items).count() == 0
    only = importance.resample(docs, items, least_words=1, percent=100).first()
    assert only["rank"] == 1 and only["n_features"] == 2


# 13
@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


@pytest.fixture(scope="module")
def bpe(library):
    keys, values = zip(*library[1].items(), strict=True)
    return byte_bpe.Encoder(byte_bpe.PerfectHash.build(list(keys), list(values)), public_tokenizers.PATTERN)


def test_perfect_hash_has_a_slot_for_each_key(library, bpe):
    keys = list(library[1])
    assert bpe.whole.find(keys).tolist() == list(library[1].values()) and len(bpe.whole.values) == len(keys)
    strange = [k + b"\x00" for k in keys] + [b"", b"not a token at all"]
    assert bpe.whole.find(strange).tolist() == [library[1].get(k, -1) for k in strange]
    tiny = byte_bpe.PerfectHash.build([b"a", b""], [5, 6])
    assert tiny.find([b"", b"a", b"b"]).tolist() == [6, 5, -1] and byte_bpe.PerfectHash.build([], []).find([b"x"]).tolist() == [-1]


def same_as_library(bpe, library, texts):
    ids, n = bpe.encode(texts)
    own = np.split(ids, np.cumsum(n)[:-1])
    assert [x.tolist() for x in own] == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x.tobytes()).decode() for x in own] == texts


@given(st.lists(st.text("ab e'stxZ01 \n\t!?.,é中한🙂　\x00\x85́", max_size=40) | st.text(max_size=15), min_size=1, max_size=8), st.sampled_from([4, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_encoding_matches_the_library(bpe, library, texts, window):
    before, byte_bpe.WINDOW = byte_bpe.WINDOW, window
    try:
        same_as_library(bpe, library[0], [t.encode("utf-8", "replace").decode() for t in texts])
    finally:
        byte_bpe.WINDOW = before


def test_long_pieces_and_a_small_memory(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MISSES", 3)
    r = random.Random(2)
    made = ["".join(r.choices("etaoinshrdlu", k=n)) for n in (1, 7, 30, 5000)]
    same_as_library(bpe, library[0], [*made, " ".join(r.choices(made[:3], k=200)), "a" * 20_000, " " * 3000, "é" * 999, ""])


def test_bpe_query_matches_the_library(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op13_byte_bpe(spark, sf).collect()}
    own = table(spark, sf, "documents").collect()
    assert len(got) == len(own)
    for r in own:
        ids = library[0].encode_ordinary(r["text"] or "")
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_bpe_odd(spark, library):
    rows = [(None, None, None, None), (1, "", None, None), (1, "twice", None, None), (1, "twice", None, None), (2, "mot àpart " * 300_000, None, None)]
    docs = frame(spark, rows)
    v = byte_bpe.vocabulary(docs)
    got = byte_bpe.decode(byte_bpe.encode(docs, v), v)
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["decoded"]).decode()) for r in got.collect()) == Counter((r[0], len(library[0].encode_ordinary(r[1] or "")), r[1] or "") for r in rows)
    lists = [r["token_ids"] for r in byte_bpe.unpacked(byte_bpe.encode(docs, v)).collect() if r["doc_id"] == 1]
    assert sorted(lists) == [[], *[library[0].encode_ordinary("twice")] * 2]
    assert byte_bpe.encode(docs.limit(0), v).count() == 0
