"""Each operator against a brute-force version, a round trip or held-out labels, and on odd inputs."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tickgrid.llm import base, chat, components, decontaminate, embedding_dedup, jaccard_forest, language_id, mixing, pii_crf, queries, textvec, token_store, toxicity, weak_quality
from tickgrid.llm.base import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "palabra otra vez " * 40_000


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, null and empty texts, repeated rows, a very long text."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words of a row without an id here", None, "b", 1), (3, "?? 12 !!", "en", None, 8), (4, "the same row twice over again here", "en", "s", 1), (4, "the same row twice over again here", "en", "s", 1), (5, LONG, "es", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(7)).withColumn("id", F.lit("x"))


def rows_of(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


# 1
def test_language_held_out(spark, sf):
    got = rows_of(queries.op1_language_id(spark, sf))
    told = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    assert len(got) == len(told)
    for i, r in got.items():
        assert r[0]["held_out"] == (fold(i, 4) == 2) and 0 <= r[0]["score"] <= 1
    own = [i for i in got if got[i][0]["held_out"] and told[i]["lang"]]
    assert np.mean([got[i][0]["lang_pred"] == told[i]["lang"] for i in own]) > 0.95


def test_language_odd(spark, docs, odd):
    model = language_id.fit(docs)
    out = rows_of(language_id.identify(odd, model))
    assert out[1][0]["lang_pred"] == out[2][0]["lang_pred"] == out[3][0]["lang_pred"] == "und" and out[1][0]["score"] == 0
    assert out[5][0]["lang_pred"] in model.languages and len(out[4]) == 2 and out[4][0]["score"] == out[4][1]["score"] <= 1
    assert {r[0]["lang_pred"] for r in rows_of(language_id.identify(odd, language_id.fit(docs.limit(0)))).values()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_codewords_are_apart():
    for n in (1, 2, 4, 7, 30):
        c = language_id.codewords(n)
        assert len({tuple(x) for x in c.tolist()}) == n
        if n > 2:
            assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 3


def plain_vector(text, orders, bits):
    """Hashed n-gram shares by loops, for one text."""
    c, n, total = [ord(x) for x in text], {}, 0
    for k in orders:
        for i in range(len(c) - k + 1):
            h = 0
            for j in range(k):
                h = (h * 0x01000193 + c[i + j] + j + 1) % (1 << 32)
            at = (h * 0x9E3779B1) % (1 << 32) >> (32 - bits)
            n[at] = n.get(at, 0) + 1
            total += 1
    return {at: math.sqrt(v / total) for at, v in n.items()}


def test_language_query_matches_plain_decoding(spark, sf):
    model = language_id.fit(language_id.train_split(table(spark, sf, "documents").select("doc_id", "text", "lang")))
    got = rows_of(queries.op1_language_id(spark, sf))
    for d in table(spark, sf, "documents").collect():
        own = got[d["doc_id"]][0]
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
            continue
        x = plain_vector(d["text"].lower(), language_id.ORDERS, language_id.BITS)
        far = []
        for k in range(len(model.languages)):
            loss = 0.0
            for bit in range(model.codes.shape[1]):
                margin = float(model.bias[bit]) + sum(v * float(model.weights[at, bit]) for at, v in x.items())
                loss += float(model.trust[k, bit]) * math.log1p(math.exp(-margin * float(model.codes[k, bit])))
            far.append(loss)
        p = [math.exp(4 * (min(far) - f)) for f in far]
        top = sorted(far)
        if len(top) < 2 or top[1] - top[0] > 1e-3:
            assert own["lang_pred"] == model.languages[far.index(min(far))]
        assert abs(own["score"] - max(p) / sum(p)) < 5e-3


# 2
def brute_spans(text):
    out = []
    for k, (pattern, good) in enumerate([
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii_crf.luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]):
        out += [(k, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return out


@pytest.mark.parametrize("text", ["a@b.c@d.ef", "x..y@mail.example.com.", "@a.b c@ d@e", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.3.0255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (974) 555-3436 é +12 3", "+1......", "a@b.co+1 234 567 8901", "1.1.1.256.7.8.9", "0000001.1.1.1"])
def test_base_spans(text):
    assert sorted(pii_crf.base_spans(text)) == sorted(brute_spans(text))


def test_base_spans_of_random_texts():
    r = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(r.choice(list("a1 4.@+-()9é%\n"), 40))
        assert sorted(pii_crf.base_spans(text)) == sorted(brute_spans(text)), text


def test_pii_query(spark, sf):
    out = rows_of(queries.op2_pii(spark, sf))
    for r in table(spark, sf, "documents").collect():
        spans = brute_spans(r["text"] or "")
        own = out[r["doc_id"]][0]
        names = [f"{pii_crf.KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans)]
        every = own["spans"].split(",") if own["spans"] else []
        told = [m for m in re.finditer(r"token = \"([0-9a-f]{40})\"", r["text"] or "") if any(c.isdigit() for c in m[1])]
        assert {f"secret:{m.start(1)}:{m.end(1)}" for m in told} <= set(every) and own["n_spans"] == len(every) == len(names) + own["n_added"]
        assert own["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [own[f"n_{k}"] for k in pii_crf.KINDS[:4]] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert set(names) <= set(every)


def test_skip_edges_add_the_distant_repeat(spark):
    text = "write to +1 (974) 555-3436 now " + "word " * 200 + "or 19745553436 later, room 12 at 9:30"
    rows = spark.createDataFrame([(i, f"call +1 (9{i % 10}4) 555-34{i % 90 + 10} or mail a{i}@b.com {i} items, code {i * 7919}") for i in range(200)], "doc_id long, text string")
    weights = pii_crf.fit(rows)
    added = [s for s in pii_crf.find(text, weights) if s[3] == "crf"]
    assert [text[a:z] for _, a, z, _, _ in added] == ["19745553436"] and pii_crf.KINDS[added[0][0]] == "phone"


@pytest.fixture(scope="module")
def pii_weights(spark):
    r = np.random.default_rng(12)
    rows = []
    for i in range(400):
        a, b, c = (int(x) for x in r.integers(100, 999, 3))
        rows.append((i, f"call +1 ({a}) 555-{b}{i % 10} or mail u{a}.{b}@host{c}.org from 10.{a % 256}.{b % 256}.{c % 256}, v2.{i % 9}, item {i}, {a}.{b} euros, token = \"{hashlib.sha1(bytes([i % 256, a % 256])).hexdigest()}\" and 4111 1111 1111 1111"))
    return pii_crf.fit(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("known, other, kind", [
    ("+1 (974) 555-3436", "974 555 3436", "phone"), ("+1 (974) 555-3436", "(974) 555-3436", "phone"), ("+1 (974) 555-3436", "1 974 555 3436", "phone"), ("+1 (974) 555-3436", "974-555-3436", "phone"),
    ("jo.doe@mail1.example.com", "jo.doe (at) mail1 (dot) example (dot) com", "email"), ("jo.doe@mail1.example.com", "jo.doe at mail1 dot example dot com", "email"), ('token = "5f790b897549d620aedfc0705a565f96e3741e89"', "5f790b897549d620aedfc0705a565f96e3741e89", "secret"),
])
def test_similar_tokens_share_labels(pii_weights, known, other, kind):
    text = f"first {known} then {'word ' * 150}again <{other}> and room 12 at 9:30, chapter 4.2, 20 pages"
    added = [(pii_crf.KINDS[k], text[a:z]) for k, a, z, source, _ in pii_crf.find(text, pii_weights) if source == "crf"]
    assert added == [(kind, other)]


def test_context_decides_what_is_a_secret(pii_weights):
    made = hashlib.sha1(b"x").hexdigest()
    for text, kinds in ((f'token = "{made}"', ["secret"]), (f"the commit {made} of page 12", []), (f'see {made} then token = "{made}" and {made}', ["secret"] * 3)):
        got = pii_crf.find(text, pii_weights)
        assert [pii_crf.KINDS[k] for k, *_ in got] == kinds
    assert [s for *_, s, _ in got] == ["crf", "context", "crf"]  # the repeats follow the one that its context tells


@pytest.mark.parametrize("text", ["+1 (974) 555-3436 or 974 555 3436, room 12", 'token = "5f790b897549d620aedfc0705a565f96e3741e89" 5f790b897549d620aedfc0705a565f96e3741e89 x9', "jo@a.example.com, jo (at) a (dot) example (dot) com 7 7", "call 974 555 3436 or 974-555-3436 or (974) 555 3436", "4111 1111 1111 1111 and 4111111111111112 of 10.1.2.3"])
def test_added_spans_match_exact_marginals(pii_weights, text):
    own, clamped, unary = pii_crf.potentials(text, pii_crf.base_spans(text) + pii_crf.seeds(text), pii_weights)
    edges, power = pii_crf.edges_of([text[a:z] for a, z, _ in own])
    p = np.zeros(unary.shape)
    for y in np.ndindex(*[6] * len(own)):
        p[np.arange(len(own)), y] += math.exp(sum(unary[i, k] for i, k in enumerate(y)) + sum(w * (y[a] == y[b]) for (a, b), w in zip(edges.tolist(), power, strict=True)) - 30 * sum(map(bool, clamped)))
    p /= p.sum(axis=1, keepdims=True)
    want = {(int(p[i].argmax()) - 1, a, z) for i, (a, z, _) in enumerate(own) if not clamped[i] and p[i].argmax() and p[i].max() >= pii_crf.ADD}
    assert {s[:3] for s in pii_crf.find(text, pii_weights) if s[3] != "base"} == want and len(own) <= 6


def test_clean_texts_get_no_span(pii_weights):
    for text in ("section 4.2 of 2019, 300 items at 12:45 and 7 more", "version 2.0. and 3.11.4 of 1999-12-31", "9446062893 is a number", "a dot at the end, at noon", "numbers 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"):
        assert pii_crf.find(text, pii_weights) == []


def test_pii_precision_and_recall_of_added_spans(pii_weights):
    r = np.random.default_rng(21)
    right = added = planted = 0
    for i in range(200):
        a, b, c = (int(x) for x in r.integers(1000, 9999, 3))
        user, host, number = f"u{a}", f"m{b % 7}.example.org", f"{c}{a}{b}"[:10]
        other = [f"{user} (at) {host.replace('.', ' (dot) ')}", f"{number[:3]} {number[3:6]} {number[6:]}"][i % 2]
        text = f"see {user}@{host} or +1 ({number[:3]}) {number[3:6]}-{number[6:]} {'x ' * 60} items {a} of {b}.{c % 10}, {other if i % 4 < 3 else a} end"
        got = [text[x:z] for _, x, z, source, _ in pii_crf.find(text, pii_weights) if source == "crf"]
        planted, added, right = planted + (i % 4 < 3), added + len(got), right + (i % 4 < 3 and other in got)
    assert right / planted > 0.95 and right / added > 0.95


def test_pii_fit_on_nothing(spark, odd):
    assert pii_crf.fit(odd.limit(0)) is None and pii_crf.fit(odd) is None


def test_propagation_is_exact_on_a_chain():
    r = np.random.default_rng(0)
    u, e, w = r.normal(size=(4, 3)), np.array([(0, 1), (1, 2), (2, 3)]), np.array([0.5, 1.0, 2.0])
    got = pii_crf.propagate(u, e, w, rounds=60)
    want = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        p = math.exp(sum(u[i, y[i]] for i in range(4)) + sum(w[k] * (y[a] == y[b]) for k, (a, b) in enumerate(e)))
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_pii_odd(spark, odd):
    out = rows_of(odd.select("doc_id", pii_crf.finder(None, spark)("text").alias("f")).select("doc_id", "f.*"))
    assert out[1][0]["spans"] == out[2][0]["spans"] == out[5][0]["spans"] == ""
    assert pii_crf.base_spans("1" * 100_000 + " " + "a" * 100_000 + "@") == []


# 3
def test_mixing_reaches_targets(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out, model = mixing.mix(docs, labels, mixing.domain_of_labels(), {"clean": 0.7, "low": 0.3})
    rows = out.collect()
    n = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([r["posterior"] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    total = (n * rate) @ p / n.sum()
    assert (rate >= 0).all() and np.abs(total - model.wanted).max() < 0.05
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}


def test_every_step_descends_at_least_as_the_plain_gradient(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.4, 0.4, 0.2], 300)
    n = r.integers(1, 500, 300)
    w, want = n / n.sum(), np.array([0.9, 0.07, 0.03])
    model = mixing.fit_rates(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posterior array<double>"), mixing.MixingModel(["clean", "low", "toxic"], None, None), mixing.TARGETS)
    value = lambda x: ((w * x @ p - want) ** 2).sum() / 2 + mixing.RIDGE / 2 * w @ (x - 1) ** 2
    x = np.ones(300)
    for length, pull in model.steps:
        slope = p @ (w * x @ p - want) + mixing.RIDGE * (x - 1)
        plain = np.maximum(0, x - slope / (1 + mixing.RIDGE))
        x = mixing.stepped(x, p, length, pull)
        assert (x >= 0).all() and value(x) <= value(plain) + 1e-15
    assert 0 < len(model.steps) < 60 and (x == model.rates(p)).all() and (x == 0).any()


def test_mixing_keeps_labelled_domains(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").withColumn("truth", mixing.domain_of_labels())
    out, model = mixing.mix(table(spark, sf, "documents").select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"), mixing.domain_of_labels(), mixing.TARGETS)
    assert np.abs(model.reached - model.wanted).max() < 0.01
    got = {r["truth"]: r for r in out.join(labels, "doc_id").where("truth IS NOT NULL").groupBy("truth").agg(F.avg((F.col("domain") == F.col("truth")).cast("double")).alias("right"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")).collect()}
    assert got["toxic"]["right"] > 0.8 and got["clean"]["right"] > 0.95 and got["low"]["right"] > 0.8
    total = sum(r["tokens"] for r in got.values())
    for name, want in mixing.TARGETS.items():
        assert abs(got[name]["tokens"] / total - want) < 0.04 and got[name]["tokens"] > 0.5 * want * total


@pytest.mark.parametrize("spread, most", [(1.0, 0.9), (2.0, 0.9), (2.0, 0.05)])
def test_fit_rates_reaches_the_minimum(spark, spread, most):
    r = np.random.default_rng(3)
    own = r.choice(3, 600, p=[1 - most - 0.05, 0.05, most])
    z = r.normal(0, 1, (600, 3)) + spread * np.eye(3)[own]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    n = r.integers(1, 500, 600)
    held = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    model = mixing.fit_rates(held, mixing.MixingModel(["clean", "low", "toxic"], None, None), mixing.TARGETS)
    w, want = n / n.sum(), np.array([0.9, 0.07, 0.03])
    x = ahead = np.ones(600)
    t = 1.0
    for _ in range(20_000):
        pull = p @ (w * ahead @ p - want) + mixing.RIDGE * (ahead - 1)
        before, x = x, np.maximum(0, ahead - 0.9 * pull)
        if pull @ (w * (x - before)) > 0:
            t = 1.0
        t, past = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = x + (past - 1) / t * (x - before)
    pull = p @ (w * x @ p - want) + mixing.RIDGE * (x - 1)
    assert np.abs(x - np.maximum(0, x - pull)).max() < 1e-6  # the plain solver has settled
    rate = model.rates(p)
    assert np.abs(rate @ (p * w[:, None]) - x @ (p * w[:, None])).max() < 1e-4 and np.sqrt(w @ (rate - x) ** 2) < 2e-3
    assert np.abs(model.reached - rate @ (p * w[:, None])).max() < 1e-6


def test_mixing_odd(spark, odd, sf):
    none = table(spark, sf, "labels").limit(0)
    out, model = mixing.mix(odd, none, mixing.domain_of_labels(), mixing.TARGETS)
    assert model is None and {r["copies"] for r in out.collect()} == {1}
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "\n a b"), (4, " \xa0 "), (5, "x\u3000y\x1cz \t")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.mix(blank, none, mixing.domain_of_labels(), mixing.TARGETS)[0].collect()} == {1: 0, 2: 0, 3: 2, 4: 0, 5: 3}
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    out, _ = mixing.mix(odd, labels, mixing.domain_of_labels(), mixing.TARGETS)
    got = rows_of(out)
    assert len(got[4]) == 2 and got[4][0]["copies"] == got[4][1]["copies"] and got[1][0]["n_tokens"] == 0
    rates = {i: r[0]["rate"] for i, r in got.items()}
    assert all(v >= 0 for v in rates.values())
    assert mixing.mix(odd.limit(0), labels, mixing.domain_of_labels(), mixing.TARGETS)[0].count() == mixing.resample(odd.limit(0), labels, mixing.domain_of_labels(), mixing.TARGETS).count() == 0
    twice = labels.unionByName(spark.createDataFrame([(4, 1, 1), (4, 1, 0)], labels.schema))
    assert mixing.fit_classifier(odd, twice, mixing.domain_of_labels()).domains == ["low", "toxic"]
    back = mixing.resample(odd, labels, mixing.domain_of_labels(), mixing.TARGETS)
    assert back.columns == odd.columns and back.count() == out.agg(F.sum("copies")).first()[0]


# 4
def test_chat_matches_a_plain_reading(spark, sf):
    want = {}
    for r in table(spark, sf, "conversations").collect():
        want.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    want[-1] = [(0, "user", queries.EXTRA_TEXT), (1, "assistant", queries.EXTRA_TEXT)]
    got = {r["conv_id"]: r for r in queries.op4_chat(spark, sf).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts_and_escapes(spark):
    texts = ["<|im_start|>x", "<\\|a", "<\\\\|", "a<", "|b", "é\n<|image:0|>", "", None, "%0A%25"]
    rows = [(1, i, "ro%le\n<|" if i == 2 else "assistant", [("text", t, None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), None, ("audio", None, "a.wav", None, None, 1.5, None), ("odd", "z", None, None, None, None, None)]) for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    held = chat.assemble(chat.format_turns(turns))
    r = held.select("*", chat.parse(F.col("formatted")).alias("b")).select("*", F.transform("b", chat.turn_text).alias("t"), F.transform("b", chat.turn_role).alias("r"), chat.masked(F.col("b"), F.col("loss_spans")).alias("m")).first()
    assert r["t"] == [(t or "") + "<|image:0|><|audio:1|>z" for t in texts]
    assert r["r"][2] == "ro%le\n<|" and len(r["m"]) == len(texts) - 1
    assert [(a["turn"], a["number"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]][:2] == [(0, 0, "image", "i.png", 3), (0, 1, "audio", "a.wav", 38)]
    assert r["attachment_tokens"] == 41 * len(texts)


def test_chat_odd(spark):
    turns = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.assemble(chat.format_turns(turns.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    assert out[None]["formatted"] == "<|im_start|>\n<|im_end|>\n" and out[1]["formatted"].count("<|im_start|>") == 2
    assert chat.assemble(chat.format_turns(turns.limit(0).withColumn("parts", chat.text_parts(F.col("text"))))).count() == 0


# 5
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf).collect()}
    own = [r for r in table(spark, sf, "labels").collect() if r["toxic"] is not None and fold(r["doc_id"], 5) == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in own)
    right = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in own]
    assert np.mean([a == b for a, b in right]) > 0.98
    assert sum(a and b for a, b in right) / max(1, sum(b for _, b in right)) > 0.9  # some labels mark texts without a toxic word


def test_toxicity_query_matches_plain_scanning(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    assert model.weights
    got = rows_of(queries.op5_toxicity(spark, sf))
    for d in docs.collect():
        folded = toxicity.fold(d["text"] or "")
        found = []
        for term in [*model.weights, *model.exceptions]:
            at = folded.find(term)
            while at >= 0:
                z = at + len(term)
                if not (at and folded[at - 1].isalnum()) and not (z < len(folded) and folded[z].isalnum()):
                    found.append((at, -z, term))
                at = folded.find(term, at + 1)
        weight, n, free = 0.0, 0, 0
        for a, z, term in sorted(found):
            if a >= free:
                free = -z
                if term not in model.exceptions:
                    weight, n = weight + model.weights[term], n + 1
        a, b, c = model.scale
        score = 1 / (1 + math.exp(-(a * math.log1p(weight) + b * weight / (1 + len(folded) / 1000) + c)))
        own = got[d["doc_id"]][0]
        assert own["n_hits"] == n and abs(own["score"] - score) < 1e-3 and own["predicted"] == (own["score"] >= 0.5)


def test_toxicity_folds_and_exceptions():
    m = toxicity.ToxicityModel({toxicity.fold("idiot"): 2.0, "trash": 1.0}, {"trash can"})
    found = lambda t: [x[0] for x in toxicity.matches(m, t)[0]]
    assert found("an 1D10T, іdіоt! i​diot") == ["idiot"] * 3
    assert found("idiotic trash can, trashy") == [] and found("TRASH") == ["trash"]
    assert found("tr@sh tra$h ｔｒａｓｈ trásh 𝐭𝐫𝐚𝐬𝐡 id!ot ID|OT") == ["trash"] * 5 + ["idiot"] * 2
    assert found("trash! idiot!") == ["trash", "idiot"] and toxicity.fold("$100 a@1 x") == "$ioo a@i x"


def test_all_harmless_phrases_are_learned(spark):
    rows = [(f"uu{i} vv{i} zzbad xx{i}", 1) for i in range(20)] + [(f"cc{i} dd{i} ee{i}", 0) for i in range(120)]
    rows += [(f"kk{i} {w} zzbad {w}{i}", 0) for w in ("amber", "brown", "cream") for i in range(3)]
    weights, harmless = toxicity._learn_words(spark.createDataFrame(rows, "t string, y int"), "t", "y")
    assert set(weights) == {toxicity.fold("zzbad")} and harmless == {toxicity.fold(f"{w} zzbad") for w in ("amber", "brown", "cream")}


def test_toxicity_odd(spark, odd, sf):
    model = toxicity.fit(odd, table(spark, sf, "labels").limit(0))
    out = rows_of(odd.select("doc_id", toxicity.scorer(model, spark)("text").alias("s")))
    assert all(0 <= r["s"]["score"] < 0.5 for rs in out.values() for r in rs) and len(out[4]) == 2


# 6
def brute_words(t):
    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if w]


def test_decontamination_matches_brute_force(spark, sf):
    runs = lambda t: {tuple(w[i : i + 5]) for w in [brute_words(t)] for i in range(len(w) - 4)}
    items = [(r["item_id"], runs(r["text"])) for r in table(spark, sf, "benchmark").collect()]
    want = {}
    for d in table(spark, sf, "documents").collect():
        own = runs(d["text"])
        for i, s in items:
            if s and len(s & own) >= 0.8 * len(s):
                want[d["doc_id"], i] = (len(s), len(s & own))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in queries.op6_decontamination(spark, sf).collect()}
    assert got == want and want


def test_decontamination_of_items_of_all_sizes(spark):
    r = np.random.default_rng(4)
    made = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    items = [(i, made(n)) for i, n in enumerate([1, 2, 4, 5, 6, 8, 9, 11, 13, 14, 24, 35, 36, 90, 131, 132, 400, 515, 516, 900])]
    docs = []
    for i, w in items:
        for k, share in enumerate((1.0, 0.9, 0.82, 0.78, 0.5)):  # a run of the item inside other words
            docs.append((10 * i + k, [*made(30 * (k % 3)), *w[: round(share * (len(w) - 4)) + 4], *made(20 * (k % 2))]))
    docs += [(5000, items[5][1] + items[12][1] + items[19][1]), (5001, made(3000))]
    cut = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}
    want = {(d, i) for d, t in docs for i, w in items if len(cut(w) & cut(t)) >= 0.8 * len(cut(w))}
    frame = lambda rows, kind: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], kind)
    got = [(x["doc_id"], x["item_id"]) for x in decontaminate.search(frame(docs, "doc_id long, text string"), frame([*items, (3, items[3][1]), (99, items[13][1])], "item_id long, text string")).collect()]
    assert len(got) == len(set(got)) and {x for x in got if x[1] < 99} == want
    assert {d for d, i in got if i == 99} == {d for d, i in want if i == 13} and len(want) > 50


def test_decontamination_odd(spark, odd):
    items = spark.createDataFrame([(1, "twice over again here THE SAME row, twice over: again here"), (2, "few words only"), (7, "other words that are nowhere in the documents"), (7, "the same row twice over again"), (3, None), (4, "words of a row without an id"), (4, "words of a row without an id")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.search(odd, items, containment=0.2).collect()} == {(4, 1), (4, 7)}
    short = spark.createDataFrame([(1, "Few, words!", "x"), (2, "a few words more", "x"), (3, "few words", None), (None, "few words", "y")], "doc_id long, text string, _dirty string")
    two = spark.createDataFrame([(1, "few words"), (None, "a few words more")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.search(short, two).collect()) == [(1, 1), (3, 1)]
    assert [tuple(r) for r in decontaminate.remove(short, two).collect()] == [(2, "a few words more", "x")]
    kept = decontaminate.remove(odd, items.where("item_id <> 7"))
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 2, 3, 4, 4, 5]  # the row with no id goes: it holds item 4
    assert decontaminate.search(odd, items.limit(0)).count() == 0 and decontaminate.search(odd.limit(0), items).count() == 0


# 7
def brute_vectors(rows):
    good = {}
    for n, r in enumerate(rows):
        v = r["embedding"]
        if v and r["label"] is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[n] = x / np.sqrt(x @ x)
    links = {n: {m for m in good if m != n and rows[m]["label"] == rows[n]["label"] and len(good[m]) == len(good[n]) and good[m] @ good[n] >= 0.98} for n in good}
    out = []
    for n, r in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((r["vec_id"], len(links.get(n, ())), min(rows[m]["vec_id"] for m in seen)))
    return sorted(out)


def test_embeddings_match_brute_force(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    got = queries.op7_embedding_dedup(spark, sf).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings_odd_and_blocked(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.normal(size=8)
    rows = [(i, [float(x) for x in (base + r.normal(size=8) * 0.05)], 1) for i in range(60)] + [(60 + i, [1.0] * 8, 1) for i in range(9)]
    rows += [(80, None, 1), (81, [0.0] * 8, 1), (82, [float("nan")] * 8, 1), (83, [1.0] * 8, None), (84, [None, 1.0], 1), (85, [1.0] * 4, 1), (86, [], 1), (87, [1.0] * 8, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    got = embedding_dedup.dedup(frame).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == brute_vectors(frame.collect())
    assert embedding_dedup.dedup(frame.limit(0)).count() == 0


def test_components(spark):
    r = np.random.default_rng(4)
    e = [(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in r.integers(100, 160, (25, 2))] + [(7, 7), (None, 3)]
    up = {}
    root = lambda i: i if up.setdefault(i, i) == i else root(up[i])
    for a, b in e[:-2]:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if i < 100 or any(a != b and i in (a, b) for a, b in e)}


# 8
def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, sf).collect()}
    own = table(spark, sf, "labels").where("quality is not null").collect()
    low = [got[r["doc_id"]]["keep"] for r in own if r["quality"] == 0]
    good = [got[r["doc_id"]]["keep"] for r in own if r["quality"] == 1]
    assert np.mean(good) > 0.97 and np.mean(low) < 0.3


def test_quality_query_matches_plain_estimation(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    votes = {d["doc_id"]: weak_quality.votes(d["text"] or "") for d in docs}
    patterns = sorted(set(votes.values()))
    q = {v: min(0.98, max(0.02, (v.count("g") + 1) / (v.count("g") + 3 * v.count("b") + 2))) for v in patterns}
    for _ in range(weak_quality.ROUNDS):
        good, n = sum(q[v] for v in votes.values()), len(votes)
        share, rate = (good + 1) / (n + 2), {}
        for j in range(len(weak_quality.LABELLERS)):
            for c in "b-g":
                rate[1, j, c] = (sum(q[v] for v in votes.values() if v[j] == c) + 0.1) / (good + 0.3)
                rate[0, j, c] = (sum(1 - q[v] for v in votes.values() if v[j] == c) + 0.1) / (n - good + 0.3)
        for v in patterns:
            a = math.log(share) + sum(math.log(rate[1, j, c]) for j, c in enumerate(v))
            b = math.log(1 - share) + sum(math.log(rate[0, j, c]) for j, c in enumerate(v))
            q[v] = 1 / (1 + math.exp(min(50, max(-50, b - a))))
    model = weak_quality.fit(table(spark, sf, "documents"))
    got = rows_of(queries.op8_quality(spark, sf))
    for d in docs:
        own, text = got[d["doc_id"]][0], d["text"] or ""
        assert own["votes"] == votes[d["doc_id"]]
        if not text.strip():
            assert own["posterior"] == own["score"] == 0
            continue
        assert abs(own["posterior"] - q[own["votes"]]) < 1e-6
        z = model.bias + sum(v * float(model.weights[at]) for at, v in plain_vector(text, weak_quality.ORDERS, weak_quality.BITS).items())
        assert abs(own["score"] - 1 / (1 + math.exp(-z))) < 5e-3 and own["keep"] == (own["score"] >= 0.5)


def test_em_finds_accuracies():
    r = np.random.default_rng(6)
    y = r.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.85, 0.9])
    v = np.where(r.random((len(y), 8)) < right, y[:, None], ~y[:, None])
    counts = {}
    for row, mute in zip(v, r.random((len(y), 8)) < 0.3, strict=True):
        p = "".join("-" if m else "g" if x else "b" for x, m in zip(row, mute, strict=True))
        counts[p] = counts.get(p, 0) + 1
    model = weak_quality.estimate(counts)
    for (bad, good), want in zip(model.accuracy.values(), right, strict=True):
        assert abs(bad - want) < 0.05 and abs(good - want) < 0.05


def test_quality_odd(spark, odd):
    out = rows_of(odd.select("doc_id", weak_quality.scorer(weak_quality.fit(odd), spark)("text").alias("q")))
    assert not out[1][0]["q"]["keep"] and out[2][0]["q"]["score"] == 0 and len(out[4]) == 2
    assert weak_quality.fit(odd.limit(0)).posterior == {}


# 9
def test_tokens_match_the_library(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_vocabulary())
    got = {r["doc_id"]: r for r in queries.op9_token_store(spark, sf).collect()}
    start = 0
    for r in sorted(table(spark, sf, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[r["doc_id"]].asDict() == {"doc_id": r["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def encoded(own, batch):
    ids, n = own.encode(batch)
    ends = np.cumsum(n)
    return [ids[z - k : z].tolist() for k, z in zip(n.tolist(), ends.tolist(), strict=True)]


@pytest.mark.parametrize("window, cache", [(1 << 20, 250_000), (64, 30)])
def test_pieces_match_whole_texts(monkeypatch, window, cache):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_vocabulary())
    monkeypatch.setattr(token_store, "WINDOW", window)
    monkeypatch.setattr(token_store, "CACHE", cache)
    own = token_store.PieceEncoder(token_store.default_vocabulary())
    parts = ["It's", "we'LL", "naïve", "Ångström", "x_y", "1234", "½", "a b", "İstanbul", "ΣΑΣ", "é", "日本語", "“quoted”—", "don't", "<|endoftext|>", "<|startoftext|>", "!!'s", "🙂", "ǅ", "ß", "ẞ", "\x1f", "a\u0085b", "aª", "\t", "l'd'm", "''s", "'", "'re", "'rex", "'lx", "\x00", "\x01", "o'ver've", "x" * 300, "¼'S", "\n"]
    r = np.random.default_rng(8)
    batch = ["", " ", *parts, *[" ".join(r.choice(parts, 5)) for _ in range(300)], *["".join(r.choice(parts, 4)) for _ in range(300)]]
    assert encoded(own, batch) == [[*e.ids, 1] for e in t.encode_batch(batch, add_special_tokens=False)]
    plain = ["".join(r.choice(list("ab'srtvemld 1_.\n"), 60)) for _ in range(2000)]
    assert encoded(own, plain) == [[*e.ids, 1] for e in t.encode_batch(plain, add_special_tokens=False)]


def test_equal_hashes_do_not_mix_pieces():
    own = token_store.PieceEncoder(token_store.default_vocabulary())
    want = encoded(own, ["one two three one four two"])
    own.forget()
    own._hashes = lambda c, starts, ends: np.zeros(len(starts), np.uint64)
    assert encoded(own, ["one two three one four two"]) == want == encoded(own, ["one two three one four two"])


def test_added_tokens_match_a_plain_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_vocabulary())
    batch = ["x <|endoftext|> y", "<|startoftext|>Some words<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|b <|EndOfText|> <| endoftext|>", "plain words", "İ\xa0<|startoftext|>'s"]
    want = [t.encode(x, add_special_tokens=False).ids for x in batch]
    assert want[0] == [343, 49407, 344]
    assert encoded(token_store.encoder(token_store.default_vocabulary()), batch) == [[*w, 1] for w in want]
    files = token_store.write(spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string"))
    got = token_store.read(files).orderBy("doc_id").collect()
    assert [r["token_ids"] for r in got] == [[*w, 1] for w in want] and [r["start"] for r in got] == [sum(len(w) + 1 for w in want[:i]) for i in range(len(want))]


def test_tokens_odd(spark, odd):
    files = token_store.write(odd)
    rows = token_store.read(files).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 4, 5] and rows[1]["token_ids"] == rows[2]["token_ids"] == [1]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert [r["doc_id"] for r in token_store.read_documents(files, 2, 3).collect()] == [2, 3]
    assert token_store.checksums(token_store.read(token_store.write(odd.limit(0)))).count() == 0


# 10
def brute_join(rows, words=5, s=0.8):
    def grams(t):
        w = brute_words(t)
        n = min(words, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    sets = {t: grams(t) for t in {r["text"] or "" for r in rows}}
    names = [t for t in sets if sets[t]]
    where = {}
    for t in names:
        for g in sets[t]:
            where.setdefault(g, []).append(t)
    links = {t: set() for t in names}
    for t in names:
        for o in {o for g in sets[t] for o in where[g]} - {t}:
            if len(sets[t] & sets[o]) >= s * len(sets[t] | sets[o]) - 1e-9:
                links[t].add(o)
    ids = {}
    for r in rows:
        if r["doc_id"] is not None:
            ids.setdefault(r["text"] or "", []).append(r["doc_id"])
    out = []
    for r in rows:
        t = r["text"] or ""
        if not sets[t]:
            out.append((r["doc_id"], r["doc_id"], 0))
            continue
        seen, todo = {t}, [t]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        out.append((r["doc_id"], min((i for o in seen for i in ids.get(o, ())), default=None), len(links[t])))
    return sorted(out, key=str)


def test_join_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_jaccard_join(spark, sf).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_join(table(spark, sf, "documents").collect())


def test_join_odd_and_blocked(spark, odd, monkeypatch):
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    near = []
    for i in range(40):
        w = list(base)
        for j in r.integers(0, 60, r.integers(0, 3)):
            w[j] = f"x{j % 7}"
        near.append((100 + i, " ".join(w), None, None, None))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([*near, (200, "two words", None, None, None), (201, "Two, words!", None, None, None)], DOCS))
    monkeypatch.setattr(jaccard_forest, "BLOCK", 7)
    monkeypatch.setattr(jaccard_forest, "NODE", 9)
    got = jaccard_forest.join(docs).collect()
    assert sorted(((x["doc_id"], x["class_id"], x["n_links"]) for x in got), key=str) == brute_join(docs.collect())
    kept = jaccard_forest.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] or 0 for x in kept.collect() if (x["doc_id"] or 0) < 100) == [0, 1, 2, 3, 4, 5]
    assert jaccard_forest.join(docs.limit(0)).count() == 0


def test_join_keeps_one_where_ids_repeat_or_are_null(spark):
    a = " ".join(f"w{i}" for i in range(60))
    near = a.replace("w30", "x30")
    for ids in ((5, 5), (None, None), (None, 5)):
        docs = spark.createDataFrame([(ids[0], a), (ids[1], near), (ids[0], a)], "doc_id long, text string")
        assert len({r["text"] for r in jaccard_forest.keep_one(docs).collect()}) == jaccard_forest.keep_one(docs).count() == 1


def test_long_words_are_hashed_whole(monkeypatch):
    text = "start " + "abcdefgh" * 300 + " middle " + "z" * 1000 + " end of it"
    whole = textvec.word_hashes(text)
    monkeypatch.setattr(textvec, "PIECE", 64)
    monkeypatch.setattr(textvec, "_POWERS", [])
    assert len(whole) == 7 and (textvec.word_hashes(text) == whole).all()


def test_clashing_names(spark):
    """Columns named as the operators name their own leave the result alone."""
    names = ("_id", "_key", "_text", "_domain", "_h1", "_h2", "_kept", "_bare", "_twice", "_dirty", "_mix", "_n", "_label", "_rows", "_words", "lid", "tie", "id", "i", "y", "h", "own", "component", "size", "score", "toxic", "item_id", "told_ambiguous")
    text = "a text of more than five words that stands here"
    docs = spark.createDataFrame([(i, f"{text} {i * 7919}" if i % 2 else None, *["?"] * len(names)) for i in range(8)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    labels = spark.createDataFrame([(i, i % 2, 0, "z") for i in range(8)], "doc_id long, quality int, toxic int, text string")
    items = spark.createDataFrame([(1, "nothing that any document would hold at all", "z")], "item_id long, text string, doc_id string")
    rows = docs.count()
    assert jaccard_forest.keep_one(docs).columns == docs.columns and decontaminate.remove(docs, items).columns == docs.columns
    assert decontaminate.remove(docs, items).count() == rows
    assert mixing.resample(docs, labels, mixing.domain_of_labels(), {"clean": 1.0}).columns == docs.columns
    told = language_id.identify(docs, language_id.fit(docs.withColumn("lang", F.lit("en"))))
    assert told.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "score"] and told.count() == rows
    assert token_store.checksums(token_store.read(token_store.write(docs))).count() == rows
    assert docs.select(pii_crf.finder(None, spark)("text")).count() == docs.select(toxicity.scorer(toxicity.fit(docs, labels), spark)("text")).count() == rows
    assert docs.select(weak_quality.scorer(weak_quality.fit(docs), spark)("text")).count() == rows and decontaminate.search(docs, items).count() == 0
    vectors = spark.createDataFrame([(i, [1.0, 0.0], 1, *["?"] * 7) for i in range(3)], "vec_id long, embedding array<double>, label int, id string, l string, tab string, k1 string, size string, component string, pattern string")
    assert {tuple(r) for r in embedding_dedup.dedup(vectors).collect()} == {(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False)}
    turns = spark.createDataFrame([(1, 0, "user", "hello", "?", "?", "?")], "conv_id long, turn long, role string, text string, _body string, _head string, loss string")
    assert chat.assemble(chat.format_turns(turns.withColumn("parts", chat.text_parts(F.col("text"))))).count() == 1


def test_a_text_of_twenty_megabytes(spark):
    text = "some words that go on and on without an end in sight " * 400_000
    docs = spark.createDataFrame([(1, text, "en"), (2, "a short text of a few words", "en"), (3, text, "fr")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["n_copies"] for r in jaccard_forest.join(docs).collect()} == {1: 2, 2: 1, 3: 2}
    own = token_store.read(token_store.write(docs)).select("doc_id", "n_tokens").collect()
    assert len({r["n_tokens"] for r in own}) == 2
    items = spark.createDataFrame([(1, "words that go on and on without an end")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.search(docs, items).collect()) == [1, 3]
    out = docs.select("doc_id", pii_crf.finder(None, spark)("text").alias("p"), toxicity.scorer(toxicity.ToxicityModel({"sight": 1.0}), spark)("text").alias("t"), weak_quality.scorer(weak_quality.estimate({}), spark)("text").alias("q"))
    assert {r["doc_id"]: (r["p"]["n_spans"], len(r["t"]["hits"])) for r in out.collect()} == {1: (0, 400_000), 2: (0, 0), 3: (0, 400_000)}


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"wörd{i * 37 % 101}" for i in range(3000))
    whole = textvec.shingles(text)
    counts = textvec.ngram_counts(text, (1, 2, 3), 10)
    monkeypatch.setattr(textvec, "PIECE", 500)
    assert (textvec.shingles(text) == whole).all() and (textvec.ngram_counts(text, (1, 2, 3), 10) == counts).all()


# the pipeline
def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    told = corpus_pipeline.with_language(spark, docs, sf)
    pred = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit(language_id.train_split(docs)), prefix="told_").collect()}
    stays = {i: r["told_lang_pred"] for i, r in pred.items() if r["told_lang_pred"] != "und" and (r["told_lang_pred"] == r["lang"] or not r["told_ambiguous"])}
    assert told.columns == docs.columns and {r["doc_id"]: r["lang"] for r in told.collect()} == stays
    assert len(stays) > 0.98 * sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    odd = spark.createDataFrame([(1, docs.where("lang = 'en'").first()["text"], None), (2, docs.where("lang = 'en'").first()["text"], "de"), (3, "42 !!", "en"), (4, None, None)], "doc_id long, text string, lang string")
    mended = corpus_pipeline.with_language(spark, docs.select("doc_id", "text", "lang").unionByName(odd.select((-F.col("doc_id")).alias("doc_id"), "text", "lang")), sf)
    assert {r["doc_id"]: r["lang"] for r in mended.where("doc_id < 0").collect()} == {-1: "en", -2: "en"}
    one = corpus_pipeline.one_of_each(spark, told, sf)
    want = {c for _, c, _ in brute_join(told.collect())}
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(want)
    clean = corpus_pipeline.without_benchmark(spark, one, sf)
    dirty = {r["doc_id"] for r in decontaminate.search(one, table(spark, sf, "benchmark")).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == want - dirty
    out = corpus_pipeline.run(spark, sf)
    rows = out.orderBy("start").collect()
    assert {r["doc_id"] for r in rows} <= want - dirty and [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5


def test_rare_labels_do_not_teach(spark, monkeypatch):
    monkeypatch.setattr(base, "LABELS", 2)
    rows = spark.createDataFrame([(i, "abc"[min(i // 5, 2)]) for i in range(11)] + [(90, None)], "id long, y string")
    assert {r["y"] for r in base.sampled(rows, "y", 100, F.col("id")).collect()} == {"a", "b"}
    equal = spark.createDataFrame([(i, y) for i in range(3) for y in "cab"], "id long, y string")
    assert sorted(r["y"] for r in base.sampled(equal, "y", 100, F.col("id")).collect()) == ["a"] * 3 + ["b"] * 3
