"""PII, decontamination, quality, toxicity, tokens, packing and HTML against brute force and accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import rows_of, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import chat, decontam, html_main, packing, pii, quality, tokens, toxicity
from geoloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == sql_rows(sf_dir, ORACLES[name])


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": lambda: True, "ip": lambda: all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]():
                out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="ab1.@_+- (2)9%é", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == slow_spans(text)


@pytest.mark.parametrize("text", ["", "a" * 200_000, "1" * 200_000, "+1" * 50_000, "@" * 50_000, "a@b." * 20_000, "1.1" * 30_000, "4111 1111 1111 1111 and 4111-1111-1111-1112"])
def test_base_spans_of_long_texts(text):
    found = pii.base_spans(text)
    assert found == sorted(found, key=lambda s: (pii.BASE.index(s[0]), s[1]))


@pytest.mark.parametrize("n", [63, 64, 65, 256, 257, 603, 100_000])
def test_added_spans_cover_the_whole(n):
    run = "a1b2c3d4e5" * (n // 10 + 1)
    assert pii.proposals(f"x token={run[:n]} y") == [("secret", 8, 8 + n), ("secret", 8, 8 + n)]
    assert pii.proposals(f"x {run[:n]} y") == [("secret", 2, 2 + n)]
    assert [s for s in pii.proposals(f"! {run[:n]} [at] {run[:n]} (dot) org !") if s[0] == "email"] == [("email", 2, 2 * n + 18)]
    assert [s for s in pii.proposals(f"(at) {run[:n]}.b (at) c.d_e(at)f.g") if s[0] == "email"] == [("email", 5, n + 16), ("email", n + 16, n + 25)]


def test_whole_secrets_are_redacted(spark):
    secret = "A1b2C3d4e5F6" * 50
    docs = spark.createDataFrame([(1, f"the token={secret} end")], "doc_id long, text string")
    every = pii.SpanModel(tuple(range(pii.N_CODES)), ())
    assert pii.redact(docs, every).first().text == "the token=[SECRET] end"


def test_veiled_addresses_in_any_case():
    for text in ("john.doe (at) site (dot) com", "JOHN.DOE (AT) SITE (DOT) COM", "John.Doe [At] Site.Com"):
        assert [s for s in pii.proposals(text) if s[0] == "email"] == [("email", 0, len(text))]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii_query(spark, small):
    rows = QUERIES["op3_pii_weak_supervision"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in small[0].collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    added = [s for r in rows for s in r.spans.split(",") if s.startswith("secret")]
    assert added


def test_pii_odd_tables(spark):
    texts = [None, "", "mail me: ann (at) example (dot) com or ann@example.com", "password=hunter22aa1 call +1 (499) 555-6503", "x" * 100_000]
    df = docs(spark, texts).withColumnRenamed("lang", "spans")
    found = pii.annotate(df)
    model = pii.fit(found)
    clean = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert clean[0] is None and clean[1] == "" and "ann@example.com" not in clean[2] and "555-6503" not in clean[3] and clean[4] == texts[4]
    empty = pii.annotate(docs(spark, []))
    assert empty.count() == 0 and pii.fit(empty).accepted == ()


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.8, 0.6)], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    p, right = pii.expectation_maximisation(votes, np.ones(4000))
    assert right[0] > right[1] > right[2] and ((p > 0.5) == truth).mean() > 0.9


# ---- decontamination


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=70), st.lists(st.integers(1, 4), max_size=80))
@settings(max_examples=150, deadline=None)
def test_part_distance(item, text):
    assert decontam.part_distance(item, text, 99)[0] == slow_distance(item, text)


def planted(items, rng, vocabulary, n):
    rows = []
    for _ in range(n):
        key, text = rng.choice(items)
        words = text.split()
        for _ in range(decontam.edits_allowed(len(decontam.words_of(text)))):
            at, kind = rng.randrange(len(words)), rng.choice("sdi")
            words[at : at + (kind != "i")] = [] if kind == "d" and len(words) > 1 else [rng.choice(vocabulary)]
        rows.append((key, " ".join([*rng.choices(vocabulary, k=40), *words, *rng.choices(vocabulary, k=40)])))
    return rows


def test_recall_of_edited_items(spark):
    rng = random.Random(1)
    vocabulary = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60)))) for k in range(60)]
    rows = planted(items, rng, vocabulary, 600)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminations(docs(spark, [t for _, t in rows]), bench).collect()}
    blocks = {(r.doc_id, r.item_id) for r in decontam.contaminations(docs(spark, [t for _, t in rows]), bench, block=17).collect()}
    true = [(d, k) for d, (k, t) in enumerate(rows) if slow_distance(decontam.words_of(dict(items)[k]), decontam.words_of(t)) <= decontam.edits_allowed(len(decontam.words_of(dict(items)[k])))]
    assert len(set(true) & found) >= 0.99 * len(true) and found == blocks
    for d, k in found:
        assert slow_distance(decontam.words_of(dict(items)[k]), decontam.words_of(rows[d][1])) <= decontam.edits_allowed(len(decontam.words_of(dict(items)[k])))


def test_very_long_item(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    bent = [w if rng.random() > 0.1 else "other" for w in words]
    texts = [" ".join(["before"] * 50 + bent + ["after"] * 50), " ".join(rng.sample(words, len(words)))]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "five short words are here")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminations(docs(spark, texts), bench).collect()] == [(0, 1)]


def test_short_items():
    rng = random.Random(8)
    items = [[rng.randrange(1, 9) for _ in range(n)] for n in (1, 2, 3, 4, 5) for _ in range(6)]
    known = {str(w).encode(): w for w in range(1, 9)}
    found = decontam.Items(list(range(len(items))), items, known)
    texts = [[rng.randrange(1, 12) for _ in range(rng.randrange(40))] for _ in range(60)]
    got = {(k, i): (edits, end) for k, i, edits, end in found.matches([" ".join(map(str, t)) for t in texts])}
    for k, text in enumerate(texts):
        for i, item in enumerate(items):
            truth = decontam.part_distance(item, text, 9)
            assert got.get((k, i)) == (truth if truth[0] <= (len(item) == 5) else None)


def test_every_window_of_a_range(monkeypatch):
    line = list(range(1, 17))
    item = line * 2 + list(range(17, 25))
    found = decontam.Items([0], [item], {str(w).encode(): w for w in range(1, 25)})
    rows, sampled = [], found.sampled
    monkeypatch.setattr(found, "sampled", lambda windows, size: rows.append(len(windows)) or sampled(windows, size))
    monkeypatch.setattr(decontam, "AT_ONCE", 500)
    monkeypatch.setattr(found, "table", np.zeros(0, np.uint64))  # nothing meets, so nothing ends early
    text = " ".join(map(str, line * 500 + list(range(17, 25))))
    assert list(found.matches([text])) == [] and sum(rows) > 7900 and max(rows) == 500


@pytest.mark.parametrize("n", [5, 6, 7, 10, 15, 40, 100, 200, 400])
def test_recall_by_length(n):
    rng = random.Random(n)
    vocabulary = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k in range(20)]
    known: dict[bytes, int] = {}
    words = [[known.setdefault(w, len(known) + 1) for w in decontam.words_of(t)] for _, t in items]
    rows = planted(items, rng, vocabulary, 100)
    got = {(k, i) for k, i, *_ in decontam.Items([k for k, _ in items], words, known).matches([t for _, t in rows])}
    number = lambda t: [known.get(w, 0) for w in decontam.words_of(t)]
    true = {(d, k) for d, (k, t) in enumerate(rows) if decontam.part_distance(words[k], number(t), n)[0] <= decontam.edits_allowed(n)}
    assert len(true) >= 95 and len(true & got) >= 0.99 * len(true)


def test_decontamination_of_the_tables(spark, sf_dir):
    """All pairs of documents and items by edit distance."""
    docs_, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    known: dict[bytes, int] = {}
    items = [(r.item_id, [known.setdefault(w, len(known) + 1) for w in decontam.words_of(r.text)]) for r in bench]
    truth = set()
    for r in docs_:
        ids = [known.get(w, 0) for w in decontam.words_of(r.text)]
        near = set(ids)
        truth |= {(r.doc_id, i) for i, w in items if len(near & set(w)) * 2 >= len(set(w)) and decontam.part_distance(w, ids, len(w))[0] <= decontam.edits_allowed(len(w))}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate_cgk"](spark, sf_dir).collect()}
    assert got <= truth and len(got) >= 0.99 * len(truth) > 0


def test_decontaminate_odd_tables(spark):
    texts = ["x one two three four five six seven y", None, "", "One, TWO three; four five six seven!", "one two three", "z " * 50_000 + "one two three four five six seven"]
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (4, "a b"), (5, "one two three")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.contaminations(docs(spark, texts), bench).collect())
    assert found == [(0, 1), (0, 5), (3, 1), (3, 5), (4, 5), (5, 1), (5, 5)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs(spark, texts), bench).collect()) == [1, 2]
    nameless = spark.createDataFrame([(None, "one two three four five six seven y", 1), (None, None, 2)], "doc_id long, text string, item_id int")
    bench_ = spark.createDataFrame([(None, "one two three four five six seven", 9)], "item_id long, text string, doc_id int")
    assert [tuple(r)[:2] for r in decontam.contaminations(nameless, bench_).collect()] == [(None, None)]
    assert [tuple(r) for r in decontam.decontaminate(nameless, bench_).collect()] == [(None, None, 2)]
    assert decontam.decontaminate(docs(spark, texts), bench, block=2).count() == 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminations(docs(spark, texts), none).count() == 0 and decontam.decontaminate(docs(spark, texts), none).count() == 6
    assert decontam.contaminations(docs(spark, []), bench).count() == 0


# ---- chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be [kind]"), (1, 1, "user", "</s><s>[x]\n\\l"), (1, 2, "assistant", "a\\\\b"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", "q"), (None, 0, "assistant", "é😀"), (3, None, None, "x"), (3, 1, "assistant", "y"), (3, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, example string, k int")
    got = chat.examples(df.select("conv_id", "turn", "role", "text", "example", "k"))
    counts = {}
    for r in got.collect():
        counts[r.conv_id] = counts.get(r.conv_id, 0) + 1
    assert counts == {1: 3, 2: 1, None: 1, 3: 2}
    from pyspark.sql import functions as F

    back = {(r.conv_id, r.example): ([tuple(t) for t in r.turns], r.loss) for r in got.select("conv_id", "example", chat.parse_turns(F.col("text")).alias("turns"), chat.masked(F.col("text"), F.col("mask_start"), F.col("mask_length")).alias("loss")).collect()}
    assert back[1, 0] == ([("system", "be [kind]"), ("user", "</s><s>[x]\n\\l"), ("assistant", "a\\\\b")], "a\\\\b")
    assert back[1, 2][0][3:] == [("user", ""), ("assistant", ""), ("user", "bye")] and back[1, 2][1] == ""
    assert back[None, 0] == ([("assistant", "é😀")], "é😀") and back[2, 0] == ([("user", "q")], "")
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


def test_chat_is_native(spark, sf_dir):
    plan = QUERIES["op5_prefix_targets"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- quality


def test_quality_against_labels(spark, small):
    decided = {r.doc_id: r.kept for r in quality.importance_sample(*small).collect()}
    labels = {r.doc_id: r.quality for r in small[1].collect()}
    good = [decided[d] for d, q in labels.items() if q == 1 and d in decided]
    bad = [decided[d] for d, q in labels.items() if q == 0 and d in decided]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_weights_against_counting(spark, sf_dir):
    """Every weight of the smallest tables against dictionaries of n-grams."""
    docs_, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))

    def grams(text):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", (text or "").encode())
        h = [zlib.crc32(w) for w in words]
        out = [x % (quality.BUCKETS - 1) for x in h]
        for a, b in zip(h, h[1:]):
            mixed = ((a * 0x9E3779B1 + b) * 0xC2B2AE3D27D4EB4F % 2**64) >> 40
            out.append(quality.BUCKETS - 1 if a == b else mixed % (quality.BUCKETS - 1))
        return out

    rows = docs_.collect()
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    raw, aim = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for r in rows:
        for g in grams(r.text):
            raw[g] += 1
            aim[g] += known.get(r.doc_id) == 1
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    got = quality.importance_sample(docs_, labels).collect()
    weight = {r.doc_id: r.log_weight for r in got}
    assert len(got) == len(rows) and all(abs(weight[r.doc_id] - sum(ratio[g] for g in grams(r.text))) < 1e-6 for r in rows)
    share = sum(v == 1 for v in known.values()) / len(known)
    k = round(min(1, share + 1.96 * (share * (1 - share) / len(known)) ** 0.5) * len(rows))
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: -r.gumbel_key)[:k]}


def test_quality_keeps_columns_of_any_name(spark, small):
    docs_ = small[0].limit(50).withColumn("noise", F.lit(1)).withColumn("__noise", F.lit("x")).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    kept = quality.keep_sample(docs_, small[1])
    assert kept.columns == docs_.columns and 0 < kept.count() <= 50


def test_threshold_is_exact(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.standard_normal(3000) * 100, np.zeros(500), [1e-300, 1e300, -1e300]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    for k in (1, 2, 100, 1700, 2200, 3502):
        assert quality.kth_largest(df, "v", k) == np.sort(values)[-k]
    assert quality.kth_largest(df, "v", len(values)) is None and quality.kth_largest(df.limit(0), "v", 1) is None


def test_quality_odd_tables(spark):
    df = docs(spark, [None, "", "good text here", "good text here", "*** !!! ***", "long " * 50_000]).withColumnRenamed("lang", "kept")
    labels = spark.createDataFrame([(2, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.importance_sample(df, labels).collect()
    assert len(got) == 6 and all(np.isfinite(r.log_weight) for r in got)
    assert all(r.kept for r in quality.importance_sample(df, labels.limit(0)).collect())
    assert quality.importance_sample(docs(spark, []), labels).count() == 0


# ---- toxicity


def test_toxicity_held_out(spark, small):
    rows = QUERIES["op7_toxicity_bigru"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == small[0].count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    texts = {r.doc_id: r.text for r in small[0].collect()}
    marked = re.compile("pathetic|disgusting|loser|scum|idiot|clown|moron|stupid|worthless|trash")
    toxic = {r.doc_id for r in small[1].collect() if r.toxic == 1 and marked.search((texts.get(r.doc_id) or "").lower())}
    hits = [r.predicted for r in rows if r.held_out and r.doc_id in toxic]
    clean = [r.predicted for r in rows if r.held_out and not marked.search((texts[r.doc_id] or "").lower())]
    assert np.mean(hits) >= 0.8 and np.mean(clean) <= 0.1


def test_gradients():
    net = toxicity.Network([b"a", b"b", b"c"])
    for k in net.p:
        net.p[k] = net.p[k].astype(float)
    words, rng = [b"a", b"b", b"c", b"zz"], np.random.default_rng(0)
    ids, y = rng.integers(1, 5, (6, toxicity.WINDOW)), rng.integers(0, 2, 6).astype(float)
    ids[0, 20:] = ids[1, 3:] = 0
    inputs = np.concatenate([np.zeros((1, toxicity.WORD_DIM + toxicity.CHAR_DIM)), net.inputs(words)])

    def loss():
        s = toxicity._sigmoid(net.run(net.gates(inputs), ids).astype(float))
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g, _ = net.gradients(inputs, net.gates(inputs), ids, y)
    for name in ("uf", "ub", "wf", "wb", "cf", "cb", "v", "out", "bias"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        slope = (up - loss()) / 2e-3
        net.p[name][at] += 1e-3
        assert slope == pytest.approx(float(g[name][at]), abs=2e-4)


def test_forward_pass_against_a_loop_over_words():
    """One window at a time, one word at a time, one hidden unit at a time where it matters."""
    words = [b"the", b"quick", b"unseen", b"fox", b"a"]
    net = toxicity.Network([b"the", b"quick", b"fox"], seed=3)
    h, p = toxicity.HIDDEN, {k: v.astype(float) for k, v in net.p.items()}
    table = np.concatenate([np.zeros((1, toxicity.WORD_DIM + toxicity.CHAR_DIM), np.float32), net.inputs(words)])
    ids = np.array([[1, 2, 3, 4, 5, 0], [3, 3, 0, 0, 0, 0]])
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        marked = b"^" + word + b"$"
        rows = [(marked[k] * 7919 + marked[k + 1] * 104729 + marked[k + 2] * 1299709) % toxicity.CHAR_BUCKETS for k in range(len(word))]
        known = {b"the": 2, b"quick": 3, b"fox": 4}.get(word, 1)
        return np.concatenate([p["word"][known], np.mean([p["char"][r] for r in rows], axis=0)])

    def states(seq, way):
        s, out = np.zeros(h), []
        for x in seq:
            g, u = x @ p[f"w{way}"] + p[f"c{way}"], s @ p[f"u{way}"]
            z, r = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
            s = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * s
            out.append(s)
        return out

    got = net.run(net.gates(table), ids)
    for row, logit in zip(ids, got):
        seq = [vector(words[k - 1]) for k in row if k]
        both = [np.concatenate(pair) for pair in zip(states(seq, "f"), states(seq[::-1], "b")[::-1])]
        weight = np.exp([s @ p["v"] for s in both])
        assert abs(sum(w * s for w, s in zip(weight / weight.sum(), both)) @ p["out"] + p["bias"][0] - logit) < 1e-4
    scorer, text = toxicity.Scorer(net), b" ".join(words * 20).decode()
    each = [float(sigmoid(net.run(net.gates(table), np.array([([1, 2, 3, 4, 5] * 20 + [0] * 40)[k : k + toxicity.WINDOW]])[:, :])[0])) for k in toxicity.window_starts(100)]
    assert abs(scorer.scores([text])[0] - max(each)) < 1e-5


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append(sorted(texts)))
    rows = [(k, f"text {k} " + "x" * (1000 if k == 8 else 10)) for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    docs_ = spark.createDataFrame(rows + rows[:3] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows] + [(None, 1)], "doc_id long, toxic int")
    toxicity.fit(docs_, labels)
    toxicity.fit(docs_, labels, max_bytes=200)
    assert seen[0] == sorted(t for _, t in rows) and 0 < sum(map(len, seen[1])) <= 200


def test_windows_cover_everything():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        w = toxicity._windows(np.arange(1, n + 1))
        assert set(w.ravel().tolist()) - {0} == set(range(1, n + 1)) and len(w) >= 1


def test_training_sees_every_window(monkeypatch):
    rng = np.random.default_rng(4)
    net = toxicity.Network([])
    gates = net.gates(np.concatenate([np.zeros((1, toxicity.WORD_DIM + toxicity.CHAR_DIM)), rng.standard_normal((50, toxicity.WORD_DIM + toxicity.CHAR_DIM))]).astype(np.float32))
    docs = [rng.integers(1, 51, n).astype(np.int32) for n in (0, 1, 31, 32, 33, 56, 57, 4000, 20_000)]
    for rows in (3, 64, 4096):
        monkeypatch.setattr(toxicity, "ROWS", rows)
        for ids, first in zip(docs, toxicity.highest(net, gates, docs)):
            scores = net.run(gates, toxicity._windows(ids))
            assert first % toxicity.STEP == 0 and scores[first // toxicity.STEP] >= scores.max() - 1e-5


def test_training_scores_all_windows_of_long_texts(monkeypatch):
    run, rows = toxicity.Network.run, []

    def spy(self, gates, ids, keep=None):
        if keep is None:
            rows.append(len(ids))
        return run(self, gates, ids, keep)

    monkeypatch.setattr(toxicity.Network, "run", spy)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    assert toxicity.train(["a b c d " * 5000, "a b c e " * 10], [1, 0], epochs=4) is not None
    assert set(rows) == {len(toxicity.window_starts(20_000)) + len(toxicity.window_starts(40))}


def test_toxicity_odd_tables(spark):
    df = docs(spark, [None, "", "a b", "x " * 60_000]).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    assert all(r.score == 0 for r in toxicity.score(df, toxicity.fit(df, labels.filter("toxic = 0"))).collect())
    net = toxicity.train(["you idiot " * 5, "a nice day " * 5] * 8, [1, 0] * 8, epochs=2)
    assert len(toxicity.score(df, net).collect()) == 4
    assert toxicity.score(docs(spark, []), net).count() == 0


# ---- tokens and packing

ODD = [None, "", "<|endoftext|>", "a<|endoftext|>b  c", "<|endoftext", "x​　 y", " \n\n \t x", "é" * 10, "x" * 3000, "😀😀 1234 ½ Ⅷ ٣٤", "a" * 1023 + " b", "hello " * 20_000, "x" + " " * 300_000 + "y", "\n" * 200_000, "ab" * 50_000]


def reference_ids(texts):
    t = tokens.tokenizer(public_tokenizers.path(tokens.VOCABULARY))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts(spark):
    got = {r.doc_id: r for r in tokens.token_counts(docs(spark, ODD).withColumnRenamed("lang", "n_tokens")).collect()}
    for k, ids in enumerate(reference_ids(ODD)):
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (len(ids), len((ODD[k] or "").encode()), len(ids) > 512)
    nameless = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in tokens.token_counts(nameless).collect()) == [(0, 0, False), (3, 2, False)]
    assert sorted(tuple(r)[:3] + (r.doc_tokens,) for r in packing.pack(nameless).collect()) == [(None, 0, 1, 1), (None, 0, 3, 3)]
    assert tokens.token_counts(docs(spark, [])).count() == 0


def test_both_encoders_agree_on_all_characters():
    texts = ["".join(f"{chr(c)} {chr(c)}a{chr(c)}" for c in range(k, k + 512) if not 0xD800 <= c < 0xE000) for k in range(0, 0x20000, 512)]
    texts += [" ".join(map(chr, range(k, k + 4096))) for k in range(0x20000, 0x110000, 4096)]
    count = tokens.Counter(tokens.frequent_lengths(public_tokenizers.path(tokens.RANKS)), public_tokenizers.path(tokens.RANKS)).count
    for text, ids in zip(texts, reference_ids(texts)):
        assert tokens.token_ids(text).tolist() == ids and count(text) == len(ids)


def test_small_cache_counts_the_same(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    counter = tokens.Counter({}, public_tokenizers.path(tokens.RANKS))
    for text, ids in zip(ODD, reference_ids(ODD)):
        assert counter.count(text or "") == len(ids)


def check_packing(rows, texts):
    ids = [[*i, 0] for i in reference_ids(texts)]
    by_seq, seen = {}, {}
    for r in rows:
        own = np.array(ids[r.doc_id], "<u4")
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and 0 < r.length <= 1024
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in [*by_seq.values(), *seen.values()]:
        at = 0
        for begin, n in sorted(parts):
            assert begin == at
            at += n
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == {d: len(i) for d, i in enumerate(ids)}
    assert all(sum(n for _, n in p) <= 1024 for p in by_seq.values())
    return by_seq


def test_packing(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choices(["the", "of", "zebra", "qx"], k=rng.randrange(1, 900))) for _ in range(300)]
    by_seq = check_packing(packing.pack(docs(spark, texts).withColumnRenamed("lang", "start")).collect(), texts)
    total = sum(n for p in by_seq.values() for _, n in p)
    assert total / (1024 * len(by_seq)) > 0.95
    assert packing.pack(docs(spark, [])).count() == 0


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=200, deadline=None)
def test_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms, truth = [], []
    for n in lengths:
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if not fit:
            rooms.append(64)
            fit = [len(rooms) - 1]
        least = min(rooms[k] for k in fit)
        truth.append(64 - least)
        rooms[next(k for k in fit if rooms[k] == least)] -= n
    assert [o for _, o in packing.pack_lengths(iter(lengths), 64)] == truth


# ---- HTML

ARTICLE = ["A head &amp; more", "First  paragraph\n of   the text, with <b>bold</b> and <a href='x'>a link</a>.", "ok", "Last one&nbsp;here."]
PLAIN = "A head & more\nFirst paragraph of the text, with bold and a link.\nok\nLast one here."
AROUND = [
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>{}</body></html>", "<body><nav><ul><li><a href=/>menu</a></li></ul></nav><article>{}</article><footer>&copy; foot</footer>",
    "<header><h1>site</h1></header><aside>side bar</aside><main>{}</main><div class='comments'><p>a reader's comment, quite long indeed, with many words in it</p></div>",
    "<div class='ad banner'>buy now</div><article>{}<aside>more</aside><form><input>send <button>go</button></form></article><script>var x = '</p>';</script>",
    "<div class='page with-sidebar'><ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul><div class='text'>{}</div></div>",
    "<div id=cookie-notice><p>we use cookies</p></div><div class=content>{}</div><section class='related posts'><p>other article teaser text</p></section>",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("markup", ["<h1>{}</h1><p>{}</p><p>{}</p><p>{}</p>", "<h1>{}</h1><p>{}<p>{}<p>{}", "<h2>{}</h2><div>{}</div><div>{}</div><blockquote>{}</blockquote>"])
def test_main_text(around, markup):
    assert html_main.main_text(around.replace("{}", markup.format(*ARTICLE))) == PLAIN


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><body><article><p>one</p><p>two</p></article></body></html>", "one\ntwo"),
        ("<head><title>t<body><p>one</p><p>two</p>", "one\ntwo"),
        ("<head><title>a <p> b</title><meta charset=x><p>one", "one"),
        ("<head><title>t</title>one<p>two", "one\ntwo"),
        ("<head><title>t</title>one", "one"),
        ('<p>One <svg class="i"/> two</p><p>three</p>', "One two\nthree"),
        ('<p>One <svg class="i"> two</p><p>three</p>', "One two\nthree"),
        ("<p>One <math><mi>x</mi></math> two</p><select><option>a<option>b</select><p>three</p>", "One x two\nthree"),
        ("<p>One <svg><title>icon</title><text>label</text></svg> two</p>", "One label two"),
        ("<head-line>one</head-line><p>two <title-x>three</title-x></p><script-x>four</script-x>", "one\ntwo three\nfour"),
        ('<ul><li class="share">a<li>b</ul><p>one</p>', "b\none"),
        ('<ul><li class="share">a</ul><p>one</p>', "one"),
        ('<dl><dt>a<dd class="share">b<dt>c<dd>d</dl><p>one</p>', "a\nc\nd\none"),
        ('<table><tr><td class="ad">a<td>b<tr class="ad"><td>c<tr><td>d</table><p>one</p>', "b\nd\none"),
        ('<ul><li class="share">a<ul><li>b</ul><li>c</ul>', "c"),
        ('<div><nav><a href="/">m</a></div><p>one</p>', "one"),
        ("<form><p>one</p><p>two</p>", "one\ntwo"),
        ('<div><div class="ad">a<div>b</div></div><p>one</p></div>', "one"),
        ("<!--><p>one</p>", "one"),
        ("<p>one</p><script>x <p>two</p>", "one"),
        ("<p>one</p><!-- x <p>two</p>", "one"),
    ],
)
def test_elements_end_where_html_ends_them(page, text):
    assert html_main.main_text(page) == text


LONG = "word " * 199 + "word"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<ul><li class=ad>buy<li>item</ul><p>{LONG}", f"item\n{LONG}"),
        (f"<table><tr><td class=ad>buy<td>cell</table><p>{LONG}", f"cell\n{LONG}"),
        (f"<p>{LONG}</p><nav><a href=/>menu</a></nav><p>last</p>", f"{LONG}\nlast"),
        ("<p>see <a href=1>all of this long text in a link</a></p><p>and <a href=2>this too</a></p>", "see all of this long text in a link\nand this too"),
        ("<p><a href=1>home</a> | <a href=2>news</a></p>", ""),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>a teaser of another text</p></article>", f"{LONG}\n{LONG}"),
        (f"<aside data-u=http://a/b/>menu</aside><p>{LONG}</p>", LONG),
        (f"<main><p>lead</p><aside>x</aside><div><p>{LONG}</p></div><aside>y</aside><p>end</p></main><div><p>about this site</p></div>", f"lead\n{LONG}\nend"),
        (f"<main><h1>head</h1><article><p>{LONG}</p><nav>m</nav><p>end</p></article></main>", f"head\n{LONG}\nend"),
        ("<article><p>short</p></article><div><p>some more words about us</p></div>", "short"),
    ],
)
def test_surge_and_dive_decide(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div><p>lead</p><div class='ad'>buy</div><p>{LONG}</p></div>", f"lead\n{LONG}"),
        (f"<div><p>{LONG}</p><aside>buy</aside><p>{LONG}</p><form>send</form><p>last</p></div>", f"{LONG}\n{LONG}\nlast"),
        (f"<body><p>lead</p><div class='ad'>buy</div><p>{LONG}</p></body>", f"lead\n{LONG}"),
        (f"<body><div>lead</div><div class='ad'>buy</div><div>{LONG}</div></body>", f"lead\n{LONG}"),
        (f"<div id=c><section><p>lead</p></section><div class='ad'>buy</div><section><p>{LONG}</p></section></div>", f"lead\n{LONG}"),
        (f"<div><h1><a href=/>head</a></h1><p>{LONG}</p></div>", f"head\n{LONG}"),
        (f"<h1><a href=/>head</a></h1><div class=text><p>{LONG}</p><p>{LONG}</p></div>", f"head\n{LONG}\n{LONG}"),
        (f"<div>{LONG}<br><table class=ad><tr><td>buy</table>last</div>", f"{LONG}\nlast"),
        (f"<div id=top><p>site</p><p>tag line</p></div><nav>m</nav><div id=c><p>{LONG}</p><p>{LONG}</p></div><nav>m</nav><div id=end><p>right</p><p>of copy</p></div>", f"{LONG}\n{LONG}"),
        (f"<div><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a><li><a href=4>four</a></ul><p>last</p></div>", f"{LONG}\nlast"),
    ],
)
def test_short_regions_of_the_article(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_do_not_need_the_article_element(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("html").collect()
    for h in (r.html for r in rows):
        assert html_main.main_text(h.replace("<article>", "<div>").replace("</article>", "</div>")) == html_main.main_text(h)


def test_pages_against_their_article(spark):
    import html

    for p, r in zip(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect(), QUERIES["op10_line_blocks"](spark, "/root/testdata/sf0.01").orderBy("page_id").collect()):
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text) and r.url == p.url


@pytest.mark.parametrize("part", ['<a "', "<div '", "<", "<p>", "<!--", "<script ", "<script>", '<b "x>', "&", '<a href="', "</"])
def test_hostile_markup_takes_linear_time(part):
    import time

    began = time.time()
    html_main.main_text(part * 40_001)
    assert time.time() - began < 5


def test_html_odd_tables(spark):
    pages = [None, "", "just text", "<p>open <b>never closed", "<", "<div", "&amp &lt;b&gt; &#233;&#xe9;", "<script>only</script>", "<nav>a</nav>", "<p>x</p>" * 20_000]
    df = spark.createDataFrame([(k, None, h, "t", 1) for k, h in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert got[0] == got[1] == got[7] == got[8] == "" and got[2] == "just text" and got[3] == "open never closed" and got[6] == "& <b> éé" and got[9].count("\n") == 19_999
    assert html_main.extract(df.limit(0)).count() == 0


def test_regions():
    assert html_main.regions([0, 0, 5, 1, 0, 9, 0, 0, 0, 3]) == [(2, 6, 10), (9, 10, 3)]
