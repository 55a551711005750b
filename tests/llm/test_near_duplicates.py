"""SimHash and embedding joins against brute force, on fixtures with copies, ties, nulls and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from geoloom.llm import embed_dedup, simhash
from geoloom.llm.components import connected_components, forest, settle


def closure(ids, pairs):
    """Smallest id reachable from each."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "chain": [(k, k + 1) for k in range(300)], "star": [(0, k) for k in range(1, 400)],
        "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(350)], "empty": [],
    }[shape]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + [(None, 1)], "x long, y long").repartition(7)
    found = {r.node: r.component for r in connected_components(df, "x", "y").collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert found == closure(linked, edges)


def test_forest():
    a, b = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 5: 1, 9: 8}
    assert settle(np.arange(4), np.array([3, 2]), np.array([2, 1])).tolist() == [0, 1, 1, 1]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", None, "one", "one two", "A b\tC\x0bd e", "a B c d\ne", "İ ß É x y z", "x " * 4000, "the cat sat on the mat", "no break space here now"]


def test_fingerprints(spark):
    for t in TEXTS:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    long = " ".join(f"w{k % 977}" for k in range(70_000))
    assert simhash.fingerprint(long) == slow_fingerprint(long)


def test_hash_is_the_one_of_sql(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] == np.array([xxhash.xxh64_intdigest(b"a b c", 42)], np.uint64).view(np.int64)[0]


def brute_simhash(rows):
    ids = [i for i, _ in rows]
    fp = [slow_fingerprint(t) for _, t in rows]
    pairs = [(ids[a], ids[b]) for a in range(len(rows)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 2]
    return {i: (f"{f:016x}", c) for (i, f), c in zip(zip(ids, fp), closure(ids, pairs).values())}


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    for k in range(20, 200):
        rows.append((k, " ".join(rng.choices(words, k=200))))
    for k in range(200, 400):
        base = rows[rng.randrange(20, 60)][1].split()
        base[rng.randrange(len(base))] = "changed"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame([(i, t, "e", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp string, component_id int").repartition(5)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert found == brute_simhash(rows)
    kept = {r.doc_id for r in simhash.deduplicate(df).collect()}
    assert kept == {c for _, c in found.values()}


def test_links_of_dense_and_large_cells(spark):
    """Many fingerprints in one cell, more than a chunk: all components are found."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 64, (60, 2))}
    fps |= {int(base[0]) ^ (1 << x) ^ (1 << y) for x in range(12) for y in range(x)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]), k) for k, f in enumerate(fps)], "fp long, rep long")
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    truth = closure(range(len(fps)), pairs)
    for chunk in (simhash.CHUNK, 16):
        found = {r.node: r.component for r in connected_components(simhash.links(df, chunk), "a", "b").collect()}
        assert {i: found.get(i, i) for i in truth} == truth


def test_simhash_odd_tables(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q")], schema)).select("doc_id", "component_id").collect()]
    assert sorted(rows, key=str) == [(4, 4), (4, 4), (None, 4), (None, None)]
    table = [(None, "a b c", 1), (4, "a b c", 2), (4, "a b c", 2), (9, "a b c", 3), (None, "q", 4), (None, "q", 4), (None, None, 5), (7, "other words", 6)]
    kept = simhash.deduplicate(spark.createDataFrame(table, "doc_id long, text string, fp int")).collect()
    assert sorted((tuple(r) for r in kept), key=str) == [(4, "a b c", 2), (7, "other words", 6), (None, "q", 4), (None, None, 5)]
    assert simhash.deduplicate(spark.createDataFrame([], schema)).collect() == []


def brute_cosine(rows, width):
    ok = [(i, np.pad(np.array(v, float), (0, width - len(v)))) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in ok])
    hit = m @ m.T >= 0.9
    ids = [i for i, _ in ok]
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if hit[a, b]]
    comp = closure(ids, pairs)
    return {i: (int(hit[k].sum()) - 1, comp[i]) for k, i in enumerate(ids)}


@pytest.mark.parametrize(("block", "part", "interval"), [(4096, 512, 1 << 24), (64, 16, 2048), (16, 16, 1000)])
def test_embeddings(spark, monkeypatch, block, part, interval):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "PART", part)
    monkeypatch.setattr(embed_dedup, "INTERVAL_BYTES", interval)
    monkeypatch.setattr(embed_dedup, "SMALL", 10 if block == 64 else 10**5)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 8))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 12] + rng.standard_normal(8) * 0.45]) for k in range(400)]
    rows += [(1000 + k, rows[k][1]) for k in range(30)] + [(2000 + k, [2 * x for x in rows[k][1]]) for k in range(5)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [1.0, None]), (5003, []), (5004, [float("nan")] * 8), (5005, [float("inf")] + [0.0] * 7), (5006, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, n int, rep int").repartition(6)
    got = embed_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = brute_cosine(rows + odd, 8)
    for r in got:
        links, comp = truth.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (links, comp, r.vec_id is not None and comp == r.vec_id)


def test_embeddings_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 1, True)]
    assert sorted(tuple(r) for r in embed_dedup.near_duplicates(spark.createDataFrame([(1, [1.0]), (1, [1.0]), (0, [-1.0])], schema)).collect()) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True)]


def test_distant_parts_are_skipped():
    rng = np.random.default_rng(0)
    a, b = np.array([1.0, 0, 0]) + rng.random((600, 3)) * 0.01, np.array([0, 1.0, 0]) + rng.random((600, 3)) * 0.01
    one, two = (embed_dedup.Interval(np.arange(600), np.ones(600, np.int64), embed_dedup._unit(x), np.eye(3)) for x in (a, b))
    assert list(embed_dedup.ego_join(one, two, 0.9, False)) == []
    both = embed_dedup.Interval(np.arange(1200), np.ones(1200, np.int64), np.concatenate([one.unit, two.unit]), np.eye(3))
    assert sum(len(x) for x, _ in embed_dedup.ego_join(both, both, 0.9, True)) == 2 * 600 * 599 // 2


@pytest.mark.parametrize(("kind", "gap"), [("double", 1e-10), ("double", 4e-16), ("float", 1e-5)])
def test_cosines_next_to_the_limit(spark, kind, gap):
    """Pairs a little above and below the limit, in planes of their own."""
    rows, due = [], {}
    for k in range(16):
        c = 0.9 + (gap if k % 2 else -gap)
        x, y = np.zeros(40), np.zeros(40)
        x[2 * k], y[2 * k], y[2 * k + 1] = 1.0, c, np.sqrt(1 - c * c)
        rows += [(2 * k, x.tolist()), (2 * k + 1, y.tolist())]
        due[2 * k] = due[2 * k + 1] = k % 2
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
    truth = brute_cosine(rows, 40)
    assert all(r.n_links == truth[r.vec_id][0] for r in got) and (gap < 1e-14 or {r.vec_id: r.n_links for r in got} == due)


def test_repeated_ids_of_different_vectors(spark):
    got = embed_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 3 and {(r.vec_id, r.component_id) for r in got} == {(1, 1), (2, 1)}


def test_intervals():
    assert embed_dedup.n_intervals(1, 1) == 1 and embed_dedup.n_intervals(1, 6) == 3 and embed_dedup.n_intervals(100 * embed_dedup.INTERVAL_BYTES, 6) == 100
