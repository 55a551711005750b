"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is an embedding of the word (of the training vocabulary, else a shared one) and the mean of embeddings of
its hashed byte trigrams. Forward and backward GRUs run over windows of ``WINDOW`` words that overlap by a quarter; attention
pools their states; the document's score is that of its highest window. All windows of the whole text are scored.

Training is multiple-instance: a document's window with the highest score so far carries the label. The sample is bounded:
up to ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` other labelled ids, those with the smallest hashes, of rows whose
``crc32(id as text) mod 4`` isn't 2, as long as their texts fit in ``MAX_BYTES`` (a text that no longer fits is left out); of a training
text all windows take part, in blocks. Of rows that repeat an id one text is learned from. Scores see the text only.

Null text is empty; a text without words has one blank window and a score like any other. Repeated rows get equal scores, null ids are
kept (held_out null counts as false). An empty table gives an empty result; without labels every score is 0.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut_lineage, map_parts, texts_of

WINDOW, STEP = 32, 24
THRESHOLD = 0.3
MAX_TOXIC, MAX_CLEAN = 1500, 3000
#: Bytes of the training texts, which go to the driver.
MAX_BYTES = 64 << 20
VOCABULARY = 20_000
DECAY = 0.01
WORD_DIM, CHAR_DIM, CHAR_BUCKETS, HIDDEN = 12, 8, 4096, 8
#: Passes over the sample, and steps at least.
EPOCHS, STEPS, BATCH, RATE = 8, 500, 64, 0.02
#: Training documents that a word of the vocabulary is in, at least: rarer ones only let single documents be memorised.
MIN_DOCUMENTS = 4
#: Words whose inputs a worker keeps; it starts afresh beyond that. Windows run at once.
CACHE, ROWS = 200_000, 4096
_SEPARATORS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SEPARATORS).split()


def window_starts(n: int) -> range:
    """First words of the windows over n words; the last one reaches the end."""
    return range(0, max(1, n - WINDOW + STEP), STEP)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sum of the rows of each)."""
    if not len(keys):
        return keys, rows
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    return ranked[first], np.add.reduceat(rows[order], first, axis=0)


class Network:
    """Parameters by name: embeddings, and for each direction input, recurrent and bias weights of gates z, r, n."""

    def __init__(self, vocabulary: list[bytes], seed: int = 5):
        rng, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.known = {w: k + 2 for k, w in enumerate(vocabulary)}  # 0 is blank, 1 any other word
        self.p = {"word": draw(len(vocabulary) + 2, WORD_DIM), "char": draw(CHAR_BUCKETS, CHAR_DIM), "v": draw(2 * h), "out": draw(2 * h), "bias": np.zeros(1, np.float32) - 2}
        for way in "fb":
            self.p |= {f"w{way}": draw(d, 3 * h), f"u{way}": draw(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}

    def grams(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all byte trigrams of ``^word$``, index of each word's first)."""
        data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)  # trigrams of a word of n bytes: n
        first = np.cumsum(sizes) - sizes
        at = np.repeat(np.cumsum(sizes + 2) - (sizes + 2) - first, sizes) + np.arange(sizes.sum())
        return (data[at] * 7919 + data[at + 1] * 104729 + data[at + 2] * 1299709) % CHAR_BUCKETS, first

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words."""
        out = np.empty((len(words), WORD_DIM + CHAR_DIM), np.float32)
        for k in range(0, len(words), ROWS):  # so that what all trigrams look up is never in memory at once
            part = words[k : k + ROWS]
            bucket, first = self.grams(part)
            sizes = np.diff(np.append(first, len(bucket)))
            out[k : k + ROWS, WORD_DIM:] = np.add.reduceat(self.p["char"][bucket], first, axis=0) / sizes[:, None]
            out[k : k + ROWS, :WORD_DIM] = self.p["word"][[self.known.get(w, 1) for w in part]]
        return out

    def gates(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the inputs add to the gates of the forward and of the backward direction."""
        return inputs @ self.p["wf"] + self.p["cf"], inputs @ self.p["wb"] + self.p["cb"]

    def run(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; ``ids`` are rows of ``gates``, 0 where a window is blank.

        Both directions go together: at step k the forward one is at word k, the backward one at word t - 1 - k.
        """
        n, t, h = *ids.shape, HIDDEN
        at, u = np.ascontiguousarray(ids.T), np.stack([self.p["uf"], self.p["ub"]])
        mask = ids > 0
        live = np.stack([mask.T, mask.T[::-1]], axis=1)[..., None]
        states, s, g = np.zeros((t, n, 2 * h), np.float32), np.zeros((2, n, h), np.float32), np.empty((2, n, 3 * h), np.float32)
        for k in range(t):
            for own, words, into in zip(gates, (at[k], at[t - 1 - k]), g):
                np.take(own, words, axis=0, out=into, mode="clip")
            back = s @ u
            zr = _sigmoid(g[..., : 2 * h] + back[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(g[..., 2 * h :] + r * back[..., 2 * h :])
            if keep is not None:
                keep[k] = s, z, r, new, back[..., 2 * h :]
            s = np.where(live[k], new + z * (s - new), s)
            states[k, :, :h], states[t - 1 - k, :, h:] = s
        score = states @ self.p["v"] + np.where(mask.T, 0, -1e9).astype(np.float32)
        weight = np.exp(score - score.max(axis=0)) * mask.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"states": states, "weight": weight, "pooled": pooled, "live": live}
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(self, inputs: np.ndarray, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean cross-entropy by parameter, and by input vector."""
        keep: dict = {}
        logit = self.run(gates, ids, keep)
        h, (n, t) = HIDDEN, ids.shape
        d_logit = ((_sigmoid(logit) - y) / n).astype(np.float32)
        g = {"out": d_logit @ keep["pooled"], "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        along = np.einsum("tnh,nh->tn", keep["states"], d_pooled)
        d_score = keep["weight"] * (along - (keep["weight"] * along).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", d_score, keep["states"])
        d_states = keep["weight"][:, :, None] * d_pooled + d_score[:, :, None] * self.p["v"]
        u = np.stack([self.p["uf"], self.p["ub"]])
        d_s, d_u, steps = np.zeros((2, n, h), np.float32), np.zeros_like(u), np.empty((2, t, n, 3 * h), np.float32)
        for k in range(t - 1, -1, -1):
            s, z, r, new, back = keep[k]
            live = keep["live"][k]
            d_s = d_s + np.stack([d_states[k, :, :h], d_states[t - 1 - k, :, h:]])
            d = np.where(live, d_s, 0)
            d_new = d * (1 - z) * (1 - new**2)
            d_z, d_r = d * (s - new) * z * (1 - z), d_new * back * r * (1 - r)
            to_back = np.concatenate([d_z, d_r, d_new * r], axis=2)
            steps[0, k], steps[1, t - 1 - k] = np.concatenate([d_z, d_r, d_new], axis=2)
            d_u += s.transpose(0, 2, 1) @ to_back
            d_s = np.where(live, d * z, d_s) + to_back @ u.transpose(0, 2, 1)
        d_inputs, words = np.zeros_like(inputs), ids.T.ravel()
        for way, own, d in zip("fb", steps.reshape(2, t * n, 3 * h), d_u):
            d_gates = np.zeros((len(inputs), 3 * h), np.float32)
            used, total = _summed(words, own)
            d_gates[used] = total
            g[f"u{way}"], g[f"c{way}"], g[f"w{way}"] = d, d_gates.sum(axis=0), inputs.T @ d_gates
            d_inputs += d_gates @ self.p[f"w{way}"].T
        return g, d_inputs


def _windows(ids: np.ndarray) -> np.ndarray:
    padded = np.concatenate([ids, np.zeros(WINDOW, ids.dtype)])
    return padded[np.array(window_starts(len(ids)))[:, None] + np.arange(WINDOW)]


def highest(net: Network, gates: tuple[np.ndarray, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """First word of each text's window with the highest score; about ``ROWS`` windows are in memory at once."""
    best, pick = np.full(len(docs), -np.inf, np.float32), np.zeros(len(docs), np.int64)
    waiting: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        logit, at = net.run(gates, np.concatenate([w for *_, w in waiting])), 0
        for d, begin, w in waiting:
            own, at = logit[at : at + len(w)], at + len(w)
            top = int(np.argmax(own))
            if own[top] > best[d]:
                best[d], pick[d] = own[top], begin + top * STEP
        waiting.clear()

    rows, span = 0, ROWS * STEP
    for d, ids in enumerate(docs):
        n = len(window_starts(len(ids)))
        for k in range(0, n, ROWS):
            # the words of these windows alone; a block's last window may reach into the next block
            w = _windows(ids[k * STEP : k * STEP + span + WINDOW - STEP])[: n - k][:ROWS]
            waiting.append((d, k * STEP, w))
            rows += len(w)
            if rows >= ROWS:
                flush()
                rows = 0
    if waiting:
        flush()
    return pick


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Network | None:
    """A network from labelled texts; None without both labels."""
    if len(set(labels)) < 2:
        return None
    listed, seen = [words_of(t) for t in texts], Counter()
    for words in listed:
        seen.update(set(words))
    vocabulary = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= MIN_DOCUMENTS]
    net, rng = Network(vocabulary), np.random.default_rng(seed)
    distinct = sorted(seen)
    number = {w: k + 1 for k, w in enumerate(distinct)}
    docs = [np.array([number[w] for w in words], np.int32) for words in listed]
    sizes_of, y = np.array([len(window_starts(len(d))) for d in docs]), np.array(labels, np.float32)
    del listed, number
    grams = [net.grams(distinct[k : k + ROWS]) for k in range(0, len(distinct), ROWS)]
    bucket = np.concatenate([b for b, _ in grams]).astype(np.int32)
    at = np.concatenate([a + n for (_, a), n in zip(grams, np.cumsum([0, *(len(b) for b, _ in grams)]))])
    bounds, known = np.append(at, len(bucket)), np.array([net.known.get(w, 1) for w in distinct])
    blank = np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, epochs = 0, max(epochs, math.ceil(STEPS * BATCH / len(sizes_of)))
    for epoch in range(epochs):
        if epoch < epochs // 4:
            pick = (rng.random(len(sizes_of)) * sizes_of).astype(np.int64) * STEP
        else:
            gates = net.gates(np.concatenate([blank, net.inputs(distinct)]))
            pick = highest(net, gates, docs)
        order = rng.permutation(len(sizes_of))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            used, local = np.unique(np.concatenate([_windows(docs[d][pick[d] : pick[d] + WINDOW])[:1] for d in own]), return_inverse=True)
            if used[0] != 0:
                used, local = np.concatenate([[0], used]), local + 1
            local = local.reshape(len(own), WINDOW)
            words = used[1:] - 1
            parts = [bucket[bounds[w] : bounds[w + 1]] for w in words]
            sizes = np.array([len(x) for x in parts], np.int64)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(words)), sizes)
            char = _summed(owner, net.p["char"][flat])[1] / sizes[:, None]  # each word has a trigram
            inputs = np.concatenate([blank, np.concatenate([net.p["word"][known[words]], char], axis=1)]).astype(np.float32)
            g, d_inputs = net.gradients(inputs, net.gates(inputs), local, y[own])
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            sparse = {}
            d_char = d_inputs[1:, WORD_DIM:] / sizes[:, None]
            for name, rows, d in (("word", known[words], d_inputs[1:, :WORD_DIM]), ("char", flat, d_char[owner])):
                sparse[name] = _summed(rows, d)
            for name, d in [*g.items(), *sparse.items()]:
                rows, d = d if isinstance(d, tuple) else (slice(None), d)
                m, s = moments[name]
                m[rows] = 0.9 * m[rows] + 0.1 * d
                s[rows] = 0.99 * s[rows] + 0.01 * d**2
                net.p[name][rows] -= rate * m[rows] / (1 - 0.9**step) / (np.sqrt(s[rows] / (1 - 0.99**step)) + 1e-7) + rate * DECAY * net.p[name][rows]
    return net


class Scorer:
    """A worker's network with the gates of words met so far."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.gates = tuple(np.zeros((1 << 16, 3 * HIDDEN), np.float32) for _ in "fb")

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.row.get
        out = [get(w, 0) for w in words]
        if 0 in out:
            new = list({w for w, k in zip(words, out) if not k})
            at = len(self.row) + 1
            while at + len(new) > len(self.gates[0]):
                self.gates = tuple(np.concatenate([g, np.zeros_like(g)]) for g in self.gates)
            for table, g in zip(self.gates, self.net.gates(self.net.inputs(new))):
                table[at : at + len(new)] = g
            self.row.update(zip(new, range(at, at + len(new))))
            out = [get(w) for w in words]
        return np.array(out, np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Highest window of each text, as a probability."""
        out, waiting, owners, rows = np.full(len(texts), -np.inf), [], [], 0

        def flush() -> None:
            nonlocal rows
            if waiting:
                windows, owner = np.concatenate(waiting), np.concatenate(owners)
                for k in range(0, len(windows), ROWS):
                    np.maximum.at(out, owner[k : k + ROWS], self.net.run(self.gates, windows[k : k + ROWS]))
            waiting.clear()
            owners.clear()
            rows = 0

        for k, text in enumerate(texts):
            words = words_of(text)
            if len(self.row) > CACHE:
                flush()
                self.reset()
            w = _windows(self.ids(words))
            waiting.append(w)
            owners.append(np.full(len(w), k))
            rows += len(w)
            if rows >= ROWS:
                flush()
        flush()
        return _sigmoid(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Network | None:
    """A network from the bounded sample; the driver gets its texts, ``max_bytes`` at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    draw = lambda wanted, most: known.filter(wanted).orderBy(F.xxhash64("id"), "id").limit(most)
    sample = draw("toxic = 1", max_toxic).union(draw("toxic = 0", max_clean))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = cut_lineage(texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")))
    left, fits = max_bytes, []
    for r in found.select("id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id").collect():
        if r.size <= left:
            left -= r.size
            fits.append(r.id)
    if not fits:
        return None
    chosen = found.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fits], "id long")), "id", "left_semi")
    rows = sorted((r.id, r.text, r.toxic) for r in chosen.select("id", "text", "toxic").collect())
    return train([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int): a row per row of ``docs``, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches:
            if b.num_rows:
                s = scorer.scores(texts_of(b)) if scorer else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = map_parts(rows, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
