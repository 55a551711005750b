"""Benchmark decontamination: CGK embeddings and bit-sampling LSH over item-sized windows, then exact edit distance.

Texts are sequences of lower-case words without ASCII punctuation. A document is contaminated by an item of L words if some
part of it is within ``k = floor(0.2 L)`` word edits of the item (similarity 0.8 or more).

1. Seeds: an occurrence with k edits keeps at least L - 2 - 3k of the item's word trigrams, on diagonals that differ
   by 2k at most. Only window starts where so many meet are looked at; this loses nothing.
2. Every item-sized window at these starts is embedded by the random walk of Chakraborty, Goldenberg and Koucky
   (STOC 2016), which turns k edits into O(k^2) mismatches of position. Bits of each embedding are sampled again and again;
   a window and the items that share a sample's key are candidates. The number of samples follows from the
   target recall.
3. Candidates are verified by Myers' bit-parallel edit distance against the window with k more words at each side.

The item tables are broadcast in blocks of bounded size, one after the other: a block is given back before the next one is made, so
what the driver and the executors hold is bounded. Each block reads the documents once. Items of up to five words have too few trigrams: they are sought by their single words where enough of these
meet, then verified in the same way, so all of them are found. Null texts and items are empty. Repeated
rows give repeated results. Without items or documents the result is empty. Whole texts are read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut_lineage, map_batches, texts_of

SIMILARITY = 0.8
RECALL = 0.99
#: Items in a broadcast, and characters of their texts.
BLOCK, BLOCK_CHARS = 20_000, 20_000_000
#: Items of so many words at most are sought by single words.
SHORT = 5
#: Windows at once.
AT_ONCE = 8192
#: Random walks, sampled positions of an embedding in a key, and the share of positions on which the walks of two texts
#: within k edits agree, at least.
WALKS, SAMPLED, AGREEMENT = 4, 2, 0.4
_SEPARATORS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: Cells of the embeddings that are in memory at once.
_CELLS = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SEPARATORS).split()


def samples_for(recall: float, agreement: float = AGREEMENT, sampled: int = SAMPLED) -> int:
    """Samples after which a pair has met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled))


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits of an item of n words; never so many that no trigram, or no word of a short one, has to survive."""
    return max(0, min(int((1 - similarity) * n + 1e-9), (n - 3) // 3 if n > SHORT else n - 1))


def part_distance(item: list[int], text: list[int], at_most: int) -> tuple[int, int]:
    """(fewest edits from the item to any part of ``text``, end of that part)."""
    n, ones = len(item), (1 << len(item)) - 1
    peq: dict[int, int] = {}
    for k, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << k
    pv, mv, score, best, top = ones, 0, n, (n, 0), 1 << (n - 1)
    for at, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & ones, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & ones, mh << 1 & ones
        pv, mv = mh | ~(xv | ph) & ones, ph & xv
        if score < best[0]:
            best = score, at + 1
    return best


@dataclass
class Items:
    """What the executors need of a block of items."""

    keys: list[int]
    words: list[list[int]]
    known: dict[bytes, int]
    limit: list[int] = field(default_factory=list)
    similarity: float = SIMILARITY
    recall: float = RECALL

    def __post_init__(self) -> None:
        self.limit = [edits_allowed(len(w), self.similarity) for w in self.words]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.v = len(self.known) + 1
        grams, owner, offset = [], [], []
        pairs = np.array([(x, i) for i, w in enumerate(self.words) if len(w) <= SHORT for x in w], np.int64).reshape(-1, 2)
        self.short_word, self.short_owner = pairs[np.argsort(pairs[:, 0], kind="stable")].T
        for i, w in enumerate(self.words):
            for k in range(len(w) - 2 if len(w) > SHORT else 0):
                grams.append((w[k] * self.v + w[k + 1]) * self.v + w[k + 2])
                owner.append(i)
                offset.append(k)
        order = np.argsort(np.array(grams, np.int64), kind="stable")
        self.grams = np.array(grams, np.int64)[order]
        self.owner, self.offset = np.array(owner, np.int64)[order], np.array(offset, np.int64)[order]
        self.distinct, first = np.unique(self.grams, return_index=True)
        self.first = np.append(first, len(self.grams))
        self.longest = int(self.size.max(initial=0))
        rng = np.random.default_rng(7)
        # the walks' bits are the top bits of linear hashes, one for each step
        self.steps = rng.integers(0, 2**63, (WALKS, 3 * max(1, self.longest), 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.samples = samples_for(self.recall)
        self.places = rng.random((self.samples, SAMPLED))
        self.odd = rng.integers(1, 2**62, (self.samples, SAMPLED + 1), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        table = self.sampled([np.array(w, np.int64) for w in self.words], self.size)
        order = np.argsort(table.ravel(), kind="stable")
        self.table, self.table_item = table.ravel()[order], order // self.samples

    def sampled(self, rows: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """Keys of the samples of each row's embeddings, as of ``size`` words; a shorter row ends in blanks."""
        out = np.zeros((len(rows), self.samples), np.uint64)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * 3 * size[order[at + n]] <= _CELLS:
                n += 1
            part = order[at : at + n]
            out[part] = self._sampled([rows[k] for k in part], size[part])
            at += n
        return out

    def _sampled(self, rows: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        width, each = int(size.max()), np.arange(len(rows))
        words, out = np.zeros((len(rows), width + 1), np.int64), np.zeros((len(rows), self.samples), np.uint64)
        for k, row in enumerate(rows):
            words[k, : len(row)] = row
        for walk in range(WALKS):
            seen, at = np.zeros((len(rows), 3 * width), np.int64), np.zeros(len(rows), np.int64)
            for t in range(3 * width):
                word = np.where(at < size, words[each, np.minimum(at, width)], 0)
                seen[:, t] = word
                at += ((word.astype(np.uint64) * self.steps[walk, t, 0] + self.steps[walk, t, 1]) >> np.uint64(63)).astype(np.int64)
            for s in range(walk, self.samples, WALKS):
                key = size.astype(np.uint64) * self.odd[s, 0]
                for q in range(SAMPLED):
                    place = (self.places[s, q] * 3 * size).astype(np.int64)
                    key = (key ^ (key >> np.uint64(31))) + (seen[each, place] + 1).astype(np.uint64) * self.odd[s, q + 1]
                out[:, s] = key
        return out

    def starts(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first, last start of a window) where enough trigrams of the item meet."""
        if len(ids) < 3 or not len(self.distinct):
            return []
        where = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
        if not len(where):
            return []
        gram = (ids[where] * self.v + ids[where + 1]) * self.v + ids[where + 2]
        at = np.searchsorted(self.distinct, gram)
        at[at == len(self.distinct)] = 0
        hit = self.distinct[at] == gram
        where, at = where[hit], at[hit]
        if not len(where):
            return []
        many = self.first[at + 1] - self.first[at]
        index = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        item, diagonal = self.owner[index], np.repeat(where, many) - self.offset[index]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        limit = np.array(self.limit, np.int64)[item]
        need = np.maximum(1, self.size[item] - 2 - 3 * limit)
        ahead = np.arange(len(item)) + need - 1
        inside = np.minimum(ahead, len(item) - 1)
        enough = (ahead < len(item)) & (item[inside] == item) & (diagonal[inside] - diagonal <= 2 * limit)
        out: list[tuple[int, int, int]] = []
        for j in np.flatnonzero(enough):
            i, k = int(item[j]), int(limit[j])
            a, b = int(diagonal[inside[j]]) - k, int(diagonal[j]) + k
            if out and out[-1][0] == i and a <= out[-1][2] + 1:
                out[-1] = (i, out[-1][1], max(b, out[-1][2]))
            else:
                out.append((i, a, b))
        return out

    def short(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, edits, end) of each short item within the limit, where as many of its words meet as have to stay."""
        if not len(self.short_word) or not len(ids):
            return
        met = np.unique(ids[ids > 0])
        lo, hi = np.searchsorted(self.short_word, met, "left"), np.searchsorted(self.short_word, met, "right")
        owners = [self.short_owner[a:b] for a, b in zip(lo, hi) if a < b]
        if not owners:
            return
        items, many = np.unique(np.concatenate(owners), return_counts=True)
        for i in items[many >= self.size[items] - np.array(self.limit, np.int64)[items]].tolist():
            n, limit = int(self.size[i]), self.limit[i]
            total = np.concatenate([[0], np.cumsum(np.isin(ids, self.words[i]))])
            begin = np.arange(len(ids))
            dense = np.flatnonzero(total[np.minimum(begin + n + limit, len(ids))] - total[:-1] >= n - limit)
            best = (limit + 1, 0)
            for part in np.split(dense, np.flatnonzero(np.diff(dense) > 1) + 1):
                if len(part):
                    a = int(part[0])
                    edits, end = part_distance(self.words[i], ids[a : int(part[-1]) + n + limit].tolist(), limit)
                    best = min(best, (edits, a + end))
            if best[0] <= limit:
                yield i, *best

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, word at which the part ends) for each text and item within the limit."""
        get = self.known.get
        ids_of: dict[int, np.ndarray] = {}
        ranges: list[tuple[int, int, int, int]] = []
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k, text in enumerate(texts):
            ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
            for i, edits, end in self.short(ids):
                best[k, i] = edits, end
            found = self.starts(ids)
            if found:
                ids_of[k] = ids
                ranges += [(k, *r) for r in found]
        windows, size, of = [], [], []
        shared: set[tuple[int, int]] = set()

        def meet() -> None:
            keys = self.sampled(windows, np.array(size, np.int64)).ravel()
            lo, hi = np.searchsorted(self.table, keys, "left"), np.searchsorted(self.table, keys, "right")
            shared.update((of[q // self.samples], int(i)) for q in np.flatnonzero(hi > lo) for i in self.table_item[lo[q] : hi[q]])
            windows.clear()
            size.clear()
            of.clear()

        for at in range(0, len(ranges), 256):
            part = ranges[at : at + 256]
            shared.clear()
            for r, (k, i, a, b) in enumerate(part):
                ids, n = ids_of[k], int(self.size[i])
                for s in range(max(0, a), max(0, min(b, len(ids) - 1)) + 1):
                    windows.append(ids[s : s + n])
                    size.append(n)
                    of.append(r)
                    if len(windows) == AT_ONCE:
                        meet()
                        if (r, i) in shared:  # the whole range is verified then
                            break
            if windows:
                meet()
            for r, i in shared:
                k, _, a, b = part[r]
                a, b = max(0, a), max(0, min(b, len(ids_of[k]) - 1))
                limit, n = self.limit[i], int(self.size[i])
                begin = max(0, a - limit)
                edits, end = part_distance(self.words[i], ids_of[k][begin : b + n + limit].tolist(), limit)
                if edits <= limit and (edits, begin + end) < best.get((k, i), (edits + 1, 0)):
                    best[k, i] = edits, begin + end
        for (k, i), (edits, end) in sorted(best.items()):
            yield k, i, edits, end


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK, similarity: float = SIMILARITY, recall: float = RECALL) -> Iterator[tuple[Items, bool]]:
    """(items, whether they are the last) in blocks of about ``block`` items and ``BLOCK_CHARS`` characters at most, dealt by a hash of the id."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, math.ceil(n / block), math.ceil((chars or 0) / BLOCK_CHARS))
    for part in range(parts):
        known: dict[bytes, int] = {}
        keys, words = [], []
        for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect():
            w = words_of(r.text)
            if w:
                keys.append(r.item_id)
                words.append([known.setdefault(x, len(known) + 1) for x in w])
        if keys:
            yield Items(keys, words, known, similarity=similarity, recall=recall), part == parts - 1


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id long, item_id long, n_words long, edits long, end_word long): a row per document row and item found in it."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, n_words long, edits long, end_word long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for items, last in item_blocks(benchmark, **options):
        shared = spark.sparkContext.broadcast(items)

        def one(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            it = shared.value
            keys = b.column(0).to_pylist()
            found = [(keys[k], it.keys[i], len(it.words[i]), edits, end) for k, i, edits, end in it.matches(texts_of(b))]
            columns = zip(*found) if found else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_words", "edits", "end_word"])

        part = map_batches(rows, one, schema)
        if not last or out is not None:
            part = cut_lineage(part)
            shared.unpersist()
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    spark = docs.sparkSession
    for items, last in item_blocks(benchmark, **options):
        shared = spark.sparkContext.broadcast(items)

        def one(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            dirty = {k for k, *_ in shared.value.matches(texts_of(b, text_col))}
            return b.take(pa.array([k for k in range(b.num_rows) if k not in dirty], pa.int64()))

        docs = map_batches(docs, one, docs.schema)
        if not last:
            docs = cut_lineage(docs)
            shared.unpersist()
    return docs
