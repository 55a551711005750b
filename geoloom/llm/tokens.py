"""Token counts by a map-side two-tier lookup, and the token ids that packing needs.

Tier one is a broadcast table of the token counts of frequent pre-tokens: those that the vocabulary itself
spells out, so its size is bounded by the vocabulary and doesn't grow with the corpus. Tier two encodes
misses and keeps them in a bounded cache of the Python worker. No pre-token is ever shuffled.

Null text counts as empty: 0 bytes and 0 tokens. Special strings inside a text are handled as the library
does by default. Texts are never cut. An empty table gives an empty result; repeated rows are kept.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import map_batches, texts_of

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
TOKEN_LIMIT = 512
#: Pre-tokens that a worker's cache holds at most; it starts afresh beyond that.
CACHE = 400_000
#: Longer pre-tokens aren't cached.
CACHED_CHARS = 64
#: Characters from which a pre-token is encoded with a look at errors.
LONG = 1000
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def ranked(path: str):
    """The same vocabulary for the faster encoder of ordinary text; tests hold both against each other."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def frequent_lengths(ranks_path: str) -> dict[str, int]:
    """Token counts of the vocabulary's entries that are whole pre-tokens."""
    enc, split, out = ranked(ranks_path), regex.compile(public_tokenizers.PATTERN), {}
    for piece in enc._mergeable_ranks:
        try:
            word = piece.decode()
        except UnicodeDecodeError:
            continue
        if split.fullmatch(word):
            out[word] = len(enc.encode_ordinary(word))
    return out


class Counter:
    """Counts of one worker: tier one from the broadcast table, tier two from its own cache."""

    def __init__(self, frequent: dict[str, int], ranks_path: str):
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.frequent, self.enc, self.cache = frequent, ranked(ranks_path), {}

    def ordinary(self, text: str) -> int:
        n, missed, frequent, cache = 0, [], self.frequent.get, self.cache.get
        for word in self.split(text):
            k = frequent(word) or cache(word)
            if k:
                n += k
            else:
                missed.append(word)
        for word in missed:
            k = self.cache.get(word)
            if k is None:
                k = len(self.encode(word))
                if len(word) <= CACHED_CHARS:
                    if len(self.cache) >= CACHE:
                        self.cache.clear()
                    self.cache[word] = k
            n += k
        return n

    def encode(self, word: str) -> list[int]:
        if len(word) < LONG:
            return self.enc.encode_ordinary(word)
        try:
            return self.enc.encode(word, disallowed_special=())
        except ValueError:  # the faster encoder gives up on very long runs of white space
            return tokenizer(public_tokenizers.path(VOCABULARY)).encode(word, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(map(self.ordinary, parts))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, ranks: str = RANKS) -> DataFrame:
    """(doc_id long, n_bytes long, n_tokens long, over_limit boolean): a row per row of ``docs``, without a shuffle.

    The vocabulary file is looked up by name on each executor.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(public_tokenizers.path(ranks)))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        counter = _COUNTERS.get(ranks)
        if counter is None:
            counter = _COUNTERS[ranks] = Counter(table.value, public_tokenizers.path(ranks))
        n = np.array([counter.count(t) for t in texts_of(b)], np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return map_batches(rows, one, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def token_ids(text: str, ranks: str = RANKS) -> np.ndarray:
    """The ids of a text, special strings inside it included, as an array of unsigned 32-bit numbers."""
    try:
        return ranked(public_tokenizers.path(ranks)).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # the faster encoder gives up on very long runs of white space
        return np.array(tokenizer(public_tokenizers.path(VOCABULARY)).encode(text, add_special_tokens=False).ids, np.uint32)
