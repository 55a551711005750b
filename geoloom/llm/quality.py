"""Quality by importance resampling (DSIR): hashed n-gram models of target and raw text, Gumbel top-k.

1. One pass counts hashed n-grams: of all documents for the raw model, of good labelled documents for the target model.
   Tokens are runs of letters and digits, and runs of other signs; n-grams are tokens, pairs of tokens, and one
   more bucket for a token that repeats the one before it. Each task sends its counts once, not its n-grams.
2. A second pass gives each document the log of its importance weight, the sum of log ratios over its n-grams.
3. The weight's log plus Gumbel noise, which a hash of the id fixes, is the key; the ``k`` largest keys are a sample without
   replacement in proportion to the weights. k is the number of documents times the share of good labels, at the upper end of
   its 95 % interval, so that the estimate's error costs no good documents. The k-th key is found exactly by refining histograms on the executors; rows that tie with it all stay.

Target texts are those of up to ``MAX_TARGET`` good labelled ids, those with the smallest hashes; everything else covers all
rows. Null text is empty and has weight one. Null ids are hashed like any other value. Repeated rows tie and get the
same decision. Without good labels the target model is the raw one, and all rows are kept. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut_lineage, fresh, map_batches, map_parts, texts_of

BUCKETS = 1 << 14
#: Bound of the labelled sample that the target model is fitted on.
MAX_TARGET = 20_000
SEED = 17
#: Bins of one refinement of the threshold.
BINS = 1024

_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


def features(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    h = np.array(list(map(zlib.crc32, _TOKENS.findall(text.encode()))), np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
    return np.concatenate([h % np.uint64(BUCKETS - 1), np.where(h[:-1] == h[1:], BUCKETS - 1, pairs % np.uint64(BUCKETS - 1))]).astype(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


@dataclass(frozen=True)
class Model:
    """log(p target / p raw) of each bucket, and the share of documents to keep."""

    log_ratio: np.ndarray
    share: float


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_target: int = MAX_TARGET) -> Model:
    spark = docs.sparkSession
    good = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality")).dropna()
    tally = {r["g"]: r["count"] for r in good.groupBy((F.col("quality") == 1).alias("g")).count().collect()}
    chosen = good.filter("quality = 1").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_target)
    target = spark.sparkContext.broadcast(np.sort(np.array([r.id for r in chosen.collect()], np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            wanted = np.isin(b.column(0).to_numpy(zero_copy_only=False), target.value) if b.num_rows else []
            for text, w in zip(texts_of(b), wanted):
                n = np.bincount(features(text), minlength=BUCKETS)
                raw += n
                if w:
                    aim += n
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(aim[seen])], ["bucket", "raw", "target"])

    found = map_parts(_rows(docs, id_col, text_col), count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    n = np.zeros((2, BUCKETS))
    for r in found.collect():  # at most BUCKETS rows
        n[:, r.bucket] = r.target, r.raw
    if not n[0].sum():
        return Model(np.zeros(BUCKETS), 1.0)
    p = (n + 1) / (n + 1).sum(axis=1, keepdims=True)
    labelled = sum(tally.values())
    share = tally.get(True, 0) / labelled
    return Model(np.log(p[0] / p[1]), min(1.0, share + 1.96 * math.sqrt(share * (1 - share) / labelled)))


def _gumbel(doc_id: Column) -> Column:
    """Standard Gumbel noise, fixed by the id."""
    u = (F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def log_weights(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, log_weight double, gumbel_key double): a row per row of ``docs``."""
    ratio = docs.sparkSession.sparkContext.broadcast(model.log_ratio)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        w = np.array([ratio.value[features(t)].sum() for t in texts_of(b)], float)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(w)], ["doc_id", "log_weight"])

    scored = map_batches(_rows(docs, id_col, text_col), one, "doc_id long, log_weight double")
    return scored.withColumn("gumbel_key", F.col("log_weight") + _gumbel(F.col("doc_id")))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value; None if all are kept. The driver gets ``BINS`` counts a round."""
    n, lo, hi = keys.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n or k >= n:
        return None
    if k <= 0:
        return float("inf")
    c = F.col(column)
    while lo < hi:
        width = (hi - lo) / BINS
        at = F.least(F.greatest(F.floor((c - lo) / width), F.lit(0)), F.lit(BINS - 1)) if width > 0 else (c > lo).cast("long")
        bins = keys.filter(c.between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def _threshold(scored: DataFrame, model: Model) -> float | None:
    """Least key of the sample; None if all rows are in it."""
    return kth_largest(scored, "gumbel_key", round(model.share * scored.count()))


def importance_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, log_weight double, gumbel_key double, kept boolean): a row per row of ``docs``."""
    model = fit(docs, labels, id_col, text_col)
    scored = cut_lineage(log_weights(docs, model, id_col, text_col))
    least = _threshold(scored, model)
    return scored.withColumn("kept", F.lit(True) if least is None else F.col("gumbel_key") >= least)


def keep_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in the sample, with their columns.

    Keys are small and go through the threshold search; the rows themselves are weighed once more where they are read,
    so that no text is shuffled.
    """
    model = fit(docs, labels, id_col, text_col)
    least = _threshold(cut_lineage(log_weights(docs, model, id_col, text_col)), model)
    if least is None:
        return docs
    ratio, at = docs.sparkSession.sparkContext.broadcast(model.log_ratio), docs.schema.names.index(text_col)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        # the same sums as in the keys, so that the last row in is in here too
        w = np.array([ratio.value[features(t or "")].sum() for t in b.column(at).to_pylist()], float)
        keep = pa.array(w + b.column(b.num_columns - 1).to_numpy() >= least)
        return pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:-1]], b.schema.names[:-1])

    return map_batches(docs.withColumn(fresh("noise", docs.columns), _gumbel(F.col(id_col).cast("long"))), one, docs.schema)
