"""Quality by importance resampling.

Two generative models over ``BUCKETS`` hashed word n-grams (one and two words): target text (all documents labelled good) and raw text (all documents). A document's log weight is the sum of log ratios of
its n-grams. Adding Gumbel noise made from seed and doc_id and keeping the k largest keys samples k documents
without replacement in proportion to their weights. The k-th key is found exactly by counting keys in ever finer
ranges, so no task and no driver holds more than ``FINE`` keys.

Defined results: null and empty texts have weight 0; without target texts all weights are 0 and the choice is
uniform; a null doc_id draws noise from its text; repeated rows share noise and fate, so ties at the k-th key are all
kept; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint, words_of

BUCKETS, SEED = 10_000, 23
#: Share kept where no label tells the share of good documents.
UNLABELLED = 0.8
FINE, BINS = 10_000, 4096
#: Labelled rows that may be broadcast (more are joined by shuffle).
BROADCAST_ROWS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the one- and two-word n-grams of consecutive texts, and how many each text has."""
    one = (h % np.uint64(BUCKETS)).astype(np.int64)
    x = (h[:-1] * MIX) ^ (h[1:] + (h[:-1] << np.uint64(7)))
    two = ((x ^ (x >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[:-1] == owner[1:]
    who = np.concatenate([owner, owner[:-1][inside]])
    order = np.argsort(who, kind="stable")
    return np.concatenate([one, two[inside]])[order], lengths + np.maximum(lengths - 1, 0)


def _hashed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    return docs.select(*columns, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for start in range(0, b.num_rows, 1000):
            part = b.slice(start, 1000)
            got, n = ngram_buckets(*_parts(part.column(1)))
            good = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(bool), n)
            total[0] += np.bincount(got, minlength=BUCKETS)
            total[1] += np.bincount(got[good], minlength=BUCKETS)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "target"])


def target_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket, add-one smoothed; zeros without target text."""
    good = checkpoint(target_ids(labels))
    side = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id", "left")
    counts = _hashed(flagged, F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_count, "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                got, n = ngram_buckets(*_parts(part.column(2)))
                w = np.bincount(np.repeat(np.arange(len(n)), n), weights=ratio[got], minlength=len(n)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(w)], ["doc_id", "u", "n_grams", "log_weight"])

    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    digits = F.conv(F.substring(F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), key), "UTF-8")), 1, 13), 16, 10).cast("double")
    rows = _hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ((digits + 0.5) / float(1 << 52)).alias("u"))
    out = rows.mapInArrow(run, "doc_id long, u double, n_grams long, log_weight double")
    return out.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") - F.log(-F.log("u"))).alias("gumbel_key"))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of ``column``, exactly, counting in ranges that narrow around it."""
    now = rows.select(F.col(column).alias("v"))
    low, high, n = now.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k > n:
        return -math.inf
    if k < 1:
        return math.inf
    while n > FINE and low < high:
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).cast("int")
        counts = {r.b: (r.n, r.lo, r.hi) for r in now.groupBy(bin_of.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}  # BINS rows
        for b in sorted(counts, reverse=True):
            if k <= counts[b][0]:
                break
            k -= counts[b][0]
        n, low, high = counts[b]
        now = now.where((F.col("v") >= low) & (F.col("v") <= high))
    if low == high:
        return low
    return sorted((r.v for r in now.collect()), reverse=True)[k - 1]  # FINE rows at most


def good_share(labels: DataFrame) -> float:
    """Share of good documents among those labelled."""
    n = labels.where("quality is not null").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    return n.good / n.n if n.n else UNLABELLED


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept): kept marks the share ``keep`` of rows with the largest keys.

    Without ``keep`` it is the share of good documents among those labelled.
    """
    keep = good_share(labels) if keep is None else keep
    weighed = checkpoint(weigh(docs, learn(docs, labels), seed))
    least = kth_largest(weighed, "gumbel_key", math.ceil(keep * weighed.count()))
    return weighed.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs, labels)
