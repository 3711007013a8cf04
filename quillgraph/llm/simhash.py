"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A 64-bit fingerprint is cut into 32 segments of two bits. The bit counts of the segments (0, 1 or 2) form a
point whose Manhattan distance to another point never exceeds the Hamming distance of the fingerprints. Written
in unary (0 -> 00, 1 -> 01, 2 -> 11) a point fits one long and the Manhattan distance is the popcount of an XOR.

Grid range-join: the 32 dimensions form six groups. Points within distance 3 differ in at most three groups, so
they share the grid cell of at least one of the 20 choices of three groups. Cells are compared inside one task;
cells above ``CELL`` members are dealt to tasks as pairs of blocks, so no task holds an unbounded group. Pairs
pass the Manhattan bound, then the exact Hamming test. Only the links' connectivity (a star per cell) is
emitted, never all pairs of a group.

Defined results: null text counts as empty; no words give fingerprint 0, which links like any other; texts of any length count whole; repeated
rows each get a row; a null doc_id gets the component of its fingerprint; columns beyond doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint, components, words_of

BITS, MOST = 64, 3
#: Segments (of two bits) in each of the six groups of dimensions.
GROUPS = (6, 6, 5, 5, 5, 5)
#: Members of a cell that one task compares; larger cells are compared as pairs of blocks of this size.
CELL = 4096
#: Rows of a cell's matrix in work at once: up to 8 MB of distances, where the whole matrix would take 134.
STRIP = 256
#: Hot cells that may be broadcast (20 bytes each); more are joined by shuffle.
HOT_BROADCAST = 10_000
LOW = 0x5555555555555555
#: Values unpacked to bits at once, 64 bytes each.
SLAB = 200_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> list[int]:
    """One mask of unary bits for each choice of three of the six groups."""
    spans, at = [], 0
    for n in GROUPS:
        spans.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return [_signed(a | b | c) for a, b, c in combinations(spans, 3)]


def unary(x: np.ndarray) -> np.ndarray:
    """Segment popcounts of fingerprints, two unary bits each."""
    x = x.astype(np.uint64, copy=False)
    low, one = np.uint64(LOW), np.uint64(1)
    return ((x | x >> one) & low) | (((x & x >> one) & low) << one)


def _majority(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint per run of values: bit set where over half of the run's values set it."""
    out, start = np.zeros(len(ends), np.uint64), 0
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i = 0
    while i < len(ends):
        j = i + 1
        while j < len(ends) and ends[j] - start <= SLAB:
            j += 1
        starts = np.concatenate([[start], ends[i : j - 1]]) - start
        sizes = ends[i:j] - start - starts
        counts = np.zeros((j - i, BITS), np.int64)
        for lo in range(start, int(ends[j - 1]), SLAB):  # more than one turn only for a single long run
            bits = np.unpackbits(values[lo : min(lo + SLAB, int(ends[j - 1]))].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if j - i == 1:
                counts[0] += bits.sum(0, dtype=np.int64)
            else:
                full = sizes > 0
                counts[full] = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
        out[i:j] = ((counts * 2 > sizes[:, None]) * weights).sum(1, dtype=np.uint64)
        start, i = int(ends[j - 1]), j
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = b.column(1)
        values = h.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(h), 0)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_majority(values, ends).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row, from the whole text."""
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))
    shingle = lambda i: F.xxhash64(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    h = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), shingle)).when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.array().cast("array<bigint>"))
    return w.select("doc_id", h.alias("h")).mapInArrow(_fold, "doc_id long, fp long")


def _stars(adjacent: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for nodes of a boolean symmetric matrix that are not their own."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        new = label.copy()
        for at in range(0, len(ids), STRIP):
            rows, cols = np.nonzero(adjacent[at : at + STRIP])
            np.minimum.at(new, at + rows, label[cols])
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    roots = ids[order[label]]
    keep = roots != ids
    return ids[keep], roots[keep]


def _links(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    near = np.empty((len(x), len(x)), bool)
    for at in range(0, len(x), STRIP):
        part = slice(at, at + STRIP)
        near[part] = np.bitwise_count(u[part, None] ^ u[None, :]) <= MOST  # Manhattan bound
        if near[part].any():
            near[part] &= np.bitwise_count(x[part, None] ^ x[None, :]) <= MOST
    np.fill_diagonal(near, False)
    return near


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal cells; rows come sorted by (t, key, part). A run holds two blocks at most."""
    left: list[np.ndarray] = [np.zeros(0, np.int64)] * 5

    def linked(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t, key, part, fp, rep = cols
        x = fp.view(np.uint64)
        u = unary(x)
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(t)))
        i = starts[sizes == 2]
        i = i[np.bitwise_count(u[i] ^ u[i + 1]) <= MOST]
        i = i[np.bitwise_count(x[i] ^ x[i + 1]) <= MOST]
        a, b = [rep[i]], [rep[i + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            near = _links(x[s : s + n], u[s : s + n])
            if near.any():
                p, q = _stars(near, rep[s : s + n])
                a.append(p)
                b.append(q)
        return np.concatenate(a), np.concatenate(b)

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v) for v in linked(cols)], ["a", "b"])

    for batch in batches:
        cols = [np.concatenate([old, c.to_numpy(zero_copy_only=False)]) for old, c in zip(left, batch.columns, strict=True)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield out([c[:cut] for c in cols])
        left = [c[cut:] for c in cols]
    if len(left[0]):
        yield out(left)


def links(points: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp, rep) within ``MOST`` bits, through common reps."""
    spark = points.sparkSession
    one = F.shiftrightunsigned("fp", 1)
    low = F.lit(LOW)
    u = F.col("fp").bitwiseOR(one).bitwiseAND(low).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(one).bitwiseAND(low), 1))
    keyed = points.withColumn("u", u).select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("u").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())])).alias("c"), "fp", "rep"
    ).select("c.t", "c.key", "fp", "rep")
    hot = checkpoint(keyed.groupBy("t", "key").count().where(F.col("count") > CELL))
    n_hot = hot.count()
    cold = keyed.withColumn("part", F.lit(0).cast("long"))
    if n_hot:
        side = F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot
        half = CELL // 2
        wide = keyed.join(side, ["t", "key"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / half), F.lit(1)).cast("long"))
        block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        # a block meets every block, itself included: part = smaller * blocks + larger
        cold = wide.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
            "t", "key", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("part"), "fp", "rep"
        )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cold.select(F.col("t").cast("long").alias("t"), "key", "part", "fp", "rep").repartition(n, "t", "key", "part").sortWithinPartitions("t", "key", "part")
    return dealt.mapInArrow(_cells, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most 3 bits.

    Fingerprints stand for their documents, so one that only documents without an id have still carries links.
    """
    fps = checkpoint(fingerprints(docs))
    points = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(points.select("fp", F.col("fp").alias("rep"))))
    rooted = checkpoint(points.join(found, points.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents that stay: those whose doc_id is their component's smallest; one of each set of repeated rows.

    Rows of one doc_id with different texts are judged each by its own text. Rows without a doc_id cannot be named and stay. All columns of
    ``docs`` are returned.
    """
    judged = checkpoint(near_duplicates(docs).where("doc_id is not null").groupBy("doc_id", "fp").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    ids = judged.groupBy(F.col("doc_id").alias("__id")).agg(F.sum("n").alias("n"), F.min("component_id").alias("root"))
    gone = ids.where("n = 1 and __id <> root").select("__id")
    twice = checkpoint(ids.where("n > 1").select("__id"))
    if twice.isEmpty():
        return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
    once = docs.join(gone.unionByName(twice), F.col("doc_id") == F.col("__id"), "left_anti")
    again = checkpoint(docs.join(twice, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("__row", F.monotonically_increasing_id()))
    own = fingerprints(again.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "fp")
    first = again.select("__row", "doc_id").join(own, "__row").join(judged.where("doc_id = component_id").select("doc_id", "fp"), ["doc_id", "fp"], "left_semi").select("__row")
    return once.unionByName(again.join(first, "__row", "left_semi").select(*docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
