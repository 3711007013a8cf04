"""Embedding near-duplicates by epsilon grid order join.

Unit vectors with cosine of at least ``COSINE`` lie within distance eps = sqrt(2 - 2 * COSINE). Equal vectors are first
merged into one with a multiplicity and a number of its own. Principal axes come from the covariance of all vectors (summed by Spark). The
vectors are sorted by their grid cells (width eps) on the ``LEADING`` axes - the epsilon grid order - and cut into
blocks of ``BLOCK``, by their place in the order: the place in a range partition of the sort, and the sizes of those before it (one row for each). Blocks whose bounding boxes
on these axes and in the length of what the axes leave over are more than eps apart are never paired; inside a
pair, intervals of the sequence are halved recursively and skipped by the same test. What is left is multiplied
in single precision with a margin, and every pair within the margin is decided in double precision.

A task holds two blocks and returns, per vector, its number of partners and the smallest vector of its component there:
linear output, whatever the size of a group. No pair is cut off.

Defined results: null vectors, empty or zero vectors and vectors with null or non-finite components link with nothing,
as do vectors of different lengths with each other; each is its own component. Other rows with the same vec_id and
vector count as other vectors; a null vec_id takes part through its vector but names no component, so component_id is null only where no vector reachable has an id; columns other than
vec_id and embedding are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint, components

COSINE, LEADING, BLOCK, LEAF = 0.95, 16, 16_384, 512
#: Added to eps, as lengths of what the axes leave over are roots of small differences.
SLACK = 1e-6
#: Vectors that one task sorts.
SORTED = 1 << 18


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal(vectors: DataFrame, dim: int) -> np.ndarray:
    """Leading principal axes (dim x at most LEADING) of the unit vectors in column ``embedding``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim * dim + dim + 1)
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column(0), dim))
                total += np.concatenate([(x.T @ x).ravel(), x.sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    rows = vectors.select("embedding").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # dim * dim rows
    t = np.zeros(dim * dim + dim + 1)
    for r in rows:
        t[r.i] = r.v
    mean = t[dim * dim : -1] / t[-1]
    _, axes = np.linalg.eigh(t[: dim * dim].reshape(dim, dim) / t[-1] - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :LEADING])


def projected(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes and the length of the rest: no two vectors are nearer than their distance in these."""
    p = x @ axes
    rest = np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", p, p)
    return np.concatenate([p, np.sqrt(np.maximum(rest, 0.0))[:, None]], 1)


def _gap(a_low, a_high, b_low, b_high) -> float:
    """Smallest distance of two boxes."""
    d = np.maximum(0.0, np.maximum(a_low - b_high, b_low - a_high))
    return float(np.sqrt(d @ d))


def _components(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        np.minimum.at(new, cols, label[rows])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def join_blocks(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, weight_x: np.ndarray, weight_y: np.ndarray | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, int]:
    """Links between unit vectors ``x`` and ``y`` (of x alone without y): partners of each, component labels, leaves met."""
    same = y is None
    both = x if same else np.concatenate([x, y])
    weight = weight_x if same else np.concatenate([weight_x, weight_y])
    shift = 0 if same else len(x)
    n, eps = len(both), math.sqrt(2 - 2 * cosine) + SLACK
    margin = max(1e-4, 8 * x.shape[1] * 6e-8)
    p, single = projected(both, axes), both.astype(np.float32)
    partners, edges_a, edges_b, met = np.zeros(n, np.int64), [], [], 0
    box: dict[tuple[int, int], tuple] = {}

    def bounds(i: int, j: int) -> tuple:
        if (i, j) not in box:
            box[i, j] = (p[i:j].min(0), p[i:j].max(0))
        return box[i, j]

    work = [((0, len(x)), (0, n) if same else (shift, n))]
    while work:
        (i, j), (k, m) = work.pop()
        if i == j or k == m or (same and i >= m) or _gap(*bounds(i, j), *bounds(k, m)) > eps:
            continue
        if j - i > LEAF or m - k > LEAF:
            half = lambda a, b: [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]
            work += [(u, v) for u in half(i, j) for v in half(k, m) if not same or u[0] <= v[0]]
            continue
        met += 1
        a, b = np.nonzero(single[i:j] @ single[k:m].T >= cosine - margin)
        a, b = a + i, b + k
        if same:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 1 << 16):
            s, t = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            good = np.einsum("ij,ij->i", both[s], both[t]) >= cosine
            s, t = s[good], t[good]
            np.add.at(partners, s, weight[t])
            np.add.at(partners, t, weight[s])
            if len(s):
                label = _components(s, t, n)
                moved = np.flatnonzero(label != np.arange(n))
                edges_a.append(moved)
                edges_b.append(label[moved])
    label = _components(np.concatenate(edges_a), np.concatenate(edges_b), n) if edges_a else np.arange(n)
    return partners, label, met


def _pairs_of(vectors: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(rep, partners, root) from all block pairs that may hold links; ``vectors``: rep, n, embedding of one length."""
    axes, eps = principal(vectors, dim), math.sqrt(2 - 2 * cosine) + SLACK
    k = axes.shape[1] + 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = projected(unit(_matrix(b.column(2), dim)), axes) if b.num_rows else np.zeros((0, k))
            c = np.floor(p[:, :-1] / eps).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, k - 1, dtype=np.int32)), pa.array(c.ravel()))
            proj = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat, proj], ["rep", "n", "embedding", "cell", "p"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    ordered = vectors.select("rep", "n", "embedding").mapInArrow(cells, f"rep long, n long, embedding {kind}, cell array<int>, p array<double>")
    ranges = max(1, math.ceil(vectors.count() / SORTED))
    seq = checkpoint(ordered.repartitionByRange(ranges, "cell", "rep").sortWithinPartitions("cell", "rep").withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    starts = seq.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    blocks = seq.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("start") + within) / BLOCK).cast("long")).drop("part", "start")
    boxes = blocks.groupBy("block").agg(*[f(F.col("p")[i]).alias(f"{name}{i}") for i in range(k) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    boxes = checkpoint(boxes.select("block", F.floor(F.col("lo0") / eps).alias("c0"), F.floor(F.col("hi0") / eps).alias("c1"), F.array(*[f"lo{i}" for i in range(k)]).alias("lo"), F.array(*[f"hi{i}" for i in range(k)]).alias("hi")))
    left = boxes.select(F.col("block").alias("a"), "c0", "c1", "lo", "hi").withColumn("c", F.explode(F.sequence("c0", "c1")))
    right = boxes.select(F.col("block").alias("b"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")).withColumn("c", F.explode(F.sequence(F.col("d0") - 1, F.col("d1") + 1)))
    gap = lambda i: F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi")[i])
    near = sum((gap(i) * gap(i) for i in range(k)), F.lit(0.0)) <= eps * eps
    first = F.col("c") == F.greatest(F.col("c0"), F.col("d0") - 1)
    pairs = checkpoint(left.join(right, "c").where((F.col("a") <= F.col("b")) & first & near).select("a", "b"))
    rows = blocks.select("block", "at", "rep", "n", "embedding")
    one = pairs.join(rows, pairs.a == rows.block).select("a", "b", F.lit(0).alias("side"), "at", "rep", "n", "embedding")
    two = pairs.where("a < b").join(rows, pairs.b == rows.block).select("a", "b", F.lit(1).alias("side"), "at", "rep", "n", "embedding")

    def compare(t: pa.Table) -> pa.Table:
        side, rep, n = (t.column(c).to_numpy() for c in ("side", "rep", "n"))
        x, seat = unit(_matrix(t.column("embedding"), dim)), t.column("at").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = a[np.argsort(seat[a])], b[np.argsort(seat[b])]
        if t.column("a")[0].as_py() == t.column("b")[0].as_py():
            partners, label, _ = join_blocks(x[a], None, axes, n[a], None, cosine)
        else:
            partners, label, _ = join_blocks(x[a], x[b], axes, n[a], n[b], cosine)
        ids = rep[np.concatenate([a, b])]
        root = ids.copy()
        np.minimum.at(root, label, ids)  # smallest id of each label
        hit = partners > 0
        return pa.table({"rep": ids[hit], "partners": partners[hit], "root": root[label][hit]})

    return one.unionByName(two).groupBy("a", "b").applyInArrow(compare, "rep long, partners long, root long")


def link(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The contract's columns: vec_id, n_links, component_id, kept."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    e = F.col("embedding")
    fine = F.coalesce((F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(math.inf))) & F.exists(e, lambda v: v != 0), F.lit(False))
    good = rows.where(fine)
    distinct = checkpoint(good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    found = None
    for (dim,) in distinct.select(F.size("embedding")).distinct().collect():  # one row for each vector length
        part = _pairs_of(distinct.where(F.size("embedding") == dim).select("rep", "n", "embedding"), dim, cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
    found = checkpoint(found)
    partners = found.groupBy("rep").agg(F.sum("partners").alias("partners"))
    roots = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    members = checkpoint(distinct.select("rep", "first", "n").join(partners, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "first", (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root")))
    names = members.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = distinct.select("embedding", "rep").join(members.join(names, "root").select("rep", "n_links", "component_id"), "rep").drop("rep")
    linked = good.join(classes, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
