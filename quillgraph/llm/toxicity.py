"""Toxicity by class-conditional Kneser-Ney models.

Two word models, toxic and ordinary, with three levels: bigrams of the class, continuation counts of the class, and
continuation counts shared by both, so that expressions too rare for a class fall back on the same shared counts.
Discounts are the modified Kneser-Ney ones, estimated from the counts. A text's evidence is the log-likelihood ratio
of its words, normalised by length over the whole text and over its strongest runs of ``RUNS`` words; a
logistic curve, fitted on scores from models that had not seen the text (two folds), maps it to 0..1.

Counts cover every labelled row whose crc32(doc_id) mod 4 is not 2, and every word and bigram keeps its own entry. They
stay in the shared folder; a task looks up those of its own texts by reading through the files, so that what it holds is bounded by
``CHUNK`` and not by the model. Only the logistic curve is fitted on a sample, of about ``MOST`` rows per class at most. Labelled rows
of one class with the same words in the same order count once. Words are runs of letters, in lower case, and enter as 64-bit hashes.

Defined results: null and empty texts score the fitted prior of a text without evidence; without labels of both
classes every score is 0; repeated rows pass, a null doc_id is not held out and not learnt from; columns other than
doc_id and text are ignored; conflicting labels of one doc_id count as toxic; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpoint, text_remainder, written

#: Labelled rows per class that the logistic curve is fitted on.
MOST = {0: 10_000, 1: 4_000}
#: Words of texts scored at once; labelled rows that may be broadcast (more are joined by shuffle).
CHUNK, BROADCAST_ROWS = 2_000_000, 2_000_000
RUNS = (1, 4, 16)
#: Ratios above which words are counted as strong evidence.
STRONG = (1.5, 2.5, 3.5)
EXTRA = len(STRONG) + 3
THRESHOLD, FOLD, HELD = 0.3, 4, 2
BOS = np.uint64(1)


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more, from how many events occur once to four times."""
    if min(n) == 0:
        return np.array([0.0, 0.7, 0.9, 1.1])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([0.0, *(min(max(v, 0.05), k - 0.05) for k, v in zip((1, 2, 3), d))])


def _cut(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(counts - d[np.minimum(counts, 3).astype(np.int64)], 0.0)


class Model:
    """Both classes' models, whole or the part that some texts need.

    ``words``: hashes of the words, ascending; ``shared`` and ``cont``: their continuation counts, of both classes and of each;
    ``mass``: how often each precedes a word, by class; ``pairs``: before, word and counts by class of the pairs;
    ``seen``: for "shared", "cont0", "cont1", "pair0", "pair1" how many events occur one to four times, their sum, and (in a part) their number.
    ``size`` and ``cuts`` are of a part: the words of the whole model, and for each word here the discounted counts of all pairs that it begins, by class.
    """

    def __init__(self, words: np.ndarray, shared: np.ndarray, cont: np.ndarray, mass: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], seen: dict[str, list[int]], size: int | None = None, cuts: np.ndarray | None = None):
        def left(name: str, cut: np.ndarray) -> float:
            """The share that discounting takes from all events."""
            if size is None:
                return float(1 - cut.sum() / max(seen[name][4], 1))
            d, (one, two, _, _, total, events) = discounts(seen[name][:4]), seen[name]
            return float(d[1] * one + d[2] * two + d[3] * (events - one - two)) / total if total else 1.0

        self.words, n = words, len(words)
        total = max(seen["shared"][4], 1)
        cut = _cut(shared, discounts(seen["shared"][:4]))
        self.rare = left("shared", cut) / ((n if size is None else size) + 1)  # shared probability of any other word
        ps = cut / total + self.rare
        before, word, counts = pairs
        find = lambda x: np.minimum(np.searchsorted(words, x), max(n - 1, 0))
        at = find(before) if n else np.zeros(len(before), np.int64)
        known = words[at] == before if n else np.zeros(len(before), bool)
        order = np.argsort(keys := self._key(before, word))
        self.keys, self.one, self.keep, self.parts = keys[order], [], [], []
        for c in (0, 1):
            total = max(seen[f"cont{c}"][4], 1)
            cut = _cut(cont[:, c], discounts(seen[f"cont{c}"][:4]))
            back = left(f"cont{c}", cut)
            self.one.append(np.append(cut / total + back * ps, back * self.rare))  # the last entry stands for other words
            part = np.where(known, _cut(counts[:, c], discounts(seen[f"pair{c}"][:4])) / np.maximum(mass[at, c] if n else 1, 1), 0.0)
            self.parts.append(part[order])
            used = np.bincount(at[known], weights=part[known], minlength=n) if cuts is None else cuts[:, c] / np.maximum(mass[:, c], 1)
            self.keep.append(np.append(1 - used, 1.0))

    @staticmethod
    def _key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
        x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0x632BE59BD9B4E019) + (before << np.uint64(6)))
        return x ^ (x >> np.uint64(29))

    def ratios(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, toxic to ordinary, of each word; texts begin at ``starts``."""
        before = np.concatenate([[BOS], h[:-1]])
        before[starts] = BOS
        n = len(self.words)
        find = lambda table, x: np.minimum(np.searchsorted(table, x), max(len(table) - 1, 0))
        w, b = find(self.words, h), find(self.words, before)
        w, b = (np.where(self.words[i] == x, i, n) if n else np.zeros(len(h), np.int64) for i, x in ((w, h), (b, before)))
        p = [self.keep[c][b] * self.one[c][w] for c in (0, 1)]
        if len(self.keys):
            key = self._key(before, h)
            k = find(self.keys, key)
            hit = self.keys[k] == key
            for c in (0, 1):
                p[c] = p[c] + np.where(hit, self.parts[c][k], 0.0)
        return np.log(p[1]) - np.log(p[0])

    def features(self, h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per text: mean ratio, strongest run of each length (per word of the run), log counts of strong words, log length, one."""
        out = np.zeros((len(lengths), len(RUNS) + EXTRA))
        out[:, -1] = 1.0
        out[:, -2] = np.log1p(lengths) / 5
        if not len(h):
            return out
        ends = np.cumsum(lengths)
        full = lengths > 0
        starts = (ends - lengths)[full]
        r = self.ratios(h, starts)
        out[full, 0] = np.add.reduceat(r, starts) / lengths[full]
        total = np.concatenate([[0.0], np.cumsum(r)])
        begin = np.repeat(starts, lengths[full])
        at = np.arange(len(r)) + 1
        for j, k in enumerate(RUNS):
            run = total[at] - total[np.maximum(at - k, begin)]
            out[full, 1 + j] = np.maximum.reduceat(run, starts) / k
        for j, least in enumerate(STRONG):
            out[full, 1 + len(RUNS) + j] = np.log1p(np.add.reduceat((r > least).astype(np.int64), starts))
        return out


def curve(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _hashed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    return docs.select(*columns, F.transform(words, lambda w: F.xxhash64(w)).alias("h"))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, y, fold) of all labelled documents outside the held-out remainder."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (text_remainder(F.col("doc_id"), FOLD) != HELD))
    one = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    return one.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).cast("int"))


def _with(docs: DataFrame, rows: DataFrame, on: str | list[str], n: int) -> DataFrame:
    return docs.join(F.broadcast(rows) if n <= BROADCAST_ROWS else rows, on)


def _single(docs: DataFrame, rows: DataFrame, n: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, fold, first, second) of ``rows``, one of each set with equal words: copies are no new evidence; and the rows of each class before that.

    ``first`` and ``second`` are hashes of the words; only they are moved.
    """
    both = _hashed(_with(docs, rows, "doc_id", n), "doc_id", "y", "fold").select("doc_id", "y", "fold", F.xxhash64("h").alias("first"), F.xxhash64(F.lit(1), "h").alias("second"))
    groups = checkpoint(both.groupBy("first", "second", "y").agg(F.min(F.struct("doc_id", "fold")).alias("r"), F.count(F.lit(1)).alias("n")).select("r.*", "first", "second", "y", "n"))
    return groups.drop("n"), {r.y: r.n for r in groups.groupBy("y").agg(F.sum("n").alias("n")).collect()}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (before, word) by class and fold, summed inside a batch. Rows: cell (class + 2 * fold), h."""
    for b in batches:
        h, n = _values(b.column(1))
        if not len(h):
            continue
        cell = np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)
        before = np.concatenate([[BOS], h[:-1]])
        before[(np.cumsum(n) - n)[n > 0]] = BOS
        order = np.lexsort((h, before))
        x, y, cell = before[order], h[order], cell[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        at = np.cumsum(new) - 1
        sums = np.bincount(at * 4 + cell, minlength=4 * (at[-1] + 1)).reshape(-1, 4).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)), pa.array(y[new].view(np.int64)), *[pa.array(np.ascontiguousarray(sums[:, c])) for c in range(4)]], ["a", "b", "n0", "n1", "n2", "n3"])


def sample(single: DataFrame) -> DataFrame:
    """About ``MOST`` rows per class at most, picked by hash; the logistic curve is fitted on them."""
    n = {r.y: r["count"] for r in single.groupBy("y").count().collect()}
    least = {y: int(1e6 * min(1.0, most / n.get(y, 1))) for y, most in MOST.items()}
    return single.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < F.when(F.col("y") == 1, F.lit(least[1])).otherwise(F.lit(least[0])))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new]


def _find_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in the pairs (x, y) of those of the pairs (a, b) that are there; both sides are distinct and in order."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    runs = x[starts]
    run = np.minimum(np.searchsorted(runs, a), len(runs) - 1)
    hit = np.flatnonzero(runs[run] == a)
    # a run's number and the upper 40 bits of the second word make one number in the same order; what shares them lies side by side
    upper = lambda v: (v >> 24) + (1 << 39)
    sizes = np.diff(np.append(starts, len(x)))
    own = np.repeat(np.arange(len(runs)), sizes) << 40 | upper(y)
    at = np.searchsorted(own, wanted := run[hit] << 40 | upper(b[hit]))
    good = np.zeros(len(at), bool)
    while True:
        inside = at < len(x)
        same = inside & ~good
        same[inside] &= own[at[inside]] == wanted[inside]
        good[same] = y[at[same]] == b[hit][same]
        on = same & ~good
        if not on.any():
            return at[good]
        at[on] += 1


#: Columns of pair counts that make up each training set (fold 0, fold 1, both) and class.
CELLS = {(0, 0): ["n0"], (0, 1): ["n1"], (1, 0): ["n2"], (1, 1): ["n3"], (2, 0): ["n0", "n2"], (2, 1): ["n1", "n3"]}


class Counts:
    """The counts of all learnt rows, as files of the shared folder, and their tallies."""

    def __init__(self, pairs: DataFrame, words: DataFrame, seen: dict):
        self.pairs, self.words, self.seen, self.size = pairs.inputFiles(), words.inputFiles(), seen, words.count()

    @staticmethod
    def _read(files: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
        for uri in files:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                yield from pq.ParquetFile(f).iter_batches(1 << 18, columns=columns)

    def parts(self, h: np.ndarray, before: np.ndarray, models: tuple[int, ...]) -> list[Model]:
        """What the words ``h`` after ``before`` need of the models of fold 0, fold 1, or (2) both, in one reading."""
        get = lambda b, c: np.asarray(pc.fill_null(b.column(c), 0))
        find = lambda table, x: np.minimum(np.searchsorted(table, x), len(table) - 1)
        words = np.unique(h)
        names = [n for s in models for n in (f"shared{s}", *[f"{n}{s}{c}" for n in ("cont", "mass", "cuts") for c in (0, 1)])]
        of, there = np.zeros((len(words), len(names))), np.zeros(len(words), bool)
        for b in self._read(self.words, ["b", *names]):
            x = get(b, "b").view(np.uint64)
            hit = words[at := find(words, x)] == x
            there[at[hit]] = True
            of[at[hit]] = np.stack([get(b, c)[hit] for c in names], 1)
        words, of = words[there], of[there]
        asked, after = _distinct(before.view(np.int64), h.view(np.int64))
        found: list[tuple] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 4)]
        for b in self._read(self.pairs, ["a", "b", "n0", "n1", "n2", "n3"]):  # ranges of a, each in order: only the pairs asked for in a batch's range are looked up
            x = get(b, "a")
            i, j = np.searchsorted(asked, x[0]), np.searchsorted(asked, x[-1], "right")
            if i == j:
                continue
            at = _find_pairs(x, y := get(b, "b"), asked[i:j], after[i:j])
            found.append((x[at].view(np.uint64), y[at].view(np.uint64), *[get(b, f"n{c}")[at].astype(np.int32) for c in range(4)]))
        x, y, *n = (np.concatenate(c) for c in zip(*found))
        out = []
        for i, s in enumerate(models):
            own = of[:, 7 * i : 7 * i + 7]
            counts = np.stack([sum(n[int(k[1])] for k in CELLS[s, c]) for c in (0, 1)], 1)
            seen = {name: [self.seen[f"{column}_{k}"] or 0 for k in (1, 2, 3, 4, 5, 6)] for name, column in (("shared", f"shared{s}"), *[(f"{k}{c}", f"{k}{s}{c}") for k in ("cont", "pair") for c in (0, 1)])}
            out.append(Model(words, own[:, 0], own[:, 1:3], own[:, 3:5], (x, y, counts), seen, self.size, own[:, 5:7]))
        return out

    def features(self, h: np.ndarray, lengths: np.ndarray, models: tuple[int, ...]) -> list[np.ndarray]:
        """Features of the texts by each of ``models``."""
        if not len(h):
            return [np.zeros((len(lengths), len(RUNS) + EXTRA)) + np.eye(1, len(RUNS) + EXTRA, len(RUNS) + EXTRA - 1) for _ in models]
        before = np.concatenate([[BOS], h[:-1]])
        ends = np.cumsum(lengths)
        before[(ends - lengths)[lengths > 0]] = BOS
        parts = self.parts(h, before, models)
        del before
        at = np.concatenate([[0], ends])
        cuts = [*range(0, len(lengths), 200), len(lengths)]  # few at once, for memory
        return [np.concatenate([m.features(h[at[i] : at[j]], lengths[i:j]) for i, j in zip(cuts, cuts[1:])]) for m in parts]


def _counts(counted: DataFrame) -> Counts | None:
    """Every word and pair of the learnt rows; None without words of both classes."""
    bits = max(6, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 2)  # ranges grow with the partitions
    bucketed = counted.withColumn("bucket", F.shiftright("a", 64 - bits).cast("int")).repartition("bucket")  # rows are summed in each batch already
    pairs = written(bucketed.groupBy("bucket", "a", "b").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(4)]).sortWithinPartitions("bucket", "a", "b"), "bucket")
    of = {f"{s}{c}": sum((F.col(x) for x in cells), F.lit(0)) for (s, c), cells in CELLS.items()}

    def tally(name: str, column) -> list:
        return [*[F.count_if(column == k).alias(f"{name}_{k}") for k in (1, 2, 3, 4)], F.sum(column).alias(f"{name}_5"), F.count_if(column > 0).alias(f"{name}_6")]

    seen = pairs.agg(*[x for k, v in of.items() for x in tally(f"pair{k}", v)]).first().asDict()
    if not seen["pair20_5"] or not seen["pair21_5"]:
        return None
    after = pairs.groupBy("b").agg(*[F.count_if(v > 0).alias(f"cont{k}") for k, v in of.items()], *[F.count_if((of[f"{s}0"] + of[f"{s}1"]) > 0).alias(f"shared{s}") for s in range(3)])
    cuts = {}
    for k, v in of.items():
        d = [float(x) for x in discounts([seen[f"pair{k}_{i}"] for i in (1, 2, 3, 4)])]
        cuts[k] = F.greatest(v - F.when(v == 0, d[0]).when(v == 1, d[1]).when(v == 2, d[2]).otherwise(d[3]), F.lit(0.0))
    mass = pairs.groupBy("a").agg(*[F.sum(v).alias(f"mass{k}") for k, v in of.items()], *[F.sum(v).alias(f"cuts{k}") for k, v in cuts.items()])
    words = written(after.join(mass, F.col("b") == F.col("a"), "left").drop("a").sortWithinPartitions("b"))
    seen |= words.agg(*[x for c in after.columns[1:] for x in tally(c, F.col(c))]).first().asDict()
    return Counts(pairs, words, seen)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows whose column h has about ``CHUNK`` words together."""
    held, n = [], 0
    for b in batches:
        for start in range(0, b.num_rows, 500):
            held.append(part := b.slice(start, 500))
            n += len(part.column("h").flatten())
            if n >= CHUNK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Counts, np.ndarray] | None:
    """The counts and the fitted curve's weights; None where a class has no labelled text."""
    rows = labelled(labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    single, before = _single(texts, rows, rows.count())
    known = _hashed(_with(texts, single.select("doc_id", "y", "fold"), "doc_id", single.count()), "y", "fold", (F.col("y") + 2 * F.col("fold")).alias("cell"))
    counts = _counts(known.select("cell", "h").mapInArrow(_count, "a long, b long, n0 long, n1 long, n2 long, n3 long"))
    if counts is None:
        return None
    k = len(RUNS) + EXTRA

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            b = t.to_batches()[0]
            first, second = counts.features(*_values(b.column("h")), (0, 1))
            x = np.where((b.column("fold").to_numpy() == 0)[:, None], second, first)  # by the counts of the other fold
            yield pa.RecordBatch.from_arrays([b.column("y"), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], ["y", *[f"f{i}" for i in range(k)]])

    picked = _hashed(texts.join(F.broadcast(sample(single).select("doc_id", "y", "fold")), "doc_id"), "y", "fold")  # bounded by MOST
    judged = picked.mapInArrow(judge, ", ".join(["y int", *[f"f{i} double" for i in range(k)]])).toArrow()  # bounded by MOST
    x, y = np.stack([judged.column(i + 1).to_numpy() for i in range(k)], 1), judged.column(0).to_numpy()
    weights = logistic(x, y)
    share = {c: max((y == c).sum(), 1) / before[c] for c in (0, 1)}
    weights[-1] += np.log(share[0] / share[1])  # back to the classes' own frequencies, before copies were merged and rows picked
    return counts, weights


def score(docs: DataFrame, model: tuple[Counts, np.ndarray] | None) -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    counts, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            b = t.to_batches()[0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(curve(counts.features(*_values(b.column("h")), (2,))[0], weights))], ["doc_id", "score"])

    return _hashed(rows, "doc_id").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    held = F.coalesce(text_remainder(F.col("doc_id"), FOLD) == HELD, F.lit(False))
    return score(docs, learn(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
