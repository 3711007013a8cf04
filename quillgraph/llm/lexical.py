"""Ranked lexical search by windowed bucket scoring.

Documents are reduced to the counts of the terms that a block of queries asks for, written once to the shared folder
and dealt to tasks in ranges of doc_id. A task takes its documents in windows of fixed size. In each window postings
lie by term; a query adds the integer impacts of its terms into one array with a place for each document of the
window, small enough for the processor's cache, and marks the places in an occupancy bitset. The marked places are
harvested into the query's heap of the best so far, and both are cleared for the next query. The heaps of the tasks,
``top`` rows a query each, are merged in two steps.

Queries are taken in blocks of a bounded number of terms (all documents are read once a block), so the vocabulary
that tasks hold, the collected document frequencies and the broadcast never grow with either table. No posting list
is held whole in one place, so a word of all documents is as cheap a row as others.

Defined results: a text that is null or holds no term matches nothing and does not count among the N documents, nor
does a query without terms have results; repeated documents are ranked apart, as are queries of equal item_id; a null
doc_id takes part and ranks after all others of its score; equal scores rank by doc_id; a text of any length counts
whole; columns other than those named are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import LOWER, UPPER, written

#: Results a query; documents in a window (64-bit scores of 128 KB); about how many query terms, repeats included, make a block.
TOP, WINDOW, BLOCK = 20, 16_384, 200_000
#: Rows of a result batch, and tasks whose heaps are merged in a first step.
SLICE, MERGED = 2_500, 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes: letters, digits and all of other characters stay, A-Z is lowered, the rest separates.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(_BYTES).split() if text else []


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document: its number of terms and the counts of those in ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                n, sizes, ids, tfs = [], [0], [], []
                for text in part.column(1):
                    words = terms_of(text.as_py())
                    found = Counter(map(vocabulary.get, words))
                    found.pop(None, None)
                    n.append(len(words))
                    ids += found.keys()
                    tfs += found.values()
                    sizes.append(len(ids))
                lists = (pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Windows:
    """Scores a block of queries on one window of documents after another; keeps each query's best."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, documents: int, length: int, top: int, window: int):
        self.queries, self.n_terms, self.documents, self.length, self.top = queries, n_terms, documents, length, top
        self.scores, self.occupied = np.zeros(window, np.int64), np.zeros(window // 64 + 1, np.uint64)
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in queries]
        self.before = 0

    def add(self, doc_ids: list[int | None], n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """A window: its documents in order, and for each the number of its postings in ``terms`` and ``tfs``."""
        m = 75 + 25 * n * self.documents // self.length
        by_term = np.argsort(terms, kind="stable")
        places = np.repeat(np.arange(len(n)), sizes)[by_term]
        tf, term = tfs[by_term].astype(np.int64), terms[by_term]
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[places])
        first = np.searchsorted(term, np.arange(self.n_terms + 1))
        # bitsets of the terms' places, without their empty words
        word = places >> 6
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (word[1:] != word[:-1])]) if len(term) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), new) if len(new) else np.zeros(0, np.uint64)
        word, first_word = word[new], np.searchsorted(new, first)
        scores, occupied = self.scores, self.occupied
        for q, (asked, weights) in enumerate(self.queries):
            for t, w in zip(asked.tolist(), weights.tolist(), strict=True):
                a, b = first[t], first[t + 1]
                if a < b:
                    scores[places[a:b]] += w * impact[a:b]
                    a, b = first_word[t], first_word[t + 1]
                    occupied[word[a:b]] |= bits[a:b]
            words = np.flatnonzero(occupied)
            if len(words):
                marked = np.unpackbits(occupied[words].astype("<u8").view(np.uint8), bitorder="little")
                self._harvest(q, (np.repeat(words, 64) * 64 + np.tile(np.arange(64), len(words)))[marked.view(bool)], doc_ids)
                occupied[words] = 0
        self.before += len(n)

    def _harvest(self, q: int, at: np.ndarray, doc_ids: list[int | None]) -> None:
        heap, found = self.heaps[q], self.scores[at]
        self.scores[at] = 0
        good = found > (heap[0][0] if len(heap) == self.top else 0)  # later documents lose ties
        at, found = at[good], found[good]
        if len(at) > self.top:
            least = np.partition(found, -self.top)[-self.top]
            at, found = at[found >= least], found[found >= least]
        for place, score in zip(at.tolist(), found.tolist(), strict=True):
            if len(heap) < self.top:
                heapq.heappush(heap, (score, -(self.before + place), doc_ids[place]))
            elif score > heap[0][0]:
                heapq.heapreplace(heap, (score, -(self.before + place), doc_ids[place]))


def _scored(counted: DataFrame, queries: list[tuple[int, int | None, np.ndarray, np.ndarray]], n_terms: int, documents: int, length: int, top: int) -> DataFrame:
    """(query, item_id, task, doc_id, score): the best ``top`` of each range of documents."""
    window = WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        scorer = Windows([(t, w) for _, _, t, w in queries], n_terms, documents, length, top, window)
        held, count = [], 0

        def score() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            one = {c: rows.column(c).combine_chunks() for c in ("terms", "tfs")}
            sizes = np.diff(one["terms"].offsets.to_numpy())
            scorer.add(rows.column("doc_id").to_pylist(), rows.column("n").to_numpy(), sizes, one["terms"].flatten().to_numpy(), one["tfs"].flatten().to_numpy())

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, window - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == window:
                    score()
                    held, count = [], 0
        if count:
            score()
        out = [(number, item, task, doc, score) for (number, item, _, _), heap in zip(queries, scorer.heaps, strict=True) for score, _, doc in heap]
        kinds = {"query": pa.int64(), "item_id": pa.int64(), "task": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    order = F.asc_nulls_last("doc_id")
    return counted.where("size(terms) > 0").repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, "query long, item_id long, task long, doc_id long, score long")


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The ``top`` first rows of each query and other key, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("task"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score; items have item_id and text."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = F.size(F.split(F.translate(F.col("text").cast("string"), UPPER, LOWER), TERM)) - 1
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()).withColumn("size", size).where("size > 0"))
    blocks = max(1, math.ceil((asked.agg(F.sum("size")).first()[0] or 0) / block))
    out = None
    for k in range(blocks):
        texts = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).select("query", "item_id", "text").collect()  # about ``block`` terms
        if not texts:
            continue
        part = _block(docs, [(r.query, r.item_id, Counter(terms_of(bytes(r.text)))) for r in texts], top)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _block(docs: DataFrame, texts: list[tuple[int, int | None, Counter]], top: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for *_, terms in texts for t in terms}))}
    counted = written(_counted(docs, vocabulary))
    whole = counted.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    frequency = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the block at most
    weight = {i: math.floor(1000 * math.log((2 * whole.documents + 2) / (2 * df + 1))) for i, df in frequency.items()}
    queries = []
    for number, item, terms in texts:
        known = sorted((i, weight[i] * repeats) for t, repeats in terms.items() if (i := vocabulary[t]) in weight)
        queries.append((number, item, np.array([i for i, _ in known], np.int64), np.array([w for _, w in known], np.int64)))
    found = _scored(counted, queries, len(vocabulary), whole.documents, whole.length or 1, top)
    merged = _best(found.withColumn("part", F.floor(F.col("task") / MERGED)), ["query", "part"], top).drop("rank", "part")
    return _best(merged, ["query"], top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: DuckDB SQL of ``rank(documents, benchmark)``.
SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths),
measured AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // len AS m FROM lengths, whole),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN measured USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
