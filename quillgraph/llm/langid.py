"""Language ID by rank-order profiles.

A profile lists the ``TOP`` most frequent letter n-grams (one to three letters, words padded by a space), ties in
code order. A document takes the language with the smallest out-of-place distance: for each of its most frequent
n-grams, the difference of its ranks, or ``TOP`` where the language's profile lacks it. Only n-grams inside one
padded word count. Profiles are counted by Spark from all whole training texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text where nothing
could be learnt; ties go to the first language in order; long texts count whole; repeated rows and rows with a
null doc_id are scored like others (a null doc_id is in no fold and is not learnt from); columns beyond doc_id, text
and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import DOC_COLUMNS, text_remainder

TOP, FOLDS = 300, 5
#: Texts whose n-grams are merged at once, distinct n-grams of a language that a task holds before it passes them on.
SLICE, MOST_HELD = 250, 1_000_000
#: Documents below this score (share of the largest distance avoided) are rejected by ``keep_known``.
LEAST_SCORE = 0.02
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes, ascending, and their counts. A code packs letters into 21 bits each."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_letters()[cp], cp, 32).astype(np.int64)
    c = np.concatenate([[32], c, [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 32]
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(text: str | None) -> np.ndarray:
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:TOP]]


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles of the languages of ``docs``, from rows whose doc_id is not held out."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (text_remainder(F.col("doc_id"), FOLDS) != 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # of each language: codes and their sums so far

        def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            return codes, np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            codes, sums = merged(held[lang])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], ["lang", "gram", "n"])

        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.setdefault(lang, []).append(grams(text))
                for lang in [k for k, v in held.items() if len(v) > 1]:
                    held[lang] = [merged(held[lang])]
                    if len(held[lang][0][0]) > MOST_HELD:
                        yield out(lang)
                        del held[lang]
        for lang in held:
            yield out(lang)

    total = known.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP).select("lang", "gram", "rank").collect()  # TOP rows for each language
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


class Profiles:
    """Out-of-place distances of texts to a few languages."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = list(profiles)
        self.codes = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.codes), len(self.langs)), -1, np.int32)
        for j, p in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.codes, np.array(p, np.int64)), j] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(text)
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        r = np.where((self.codes[at] == mine)[:, None], self.ranks[at], -1)
        far = np.where(r < 0, TOP, np.abs(r - np.arange(len(mine))[:, None])).sum(0)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (len(mine) * TOP)


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(profiles)
        for b in batches:
            got = [p.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows whose text has a language at ``least`` or above; the columns of documents."""
    profiles = learn(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiles(profiles)
        for b in batches:
            got = [p.predict(t) for t in b.column(1).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in got], pa.bool_()))

    rows = docs.select(*DOC_COLUMNS)
    return rows.mapInArrow(keep, rows.schema)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    held = F.coalesce(text_remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return predict(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
