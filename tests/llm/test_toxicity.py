import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def toy():
    """A model of small counts, and the same probabilities by definition."""
    words = np.array([10, 20, 30], np.uint64)
    shared, cont = np.array([4, 3, 2]), np.array([[3, 1], [0, 3], [2, 0]])
    mass = np.array([[6, 2], [0, 5], [3, 0]])
    pairs = (np.array([10, 20], np.uint64), np.array([20, 20], np.uint64), np.array([[0, 2], [0, 4]]))
    seen = {"shared": [0, 0, 0, 0, 9], "cont0": [0, 0, 0, 0, 5], "cont1": [0, 0, 0, 0, 4], "pair0": [0, 0, 0, 0, 9], "pair1": [0, 0, 0, 0, 7]}
    return toxicity.Model(words, shared, cont, mass, pairs, seen)


def test_probabilities_by_definition():
    m, d = toy(), [0, 0.7, 0.9, 1.1]
    cut = lambda n: max(n - d[min(n, 3)], 0)
    shared, cont = {10: 4, 20: 3, 30: 2}, [{10: 3, 20: 0, 30: 2}, {10: 1, 20: 3, 30: 0}]
    mass, pair = [{10: 6, 30: 3}, {10: 2, 20: 5}], [{}, {(10, 20): 2, (20, 20): 4}]
    rest = 1 - sum(map(cut, shared.values())) / 9

    def one(c, w):
        total = sum(cont[c].values())
        back = 1 - sum(map(cut, cont[c].values())) / total
        return cut(cont[c].get(w, 0)) / total + back * (cut(shared.get(w, 0)) / 9 + rest / 4)

    def two(c, h, w):
        part = lambda x: cut(pair[c].get((h, x), 0)) / mass[c].get(h, 1)
        return part(w) + (1 - sum(part(x) for x in shared)) * one(c, w)

    text = [10, 20, 20, 99, 30]
    got = m.ratios(np.array(text, np.uint64), np.array([0]))
    want = [math.log(two(1, h, w) / two(0, h, w)) for h, w in zip([1, *text], text)]
    assert np.allclose(got, want)


def test_features_by_definition():
    m = toy()
    texts = [[10, 20, 20, 99, 30], [], [20], [30] * 40 + [20] * 5]
    h = np.array([w for t in texts for w in t], np.uint64)
    f = m.features(h, np.array([len(t) for t in texts]))
    for t, row in zip(texts, f):
        r = m.ratios(np.array(t, np.uint64), np.array([0])) if t else np.zeros(0)
        want = [r.mean() if t else 0]
        want += [max(r[max(0, i + 1 - k) : i + 1].sum() / k for i in range(len(t))) if t else 0 for k in toxicity.RUNS]
        want += [math.log1p((r > s).sum()) for s in toxicity.STRONG] + [math.log1p(len(t)) / 5, 1]
        assert np.allclose(row, want)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        w = list(rng.choice(base, int(rng.integers(5, 80))))
        y = int(i % 6 == 0)
        if y:
            for _ in range(int(rng.integers(1, 4))):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["vile", "awful", "scorn"])))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, y))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    got = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_edges(spark, corpus):
    docs, labels = corpus
    odd = spark.createDataFrame([(5000, None, "", "", 0), (5001, "", "", "", 0), (None, "vile awful " * 50000, "", "", 1), (5001, "", "", "", 0)], SCHEMA)
    got = toxicity.report(docs.unionByName(odd).withColumn("toxic", F.lit("clash")), labels).where("doc_id is null or doc_id >= 5000").collect()
    by = {r.doc_id: (r.score, r.held_out) for r in got}
    assert len(got) == 4 and by[None][0] > 0.9 and not by[None][1] and by[5000][0] == by[5001][0] < 0.3
    none = toxicity.report(odd, labels.where("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_every_labelled_row_counts(spark, corpus, monkeypatch):
    """Rows beyond the curve's sample, words of one context and pairs seen once all have counts of their own."""
    docs, labels = corpus
    monkeypatch.setattr(toxicity, "MOST", {0: 50, 1: 20})
    counts, _ = toxicity.learn(docs, labels)
    want = {}
    for r in docs.join(toxicity.labelled(labels), "doc_id").select("y", F.split("text", " ").alias("w")).collect():
        for pair in zip([None, *r.w], r.w):
            want.setdefault(pair, [0, 0])[r.y] += 1
    number = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for p in want for w in p if w}], "w string").select("w", F.xxhash64("w").alias("h")).collect()} | {None: 1}
    stored = spark.read.parquet(*counts.pairs).selectExpr("a", "b", "n0 + n2 as c0", "n1 + n3 as c1").collect()
    assert {(r.a, r.b): [r.c0, r.c1] for r in stored} == {(number[a], number[b]): n for (a, b), n in want.items()}
    assert spark.read.parquet(*counts.words).count() == counts.size == len({b for _, b in want})


def test_part_equals_whole(spark, corpus):
    """A part of the stored model gives the ratios of the model held whole; unknown words too."""
    docs, labels = corpus
    counts, _ = toxicity.learn(docs, labels)
    pairs, words = spark.read.parquet(*counts.pairs).toArrow(), spark.read.parquet(*counts.words).toArrow()
    get = lambda t, c: np.nan_to_num(t.column(c).to_numpy())
    h = words.column("b").to_numpy().view(np.uint64)
    order = np.argsort(h)
    for s in range(3):
        both = lambda n: np.stack([get(words, f"{n}{s}{c}")[order] for c in (0, 1)], 1)  # noqa: E731, B023
        n = np.stack([sum(get(pairs, x) for x in toxicity.CELLS[s, c]) for c in (0, 1)], 1)
        seen = {k: [counts.seen[f"{v}_{i}"] for i in range(1, 6)] for k, v in {"shared": f"shared{s}", **{f"{k}{c}": f"{k}{s}{c}" for k in ("cont", "pair") for c in (0, 1)}}.items()}
        whole = toxicity.Model(h[order], get(words, f"shared{s}")[order], both("cont"), both("mass"), (pairs.column("a").to_numpy().view(np.uint64), pairs.column("b").to_numpy().view(np.uint64), n), seen)
        for text in (np.concatenate([h[3:40], [np.uint64(7)], h[20:5:-1]]), np.array([7, 8], np.uint64)):
            before = np.concatenate([[toxicity.BOS], text[:-1]])
            assert np.allclose(counts.parts(text, before, (s,))[0].ratios(text, np.array([0])), whole.ratios(text, np.array([0])))


def test_shared_passage_is_no_copy(spark):
    """Documents that share a passage are all learnt from; those with equal words once; the prior is of all labelled rows."""
    passage = " ".join(f"pass{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))
    rows = [(i, f"{'abcdefghij'[i // 10]}x{'abcdefghij'[i % 10]} {passage} end{'abcdefghij'[i % 10]}", "en", "s", 1) for i in range(100)]
    rows += [(1000 + i, "the very same text", "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(r[0], 0, 0) for r in rows], "doc_id long, y int, fold int")
    single, before = toxicity._single(docs, marks, 105)
    kept = {r.doc_id for r in single.collect()}
    assert kept == {*range(100), 1000} and before == {0: 105}


def test_found_pairs():
    """Lookup of pairs against a dictionary, with words that share their upper bits."""
    rng = np.random.default_rng(3)
    draw = lambda n: (rng.integers(-40, 40, n) << 50, (rng.integers(-9, 9, n) << 30) + rng.integers(0, 4, n))
    x, y = toxicity._distinct(*draw(3000))
    a, b = toxicity._distinct(*draw(3000))
    got = toxicity._find_pairs(x, y, a, b)
    there = {p: i for i, p in enumerate(zip(x.tolist(), y.tolist()))}
    assert got.tolist() == [there[p] for p in zip(a.tolist(), b.tolist()) if p in there] and len(got)
