import math

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import quality, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_links(ids, xs, cosine=0.95):
    ok = [x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x) for x in xs]
    n = {i: 0 for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(xs[i]) == len(xs[j]):
                a, b = np.array(xs[i], float), np.array(xs[j], float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= cosine:
                    n[ids[i]] += 1
                    n[ids[j]] += 1
                    p, q = sorted((find(ids[i]), find(ids[j])))
                    parent[q] = p
    return {i: (n[i], find(i), find(i) == i) for i in ids}


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 60)
    monkeypatch.setattr(vectors, "LEAF", 16)
    rng = np.random.default_rng(2)
    xs = []
    for _ in range(25):
        c = rng.normal(size=12)
        xs += [[float(np.float32(v)) for v in c + rng.normal(size=12) * 0.25 * rng.random()] for _ in range(9)]
    xs += [xs[0]] * 5 + [None, [], [0.0] * 12, [float("nan")] * 12, [None] * 12, [1.0, 2.0], [2.0, 4.0], [1e30] * 12, [-1e30] * 12]
    ids = list(rng.permutation(len(xs)))
    rows = [(int(i), x) for i, x in zip(ids, xs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.link(df).collect()}
    assert got == plain_links([int(i) for i in ids], xs)
    assert vectors.link(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in vectors.link(odd).collect()) == [(0, 2, 3), (3, 2, 3), (3, 2, 3)]
    near = spark.createDataFrame([(None, [1.0, 0.001]), (9, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [0.001, 1.0]), (None, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.link(near).collect()) == [(0, 0, 0, False), (0, 1, 0, False), (0, 1, 0, False), (0, 1, 9, False), (9, 1, 9, True)]


def test_chains_through_null_ids(spark, monkeypatch):
    """Vectors without an id carry links; held against brute force with ids of their own."""
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "LEAF", 8)
    monkeypatch.setattr(vectors, "SORTED", 50)
    xs = [[float(np.float32(v)) for v in (np.cos(t), np.sin(t), 0.3)] for t in np.linspace(0, 9, 130)]
    ids = [i if i % 3 else None for i in range(130)]
    got = vectors.link(spark.createDataFrame(list(zip(ids, xs)), "vec_id long, embedding array<float>")).collect()
    want = plain_links(list(range(130)), xs)
    least = {}
    for i, (_, root, _) in want.items():
        if ids[i] is not None:
            least[root] = min(i, least.get(root, i))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in got) == sorted((-1 if ids[i] is None else i, n, least[root]) for i, (n, root, _) in want.items())


def test_vectors_of_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.link(df).collect()}
    assert got == plain_links([r.vec_id for r in rows], [r.embedding for r in rows])


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "FINE", 10)
    monkeypatch.setattr(quality, "BINS", 8)
    rng = np.random.default_rng(0)
    v = [float(x) for x in np.round(rng.normal(size=2000) ** 3, 1)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for k in (1, 7, 1000, 1999, 2000):
        assert quality.kth_largest(df, "v", k) == sorted(v, reverse=True)[k - 1]


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.report(docs, labels)
    n = got.count()
    assert abs(got.where("kept").count() - math.ceil(quality.good_share(labels) * n)) <= 40
    judged = got.join(labels, "doc_id").where("quality is not null").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    assert {r.quality: r.k for r in judged}[1] > 0.95 and {r.quality: r.k for r in judged}[0] < 0.35
    rows = got.join(labels, "doc_id").select("quality", "kept", (F.col("log_weight") / F.greatest("n_grams", F.lit(1))).alias("w")).where("quality is not null").collect()
    good, bad = [r.w for r in rows if r.quality == 1], [r.w for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good[:800] for b in bad[:300]]) > 0.7
    ratio = quality.learn(docs, labels)
    from quillgraph.llm.common import words_of

    r = docs.where("doc_id = 3").select("text", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).first()
    b, _ = quality.ngram_buckets(np.array(r.h, np.int64).view(np.uint64), np.array([len(r.h)]))
    assert abs(got.where("doc_id = 3").first().log_weight - ratio[b].sum()) < 1e-9
    odd = spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0), (None, "x", "", "", 1), (2, "", "", "", 0)], SCHEMA).withColumn("kept", F.lit(1))
    assert {(r.doc_id, r.log_weight) for r in quality.report(odd, labels.limit(0)).collect()} == {(1, 0.0), (2, 0.0), (None, 0.0)}
    assert quality.report(odd.limit(0), labels).count() == 0


def test_quality_model_by_definition(spark):
    """Counts of hashed one- and two-word n-grams, log ratios, weights and the choice, in plain Python."""
    import hashlib
    import re

    import xxhash

    texts = ["The cat sat on the mat", "a  b\tc\nd", None, "", "cat Cat cat cat", "junk junk !!", "x" * 70_000, "the end of the cat " * 3000, "the end of the cat " * 3000]
    rows = [(i if i != 5 else None, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows[8] = rows[7]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("good", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (4, 0, 0), (7, 1, 1), (7, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    mask, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def buckets(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[\\x20\\x09-\\x0D]+", (t or "").lower()) if w]
        two = [((a * mix) & mask) ^ ((b + (a << 7)) & mask) for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h] + [(x ^ (x >> 31)) % quality.BUCKETS for x in two]

    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t, *_ in rows:
        for b in buckets(t):
            raw[b] += 1
            good[b] += i in (0, 1, 7)
    ratio = np.log((good + 1) / (good.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(quality.learn(docs, labels), ratio)
    want = []
    for i, t, *_ in rows:
        key = str(i) if i is not None else hashlib.sha256(t.encode()).hexdigest()
        u = (int(hashlib.md5(f"{quality.SEED}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        w = sum(ratio[b] for b in buckets(t))
        want.append((-1 if i is None else i, len(buckets(t)), w, w - math.log(-math.log(u))))
    k = math.ceil(quality.good_share(labels) * len(rows))
    least = sorted((x[3] for x in want), reverse=True)[k - 1]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_grams, r.log_weight, r.gumbel_key, r.kept) for r in quality.report(docs, labels).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and [x[4] for x in got] == [x[3] >= least - 1e-9 for x in sorted(want)]
    assert np.allclose([x[2:4] for x in got], [x[2:4] for x in sorted(want)])
