import math
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quillgraph.llm import langid, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_rank(text):
    t = "".join(ch if ch.isalpha() else " " for ch in text.lower())
    n = Counter()
    for w in t.split():
        n.update(w)
        w = f" {w} "
        for k in (2, 3):
            n.update(w[i : i + k] for i in range(len(w) - k + 1))
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [pack(g) for g in sorted(n, key=lambda g: (-n[g], pack(g)))][: langid.TOP]


def test_profile_against_plain():
    for t in ("Ein Satz, ein Wort. Über allem!", "a", "--12--", "", "été  à la plage" * 50):
        assert list(langid.ranked(t)) == plain_rank(t)


def test_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    rows = [(1, None, "en", "a", 0), (2, "123 ...", "en", "a", 0), (None, "the cat", None, None, 0), (4, "the cat " * 60000, "en", "a", 0), (4, "the cat", "en", "a", 0)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))
    out = {(r.doc_id, r.lang_pred) for r in langid.report(odd).collect()}
    assert {(1, "und"), (2, "und"), (4, "en"), (None, "en")} == out
    assert langid.report(odd.limit(0)).count() == 0
    assert langid.keep_known(odd).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in langid.keep_known(odd).collect()} == {None, 4}


def test_learning_and_distance_by_definition(spark, monkeypatch):
    """Profiles from counts over all training texts, and the language of the smallest out-of-place distance, in plain Python."""
    import zlib

    monkeypatch.setattr(langid, "SLICE", 3)
    monkeypatch.setattr(langid, "MOST_HELD", 400)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, None if r.doc_id % 10 == 3 else r.lang) for r in rows] + [(None, "nobody learns this", "en"), (900001, None, "de"), (900002, "", "xx"), (900003, "long " * 30000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {}
    for i, t, lang in rows:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            n = counts.setdefault(lang, Counter())
            for w in "".join(ch if ch.isalpha() else " " for ch in (t or "").lower()).split():
                n.update(w)
                n.update(f" {w} "[k : k + size] for size in (2, 3) for k in range(len(w) + 3 - size))
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    want = {lang: [pack(g) for g in sorted(n, key=lambda g: (-n[g], pack(g)))][: langid.TOP] for lang, n in counts.items() if n}
    assert langid.learn(docs) == want
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.report(docs).collect()}
    for i, t, _ in rows:
        mine = plain_rank(t or "")
        far = {lang: sum(abs(p.index(g) - k) if g in p else langid.TOP for k, g in enumerate(mine)) for lang, p in sorted(want.items())}
        best = min(far, key=far.get) if mine else "und"
        assert out[i][0] == best and abs(out[i][1] - (1 - far[best] / (len(mine) * langid.TOP) if mine else 0)) < 1e-12


def test_long_text_is_mixed_whole(spark):
    long = "w " * 400_000
    docs = spark.createDataFrame([(i, long + str(i), "en", "s", 1) for i in range(4)], SCHEMA)
    got = mixing.mix(docs, {"s": 1.0}).collect()
    assert all(r.text == long + str(r.doc_id) for r in got)


def test_mix_against_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(mixing.SQL).fetchall(), key=str)


def test_mix_rates_and_edges(spark):
    rows = [(i, "t", "en", None if i % 3 == 0 else "b", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("copy_no", F.lit("clash"))
    n = Counter(r.source for r in mixing.mix(docs, {None: 0.5, "b": 0.5}).collect())
    assert abs(n[None] - 1500) < 4 * math.sqrt(1500) and abs(n["b"] - 1500) < 4 * math.sqrt(1500)
    assert set(Counter(r.source for r in mixing.mix(docs, {"b": 1.0}).collect())) == {"b"}
    few = spark.createDataFrame([(1, None, None, "one", None)] + [(None, "x", None, "two", 1)] * 999, SCHEMA)
    n = Counter(r.source for r in mixing.mix(few, {"one": 1.0, "two": 1.0}).collect())
    assert abs(n["one"] - 500) < 120 and n["two"] % 999 == 0
    assert mixing.mix(few.limit(0)).count() == 0
