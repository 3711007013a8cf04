import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, top=20):
    """{(item_id, rank): (doc_id, score)} by the contract's formulas, document by document."""
    found = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = defaultdict(list)
    for item, text in items:
        scores = []
        for i, c in found:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1):
            out[item].append((rank, i, -s))
    return out


def test_terms():
    for t in ("Ab-c Ñé_ñ it's 3.14", "", "  ", "日本語、テスト x y", "\x00a\x7fb", "ÀÉ aZ09{}[]`@:/"):
        assert [w.decode() for w in lexical.terms_of(t.encode())] == terms(t)


@pytest.mark.parametrize("window,block", [(lexical.WINDOW, lexical.BLOCK), (64, 600)])
def test_against_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(lexical, "WINDOW", window)
    rng = random.Random(3)
    words = ["the", "The", "sea", "Ñu", "ñu", "x1", "日本"] + [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((3, 9, 67))]) for _ in range(n))
    docs = [(k * 37 % 1000 - 200, text(rng.randint(0, 30))) for k in range(700)]
    docs += [(5000 + k, "same words here the sea") for k in range(90)] + [(None, "the sea w1"), (7001, None), (7002, " .,; "), (7003, "sea " * 200_000)]
    items = [(k, text(rng.randint(1, 12))) for k in range(12)] + [(50, None), (51, ""), (52, "nowhere found"), (53, "the the the sea"), (54, "SAME words here"), (55, "w1 w2 w3 " * 500)]
    got = defaultdict(list)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "terms", "item_id", "score", "rank")}).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc_id", "query", "size")})
    found = lexical.rank(d, q, block=block)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    for r in found.collect():
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == brute(docs, items)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a"), (3, "c c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a"), (9, "a"), (10, "zzz")], "item_id long, text string")
    got = sorted((r.item_id, r.rank, r.doc_id) for r in lexical.rank(docs, items).collect())
    assert got == sorted([(9, 1, 2), (9, 2, 1), (9, 3, 1)] * 2)
    assert sorted(r.rank for r in lexical.rank(docs, items.limit(1), top=2).collect()) == [1, 2]
    assert lexical.rank(docs.limit(0), items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0


def test_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(lexical.SQL).fetchall()
    got = [tuple(r) for r in lexical.rank(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()]
    assert len(got) > 500 and sorted(got) == sorted(want)
