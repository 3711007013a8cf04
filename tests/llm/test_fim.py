import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42):
    """The contract in plain Python: (doc_id, n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "\n\t \r", "a", " a", "a ", "two words", "tabs\tand\x0bfeeds\x0c  end \n", "no break   space", "Grüße 日本語 😀 ok", "has <P> inside", "almost <P <S <M > here", "<", "x<", ">y <", "P> S> M> <", "<<S", "é combining",
    "nul\x00inside here", "word " * 50_000, "x" * 300_000,
]


@pytest.mark.parametrize("slab", [1, 40, fim.SLAB])
def test_by_definition(spark, monkeypatch, slab):
    monkeypatch.setattr(fim, "SLAB", slab)
    rows = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS)] + [(None, "no id here at all"), (5, "again"), (5, "again"), (-7, "negative id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("batch", F.lit(1))
    got = fim.transform(docs).collect()
    want = [plain(*r) for r in rows]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted((repr(r.doc_id), r.restored) for r in got) == sorted((repr(i), t or "") for i, t in rows)
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.report(docs).collect()}
    assert digests == {(w[0], hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for w, (_, t) in zip(want, rows, strict=True)}


def test_other_parameters_and_empty_table(spark):
    docs = spark.createDataFrame([(k, f"some words of row {k}") for k in range(200)], "doc_id long, text string")
    all_psm = fim.transform(docs, seed=7, rate=100, suffix_first=0).collect()
    assert {r.form for r in all_psm} == {"psm"} and {r.restored for r in all_psm} == {f"some words of row {k}" for k in range(200)}
    assert fim.transform(docs, rate=0).where("form <> 'plain'").count() == 0
    empty = fim.report(docs.limit(0))
    assert empty.count() == 0 and empty.columns == list(fim.REPORT)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = ", ".join(fim.REPORT)
    want = con.execute(f"SELECT {cols} FROM ({fim.SQL})").fetchall()
    got = [tuple(r) for r in fim.report(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert len(got) >= 200 and sorted(map(repr, got)) == sorted(map(repr, want))
