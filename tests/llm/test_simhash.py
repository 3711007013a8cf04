import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, fps, most=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                p, q = sorted((find(a), find(ids[j])))
                parent[q] = p
    return {i: find(i) for i in ids}


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    ids, fps = [r[0] for r in rows], [plain_fp(r[1]) for r in rows]
    want = plain_components(ids, fps)
    got = {r.doc_id: r for r in simhash.report(docs).collect()}
    assert {i: got[i].fingerprint for i in ids} == {i: f"{f:016x}" for i, f in zip(ids, fps)}
    assert {i: got[i].component_id for i in ids} == want
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == {i for i in ids if want[i] == i}


def test_links_of_close_and_hot_cells(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = []
    for b in base:
        x = b
        for _ in range(12):
            fps.append(x)
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
    fps = list(dict.fromkeys(fps))
    want = plain_components(list(range(len(fps))), fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    points = spark.createDataFrame(rows, "fp long, rep long")
    for cell in (4096, 4):
        monkeypatch.setattr(simhash, "CELL", cell)
        from quillgraph.llm.common import components

        got = {r.node: r.component for r in components(simhash.links(points)).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "A b", "en", "s", 3), (3, "A b", "en", "s", 3), (None, "a B", "en", "s", 3), (7, long, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.report(docs).collect())
    ab = f"{plain_fp('a b'):016x}"
    assert got == sorted([(1, "0" * 16, 1), (2, "0" * 16, 1), (3, ab, 3), (3, ab, 3), (-1, ab, 3), (7, f"{plain_fp(long):016x}", 7)])
    kept = simhash.keep_first(docs.drop("fp", "component_id"))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 7]
    assert simhash.report(docs.limit(0)).count() == 0
