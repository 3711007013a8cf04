import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "line\n\n next", "tab\t x", "it's we'll", " 's", "Ñandú 日本語 😀", "x  y", "　 z", "a\x1c b", "<|endoftext|>", "a  <|endoftext|>b", "a <|endoftext|> b", "one <|endoftext", "1234 567,89 -- !!",
    "no-spaces-here" * 40, "\n", " \n", "end\n",
]


def library_ids(texts):
    return [[*e.ids, 0] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def best_fit_decreasing(sizes, size=packing.SIZE):
    gaps, n = [0] * (size + 1), 0
    for s in sorted(sizes, reverse=True):
        g = next((g for g in range(s, size) if gaps[g]), None)
        if g is None:
            n, g = n + 1, size
        else:
            gaps[g] -= 1
        gaps[g - s] += 1
    return n


def test_encoder_equals_library(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 500)
    monkeypatch.setattr(packing, "CALL", 7)
    texts = TEXTS + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab Ñ,.'\n\t 1é \x0b") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    encoder = packing.Encoder(PATH)
    for at in range(0, len(texts), 400):
        some = texts[at : at + 400]
        ids, sizes = encoder.encode(pa.array(some))
        ends = np.cumsum(sizes)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == library_ids(some)


def held(rows, docs):
    """Pieces against the library's ids; sequences gapless and within their size. Number of sequences."""
    want = {i: ids for (i, _), ids in zip(docs, library_ids([t or "" for _, t in docs]), strict=True)}
    seqs, seen = {}, {}
    for r in rows:
        ids = want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert seen.keys() == want.keys()
    for i, pieces in seen.items():
        pieces.sort()
        n = -(-len(want[i]) // packing.SIZE)
        first = len(want[i]) - (n - 1) * packing.SIZE
        assert pieces == [(k, 0 if not k else first + (k - 1) * packing.SIZE, first if not k else packing.SIZE) for k in range(n)]
    for parts in seqs.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist() and sum(p[1] for p in parts) <= packing.SIZE
    return len(seqs)


@pytest.mark.parametrize("rows", [packing.ROWS, 150])
def test_packs_as_few_as_best_fit(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "ROWS", rows)
    rng = random.Random(9)
    word = lambda n: " ".join(rng.choice(["the", "sea", "and", "of"]) for _ in range(n))
    docs = list(enumerate([*TEXTS, None, word(2047), word(2048), word(2049), word(9000), *[word(rng.choice((3, 40, 300, 700, 1000, 1500))) for _ in range(500)], *["the same text of many rows" * 60] * 250]))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "state", "rid", "part", "piece", "seq")}).repartition(4)
    out = packing.pack(df)
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    got = out.collect()
    n = held(got, docs)
    best = best_fit_decreasing([r.length for r in got])
    assert n <= best * 1.01 + 1


def test_deals_hold_every_row_once():
    """Over random summaries: deals of a range and state don't overlap and stay within it; nothing is opened while a gap may fit."""
    rng = random.Random(2)
    from types import SimpleNamespace as Row

    for _ in range(300):
        rows, top = [], 2000
        for part in range(rng.randint(1, 8)):
            low = max(1, top - rng.randint(0, 400))
            for state in (packing.PIECE, packing.FRESH, packing.USED):
                if rng.random() < 0.7 and top < 1025 or state != packing.PIECE:
                    n = rng.randint(1, 50)
                    rows.append(Row(part=part, state=state, n=n, least=low, most=top, total=n * (low + top) // 2))
            top = low
        deals, limit = packing.plan(rows), {(r.part, r.state): r.n for r in rows}
        for key in limit:
            spans = sorted((a, b) for p, s, a, b, _ in deals if (p, s) == key)
            assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False)) and (not spans or 0 <= spans[0][0] and spans[-1][1] <= limit[key])
        assert all(s == packing.PIECE for _, s, _, _, d in deals if d < 0)


def test_sequences_hold_the_ids(spark):
    docs = [(k, "some text, and more of it " * (k % 90)) for k in range(120)] + [(None, "no id"), (5, "the id of another row")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = packing.sequences(df).collect()
    assert all(len(r.ids) <= packing.SIZE for r in got)
    cut = sorted(tuple(x) for r in got for x in np.split(np.array(r.ids), np.flatnonzero(np.array(r.ids) == 0) + 1) if len(x))
    assert sum(len(x) for x in cut) == sum(map(len, library_ids([t for _, t in docs]))) and tuple(library_ids(["no id"])[0]) in cut
    assert sum(i is None for r in got for i in r.doc_ids) == 1
    assert packing.pack(df.limit(0)).count() == 0
