import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillgraph.llm import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", "  Hello  world\n\tfoo é𝒳 ", " ", "a", "\n\n", "x" * 5000, "    indented\n        code {\n", "ﬁ　½ ▁ 梦梦", "1234567890 3.14 ==========", "\x00 \x7f​", "ab" * 3000 + " " * 40 + "end"]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_equal_to_library(spark, sp):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = pieces.encode(docs.unionByName(odd)).collect()
    assert len(rows) == 1000 + len(ODD)
    for r in rows:
        ids = sp.encode(r.text)
        assert list(r.ids) == ids, r.doc_id
        assert r.decoded == sp.decode(ids), r.doc_id


def test_random_words(sp):
    enc, r = pieces.Encoder(open(pieces.MODEL, "rb").read()), random.Random(3)
    some = [sp.id_to_piece(i) for i in range(259, 32000)]
    texts = ["".join(r.choice(some).replace("▁", " ") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    import numpy as np

    for t, b in zip(texts, enc.encode(texts)):
        assert np.frombuffer(b, np.int32).tolist() == sp.encode(t), t


def test_unigram_is_viterbi():
    r = random.Random(1)
    toy = ["<unk>", *"abc", *{"".join(r.choice("abc") for _ in range(r.randint(2, 4))) for _ in range(25)}]
    scores = [0.0] + [-r.random() * 3 * len(p) ** 0.5 for p in toy[1:]]
    v = pieces.Vocabulary(toy, scores, "unigram")

    def best(w):
        return max(([s + scores[toy.index(w[:n])] for n in range(1, len(w) + 1) if w[:n] in toy[1:] for s in [best(w[n:])]] or [-1e9])) if w else 0.0

    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)}
    for w, ids in v.words(words):
        assert "".join(toy[i] for i in ids) == w and abs(sum(scores[i] for i in ids) - best(w)) < 1e-9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (None, "a b", None, None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], SCHEMA).withColumn("ids", F.lit(0))
    got = sorted((r.doc_id or -1, r.n_pieces, r.roundtrip) for r in pieces.report(docs).collect())
    assert got == [(-1, 2, True), (1, 0, True), (2, 0, True), (2, 0, True)]
    assert pieces.encoded_documents(docs).where("roundtrip").count() == 4
    assert pieces.report(docs.limit(0)).count() == 0
