import math
import sys
from collections import Counter

from tests.llm.test_pii import plain
from tests.llm.test_simhash import plain_components, plain_fp


def test_stages_against_brute_force(spark, sf):
    import corpus_pipeline as cp
    import sentencepiece

    from quillgraph.llm import mixing, pieces

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    known = cp.known_language(spark, docs, sf)
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} == {i for i, r in rows.items() if any(c.isalpha() for c in r.text)}
    ids = sorted(rows)
    fps = [plain_fp(rows[i].text) for i in ids]
    comp = plain_components(ids, fps)
    kept = cp.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in ids if comp[i] == i}
    clean = {r.doc_id: r for r in cp.personal_data(spark, docs, sf).collect()}
    assert set(clean) == set(rows)
    assert all((clean[i].text == rows[i].text) or plain(rows[i].text) or "<SECRET>" in clean[i].text or "<NATIONAL" in clean[i].text for i in ids)
    assert not any(plain(clean[i].text) for i in ids) and all(r.n_chars == len(r.text) for r in clean.values())
    once, again = (Counter(r.doc_id for r in mixing.mix(docs).collect()) for _ in range(2))
    assert once == again
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    last = cp.run(spark, sf).collect()
    assert last and all(list(r.ids) == sp.encode(r.text) and r.n_pieces == len(r.ids) and r.roundtrip for r in last)
    assert abs(len(last) - sum(comp[i] == i for i in ids)) < 5 * math.sqrt(len(ids))
    assert cp.ORACLE_SQL is None and 4 <= len(cp.STAGES) <= 5


def test_entry_registers_everything():
    import __spark_entry__ as e

    q = e.queries()
    assert "pipeline" in q and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in q if k.startswith("op")}
    assert set(e.oracle_sql()) <= set(q)
    assert "quillgraph.llm" in sys.modules


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string, copy_no string, page_id string"


def test_odd_documents(spark, tmp_path):
    """Null columns, empty and very long texts, repeated rows, equal ids with different texts and extra columns pass all stages."""
    import corpus_pipeline as cp

    long = "the house of the river and the hill " * 40_000
    rows = [(1, long + "mail me@x.org", "en", "a", 1), (2, None, "en", "a", 0), (3, "", None, None, None), (4, "12 34 !!", "en", "a", 8), (None, "the river and the hill are here", "en", None, 1), (5, "the end of the road", None, "b", 1)]
    rows += [(6, "the other end of that long road and more", "en", "b", 1)] * 3 + [(7, "a wholly different text about rivers and towns", "en", "b", 1), (7, "the other end of that long road and more", "en", "b", 1)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "p") for r in rows], ODD)
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    known = cp.known_language(spark, docs, str(tmp_path))
    assert Counter(r.doc_id for r in known.collect()) == {1: 1, None: 1, 5: 1, 6: 3, 7: 2}
    kept = cp.near_duplicates(spark, known, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text[:12]) for r in kept.collect()) == [(0, "the river an"), (1, "the house of"), (5, "the end of t"), (6, "the other en"), (7, "a wholly dif")]
    clean = {r.doc_id: r.text for r in cp.personal_data(spark, kept, str(tmp_path)).collect()}
    assert clean[1] == long + "mail <EMAIL>" and clean[5] == "the end of the road"
    out = cp.run(spark, f"{tmp_path}/in").collect()
    assert all(r.roundtrip and r.n_pieces == len(r.ids) for r in out) and {r.doc_id for r in out} <= {1, None, 5, 6, 7}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
