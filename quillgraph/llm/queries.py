"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from quillgraph.llm import fim, htmltext, langid, lexical, media, mixing, packing, pieces, pii, quality, simhash, toxicity, vectors
from quillgraph.llm.common import table

QUERIES = {
    "op1_pii": lambda spark, d: pii.detect(table(spark, d, "documents")),
    "op2_toxicity": lambda spark, d: toxicity.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_quality": lambda spark, d: quality.report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_sentencepiece": lambda spark, d: pieces.report(table(spark, d, "documents")),
    "op5_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
    "op6_embedding_dedup": lambda spark, d: vectors.link(table(spark, d, "embeddings")),
    "op7_simhash": lambda spark, d: simhash.report(table(spark, d, "documents")),
    "op8_media": lambda spark, d: media.report(table(spark, d, "documents")),
    "op9_html": lambda spark, d: htmltext.report(table(spark, d, "pages")),
    "op10_langid": lambda spark, d: langid.report(table(spark, d, "documents")),
    "op11_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op12_fim": lambda spark, d: fim.report(table(spark, d, "documents")),
    "op13_search": lambda spark, d: lexical.rank(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

ORACLES = {"op5_mixing": mixing.SQL, "op12_fim": fim.SQL, "op13_search": lexical.SQL}
