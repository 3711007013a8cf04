"""Ranked symbol search: one projection over nodes and a lookup of the query's tokens, one top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text

# Points.
EXACT, SAME, PREFIX, PART, TOKEN, PATH = 100, 60, 30, 15, 5, 10
KIND_POINTS = {"class": 15, "interface": 15, "route": 12, "function": 10, "method": 10, "type": 8}


def node_tokens(nodes: DataFrame) -> Column:
    """All tokens of a node, one copy from each of its texts that has the token."""
    cols = [text.symbol_tokens(F.col("name")), text.symbol_tokens(F.col("file_path"))]
    cols += [text.text_tokens(F.col(c)) for c in ("signature", "docstring", "snippet") if c in nodes.columns]
    return F.concat(*cols)


def token_index(nodes: DataFrame) -> DataFrame:
    """(token, id, freq)."""
    return nodes.select("id", F.explode(node_tokens(nodes)).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("freq"))


def query_tokens(query: str) -> list[str]:
    """Tokens of a query: its ``text_tokens``, which the optimizer folds to a local row."""
    return list(SparkSession.active().sql("SELECT :q AS q", args={"q": query}).select(text.text_tokens(F.col("q"))).collect()[0][0])


def _token_hits(nodes: DataFrame, wanted: list[str]) -> Column:
    """How many of a node's tokens are wanted. A token is a run of its text's letters and digits, so only texts with such a run are tokenized."""
    total: Column = F.lit(0)
    for c, tokens in [("name", text.symbol_tokens), ("file_path", text.symbol_tokens)] + [(c, text.text_tokens) for c in ("signature", "docstring", "snippet") if c in nodes.columns]:
        bare = F.lower(F.regexp_replace(F.col(c), text.NO_TOKEN, ""))
        total = total + F.when(_any([bare.contains(w) for w in wanted]), F.size(F.filter(tokens(F.col(c)), lambda t: t.isin(wanted)))).otherwise(0)
    return total


def search(nodes: DataFrame, query: str | None, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """id, name, kind, file_path, score, match_type, highlight of the best nodes, best first; none for a blank query.

    ``index``: the nodes' ``token_index``, as a store has it written; without it nodes are tokenized where they may match.
    """
    whole = (query or "").strip()
    terms = whole.split()
    some = lambda test, least=1: F.lit(False) if not terms else _any([test(F.lit(t), F.lit(t.lower())) for t in dict.fromkeys([whole] + [t for t in terms if len(t) >= least])])
    name, low, path = F.col("name"), F.lower("name"), F.lower("file_path")
    exact = some(lambda t, _: name == t)
    same = some(lambda _, t: low == t)
    prefix = some(lambda _, t: low.startswith(t), 2)
    part = some(lambda _, t: low.contains(t), 2)
    symbol = F.when(exact, EXACT).when(same, SAME).when(prefix, PREFIX).when(part, PART).otherwise(0)
    wanted = query_tokens(whole)
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_POINTS.items() for x in kv])[F.col("kind")], F.lit(0))
    if not wanted:
        found = nodes.withColumn("__n", F.lit(0))
    elif index is not None:  # looked up by token in the written index
        hits = index.where(F.col("token").isin(wanted)).groupBy("id").agg(F.sum("freq").alias("__n"))
        found = nodes.join(hits, "id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    else:
        found = nodes.withColumn("__n", _token_hits(nodes, wanted))
    scored = found.withColumn("__s", symbol).withColumn("score", F.col("__s") + F.col("__n") * TOKEN).where("score > 0")
    scored = scored.withColumn("score", (F.col("score") + kind + F.when(some(lambda _, t: path.contains(t), 2), PATH).otherwise(0)).cast("int"))
    match = F.when(F.col("__s") >= SAME, "exact_name").when(F.col("__s") > 0, "partial_name").when(F.col("kind").isin("doc_section", "doc_document"), "doc").otherwise("fts_content")
    shown = F.coalesce("signature", "name") if "signature" in nodes.columns else F.col("name")
    out = scored.select("id", "name", "kind", "file_path", "score", match.alias("match_type"), shown.alias("highlight"), "ord")
    return out.orderBy(F.desc("score"), F.collate("name", "UNICODE"), "ord").limit(limit if limit > 0 else 10).drop("ord")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
