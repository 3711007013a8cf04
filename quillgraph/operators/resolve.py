"""Cross-file resolution of symbolic references and lookups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.frames import checkpoint

#: Answers to different references that may be broadcast; more are joined by shuffle.
BROADCAST_ANSWERS = 100_000


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose name equals ``name`` apart from case, in graph order."""
    return nodes.where(F.lower("name") == name.lower()).orderBy("ord")


def seed(nodes: DataFrame, target: str) -> str:
    """Id that a target names: the first node of that name, a file's id for a path, else the target itself."""
    row = nodes.where(F.lower("name") == target.lower()).agg(F.min_by("id", "ord")).first()
    if row[0]:
        return row[0]
    row = nodes.where((F.col("kind") == "file") & (F.col("file_path") == target)).agg(F.min_by("id", "ord")).first()
    return row[0] or target


def seeds(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(seed, id) of many targets (seed) at once, by the rules of ``seed``: joins, no job for each."""
    asked = targets.select("seed").distinct()
    named = nodes.select(F.lower("name").alias("__key"), "id", "ord").join(asked.select(F.lower("seed").alias("__key")).distinct(), "__key", "left_semi").groupBy("__key").agg(F.min_by("id", "ord").alias("__named"))
    paths = nodes.where("kind = 'file'").select(F.col("file_path").alias("__path"), "id", "ord").join(asked, F.col("__path") == F.col("seed"), "left_semi").groupBy("__path").agg(F.min_by("id", "ord").alias("__file"))
    rows = asked.join(named, F.lower("seed") == F.col("__key"), "left").join(paths, F.col("seed") == F.col("__path"), "left")
    return rows.select("seed", F.coalesce("__named", "__file", "seed").alias("id"))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("kind").isin("file", "doc_document")).select(F.lower("name").alias("__key"), "id", "file_path", "ord")


def _external() -> Column:
    t = F.col("target_id")
    return t.startswith("pkg:") | t.startswith("crate:") | t.startswith("file:")


def _reference() -> Column:
    """The name that an edge's target asks for; null for an external one."""
    t = F.col("target_id")
    raw = F.when(t.startswith("sym:"), F.substring(t, 5, 1 << 20)).otherwise(F.coalesce(F.col("target_name"), F.get(F.split(t, "#"), F.lit(1)), t))
    return F.when(~_external(), raw)


def asks(edges: DataFrame) -> DataFrame:
    """(ask, wanted, id, source_id, file_path): the lower-cased name and the id that each unresolved edge's target depends on."""
    return edges.select(F.lower(_reference()).alias("ask"), F.col("target_id").alias("wanted"), "id", "source_id", "file_path")


def changed_asks(asked: DataFrame, before: DataFrame, after: DataFrame, rest: DataFrame) -> DataFrame:
    """Ids of the edges in ``asked`` that may resolve in another way once the nodes ``before`` have become ``after``. ``rest``: all other nodes."""
    keys = _named(before).select("__key").union(_named(after).select("__key")).distinct()
    others = _named(rest).join(keys, "__key", "left_semi")

    def differs(by: list[str], found) -> DataFrame:
        old, new = (_named(n).unionByName(others).groupBy(*by).agg(found) for n in (before, after))
        return old.withColumnRenamed("__is", "__was").join(new, by, "full_outer").where("not (__is <=> __was)").select(*by)

    anywhere = differs(["__key"], F.struct((F.count(F.lit(1)) == 1).alias("one"), F.min_by("id", "ord").alias("any")).alias("__is"))
    own = differs(["__key", "file_path"], F.min_by("id", "ord").alias("__is"))
    ids = before.select("id", F.lit(1).alias("was")).join(after.select("id", F.lit(1).alias("is")), "id", "full_outer").where("was is null or is is null").select(F.col("id").alias("wanted"))
    by_name = asked.join(anywhere.withColumnRenamed("__key", "ask"), "ask", "left_semi")
    by_own = asked.join(own.withColumnRenamed("__key", "ask"), ["ask", "file_path"], "left_semi")
    return by_name.select("id").union(by_own.select("id")).union(asked.join(ids, "wanted", "left_semi").select("id")).distinct()


def candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that the targets of unresolved ``edges`` may be resolved to: all of their names, and those of their ids."""
    wanted = asks(edges)
    by_name = nodes.join(wanted.select(F.col("ask").alias("__ask")).distinct(), F.lower("name") == F.col("__ask"), "left_semi")
    by_id = nodes.join(wanted.select(F.col("wanted").alias("__ask")).distinct(), F.col("id") == F.col("__ask"), "left_semi")
    return by_name.unionByName(by_id).dropDuplicates(["id"])


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with target_id and confidence settled.

    A reference is symbolic if its target begins with ``sym:`` or is missing and not external. One node of the
    name: exact. Several: the first in the edge's own file (exact), else the first of all (heuristic). None: stays
    symbolic. Edges that ask the same in the same file are answered once, by names that are asked for, combined to one
    row each; only the answers are joined to the edges, so no name multiplies any and the edges are moved once at most.
    """
    t, asked_by = F.col("target_id"), ["target_id", "target_name", "file_path"]
    asked = checkpoint(edges.where(~_external()).select(*asked_by).distinct().withColumn("__raw", _reference()))
    open_ = ~t.startswith("sym:")
    symbolic = asked
    if not asked.where(open_).isEmpty():
        symbolic = checkpoint(asked.where(~open_).unionByName(asked.where(open_).join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti")))
    symbolic = symbolic.withColumn("__key", F.lower("__raw"))
    named = _named(nodes).join(symbolic.select("__key").distinct(), "__key", "left_semi")
    own = checkpoint(named.groupBy("__key", F.col("file_path").alias("__path")).agg(F.count(F.lit(1)).alias("__c"), F.min_by("id", "ord").alias("__own"), F.min("ord").alias("__ord")))
    anywhere = own.groupBy("__key").agg(F.sum("__c").alias("__n"), F.min_by("__own", "__ord").alias("__any"))
    rows = symbolic.join(anywhere, "__key", "left").withColumn("__path", F.col("file_path")).join(own.select("__key", "__path", "__own"), ["__key", "__path"], "left")
    hit = F.col("__n").isNotNull()
    target = F.when(F.col("__n") == 1, F.col("__any")).when(hit, F.coalesce("__own", "__any")).otherwise(F.concat(F.lit("sym:"), "__raw"))
    sure = F.when((F.col("__n") == 1) | F.col("__own").isNotNull(), F.lit("exact")).when(hit, F.lit("heuristic"))
    answers = checkpoint(rows.select(*[F.col(c).alias(f"__{c}") for c in asked_by], target.alias("__target"), sure.alias("__sure")).where("__sure is not null or not __target <=> __target_id"))
    few = F.broadcast(answers) if answers.count() <= BROADCAST_ANSWERS else answers
    same = (t == F.col("__target_id")) & F.col("target_name").eqNullSafe(F.col("__target_name")) & F.col("file_path").eqNullSafe(F.col("__file_path"))
    before = F.col("confidence") if "confidence" in edges.columns else F.lit(None).cast("string")
    out = edges.join(few, same, "left").withColumn("target_id", F.when(F.col("__target_id").isNotNull(), F.col("__target")).otherwise(t)).withColumn("confidence", F.coalesce("__sure", before))
    return out.select(*edges.columns, *([] if "confidence" in edges.columns else ["confidence"]))
