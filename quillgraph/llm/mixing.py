"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source s with n_s of N rows and target weight w_s gets the mean repetition rate N * w_s / n_s. A row's number
of copies is the inverse of that Poisson distribution at a uniform value made from the MD5 of seed and doc_id, so
it does not depend on partitioning and is the same when a lost task runs again. Rates above ``PART`` are the sum
of equal smaller Poisson draws, so no exponential underflows. Copies are exploded and dealt to partitions by the
hash of (seed, doc_id, copy), then sorted by it inside partitions: a global shuffle.

Defined results: a null source is a source of its own; a null doc_id draws from its text; repeated rows draw
alike; null and empty texts are mixed like others; sources missing from the weights get weight 0 and vanish;
columns beyond those named are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import DOC_COLUMNS

SEED, ALPHA = 17, 0.7
#: Largest mean of one draw.
PART = 100.0
#: Sources whose table (under 2 KB each) may be broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def _digits(text: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, n), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA) -> tuple[DataFrame, int]:
    """(source, n, rate) of each source and the number of sources. Without weights, w_s is n_s ** alpha, normalised."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        raw = F.lit(0.0)
        for s, w in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(raw)
    weighed = counts.withColumn("w", raw)
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k")).first()
    if not total.k or not total.w:
        return weighed.select("source", "n", F.lit(0.0).alias("rate")), total.k
    return weighed.select("source", "n", (F.lit(float(total.n)) * F.col("w") / F.lit(float(total.w)) / F.col("n")).alias("rate")), total.k


def _inverse_table(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2 ... up to where the rest is below double precision."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    zero = F.exp(-mean)

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), most), F.struct(zero.alias("p"), F.array(zero).alias("c")), step)["c"]


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Columns of documents, then copy_no (from 1) and shuffle_key, in globally shuffled order."""
    rate, n_sources = rates(docs, weights, alpha)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    side = rate.select(
        F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source"), parts.alias("__parts"), (F.col("rate") / parts).alias("__mean")
    ).withColumn("__cdf", _inverse_table(F.col("__mean"))).where("__mean > 0")
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select(*DOC_COLUMNS, F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source"), key.alias("__key"))
    joined = rows.join(F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side, ["__null", "__source"])

    def draw(j: Column) -> Column:
        u = (_digits(F.concat_ws(":", F.lit(str(seed)), F.col("__key"), j.cast("string")), 13) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.size(F.filter(F.col("__cdf"), lambda c: c < u))

    n = F.aggregate(F.sequence(F.lit(0), F.col("__parts") - 1), F.lit(0), lambda acc, j: acc + draw(j))
    copies = joined.withColumn("__n", n).where("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    order = _digits(F.concat_ws(":", F.lit(f"order{seed}"), F.col("__key"), F.col("copy_no").cast("string")), 15)
    return copies.select(*DOC_COLUMNS, "copy_no", order.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: DuckDB SQL for ``mix(documents)`` with the default parameters (rates up to ``PART``).
SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(n)::DOUBLE AS n, sum(pow(n::DOUBLE, {ALPHA})) AS w FROM counts),
rate AS (SELECT source, total.n * pow(counts.n::DOUBLE, {ALPHA}) / total.w / counts.n AS mean FROM counts, total),
pmf AS (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM rate, range(0, 240) AS r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
lists AS (SELECT source, list(c ORDER BY k) AS c FROM cdf GROUP BY source),
keyed AS (SELECT d.*, coalesce(d.doc_id::VARCHAR, sha256(coalesce(d.text, ''))) AS key FROM documents d),
drawn AS (SELECT d.*, l.c, (('0x' || substr(md5('{SEED}:' || key || ':0'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
          FROM keyed d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
counted AS (SELECT *, len(list_filter(c, lambda x: x < u)) AS n FROM drawn),
copies AS (SELECT *, unnest(range(1, n + 1))::INT AS copy_no FROM counted WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy_no,
       ('0x' || substr(md5('order{SEED}:' || key || ':' || copy_no::VARCHAR), 1, 15))::BIGINT AS shuffle_key FROM copies
"""
