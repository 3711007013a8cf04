"""Fill-in-middle transformation: DuckDB SQL over each Arrow batch of a ``mapInArrow``.

Every text is cut into units (a word with the white space before it, or white space at the end); two hashed cuts give
prefix, middle and suffix, which a hashed draw orders as ``<P>``prefix``<S>``suffix``<M>``middle (psm), as
``<S>``suffix``<P>``prefix``<M>``middle (spm) or leaves as they are (plain). The draws are groups of the sha256 of
``seed:doc_id``, so a lost task gives the same rows when it runs again. Batches are registered as a view in slices of
bounded text, each answered by one statement; no row passes through Python. The original text is rebuilt from the
output and its form alone, by the sentinels, which no transformed text holds.

Defined results: null text counts as empty, and an empty text is plain with no units; a text that holds a sentinel
stays plain; white space alone is one unit; a null doc_id is hashed as an empty string, and repeated rows are cut
alike; a text of any length is cut whole, one slice holding at least one; columns other than doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seed of the draws, share of transformed texts and share of suffix-first ones among them, in hundredths.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
#: Bytes of text in one statement, and the memory that DuckDB may take for it.
SLAB, MEMORY = 4_000_000, "800MB"

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SENTINEL = "<[PSM]>"

#: All columns of one batch; restored comes from output and form alone.
BATCH_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{unit}') AS units, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM batch
), draws AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::UBIGINT % (len(units) + 1)::UBIGINT AS one, ('0x' || substr(h, 9, 8))::UBIGINT % (len(units) + 1)::UBIGINT AS two,
         CASE WHEN text = '' OR regexp_matches(text, '{sentinel}') OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= {rate} THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM texts
), cut AS (
  SELECT doc_id, text, n, form, least(one, two)::BIGINT AS a, greatest(one, two)::BIGINT AS b, units FROM draws
), parts AS (
  SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS prefix,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS middle, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS suffix FROM cut
), written AS (
  SELECT doc_id, n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts
), read_back AS (
  SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, '{sentinel}') END AS p FROM written
), restored AS (
  SELECT doc_id, n, form, prefix_chars, middle_chars, output, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN p[2] || p[4] || p[3] ELSE p[3] || p[4] || p[2] END AS restored FROM read_back
)
SELECT {columns} FROM restored"""

#: Result columns of the two forms of the operator: their SQL and their type in Spark.
REPORT = {"doc_id": ("doc_id", "long"), "n": ("n", "long"), "form": ("form", "string"), "prefix_chars": ("prefix_chars", "long"), "middle_chars": ("middle_chars", "long"), "output_sha256": ("sha256(output)", "string"), "restored_sha256": ("sha256(restored)", "string")}
TEXTS = {k: REPORT[k] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars")} | {"output": ("output", "string"), "restored": ("restored", "string")}


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` holding up to ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _run(docs: DataFrame, columns: dict[str, tuple[str, str]], seed: int, rate: int, suffix_first: int) -> DataFrame:
    listed = ", ".join(f"{sql} AS {name}" for name, (sql, _) in columns.items())
    query = BATCH_SQL.format(unit=UNIT, sentinel=SENTINEL, seed=seed, rate=rate, suffix_first=suffix_first, columns=listed)
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, (_, kind) in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            for batch in batches:
                for part in slices(batch, 1, SLAB):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.sql(query).to_arrow_table().cast(schema).to_batches()
                    con.unregister("batch")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, (_, kind) in columns.items()))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and the text rebuilt from it, of every row."""
    return _run(docs, TEXTS, seed, rate, suffix_first)


def report(docs: DataFrame) -> DataFrame:
    """``transform`` with digests in place of the texts."""
    return _run(docs, REPORT, SEED, RATE, SUFFIX_FIRST)


#: DuckDB SQL of ``report(documents)``, by code point positions in the text in place of lists of units.
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
ends AS (SELECT *, [0] || list_transform(regexp_extract_all(x, '{UNIT}'), lambda u: length(u)) AS e FROM t),
drawn AS (SELECT *, (len(e) - 1)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % len(e) AS c, ('0x' || h[9:16])::BIGINT % len(e) AS d FROM ends),
places AS (SELECT doc_id, x, n, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= {RATE} THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
                  list_sum(e[1:least(c, d) + 1])::BIGINT AS a, list_sum(e[1:greatest(c, d) + 1])::BIGINT AS b FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN concat('<P>', left(x, a), '<S>', substr(x, b + 1), '<M>', substr(x, a + 1, b - a))
              ELSE concat('<S>', substr(x, b + 1), '<P>', left(x, a), '<M>', substr(x, a + 1, b - a)) END) AS output_sha256,
       sha256(x) AS restored_sha256 FROM places
"""
