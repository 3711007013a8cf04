"""Freshness, reconcile and incremental upsert: snapshots of files against what the graph has indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE_MS, HEAL_MS = 50, 500


def reconcile(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change): insert, update (hashes differ) or delete; unchanged files do not appear. Both: (path, hash)."""
    a, b = indexed.select("path", F.col("hash").alias("old")), disk.select("path", F.col("hash").alias("new"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return both.select("path", change.alias("change")).where("change is not null")


def freshness(indexed: DataFrame, disk: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, is_stale, reason) of the asked paths. Both sides: (path, hash, mtime_ms)."""
    a = indexed.select("path", F.col("hash").alias("old"), F.col("mtime_ms").alias("old_ms"))
    b = disk.select("path", F.col("hash").alias("new"), F.col("mtime_ms").alias("new_ms"))
    rows = paths.select("path").distinct().join(a, "path", "left").join(b, "path", "left")
    gone = F.col("old").isNotNull() & F.col("new").isNull()
    changed = (F.col("new_ms") > F.col("old_ms") + TOLERANCE_MS) & (F.col("new") != F.col("old"))
    reason = F.when(gone, "file_deleted").when(changed, "file_modified_on_disk")
    return rows.select("path", reason.isNotNull().alias("is_stale"), reason.alias("reason"), "old")


def freshness_summary(rows: DataFrame) -> DataFrame:
    """One row: is_stale, reason of the last stale path, content_hash of the paths' hashes (``clean`` without any)."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("old").isNotNull(), F.struct("path", F.substring("old", 1, 8).alias("old"))))), lambda s: s["old"]), "")  # of the paths that a caller names
    return rows.agg(F.coalesce(F.bool_or("is_stale"), F.lit(False)).alias("is_stale"), F.max_by("reason", F.when(F.col("is_stale"), F.col("path"))).alias("reason"), F.when(F.length(parts) > 0, parts).otherwise("clean").alias("content_hash"))


def needs_heal(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """(heal): whether any file is new, gone, or changed with another time."""
    a = indexed.select("path", F.col("hash").alias("old"), F.col("mtime_ms").alias("old_ms"))
    b = disk.select("path", F.col("hash").alias("new"), F.col("mtime_ms").alias("new_ms"))
    odd = F.col("old").isNull() | F.col("new").isNull() | ((F.abs(F.col("old_ms") - F.col("new_ms")) > HEAL_MS) & (F.col("old") != F.col("new")))
    return a.join(b, "path", "full_outer").agg((F.count_if(odd) > 0).alias("heal"))


def upsert(table: DataFrame, rows: DataFrame, changed: DataFrame, key: str = "file_path") -> DataFrame:
    """``table`` without the rows of changed paths, then ``rows``: replace, insert and delete by file. ``changed``: (path)."""
    gone = changed.select(F.col("path").alias("__gone")).distinct()
    return table.join(gone, F.col(key) == F.col("__gone"), "left_anti").unionByName(rows)


def debounce(events: DataFrame, key: str, ts: str, item: str, gap: str = "10 seconds") -> DataFrame:
    """(key, started, n, items): bursts of events no more than ``gap`` apart, each with its distinct items."""
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(item).alias("item"))
    got = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("n_items"), F.min("ts").alias("started"))
    return got.select("key", "started", "n", "n_items")


def ancestor(roots: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, root): the longest root that is the path or one of its parents, by an equi-join on the path's parents."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    wide = paths.select("path").distinct().select("path", F.explode(prefixes).alias("root"))
    found = wide.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(found, "path", "left").select("path", "root")
