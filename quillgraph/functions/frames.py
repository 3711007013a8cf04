"""Frame helpers: checkpoints in the shared folder, first rows by an explicit order."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it names none, a temporary folder in local mode and an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``. A hash aggregate, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def spread(df: DataFrame, rows_a_task: int) -> DataFrame:
    """``df`` over tasks of about so many rows, one a core at least: for rows that are small to move and dear to work on. A small file would give one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task)))


def last_writer(df: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows with a key seen several times become one: the last one's values at the first one's place."""
    place = F.struct("file_ord", "emit_ord")
    rest = [c for c in df.columns if c not in (*keys, "file_ord", "emit_ord")]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("__v"), F.min(place).alias("__p"))
    return one.select(*[F.col("__p")[c].alias(c) if c in ("file_ord", "emit_ord") else (F.col(c) if c in keys else F.col("__v")[c].alias(c)) for c in df.columns])
