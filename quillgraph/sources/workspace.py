"""A source tree as a Spark data source: ``spark.read.format("workspace").load(root)``, batch and streaming.

Rows are (path, size, mtime_ms, content). Ignored folders are pruned while walking, files are filtered by extension and size; names that begin with
``_`` or ``.`` are read like others. The driver lists names, sizes and times and packs files into partitions of bounded size; tasks read the contents,
or none with the option ``content`` = ``false``. The stream yields files changed since the last trigger; deletions come from the reconcile step. The
root must be readable on the executors.
"""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillgraph import schema as fixed

#: Bytes and files of one input partition.
PART_BYTES, PART_FILES = 16 << 20, 2000


def wanted(rel: str, size: int) -> bool:
    parts, low = rel.split("/"), rel.lower()
    base = parts[-1]
    ext = base.rsplit(".", 1)[-1].lower() if "." in base[1:] else ""
    return not pruned(parts) and not low.endswith(tuple(fixed.IGNORED_SUFFIXES)) and ext in fixed.SCANNED and size <= fixed.MAX_FILE_BYTES


def pruned(parts: list[str]) -> bool:
    return not set(fixed.IGNORED_SEGMENTS).isdisjoint(parts)


def walk(root: str, below: str = "") -> Iterator[tuple[str, int, float]]:
    """(path, size, mtime_ms) of scanned files in path order."""
    for entry in sorted(os.scandir(os.path.join(root, below)), key=lambda e: e.name):
        rel = f"{below}/{entry.name}" if below else entry.name
        if entry.is_dir(follow_symlinks=False):
            if not pruned([entry.name]):
                yield from walk(root, rel)
        elif entry.is_file():
            s = entry.stat()
            if wanted(rel, s.st_size):
                yield rel, s.st_size, s.st_mtime_ns / 1e6


def read(root: str, rel: str) -> str:
    with open(os.path.join(root, rel), encoding="utf-8", errors="replace", newline="") as f:
        return f.read()


class Part(InputPartition):
    """Some files: (path, size, mtime_ms)."""

    def __init__(self, files: list[tuple[str, int, float]]):
        super().__init__(len(files))
        self.files = files


def packed(files: Iterator[tuple[str, int, float]]) -> list[Part]:
    """Files in path order, dealt to partitions of bounded size; a folder of any size makes as many as it needs."""
    parts, held, size = [], [], 0
    for f in files:
        held.append(f)
        size += f[1]
        if size >= PART_BYTES or len(held) >= PART_FILES:
            parts.append(Part(held))
            held, size = [], 0
    return parts + [Part(held)] if held or not parts else parts


def rows_of(root: str, part: Part, content: bool) -> Iterator[tuple]:
    for rel, size, ms in part.files:
        try:
            yield rel, size, ms, read(root, rel) if content else None
        except FileNotFoundError:  # gone since it was listed
            pass


class Reader(DataSourceReader):
    """Names are listed once, by the driver; contents are read by the tasks."""

    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content

    def partitions(self) -> list[Part]:
        return packed(walk(self.root))

    def read(self, part: Part) -> Iterator[tuple]:
        return rows_of(self.root, part, self.content)


class Changes(DataSourceStreamReader):
    """Files whose time lies in (start, end]; offsets are epoch milliseconds, so a replay gives the same files."""

    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return packed(f for f in walk(self.root) if start["ms"] < f[2] <= end["ms"])

    def read(self, part: Part) -> Iterator[tuple]:
        return rows_of(self.root, part, self.content)


class Workspace(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return fixed.SNAPSHOT

    def _content(self) -> bool:
        return self.options.get("content", "true").lower() != "false"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._content())

    def streamReader(self, schema) -> Changes:
        return Changes(self.options["path"], self._content())


def register(spark) -> None:
    """Make the source known; workers import this package by the driver's own path to it."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shown = spark.sparkContext.environment
    if home not in shown.get("PYTHONPATH", "").split(os.pathsep):
        shown["PYTHONPATH"] = os.pathsep.join(p for p in (home, shown.get("PYTHONPATH")) if p)
    spark.dataSource.register(Workspace)


def with_content(rows: DataFrame, root: str) -> DataFrame:
    """(path, content) of listed files (path), read by the tasks; files that have gone are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                if os.path.isfile(os.path.join(root, path)):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([read(root, path)])], ["path", "content"])

    return rows.select("path").mapInArrow(run, "path string, content string")


def git_changes(root: str, extensions: list[str] | None = None) -> list[str]:
    """Staged, unstaged and untracked files that exist and have a scanned extension."""
    out: set[str] = set()
    for args in (["diff", "--name-only"], ["diff", "--name-only", "--cached"], ["ls-files", "--others", "--exclude-standard"]):
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        out |= set(got.stdout.split("\n")) if got.returncode == 0 else set()
    exts = tuple(f".{e}" for e in (extensions or fixed.SCANNED))
    return sorted(p for p in out if p.endswith(exts) and os.path.isfile(os.path.join(root, p)))
