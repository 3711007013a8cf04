"""The graph on disk: versions of bucketed Parquet tables on any Hadoop file system, and JSON import and export.

Rows of a table lie in buckets by the file that they come from, a bounded number of files to a bucket however large the
tree is. A version is a folder with a manifest: for every table, which data folder holds each of its buckets. A change
writes the buckets it touches and a manifest that names the others' old folders, so what an edit writes does not grow
with the tree. Data folders are never written to again.

A version's folder is made under another name and renamed to the next number, whole. The first rename to a number makes
it; a later one lands inside that folder and has lost: its writer gets ``Conflict`` and has to start from the newer
version. Readers take the newest version and see it whole. (On stores without a rename, only one writer may work.)
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schema

#: ``parsed_*`` hold every file's own version of an id, ``nodes`` and ``edges`` one row per id, ``tokens`` the search index, ``asks`` the names and ids that edges ask for. The second: what a bucket is kept sorted by.
TABLES: dict[str, str | None] = {"files": None, "parsed_nodes": None, "parsed_edges": None, "nodes": None, "edges": None, "tokens": "token", "asks": "ask"}
MANIFEST = "manifest.json"
#: Files of a bucket, about; seconds that data which no kept version names stays for readers and other writers.
FILES, GRACE_S = 256, 3600.0


class Conflict(Exception):
    """Another writer has made the next version."""


def camel(name: str) -> str:
    if name == "mtime_ms":
        return "lastModified"
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def home(id_: str) -> Column:
    """The file that an id names, else the id itself: what its bucket is taken from."""
    return F.regexp_replace(F.substring_index(id_, "#", 1), "^file:", "")


#: What the bucket of a table's rows is taken from.
KEYS = {"files": F.col, "parsed_nodes": F.col, "parsed_edges": F.col, "nodes": home, "tokens": home, "edges": home, "asks": home}
KEY_COLUMNS = {"files": "path", "parsed_nodes": "file_path", "parsed_edges": "file_path", "nodes": "id", "tokens": "id", "edges": "source_id", "asks": "source_id"}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def _names(self, where: str) -> list[str]:
        at = self._path(where)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self) -> list[tuple[int, str, bool]]:
        """(number, folder, complete) in rising order."""
        found = sorted((int(m.group(1)), n) for n in self._names(self.root) if (m := re.fullmatch(r"v(\d+)(?:-\w+)?", n)))
        return [(k, n, self._fs.exists(self._path(f"{self.root}/{n}/{MANIFEST}"))) for k, n in found]

    def version(self) -> str | None:
        return next((n for _, n, done in reversed(self._versions()) if done), None)

    def manifest(self, version: str | None = None) -> dict | None:
        """{number, buckets, schemas: {table: DDL}, data: {table: {bucket: folder}}} of a version, the newest unless named."""
        version = version or self.version()
        return version and json.loads(self.spark.read.text(f"{self.root}/{version}/{MANIFEST}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> str:
        mine, name = uuid.uuid4().hex, f"v{manifest['number']:015d}"
        at, target = f"{self.root}/.new-{mine}", f"{self.root}/{name}"
        if self._fs.exists(self._path(target)):
            raise Conflict(name)
        for file, text in ((MANIFEST, json.dumps(manifest)), (f"by-{mine}", "")):
            out = self._fs.create(self._path(f"{at}/{file}"), True)
            out.write(bytearray(text.encode()))
            out.close()
        try:
            self._fs.rename(self._path(at), self._path(target))
        except Exception:  # some file systems refuse, others move it into the folder
            pass
        if not self._fs.exists(self._path(f"{target}/by-{mine}")):
            for left in (at, f"{target}/.new-{mine}"):
                self._fs.delete(self._path(left), True)
            raise Conflict(name)
        self._clean()
        return name

    def _clean(self) -> None:
        """Keep the newest version and the complete one before it, and the data that they name."""
        versions = self._versions()
        keep = [n for _, n, done in versions if done][-2:]
        for _, name, _ in versions:
            if name not in keep:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
        named = [self.manifest(n)["data"] for n in keep if self._fs.exists(self._path(f"{self.root}/{n}/{MANIFEST}"))]
        for t in self._names(f"{self.root}/data"):
            used = {folder for data in named for folder in data.get(t, {}).values()}
            for folder in self._names(f"{self.root}/data/{t}"):
                at = self._path(f"{self.root}/data/{t}/{folder}")
                if folder not in used and time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 > GRACE_S:
                    self._fs.delete(at, True)

    # reading

    def table(self, manifest: dict, t: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version's table, of the given buckets alone or of all."""
        data = manifest["data"][t]
        paths = [f"{self.root}/data/{t}/{folder}/bucket={k}" for k, folder in data.items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(manifest["schemas"][t]).parquet(*paths) if paths else self.spark.createDataFrame([], manifest["schemas"][t])

    def load(self) -> dict[str, DataFrame] | None:
        found = self.manifest()
        return found and {t: self.table(found, t) for t in found["data"]}

    # writing

    def bucket(self, t: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(KEYS[t](KEY_COLUMNS[t])), F.lit(buckets)).cast("int")

    def _write(self, t: str, rows: DataFrame, buckets: int) -> dict[str, str]:
        """{bucket: folder} of rows written anew."""
        folder, order = uuid.uuid4().hex, [c for c in ("bucket", TABLES[t]) if c]
        at = f"{self.root}/data/{t}/{folder}"
        rows.withColumn("bucket", self.bucket(t, buckets)).repartition("bucket").sortWithinPartitions(*order).write.partitionBy("bucket").parquet(at)
        return {m.group(1): folder for n in self._names(at) if (m := re.fullmatch(r"bucket=(\d+)", n))}

    def save(self, tables: dict[str, DataFrame]) -> str:
        """A new version of all tables; it does not rest on the one before, so it takes the next free number."""
        buckets = max(1, -(-tables["files"].count() // FILES))
        schemas = {t: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables[t].schema) for t in tables}
        manifest = {"buckets": buckets, "schemas": schemas, "data": {t: self._write(t, tables[t], buckets) for t in tables}}
        while True:
            try:
                return self._commit({**manifest, "number": max((k for k, _, _ in self._versions()), default=0) + 1})
            except Conflict:
                continue

    def change(self, manifest: dict, tables: dict[str, tuple[DataFrame, list[int]]]) -> str:
        """The version after ``manifest``: of each table all rows of the buckets listed with it; other buckets stay. ``Conflict`` if there is one already."""
        data = {t: dict(folders) for t, folders in manifest["data"].items()}
        for t, (rows, touched) in tables.items():
            data[t] = {k: f for k, f in data[t].items() if int(k) not in set(touched)} | self._write(t, rows, manifest["buckets"])
        newest = max(k for k, _, _ in self._versions())
        if self.version() != f"v{manifest['number']:015d}":
            raise Conflict(self.version())
        return self._commit({**manifest, "data": data, "number": newest + 1})

    def export_json(self, path: str) -> None:
        """One JSON object in a local file: files by path, nodes and edges in order. Rows pass the driver one partition at a time."""
        got = self.load() or {}
        shown = {"files": schema.FILE, "nodes": schema.NODE, "edges": schema.EDGE}

        def rows(t: str):
            if t in got:
                names = [c.split()[0] for c in shown[t].split(", ") if c.split()[0] in got[t].columns and not c.endswith(("_ord long", "_ord int"))]
                df = got[t].orderBy("path" if t == "files" else "ord").select([F.col(c).alias(camel(c)) for c in names])
                yield from (json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).toLocalIterator())

        with open(f"{path}.part", "w", encoding="utf-8") as f:
            f.write(f'{{"version": 1, "lastUpdated": {int(time.time() * 1000)}, "files": {{')
            for i, r in enumerate(rows("files")):
                f.write(f"{', ' if i else ''}{json.dumps(r['path'])}: {json.dumps(r)}")
            for t in ("nodes", "edges"):
                f.write(f'{"}" if t == "nodes" else "]"}, "{t}": [')
                for i, r in enumerate(rows(t)):
                    if r.get("metadata"):
                        r["metadata"] = json.loads(r["metadata"])
                    f.write(f"{', ' if i else ''}{json.dumps(r)}")
            f.write("]}")
        os.replace(f"{path}.part", path)


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """files, nodes and edges of an exported graph; ``ord`` is the place in the file. Later rows of an id replace earlier ones."""
    types = {"node": schema.NODE, "edge": schema.EDGE, "file": schema.FILE}
    shape = lambda k: "struct<" + ", ".join(f"{camel(c.split()[0])}: {c.split()[1]}" for c in types[k].split(", ")) + ">"
    raw = spark.read.schema(f"files map<string, {shape('file')}>, nodes array<{shape('node')}>, edges array<{shape('edge')}>").json(path, multiLine=True)

    def rows(t: str, kind: str) -> DataFrame:
        names = [c.split()[0] for c in types[kind].split(", ") if c.split()[0] not in ("file_ord", "emit_ord")]
        at: Column = F.posexplode(t)
        return raw.select(at.alias("emit_ord", "r")).select(*[F.col(f"r.{camel(c)}").alias(c) for c in names], F.lit("").alias("file_ord"), "emit_ord")

    files = raw.select(F.explode("files").alias("path", "r")).select("path", *[F.col(f"r.{camel(c)}").alias(c) for c in [x.split()[0] for x in types["file"].split(", ")][1:]])
    return {"files": files, "nodes": rows("nodes", "node"), "edges": rows("edges", "edge")}
