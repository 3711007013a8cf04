"""Change feed: files that changed are parsed and applied by micro-batch; debounce by session window."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, key: str, ts: str, item: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, n, items): closed bursts of a stream of events; later ones than ``late`` are dropped."""
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(item).alias("item")).withWatermark("ts", late)
    out = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("item")).alias("items"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "items")


def watch(engine, checkpoint_dir: str, interval: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Refresh the engine's graph when its tree changes; every trigger also applies deletions (self-healing).

    A refresh compares hashes, so a replayed batch changes nothing: the sink is idempotent.
    """
    stream = engine.spark.readStream.format("workspace").option("content", "false").load(engine.root)  # names only: a refresh reads what has changed

    def apply(batch: DataFrame, _: int) -> None:
        engine.refresh(quick=True)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def git_head(root: str) -> str | None:
    """The commit that a tree's HEAD names; a detached HEAD is its own commit."""
    at = os.path.join(root, ".git", "HEAD")
    if not os.path.isfile(at):
        return None
    with open(at, encoding="utf-8") as f:
        head = f.read().strip()
    if not head.startswith("ref: "):
        return head
    ref = os.path.join(root, ".git", head[5:])
    if os.path.isfile(ref):
        with open(ref, encoding="utf-8") as f:
            return f"{head} {f.read().strip()}"
    return head


class HeadWatcher:
    """Refreshes a whole graph when its tree's HEAD moves: a checkout may change many files at once, with any times."""

    def __init__(self, engine):
        self.engine, self.head = engine, git_head(engine.root)

    def check(self) -> bool:
        now = git_head(self.engine.root)
        if now == self.head:
            return False
        self.engine.refresh()
        self.head = now
        return True


def watch_all(manager, folder: str, interval: str = "60 seconds") -> dict[str, StreamingQuery]:
    """One refreshing query for every registered workspace, by its id."""
    return {w["id"]: watch(manager.engine(w["id"]), os.path.join(folder, w["id"]), interval) for w in manager.registry.list()}


def supervise(queries: dict[str, StreamingQuery], restart, pause: float = 5.0, rounds: int | None = None) -> int:
    """Start queries that have failed anew, by ``restart(id)``; how many were. Ends after ``rounds`` or when all have been stopped."""
    again = 0
    while rounds is None or rounds > 0:
        for key, q in list(queries.items()):
            if not q.isActive and q.exception() is not None:
                queries[key] = restart(key)
                again += 1
        if not any(q.isActive for q in queries.values()):
            break
        rounds = None if rounds is None else rounds - 1
        time.sleep(pause if rounds is None or rounds else 0)
    return again


def status(query: StreamingQuery) -> dict:
    last = query.lastProgress
    return {"active": query.isActive, "pending": bool(query.status.get("isDataAvailable")), "rows": last["numInputRows"] if last else 0}
