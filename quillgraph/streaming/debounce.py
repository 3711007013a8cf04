"""Trailing debounce with timers: a burst of events comes out once it has been quiet, also the last one of a key.

The open bursts of a key are its state. Events widen a burst, join two of them or begin one, in any order of arrival. A
burst is closed by events of its key that are later by more than gap and lateness, else by a timer: ``wait`` after the
key's last arrival in processing time, so no later event is needed. The state can be read while the query runs or
stands still: it is the queue of what waits. (Timers need Spark's RocksDB state store, which ``enable`` sets.)

Defined results: events without a key or time are left out; repeated events count, their items once; events behind a
closed burst are a burst of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Up to CHUNK bursts of a key are one row of its state and of what comes out, as a JSON text of these columns: a value for each burst costs more to pass between Python and Spark than the work on it.
BURSTS = "start array<long>, end array<long>, n array<long>, items array<array<string>>"
CHUNK = 1000
STATE = "bursts string"
OUT = "key string, bursts string"


def enable(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged(bursts: list[tuple[int, int, int, set[str]]], gap: int) -> list[tuple[int, int, int, set[str]]]:
    """Bursts in order, those no more than ``gap`` apart joined."""
    out: list[tuple[int, int, int, set[str]]] = []
    for start, end, n, items in sorted(bursts, key=lambda b: b[:3]):
        if out and start - out[-1][1] <= gap:
            first, last, before, known = out[-1]
            out[-1] = (first, max(last, end), before + n, known | items)
        else:
            out.append((start, end, n, items))
    return out


def bursts_of(ts: np.ndarray, items: np.ndarray, gap: int) -> list[tuple[int, int, int, set[str]]]:
    """The bursts of a key's events, in any order."""
    order = np.argsort(ts, kind="stable")
    ts, items = ts[order], items[order].tolist()
    cuts = np.flatnonzero(np.diff(ts) > gap) + 1
    first, end = [0, *cuts.tolist()], [*cuts.tolist(), len(items)]
    times = ts.tolist()
    return [(times[a], times[b - 1], b - a, {i for i in items[a:b] if i is not None}) for a, b in zip(first, end, strict=True)]


def packed(bursts: list[tuple[int, int, int, set[str]]]) -> Iterator[str]:
    """Bursts as texts of up to CHUNK."""
    for at in range(0, len(bursts), CHUNK):
        some = bursts[at : at + CHUNK]
        yield json.dumps({"start": [b[0] for b in some], "end": [b[1] for b in some], "n": [b[2] for b in some], "items": [sorted(b[3]) for b in some]})


def _apart(rows: DataFrame) -> DataFrame:
    """(key, start, end, n, items) of rows (key, bursts)."""
    columns = F.from_json("bursts", BURSTS)
    b = F.col("b")
    each = rows.select("key", columns.alias("c")).select("key", F.explode(F.arrays_zip("c.start", "c.end", "c.n", "c.items")).alias("b"))
    return each.select("key", F.timestamp_micros(b["start"]).alias("start"), F.timestamp_micros(b["end"]).alias("end"), b["n"].alias("n"), b["items"].alias("items"))


class Debounce(StatefulProcessor):
    """Times in microseconds; ``wait`` in milliseconds of processing time."""

    def __init__(self, gap: int, late: int, wait: int):
        self.gap, self.late, self.wait = gap, late, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [json.loads(text) for (text,) in self.open.get()]
        bursts = [(s, e, n, set(i)) for c in waiting for s, e, n, i in zip(c["start"], c["end"], c["n"], c["items"], strict=True)]
        for frame in rows:  # one frame in work at a time; what stays are its bursts
            items = frame["item"].astype(object)
            bursts = merged(bursts + bursts_of(frame["ts"].to_numpy(np.int64), items.where(items.notna(), None).to_numpy(), self.gap), self.gap)
        newest = bursts[-1][1]
        done = [b for b in bursts if b[1] + self.gap + self.late < newest]
        self.open.put([(text,) for text in packed(bursts[len(done) :])])
        if waiting:  # a key has a timer as long as a burst of it waits
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        if done:
            yield pd.DataFrame([(key[0], text) for text in packed(done)], columns=["key", "bursts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [(key[0], text) for (text,) in self.open.get()]
        self.open.clear()
        yield pd.DataFrame(waiting, columns=["key", "bursts"])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, ts: str, item: str, gap: str = "500 milliseconds", late: str = "0 seconds", wait_ms: int = 500) -> DataFrame:
    """(key, start, end, n, items) of every burst of a stream of events, each once."""
    enable(events.sparkSession)
    micros = lambda text: int(pd.Timedelta(text) / pd.Timedelta(microseconds=1))
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(item).cast("string").alias("item")).where("key is not null and ts is not null")
    return _apart(rows.groupBy("key").transformWithStateInPandas(Debounce(micros(gap), micros(late), wait_ms), OUT, "Append", "ProcessingTime"))


def pending(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """(key, start, end, n, items) of the bursts that still wait, from the state of a ``debounced`` query."""
    enable(spark)
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint_dir)
    return _apart(state.select(F.col("key.key").alias("key"), F.col("list_element")["bursts"].alias("bursts")))
