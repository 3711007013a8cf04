"""The trailing debounce: all bursts, the last ones without a later event, in any order of arrival; what waits is readable."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from quillgraph.streaming import debounce

SCHEMA = "k string, ts timestamp, item string"


def brute(rows, gap):
    out, last = [], {}
    for k, t, item in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        b = last.get(k)
        if b is None or t - b[2] > gap:
            b = last[k] = [k, t, t, 0, set()]
            out.append(b)
        b[2], b[3] = t, b[3] + 1
        b[4].add(item)
    return sorted((k, s, e, n, tuple(sorted(i))) for k, s, e, n, i in out)


def test_merged_by_definition():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randrange(300) for _ in range(rng.randint(1, 40))]
        bursts, parts = [], [times[i::3] for i in range(3)]
        for part in parts:
            bursts = debounce.merged(bursts + [(t, t, 1, {str(t)}) for t in part], 5)
        assert [("k", s, e, n, tuple(sorted(i))) for s, e, n, i in bursts] == brute([("k", t, str(t)) for t in times], 5)


def test_every_burst_of_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), 1_700_000_000 + rng.randrange(4000), rng.choice(["x", "y", "z"])) for _ in range(150)] + [("once", 1_700_000_000, "q"), (None, 1_700_000_000, "q"), ("a", None, "q")]
    write = lambda some: spark.createDataFrame(some, "k string, t long, item string").select("k", F.timestamp_seconds("t").alias("ts"), "item").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rng.shuffle(rows)
    write(rows[:80])
    out = debounce.debounced(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", "ts", "item", gap="60 seconds", late="1 day", wait_ms=25_000)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    def taken(n):
        until = time.time() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < n and time.time() < until:
            time.sleep(0.3)

    try:
        taken(80)
        assert {r.key for r in debounce.pending(spark, str(tmp_path / "ck")).collect()} >= {"a", "b", "c"}
        write(rows[80:])
        got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
        until = time.time() + 120
        while got.agg(F.sum("n")).first()[0] != 151 and time.time() < until:
            time.sleep(1)
            got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    finally:
        q.stop()
    found = sorted((r.key, r.s, r.e, r.n, tuple(r.items)) for r in got.select("key", F.unix_seconds("start").alias("s"), F.unix_seconds("end").alias("e"), "n", "items").collect())
    assert found == brute(rows, 60)
    assert debounce.pending(spark, str(tmp_path / "ck")).count() == 0


class Handle:
    """A key's state, by hand."""

    def __init__(self):
        self.rows, self.timers, self.asked = [], [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def listTimers(self):
        self.asked += 1
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def test_bursts_pass_to_the_state_and_out_in_chunks(spark):
    """A value for each burst, and a frame where nothing is closed, made a key's work grow far faster than its events'."""
    class Now:
        @staticmethod
        def getCurrentProcessingTimeInMs():
            return 7

    work, handle = debounce.Debounce(5, 10**9, 100), Handle()
    work.init(handle)
    rng = random.Random(2)
    events = [("k", 10 * rng.randrange(2500) + rng.randrange(3), rng.choice(["a", 'b"\n', None])) for _ in range(4000)]
    frames = [pd.DataFrame(events[at : at + 1000], columns=["key", "ts", "item"]) for at in range(0, 4000, 1000)]
    assert list(work.handleInputRows(("k",), iter(frames[:3]), Now)) == [] and handle.asked == 0
    assert list(work.handleInputRows(("k",), iter(frames[3:]), Now)) == [] and handle.asked == 1 and handle.timers == [107]
    want = [(s, e, n, tuple(sorted(x for x in i if x))) for _, s, e, n, i in brute([(k, t, i or "") for k, t, i in events], 5)]
    assert len(handle.rows) == -(-len(want) // debounce.CHUNK) < len(want) / 100
    out = list(work.handleExpiredTimer(("k",), Now, None))
    assert len(out) == 1 and len(out[0]) == -(-len(want) // debounce.CHUNK) and handle.rows == []
    got = debounce._apart(spark.createDataFrame(out[0])).select("key", F.unix_micros("start"), F.unix_micros("end"), "n", "items").collect()
    assert sorted((s, e, n, tuple(i)) for k, s, e, n, i in got) == want
