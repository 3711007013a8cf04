"""The bucketed store: what an edit writes, refreshes against full indexes, writers at once."""

import os
import random
import threading
import time

import pytest

from quillgraph.engine import Engine
from quillgraph.sources import store
from quillgraph.sources.store import Conflict, Store


def rows(e):
    return {t: sorted(map(str, e.tables[t].drop("mtime_ms").collect())) for t in store.TABLES}


def edit(path, text, later):
    path.write_text(text)
    os.utime(path, (time.time() + later,) * 2)


def data_files(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{root}/data") for f in files if f.startswith("part-")}


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(store, "FILES", 4)


def test_an_edit_writes_its_buckets_alone(spark, tmp_path, small_buckets):
    wrote = {}
    for n in (16, 80):
        root = tmp_path / f"w{n}"
        root.mkdir()
        for i in range(n):
            (root / f"f{i}.py").write_text("".join(f"def own_{i}_{k}():\n    return own_{(i + 1) % n}_{k}()\n\n" for k in range(8)))
        e = Engine(spark, str(root), str(tmp_path / f"s{n}"))
        e.index()
        assert e.store.manifest()["buckets"] == n // 4
        before = data_files(tmp_path / f"s{n}")
        edit(root / "f3.py", "def own_3_0():\n    return own_4_1()\n\ndef added():\n    return own_3_0()\n", 9)
        assert e.refresh(quick=True) == {"insert": 0, "update": 1, "delete": 0}
        wrote[n] = sum(size for f, size in data_files(tmp_path / f"s{n}").items() if f not in before)
        assert e.search("added")[0]["name"] == "added" and e.nodes.where("name = 'own_3_1'").count() == 0
        assert e.edges.where("target_id = 'sym:own_3_1'").count() == 1  # the caller in another file has lost its target
    assert wrote[80] < 1.5 * wrote[16]


def test_random_edits_equal_a_full_index(spark, tmp_path, small_buckets):
    rng = random.Random(8)
    names = [f"name{k}" for k in range(7)]

    def source():
        return "".join(f"def {rng.choice(names)}():\n    return {rng.choice(names)}({rng.choice(names)}())\n\n" for _ in range(rng.randint(1, 4))) + f"@app.get('/r{rng.randrange(3)}')\ndef route_{rng.randrange(3)}():\n    pass\n"

    root = tmp_path / "w"
    root.mkdir()
    for i in range(14):
        (root / f"f{i}.py").write_text(source())
    e = Engine(spark, str(root), str(tmp_path / "s"))
    e.index()
    for turn in range(1, 3):
        for i in rng.sample(range(14), 3):
            at = root / f"f{i}.py"
            if at.exists() and rng.random() < 0.3:
                at.unlink()
            else:
                edit(at, source(), 9 * turn)
        (root / f"new{turn}.py").write_text(source())
        e.refresh(quick=True)
    part = rows(e)
    e.index()
    assert part == rows(e)


def test_two_writers_lose_nothing(spark, tmp_path, small_buckets, monkeypatch):
    root = tmp_path / "w"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return two()\n")
    (root / "b.py").write_text("def two():\n    return 1\n")
    first, second = (Engine(spark, str(root), str(tmp_path / "s")) for _ in range(2))
    first.index()
    edit(root / "a.py", "def one():\n    return three()\n", 9)
    seen = first._suspects(first.tables["files"]).cache()  # the first writer knows this change alone
    seen.count()
    edit(root / "b.py", "def two():\n    return 1\n\ndef three():\n    return two()\n", 9)
    change, tried = Store.change, []

    def slow(self, manifest, tables):
        tried.append(manifest["number"])
        if len(tried) == 1:  # the second writer's refresh happens while the first writes
            assert second.refresh() == {"insert": 0, "update": 2, "delete": 0}
        return change(self, manifest, tables)

    monkeypatch.setattr(Store, "change", slow)
    assert first.refresh(quick=True) == {"insert": 0, "update": 0, "delete": 0}  # nothing is left to do from the newer version
    assert tried == [1, 1] and first.store.manifest()["number"] == 2
    assert {(r.source_id, r.target_id) for r in first.edges.where("kind = 'calls'").collect()} == {("a.py#one", "b.py#three"), ("b.py#three", "b.py#two")}


def test_one_of_many_commits_wins(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    won, lost = [], []

    def commit(k):
        try:
            won.append(s._commit({"number": 1, "buckets": 1, "by": k, "schemas": {}, "data": {}}))
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=commit, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and s.version() == won[0] and s.manifest()["by"] not in lost
    assert [n for n in os.listdir(tmp_path / "s") if n != won[0]] == []
