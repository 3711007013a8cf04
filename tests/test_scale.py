"""What keeps a query's work spread and bounded as its tables grow."""

import random

import pytest

from quillgraph import parse
from quillgraph.operators import metrics, resolve
from quillgraph.parse import lexer
from quillgraph.plans import code, registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["parse_programs", "parse_edges", "markdown_sections", "parse_symbols"])
def test_parsers_get_spread_rows_and_give_only_what_is_asked(spark, sf, name):
    """A small table is one file and one task; its rows are dealt to all cores before the parsers, whose rows hold no snippets."""
    shown = plan(registry.QUERIES[name](spark, sf))
    assert "RoundRobinPartitioning" in shown and "snippet" not in shown
    assert shown.count("MapInArrow") == 1  # nodes and edges come from the same run


def test_programs_are_not_shuffled_once_parsed(spark, sf, tmp_path):
    """Only the keys are dealt out; what is parsed of them is 34 rows a file, and no two files share an id: the same rows as settled by id, repeated keys or not."""
    shown = plan(registry.QUERIES["parse_programs"](spark, sf))
    assert "Exchange" not in shown[: shown.index("MapInArrow")]
    keys = [*range(60), 7, 7, 59]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["parse_programs"](spark, str(tmp_path)).collect()
    nodes, edges = parse.parse_files(code._programs(spark, str(tmp_path)))
    want = nodes.where("kind <> 'file'").select("file_path", "kind", "name", "start_line", "end_line").collect()
    want += edges.selectExpr("file_path", "kind", "target_name", "line", "0").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r[0] for r in got}) == 120


def test_plain_script_is_cut_by_one_call(monkeypatch):
    """Tokens cost no call of the pattern each: one call cuts all up to a template, a "/" or an element."""
    calls = []

    class Counted:
        def findall(self, *args):
            calls.append(1)
            return pattern.findall(*args)

    pattern = lexer._WORDS[False]
    monkeypatch.setitem(lexer._WORDS, False, Counted())
    got = lexer.Lexer("const a = b(c, 'd'); // no(1)\n" * 500 + "e = /f/.g(h)\n", False)
    assert len(calls) == 2 and len(got.kinds) == 500 * 10 + 8 and got.kinds[-6] == "regex" and got.numbers[-1] == 500


def test_cut_at_once_or_token_by_token(monkeypatch):
    """A long text is cut token by token until its rest is short: both ways give the same tokens."""
    rng = random.Random(5)
    bits = ["`", "${", "}", "{", "(", ")", "/", "//", "/*", "*/", "'", '"', "\\", "<", "<a", "</a>", "/>", "\n", " ", "#", "#!x\n", "é", "٣", ".5", "...", "?.", "=>", "return ", "a", "_b", "7", "<T,>", "\u2028"]
    for _ in range(2000):
        text, jsx = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), rng.random() < 0.5
        ways = [lexer.Lexer(text, jsx, near) for near in (lexer.NEAR, 0, 12)]
        assert len({str((x.kinds, x.texts, sorted(x.fresh), x.pair, x.starts, x.numbers)) for x in ways}) == 1, text
        whole = ways[1]
        for at, word in zip(whole.ats, whole.texts, strict=True):
            assert word in ("[", "]", ",") or text.startswith(word, at)


def test_sql_files_are_parsed_once(spark, sf, monkeypatch):
    from quillgraph.functions import frames

    kept = []
    monkeypatch.setattr(frames, "checkpoint", lambda df, real=frames.checkpoint: (kept.append(plan(df)), real(df))[1])
    shown = plan(registry.QUERIES["sql_ddl"](spark, sf))
    assert "MapInArrow" not in shown and len(kept) == 1 and "RoundRobinPartitioning" in kept[0] and "snippet" not in kept[0]


def test_pagerank_rounds_hold_only_nodes_with_links_to_them(spark, monkeypatch):
    sizes = []

    def checkpoint(df, real=metrics.checkpoint):
        out = real(df)
        if "powers" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(metrics, "checkpoint", checkpoint)
    nodes = spark.range(1000).selectExpr("'n' || id AS id")
    pairs = [(f"n{k}", "n0") for k in range(1, 999)] + [("n0", "n1"), ("n0", "n1"), ("n1", "nowhere"), ("gone", "n1")]
    edges = spark.createDataFrame(pairs, "source_id string, target_id string")
    got = dict(map(tuple, metrics.pagerank(nodes, edges).collect()))
    assert sizes and max(sizes) == 2
    one = dict(map(tuple, metrics.pagerank(nodes, edges, 10**6).collect()))  # the one-task form is another implementation
    assert got.keys() == one.keys() and all(abs(got[k] - one[k]) < 1e-12 for k in one)
    assert sum(got.values()) == pytest.approx(1)
    line = spark.createDataFrame([("n1", "n2"), ("n2", "n3")], "source_id string, target_id string")  # ranks stop moving before the last round
    got, one = (dict(map(tuple, metrics.pagerank(nodes, line, n).collect())) for n in (0, 10**6))
    assert all(abs(got[k] - one[k]) < 1e-12 for k in one)


def test_hubs_count_degrees_of_candidates_only(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(metrics, "degrees", lambda nodes, *rest, real=metrics.degrees: (asked.append(nodes.count()), real(nodes, *rest))[1])
    nodes = spark.range(1000).selectExpr("'n' || id AS id", "'x' AS name", "'class' AS kind", "'p' AS file_path", "id AS ord")
    edges = spark.createDataFrame([(f"n{k}", f"n{k % 20}") for k in range(20, 1000)], "source_id string, target_id string")
    assert metrics.god_nodes(nodes, edges).count() == 10 and asked == [20]


def test_integrity_counts_ends_before_they_are_joined(spark, monkeypatch):
    looked_up = []
    monkeypatch.setattr(metrics, "checkpoint", lambda df, real=metrics.checkpoint: (looked_up.append(df), real(df))[1])
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    pairs = [("a", "b"), ("a", "a"), ("a", "sym:x"), ("gone", "sym:x"), ("gone", "lost"), ("gone", "b"), ("a", "lost"), (None, "lost"), (None, "b"), ("a", None), ("gone", None)]
    got = metrics.diagnose(nodes, spark.createDataFrame(pairs, "source_id string, target_id string")).first()
    assert tuple(got) == (7, 2, 1, 11)  # (a, null) is neither broken nor outside
    assert len(looked_up) == 1


def test_text_index_shuffles_counts_and_keeps_shared_ids_apart(spark, tmp_path):
    rows = [(1, "red fish red"), (2, "red"), (2, "red bird"), (None, "bird"), (None, "bird"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, registry.QUERIES["text_index"](spark, str(tmp_path)).collect())) == [("bird", 2), ("fish", 1), ("red", 2)]
    spark.createDataFrame(rows[:2], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert "doc_id" not in [x for x in plan(registry.QUERIES["text_index"](spark, f"{tmp_path}/b")).splitlines() if "Exchange" in x][0]


def test_references_are_answered_once_and_edges_not_moved_for_few_answers(spark, monkeypatch):
    rng, old = random.Random(3), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    nodes = [(f"n{k}", rng.choice(["Run", "run", "load", "one", None]) if k else "Single", rng.choice(["file", "function", "class"]) if k else "class", rng.choice(["a", "b", "c", None]), k) for k in range(40)]
    targets = ["sym:RUN", "sym:run", "sym:load", "sym:single", "sym:none", "sym:", "pkg:run", "crate:x", "file:a", "n3", "n4", "x#load", "run", "lost", None]
    edges = [(f"e{k}", rng.choice(targets), rng.choice(["load", None, None]), rng.choice(["a", "b", None]), rng.choice(["given", None])) for k in range(400)]
    want, ids = [], {n[0] for n in nodes}
    for e, t, name, path, sure in edges:
        ask = None
        if t is not None and not t.startswith(("pkg:", "crate:", "file:")):
            ask = t[4:] if t.startswith("sym:") else None if t in ids else name or (t.split("#") + [t])[1]
        if ask is not None:
            same = [n for n in nodes if n[1] and n[1].lower() == ask.lower() and n[2] != "file"]
            own = [n for n in same if n[3] == path and path is not None]
            t = (same if len(same) == 1 else own or same)[0][0] if same else f"sym:{ask}"
            sure = ("exact" if len(same) == 1 or own else "heuristic") if same else sure
        want.append((e, t, sure))
    n = spark.createDataFrame(nodes, "id string, name string, kind string, file_path string, ord long")
    e = spark.createDataFrame(edges, "id string, target_id string, target_name string, file_path string, confidence string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all were large
    try:
        out = resolve.resolve(n, e)
        assert "SortMergeJoin" not in plan(out) and "Exchange hashpartitioning" not in plan(out)
        assert sorted(map(tuple, out.select("id", "target_id", "confidence").collect())) == sorted(want)
        monkeypatch.setattr(resolve, "BROADCAST_ANSWERS", 0)
        out = resolve.resolve(n, e)
        assert plan(out).count("SortMergeJoin") == 1
        assert sorted(map(tuple, out.select("id", "target_id", "confidence").collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
