"""Readers on small files, and the finding stream."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import text as X
from graphloom.operators import evaluate
from graphloom.sources import files as S
from graphloom.sources import graph as G
from graphloom.sources import scanners as C
from graphloom.streaming import findings

from .oracle import connect, expected, rows


def put(path, value, bom=False):
    path.write_text(("﻿" if bom else "") + (value if isinstance(value, str) else json.dumps(value)), encoding="utf-8")
    return str(path)


def test_graph_file(spark, tmp_path):
    p = put(tmp_path / "g.json", {"nodes": [{"id": "a", "label": "a()"}, {"id": "b"}, {"id": "a", "label": "new()"}], "links": [{"source": "a", "target": "b", "relation": "calls"}], "edges": []}, bom=True)
    g = G.read_graph(spark, p)
    assert {r.id: r.label for r in g.nodes.collect()} == {"a": "new()", "b": None}
    assert [(r.source, r.edge_pos) for r in g.edges.collect()] == [("a", 0)]
    assert G.readable(spark, p) and not G.readable(spark, put(tmp_path / "x.json", "{nope")) and not G.readable(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        G.read_graph(spark, str(tmp_path / "x.json"))
    e = put(tmp_path / "e.json", {"nodes": [{"id": "a"}]})
    assert G.read_graph(spark, e).edges.count() == 0


def test_manifest_findings_report(spark, tmp_path):
    m = put(tmp_path / "m.json", {"a.py": {"ast_hash": "1", "hash": "2"}, "b.py": {"hash": "3"}, "c.py": {}})
    assert {r.path: r.md5 for r in G.read_manifest(spark, m).collect()} == {"a.py": "1", "b.py": "3", "c.py": ""}
    f = put(tmp_path / "f.json", {"edges": [{"relation": "taints", "source_ref": {"file": "a.py", "line": 3}, "target_ref": {"node": "x"}}]})
    assert G.read_findings(spark, f).first().source_ref.line == 3
    for body in ([{"id": "V1", "file": "a.py", "line": 2}], {"vulns": [{"id": "V1", "file": "a.py", "line": 2}]}):
        assert G.read_report(spark, put(tmp_path / "r.json", body)).first().query_id == "V1"


def test_semgrep_classes_and_locations(spark, tmp_path):
    at = {"path": "s.py", "start": {"line": 7}}
    results = [
        {"check_id": "r.Trace", "path": "a.py", "start": {"line": 1}, "extra": {"severity": "ERROR", "dataflow_trace": {"taint_source": shape}}}
        for shape in ([at, "x"], at, {"location": at})
    ] + [{"check_id": "py.SQL-injection", "path": "a.py", "start": {"line": 2}, "extra": {"severity": "WARNING"}}, {"check_id": "style", "path": "a.py", "start": {"line": 3}, "extra": {"severity": "INFO"}}]
    df = C.read_semgrep(spark, put(tmp_path / "s.json", {"results": results}))
    found, skipped = C.semgrep_findings(df, ("sql-inj",))
    rows = found.orderBy("pos").collect()
    assert [r.relation for r in rows] == ["taints", "reaches_sink"] * 3 + ["reaches_sink"]
    assert all(r.source_ref.line == 7 and r.source_ref.file == "s.py" for r in rows[:6]) and rows[6].source_ref.line == 2
    assert rows[6].confidence_score == pytest.approx(0.72) and [r.check_id for r in skipped.collect()] == ["style"]


def test_flows(spark, tmp_path):
    flow = {"rule": "r", "path": [{"file": "a", "line": 1}, {"file": "a", "line": -1}, {"file": "b", "line": 2}, {"file": "c", "line": 3}]}
    raw = {"elements": [{"location": {"filename": "a", "lineNumber": {"value": 4}}}, {"location": {"filename": "b", "lineNumber": 5}}]}
    out = C.flow_findings(C.read_flows(spark, put(tmp_path / "f.json", {"flows": [flow, raw, {"path": [{"file": "z", "line": 1}]}]}))).collect()
    pairs = sorted((r.relation, r.source_ref.line, r.target_ref.line, r.skip_self) for r in out)
    assert pairs == [("reaches_sink", 1, 3, False), ("reaches_sink", 4, 5, False), ("taints", 1, 2, True), ("taints", 1, 3, False), ("taints", 2, 3, True), ("taints", 4, 5, False), ("taints", 4, 5, True)]


def test_coverage_and_runs(spark, tmp_path):
    cov = {"files": {"src/a.py": {"contexts": {"3": ["tests/t.py::T::test_x[1]|run", ""], "x": ["q"]}}, "tests/t.py": {"contexts": {"1": ["z|run"]}}}}
    rows = C.read_coverage(spark, put(tmp_path / "c.json", cov))
    assert [(r.file, r.line, r.test) for r in rows.collect()] == [("src/a.py", 3, "tests/t.py::T::test_x[1]")]
    assert C.coverage_findings(rows).first().source_ref.node == "test_x"
    log = put(tmp_path / "p.txt", "PASSED a::b\nnoise\nFAILED c::d - boom\n")
    assert {r.test: r.status for r in C.read_pytest(spark, log).collect()} == {"a::b": "PASSED", "c::d": "FAILED"}
    mocha = put(tmp_path / "mo.json", {"passes": [{"fullTitle": "p"}], "failures": [], "pending": [{"fullTitle": "q"}]})
    assert {r.test: r.status for r in C.read_mocha(spark, mocha).collect()} == {"p": "PASSED", "q": "SKIPPED"}


def test_source_tree(spark, tmp_path):
    (tmp_path / "t/.git").mkdir(parents=True)
    put(tmp_path / "t/a.py", 'import os\nx = os.environ["HOME_DIR"]\ny = os.getenv("lower")\nq = "select 1 from Users join orders"\n')
    put(tmp_path / "t/b.js", "const a = process.env.PORT; const b = process.env['HOST_NAME']\n")
    put(tmp_path / "t/.env", "export PORT=1\n# c\nHOST_NAME: x\n")
    put(tmp_path / "t/.git/c.py", 'os.getenv("SKIPPED")\n')
    files = S.scan(spark, str(tmp_path / "t"))
    assert {r.file for r in files.collect()} == {"a.py", "b.js", ".env"}
    assert {(r.file, r.key) for r in S.env_reads(files).collect()} == {("a.py", "HOME_DIR"), ("b.js", "PORT"), ("b.js", "HOST_NAME")}
    assert ("a.py", "lower") in {(r.file, r.key) for r in S.env_reads(files, any_case=True).collect()}
    assert {r.key for r in S.env_definitions(files).collect()} == {"PORT", "HOST_NAME"}
    assert {r.key for r in S.env_definitions(files, per_format=True).collect()} == {"PORT"}
    assert {r.table for r in S.table_refs(files).collect()} == {"Users", "orders"}
    words = spark.createDataFrame([("q", "process")], "query_id string, word string")
    assert [(r.file, r.line) for r in S.grep(files, words).collect()] == [("b.js", 1)]


def test_diffs_and_history(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -3,2 +3 @@\n-a\n-b\n+c\n@@ -10,0 +9,2 @@\n+d\n+e\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n-q\n+r\n--- /dev/null\n+++ b/z.py\n@@ -0,0 +1 @@\n+n\n"
    out = {(r.file, r.line, r.kind) for r in S.changed_old_lines(spark.createDataFrame([(1, text)], "diff_id int, text string")).collect()}
    assert out == {("x.py", 3, "modified"), ("x.py", 4, "modified"), ("x.py", 10, "inserted"), ("y.py", 1, "modified")}
    log = spark.createDataFrame([("h1\x00fix\x00body\x01\nh2\x00more\x00\x01",)], "text string")
    assert [(r.commit, r.subject) for r in S.commits(log).orderBy("pos").collect()] == [("h1", "fix"), ("h2", "more")]


def test_jsonl_runs_and_union(spark, tmp_path):
    p = put(tmp_path / "l.jsonl", '{"key":"a"}\nbroken\n{"key":"b"}\n')
    assert S.read_jsonl(spark, p, "key string").count() == 2
    with pytest.raises(Exception):
        S.read_jsonl(spark, p, "key string", strict=True).collect()
    log = spark.createDataFrame([(0.0, "a", "agent running"), (5.0, "a", "resolved=True"), (10.0, "b", "agent running")], "ts double, key string, text string")
    assert [r.key for r in S.running(log).collect()] == ["b"]
    a, b = (spark.createDataFrame(rows, "k string, v int") for rows in ([("x", 1)], [("x", 2), ("y", 3)]))
    assert {r.k: r.v for r in S.union_first_wins([a, b], "k").collect()} == {"x": 1, "y": 3}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute("create table nodes(qualified_name text, file_path text, line_start integer)")
        db.executemany("insert into nodes values (?, ?, ?)", [(f"/w/src/a.py::f{i}", "/w/src/a.py", i) for i in range(10)])
    df = S.read_sqlite(spark, path, "nodes", "qualified_name string, file_path string, line_start long", partitions=3)
    assert df.count() == 10
    want = spark.createDataFrame([("q", "src/a.py"), ("r", "/w/src/a.py"), ("s", "rc/a.py")], "query_id string, path string")
    found = S.by_path(df, want).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {"q": 10, "r": 10}


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße()", ".x.y()", "src/x.py:L12", "tests\\a.py", "feature/x y"), ("A", "z((", "nope", "src/FooTest.java", "main")], "a string, b string, c string, d string, e string")
    r = df.select(X.folded("a").alias("f"), X.slug("a").alias("s"), X.leaf(df.b).alias("l"), X.leaf_any_parens(df.b).alias("l2"), X.file_and_line(df.c).alias("c"), X.is_test_path(df.d).alias("t"), X.slot_name(df.e).alias("slot")).collect()
    assert r[0].f == "strasse()" and r[0].s == "strasse" and r[0].l == "x.y" and r[0].c == ("src/x.py", 12) and r[0].t and r[1].t
    assert r[1].l2 == "z" and r[1].c is None and r[1].slot == "main" and r[0].slot.startswith("feature-x-y-")


def test_stream_upserts_and_a_second_run_adds(spark, tmp_path):
    src, table, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    row = lambda s, d, seq: json.dumps({"relation": "taints", "source_id": s, "target_id": "t", "detail": d, "seq": seq})
    put(src / "a.json", row("a", "old", 0) + "\n" + row("b", "b", 1))
    findings.start(spark, str(src), table, cp).awaitTermination(120)
    put(src / "b.json", row("a", "new", 2))
    findings.start(spark, str(src), table, cp).awaitTermination(120)
    assert {r.source_id: r.detail for r in findings.current(spark, table).collect()} == {"a": "new", "b": "b"}


def test_a_new_checkpoint_loses_no_update(spark, tmp_path):
    """Batch numbers begin at 0 again, at a new place and at the old one; versions go on, and a batch taken in before changes nothing."""
    import shutil

    table = str(tmp_path / "out")
    row = lambda s, d, seq: json.dumps({"relation": "taints", "source_id": s, "target_id": "t", "detail": d, "seq": seq})
    shown = lambda: {r.source_id: r.detail for r in findings.current(spark, table).collect()}
    for k, (folder, checkpoint) in enumerate([("in1", "cp1"), ("in1", "cp1"), ("in2", "cp2"), ("in3", "cp1")]):
        (tmp_path / folder).mkdir(exist_ok=True)
        if k == 3:
            shutil.rmtree(tmp_path / "cp1")
        put(tmp_path / folder / f"{k}.json", row("a", f"v{k}", k) + "\n" + row(f"only{k}", "x", 0))
        findings.start(spark, str(tmp_path / folder), table, str(tmp_path / checkpoint)).awaitTermination(120)
        assert shown() == {"a": f"v{k}"} | {f"only{i}": "x" for i in range(k + 1)}
    manifests = sorted(p.name for p in (tmp_path / "out" / "manifest").iterdir())
    assert manifests == ["000000000003", "000000000004"]  # older ones are dropped
    batch = spark.createDataFrame([("taints", "a", "t", "again", None, None, 9)], findings.SCHEMA)
    take = findings.upsert_into(table, "other")
    take(batch, 0)
    take(batch.withColumn("detail", F.lit("twice")), 0)
    assert shown()["a"] == "again"
    # only the buckets of a batch's keys are written again
    touched = {r.bucket for r in batch.select(F.pmod(F.xxhash64(*findings.KEYS), F.lit(findings.BUCKETS)).alias("bucket")).collect()}
    assert {int(p.name.split("=")[1]) for p in max((tmp_path / "out" / "data").iterdir()).glob("bucket=*")} == touched


def test_configuration_lies_where_its_forms_say(spark):
    names = [".env", "a/.env", "helm/x/y.yaml", "x/helm/y.yaml", "k8s/a.yml", "k8s/b/a.yml", ".github/workflows/ci.yml", "Dockerfile.dev", "src/Dockerfile", "main.tf"]
    df = spark.createDataFrame([(n, "export MY_KEY=1") for n in names], "file string, text string")
    assert {r.file for r in S.env_definitions(df).collect()} == {".env", "helm/x/y.yaml", "k8s/a.yml", ".github/workflows/ci.yml", "Dockerfile.dev", "main.tf"}


def test_long_paths_in_diffs(spark):
    path = "d/" * 3000 + "f.py"
    df = spark.createDataFrame([("x", f"--- a/{path}\n+++ b/{path}\n@@ -3,0 +4 @@\n+new")], "diff_id string, text string")
    assert [(r.file, r.line, r.kind) for r in S.changed_old_lines(df).collect()] == [(path, 3, "inserted")]


def test_hidden_files_at_every_depth(spark, tmp_path):
    for name in (".env", "a/.env", "a/b/_c.py", ".github/workflows/ci.yml", "a/b/d.py", ".git/config", "node_modules/x/.env"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x = 1")
    assert {r.file for r in S.scan(spark, str(tmp_path)).collect()} == {".env", "a/.env", "a/b/_c.py", ".github/workflows/ci.yml", "a/b/d.py"}


def test_keys_lines_costs_and_time_left(spark):
    df = spark.createDataFrame([("'a b'", "x L12 y", '{"a": [1, 2]}'), ("[computed]", "none", None), ("1st", "L7", '"é"'), ("`ok`", None, "[]"), ("with\ttab", "", "1")], "k string, l string, j string")
    out = df.select(X.clean_key(F.col("k")).alias("k"), X.loose_line(F.col("l")).alias("l"), X.json_cost("j").alias("j")).collect()
    assert [r.k for r in out] == ["a b", None, None, "ok", None] and [r.l for r in out] == [12, None, 7, None, None]
    assert [r.j for r in out] == [len('{"a": [1, 2]}') // 4, None, len('"\\u00e9"') // 4, 0, 0]
    df = spark.createDataFrame([(3, 10, 60.0, 2), (12, 10, 60.0, 2), (0, 4, 30.0, 0)], "done int, total int, s double, n int")
    assert [r.m for r in df.select(evaluate.eta_minutes(*map(F.col, df.columns)).alias("m")).collect()] == [3.5, 0.0, 2.0]


def test_env_reads_query_takes_any_numbers(spark, tmp_path):
    """Numbers far apart, and one that stands twice."""
    keys = [(k,) for k in (0, 1, 3, 3, 4, 90001, 2000000)]
    spark.createDataFrame(keys, "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got, want = rows(queries.QUERIES["env_reads"](spark, str(tmp_path))), expected(connect(str(tmp_path)), queries.ORACLE_SQL["env_reads"])
    assert got == want


def _semgrep_rows(spark, path, size="128m"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return sorted(tuple(r) for r in C.read_semgrep(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_semgrep_results_in_splits_of_a_file(spark, tmp_path):
    """Pretty and in one line, split at any byte, with what only looks like a key; never parsed whole."""
    odd = ('say "check_id', "a } , { b", "\\", '{"check_id": 1}', "é" * 9)
    results = [{"check_id": f"r{i}", "path": f"p{i % 7}", "start": {"line": i}, "end": {"line": i}, "extra": {"message": odd[1 + i % 4], "severity": "INFO"}} for i in range(300)]
    want = sorted((i, f"r{i}", f"p{i % 7}", i, "INFO", odd[1 + i % 4], None) for i in range(300))
    for indent in (None, 2):
        p = put(tmp_path / f"{indent}.json", json.dumps({"version": "1", "results": results, "errors": []}, indent=indent))
        for size in ("1000b", "1003b", "128m"):
            assert _semgrep_rows(spark, p, size) == want
        assert C._semgrep_pieces(spark, p) is not None


def test_semgrep_files_that_are_no_rows_of_results(spark, tmp_path):
    """Other first keys, results without the key, lists besides the results, and none at all give what parsing the whole gives."""
    x = {"check_id": "a", "path": "p", "start": {"line": 1}}
    for k, d in enumerate((
        {"results": [{"path": "p", "check_id": "a"}, x]}, {"results": [x, {"path": "no id"}, x]}, {"results": [x], "other": [{"path": "o"}, x, x]}, {"other": {"results": [x]}}, {"other": [x], "results": [x, x]},
        {"results": [x | {"extra": {"metadata": {"check_id": "inner"}}}, x]}, {"results": []}, {"version": 1}, {"results": [x | {"extra": {"message": 'say "check_id'}}, x]},
    )):
        got = _semgrep_rows(spark, put(tmp_path / f"{k}.json", d))
        assert [(r[0], r[1], r[2]) for r in got] == [(i, r.get("check_id"), r["path"]) for i, r in enumerate(d.get("results", []))], d
