"""Sinks, state, envelopes and the command line."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom import __main__ as command
from graphloom.api import Session, exit_code
from graphloom.plans import lineage
from graphloom.sinks import tables
from graphloom.sources import files, graph as G, scanners

GRAPH = {
    "nodes": [
        {"id": "handler", "label": "handler()", "source_file": "app.py", "source_location": "L4"}, {"id": "validate", "label": "validate()", "source_file": "app.py", "source_location": "L8"},
        {"id": "app", "label": "app.py", "source_file": "app.py", "source_location": "L1"}, {"id": "t", "label": "test_validate()", "source_file": "tests/test_app.py", "source_location": "L1"},
    ],
    "links": [{"source": "handler", "target": "validate", "relation": "calls", "confidence": "EXTRACTED"}, {"source": "app", "target": "handler", "relation": "contains"}],
}
CODE = "import os\n\n\ndef handler(a):\n    return validate(os.environ['HOME_DIR'])\n\n\ndef validate(a):\n    return a\n\n\ndef missed():\n    return 1\n"


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "app.py").write_text(CODE)
    (tmp_path / "tree" / ".env").write_text("HOME_DIR=/x\n")
    (tmp_path / "graph.json").write_text(json.dumps(GRAPH))
    return tmp_path


def test_tables_are_replaced_in_place(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.replace_table(spark.range(3), path)
    tables.replace_table(spark.read.parquet(path).where("id > 0"), path)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception):
        tables.replace_table(spark.range(3).select(F.raise_error(F.lit("no"))), path)
    assert spark.read.parquet(path).count() == 2


def test_parts_stamps_and_lines(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "repo string, v int")
    tables.merge_parts(make(("a", 1), ("b", 2)), f"{tmp_path}/r")
    tables.merge_parts(make(("b", 3)), f"{tmp_path}/r")
    assert {(r.repo, r.v) for r in spark.read.parquet(f"{tmp_path}/r").collect()} == {("a", 1), ("b", 3)}
    tables.append_jsonl(make(("a", 1)), f"{tmp_path}/l")
    tables.append_jsonl(make(("a", 2)), f"{tmp_path}/l")
    assert files.read_jsonl(spark, f"{tmp_path}/l", "repo string, v int").count() == 2
    assert tables.read_stamp(spark, f"{tmp_path}/s").count() == 0
    tables.write_stamp(spark, f"{tmp_path}/s", "main", "abc", 1, supplement=True)
    row = tables.read_stamp(spark, f"{tmp_path}/s").first()
    assert (row.branch, row.base_commit, row.version, row.supplement) == ("main", "abc", 1, True) and row.written is not None


def test_answers(spark, place):
    s = Session(spark, f"{place}/graph.json", f"{place}/tree")
    assert [r["id"] for r in s.search("VALIDATE")["rows"]] == ["validate", "t"]
    assert {r["id"] for r in s.blast_radius("validate")["rows"]} == {"validate", "handler"}
    lost = s.blast_radius("no such")
    assert lost["status"] == "error" and exit_code(lost) == 1
    near = s.overrides("a")
    assert near["status"] == "error" and near["candidates"]
    assert s.relations()["rows"][0]["relation"] == "calls"
    assert s.test_link()["rows"] == [{"test_id": "t", "target_id": "validate"}]
    assert s.config_scan()["rows"][0]["key"] == "HOME_DIR"
    pack = s.context("validate")
    assert "def validate" in pack["text"] and pack["summary"].endswith("tokens counted as chars/4")
    made = s.supplement(out=f"{place}/more")
    assert made["reasons"] == {"absent_from_extraction": 1}
    assert Session(spark, f"{place}/more").search("missed")["rows"][0]["id"] == "app_missed"
    assert Session(spark, f"{place}/none.json").relations()["status"] == "error"


def test_injection_and_edge_differences(spark, place, capsys):
    (place / "f.json").write_text(json.dumps({"edges": [{"relation": "taints", "source_ref": {"node": "handler"}, "target_ref": {"file": "app.py", "line": 9}}, {"relation": "odd", "source_ref": {"node": "app"}, "target_ref": {"node": "app"}}]}))
    at = ["--graph", f"{place}/graph.json"]
    assert command.main([*at, "edge-diff", "snapshot", "handler", f"{place}/snap"], spark) == 0
    assert command.main([*at, "edge-diff", "check", "handler", f"{place}/snap"], spark) == 0
    capsys.readouterr()
    assert command.main([*at, "inject", f"{place}/f.json", "--out", f"{place}/g"], spark) == 0
    assert json.loads(capsys.readouterr().out)["report"] == {"applied": 1, "unknown_relation": 1}
    assert command.main(["--graph", f"{place}/g", "edge-diff", "check", "handler", f"{place}/snap"], spark) == 2
    assert command.main(["--graph", f"{place}/g", "search", "", "--limit", "3"], spark) == 0
    assert command.main(["--graph", f"{place}/g", "inject", f"{place}/f.json", "--kind", "odd"], spark) == 1


def test_git_probes(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    (tmp_path / "a").write_text("1")
    run("add", "a")
    run("commit", "-m", "first\n\nbody text")
    first = files.git(str(tmp_path), "rev-parse", "HEAD").strip()
    run("checkout", "-b", "topic")
    run("commit", "--allow-empty", "-m", "second")
    row = files.git_state(spark, str(tmp_path), first).first()
    assert (row.branch, row.previous, row.base_is_ancestor) == ("topic", "main", True) and row.year > 2000 and row.head != first
    assert [(r.subject, r.body.strip()) for r in files.git_log(spark, str(tmp_path)).orderBy("pos").collect()] == [("second", ""), ("first", "body text")]
    assert files.git(str(tmp_path / "none"), "status") is None


def test_trace_ends_however_deep(spark):
    ends = [{"path": "a.py", "start": {"line": 3}}, [{"location": {"path": "b.py", "start": {"line": 4}}}, "text"], ["Loc", [[[{"location": {"location": {"path": "c.py"}}}]]]], {"x": 1}, "text", None]
    df = spark.createDataFrame([(None if e is None else json.dumps(e),) for e in ends] + [("{bad",)], "t string")
    got = [(r["at"].file, r["at"].line) for r in df.select(scanners.location("t").alias("at")).collect()]
    assert got == [("a.py", 3), ("b.py", 4), ("c.py", None), (None, None), (None, None), (None, None), (None, None)]


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session_:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="shared folder"):
        lineage.shared_dir(Session_())


def test_cleared_intermediates_are_gone(spark):
    since = lineage.mark()
    df = lineage.cut(spark.range(3), "x")
    assert df.count() == 3
    lineage.clear(spark, since)
    with pytest.raises(Exception):
        df.count()


def test_graph_files_are_told_apart(spark, place):
    assert G.readable(spark, f"{place}/graph.json") and not G.readable(spark, f"{place}/f.json")
