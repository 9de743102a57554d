"""Traversal, resolution, links and packs on a small graph."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import text as T
from graphloom.functions import text as X
from graphloom.operators import corpus, diff, edges as E, pack, rank, resolve, state, supplement, symbols, traverse, triage

NODE = "id string, label string, source_file string, source_location string, _callable boolean, qualified_name string, origin string, node_pos long"
EDGE = "source string, target string, relation string, confidence string, confidence_score double, origin string, detail string, edge_pos long"


def node(pos, id_, label, file, line):
    return (id_, label, file, f"L{line}", None, None, None, pos)


def edge(pos, s, t, relation, confidence="EXTRACTED"):
    return (s, t, relation, confidence, None, None, None, pos)


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        node(0, "handler", "handler()", "src/app.py", 3), node(1, "validate", "validate()", "src/app.py", 10), node(2, "sanitize", "sanitize()", "src/app.py", 20),
        node(3, "Base", "Base", "src/base.py", 1), node(4, "Base.check", ".check()", "src/base.py", 2), node(5, "Sub", "Sub", "src/sub.py", 1), node(6, "Sub.check", ".check()", "src/sub.py", 5),
        node(7, "t_validate", "test_validate()", "tests/test_app.py", 4), node(8, "app", "app.py", "src/app.py", 1),
    ]
    edges = [
        edge(0, "handler", "validate", "calls"), edge(1, "validate", "sanitize", "calls"), edge(2, "Base", "Base.check", "method"), edge(3, "Sub", "Sub.check", "method"),
        edge(4, "Sub", "Base", "inherits"), edge(5, "handler", "Base.check", "calls"), edge(6, "t_validate", "validate", "calls"),
    ]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def seeds(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "query_id string, id string")


def reach(spark, graph, seed, depth, direction, **more):
    return {r.id: r.depth for r in traverse.radius(*graph, seeds(spark, seed), depth, direction, **more).collect()}


def test_up_finds_callers_with_their_depth(spark, graph):
    assert reach(spark, graph, "sanitize", 2, "up") == {"sanitize": 0, "validate": 1, "handler": 2, "t_validate": 2}
    assert "handler" not in reach(spark, graph, "sanitize", 1, "up")


def test_down_and_members_as_seeds(spark, graph):
    assert set(reach(spark, graph, "handler", 2, "down")) >= {"validate", "sanitize"}
    up = reach(spark, graph, "Base", 1, "up")
    assert up["Base.check"] == 0 and {"handler", "Sub"} <= set(up)
    narrowed = reach(spark, graph, "Base", 1, "up", relations=("calls",))
    assert set(narrowed) < set(up) and "Sub" not in narrowed


def test_cap_truncates_in_discovery_order(spark, graph):
    out = traverse.radius(*graph, seeds(spark, "sanitize"), 5, "up", max_nodes=3).collect()
    assert {r.id for r in out} == {"sanitize", "validate", "handler"} and all(r.truncated for r in out)
    out = traverse.radius(*graph, seeds(spark, "sanitize"), 5, "up", max_nodes=99).collect()
    assert len(out) == 4 and not any(r.truncated for r in out)


def test_unknown_seed_and_direction_raise(spark, graph):
    with pytest.raises(KeyError):
        traverse.radius(*graph, seeds(spark, "nope"))
    with pytest.raises(ValueError):
        traverse.radius(*graph, seeds(spark, "Base"), direction="sideways")


def test_deep_walk_cuts_lineage_and_survives_cycles(spark):
    n = spark.createDataFrame([node(i, f"n{i}", f"n{i}()", "a.py", i + 1) for i in range(9)], NODE)
    e = spark.createDataFrame([edge(i, f"n{i}", f"n{(i + 1) % 9}", "calls") for i in range(9)], EDGE)
    assert reach(spark, (n, e), "n0", 12, "down") == {f"n{i}": i for i in range(9)}


def test_closure_takes_every_relation_and_taint_is_exposed(spark, graph):
    nodes, edges = graph
    edges = edges.unionByName(spark.createDataFrame([edge(7, "handler", "sanitize", "taints", "EXTERNAL"), edge(8, "handler", "sanitize", "taints", "EXTERNAL")], EDGE))
    r = traverse.radius(nodes, edges, seeds(spark, "sanitize"), 2, "up")
    closure = traverse.closure_edges(edges, r)
    assert closure.where("relation = 'taints'").count() == 1
    assert {x.id for x in traverse.taint_exposed(closure)[1].collect()} == {"handler", "sanitize"}


def test_overrides_in_subclasses(spark, graph):
    out = traverse.overrides(*graph, seeds(spark, "Base.check")).collect()
    assert [(r.id, r.owning_class) for r in out] == [("Sub.check", "Sub")]


def test_self_loop_is_a_caller_only_and_counts_twice(spark, graph):
    e = spark.createDataFrame([edge(0, "handler", "handler", "calls")], EDGE)
    assert [r.role for r in traverse.neighbours(graph[0], e, seeds(spark, "handler")).collect()] == ["caller"]
    assert traverse.degree(e).first().degree == 2


def test_ladder_falls_through_rungs_with_several_matches(spark, graph):
    asked = ["Base.check", "src/app.py:L10", "src/app.py:12", "validate", ".check()", "src/sub.py", "saniti", "check", "nothing here"]
    out = {r.query_id: (r.id, r.rung) for r in resolve.resolve(spark.createDataFrame([(a, a) for a in asked], "query_id string, query string"), graph[0]).collect()}
    assert out["Base.check"] == ("Base.check", "id")
    assert out["src/app.py:L10"] == ("validate", "location") and out["src/app.py:12"] == ("validate", "location")
    assert out["validate"] == ("validate", "id")
    assert ".check()" not in out  # two labels, two leaves, and nothing else tells them apart
    assert out["src/sub.py"] == ("Sub", "file")
    assert out["saniti"] == ("sanitize", "substring")
    assert "nothing here" not in out


def test_locate_guards(spark, graph):
    lines = [("src/app.py", i, "    x" if i not in (1, 15) else "y = 1") for i in range(1, 31)]
    text = spark.createDataFrame(lines, "file string, line int, text string")
    ask = spark.createDataFrame([("a", "src/app.py", 10), ("b", "src/app.py", 12), ("c", "src/app.py", 15), ("d", "src/app.py", 99), ("e", "src\\app.py", 25)], "query_id string, file string, line int")
    out = {r.query_id: (r.id, r.how) for r in resolve.locate(ask, graph[0], text).collect()}
    assert out == {"a": ("validate", "exact"), "b": ("validate", "preceding"), "c": ("app", "file"), "e": ("sanitize", "preceding")}


def test_candidates_rank_exact_before_part(spark, graph):
    out = resolve.candidates(spark.createDataFrame([("q", "validate")], "query_id string, query string"), graph[0], limit=2).orderBy("rank").collect()
    assert [(r.id, r.match) for r in out] == [("validate", 0), ("t_validate", 2)]


def test_smallest_extent_and_anchor(spark):
    ext = spark.createDataFrame([("f", "outer", 1, 200, 0), ("f", "inner", 60, 70, 1)], "file string, name string, start int, end int, pos int")
    pts = spark.createDataFrame([(1, "f", 64), (2, "f", 70), (3, "f", 150), (4, "f", 300)], "query_id int, file string, line int")
    assert {r.query_id: r.name for r in resolve.enclosing(pts, ext).collect()} == {1: "inner", 2: "inner", 3: "outer"}
    assert {r.query_id: r["name"] for r in resolve.insertion_anchor(pts, ext).collect()} == {1: "inner", 3: "outer"}


def test_skip_fill_takes_a_smaller_row_after_one_that_did_not_fit(spark):
    rows = spark.createDataFrame([("q", 1, 50), ("q", 2, 80), ("q", 3, 40), ("q", 4, 20)], "query_id string, rank int, cost int")
    out = {r["rank"]: r.taken for r in rank.greedy_fill(rows, 100).collect()}
    assert out == {1: True, 2: False, 3: True, 4: False}


def test_seed_is_kept_over_budget_and_the_index_takes_the_rest(spark):
    rows = [("q", "s", "s", 1, 0, 500, 9), ("q", "s", "a", 2, 1, 10, 9), ("q", "s", "b", 3, 2, 10, 9), ("q", "s", "c", 4, 2, 10, 9)]
    df = spark.createDataFrame(rows, "query_id string, seed string, id string, rank int, depth int, cost int, index_cost int")
    out = {r.id: (r.tier, r.reason) for r in rank.two_tier_fill(df, 100, 20, body_depth=1).collect()}
    assert out == {"s": ("body", None), "a": ("index", "budget"), "b": ("index", "depth"), "c": ("omitted", "index_budget")}


def test_orders_differ(spark):
    rows = [("q", "s", "s", "s()", 0, "calls", False), ("q", "s", "near", "near()", 1, "imports", False), ("q", "s", "far", "far()", 2, "calls", True), ("q", "s", "mem", ".mem()", 1, "imports", False)]
    df = spark.createDataFrame(rows, "query_id string, seed string, id string, label string, depth int, via string, mentioned boolean")
    order = lambda o: [r.id for r in rank.ranked(df, o).orderBy("rank").collect()]
    assert order("mention-first") == ["s", "far", "mem", "near"]
    assert order("current") == ["s", "mem", "near", "far"]
    with pytest.raises(ValueError):
        rank.ranked(df, "random")


def test_merge_is_idempotent_and_reports(spark, graph):
    found = spark.createDataFrame(
        [("taints", "handler", "sanitize", 0, False), ("taints", "handler", "sanitize", 1, False), ("odd", "a", "b", 2, False), ("taints", None, "b", 3, False), ("taints", "x", "x", 4, True), ("taints", "x", "x", 5, False)],
        "relation string, source_id string, target_id string, pos long, skip_self boolean",
    ).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("confidence", "string"), ("confidence_score", "double"), ("detail", "string"))])
    once, first = E.merge(graph[1], E.validated(found))
    twice, second = E.merge(once, E.validated(found))
    key = ("source", "target", "relation", "confidence", "origin")
    assert not diff.edge_diff(once, twice, key).count() and diff.exit_code(diff.edge_diff(graph[1], once, key)) == 2
    assert {r.reason: r.n for r in first.collect()} == {"applied": 2, "unknown_relation": 1, "unresolved_source": 1, "self_edge": 1}
    assert {r.reason: r.n for r in second.collect()}["removed"] == 2
    assert once.where("relation = 'taints'").first().confidence == "EXTERNAL"


def test_line_bearing_reference_is_not_downgraded(spark, graph):
    ref = "struct<node:string,file:string,line:int>"
    f = spark.createDataFrame([("taints", (None, "src/app.py", 21), ("Base.check", None, None)), ("taints", (None, "src/none.py", 5), ("Base.check", None, None))], f"relation string, source_ref {ref}, target_ref {ref}")
    out = sorted((r.source_id or "", r.target_id) for r in E.resolve_findings(f, graph[0]).collect())
    assert out == [("", "Base.check"), ("sanitize", "Base.check")]


def test_upsert_keeps_the_place(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "k string, v int, pos long")
    new = spark.createDataFrame([("a", 9, 0), ("c", 3, 1)], "k string, v int, pos long")
    out = E.upsert(old, new, ["k"]).orderBy("generation", "pos").collect()
    assert [(r.k, r.v) for r in out] == [("a", 9), ("b", 2), ("c", 3)]


def test_unique_name_links_need_exactly_one_target(spark, graph):
    assert {(r.test_id, r.target_id) for r in E.unique_name_links(graph[0]).collect()} == {("t_validate", "validate")}


def test_triage_in_one_traversal(spark, graph):
    report = spark.createDataFrame([("V1", "d", "src/app.py", 21, None), ("V2", "d", None, None, "Base.check"), ("V3", "d", "x.py", 3, None)], "query_id string, description string, file string, line int, function string")
    out = {r.query_id: r for r in triage.triage(report, *graph).collect()}
    assert out["V1"].seed == "sanitize" and out["V1"].callers == ["validate"] and out["V1"].n_nodes == 4
    assert out["V2"].overrides == ["Sub.check"] and out["V3"].seed is None


SOURCE = '''import os


@decorated
def top(a, b=1):
    """Text."""
    return helper(a) + mod.other(b)


class Outer:
    class Inner:
        def deep(self):
            def hidden():
                return 1
            return hidden()

    def method(self):
        return top(1)
'''


@pytest.fixture(scope="module")
def source(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("x.tsx", "let a"), ("gone.py", None)], "file string, text string")
    return files, symbols.definitions(files).cache()


def test_definitions_extents_and_calls(source):
    rows = {r.name: r for r in source[1].where("status = 'ok'").collect()}
    assert (rows["top"].start, rows["top"].def_line, rows["top"].end) == (4, 5, 7) and rows["top"].calls == ["helper", "other"]
    assert set(rows) == {"top", "Outer", "Outer.Inner", "Outer.Inner.deep", "Outer.Inner.deep.hidden", "Outer.method"}
    assert rows["Outer.Inner.deep"].calls == ["hidden"]
    status = {r.file: r.status for r in source[1].where("status <> 'ok'").collect()}
    assert status == {"bad.py": "parse_failed", "x.tsx": "unsupported_language", "gone.py": "file_unreadable"}


def test_nested_and_members(source):
    assert [r.name for r in symbols.nested_in_function(source[1]).collect()] == ["Outer.Inner.deep.hidden"]
    members = {(r["class"], r.member) for r in symbols.class_members(source[1]).collect()}
    assert members == {("Outer", "Outer.Inner"), ("Outer", "Outer.method"), ("Outer.Inner", "Outer.Inner.deep")}


def test_typed_refusals(spark, source):
    ask = [("ok", "a.py", 5, "top"), ("other", "a.py", 5, "nope"), ("none", "a.py", 2, "x"), ("bad", "bad.py", 1, "x"), ("lang", "x.tsx", 1, "x"), ("loc", "a.py", None, "x"), ("file", None, 1, "x"), ("gone", "zz.py", 1, "x")]
    out = {r.query_id: r.unresolved for r in symbols.at_line(spark.createDataFrame(ask, "query_id string, file string, def_line int, leaf string"), source[1]).collect()}
    assert out == {"ok": None, "other": "definition_mismatch", "none": "no_definition_at_line", "bad": "parse_failed", "lang": "unsupported_language", "loc": "bad_source_location", "file": "missing_source_file", "gone": "file_unreadable"}


def test_supplement_is_idempotent_and_skips_nested(spark, source):
    nodes = spark.createDataFrame([node(0, "a_py", "a.py", "a.py", 1), node(1, "a_top", "top()", "a.py", 5)], NODE).drop("node_pos")
    edges = spark.createDataFrame([], EDGE).drop("edge_pos")
    n, e, skipped = supplement.compute(nodes, source[1])
    ids = {r.id for r in n.collect()}
    assert ids == {"a_py_outer", "a_py_outer_inner", "a_py_outer_inner_deep", "a_py_outer_method"}
    assert [r.name for r in skipped.collect()] == ["Outer.Inner.deep.hidden"]
    links = {(r.source, r.target, r.relation) for r in e.collect()}
    assert ("a_py_outer", "a_py_outer_method", "method") in links and ("a_py", "a_py_outer", "contains") in links
    assert ("a_py_outer_method", "a_top", "calls") in links
    one = supplement.apply(nodes, edges, source[1])
    two = supplement.apply(*one, source[1])
    assert {r.id for r in one[0].collect()} == {r.id for r in two[0].collect()} and one[1].count() == two[1].count()


def test_pack_discloses_what_is_missing(spark, source):
    files, defs = source
    nodes = spark.createDataFrame([node(0, "f", "a.py", "a.py", 1), node(1, "top", "top()", "a.py", 5), node(2, "m", ".method()", "a.py", 17), node(3, "lost", "lost()", "a.py", 9)], NODE)
    edges = spark.createDataFrame([edge(0, "m", "top", "calls"), edge(1, "lost", "top", "calls"), edge(2, "f", "top", "contains")], EDGE)
    p = pack.context_pack(nodes, edges, seeds(spark, "top"), files, defs)
    assert {r.id: r.tier for r in p.rows.collect()} == {"top": "body", "m": "body"}
    assert {r.id: r.reason for r in p.unresolved.collect()} == {"lost": "no_definition_at_line", "f": "file_node"}
    assert {r.name for r in p.unmodelled.collect()} == {"Outer", "Outer.Inner", "Outer.Inner.deep", "Outer.Inner.deep.hidden"}
    assert {r.id for r in p.call_sites.collect()} == {"m", "lost"}
    text = pack.render(p, files).first().text
    assert "def top" in text and text.index("def top") < text.index("def method")


def test_slots_and_refresh(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    state.write_slot(df, str(tmp_path / "g"), "main")
    state.seed_slot(spark, str(tmp_path / "g"), "main", "topic")
    state.write_slot(df.where("path = 'a'"), str(tmp_path / "g"), "topic")
    assert state.read_slot(spark, str(tmp_path / "g"), "main").count() == 2 and state.read_slot(spark, str(tmp_path / "g"), "topic").count() == 1
    manifest = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, md5 string")
    files = spark.createDataFrame([("a", "", "1"), ("b", "", "2"), ("d", "", "1")], "path string, text string, md5 string")
    rows, report = state.refresh(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int"), manifest, files, lambda f: f.select("path", F.lit(2).alias("v")))
    assert {r.path: r.v for r in rows.collect()} == {"a": 1, "b": 2, "d": 2}
    assert {r.path: r.reason for r in report.collect()} == {"b": "edited", "c": "deleted", "d": "added"}


def test_shortest_depth_query_walks_as_far_as_the_operator(spark, monkeypatch):
    """A chain with O:7 at one end: 4, 8 and 9 hops to the targets, held against a plain breadth-first search."""
    chain = ["O:7", "a", "b", "c", "S:1", "d", "e", "f", "P:3", "R:1"]
    pairs = [(chain[i], chain[i + 1]) if i % 2 else (chain[i + 1], chain[i]) for i in range(len(chain) - 1)]
    nodes = spark.createDataFrame([node(i, x, x, "f", i) for i, x in enumerate(chain)], NODE)
    edges = spark.createDataFrame([edge(i, s, t, "calls") for i, (s, t) in enumerate(pairs)], EDGE)
    monkeypatch.setattr(queries, "_graph", lambda *_, **more: (nodes, edges))
    near, depth, hops = {"O:7"}, {"O:7": 0}, 0
    while near and hops < 8:
        hops += 1
        near = {y for s, t in pairs for x, y in ((s, t), (t, s)) if x in near and y not in depth}
        depth |= dict.fromkeys(near, hops)
    got = {r.target: r.depth for r in queries.QUERIES["shortest_depth"](spark, "").collect()}
    assert got == {x: depth.get(x) for x in ("S:1", "P:3", "R:1")} == {"S:1": 4, "P:3": 8, "R:1": None}


def test_ladder_folds_case_and_answers_places_from_the_place_alone(spark, graph):
    nodes = graph[0].unionByName(spark.createDataFrame([node(20, "p1", "Parse()", "src/p.py", 3), node(21, "p2", "ParseAll()", "src/p.py", 9), node(22, "parse_mod", "util", "src/p.py", 20), node(23, "s", "Straße()", "src/s.py", 2)], NODE))
    asked = ["parse", "PARSEALL", "STRASSE", "SRC/sub.py", "./src/sub.py/", "src/p.py:L1", "nowhere.py:3", "arseal", "rse", "Handler()"]
    out = {r.query_id: (r.id, r.rung) for r in resolve.resolve(spark.createDataFrame([(a, a) for a in asked], "query_id string, query string"), nodes).collect()}
    assert out["parse"] == ("p1", "bare") and out["PARSEALL"] == ("p2", "bare") and out["STRASSE"] == ("s", "bare")
    assert out["SRC/sub.py"] == out["./src/sub.py/"] == ("Sub", "file")
    assert "src/p.py:L1" not in out and "nowhere.py:3" not in out  # nothing lies above, and a place is no name
    assert out["arseal"] == ("p2", "substring") and "rse" not in out and out["Handler()"] == ("handler", "label")


def test_containment_through_grams_equals_the_direct_form(spark, graph, monkeypatch):
    ask = spark.createDataFrame([(q, q) for q in ("check", "VALID", "a", "py", "handler", "src/sub", "no")], "query_id string, query string")
    shown = lambda: sorted((r.query_id, r.id, r.match, r["rank"]) for r in resolve.candidates(ask, graph[0]).collect())
    direct = shown()
    monkeypatch.setattr(resolve, "DIRECT", 2)
    assert shown() == direct and len(direct) > 10
    plan = resolve.candidates(ask, graph[0])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_places_in_far_spans_carry_the_last_definition(spark, graph, monkeypatch):
    monkeypatch.setattr(resolve, "SPAN", 4)
    test_locate_guards(spark, graph)
    ask = spark.createDataFrame([(str(k), "src/app.py", k) for k in range(1, 60)], "query_id string, file string, line int")
    out = {int(r.query_id): r.id for r in resolve.locate(ask, graph[0]).collect()}
    assert out == {k: "sanitize" if k >= 20 else "validate" if k >= 10 else "handler" for k in range(3, 60)}


def test_dangling_ends_are_neither_found_nor_walked_through(spark, graph):
    e = graph[1].unionByName(spark.createDataFrame([edge(9, "ghost", "sanitize", "calls"), edge(10, "Sub", "ghost", "calls")], EDGE))
    assert reach(spark, (graph[0], e), "sanitize", 3, "up") == {"sanitize": 0, "validate": 1, "handler": 2, "t_validate": 2}
    assert [(r.id, r.pos) for r in traverse.ordered(traverse.radius(graph[0], e, seeds(spark, "sanitize"))).orderBy("pos").collect()] == [("sanitize", 1), ("validate", 2), ("handler", 3), ("t_validate", 4)]
    narrow, wide = (traverse.radius(*graph, seeds(spark, "Base"), 1, "up", r) for r in (("calls",), ("calls", "inherits")))
    assert traverse.is_subset(narrow, wide) and not traverse.is_subset(wide, narrow)
    assert traverse.relation_set(("a", "b"), ("b", "c")) == ("a", "b", "c")


def test_tests_are_linked_by_words_only_and_to_any_labelled_node(spark):
    rows = [node(0, "a", "Widget", "src/a.py", 1), node(1, "b", "twice()", "src/b.py", 1), node(2, "c", "Twice", "src/c.py", 1), node(3, "t1", "test_widget()", "tests/t.py", 1), node(4, "t2", "TEST_TWICE()", "tests/t.py", 2), node(5, "t3", "test_widget-x()", "tests/t.py", 3), node(6, "t4", ".test_widget()", "tests/t.py", 4)]
    n = spark.createDataFrame(rows, NODE)
    assert [(r.test_id, r.target_id) for r in E.unique_name_links(n).collect()] == [("t1", "a")]
    assert {r.test_id for r in E.unique_name_links(n, strip_dots=True).collect()} == {"t1", "t4"}


def test_supplement_comes_before_findings(spark, source):
    nodes = spark.createDataFrame([node(0, "a_py", "a.py", "a.py", 1), node(1, "a_top", "top()", "a.py", 5)], NODE)
    edges = spark.createDataFrame([], EDGE)
    ref = "struct<node:string,file:string,line:int>"
    found = spark.createDataFrame([("taints", ("a_top", None, None), ("Outer.method", None, None), None, None, None, False, 0)], f"relation string, source_ref {ref}, target_ref {ref}, detail string, confidence string, confidence_score double, skip_self boolean, pos long")
    n, e, report = E.reapply(nodes, edges, source[1], found)
    assert {(r.source, r.target) for r in e.where("relation = 'taints'").collect()} == {("a_top", "a_py_outer_method")} and {r.reason for r in report.collect()} == {"applied"}


def test_refresh_tells_what_changed_once_more(spark):
    manifest = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, md5 string")
    files = spark.createDataFrame([("a", "", "2"), ("b", "", "2")], "path string, text string, md5 string")
    now = spark.createDataFrame([("a", "2"), ("b", "3")], "path string, md5 string")
    _, report = state.refresh(spark.createDataFrame([("a", 1)], "path string, v int"), manifest, files, lambda f: f.select("path", F.lit(2).alias("v")), now)
    assert {r.path: r.still_stale for r in report.collect()} == {"a": False, "b": True}
    assert state.render_refresh(report).first().text == "edited a\nedited b (still stale)"


def test_fingerprints_and_their_differences(spark, graph):
    ids = spark.createDataFrame([("validate",), ("cfg",)], "id string")
    before = diff.fingerprints(graph[1], ids)
    after = diff.fingerprints(graph[1].where("target <> 'sanitize'"), ids)
    rows = {r.id: r.edges for r in before.collect()}
    assert rows["cfg"] == [] and rows["validate"] == sorted(rows["validate"]) and rows["validate"][0] == '{"confidence":"EXTRACTED","relation":"calls","source":"handler","target":"validate"}'
    out = diff.fingerprint_diff(before, after).collect()
    assert [(r.id, len(r.added), len(r.removed)) for r in out] == [("validate", 0, 1)]


def test_triage_lines(spark, graph):
    report = spark.createDataFrame([("V1", "d", "src/app.py", 21, None), ("V3", "d", "x.py", 3, None)], "query_id string, description string, file string, line int, function string")
    text = {r.query_id: r.text for r in triage.summarize(triage.triage(report, *graph)).collect()}
    assert text == {"V1": "- V1: sanitize [radius: 4 nodes/3 edges; taint-exposed: 0; NO TEST COVERAGE; overrides: 0; config deps: 0]", "V3": "- V3: UNRESOLVED"}


def test_python_rounding_and_label_kinds(spark):
    df = spark.createDataFrame([(2.675, 2), (0.5, 0), (1.5, 0), (None, 1)], "v double, n int")
    assert [r.x for r in df.select(X.rounded("v", "n").alias("x")).collect()] == [round(2.675, 2), 0.0, 2.0, None]
    df = spark.createDataFrame([("f()",), ("a/b.py",), ("Class",), (None,)], "l string")
    assert [r.k for r in df.select(X.label_kind(F.col("l")).alias("k")).collect()] == ["function", "file", None, None]


def _extents_at_random():
    """(extents, points): two files, extents of every length around the same lines, ties, empty and missing ones."""
    rnd = random.Random(3)
    starts = [rnd.randrange(-5, 300) for _ in range(300)]
    extents = [(rnd.choice("ab"), f"n{i % 90}", a, a + rnd.choice([0, 1, 3, 4, 15, 16, 17, 64, 200, 5000, -2]), rnd.randrange(200) * 1000 + i) for i, a in enumerate(starts)]
    extents += [(None, "no file", 1, 5, 1), ("a", "no start", None, 5, 2), ("b", "whole", 0, 2147483647, -1)]
    points = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(-8, 600)])) for i in range(2000)]
    return extents, points


def _smallest_by_hand(extents, file, line):
    met = [(end - start, pos, f, name, start, end) for f, name, start, end, pos in extents if None not in (f, start, line) and f == file and start <= line <= end]
    return min(met)[2:] if met else None


EXTENT, POINT = "file string, name string, start int, end int, pos long", "query_id long, file string, line int"


def test_smallest_extent_as_by_hand(spark):
    extents, points = _extents_at_random()
    got = resolve.enclosing(spark.createDataFrame(points, POINT), spark.createDataFrame(extents, EXTENT)).collect()
    assert {tuple(r) for r in got} == {(i, *e) for i, f, n in points if (e := _smallest_by_hand(extents, f, n))}


def test_smallest_extent_makes_no_row_for_each_pair(spark, monkeypatch):
    """2,000 nested extents around the same lines: what is dealt out follows the extents' lengths by their logarithm, not their lines."""
    extents = spark.range(2000).selectExpr("'f' as file", "'n' || id as name", "cast(10000 - id as int) as start", "cast(10000 + id as int) as end", "id as pos")
    dealt = extents.select(F.explode(resolve._blocks(F.col("start"), F.col("end"))))
    assert dealt.count() < 2000 * 32
    points = spark.range(19000).selectExpr("id as query_id", "'f' as file", "cast(id as int) as line")
    got = {r.query_id: r["name"] for r in resolve.enclosing(points, extents).collect()}
    assert got == {i: f"n{abs(i - 10000)}" for i in range(19000) if abs(i - 10000) < 2000}


def test_insertion_anchor_as_by_hand(spark):
    """Also of points that share an id, and of extents that differ in their end alone."""
    extents, points = _extents_at_random()
    points += [(None, "a", 40), (7, "b", 90), (8, "b", 91)]
    got = resolve.insertion_anchor(spark.createDataFrame(points, POINT), spark.createDataFrame(extents, EXTENT)).collect()
    best = {}
    for i, f, n in points:
        for o in (0, 1):
            met = [(end - start, pos, f, name, start) for g, name, start, end, pos in extents if None not in (i, g, start, n) and g == f and start <= n + o <= end]
            best[i, o] = min([*met, *([best[i, o]] if best.get((i, o)) else [])], default=None)
    ids = {i for i, _, _ in points}
    assert sorted((r.query_id, r["name"]) for r in got) == sorted((i, best[i, 0][3]) for i in ids if best[i, 0] and best[i, 1] and best[i, 0][2:] == best[i, 1][2:])


def test_controls_count_each_line_by_itself(spark):
    """Random extents of any length; lines may share an id and may have no place."""
    extents, points = _extents_at_random()
    lines = [(i // 2, i % 3, f, n, i % 5 < 2) for i, f, n in points]
    got = corpus.controls(spark.createDataFrame(lines, "query_id long, repo int, file string, line int, touched boolean"), spark.createDataFrame(extents, EXTENT)).collect()
    inside = [(r, t, _smallest_by_hand(extents, f, n) is not None) for _, r, f, n, t in lines]
    counts = lambda rows: (sum(t for _, t, _ in rows), sum(t and h for _, t, h in rows), sum(not t for _, t, _ in rows), sum(not t and not h for _, t, h in rows))
    assert {r.repo: tuple(r)[1:] for r in got} == {None: counts(inside)} | {k: counts([x for x in inside if x[0] == k]) for k in range(3)}


def test_line_slices_split_a_long_text_once(spark):
    """20,000 ranges of a text of 40,000 lines; split for each of them, it would be 800,000,000 lines."""
    text = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40000)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\r\n").alias("text"))
    ranges = F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda i: F.struct((i * 2 - 2).alias("start"), (i * 2).alias("end")))
    got = text.select(F.inline(T.line_slices(F.col("text"), ranges))).collect()
    assert [r.text for r in got] == ["\n".join(f"line {n}" for n in range(max(1, i * 2 - 2), i * 2 + 1)) for i in range(1, 20001)]
    odd = spark.createDataFrame([("a\nb\nc",)], "text string").select(F.inline(T.line_slices(F.col("text"), F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 1), (2, 9), (3, 1), (7, 8))]))))
    assert [r.text for r in odd.collect()] == ["a", "b\nc", "", ""]
