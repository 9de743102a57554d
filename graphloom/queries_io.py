"""Queries for readers and state: inputs are put into files in the shared folder and read back through the library's sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as X
from .operators import diff, evaluate, rank, state, supplement, symbols
from .plans import lineage, projection
from .plans.projection import table
from .queries import _DEFS_SQL, _graph, _modelled, _parsed, _sources, query
from .sinks import tables
from .sources import files, graph as G, scanners


def _put(df: DataFrame, label: str) -> str:
    """One text column as a file in the shared folder, a row a line."""
    path = lineage.new_path(df.sparkSession, label)
    df.coalesce(1).write.text(path)
    return path


def _joined(df: DataFrame, item: Column, order: Column, head: str, tail: str, sep: str = ",") -> DataFrame:
    """All rows as one text."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("t")))), lambda x: x["t"]), sep)
    return df.agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value"))


def _put_list(df: DataFrame, item: Column, order: str, head: str, tail: str, label: str) -> str:
    """A list as a file, an item a line: rows stream into it in order and are never one text."""
    ends = df.sparkSession.createDataFrame([(0,), (2,)], "_part int")
    rows = df.withColumn("_part", F.lit(1)).unionByName(ends, allowMissingColumns=True).repartition(1).sortWithinPartitions("_part", order)
    rows = rows.withColumn("_n", F.monotonically_increasing_id())  # the head is 0 and the first item 1
    value = F.when(F.col("_part") == 0, head).when(F.col("_part") == 2, tail).otherwise(F.concat(F.when(F.col("_n") > 1, ",").otherwise(""), item))
    return _put(rows.select(value.alias("value")), label)


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- files ---------------------------------------------------------------------------------


@query("""with n as (select 'N:' || n_nationkey as id, n_name as label, n_nationkey as p from nation), e as (select 'R:' || n_regionkey as source, 'N:' || n_nationkey as target, n_nationkey as p from nation)
select 'node' as kind, id as a, case when p % 5 = 0 then label || ' again' else label end as b, (case when p % 5 = 0 then 100 else 0 end + p)::bigint as pos from n union all select 'edge', source, target, p::bigint from e""")  # fmt: skip
def graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph file: ``links`` go before ``edges``, of nodes with one id the last wins, list positions are kept."""
    n = table(spark, sf_dir, "nation")
    node = lambda label: F.to_json(F.struct(F.concat(F.lit("N:"), _text("n_nationkey")).alias("id"), label.alias("label")))
    every = n.select(F.col("n_nationkey").alias("o"), node(F.col("n_name")).alias("t")).unionByName(n.where("n_nationkey % 5 = 0").select((F.col("n_nationkey") + 100).alias("o"), node(F.concat("n_name", F.lit(" again"))).alias("t")))
    nodes = _joined(every, F.col("t"), F.col("o"), "", "").first().value
    link = F.to_json(F.struct(F.concat(F.lit("R:"), _text("n_regionkey")).alias("source"), F.concat(F.lit("N:"), _text("n_nationkey")).alias("target"), F.lit("contains").alias("relation")))
    links = _joined(n, link, F.col("n_nationkey"), "", "").first().value
    path = _put(spark.createDataFrame([('{"nodes": [' + nodes + '], "links": [' + links + '], "edges": [{"source": "no", "target": "no"}]}',)], "value string"), "graph")
    g = G.read_graph(spark, path)
    # what is read twice stands behind the 25 others, in order
    place = F.when(F.col("node_pos") >= 25, F.regexp_extract("id", "([0-9]+)", 1).cast("long") + 100).otherwise(F.col("node_pos"))
    return g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), place.alias("pos")).unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("edge_pos").alias("pos")))


@query("select 'p' || page_id as path, case when page_id % 3 = 0 then '' when page_id % 3 = 1 then md5(html) else 'h' || page_id end as md5 from pages")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest: an entry's ``ast_hash`` goes before its ``hash``, one without either has an empty one."""
    k = F.col("page_id") % 3
    entry = F.concat(F.lit('"p'), _text("page_id"), F.lit('": '), F.when(k == 0, "{}").when(k == 1, F.concat(F.lit('{"ast_hash": "'), F.md5("html"), F.lit('", "hash": "other"}'))).otherwise(F.concat(F.lit('{"hash": "h'), _text("page_id"), F.lit('"}'))))
    return G.read_manifest(spark, _put(_joined(table(spark, sf_dir, "pages"), entry, F.col("page_id"), "{", "}"), "manifest"))


@query("select (row_number() over (order by event_id) - 1)::bigint as pos, case when event_id % 2 = 0 then 'taints' else 'tests' end as relation, 'u' || user_id as node, 'f' || (event_id % 9) as file, (event_id % 50)::int as line, event_id % 3 = 0 as skip_self from events")
def findings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral findings with their references and places in the list."""
    k = F.col("event_id")
    f = F.struct(F.when(k % 2 == 0, "taints").otherwise("tests").alias("relation"), F.struct(F.concat(F.lit("u"), _text("user_id")).alias("node")).alias("source_ref"), F.struct(F.concat(F.lit("f"), _text(k % 9)).alias("file"), (k % 50).cast("int").alias("line")).alias("target_ref"), (k % 3 == 0).alias("skip_self"))
    out = G.read_findings(spark, _put(_joined(table(spark, sf_dir, "events"), F.to_json(f), k, '{"edges": [', "]}"), "findings"))
    return out.select("pos", "relation", F.col("source_ref.node").alias("node"), F.col("target_ref.file").alias("file"), F.col("target_ref.line").alias("line"), "skip_self")


@query("select 'V' || s_suppkey as query_id, s_name as description, 'f' || s_nationkey as file, case when s_suppkey % 2 = 0 then s_suppkey::int end as line, case when s_suppkey % 3 = 0 then 'fn' || s_suppkey end as function from supplier")
def report_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vulnerability report under ``vulns``."""
    k = F.col("s_suppkey")
    v = F.struct(F.concat(F.lit("V"), _text(k)).alias("id"), F.col("s_name").alias("description"), F.concat(F.lit("f"), _text("s_nationkey")).alias("file"), F.when(k % 2 == 0, k.cast("int")).alias("line"), F.when(k % 3 == 0, F.concat(F.lit("fn"), _text(k))).alias("function"))
    return G.read_report(spark, _put(_joined(table(spark, sf_dir, "supplier"), F.to_json(v), k, '{"vulns": [', "]}"), "report"))


@query("""select distinct 'src/n' || c_nationkey || '.py' as file, (c_custkey % 40)::int as line, case when c_custkey % 3 = 0 then 'tests/t.py' end as ref_file, case when c_custkey % 3 <> 0 then 'test_' || (c_custkey % 7) end as ref_node from customer""")
def coverage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage contexts as references: test files are left out, a context counts up to its bar, empty ones do not."""
    k = F.col("c_custkey")
    test = F.when(k % 3 == 0, F.lit('"tests/t.py"')).otherwise(F.concat(F.lit('"tests/t.py::Case::test_'), _text(k % 7), F.lit('[a]|run"')))
    per_line = table(spark, sf_dir, "customer").groupBy("c_nationkey", (k % 40).alias("line")).agg(F.concat(F.lit('"'), _text("line"), F.lit('": ["", '), F.array_join(F.sort_array(F.collect_set(test)), ", "), F.lit("]")).alias("t"))
    per_file = per_line.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("t")), ", ").alias("t"))
    body = F.concat(F.lit('"src/n'), _text("c_nationkey"), F.lit('.py": {"contexts": {"x": ["no"], '), F.col("t"), F.lit("}}"))
    rows = scanners.read_coverage(spark, _put(_joined(per_file, body, F.col("c_nationkey"), '{"files": {"tests/t.py": {"contexts": {"1": ["t"]}}, ', "}}"), "coverage"))
    return scanners.coverage_findings(rows).select(F.col("target_ref.file").alias("file"), F.col("target_ref.line").alias("line"), F.col("source_ref.file").alias("ref_file"), F.col("source_ref.node").alias("ref_node"))


@query("""with r as (select event_id as pos, user_id, event_type, event_id % 4 as k from events)
select pos * 2 + unnest(case when k < 2 then [0, 1] else [0] end) as pos, unnest(case when k < 2 then ['taints', 'reaches_sink'] else ['reaches_sink'] end) as relation, case when k < 2 then 'src' || user_id else 'f' || (pos % 9) end as source_file, (case when k < 2 then user_id else pos end % 50)::int as source_line, 'f' || (pos % 9) as target_file, (pos % 50)::int as target_line,
  round(case when k < 2 then 1.0 else 0.9 end * case when event_type = 'error' then 1.0 else 0.9 end, 4)::double as score from r where k < 2 or event_type in ('click', 'error')""")  # fmt: skip
def semgrep_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanner results from their file to findings: a trace in any of its shapes, a declared rule, or nothing."""
    k, u = F.col("event_id"), F.col("user_id")
    at = F.concat(F.lit('{"path": "src'), _text(u), F.lit('", "start": {"line": '), _text(u % 50), F.lit("}}"))
    trace = F.when(k % 4 == 0, F.concat(F.lit('["CliLoc", ['), at, F.lit(', "text"]]'))).when(k % 4 == 1, F.concat(F.lit('{"location": '), at, F.lit("}")))
    more = F.concat(F.lit('{"severity": "'), F.when(F.col("event_type") == "error", "ERROR").otherwise("OTHER"), F.lit('"'), F.coalesce(F.concat(F.lit(', "dataflow_trace": {"taint_source": '), trace, F.lit("}")), F.lit("")), F.lit("}"))
    item = F.concat(F.lit('{"check_id": "Rule.'), F.upper("event_type"), F.lit('", "path": "f'), _text(k % 9), F.lit('", "start": {"line": '), _text(k % 50), F.lit('}, "end": {"line": 1}, "extra": '), more, F.lit("}"))
    rows = scanners.read_semgrep(spark, _put_list(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), item, "event_id", '{"results": [', "]}", "semgrep"))
    first = table(spark, sf_dir, "events").agg(F.min("event_id")).first()[0]
    found, _ = scanners.semgrep_findings(rows.withColumn("pos", F.col("pos") + first), ("click", "error"))
    return found.select("pos", "relation", F.col("source_ref.file").alias("source_file"), F.col("source_ref.line").alias("source_line"), F.col("target_ref.file").alias("target_file"), F.col("target_ref.line").alias("target_line"), F.round("confidence_score", 4).alias("score"))


@query("select 'c' || o_orderkey as commit, 'fix ' || o_orderpriority as subject, 'line' || chr(10) || o_custkey as body, (row_number() over (order by o_orderkey) - 1)::bigint as pos from orders where o_orderkey % 10 = 0")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history whose fields end in NUL and whose records end in SOH: every tenth order is a commit."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0")
    record = F.concat(F.lit("c"), _text("o_orderkey"), F.lit("\x00fix "), F.col("o_orderpriority"), F.lit("\x00line\n"), _text("o_custkey"), F.lit("\x01"))
    out = files.commits(_joined(o, record, F.col("o_orderkey"), "", "", "\n").withColumnRenamed("value", "text"))
    return out.select("commit", "subject", "body", F.col("pos").cast("long").alias("pos"))


@query("select event_id, value from events where event_id % 5 <> 0")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON; bad ones are skipped."""
    line = F.when(F.col("event_id") % 5 == 0, '{"event_id": ').otherwise(F.to_json(F.struct("event_id", "value"), {"ignoreNullFields": "false"}))
    return files.read_jsonl(spark, _put(table(spark, sf_dir, "events").select(line.alias("value")), "lines"), "event_id long, value double")


@query("""with l as (select user_id as key, event_id * 10 as ts, case when event_type = 'click' then 'agent running' when event_type = 'view' then 'resolved=1' else 'other' end as text from events),
k as (select key, max(case when text = 'agent running' then ts end) as since, max(case when text = 'resolved=1' then ts end) as until, max(ts) as seen from l group by key)
select key, since::double as since from k where since is not null and (until is null or until < since) and (select max(ts) from l) - seen < 1800""")  # fmt: skip
def running_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in a log that began and have not ended, and are not idle."""
    text = F.when(F.col("event_type") == "click", "agent running").when(F.col("event_type") == "view", "resolved=1").otherwise("other")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") * 10).cast("double").alias("ts"), text.alias("text"))
    return files.running(log)


@query("""select 'tests/t' || (p_partkey % 9) || '.py::test_' || p_partkey as test, case p_partkey % 3 when 0 then 'PASSED' when 1 then 'FAILED' else 'XFAIL' end as status from part where p_partkey % 4 <> 0
union all select 'suite ' || s_suppkey, case s_suppkey % 3 when 0 then 'PASSED' when 1 then 'FAILED' else 'SKIPPED' end from supplier""")  # fmt: skip
def test_run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two test runners."""
    k = F.col("p_partkey")
    status = F.when(k % 3 == 0, "PASSED").when(k % 3 == 1, "FAILED").otherwise("XFAIL")
    line = F.when(k % 4 == 0, "collected items").otherwise(F.concat(status, F.lit(" tests/t"), _text(k % 9), F.lit(".py::test_"), _text(k), F.lit(" - reason")))
    one = scanners.read_pytest(spark, _put(table(spark, sf_dir, "part").select(line.alias("value")), "pytest"))
    s = F.col("s_suppkey")
    lists = [_joined(table(spark, sf_dir, "supplier").where(s % 3 == r), F.concat(F.lit('{"fullTitle": "suite '), _text(s), F.lit('"}')), s, f'"{name}": [', "]").first().value for r, name in enumerate(("passes", "failures", "pending"))]
    return one.unionByName(scanners.read_mocha(spark, _put(spark.createDataFrame([("{" + ", ".join(lists) + "}",)], "value string"), "mocha")))


@query("""with a as (select c_custkey as key, 'customer' as origin, c_name as name from customer where c_custkey % 2 = 0 union all select s_suppkey, 'supplier', s_name from supplier)
select key, origin, name from a qualify row_number() over (partition by key order by origin) = 1""")  # fmt: skip
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora united; of one key the first corpus's row."""
    part = lambda name, k, n: table(spark, sf_dir, name).select(F.col(k).alias("key"), F.lit(name).alias("origin"), F.col(n).alias("name"))
    return files.union_first_wins([part("customer", "c_custkey", "c_name").where("key % 2 = 0"), part("supplier", "s_suppkey", "s_name")], "key")


# --- text ----------------------------------------------------------------------------------


@query("""with l as (select c_custkey as k, case c_custkey % 3 when 0 then 'src/a.py' when 1 then 'src/b.js' else 'README.md' end as file from customer)
select file, k + 1 as line, case when k % 3 = 0 then 'KEY_' else 'VAR_' end || k as key from l where k % 3 <> 2""")  # fmt: skip
def env_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of environment variables in code, one row a match; other files and lower-case names do not count."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("x = os.environ['KEY_"), _text(k), F.lit("'] or os.getenv('lower')"))).when(k % 3 == 1, F.concat(F.lit("let x = process.env.VAR_"), _text(k))).otherwise("process.env.NOT_CODE")
    name = F.when(k % 3 == 0, "src/a.py").when(k % 3 == 1, "src/b.js").otherwise("README.md")
    # a customer's line follows from its number: lines of the others are empty, as many as lie between it and the one before
    before = F.coalesce(F.lag("k").over(Window.partitionBy("file").orderBy("k")), F.lit(0))
    lines = table(spark, sf_dir, "customer").select(name.alias("file"), k.alias("k"), text.alias("t"))
    lines = lines.withColumn("t", F.concat(F.repeat(F.lit("\n"), (F.col("k") - before).cast("int")), F.col("t")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "")
    return files.env_reads(lines.groupBy("file").agg(body.alias("text"))).select("file", F.col("line").cast("long").alias("line"), "key")


@query("""select '.env' as file, (row_number() over (order by s_suppkey))::int as line, 'KEY_' || s_suppkey as key from supplier union all select 'Dockerfile.dev', (row_number() over (order by s_suppkey))::int, 'ARG_' || s_suppkey from supplier
union all select 'helm/a/b.yaml', (row_number() over (order by s_suppkey))::int, 'YML_' || s_suppkey from supplier""")  # fmt: skip
def env_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in configuration files that lie where configuration lies."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    made = lambda name, head, tail: _joined(s, F.concat(F.lit(head), _text(k), F.lit(tail)), k, "", "", "\n").select(F.lit(name).alias("file"), F.col("value").alias("text"))
    parts = [made(".env", "export KEY_", "=1"), made("Dockerfile.dev", "ENV ARG_", "=x"), made("helm/a/b.yaml", "  YML_", ": 1"), made("src/helm/b.yaml", "  NO_", ": 1"), made("notes.txt", "NO_", "=1")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return files.env_definitions(out)


@query("""select 'q' || p_partkey || '.py' as file, 1 as line, unnest(case p_partkey % 4 when 0 then ['part', 'supplier'] when 1 then ['orders'] when 2 then ['nation'] else ['model_' || p_partkey] end) as "table" from part""")
def table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL tables named in code."""
    k = F.col("p_partkey")
    code = F.when(k % 4 == 0, 'run("select * from part p JOIN `supplier` s")').when(k % 4 == 1, "run('INSERT INTO orders VALUES (1)')").when(k % 4 == 2, 'run("update nation set x = 1")').otherwise(F.concat(F.lit("__tablename__ = 'model_"), _text(k), F.lit("'")))
    return files.table_refs(table(spark, sf_dir, "part").select(F.concat(F.lit("q"), _text(k), F.lit(".py")).alias("file"), code.alias("text")))


@query("""select page_id, case page_id % 4 when 0 then 'src/p' || page_id || '.py' when 1 then 'a/b.ts' end as file, case page_id % 4 when 0 then page_id::int when 1 then 12 end as line from pages""")
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file:line`` as users and scanners write it, and what only looks like it."""
    k = F.col("page_id") % 4
    t = F.when(k == 0, F.concat(F.lit("src/p"), _text("page_id"), F.lit(".py:L"), _text("page_id"))).when(k == 1, "a/b.ts:12").when(k == 2, F.concat(F.lit("nation_"), _text("page_id"), F.lit(":L25"))).otherwise("a.py:x9")
    at = X.file_and_line(t)
    return table(spark, sf_dir, "pages").select("page_id", at["file"].alias("file"), at["line"].alias("line"))


@query("select c_custkey as key, lower(c_name) as name, 'strasse ' || c_custkey as street from customer")
def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full case folding, of plain and of other letters."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return X.with_folded(c, name=F.col("c_name"), street=F.concat(F.lit("STRAßE "), _text("key"))).select("key", "name", "street")


@query("""select doc_id, case doc_id % 4 when 0 then 'key_' || doc_id when 1 then 'a-b' end as key from documents""")
def clean_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without their quotes; computed ones and ones no name can be are none."""
    k = F.col("doc_id") % 4
    key = F.when(k == 0, F.concat(F.lit("'key_"), _text("doc_id"), F.lit("'"))).when(k == 1, '"a-b"').when(k == 2, "[computed]").otherwise(F.concat(_text("doc_id"), F.lit("th")))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_key(key).alias("key"))


@query("select event_id, round(value, 3)::double as value from events where value is not null")
def python_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", X.rounded("value", F.lit(3)).alias("value"))


@query("""with n as (select id, source_file || '.py' as file, line from nodes where source_file is not null union all select 'F:' || k, 'nation_' || k || '.py', 1 from (select distinct s_nationkey as k from supplier))
select id, id like 'F:%' as is_file from n""", graph=True)  # fmt: skip
def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes stand for a file: at line 1, not callable, and named like the file or the end of its path."""
    n = projection.nodes(spark, sf_dir).where("source_file is not null").select("id", "label", F.concat("source_file", F.lit(".py")).alias("source_file"), "source_location", "_callable")
    s = table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    name = F.concat(F.lit("nation_"), _text("s_nationkey"), F.lit(".py"))
    own = s.select(F.concat(F.lit("F:"), _text("s_nationkey")).alias("id"), name.alias("label"), name.alias("source_file"), F.lit("L1").alias("source_location"), F.lit(None).cast("boolean").alias("_callable"))
    return n.unionByName(own).select("id", X.is_file_node(F.col("source_file"), F.col("source_location"), F.col("label"), F.col("_callable")).alias("is_file"))


@query("""with adj as (select source as id, target as next from edges where relation in ('calls', 'references') and target not like 'O:%7'), w1 as (select distinct next as id from adj where id = 'C:1'), w2 as (select distinct next as id from adj where id in (select id from w1))
select id, min(depth)::int as depth from (select 'C:1' as id, 0 as depth union all select id, 1 from w1 union all select id, 2 from w2) group by id""", graph=True)  # fmt: skip
def dangling_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that are no nodes are neither found nor walked through: orders whose number ends in 7 are missing here."""
    from .operators import traverse

    n, e = _graph(spark, sf_dir, distinct=False)
    seeds = spark.createDataFrame([("C:1", "C:1")], "query_id string, id string")
    return traverse.radius(n.where("id not like 'O:%7'"), e, seeds, 2, "down", ("calls", "references"), members=False).select("id", "depth")


# --- evaluation and state --------------------------------------------------------------------


@query("""with r as (select o_custkey as query_id, o_orderkey as id, o_totalprice as score, case when o_orderkey % 4 = 0 then 'omitted' else 'body' end as tier, row_number() over (partition by o_custkey order by o_orderkey) = 1 as is_seed from orders),
f as (select query_id, min(score) as floor from r where tier = 'body' and not is_seed group by query_id)
select r.query_id, r.id, case when score >= coalesce(floor, 0) then 'truncated_high_rank' else 'truncated_low_rank' end as severity from r left join f using (query_id) where tier = 'omitted'""")  # fmt: skip
def severity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was left out although it ranks above something kept."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 4 == 0, "omitted").otherwise("body").alias("tier"))
    return rank.severity(o.withColumn("seed", F.min("id").over(Window.partitionBy("query_id")))).select("query_id", "id", "severity")


@query("select o_custkey as task, greatest(30 - count(*), 0) * avg(o_totalprice) / 2 / 60 as minutes from orders group by 1")
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return done.select("task", evaluate.eta_minutes(F.col("n"), F.lit(30), F.col("mean"), F.lit(2)).alias("minutes"))


@query("""with e as (select source, relation, target from edges where source in ('O:7', 'O:8', 'N:3')), a as (select * from e where not (source = 'O:7' and relation = 'references'))
select id, not exists (select 1 from ((select * from e except select * from a) union all (select * from a except select * from e)) where source = id or target = id) as clean from (values ('O:7'), ('O:8'), ('N:3')) t(id)""", graph=True)  # fmt: skip
def edge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a node's edges are what a snapshot of them says."""
    e = projection.edges(spark, sf_dir).where("source in ('O:7', 'O:8', 'N:3')").select("source", "relation", "target")
    ids = spark.createDataFrame([("O:7",), ("O:8",), ("N:3",)], "id string")
    keys = ("source", "target", "relation")
    path = lineage.new_path(spark, "snapshot")
    tables.write_snapshot(diff.fingerprints(e, ids, keys), path)
    now = diff.fingerprints(e.where("not (source = 'O:7' and relation = 'references')"), ids, keys)
    changed = diff.fingerprint_diff(spark.read.parquet(path), now).select("id", F.lit(False).alias("clean"))
    return ids.join(changed, "id", "left").select("id", F.coalesce("clean", F.lit(True)).alias("clean"))


@query(f"""with {_DEFS_SQL}, kept as (select file || '::' || cls as id, file from m group by 1, 2 union all select file || '::' || cls || '.customer_' || c, file from m where c % 2 = 0 union all select replace(file, '.', '_'), file from m group by 1, 2),
new as (select lower('nation_' || k || '_py_' || cls || '_customer_' || c) as id from m where c % 2 = 1) select id, false as ours from kept union all select id, true from new""")  # fmt: skip
def supplemented_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a graph with its supplement, applied twice: the second time changes nothing."""
    defs = _parsed(_sources(spark, sf_dir))
    nodes = _modelled(spark, defs)
    edges = spark.createDataFrame([], "source string, target string, relation string, confidence string, origin string, detail string")
    once = supplement.apply(nodes, edges, defs)
    twice = supplement.apply(lineage.cut(once[0], "nodes"), lineage.cut(once[1], "edges"), defs)
    return twice[0].select("id", F.coalesce(F.col("origin") == supplement.SUPPLEMENTED, F.lit(False)).alias("ours"))


@query(f"with {_DEFS_SQL} select file, cls || '.customer_' || c as name, 'def customer_' || c || '(self)' as signature from m union all select distinct file, cls, 'class ' || cls from m union all select file, cls || '.customer_' || c || '.inner_' || c, 'def inner_' || c || '()' from m where c % 3 = 0")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of definitions."""
    return symbols.definitions(_sources(spark, sf_dir)).select("file", "name", F.regexp_replace("signature", r": return 1$", "").alias("signature"))


@query("""with f as (select page_id as k, 'p' || page_id as path from pages) select path, case when k % 5 = 0 then 'deleted' when k % 5 = 1 then 'edited' when k % 5 = 2 then 'added' end as reason, k % 5 = 1 and k % 2 = 0 as still_stale from f where k % 5 < 3""")
def refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh had to do, and which files changed once more while it ran."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(k.alias("k"), F.concat(F.lit("p"), _text(k)).alias("path"))
    manifest = p.where("k % 5 <> 2").select("path", F.lit("1").alias("md5"))
    now = p.where("k % 5 <> 0").select("k", "path", F.lit("text").alias("text"), F.when(F.col("k") % 5 == 1, "2").otherwise("1").alias("md5"))
    later = now.select("path", F.when((F.col("k") % 5 == 1) & (F.col("k") % 2 == 0), "3").otherwise(F.col("md5")).alias("md5"))
    return state.refresh(p.select("path"), manifest, now.select("path", "text", "md5"), lambda f: f.select("path"), later)[1]


@query("""select 'main' as slot, c_custkey as key from customer where c_custkey % 2 = 0 union all select 'topic', c_custkey from customer where c_custkey % 3 = 0 union all select 'seeded', c_custkey from customer where c_custkey % 2 = 0""")
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots side by side: a slot is replaced and the others stay; a new one begins as a copy of the active one."""
    c, path = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), lineage.new_path(spark, "slots")
    state.write_slot(c.where("key % 2 = 0"), path, "main")
    state.seed_slot(spark, path, "main", "topic")
    state.write_slot(c.where("key % 3 = 0"), path, "topic")
    state.seed_slot(spark, path, "main", "seeded")
    out = None
    for name in ("main", "topic", "seeded"):
        part = state.read_slot(spark, path, name).select(F.lit(name).alias("slot"), "key")
        out = part if out is None else out.unionByName(part)
    return out
