"""Output of analysers as neutral findings: Semgrep results, flows, coverage, test runs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import is_test_path, severity_score
from ..plans.lineage import cut
from ..schema import ASSUMED_TAINT


def _ref(file: Column, line: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("node"), file.alias("file"), line.cast("int").alias("line"))


def _located(x) -> tuple[str, int | None] | None:
    """The first place in a trace end, however deep: ``[location, text]``, ``{path, start}``, ``{location: ...}``."""
    todo = [x]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            if isinstance(x.get("path"), str):
                start = x.get("start")
                line = start.get("line") if isinstance(start, dict) else None
                return x["path"], line if isinstance(line, int) else None
            todo = [x["location"], *todo] if "location" in x else todo
        elif isinstance(x, list):
            todo = x + todo
    return None


@F.pandas_udf(T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType())]))
def location(trace: pd.Series) -> pd.DataFrame:
    """``struct<file, line>`` of a trace end given as JSON; both null where it names no place."""
    found = []
    for text in trace:
        try:
            found.append((text is not None and _located(json.loads(text))) or (None, None))
        except ValueError:
            found.append((None, None))
    return pd.DataFrame(found, columns=["file", "line"]).astype({"line": "Int32"})


#: The key that each result begins with, and the value of it that marks an end put in by the reader.
_KEY, _END = '"check_id"', "\x01end"
_RESULTS = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:string>>>"


def read_semgrep(spark: SparkSession, path: str) -> DataFrame:
    """``pos, check_id, file, line, severity, message, trace`` (JSON text) of each result, ``pos`` being its place in its file.

    A file is read in pieces, each of them a result and what stands between it
    and the next, by as many tasks as it has splits. Where pieces are no single
    results (other keys go first, or stand in other lists), it is parsed whole.
    """
    r = _semgrep_pieces(spark, path)
    if r is None:
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", _RESULTS).alias("r"))
        r = text.select(F.posexplode("r.results").alias("pos", "x"))
    get = lambda p: F.get_json_object("x.extra", p)
    return r.select(F.col("pos").cast("long").alias("pos"), "x.check_id", F.col("x.path").alias("file"), F.col("x.start.line").alias("line"), get("$.severity").alias("severity"), get("$.message").alias("message"), get("$.dataflow_trace.taint_source").alias("trace"))


def _semgrep_pieces(spark: SparkSession, path: str) -> DataFrame | None:
    """``pos, x`` of files cut at ``_KEY``; none unless each piece proves to be one whole result.

    The brace before the next key is completed to an object that marks the end:
    a piece is right if its list holds just the result and that object, so
    nothing else can hide before, behind or between.
    """
    text = spark.read.option("lineSep", _KEY).text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("in_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    head, opens = ~F.col("value").rlike(r"^\s*:"), F.col("value").rlike(r"\{\s*$")
    closed = F.when(opens, F.concat(F.regexp_replace("value", r"\{\s*$", ""), F.lit(f'{{{_KEY}: "\\u0001end"}}]}}'))).otherwise(F.col("value"))
    whole = F.when(head, closed).otherwise(F.concat(F.lit(f'{{"results": [{{{_KEY}'), closed))
    rows = text.select("in_file", "block", "id", head.alias("head"), opens.alias("opens"), F.from_json(whole, _RESULTS)["results"].alias("r"))
    size = F.coalesce(F.size("r"), F.lit(0)) == F.when(F.col("head"), 0).otherwise(1) + F.col("opens").cast("int")
    ended = ~F.col("opens") | F.coalesce(F.element_at("r", -1)["check_id"] == _END, F.lit(False))
    rows = cut(rows.select("in_file", "block", "id", "head", "opens", F.when(size, size & ended).otherwise(False).alias("right"), F.when(~F.col("head"), F.get("r", F.lit(0))).alias("x")), "pieces")
    blocks = rows.groupBy("in_file", "block").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.count_if("head").alias("heads"), F.count_if(~F.col("opens")).alias("ends"), F.count_if(~F.col("right")).alias("wrong"))
    if not blocks.groupBy("in_file").agg(F.sum("heads").alias("heads"), F.sum("ends").alias("ends"), F.sum("wrong").alias("wrong")).where("heads <> 1 or ends <> 1 or wrong > 0").isEmpty():
        return None
    before = F.sum("n").over(Window.partitionBy("in_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    place = blocks.select("in_file", "block", "low", F.coalesce(before, F.lit(0)).alias("before"))
    # the head is the first piece of its file
    return rows.where("not head").join(F.broadcast(place), ["in_file", "block"]).select((F.col("before") + F.col("id") - F.col("low") - 1).alias("pos"), "x")


def classify(results: DataFrame, taint_rules: tuple[str, ...] = (), assume_taint: bool = False) -> DataFrame:
    """Results with ``class`` and ``score``: a trace; else a declared rule (part of its name, case ignored) or ``assume_taint``, at nine tenths of its score; else skipped."""
    declared = F.lit(assume_taint)
    for rule in taint_rules:
        declared = declared | F.lower("check_id").contains(rule.lower())
    kind = F.when(F.col("trace").isNotNull(), "trace").when(declared, "declared").otherwise("skipped")
    score = severity_score(F.col("severity"))
    return results.withColumn("class", kind).withColumn("score", F.when(F.col("class") == "trace", score).when(F.col("class") == "declared", score * ASSUMED_TAINT))


def semgrep_findings(results: DataFrame, taint_rules: tuple[str, ...] = (), assume_taint: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, skipped): a trace gives ``taints`` and ``reaches_sink`` from source to sink, a declared rule ``reaches_sink`` at its own place."""
    c = classify(results, taint_rules, assume_taint).withColumn("at", location(F.col("trace")))
    here = _ref(F.col("file"), F.col("line"))
    there = F.when(F.col("at.file").isNotNull(), _ref(F.col("at.file"), F.col("at.line"))).otherwise(here)
    make = lambda relation, source: F.struct(F.lit(relation).alias("relation"), source.alias("source_ref"), here.alias("target_ref"))
    rows = F.when(F.col("class") == "trace", F.array(make("taints", there), make("reaches_sink", there))).otherwise(F.array(make("reaches_sink", here)))
    found = c.where("class <> 'skipped'").select("pos", F.posexplode(rows).alias("k", "f"), F.col("check_id").alias("detail"), F.col("score").alias("confidence_score"))
    out = found.select("f.*", "detail", F.lit(None).cast("string").alias("confidence"), "confidence_score", F.lit(False).alias("skip_self"), (F.col("pos") * 2 + F.col("k")).alias("pos"))
    return out, c.where("class = 'skipped'").select("check_id", "file", "line", F.lit("no trace and no declared rule").alias("reason"))


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """``flow, pos, rule, file, line`` of located elements; an object with ``flows`` or a bare list, elements plain or with ``location``."""
    text = spark.read.text(path, wholetext=True)
    flows = F.coalesce(F.get_json_object("value", "$.flows"), F.col("value"))
    each = text.select(F.posexplode(F.from_json(flows, "array<string>")).alias("flow", "f"))
    path_ = F.coalesce(F.get_json_object("f", "$.path"), F.get_json_object("f", "$.elements"), F.when(F.ltrim("f").startswith("["), F.col("f")))
    els = each.select("flow", F.get_json_object("f", "$.rule").alias("rule"), F.posexplode(F.from_json(path_, "array<string>")).alias("pos", "e"))
    get = lambda *ps: F.coalesce(*[F.get_json_object("e", p) for p in ps])
    rows = els.select("flow", "pos", "rule", get("$.file", "$.location.filename", "$.filename").alias("file"), get("$.line", "$.location.lineNumber.value", "$.location.lineNumber", "$.lineNumber").try_cast("int").alias("line"))
    return rows.where("file is not null and file <> '' and line >= 0")


def without_sanitizer(elements: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Elements of the flows that pass through none of the sanitizing ``methods`` (column ``method``)."""
    safe = elements.where(F.col("method").isin(*methods)).select("flow").distinct()
    return elements.join(safe, "flow", "left_anti")


def flow_findings(elements: DataFrame, rule: str = "flow") -> DataFrame:
    """End to end ``taints`` and ``reaches_sink`` for each flow with two located elements or more, and ``taints`` between neighbours, which must not be self-edges."""
    located = F.struct("pos", "file", "line")
    ends = elements.groupBy("flow").agg(F.min(located).alias("a"), F.max(located).alias("b"), F.count("*").alias("n"), F.max("rule").alias("rule")).where("n >= 2")
    make = lambda relation: ends.select("flow", F.lit(-1).alias("pos"), F.lit(relation).alias("relation"), _ref(F.col("a.file"), F.col("a.line")).alias("source_ref"), _ref(F.col("b.file"), F.col("b.line")).alias("target_ref"), F.lit(False).alias("skip_self"), "rule")
    w = Window.partitionBy("flow").orderBy("pos")
    steps = elements.withColumn("next", F.lead(F.struct("file", "line")).over(w)).where("next is not null")
    steps = steps.select("flow", "pos", F.lit("taints").alias("relation"), _ref(F.col("file"), F.col("line")).alias("source_ref"), _ref(F.col("next.file"), F.col("next.line")).alias("target_ref"), F.lit(True).alias("skip_self"), "rule")
    out = make("taints").unionByName(make("reaches_sink")).unionByName(steps)
    return out.select("relation", "source_ref", "target_ref", F.coalesce("rule", F.lit(rule)).alias("detail"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("double").alias("confidence_score"), "skip_self", (F.col("flow").cast("long") * 100000 + F.col("pos")).alias("pos"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, test``: which test ran which line of a production file; a context counts up to its ``|``."""
    kind = "struct<files:map<string,struct<contexts:map<string,array<string>>>>>"
    files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["files"]).alias("file", "f"))
    per_line = files.where(~is_test_path(F.col("file"))).select("file", F.explode("f.contexts").alias("line", "tests"))
    rows = per_line.select("file", F.col("line").try_cast("int").alias("line"), F.explode("tests").alias("test"))
    return rows.select("file", "line", F.substring_index("test", "|", 1).alias("test")).where("line is not null and test <> ''")


def context_ref(test: Column) -> Column:
    """A test id as reference: the last name of ``a::B::f[x]`` as node, a path as file, anything else as node."""
    name = F.regexp_replace(F.substring_index(test, "::", -1), r"\[.*$", "")
    is_path = ~test.contains("::") & (test.contains("/") | test.endswith(".py"))
    return F.struct(F.when(~is_path, name).alias("node"), F.when(is_path, test).alias("file"), F.lit(None).cast("int").alias("line"))


def coverage_findings(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("tests").alias("relation"), context_ref(F.col("test")).alias("source_ref"), _ref(F.col("file"), F.col("line")).alias("target_ref"), F.lit("coverage").alias("detail")).distinct()


def read_pytest(spark: SparkSession, path: str) -> DataFrame:
    """``test, status`` of ``-rA`` summary lines."""
    found = r"^(PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS) (\S+)"
    lines = spark.read.text(path).where(F.col("value").rlike(found))
    return lines.select(F.regexp_extract("value", found, 2).alias("test"), F.regexp_extract("value", found, 1).alias("status"))


def read_mocha(spark: SparkSession, path: str) -> DataFrame:
    kind = T.ArrayType(T.StructType([T.StructField("fullTitle", T.StringType())]))
    text = spark.read.text(path, wholetext=True)
    part = lambda key, status: text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{key}"), kind)).alias("t")).select(F.col("t.fullTitle").alias("test"), F.lit(status).alias("status"))
    return part("passes", "PASSED").unionByName(part("failures", "FAILED")).unionByName(part("pending", "SKIPPED"))
