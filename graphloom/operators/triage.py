"""Triage of a vulnerability report: one traversal for all its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..schema import TRAVERSAL_RELATIONS
from .resolve import resolve
from .traverse import closure_edges, neighbours, overrides, radius, taint_exposed


def seeds_of(report: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, id``: each finding resolved by its function, else its file and line, else its file; null if none fits."""
    place = F.when(F.col("line").isNotNull(), F.concat("file", F.lit(":L"), F.col("line").cast("string")))
    asked = report.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("function").alias("q")), F.struct(F.lit(1).alias("k"), place.alias("q")), F.struct(F.lit(2).alias("k"), F.when(place.isNull(), F.col("file")).alias("q")))).alias("a")).where("a.q is not null")
    asked = asked.select(F.concat_ws("\x00", "query_id", F.col("a.k").cast("string")).alias("query_id"), F.col("a.q").alias("query"), F.col("query_id").alias("vuln"), F.col("a.k").alias("k"))
    got = asked.join(resolve(asked.select("query_id", "query"), nodes), "query_id").groupBy("vuln").agg(F.min_by("id", "k").alias("id"))
    return report.select("query_id").join(got.withColumnRenamed("vuln", "query_id"), "query_id", "left")


def triage(report: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, direction: str = "up", relations: tuple[str, ...] = TRAVERSAL_RELATIONS, max_nodes: int | None = 300) -> DataFrame:
    """One row a finding: seed (null if unresolved), reach, truncation, callers, callees, taint-exposed nodes, overrides, covering tests and configuration read."""
    seeds = cut(seeds_of(report, nodes), "seeds")
    known = seeds.where("id is not null")
    reach = cut(radius(nodes, edges, known, depth, direction, relations, max_nodes), "reach")
    closure = cut(closure_edges(edges, reach), "closure")
    lists = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias(name))
    # edges at a seed, read once for all that asks about them
    own = known.select("id").distinct()
    at = cut(edges.join(own.withColumnRenamed("id", "source"), "source").select("source", "target", "relation").unionByName(edges.join(own.withColumnRenamed("id", "target"), "target").select("source", "target", "relation")).distinct(), "near")
    near = neighbours(nodes, at, known, relations)
    tests = at.where("relation = 'tests'").join(known.select("query_id", F.col("id").alias("target")), "target").select("query_id", F.col("source").alias("id"))
    config = at.where("relation = 'reads_config'").join(known.select("query_id", F.col("id").alias("source")), "source").select("query_id", F.col("target").alias("id"))
    parts = [
        reach.groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.bool_or("truncated").alias("truncated")), closure.groupBy("query_id").agg(F.count("*").alias("n_edges")),
        lists(near.where("role = 'caller'"), "callers"), lists(near.where("role = 'callee'"), "callees"), lists(taint_exposed(closure)[1], "exposed"),
        lists(overrides(nodes, edges, known), "overrides"), lists(tests, "covered_by"), lists(config, "config"),
    ]
    out = report.select("query_id", "description").join(seeds.withColumnRenamed("id", "seed"), "query_id")
    for p in parts:
        out = out.join(p, "query_id", "left")
    return out


def summarize(rows: DataFrame) -> DataFrame:
    """``query_id, text``: one line a finding, as it is shown."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    found = F.format_string(
        "- %s: %s [radius: %d nodes/%d edges%s; taint-exposed: %d; %s; overrides: %d; config deps: %d]", F.col("query_id"), F.col("seed"), F.coalesce("n_nodes", F.lit(0)), F.coalesce("n_edges", F.lit(0)),
        F.when(F.col("truncated"), ", TRUNCATED").otherwise(""), size("exposed"), F.when(size("covered_by") > 0, "covered").otherwise("NO TEST COVERAGE"), size("overrides"), size("config"),
    )
    return rows.select("query_id", F.when(F.col("seed").isNull(), F.format_string("- %s: UNRESOLVED", F.col("query_id"))).otherwise(found).alias("text"))
