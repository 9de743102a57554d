"""Nodes and edges for definitions that the extraction missed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_callable, is_file_node, leaf_any_parens, location_line, slug
from ..schema import SUPPLEMENTED
from .edges import tiered_callees, unmodelled
from .symbols import nested_in_function


def stale_files(nodes: DataFrame, defs: DataFrame, manifest: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``file, reason`` of files that the graph no longer matches: the hash differs, or a callable stands where no definition begins."""
    calls = nodes.where(is_callable(F.col("_callable"), F.col("label"))).select(F.col("source_file").alias("file"), location_line(F.col("source_location")).alias("def_line")).where("def_line is not null")
    parsed = defs.where("status = 'ok'")
    orphan = calls.join(parsed.select("file").distinct(), "file", "left_semi").join(parsed.select("file", "def_line"), ["file", "def_line"], "left_anti").select("file").distinct().withColumn("reason", F.lit("orphan_callable"))
    if manifest is None or files is None:
        return orphan
    edited = manifest.select(F.col("path").alias("file"), F.col("md5").alias("known")).join(files.select("file", "md5"), "file").where("known <> md5").select("file", F.lit("hash_differs").alias("reason"))
    return edited.unionByName(orphan.join(edited, "file", "left_anti"))


def compute(nodes: DataFrame, defs: DataFrame, stale: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, skipped) to add. Definitions nested in functions are skipped; stale files are left out whole."""
    file_nodes = nodes.where(is_file_node(F.col("source_file"), F.col("source_location"), F.col("label"), F.col("_callable"))).groupBy(F.col("source_file").alias("file")).agg(F.min("id").alias("file_id"))
    d = defs.where("status = 'ok'").join(file_nodes, "file")
    if stale is not None:
        d = d.join(stale.select("file"), "file", "left_anti")
    d = d.withColumn("leaf", F.substring_index("name", ".", -1))
    nested = nested_in_function(d)
    missing = unmodelled(d, nodes)
    skipped = missing.join(nested, ["file", "name", "def_line"], "left_semi").select("file", "name", "def_line", F.lit("nested_in_function").alias("reason"))
    fresh = missing.join(nested, ["file", "name", "def_line"], "left_anti").withColumn("owner", F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.[^.]*$", "")))
    kinds = d.groupBy("file", F.col("name").alias("owner")).agg(F.max("kind").alias("owner_kind"))
    known = nodes.where(is_callable(F.col("_callable"), F.col("label"))).select(F.col("source_file").alias("file"), leaf_any_parens(F.col("label")).alias("leaf")).distinct().withColumn("taken", F.lit(True))
    fresh = fresh.join(kinds, ["file", "owner"], "left").join(known, ["file", "leaf"], "left")
    method = F.coalesce(F.col("owner_kind") == "class", F.lit(False))
    again = F.row_number().over(Window.partitionBy("file", "leaf").orderBy("def_line", "name")) > 1
    reason = F.when(F.col("taken").isNotNull() | again, "id_collision_or_overload").when(F.col("owner").isNotNull() & F.col("owner_kind").isNull(), "assignment_bound_member").otherwise("absent_from_extraction")
    fresh = fresh.withColumn("reason", reason).withColumn("is_method", method).withColumn("base", slug(F.concat_ws("_", "file_id", F.translate("name", ".", "_"))))
    # ids already taken, then one suffix after the other in order of lines
    order = Window.partitionBy("base").orderBy("file", "def_line", "name")
    used = nodes.select(F.col("id").alias("base")).distinct().withColumn("used", F.lit(1))
    fresh = fresh.join(used, "base", "left").withColumn("n", F.row_number().over(order) - 1 + F.coalesce("used", F.lit(0)))
    line = F.concat(F.lit("_l"), F.col("def_line").cast("string"))
    twin = F.row_number().over(Window.partitionBy("base", "def_line").orderBy("file", "name"))
    fresh = fresh.withColumn("twin", twin).withColumn("id", F.when(F.col("n") == 0, F.col("base")).when(F.col("twin") == 1, F.concat("base", line)).otherwise(F.concat("base", line, F.lit("_"), F.col("twin").cast("string"))))
    function = F.col("kind") == "function"
    label = F.when(~function, F.col("leaf")).when(F.col("is_method"), F.concat(F.lit("."), F.col("leaf"), F.lit("()"))).otherwise(F.concat("leaf", F.lit("()")))
    new_nodes = fresh.select(
        "id", label.alias("label"), F.lit("code").alias("file_type"), F.col("file").alias("source_file"), F.concat(F.lit("L"), F.col("def_line").cast("string")).alias("source_location"),
        F.when(function, True).alias("_callable"), F.lit(SUPPLEMENTED).alias("origin"), F.col("name").alias("qualified_name"), "kind", F.col("reason").alias("supplement_reason"),
    )
    # owners: a definition of this run, else the node that models the class
    modelled = d.join(nodes.select("id", F.col("source_file").alias("file"), location_line(F.col("source_location")).alias("def_line"), leaf_any_parens(F.col("label")).alias("leaf")), ["file", "def_line", "leaf"]).select("file", "name", "kind", "calls", F.col("id"))
    every = modelled.withColumn("is_new", F.lit(False)).unionByName(fresh.select("file", "name", "kind", "calls", "id").withColumn("is_new", F.lit(True)))
    owners = every.groupBy("file", F.col("name").alias("owner")).agg(F.min("id").alias("owner_id"))
    owned = fresh.join(owners, ["file", "owner"], "left").withColumn("by_class", F.col("is_method") & F.col("owner_id").isNotNull())
    edge = lambda df, s, t, rel, conf, detail: df.select(s.alias("source"), t.alias("target"), rel.alias("relation"), F.lit(conf).alias("confidence"), F.lit(SUPPLEMENTED).alias("origin"), detail.alias("detail"))
    parents = edge(owned, F.when(F.col("by_class"), F.col("owner_id")).otherwise(F.col("file_id")), F.col("id"), F.when(F.col("by_class"), "method").otherwise("contains"), "EXTRACTED", F.concat(F.lit("supplement:"), F.col("reason")))
    old = nodes.where(is_callable(F.col("_callable"), F.col("label")) & F.col("source_file").isNotNull()).select("id", F.col("source_file").alias("file"), leaf_any_parens(F.col("label")).alias("name"))
    callables = old.unionByName(fresh.where(function).select("id", "file", F.col("leaf").alias("name")))
    calls = every.where("kind = 'function'").select(F.col("id").alias("source"), "file", F.substring_index("name", ".", -1).alias("own"), F.explode("calls").alias("callee")).where("callee <> own")
    fresh_ids = fresh.select(F.col("id").alias("x"))
    met = tiered_callees(calls.select("source", "file", "callee"), callables)
    met = met.join(fresh_ids.withColumnRenamed("x", "source"), "source", "left_semi").union(met.join(fresh_ids.withColumnRenamed("x", "target"), "target", "left_semi").select("source", "target", "scope")).distinct()
    called = edge(met, F.col("source"), F.col("target"), F.lit("calls"), "INFERRED", F.concat(F.lit("supplement:name-match("), F.col("scope"), F.lit(")")))
    return new_nodes, parents.unionByName(called), skipped


def remove(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without supplemented nodes and without any edge that touches one."""
    ours = nodes.where(F.col("origin") == SUPPLEMENTED).select("id")
    kept = edges.where(~F.col("origin").eqNullSafe(F.lit(SUPPLEMENTED))).join(ours.withColumnRenamed("id", "source"), "source", "left_anti").join(ours.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.where(~F.col("origin").eqNullSafe(F.lit(SUPPLEMENTED))), kept


def apply(nodes: DataFrame, edges: DataFrame, defs: DataFrame, stale: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph with its supplement; what an earlier run added is replaced, so applying twice changes nothing."""
    n, e = remove(nodes, edges)
    new_nodes, new_edges, _ = compute(n, defs, stale)
    return n.unionByName(new_nodes, allowMissingColumns=True), e.unionByName(new_edges, allowMissingColumns=True)
