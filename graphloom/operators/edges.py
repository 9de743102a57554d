"""Edges from other producers: validation, upsert, idempotent merge, name and key links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bare, is_test_path, leaf, leaf_any_parens, location_line, with_folded
from ..schema import INJECTABLE_RELATIONS, INJECTED
from .resolve import resolve
from .traverse import first_wins


def finding_key(*cols: str) -> Column:
    """Canonical JSON of the columns, in name order, without null fields: what a fingerprint consists of."""
    return F.to_json(F.struct(*sorted(cols)))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored findings with the incoming ones merged in: a new row replaces the old one in its place, others follow. Both have ``pos``."""
    both = stored.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    newest = F.row_number().over(w.orderBy(F.desc("_gen"), F.desc("pos")))
    place = F.min(F.struct("_gen", "pos")).over(w)
    kept = both.withColumn("_newest", newest).withColumn("place", place).where("_newest = 1")
    return kept.select(*[c for c in both.columns if c not in ("_gen", "pos")], F.col("place._gen").alias("generation"), F.col("place.pos").alias("pos"))


def without_origin(edges: DataFrame, origin: str = INJECTED) -> DataFrame:
    """Edges of other producers; an edge without origin stays."""
    return edges.where(~F.col("origin").eqNullSafe(F.lit(origin)))


def validated(findings: DataFrame) -> DataFrame:
    """Findings (relation, source_id, target_id, skip_self) with ``reason``: why one cannot be an edge, null if it can."""
    self_edge = (F.col("source_id") == F.col("target_id")) & F.coalesce("skip_self", F.lit(False))
    return findings.withColumn("reason", F.when(~F.col("relation").isin(*INJECTABLE_RELATIONS), "unknown_relation").when(F.col("source_id").isNull(), "unresolved_source").when(F.col("target_id").isNull(), "unresolved_target").when(self_edge, "self_edge"))


def ref_text(ref: Column) -> Column:
    """A reference as the text the resolution ladder takes: the node, else ``file:line``, else the file."""
    return F.coalesce(ref["node"], F.when(ref["line"].isNotNull(), F.concat(ref["file"], F.lit(":L"), ref["line"].cast("string"))), ref["file"])


def resolve_findings(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings with ``source_id`` and ``target_id``. Distinct references are resolved once; one with a line is never taken for its whole file."""
    f = findings.withColumn("_s", ref_text(F.col("source_ref"))).withColumn("_t", ref_text(F.col("target_ref")))
    refs = f.select(F.col("_s").alias("query")).union(f.select(F.col("_t").alias("query"))).where("query is not null").distinct().withColumn("query_id", F.col("query"))
    known = resolve(refs, nodes).select("query_id", "id")
    f = f.join(known.select(F.col("query_id").alias("_s"), F.col("id").alias("source_id")), "_s", "left")
    return f.join(known.select(F.col("query_id").alias("_t"), F.col("id").alias("target_id")), "_t", "left").drop("_s", "_t")


def merge(edges: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, report): own earlier edges go, valid findings come, once each; merging again changes nothing.

    ``findings`` are validated rows with ``pos``. The report counts applied,
    removed and each reason of refusal.
    """
    kept = without_origin(edges)
    valid = findings.where("reason is null").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation", F.coalesce("confidence", F.lit("EXTERNAL")).alias("confidence"), "confidence_score", F.lit(INJECTED).alias("origin"), "detail", "pos")
    new = first_wins(valid, ["source", "target", "relation"], F.col("pos"))
    counts = findings.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    report = counts.unionByName(new.select(F.lit("applied").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))).unionByName(edges.where(F.col("origin") == INJECTED).select(F.lit("removed").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")))
    return kept.unionByName(new.drop("pos"), allowMissingColumns=True), report


def unique_name_links(nodes: DataFrame, strip_dots: bool = False) -> DataFrame:
    """``test_id, target_id``: a test named after exactly one labelled node outside the tests, case folded. ``strip_dots`` also links members."""
    name = leaf if strip_dots else bare
    n = with_folded(nodes.where("id is not null and label <> ''").select("id", "label", is_test_path(F.col("source_file")).alias("is_test")), folded=F.col("label"))
    n = n.select("id", name(F.col("folded")).alias("name"), "is_test")
    tests = n.where("is_test").withColumn("target", F.regexp_extract("name", r"(?U)^test[_ ]?(\w+)$", 1)).where("target <> ''")
    single = n.where("not is_test").groupBy(F.col("name").alias("target")).agg(F.count("*").alias("n"), F.min("id").alias("target_id")).where("n = 1")
    return tests.join(single, "target").select(F.col("id").alias("test_id"), "target_id")


def known_definitions(nodes: DataFrame) -> DataFrame:
    """``file, def_line, leaf`` of what the graph already models; the leaf of a qualified name is a second key."""
    n = nodes.select(F.col("source_file").alias("file"), location_line(F.col("source_location")).alias("def_line"), leaf_any_parens(F.col("label")).alias("leaf"), F.substring_index("qualified_name", ".", -1).alias("other")).where("file is not null and def_line is not null")
    return n.select("file", "def_line", F.explode(F.array_distinct(F.array_compact(F.array("leaf", "other")))).alias("leaf")).distinct()


def unmodelled(definitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Definitions (file, name, def_line, ...) that no node stands for."""
    d = definitions.withColumn("leaf", F.substring_index("name", ".", -1))
    return d.join(known_definitions(nodes), ["file", "def_line", "leaf"], "left_anti")


def tiered_callees(calls: DataFrame, callables: DataFrame) -> DataFrame:
    """``source, target, scope``: the one callable of that name in the caller's file, else the one in the whole graph, else nothing.

    ``calls``: source, file, callee. Names known more than once stay unlinked.
    """
    local = callables.groupBy("file", "name").agg(F.count("*").alias("n"), F.min("id").alias("local")).where("n = 1").select("file", F.col("name").alias("callee"), "local")
    whole = callables.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("whole")).where("n = 1").select(F.col("name").alias("callee"), "whole")
    met = calls.join(local, ["file", "callee"], "left").join(whole, "callee", "left").withColumn("target", F.coalesce("local", "whole")).where("target is not null and target <> source")
    return met.select("source", "target", F.when(F.col("local").isNotNull(), "same-file").otherwise("graph-unique").alias("scope")).distinct()


def key_links(reads: DataFrame, definitions: DataFrame, key: str = "key") -> DataFrame:
    """Every read joined with every definition of its key: ``source, target, key``."""
    return reads.select("source", key).join(definitions.select("target", key), key).select("source", "target", key).distinct()


def table_links(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """References to SQL tables the graph knows, case ignored, to each definition: ``source, target, table``."""
    t = tables.select("target", F.lower("table").alias("table"))
    return refs.select("source", F.lower("table").alias("table")).distinct().join(t, "table").select("source", "target", "table").distinct()


def related_tests(nodes: DataFrame, edges: DataFrame, shown: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """``query_id, test_id, touches, relation``: tests at the other end of an edge of a shown node, either way; structural relations say nothing."""
    e = edges.where(~F.col("relation").isin(*excluded))
    ends = e.select(F.col("source").alias("test_id"), F.col("target").alias("touches"), "relation").unionByName(e.select(F.col("target").alias("test_id"), F.col("source").alias("touches"), "relation")).where("test_id <> touches")
    tests = nodes.where(is_test_path(F.col("source_file"))).select(F.col("id").alias("test_id"))
    return ends.join(tests, "test_id", "left_semi").join(shown.select("query_id", F.col("id").alias("touches")), "touches").select("query_id", "test_id", "touches", "relation").distinct()


def tests_in_order(tests: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """``related_tests`` with ``rank``: tests of the seed itself first, then ``tests`` edges, then by file and label."""
    own = seeds.select("query_id", F.col("id").alias("seed"))
    info = nodes.select(F.col("id").alias("test_id"), F.col("source_file").alias("file"), "label")
    order = Window.partitionBy("query_id").orderBy(F.col("touches") != F.col("seed"), F.col("relation") != "tests", "file", "label", "touches", "relation")
    return tests.join(own, "query_id").join(info, "test_id").withColumn("rank", F.row_number().over(order)).drop("seed")


def reapply(nodes: DataFrame, edges: DataFrame, defs: DataFrame, findings: DataFrame, stale: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report) of a rebuilt graph: the supplement first, since findings may name what it adds, then the stored findings."""
    from . import supplement

    n, e = supplement.apply(nodes, edges, defs, stale)
    merged, report = merge(e, validated(resolve_findings(findings, n)))
    return n, merged, report
