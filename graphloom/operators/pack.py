"""Context packs: what to read about a seed under a token budget, and what was left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_callable, is_file_node, leaf_any_parens, line_slice, line_slices, location_line, token_count
from ..plans.lineage import cut
from ..schema import CALL_RELATIONS, MEMBER_RELATIONS, NOT_A_TEST_LINK, TRAVERSAL_RELATIONS
from .edges import related_tests, unmodelled
from .rank import mentioned, ranked, severity, two_tier_fill, via
from .symbols import at_line
from .traverse import closure_edges, radius


def call_sites(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``query_id, id, label, relation`` of what calls the seed."""
    s = seeds.select("query_id", F.col("id").alias("target"))
    calls = edges.where(F.col("relation").isin(*CALL_RELATIONS)).join(s, "target").select("query_id", F.col("source").alias("id"), "relation").distinct()
    return calls.join(nodes.select("id", "label"), "id").select("query_id", "id", "label", "relation")


def siblings(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``query_id, id, label, owner`` of callable members that share an owner with the seed."""
    member = edges.where(F.col("relation").isin(*MEMBER_RELATIONS)).select(F.col("source").alias("owner"), F.col("target").alias("id"))
    owners = seeds.select("query_id", F.col("id").alias("seed")).join(member.withColumnRenamed("id", "seed"), "seed").select("query_id", "seed", "owner").distinct()
    calls = nodes.where(is_callable(F.col("_callable"), F.col("label")) & ~is_file_node(F.col("source_file"), F.col("source_location"), F.col("label"), F.col("_callable"))).select("id", "label")
    return owners.join(member, "owner").where("id <> seed").join(calls, "id").select("query_id", "id", "label", "owner").distinct()


@dataclass
class Pack:
    """``rows``: every reached definition with its tier, score, rank and cost; the others explain what is not in it."""

    rows: DataFrame
    unresolved: DataFrame
    omitted: DataFrame
    unmodelled: DataFrame
    tests: DataFrame
    call_sites: DataFrame
    siblings: DataFrame


def context_pack(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, files: DataFrame, defs: DataFrame, depth: int = 2, direction: str = "both", budget: int = 6000, index_budget: int = 300, order: str = "mention-first", containment: bool = True, max_nodes: int | None = 200, symbol_cap: int | None = None) -> Pack:
    """Packs for several seeds in one traversal.

    ``files``: file, text; ``defs``: their definitions. With an index the walk
    goes one hop further, for the index alone. Costs count a header line and
    the body, cut to ``symbol_cap`` tokens if given; an index row costs its
    place and signature.
    """
    relations = TRAVERSAL_RELATIONS + (MEMBER_RELATIONS if containment else ())
    hops = depth + (1 if index_budget > 0 else 0)
    # bounded by max_nodes for each seed, and read several times below
    reach = cut(radius(nodes, edges, seeds, hops, direction, relations, max_nodes), "reach")
    v = via(closure_edges(edges, reach))
    seed = seeds.select("query_id", F.col("id").alias("seed"))
    info = nodes.select("id", "label", "source_file", "source_location", "_callable")
    rows = reach.select("query_id", "id", "depth").join(info, "id").join(v, ["query_id", "id"], "left").join(seed, "query_id")
    rows = rows.withColumn("is_file", is_file_node(F.col("source_file"), F.col("source_location"), F.col("label"), F.col("_callable")))
    asked = info.select(F.col("id").alias("query_id"), F.col("source_file").alias("file"), location_line(F.col("source_location")).alias("def_line"), leaf_any_parens(F.col("label")).alias("leaf"))
    got = at_line(asked.join(rows.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_semi"), defs).select(F.col("query_id").alias("id"), "symbol", "unresolved")
    rows = cut(rows.join(got, "id", "left").withColumn("why_not", F.when(F.col("is_file"), "file_node").otherwise(F.col("unresolved"))), "rows")
    deep = (F.col("depth") > depth) & (F.col("id") != F.col("seed"))
    unresolved = rows.where(F.col("why_not").isNotNull() & ~deep).select("query_id", "id", "label", F.col("why_not").alias("reason"), (F.col("id") == F.col("seed")).alias("is_seed"))
    shown = rows.where("why_not is null").withColumns({"start": F.col("symbol.start"), "end": F.col("symbol.end")})
    # a file goes to its ranges of lines once, and not to every row
    wanted = shown.groupBy("source_file").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    bodies = wanted.join(files.select(F.col("file").alias("source_file"), F.col("text").alias("source")), "source_file").select("source_file", F.inline(line_slices(F.col("source"), F.col("ranges")))).withColumnRenamed("text", "body")
    shown = shown.join(cut(bodies, "bodies"), ["source_file", "start", "end"])
    head = F.concat(F.lit("--- "), F.col("source_file"), F.lit(":L"), F.col("symbol.def_line").cast("string"), F.lit(" ---\n"))
    body = F.col("body") if symbol_cap is None else F.substring("body", 1, 4 * symbol_cap)
    line = F.concat(F.lit("  "), F.col("source_file"), F.lit(":L"), F.col("symbol.def_line").cast("string"), F.lit("  "), F.substring("symbol.signature", 1, 120), F.lit("\n"))
    shown = shown.withColumn("cost", token_count(F.concat(head, body, F.lit("\n")))).withColumn("index_cost", token_count(line))
    text = shown.where("id = seed").select("query_id", F.col("body").alias("text"))
    placed = ranked(mentioned(shown.drop("start", "end", "body"), text), order)
    tiers = cut(two_tier_fill(cut(placed, "placed"), budget, index_budget, body_depth=depth), "tiers")
    kept = tiers.where("tier <> 'omitted'").select("query_id", "id")
    files_shown = tiers.where("tier = 'body'").select("query_id", F.col("source_file").alias("file")).distinct()
    return Pack(
        tiers.select("query_id", "id", "label", F.col("source_file").alias("file"), F.col("symbol.start").alias("start"), F.col("symbol.end").alias("end"), F.col("symbol.def_line").alias("def_line"), F.col("symbol.signature").alias("signature"), "depth", "via", "via_confidence", F.round("score", 5).alias("score"), "rank", "cost", "index_cost", "tier", "reason"),
        unresolved, severity(tiers).select("query_id", "id", "score", "reason", "severity"),
        unmodelled(defs.where("status = 'ok'"), nodes).select("file", "name", "kind", "def_line").join(files_shown, "file").select("query_id", "file", "name", "kind", "def_line"),
        related_tests(nodes, edges, kept, NOT_A_TEST_LINK), call_sites(nodes, edges, seeds), siblings(nodes, edges, seeds),
    )


def render(pack: Pack, files: DataFrame) -> DataFrame:
    """``query_id, text``: bodies in rank order, then the index."""
    b = pack.rows.where("tier = 'body'").join(files.select("file", F.col("text").alias("source")), "file")
    head = F.concat(F.lit("--- "), F.col("file"), F.lit(":L"), F.col("def_line").cast("string"), F.lit(" ---\n"))
    chunk = F.concat(head, line_slice(F.col("source"), F.col("start"), F.col("end")))
    i = pack.rows.where("tier = 'index'").select("query_id", F.lit(1).alias("part"), "rank", F.format_string("  %s:L%d  %s", F.col("file"), F.col("def_line"), F.substring("signature", 1, 120)).alias("chunk"))
    every = b.select("query_id", F.lit(0).alias("part"), "rank", chunk.alias("chunk")).unionByName(i)
    return every.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rank", "chunk"))), lambda x: x["chunk"]), "\n").alias("text"))
