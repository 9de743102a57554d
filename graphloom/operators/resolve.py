"""From what a user or a scanner names to nodes: ladder, candidates, as-of and interval joins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bare, file_and_line, is_callable, is_file_node, leaf, location_line, posix, with_folded
from ..plans.lineage import cut

#: Lines a bucket of an interval join that lists all pairs spans, and those of the as-of join.
BUCKET, SPAN = 64, 4096
#: Blocks that make up one of the next level where only the smallest extent counts; a power of two.
WIDTH = 4
#: Search texts that are looked for in every node directly; more are met through trigrams.
DIRECT = 200

RUNGS = ("id", "location", "label", "qualified_name", "bare", "leaf", "file", "substring")


def locate(findings: DataFrame, nodes: DataFrame, file_lines: DataFrame | None = None) -> DataFrame:
    """As-of join: ``query_id, file, line`` to the nearest preceding callable, as ``query_id, id, how``.

    ``exact``: a callable defined on the line; ``preceding``: else the last
    callable above; ``any``: else the last node of any kind above; no row if
    none. With ``file_lines`` (file, line, text): past the file's end there is no
    row, and an unindented, non-blank line that defines nothing belongs to the
    file's own node. Nodes and findings are merged and sorted within spans of
    lines, so that a very long file is no single task; what an earlier span
    ends with, one row a span, is carried into the later ones.
    """
    at = nodes.select(
        posix(F.col("source_file")).alias("file"), location_line(F.col("source_location")).alias("line"), F.struct("node_pos", "id").alias("node"),
        is_callable(F.col("_callable"), F.col("label")).alias("calls"), is_file_node(F.col("source_file"), F.col("source_location"), F.col("label"), F.col("_callable")).alias("is_file"),
    ).where("line is not null")
    ask = findings.select("query_id", posix(F.col("file")).alias("file"), "line")
    span = F.floor(F.col("line") / SPAN).alias("span")
    defined = at.where("not is_file").select("file", "line", span, F.struct("line", "node").alias("any"), F.when(F.col("calls"), F.struct("line", "node")).alias("near"))
    kind = defined.schema["any"].dataType
    merged = ask.select("file", "line", span, F.lit(1).alias("asks"), "query_id", F.lit(None).cast(kind).alias("any"), F.lit(None).cast(kind).alias("near")).unionByName(
        defined.select("file", "line", "span", F.lit(0).alias("asks"), F.lit(None).cast(ask.schema["query_id"].dataType).alias("query_id"), "any", "near")
    )
    w = Window.partitionBy("file", "span").orderBy("line", "asks", "any.node.node_pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    found = merged.withColumn("near", last("near")).withColumn("any", last("any")).where("asks = 1")
    ends = defined.groupBy("file", "span").agg(F.max("near").alias("near"), F.max("any").alias("any")).unionByName(ask.select("file", span).distinct(), allowMissingColumns=True).groupBy("file", "span").agg(F.max("near").alias("near"), F.max("any").alias("any"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "span", F.last("near", ignorenulls=True).over(before).alias("near_before"), F.last("any", ignorenulls=True).over(before).alias("any_before")).where("any_before is not null")
    found = found.join(carried, ["file", "span"], "left").withColumn("near", F.coalesce("near", "near_before")).withColumn("any", F.coalesce("any", "any_before"))
    if file_lines is None:
        out = found.withColumn("own", F.lit(None).cast("string")).withColumn("inside", F.lit(True)).withColumn("outer", F.lit(False))
    else:
        text = file_lines.select(posix(F.col("file")).alias("file"), "line", "text")
        last_lines = text.groupBy("file").agg(F.max("line").alias("last_line"))
        own = at.where("is_file").groupBy("file").agg(F.min_by("node.id", "node.node_pos").alias("own"))
        out = found.join(text, ["file", "line"], "left").join(last_lines, "file", "left").join(own, "file", "left")
        out = out.withColumn("inside", F.coalesce(F.col("line") <= F.col("last_line"), F.lit(True))).withColumn("outer", F.coalesce(F.col("text").rlike(r"^\S"), F.lit(False)))
    exact = F.col("near.line") == F.col("line")
    how = F.when(exact, "exact").when(F.col("outer"), "file").when(F.col("near").isNotNull(), "preceding").otherwise("any")
    chosen = F.when(exact, F.col("near.node.id")).when(F.col("outer"), F.col("own")).otherwise(F.coalesce("near.node.id", "any.node.id"))
    return out.where("inside").select("query_id", chosen.alias("id"), how.alias("how")).where("id is not null")


def _blocks(start: Column, end: Column) -> Column:
    """``array<struct<level, block>>``: the fewest blocks of ``WIDTH`` ** level lines that make up the lines of an extent, at most 2 * (WIDTH - 1) a level."""
    none = F.array().cast("array<long>")
    some = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    first = lambda n: F.ceil(start / F.pow(F.lit(WIDTH), n))
    behind = lambda n: F.floor((end.cast("long") + 1) / F.pow(F.lit(WIDTH), n))

    def own(n: Column) -> Column:
        """Blocks that no block of the next level holds."""
        a, b, up, down = first(n), behind(n), first(n + 1), behind(n + 1)
        left = F.when(up < down, F.concat(some(a, up * WIDTH), some(down * WIDTH, b))).otherwise(some(a, b))
        return F.transform(left, lambda x: F.struct(n.alias("level"), x.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), _top(start, end)), own))


def _top(start: Column, end: Column) -> Column:
    """The highest level with a block no longer than the extent."""
    return F.floor((F.length(F.bin(end.cast("long") - start + 1)) - 1) / (WIDTH.bit_length() - 1)).cast("int")


def smallest(spots: DataFrame, extents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, held): ``file, line, rank`` of the smallest extent that holds each distinct spot (file, line), and the extents by ``rank``.

    Extents are ranked by size and then ``pos``. Each is dealt into the few
    blocks of lines that it consists of, on levels of growing width, and a block
    keeps its lowest rank; a spot looks into one block a level. Neither long
    extents nor many around the same lines cost more than the logarithm of a length.
    """
    ordered = extents.where("file is not null and start <= end").withColumn("_size", F.col("end") - F.col("start")).orderBy("_size", "pos").drop("_size")
    held = cut(ordered.withColumn("rank", F.monotonically_increasing_id()), "extents")
    top = held.agg(F.max(_top(F.col("start"), F.col("end")))).first()[0] or 0
    kept = held.select("file", "rank", F.inline(_blocks(F.col("start"), F.col("end")))).groupBy("file", "level", "block").agg(F.min("rank").alias("rank"))
    block = lambda n: F.struct(n.alias("level"), F.floor(F.col("line") / F.pow(F.lit(WIDTH), n)).alias("block"))
    asked = spots.select("file", "line").where("file is not null and line is not null").distinct()
    asked = asked.select("file", "line", F.inline(F.transform(F.sequence(F.lit(0), F.lit(top)), block)))
    return asked.join(kept, ["file", "level", "block"]).groupBy("file", "line").agg(F.min("rank").alias("rank")), held


def enclosing(points: DataFrame, extents: DataFrame) -> DataFrame:
    """``query_id`` and the smallest extent (file, start, end, name) that holds its (file, line); the first listed on ties."""
    hits, held = smallest(points, extents)
    best = points.select("query_id", "file", "line").join(hits, ["file", "line"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return best.join(held, "rank").select("query_id", "file", "name", "start", "end")


def insertion_anchor(points: DataFrame, extents: DataFrame) -> DataFrame:
    """``query_id, name`` where line N and line N + 1 lie in the same extent; others stay unattributed and have no row.

    Both lines are looked up together, once for each place and not for each point.
    """
    spots = points.select("file", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"))
    hits, held = smallest(spots, extents)
    none = F.lit(None).cast("long")
    near = hits.select("file", "line", F.col("rank").alias("here"), none.alias("below")).unionByName(hits.select("file", (F.col("line") - 1).alias("line"), none.alias("here"), F.col("rank").alias("below")))
    near = near.groupBy("file", "line").agg(F.min("here").alias("here"), F.min("below").alias("below"))
    both = points.select("query_id", "file", "line").join(near, ["file", "line"]).groupBy("query_id").agg(F.min("here").alias("here"), F.min("below").alias("below"))
    own = lambda side: held.select(F.col("rank").alias(side), "file", "name", "start")
    pairs = both.where("query_id is not null and here is not null and below is not null").select("here", "below").distinct()
    # the two may differ in their end alone
    same = pairs.join(own("here"), "here").join(own("below"), ["below", "file", "name", "start"]).select("here", "below", "name")
    return both.join(same, ["here", "below"]).where("query_id is not null").select("query_id", "name")


def _path(path: Column) -> Column:
    """A path as it is compared: posix, without empty and ``.`` segments and without a slash at its end."""
    p = F.regexp_replace(F.regexp_replace(posix(path), r"(?<=/)(\./)+|^(\./)+(?=.)", ""), r"/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/$", ""))


def containing(texts: DataFrame, text: str, asked: DataFrame, probe: str) -> DataFrame:
    """Rows of ``texts`` and of ``asked`` where the column ``text`` contains the column ``probe``.

    Few probes travel as a constant and each row is looked at once, where it
    lies. Beyond ``DIRECT``, rows meet probes through the grams of three
    characters that they share (all of a shorter probe), and containment is
    tested behind that equi-join. There is no nested loop either way.
    """
    asked = asked.where(F.col(probe) != "")
    some = asked.limit(DIRECT + 1).collect()
    if len(some) <= DIRECT:
        kind = f"array<{asked.schema.simpleString()}>"
        each = F.from_json(F.lit(json.dumps([r.asDict(True) for r in some])), kind)
        return texts.select("*", F.inline(F.filter(each, lambda a: F.contains(F.col(text), a[probe]))))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substr(F.col(text), i, n)))))
    met = texts.where(F.col(text) != "").withColumn("_gram", F.explode(grams)).join(asked.withColumn("_gram", F.substring(probe, 1, 3)), "_gram")
    return met.where(F.contains(F.col(text), F.col(probe))).drop("_gram")


def resolve(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, id, rung``: the first rung of the ladder with exactly one match; a rung with several falls through.

    Case is folded on every rung but the id's. Nodes and queries are spread into
    one key a rung and meet in one equi-join. A query in the form of a location
    that is no id is answered from the location alone, or not at all. Only what
    no rung decides is looked for in the labels.
    """
    q = with_folded(queries.select("query_id", "query"), q=F.coalesce(F.nullif(F.regexp_replace("query", r"[/\\]+$", ""), F.lit("")), F.col("query")), qpath=_path(F.col("query")))
    q = cut(q.withColumn("at", file_and_line(F.trim("query"))), "asked")
    n = with_folded(nodes.select("id", F.coalesce(F.col("source_location") == "L1", F.lit(False)).alias("first"), "label", "qualified_name", "source_file"), l=F.col("label"), qn=F.col("qualified_name"), path=_path(F.col("source_file")))
    key = lambda rung, c: F.struct(F.lit(RUNGS.index(rung)).alias("rung"), c.alias("key"))
    spread = lambda df, *keys: F.explode(F.filter(F.array(*keys), lambda k: k["key"].isNotNull() & (k["key"] != ""))).alias("k")
    ours = n.select("id", "first", spread(n, key("id", F.col("id")), key("label", F.col("l")), key("qualified_name", F.col("qn")), key("bare", bare(F.col("l"))), key("leaf", leaf(F.col("l"))), key("file", F.col("path"))))
    named = F.col("at").isNull()
    theirs = q.select("query_id", spread(q, key("id", F.col("query")), *(key(rung, F.when(named, c)) for rung, c in (("label", F.col("q")), ("qualified_name", F.col("q")), ("bare", bare(F.col("q"))), ("leaf", leaf(F.col("q"))), ("file", F.col("qpath"))))))
    met = ours.select("id", "first", "k.rung", "k.key").join(theirs.select("query_id", "k.rung", "k.key"), ["rung", "key"]).groupBy("query_id", "rung")
    hits = met.agg(F.count("*").alias("n"), F.min("id").alias("id"), F.count_if("first").alias("n1"), F.min(F.when(F.col("first"), F.col("id"))).alias("id1"))
    # a file with several nodes means its one node at line 1
    by_first = (F.col("rung") == RUNGS.index("file")) & (F.col("n") > 1) & (F.col("n1") == 1)
    one = hits.where((F.col("n") == 1) | by_first).select("query_id", "rung", F.when(by_first, F.col("id1")).otherwise(F.col("id")).alias("id"))
    at = q.where("at is not null").select("query_id", "at.file", "at.line")
    one = one.unionByName(locate(at, nodes).select("query_id", F.lit(RUNGS.index("location")).alias("rung"), "id"))
    exact = cut(one.groupBy("query_id").agg(F.min_by("id", "rung").alias("id"), F.min("rung").alias("rung")), "exact")
    rest = q.where(named).join(exact, "query_id", "left_anti").select("query_id", "q")
    loose = containing(n.select("id", "l"), "l", rest, "q").groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("query_id", "id", F.lit(RUNGS.index("substring")).alias("rung"))
    every = exact.unionByName(loose)
    return every.select("query_id", "id", F.element_at(F.array(*map(F.lit, RUNGS)), F.col("rung") + 1).alias("rung"))


def candidates(queries: DataFrame, nodes: DataFrame, limit: int = 25) -> DataFrame:
    """``query_id, id, match, rank``: the best ``limit`` nodes for a search term, case folded.

    0 exact id, label, bare, leaf or qualified name; 1 leaf of the qualified
    name; 2 part of label or qualified name; 3 part of id or path. Callables
    come first within a rank, then ids ascend.
    """
    t = with_folded(queries.select("query_id", "query"), q=F.trim("query")).where("q <> ''")
    # whatever matches holds the term's leaf somewhere
    t = cut(t.withColumn("probe", F.when(leaf(F.col("q")) != "", leaf(F.col("q"))).otherwise(F.col("q"))), "asked")
    n = nodes.select("id", "label", F.col("_callable").alias("flag"), F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), F.coalesce("source_file", F.lit("")).alias("source_file"))
    n = with_folded(n, l=F.coalesce("label", F.lit("")), qn=F.col("qualified_name"), path=F.col("source_file"), low=F.col("id")).withColumn("all", F.concat_ws("\n", "l", "qn", "low", "path"))
    met = containing(n, "all", t, "probe")
    q, label, qual = F.col("q"), F.col("l"), F.col("qn")
    exact = (label == q) | (bare(label) == bare(q)) | (leaf(label) == leaf(q)) | ((qual != "") & (qual == q)) | (F.col("id") == F.col("query"))
    match = (
        F.when(exact, 0).when((qual != "") & (F.substring_index(qual, ".", -1) == leaf(q)), 1).when(F.contains(label, q) | F.contains(qual, q), 2)
        .when(F.contains(F.col("low"), q) | F.contains(F.col("path"), q), 3)
    )
    met = met.withColumn("match", match).where("match is not null")
    order = Window.partitionBy("query_id").orderBy("match", (~is_callable(F.col("flag"), label)).cast("int"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "match", "rank")
