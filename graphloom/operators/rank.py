"""Relevance ranking and filling a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import IDENTIFIER, leaf_any_parens
from ..schema import DECAY, LEGACY_RANK, RELATION_WEIGHTS, UNKNOWN_WEIGHT

ORDERS = ("mention-first", "mention", "current", "legacy")


def lookup(key: Column, table: dict, other) -> Column:
    """``table[key]`` as a column, ``other`` for keys not in it and for null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(other))


def via(closure: DataFrame) -> DataFrame:
    """``query_id, id, via, via_confidence``: relation of the first closure edge that touches a node, and that edge's confidence."""
    ends = closure.select("query_id", F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(0).alias("end")), F.struct(F.col("source").alias("id"), F.lit(1).alias("end")))).alias("e"), "relation", "confidence", "edge_pos")
    first = ends.groupBy("query_id", "e.id").agg(F.min_by(F.struct("relation", "confidence"), F.struct("edge_pos", "e.end")).alias("v"))
    return first.select("query_id", "id", F.col("v.relation").alias("via"), F.nullif(F.col("v.confidence"), F.lit("")).alias("via_confidence"))


def score(relation: Column, depth: Column) -> Column:
    """Weight of the relation times the decay for each hop."""
    return lookup(relation, RELATION_WEIGHTS, UNKNOWN_WEIGHT) * F.pow(F.lit(DECAY), depth)


def mentioned(rows: DataFrame, seed_text: DataFrame) -> DataFrame:
    """``rows`` with ``mentioned``: whether the label's bare name is an identifier in the seed's own source (``query_id, text``)."""
    words = seed_text.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({IDENTIFIER})"), F.lit(1)))).alias("name")).withColumn("mentioned", F.lit(True))
    return rows.withColumn("name", leaf_any_parens(F.col("label"))).join(words, ["query_id", "name"], "left").withColumn("mentioned", F.coalesce("mentioned", F.lit(False))).drop("name")


def ranked(rows: DataFrame, order: str = "mention-first") -> DataFrame:
    """``rows`` (query_id, id, seed, label, depth, via, mentioned) with ``score`` and ``rank`` from 1 under one of ``ORDERS``."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, not {order!r}")
    rows = rows.withColumn("score", score(F.col("via"), F.col("depth")))
    is_seed = (F.col("id") != F.col("seed")).cast("int")
    member = (~F.coalesce(F.col("label").startswith("."), F.lit(False))).cast("int")
    if order == "legacy":
        keys = [is_seed, F.col("depth"), lookup(F.col("via"), LEGACY_RANK, 5), F.coalesce("label", F.lit("")), F.col("id")]
    else:
        apart = (~F.col("mentioned")).cast("int")
        within = {"mention-first": [apart, F.col("depth")], "mention": [F.col("depth"), apart], "current": [F.col("depth")]}[order]
        keys = [is_seed, *within, -F.col("score"), member, F.col("id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)))


def greedy_fill(rows: DataFrame, budget: int | str, key: str = "query_id", rank: str = "rank", cost: str = "cost", always: str | None = None) -> DataFrame:
    """``rows`` with ``taken`` and ``used``: walked in rank order, a row is taken if it still fits; later, smaller ones may fit after one that did not.

    Not a running sum: each row's fate depends on those before it. A query's
    rows lie sorted in one partition and stream past a single number, so memory
    does not depend on how many they are. ``budget``: a number, or a column of
    one for each query.
    """
    own = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    held = F.col(always) if always else F.lit(False)
    df = rows.withColumns({"_most": own.cast("long"), "_cost": F.col(cost).cast("long"), "_held": F.coalesce(held, F.lit(False))})
    kept = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", taken boolean, used long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, used = object(), 0
        for b in batches:
            taken, totals = [], []
            for k, most, c, always_ in zip(b.column(key).to_pylist(), b.column("_most").to_pylist(), b.column("_cost").to_pylist(), b.column("_held").to_pylist(), strict=True):
                if k != query:
                    query, used = k, 0
                fits = always_ or used + c <= most
                used += c if fits else 0
                taken.append(fits)
                totals.append(used)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(taken, pa.bool_()), pa.array(totals, pa.int64())], [*kept, "taken", "used"])

    return df.repartition(key).sortWithinPartitions(key, rank).mapInArrow(run, schema)


def two_tier_fill(rows: DataFrame, budget: int, reserve: int, dynamic: bool = True, body_depth: int | None = None) -> DataFrame:
    """``tier``: ``body``, ``index`` or ``omitted`` and, for what is not a body, ``reason``.

    Bodies fill the budget (the seed always); rows that do not fit, or lie
    deeper than ``body_depth``, compete in the same order for an index of
    ``reserve`` tokens, or of what the bodies left if that is more and
    ``dynamic``. Rows carry ``cost`` and ``index_cost``.
    """
    rows = rows.withColumn("_seed", F.col("id") == F.col("seed"))
    deep = F.lit(False) if body_depth is None else (F.col("depth") > body_depth) & ~F.col("_seed")
    body = greedy_fill(rows.where(~deep), budget, always="_seed").withColumnRenamed("used", "body_used")
    spent = body.groupBy("query_id").agg(F.max("body_used").alias("spent"))
    waiting = body.where("not taken").select(*rows.columns, F.lit("budget").alias("why")).unionByName(rows.where(deep).select(*rows.columns, F.lit("depth").alias("why")))
    cap = F.greatest(F.lit(reserve), F.lit(budget) - F.coalesce("spent", F.lit(0))) if dynamic and reserve > 0 else F.lit(reserve)
    waiting = waiting.join(spent, "query_id", "left").withColumn("cap", cap.cast("long"))
    index = greedy_fill(waiting, "cap", cost="index_cost").withColumn("listed", F.col("taken") & F.lit(reserve > 0))
    rest = index.select(*rows.columns, F.when(F.col("listed"), "index").otherwise("omitted").alias("tier"), F.when(F.col("listed"), F.col("why")).when(F.col("why") == "budget", "budget").otherwise("index_budget").alias("reason"))
    bodies = body.where("taken").select(*rows.columns, F.lit("body").alias("tier"), F.lit(None).cast("string").alias("reason"))
    return bodies.unionByName(rest).drop("_seed")


def severity(tiers: DataFrame) -> DataFrame:
    """Omitted rows with ``severity``: high rank if no kept row but the seed scores lower, else low rank."""
    floor = tiers.where("tier = 'body' and id <> seed").groupBy("query_id").agg(F.min("score").alias("floor"))
    gone = tiers.where("tier = 'omitted'").join(floor, "query_id", "left")
    return gone.withColumn("severity", F.when(F.col("score") >= F.coalesce("floor", F.lit(0.0)), "truncated_high_rank").otherwise("truncated_low_rank"))
