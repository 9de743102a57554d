"""Structural and metric differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edges import finding_key

TOLERANCE = 1e-9


def edge_diff(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("source", "target", "relation", "confidence", "origin")) -> DataFrame:
    """Fingerprints that came or went, as sets: repeated edges count once. ``change`` is added or removed."""
    a, b = before.select(*columns), after.select(*columns)
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def fingerprints(edges: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("source", "target", "relation", "confidence", "origin")) -> DataFrame:
    """``id, edges``: the edges of each node as sorted, distinct canonical JSON; an empty list for a node without any."""
    prints = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), finding_key(*columns).alias("f"))
    mine = prints.join(ids.distinct(), "id").groupBy("id").agg(F.sort_array(F.collect_set("f")).alias("edges"))
    return ids.distinct().join(mine, "id", "left").select("id", F.coalesce("edges", F.array().cast("array<string>")).alias("edges"))


def fingerprint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id, added, removed``, sorted, of the nodes whose fingerprints differ."""
    j = before.select("id", F.col("edges").alias("a")).join(after.select("id", F.col("edges").alias("b")), "id", "full_outer")
    none = F.array().cast("array<string>")
    out = j.select("id", F.array_except(F.coalesce("b", none), F.coalesce("a", none)).alias("added"), F.array_except(F.coalesce("a", none), F.coalesce("b", none)).alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def exit_code(diff: DataFrame) -> int:
    """0 without a difference, 2 with one."""
    return 0 if diff.isEmpty() else 2


def graph_equality(a_nodes: DataFrame, a_edges: DataFrame, b_nodes: DataFrame, b_edges: DataFrame, node_keys: tuple[str, ...], edge_keys: tuple[str, ...]) -> DataFrame:
    """``part, only_a, only_b``: how many distinct nodes and edges each side has alone."""

    def count(part: str, x: DataFrame, y: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        x, y = x.select(*keys).distinct().withColumn("_in", F.lit(1)), y.select(*keys).distinct().withColumn("_in", F.lit(2))
        sides = x.union(y).groupBy(*keys).agg(F.sum("_in").alias("side"))
        return sides.agg(F.count_if(F.col("side") == 1).alias("only_a"), F.count_if(F.col("side") == 2).alias("only_b")).select(F.lit(part).alias("part"), "only_a", "only_b")

    return count("nodes", a_nodes, b_nodes, node_keys).unionByName(count("edges", a_edges, b_edges, edge_keys))


def compare(base: Column, now: Column, in_base: Column, in_now: Column) -> Column:
    """Of two runs of one task: new, missing, improved, regressed or same. A value on one side only counts as regressed."""
    lost = base.isNull() != now.isNull()
    return (
        F.when(~in_base, "new").when(~in_now, "missing").when(base.isNull() & now.isNull(), "same").when(lost, "regressed")
        .when(now > base + TOLERANCE, "improved").when(now < base - TOLERANCE, "regressed").otherwise("same")
    )


def baseline_diff(base: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """``key, base, now, verdict`` over all keys of either side."""
    b = base.select(key, F.col(value).alias("base"), F.lit(True).alias("in_base"))
    n = now.select(key, F.col(value).alias("now"), F.lit(True).alias("in_now"))
    j = b.join(n, key, "full_outer")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select(key, "base", "now", compare(F.col("base"), F.col("now"), has("in_base"), has("in_now")).alias("verdict"))


def ab_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``key, a, b, verdict`` for the keys of A: newly_scoreable, lost, still_unscored, improved, regressed or same."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "left")
    x, y = F.col("a"), F.col("b")
    verdict = (
        F.when(x.isNull() & y.isNull(), "still_unscored").when(x.isNull(), "newly_scoreable").when(y.isNull(), "lost")
        .when(y > x + TOLERANCE, "improved").when(y < x - TOLERANCE, "regressed").otherwise("same")
    )
    return j.select(key, "a", "b", verdict.alias("verdict"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``key, a, b`` where two configurations (key, value) differ; runs under different ones are not compared."""
    j = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b")))
