"""Bounded traversal, closures and inheritance.

All functions take several seeds at once, told apart by ``query_id``, and run one
equi-join a hop: the frontier meets the edges first, and only what it finds is
held against the nodes. Each hop is written to the shared folder, which cuts
lineage and gives the planner the frontier's true size: a small one is broadcast
to where the edges lie, so that neither edges nor nodes are shuffled for it, a
large one is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bare
from ..plans.lineage import cut
from ..schema import INHERIT_RELATIONS, MEMBER_RELATIONS, TAINT_RELATIONS, TRAVERSAL_RELATIONS

def adjacency(edges: DataFrame, direction: str, relations: tuple[str, ...]) -> DataFrame:
    """``id, to, turn, edge_pos``: edges to follow from a node, in-edges (turn 0) before out-edges (turn 1)."""
    if direction not in ("up", "down", "both"):
        raise ValueError(f"direction must be up, down or both, not {direction!r}")
    kept = edges.where(F.col("relation").isin(*relations))
    turns = []
    if direction in ("up", "both"):
        turns.append(kept.select(F.col("target").alias("id"), F.col("source").alias("to"), F.lit(0).alias("turn"), "edge_pos"))
    if direction in ("down", "both"):
        turns.append(kept.select(F.col("source").alias("id"), F.col("target").alias("to"), F.lit(1).alias("turn"), "edge_pos"))
    return turns[0] if len(turns) == 1 else turns[0].unionByName(turns[1])


def existing(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct rows of ``found`` whose ``id`` is a node. ``found`` is the side that may be broadcast."""
    return nodes.select("id").join(found, "id").select(found.columns).distinct()


def seeded(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, members: bool = True) -> DataFrame:
    """``query_id, id``: the seeds, and with ``members`` the members they own that are nodes."""
    own = seeds.select("query_id", "id")
    if not members:
        return own.distinct()
    owned = edges.where(F.col("relation").isin(*MEMBER_RELATIONS)).select(F.col("source").alias("id"), F.col("target").alias("to"))
    found = cut(own.join(owned, "id").select("query_id", F.col("to").alias("id")).distinct(), "members")
    return own.unionByName(existing(nodes, found)).distinct()


def radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "up", relations: tuple[str, ...] = TRAVERSAL_RELATIONS, max_nodes: int | None = None, members: bool = True) -> DataFrame:
    """``query_id, id, depth, truncated``: breadth-first reach of each seed within ``depth`` hops; ends of edges that are no nodes are dropped.

    ``max_nodes`` bounds the nodes of a query in the order a queue would find
    them: by the parent's place, in-edges first, then the edges' order. Seeds
    and their members are exempt but count. A query whose seed is no node
    raises KeyError. The result may be put in ``ordered`` for display.
    """
    adj = adjacency(edges, direction, relations)
    asked = seeds.select("id").distinct()
    unknown = asked.join(existing(nodes, asked), "id", "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"no such nodes: {[r.id for r in unknown]}")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id")).cast("long") if max_nodes else F.lit(0).cast("long")
    seen = cut(seeded(nodes, edges, seeds, members).withColumn("depth", F.lit(0)).withColumn("place", place), "hop")
    dropped: DataFrame | None = None
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.select("query_id", "id", "place").join(adj, "id")
        order = [F.min(F.struct("place", "turn", "edge_pos")).alias("order")] if max_nodes else []
        found = step.groupBy("query_id", F.col("to").alias("id")).agg(*order) if order else step.select("query_id", F.col("to").alias("id")).distinct()
        found = existing(nodes, cut(found.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti"), "found"))
        if max_nodes:
            so_far = seen.groupBy("query_id").agg(F.count("*").alias("so_far"))
            ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("order", "id"))).join(so_far, "query_id").withColumn("place", F.col("so_far") + F.col("rank")).withColumn("depth", F.lit(hop))
            ranked = cut(ranked.select("query_id", "id", "depth", "place"), "hop")
            over = ranked.where(F.col("place") > max_nodes).select("query_id").distinct()
            dropped = over if dropped is None else dropped.union(over)
            frontier = ranked.where(F.col("place") <= max_nodes)
        else:
            frontier = found.withColumn("depth", F.lit(hop)).withColumn("place", F.lit(0).cast("long"))
            # what the last hop finds is not walked from
            frontier = cut(frontier, "hop") if hop < depth else frontier
        if (max_nodes or hop < depth) and frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(seen.columns))
    out = seen.select("query_id", "id", "depth")
    if dropped is None:
        return out.withColumn("truncated", F.lit(False))
    return out.join(dropped.distinct().withColumn("cut", F.lit(True)), "query_id", "left").select("query_id", "id", "depth", F.coalesce("cut", F.lit(False)).alias("truncated"))


def ordered(reach: DataFrame) -> DataFrame:
    """A radius as it is shown: with ``pos`` from 1 within its query, by depth and then id."""
    return reach.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "id")))


def first_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key, the first in ``order``."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_first = 1").drop("_first")


def closure_edges(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """``query_id`` and each edge, of any relation, with both ends in the query's reach; of equal (source, target, relation) the first."""
    inside = cut(reach.select("query_id", "id"), "inside")  # its size tells whether edges have to be shuffled for it
    kept = edges.join(inside.withColumnRenamed("id", "source"), "source").join(inside.withColumnRenamed("id", "target"), ["query_id", "target"], "left_semi")
    return first_wins(kept, ["query_id", "source", "target", "relation"], F.col("edge_pos"))


def taint_exposed(closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Taint edges of the closure, and the nodes they touch."""
    taints = closure.where(F.col("relation").isin(*TAINT_RELATIONS))
    ends = taints.select("query_id", F.col("source").alias("id")).union(taints.select("query_id", F.col("target").alias("id"))).distinct()
    return taints, ends


def subclasses(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``query_id, id`` of all direct and indirect subclasses; cycles end, depth is not bounded."""
    below = edges.where(F.col("relation").isin(*INHERIT_RELATIONS)).select(F.col("target").alias("id"), F.col("source").alias("to")).distinct()
    seen: DataFrame | None = None
    frontier = classes.select("query_id", "id").distinct()
    while True:
        found = frontier.join(below, "id").select("query_id", F.col("to").alias("id")).distinct()
        if seen is not None:
            found = found.join(seen, ["query_id", "id"], "left_anti")
        frontier = cut(found, "subclasses")
        if frontier.isEmpty():
            return seen if seen is not None else frontier
        seen = frontier if seen is None else seen.union(frontier)


def overrides(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``query_id, id, owning_class``: members of a subclass of the seed's owner with the seed's bare label."""
    member = edges.where(F.col("relation").isin(*MEMBER_RELATIONS)).select(F.col("source").alias("owner"), F.col("target").alias("member"))
    labels = nodes.select("id", bare(F.col("label")).alias("name"))
    owners = seeds.select("query_id", F.col("id").alias("member")).join(member, "member").select("query_id", F.col("owner").alias("id"))
    below = subclasses(edges, owners).select("query_id", F.col("id").alias("owner"))
    wanted = seeds.select("query_id", F.col("id").alias("seed")).join(labels.withColumnRenamed("id", "seed"), "seed")
    return below.join(member, "owner").join(labels.withColumnRenamed("id", "member"), "member").join(wanted, ["query_id", "name"]).where("member <> seed").select("query_id", F.col("member").alias("id"), F.col("owner").alias("owning_class")).distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, relations: tuple[str, ...] = TRAVERSAL_RELATIONS) -> DataFrame:
    """``query_id, id, role, relation``: callers point at the seed, callees are pointed at; a self-loop counts as caller only."""
    kept = edges.where(F.col("relation").isin(*relations))
    s = seeds.select("query_id", F.col("id").alias("seed"))
    callers = kept.join(s, kept["target"] == s["seed"]).select("query_id", F.col("source").alias("id"), F.lit("caller").alias("role"), "relation")
    callees = kept.join(s, kept["source"] == s["seed"]).where("source <> target").select("query_id", F.col("target").alias("id"), F.lit("callee").alias("role"), "relation")
    return existing(nodes, cut(callers.union(callees).distinct(), "near")).select("query_id", "id", "role", "relation")


def shortest_depth(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, limit: int = 8, relations: tuple[str, ...] = TRAVERSAL_RELATIONS) -> DataFrame:
    """``query_id, id, target, depth``: hops between each pair, direction ignored; null beyond ``limit``."""
    reach = radius(nodes, edges, pairs.select("query_id", "id").distinct(), limit, "both", relations, members=False)
    return pairs.join(reach.select("query_id", F.col("id").alias("target"), "depth"), ["query_id", "target"], "left").select("query_id", "id", "target", "depth")


def degree(edges: DataFrame) -> DataFrame:
    """``id, degree``: both ends of every edge; a self-loop counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def relation_set(*groups: tuple[str, ...]) -> tuple[str, ...]:
    """The relations of several sets, each once, in the order they are first named."""
    return tuple(dict.fromkeys(r for g in groups for r in g))


def is_subset(part: DataFrame, whole: DataFrame, keys: tuple[str, ...] = ("query_id", "id")) -> bool:
    """Whether a narrowed reach lies inside another."""
    return part.select(*keys).join(whole.select(*keys), list(keys), "left_anti").isEmpty()
