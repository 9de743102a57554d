"""Connected components of a link table, on the executors throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has a link; the component is its smallest node.

    Contraction: every node points to its smallest neighbour if that is
    smaller, pointers are doubled until they reach roots, and links are redrawn
    between roots until none is left. Rounds and doublings are logarithmic in
    practice; each is written to the shared folder. Aggregates are
    pre-aggregated before their shuffle, and the joins are plain, so a node
    with very many links is split by the adaptive skew join.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = materialize(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels: DataFrame | None = None
    while not links.isEmpty():
        up = materialize(links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "pointers")
        while True:
            next_up = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = materialize(up.join(next_up.where("p <> pp"), "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jumps")
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("u", "p")
            if not moved:
                break
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            root = up.select(F.col("u").alias("component"), F.col("p").alias("root"))
            labels = materialize(labels.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        to = up.where("u <> p")
        redrawn = links.join(to.select("u", F.col("p").alias("pu")), "u", "left").select(F.coalesce("pu", "u").alias("u"), "v")
        redrawn = redrawn.join(to.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v", "left").select("u", F.coalesce("pv", "v").alias("v"))
        links = materialize(redrawn.where("u <> v").distinct(), "links")
    if labels is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
