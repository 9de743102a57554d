"""A property graph out of the star-schema tables, so that every operator runs on them.

Regions contain nations; nations have customers and suppliers as members and
inherit from their region; customers call orders, orders reference parts,
suppliers use parts; orders with status F are tainted by their customer.
Customers of one market segment live in test files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, prefix: str, key: str, label, file=None, line=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"), label.alias("label"), (none if file is None else file).alias("source_file"),
        (none if line is None else F.concat(F.lit("L"), line.cast("string"))).alias("source_location"), F.lit(None).cast("boolean").alias("_callable"), none.alias("qualified_name"),
        none.alias("origin"), F.concat(F.lit(f"{prefix}:"), F.lpad(F.col(key).cast("string"), 12, "0")).alias("node_pos"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    call = lambda c: F.concat(F.col(c), F.lit("()"))
    file = lambda n: F.concat(F.lit("nation_"), F.col(n).cast("string"))
    rank = lambda n, k: F.row_number().over(Window.partitionBy(n).orderBy(k)) * 10
    in_test = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("tests/"), file("c_nationkey"))).otherwise(file("c_nationkey"))
    parts = [
        _node(t("region"), "R", "r_regionkey", F.col("r_name")),
        _node(t("nation"), "N", "n_nationkey", F.col("n_name")),
        _node(t("customer"), "C", "c_custkey", call("c_name"), in_test, rank("c_nationkey", "c_custkey") + 1),
        _node(t("supplier"), "S", "s_suppkey", call("s_name"), file("s_nationkey"), rank("s_nationkey", "s_suppkey") + 6),
        _node(t("part"), "P", "p_partkey", F.col("p_name")),
        _node(t("orders"), "O", "o_orderkey", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit("()"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """``distinct=False`` leaves repeated edges in and needs no shuffle."""
    t = lambda name: table(spark, sf_dir, name)
    i = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))

    def edge(df: DataFrame, source, relation: str, target, confidence: str = "EXTRACTED") -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))

    n, c, o = t("nation"), t("customer"), t("orders")
    lines = t("lineitem")
    pairs = lambda *c: lines.select(*c).distinct() if distinct else lines.select(*c)
    parts = [
        edge(n, i("R", "n_regionkey"), "contains", i("N", "n_nationkey")),
        edge(n, i("N", "n_nationkey"), "inherits", i("R", "n_regionkey")),
        edge(c, i("N", "c_nationkey"), "method", i("C", "c_custkey")),
        edge(t("supplier"), i("N", "s_nationkey"), "method", i("S", "s_suppkey")),
        edge(o, i("C", "o_custkey"), "calls", i("O", "o_orderkey")),
        edge(o.where("o_orderstatus = 'F'"), i("C", "o_custkey"), "taints", i("O", "o_orderkey"), "EXTERNAL"),
        edge(pairs("l_orderkey", "l_partkey"), i("O", "l_orderkey"), "references", i("P", "l_partkey")),
        edge(pairs("l_suppkey", "l_partkey"), i("S", "l_suppkey"), "uses", i("P", "l_partkey"), "INFERRED"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # an order that every engine computes alike without sorting the whole table
    return out.withColumn("edge_pos", F.concat_ws("|", "relation", "source", "target"))


SQL = """
nodes as (
  select 'R:' || r_regionkey as id, r_name as label, null::varchar as source_file, null::int as line from region
  union all select 'N:' || n_nationkey, n_name, null, null from nation
  union all select 'C:' || c_custkey, c_name || '()', case when c_mktsegment = 'BUILDING' then 'tests/' else '' end || 'nation_' || c_nationkey, (row_number() over (partition by c_nationkey order by c_custkey) * 10 + 1)::int from customer
  union all select 'S:' || s_suppkey, s_name || '()', 'nation_' || s_nationkey, (row_number() over (partition by s_nationkey order by s_suppkey) * 10 + 6)::int from supplier
  union all select 'P:' || p_partkey, p_name, null, null from part
  union all select 'O:' || o_orderkey, 'order_' || o_orderkey || '()', null, null from orders
), raw_edges as (
  select 'R:' || n_regionkey as source, 'N:' || n_nationkey as target, 'contains' as relation, 'EXTRACTED' as confidence from nation
  union all select 'N:' || n_nationkey, 'R:' || n_regionkey, 'inherits', 'EXTRACTED' from nation
  union all select 'N:' || c_nationkey, 'C:' || c_custkey, 'method', 'EXTRACTED' from customer
  union all select 'N:' || s_nationkey, 'S:' || s_suppkey, 'method', 'EXTRACTED' from supplier
  union all select 'C:' || o_custkey, 'O:' || o_orderkey, 'calls', 'EXTRACTED' from orders
  union all select 'C:' || o_custkey, 'O:' || o_orderkey, 'taints', 'EXTERNAL' from orders where o_orderstatus = 'F'
  union all (select distinct 'O:' || l_orderkey, 'P:' || l_partkey, 'references', 'EXTRACTED' from lineitem)
  union all (select distinct 'S:' || l_suppkey, 'P:' || l_partkey, 'uses', 'INFERRED' from lineitem)
), edges as (select *, relation || '|' || source || '|' || target as edge_pos from raw_edges)
"""
