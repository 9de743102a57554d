"""Writing graphs, findings, stamps and results.

What replaces a whole table is written beside it and renamed into place, so that
readers see the old table or the new one. What replaces a part of one is a
dynamic overwrite of its partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graph import Graph


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _put_in_place(spark: SparkSession, staged: str, path: str) -> None:
    """``staged`` becomes ``path``; what was there goes once it has been moved aside."""
    system, at = _system(spark, path)
    _, new = _system(spark, staged)
    _, old = _system(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = system.exists(at)
    if had and not system.rename(at, old):
        raise OSError(f"{path} cannot be moved aside")
    if not system.rename(new, at):
        if had:
            system.rename(old, at)
        raise OSError(f"{staged} cannot be renamed to {path}")
    if had:
        system.delete(old, True)


def _staged(path: str) -> str:
    return f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"


def replace_table(df: DataFrame, path: str, *partitions: str) -> None:
    """The rows replace the table as a whole. The table may be one that ``df`` reads."""
    staged = _staged(path)
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(staged)
    _put_in_place(df.sparkSession, staged, path)


def write_graph(graph: Graph, path: str) -> None:
    """Nodes and edges as Parquet under ``path``, replaced together."""
    staged = _staged(path)
    graph.nodes.write.parquet(f"{staged}/nodes")
    graph.edges.write.partitionBy("relation").parquet(f"{staged}/edges")
    _put_in_place(graph.nodes.sparkSession, staged, path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, replaced as a whole."""
    staged = _staged(path)
    df.write.json(staged)
    _put_in_place(df.sparkSession, staged, path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """One line a row behind what is there."""
    df.write.mode("append").json(path)


def merge_parts(df: DataFrame, path: str, part: str = "repo") -> None:
    """Results of the parts in ``df`` (repositories, producers) replace those parts' and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def write_stamp(spark: SparkSession, path: str, branch: str, base_commit: str | None, version: int, supplement: bool = False) -> None:
    """What a slot was built from, when, and whether a supplement is wanted in it: one row."""
    row = spark.createDataFrame([(branch, base_commit, version, supplement)], "branch string, base_commit string, version int, supplement boolean")
    write_json(row.withColumn("written", F.current_timestamp()).coalesce(1), path)


def read_stamp(spark: SparkSession, path: str) -> DataFrame:
    """The stamp, or no row where there is none."""
    schema = "branch string, base_commit string, version int, supplement boolean, written timestamp"
    system, at = _system(spark, path)
    return spark.read.schema(schema).json(path) if system.exists(at) else spark.createDataFrame([], schema)


def write_snapshot(prints: DataFrame, path: str) -> None:
    """Edge fingerprints (id, edges) before a change, to be held against those after it."""
    replace_table(prints, path)
