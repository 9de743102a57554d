"""Cutting lineage in the folder all executors share, and clearing up there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where it is unset and everything runs in one process (tests), a
    temporary folder is made and set; on a cluster that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder; executors of {master} do not see local ones")
        known = "file://" + tempfile.mkdtemp(prefix="graphloom-shared-")
        spark.conf.set("spark.checkpoint.dir", known)
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, remembered for ``clear``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    A lost executor costs nothing afterwards, and the files' sizes give the
    planner true statistics.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """Where the intermediates made from now on begin."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediates made since ``mark()``; for when what was computed of them has been written elsewhere."""
    for path in _made[since:]:
        delete_path(spark, path)
    del _made[since:]
