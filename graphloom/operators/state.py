"""Snapshots of a graph, one partition a slot, and what has to be computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, reason``: files of the manifest that were edited or deleted."""
    now = files.select("path", F.col("md5").alias("now"))
    j = manifest.join(now, "path", "left")
    return j.where("now is null or now <> md5").select("path", F.when(F.col("now").isNull(), "deleted").otherwise("edited").alias("reason"))


def stale_shown(shown: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, reason`` for the files of a pack: not in the manifest, unreadable or edited."""
    j = shown.select("path").distinct().join(manifest.select("path", F.col("md5").alias("known")), "path", "left").join(files.select("path", F.col("md5").alias("now")), "path", "left")
    reason = F.when(F.col("known").isNull(), "not_in_manifest").when(F.col("now").isNull(), "unreadable").when(F.col("known") != F.col("now"), "edited")
    return j.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def trustworthy(version: Column, is_ancestor: Column) -> Column:
    """A stamped slot is trusted if it has this version and its commit is an ancestor; one without a stamp is trusted."""
    return F.coalesce((version == VERSION) & is_ancestor, version.isNull())


def decision(detached: Column, cached: Column, trusted: Column) -> Column:
    """What a switch has to do: full or incremental."""
    return F.when(detached | ~cached | ~trusted, "full").otherwise("incremental")


def write_slot(df: DataFrame, path: str, slot: str) -> None:
    """Replace one slot and leave the others."""
    df.withColumn("slot", F.lit(slot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)


def read_slot(spark: SparkSession, path: str, slot: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("slot") == slot).drop("slot")


def seed_slot(spark: SparkSession, path: str, active: str, new: str) -> None:
    """A new slot starts as a copy of the active one."""
    write_slot(read_slot(spark, path, active), path, new)


def refresh(known: DataFrame, manifest: DataFrame, files: DataFrame, extract, now: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, report): rows of files that did not change are kept, changed and new ones are extracted again.

    ``known`` has a ``path`` column; ``extract`` takes files (path, text, md5) and
    returns rows like ``known``. Deleted files lose their rows. ``still_stale``
    tells the files that changed once more meanwhile, by their hashes in ``now``
    (path, md5), or that gave no rows though they should have.
    """
    changed = stale(manifest, files)
    added = files.join(manifest.select("path"), "path", "left_anti").select("path", F.lit("added").alias("reason"))
    todo = changed.unionByName(added)
    again = files.join(todo.select("path"), "path", "left_semi")
    rows = known.join(todo.select("path"), "path", "left_anti").unionByName(extract(again))
    if now is None:
        return rows, todo.withColumn("still_stale", F.lit(False))
    seen = files.select("path", "md5").join(todo.select("path"), "path", "left_semi")
    moved = stale(seen, now).select("path", F.lit(True).alias("moved"))
    return rows, todo.join(moved, "path", "left").select("path", "reason", F.coalesce("moved", F.lit(False)).alias("still_stale"))


def render_refresh(report: DataFrame) -> DataFrame:
    """``text``: a refresh in one line a file, by reason and path."""
    line = F.concat(F.col("reason"), F.lit(" "), F.col("path"), F.when(F.col("still_stale"), " (still stale)").otherwise(""))
    return report.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
