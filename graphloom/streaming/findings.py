"""Findings that keep arriving: a directory of JSON lines upserted into a table.

The table is a series of numbered manifests. A manifest names the folder of each
bucket of keys, and the last batch taken in of each stream. A batch writes the
buckets its keys fall in, and no others, into a folder of its own and then a
manifest one number higher than the newest, whatever the batch is numbered.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.edges import upsert
from ..plans.lineage import cut, delete_path

SCHEMA = "relation string, source_id string, target_id string, detail string, confidence string, confidence_score double, seq long"
KEYS = ["relation", "source_id", "target_id"]
BUCKETS, KEPT = 64, 2


def stream(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(directory)


def _manifests(spark: SparkSession, table: str) -> list[dict]:
    """All that are kept, newest first."""
    try:
        rows = spark.read.text(f"{table}/manifest/*").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted((json.loads(r.value) for r in rows), key=lambda m: -m["number"])


def _read(spark: SparkSession, table: str, manifest: dict, buckets: list[str]) -> DataFrame | None:
    folders = sorted({manifest["buckets"][b] for b in buckets})
    out = None
    for folder in folders:
        mine = [int(b) for b in buckets if manifest["buckets"][b] == folder]
        part = spark.read.parquet(f"{table}/{folder}").where(F.col("bucket").isin(mine)).drop("bucket")
        out = part if out is None else out.unionByName(part)
    return out


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as its newest manifest names it; older ones stay readable while a batch is written."""
    found = _manifests(spark, table)
    return _read(spark, table, found[0], list(found[0]["buckets"])) if found else None


def upsert_into(table: str, name: str, buckets: int = BUCKETS):
    """A ``foreachBatch`` function for the stream ``name``; a batch of it that was taken in before changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = _manifests(spark, table)
        newest = found[0] if found else {"number": 0, "buckets": {}, "taken": {}, "modulus": buckets}
        if newest["taken"].get(name, -1) >= batch_id:
            return
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(newest["modulus"])).cast("int")
        new = cut(batch.withColumn("pos", F.col("seq")).withColumn("bucket", bucket), "findings")
        touched = [str(r.bucket) for r in new.select("bucket").distinct().collect()]
        stored = [b for b in touched if b in newest["buckets"]]
        plain = new.drop("bucket")
        old = _read(spark, table, newest, stored) if stored else plain.limit(0)
        merged = upsert(old, plain, KEYS).drop("generation").withColumn("bucket", bucket)
        number = newest["number"] + 1
        folder = f"data/{number:012d}-{uuid.uuid4().hex[:8]}"
        merged.write.partitionBy("bucket").parquet(f"{table}/{folder}")
        state = {"number": number, "modulus": newest["modulus"], "buckets": newest["buckets"] | dict.fromkeys(touched, folder), "taken": newest["taken"] | {name: batch_id}}
        # two writers cannot both make the same number
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("error").text(f"{table}/manifest/{number:012d}")
        _drop_old(spark, table, [state, *found])

    return run


def _drop_old(spark: SparkSession, table: str, manifests: list[dict]) -> None:
    """Folders and manifests that the last ``KEPT`` ones do not need go."""
    needed = {f for m in manifests[:KEPT] for f in m["buckets"].values()}
    for m in manifests[KEPT:]:
        for folder in sorted(set(m["buckets"].values()) - needed):
            delete_path(spark, f"{table}/{folder}")
        delete_path(spark, f"{table}/manifest/{m['number']:012d}")


def _name_of(spark: SparkSession, checkpoint: str) -> str:
    """A name kept inside the checkpoint, so that a new checkpoint, even at an old place, is a new stream."""
    at = f"{checkpoint.rstrip('/')}/stream-name"
    try:
        return spark.read.text(at).first().value
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(at)
    return name


def start(spark: SparkSession, directory: str, table: str, checkpoint: str) -> StreamingQuery:
    """Take in all files there are, then stop; run again for later ones."""
    take = upsert_into(table, _name_of(spark, checkpoint))
    return stream(spark, directory).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
