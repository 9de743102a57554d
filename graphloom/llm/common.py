"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, delete_path, new_path, shared_dir  # noqa: F401

#: Rows an Arrow batch may hold on its way to Python. Texts are long, so the
#: default of 10,000 rows would let one batch outgrow a Python worker.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again. ``plans.lineage.clear`` deletes what was written."""
    return cut(df, label)


def crc_bucket(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)



def small_batches(spark: SparkSession) -> None:
    """Cut Arrow batches to ``ARROW_ROWS`` rows and ``ARROW_BYTES`` bytes, where the session leaves them at Spark's defaults; settings of its own stay."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        # what a session has set itself is listed; defaults are not
        if not spark._jsparkSession.conf().getAll().contains(key):
            spark.conf.set(key, str(value))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in small batches, whatever the session: larger ones are looked at ``ARROW_ROWS`` rows at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(b.slice(at, ARROW_ROWS) for b in batches for at in range(0, max(1, b.num_rows), ARROW_ROWS))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Free memory of a worker goes back to the machine when its task ends; workers outlive tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keep_rows(df: DataFrame, column: str, keep: Callable[[list], "list[bool]"]) -> DataFrame:
    """Rows of ``df`` for whose values in ``column`` ``keep`` says so; all columns stay as they are, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(column).to_pylist()), pa.bool_()))

    return map_batches(df, run, df.schema)


_MODELS: dict = {}


def model(key, build: Callable):
    """What ``build`` makes, kept until another key is asked for: one model for each Python worker at a time."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = build()
    return _MODELS[key]


class Memo(dict):
    """A bounded memo in two generations, with lookups at C speed.

    ``memo[key]`` computes missing values; when ``limit`` keys have been added
    the older generation is dropped, and long keys are not kept, so memory
    stays bounded on any stream.
    """

    LONGEST = 64

    __slots__ = ("fn", "limit", "old")

    def __init__(self, fn: Callable, limit: int) -> None:
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.fn(key)
        if len(key) <= self.LONGEST:
            self[key] = found
        return found

    def trim(self) -> None:
        """Called between texts, never while a lookup pass runs."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
