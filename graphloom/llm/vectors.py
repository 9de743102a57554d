"""Reading vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


def usable(vector: list | None) -> np.ndarray | None:
    """The vector in double precision; None if null, empty, zero, or with a null or non-finite component."""
    if not vector or None in vector:
        return None
    x = np.array(vector, dtype=np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dim, key, other, vector``: usable vectors with a non-null id, as bytes (float32 where that is what the column holds); ``key`` and ``other`` are the halves of a 128-bit hash of the bytes."""
    half = "float" in df.schema[vector_col].dataType.simpleString()
    dtype = np.float32 if half else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, keys, others, raw = [], [], [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (x := usable(v)) is not None:
                    ids.append(i)
                    dims.append(len(x))
                    raw.append((x + 0.0).astype(dtype).tobytes())  # -0.0 becomes 0.0
                    digest = xxhash.xxh3_128_intdigest(raw[-1], len(x))
                    keys.append((digest >> 64) - (1 << 63))
                    others.append((digest & ((1 << 64) - 1)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array(raw, pa.binary())], ["id", "dim", "key", "other", "vector"])

    return map_batches(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col)), run, "id long, dim int, key long, other long, vector binary")


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows in double precision."""
    if not len(raw):
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(raw), dtype=np.float32 if len(raw[0]) == 4 * dim else np.float64).reshape(len(raw), dim).astype(np.float64)
