"""Hashed text features and the bounded samples that models are fitted on."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches

#: Hash space of feature names.
DIM = 1 << 22
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 100_000


def hashed(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode(errors="surrogatepass")) & (DIM - 1)


def letters(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stem_features(word: str) -> tuple[int, ...]:
    """The word and its first 4 to 6 letters, so that unseen endings of a known stem still count."""
    return (hashed("w" + word), *(hashed("p" + word[:n]) for n in (4, 5, 6) if len(word) >= n))


@dataclass
class Features:
    """``split`` cuts a text into tokens, ``of_token`` and ``of_text`` name features of a token and of the whole text."""

    split: Callable[[str], list[str]]
    of_token: Callable[[str], tuple[int, ...]]
    of_text: Callable[[str, list[str]], list[int]] | None = None

    def all(self, text: str) -> np.ndarray:
        tokens = self.split(text)
        found = {f for t in set(tokens) for f in self.of_token(t)}
        return np.array(sorted(found.union(self.of_text(text, tokens) if self.of_text else ())), dtype=np.int32)


@dataclass
class Weights:
    """A linear score over present features; only features with a weight are kept."""

    features: Features
    weight: dict[int, float]
    bias: float = 0.0
    _memo: Memo | None = field(default=None, repr=False)

    def score(self, text: str) -> float:
        """Of the whole text: every distinct token is looked at."""
        if self._memo is None:
            w = self.weight
            self._memo = Memo(lambda t: tuple(f for f in self.features.of_token(t) if f in w), _MEMO)
        tokens = self.features.split(text)
        found = {f for hit in set(map(self._memo.__getitem__, set(tokens))) for f in hit}
        if self.features.of_text:
            found.update(f for f in self.features.of_text(text, tokens) if f in self.weight)
        self._memo.trim()
        return self.bias + sum(self.weight[f] for f in sorted(found))

    def __getstate__(self) -> dict:
        return {"features": self.features, "weight": self.weight, "bias": self.bias, "_memo": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)


def label_of_ids(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """``id, label``: one row for each labelled id, with its largest label."""
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_label: dict[int, int] | int, id_col: str, text_col: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], made: str) -> list:
    """``id, label`` and the columns ``made`` that ``rows`` makes of a bounded sample of labelled documents.

    At most ``per_label`` ids of each label value, those with the smallest
    xxhash64 of the id; a label given more than once counts with its largest
    value, an id of several documents with the text of smallest hash. The ids
    (bounded) are broadcast, so the documents are read once, and only sampled
    texts, one an id, are shuffled; they stay on the executors, and only what
    ``rows`` makes of them comes back.
    """
    clean = label_of_ids(labels, label_col, id_col)
    bound = lambda v: per_label if isinstance(per_label, int) else per_label.get(v, 0)
    values = [r.label for r in clean.select("label").distinct().collect()] if isinstance(per_label, int) else sorted(per_label)
    picked = []
    for v in sorted(values):
        picked += [(r.id, v) for r in clean.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(bound(v)).select("id").collect()]
    if not picked:
        return []
    kind = labels.schema[id_col].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame(picked, f"id {kind}, label int")
    some = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    one = some.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return map_batches(one, rows, f"id {one.schema['id'].dataType.simpleString()}, label int, {made}").collect()


def screen(rows: list[np.ndarray], target: np.ndarray, most: int, least_rows: int = 3) -> np.ndarray:
    """The features that go best with the target (squared correlation times rows), at most ``most``."""
    if not rows:
        return np.array([], dtype=np.int32)
    which = np.concatenate(rows)
    names, inverse, count = np.unique(which, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y = target - target.mean()
    dot = np.bincount(inverse, weights=y[owner], minlength=len(names))
    n = len(rows)
    spread = count * (1 - count / n)
    power = np.where(spread > 0, dot**2 / np.maximum(spread, 1e-9), 0) / max(float((y**2).mean()), 1e-12)
    order = np.lexsort((names, -power))
    keep = order[(power[order] > 12) & (count[order] >= least_rows)][:most]
    return np.sort(names[keep])


class Sparse:
    """Presence matrix of screened features."""

    def __init__(self, rows: list[np.ndarray], names: np.ndarray) -> None:
        at = [np.searchsorted(names, r) for r in rows]
        ok = [a[(a < len(names)) & (names[np.minimum(a, max(len(names) - 1, 0))] == r if len(names) else False)] for a, r in zip(at, rows, strict=True)]
        self.n, self.m = len(rows), len(names)
        self.col = np.concatenate(ok) if ok else np.array([], dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in ok])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.m)


def adam(start: np.ndarray, grad: Callable[[np.ndarray], np.ndarray], steps: int = 400, rate: float = 0.05) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
