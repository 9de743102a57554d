"""Ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(score - threshold_k): one shared weight vector over
hashed text features, thresholds kept in order. Gives an expected grade and the
probability of reaching a wanted grade, by which documents are selected. Grades
are sampled up to a bound each; a sampled row weighs as many labelled ids as it
stands for, so that the result does not depend on where the bound cuts.

Defined results: a null or empty text gets the score of an empty text; with one
grade only, that grade is expected everywhere, without labels 0; repeated
documents are rated alike; ids may be of any type; an empty table gives an empty
result; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_batches, model
from .hashed import Features, Sparse, Weights, adam, hashed, label_of_ids, labelled_sample, screen, sigmoid

#: Bound of the training sample, rows for each grade.
SAMPLE = 3072
MOST_FEATURES = 20_000
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def token_features(token: str) -> tuple[int, ...]:
    """The lower-cased token, and its shape: runs of letters as ``a`` (``A`` if upper case), of digits as ``9``."""
    shape = _DIGITS.sub("9", _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", token))
    return hashed("w" + token.lower()), hashed("s" + shape)


def text_features(text: str, tokens: list[str]) -> list[int]:
    """Size, share of plain words, repetition of words and of lines, in coarse steps."""
    n = len(tokens)
    if not n:
        return [hashed("empty")]
    plain = sum(map(str.isalpha, tokens)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    twice = sum(c for c in Counter(lines).values() if c > 1) / max(1, len(lines))
    distinct = len(set(tokens)) / n
    upper = sum(map(str.isupper, tokens)) / n
    step = lambda name, v: hashed(f"{name}{v}")
    return [step("n", int(math.log2(n))), step("plain", round(plain * 10)), step("lines", round(twice * 10)), step("distinct", round(distinct * 10)), step("upper", round(upper * 10)), step("mean", min(30, round(len(text) / n)))]


FEATURES = Features(str.split, token_features, text_features)


@dataclass
class OrdinalModel:
    weights: Weights
    grades: list[int]
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k but the highest."""
        return sigmoid(self.weights.score(text or "") - self.thresholds)


def fit(rows: list[np.ndarray], grade: np.ndarray, ridge: float = 5e-4, weight: np.ndarray | None = None) -> OrdinalModel:
    """``weight``: labelled ids that each row stands for, equal unless given."""
    grades = sorted({int(g) for g in grade}) or [0]
    if len(grades) == 1:
        return OrdinalModel(Weights(FEATURES, {}), grades, np.array([]))
    level = np.searchsorted(grades, grade)
    names = screen(rows, level.astype(float), MOST_FEATURES)
    x, n, m, k = Sparse(rows, names), len(rows), len(names), len(grades) - 1
    above = (level[:, None] > np.arange(k)).astype(float)  # n x k
    weight = np.ones(n) if weight is None else weight * (n / weight.sum())

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.concatenate([p[m : m + 1], p[m] + np.cumsum(np.exp(p[m + 1 :]))])

    def grad(p: np.ndarray) -> np.ndarray:
        s, t = x.dot(p[:m]), thresholds(p)
        # the likelihood of a grade is the difference of neighbouring tails
        tail = np.column_stack([np.ones(n), sigmoid(s[:, None] - t), np.zeros(n)])
        like = np.maximum(tail[np.arange(n), level] - tail[np.arange(n), level + 1], 1e-9)
        slope = tail * (1 - tail)
        like /= weight
        ds = -(slope[np.arange(n), level] - slope[np.arange(n), level + 1]) / like / n
        dt = np.zeros(k)
        for j in range(k):
            dt[j] = (np.where(level == j + 1, slope[:, j + 1] / like, 0) - np.where(level == j, slope[:, j + 1] / like, 0)).sum() / n
        steps = np.array([dt[j:].sum() for j in range(k)])
        steps[1:] *= np.exp(p[m + 1 :])
        return np.concatenate([x.back(ds) + 2 * ridge * p[:m], steps])

    start = np.zeros(m + k)
    share = np.average(above, axis=0, weights=weight).clip(1e-3, 1 - 1e-3)
    t0 = -np.log(share / (1 - share))
    start[m] = t0[0]
    start[m + 1 :] = np.log(np.maximum(np.diff(t0), 1e-2))
    p = adam(start, grad)
    keep = np.abs(p[:m]) > 1e-3
    return OrdinalModel(Weights(FEATURES, dict(zip(names[keep].tolist(), p[:m][keep].tolist(), strict=True))), grades, thresholds(p))


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 0, sample: int = SAMPLE) -> OrdinalModel:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [FEATURES.all(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["id", "label", "raw"])

    known = labels.where(crc_bucket(id_col, modulus) != held)
    rows = labelled_sample(docs, known, grade_col, sample, id_col, text_col, features, "raw binary")
    rows.sort(key=lambda r: (r.id, r.raw))
    counts = {r.label: r["count"] for r in label_of_ids(known, grade_col, id_col).groupBy("label").count().collect()}
    weight = np.array([counts[r.label] / min(counts[r.label], sample) for r in rows])
    return fit([np.frombuffer(r.raw, dtype=np.int32) for r in rows], np.array([r.label for r in rows]), weight=weight)


def quality(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", wanted: int | None = None, least: float = 0.5, modulus: int = 5, held: int = 0) -> DataFrame:
    """``id_col, held_out, expected_grade, tail, selected``.

    ``tail``: P(grade >= ``wanted``), by default the highest grade; selected
    where that is at least ``least``. One pass over the documents, no shuffle.
    """
    fitted = train(docs, labels, grade_col, id_col, text_col, modulus, held)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fitted))
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = fitted.grades[-1] if wanted is None else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(("quality", shared.value), lambda: pickle.loads(shared.value))
        gaps = np.diff(m.grades).astype(float)
        k = int(np.searchsorted(m.grades, wanted))
        for b in batches:
            expected, tail = [], []
            for t in b.column(1):
                over = m.tails(t.as_py())
                expected.append(float(m.grades[0] + (gaps * over).sum()))
                tail.append(1.0 if k == 0 else 0.0 if k >= len(m.grades) else float(over[k - 1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], [id_col, "expected_grade", "tail"])

    rated = map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, expected_grade double, tail double")
    return rated.select(id_col, F.coalesce(crc_bucket(id_col, modulus) == held, F.lit(False)).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= least).alias("selected"))
