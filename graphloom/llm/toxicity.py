"""Counterfactually regularised toxicity classifier.

A logistic model over hashed word and stem features. Every labelled text of the
sample gives two counterfactual pairs. Where it names an identity, its terms are
swapped for others of the same kind, and taken out; where it names none, two
terms of one kind are put in, each in turn. The squared change of the score
within the pairs is penalised, so that naming a group does not raise the score by
itself, whichever group it is.

Defined results: a null or empty text gets the model's score of no features;
without labels of both kinds the model is the prior; labels for unknown
documents are ignored; an id given to several rows is learned from once, with
the text of smallest hash; repeated documents are scored alike; ids may be of
any type; columns other than id and text are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, keep_rows, map_batches, model
from .hashed import Features, Sparse, Weights, adam, labelled_sample, letters, screen, sigmoid, stem_features

#: Groups of identity terms that may stand for each other: English, French, German, Spanish.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "abled"), ("old", "young"), ("deaf", "hearing"), ("blind", "sighted"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques"), ("homosexuels", "hétérosexuels", "bisexuels"), ("immigrés", "étrangers", "autochtones"), ("handicapés", "valides"), ("vieux", "jeunes"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten"), ("schwule", "lesben", "heterosexuelle", "bisexuelle"), ("einwanderer", "ausländer", "einheimische"), ("behinderte", "nichtbehinderte"), ("alte", "junge"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos"), ("gays", "lesbianas", "heterosexuales", "bisexuales"), ("inmigrantes", "extranjeros", "nativos"), ("discapacitados", "capacitados"), ("viejos", "jóvenes"),
)
#: Bound of the training sample, rows for each label.
SAMPLE = {1: 2048, 0: 4096}
#: Bound of the model, without the terms' own features.
MOST_FEATURES = 20_000
#: Weight of the mean squared score change within pairs.
PENALTY = 4.0
FEATURES = Features(letters, stem_features)
Pair = tuple[np.ndarray, np.ndarray]


class Counterfactuals:
    """Pairs of texts that differ only in the identity terms they name."""

    def __init__(self, terms=IDENTITY_TERMS) -> None:
        self.groups = tuple(terms)
        self.after = {t: g[(i + 1) % len(g)] for g in terms for i, t in enumerate(g)}
        self.found = re.compile(r"(?<![^\W\d_])(" + "|".join(map(re.escape, sorted(self.after, key=len, reverse=True))) + r")(?![^\W\d_])", re.I) if self.after else None

    def swapped(self, text: str) -> str:
        """Each term becomes the next of its group."""
        return self.found.sub(lambda m: self.after.get(m[0].lower(), m[0]), text) if self.found else text

    def without(self, text: str) -> str:
        return self.found.sub(" ", text) if self.found else text

    def texts(self, text: str) -> list[tuple[str, str]]:
        """The two pairs of a text; none without terms to choose from."""
        if not self.groups:
            return []
        if self.found.search(text):
            return [(text, self.swapped(text)), (text, self.without(text))]
        h = xxhash.xxh64_intdigest(text.encode(errors="surrogatepass"))
        group = self.groups[h % len(self.groups)]
        one = group[(h >> 32) % len(group)]
        return [(f"{one} {text}", f"{self.after[one]} {text}"), (text, f"{one} {text}")]

    def pairs(self, text: str, raw: np.ndarray) -> list[Pair]:
        """For each pair: the features that only one side has, and those that only the other has."""
        out = []
        for a, b in self.texts(text):
            x, y = (raw if t is text else FEATURES.all(t) for t in (a, b))
            out.append((np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)))
        return out

    def features(self) -> np.ndarray:
        return np.unique([f for t in self.after for f in stem_features(t)]).astype(np.int32)


@dataclass
class ToxicityModel:
    weights: Weights
    #: Counterfactual pairs that the fit compared.
    pairs: int = 0

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.weights.score(text or "")))


def fit(rows: list[np.ndarray], pairs: list[Pair], y: np.ndarray, penalty: float = PENALTY, ridge: float = 2e-4, prior: float | None = None, terms: np.ndarray | None = None) -> ToxicityModel:
    """Logistic loss + ``penalty`` * mean squared score change within pairs + ``ridge`` * weights squared.

    ``prior``: share of label 1 among all labelled rows, to undo the sample's
    balance. ``terms``: features that take part whatever they tell.
    """
    if len(y) == 0 or y.min() == y.max():
        p = 0.0 if len(y) == 0 else float(y.mean())
        return ToxicityModel(Weights(FEATURES, {}, float(np.log((p + 1e-3) / (1 - p + 1e-3)))))
    names = screen(rows, y, MOST_FEATURES)
    names = np.union1d(names, terms) if terms is not None and len(terms) else names
    pairs = [p for p in pairs if len(p[0]) or len(p[1])]
    x, gone, come = Sparse(rows, names), Sparse([a for a, _ in pairs], names), Sparse([b for _, b in pairs], names)
    n, m = len(y), len(names)

    def grad(p: np.ndarray) -> np.ndarray:
        w = p[:m]
        g = (sigmoid(x.dot(w) + p[m]) - y) / n
        moved = (gone.dot(w) - come.dot(w)) * (2 * penalty / max(1, len(pairs)))
        return np.append(x.back(g) + gone.back(moved) - come.back(moved) + 2 * ridge * w, g.sum())

    p = adam(np.zeros(m + 1), grad)
    bias = p[m]
    if prior and 0 < prior < 1:
        share = y.mean()
        bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    keep = np.abs(p[:m]) > 1e-3
    return ToxicityModel(Weights(FEATURES, dict(zip(names[keep].tolist(), p[:m][keep].tolist(), strict=True)), float(bias)), len(pairs))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 0, sample: dict[int, int] | None = None, terms=IDENTITY_TERMS, penalty: float = PENALTY) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows whose id's crc32 modulo ``modulus`` is not ``held``."""
    swaps = Counterfactuals(terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, gone, come = [], [], []
            for t in b.column(2).to_pylist():
                own = FEATURES.all(t)
                raw.append(own.tobytes())
                pairs = swaps.pairs(t, own)
                gone.append([a.tobytes() for a, _ in pairs])
                come.append([c.tobytes() for _, c in pairs])
            several = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(gone, several), pa.array(come, several)], ["id", "label", "raw", "gone", "come"])

    known = labels.where(crc_bucket(id_col, modulus) != held)
    rows = labelled_sample(docs, known, label_col, sample or SAMPLE, id_col, text_col, features, "raw binary, gone array<binary>, come array<binary>")
    rows.sort(key=lambda r: (r.id, r.raw))
    prior = known.select(F.avg(F.col(label_col).cast("double")).alias("p")).first().p
    array = lambda b: np.frombuffer(b, dtype=np.int32)
    pairs = [(array(a), array(b)) for r in rows for a, b in zip(r.gone, r.come, strict=True)]
    return fit([array(r.raw) for r in rows], pairs, np.array([float(r.label) for r in rows]), penalty, prior=prior, terms=swaps.features())


def _shipped(docs: DataFrame, fitted: ToxicityModel) -> Callable[[], ToxicityModel]:
    """The model (bounded) broadcast as bytes; a worker builds it once and lets go of it for the next model."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fitted))
    return lambda: model(("toxicity", shared.value), lambda: pickle.loads(shared.value))


def score(docs: DataFrame, fitted: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every document: one pass, no shuffle."""
    get = _shipped(docs, fitted)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, held: int = 0, limit: float = 0.5, terms=IDENTITY_TERMS, penalty: float = PENALTY) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; all columns stay, nothing is shuffled."""
    get = _shipped(docs, train(docs, labels, label_col, id_col, text_col, modulus, held, terms=terms, penalty=penalty))
    return keep_rows(docs, text_col, lambda texts: [get().score(t) < limit for t in texts])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, held: int = 0, terms=IDENTITY_TERMS, penalty: float = PENALTY) -> DataFrame:
    """``id_col, held_out, score, predicted``; a null id is not held out."""
    scored = score(docs, train(docs, labels, label_col, id_col, text_col, modulus, held, terms=terms, penalty=penalty), id_col, text_col)
    return scored.select(id_col, F.coalesce(crc_bucket(id_col, modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
