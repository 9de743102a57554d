"""Best-fit packing by exact complements over a histogram of lengths.

Texts become pieces of at most ``capacity`` tokens. How pieces combine depends
on their lengths only, so the plan is made over the counts of each length (at
most ``capacity`` numbers, whatever the data): for the longest length left, an
index of single, pair and triple sums is asked for lengths that fill the gap
exactly, each combination is used as often as the counts allow, and what no
combination fills is packed best-fit. Every step uses up a length, so planning
takes a bounded number of steps; the pieces then take the planned places by
their rank among pieces of their length.

Defined results: a null text counts as empty and gives one piece, the end
token; an empty table gives an empty result; repeated documents are packed each
on its own, as are documents of one id or of none; ties between pieces of one
length go by their place in the table; columns not asked for are ignored, and
``keep`` may not name ``_row``, ``_bucket`` or ``_rank``.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe import byte_chars
from .common import map_batches, materialize, model

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A length may hold most of all pieces, so its pieces are ranked in buckets: of so many pieces at
#: least, and at most so many buckets beside one for each length.
RANKED, BUCKETS = 1000, 10_000
#: Characters encoded at a time.
SLICE = 1 << 20
_BEFORE_WORD, _GAP = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"(?<=\S) (?=\S)")
_PLAIN = "ԯ"  # beyond it, Unicode versions differ on letters; the file's own library decides


class Ids:
    """Token ids of texts as little-endian uint32; the vocabulary's ranks are all that the plain letters need.

    Only words with letters beyond ``_PLAIN`` go to the file's own library. A
    pre-token never spans the gap before a single space, so texts may be cut there.
    """

    def __init__(self, spec: str, end: int) -> None:
        j = json.loads(spec)
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in j["model"]["vocab"].items() if t not in special}
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_str(spec)
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.end = end

    def _ordinary(self, text: str) -> list[int]:
        if text.isascii() or max(text) <= _PLAIN:
            return self.encode(text) if len(text) <= SLICE else [i for x in self._slices(text) for i in self.encode(x)]
        out = []
        for plain, run in groupby(_BEFORE_WORD.split(text), lambda w: not w or max(w) <= _PLAIN):
            part = "".join(run)
            out += self.encode(part) if plain else self.library.encode(part, add_special_tokens=False).ids
        return out

    @staticmethod
    def _slices(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + SLICE)
            to = gap.start() if gap else len(text)
            yield text[at:to]
            at = to

    def of(self, text: str) -> array:
        out = []
        if self.cut and any(map(text.__contains__, self.special)):
            for part in self.cut(text):
                out += [self.special[part]] if part in self.special else self._ordinary(part)
        else:
            out = self._ordinary(text)
        out.append(self.end)
        return array("I", out)


def pieces(docs: DataFrame, tokenizer_path: str, end: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32``, with ``tokens=True`` also ``ids``, and the columns ``keep``: only documents over ``capacity`` are cut, their first piece takes the remainder."""
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path).read())
    carried = docs.select(F.col(id_col), F.col(text_col), *(F.col(c) for c in keep))
    fields = [f"`{id_col}` {carried.schema[0].dataType.simpleString()}", "piece int", "start long", "length long", "ids_crc32 long", *(["ids array<int>"] if tokens else [])]
    fields += [f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[2:]]
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if tokens else []), *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model(("packing", spec.value, end), lambda: Ids(spec.value, end)).of
        for batch in batches:
            encoded = [encode(t or "") for t in batch.column(1).to_pylist()]
            n = np.array([len(ids) for ids in encoded], dtype=np.int64)
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            head = np.repeat(n - (many - 1) * capacity, many)
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            views = list(map(memoryview, encoded))
            crc = [zlib.crc32(views[i][x:y]) for i, x, y in zip(row.tolist(), start.tolist(), (start + length).tolist(), strict=True)]
            which = pa.array(row)
            arrays = [pc.take(batch.column(0), which), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if tokens:  # pieces follow one another as their documents' ids do
                flat = np.concatenate([np.frombuffer(ids, dtype=np.int32) for ids in encoded]) if encoded else np.array([], dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat)))
            arrays += [pc.take(batch.column(k), which) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(carried, run, ", ".join(fields))


class Sums:
    """Index of the single, pair and triple sums of the lengths in stock, under their counts.

    ``pairs[s]`` lists the longer part ``a`` of each pair ``a + b = s``,
    ``triples[s]`` the longest part of each triple, shortest first. A list is
    looked through from its end; entries whose lengths have run out leave it,
    and as counts only fall they never come back.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.tolist()
        capacity = len(counts) - 1
        stock = [k for k in range(1, capacity + 1) if self.n[k]]
        self.pairs: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.triples: list[list[int]] = [[] for _ in range(capacity + 1)]
        for a in stock:
            for b in stock:
                if b > a or a + b > capacity:
                    break
                self.pairs[a + b].append(a)
        for a in stock:
            for rest in range(2, capacity + 1 - a):
                if self.pairs[rest] and self.pairs[rest][0] <= a:
                    self.triples[a + rest].append(a)

    def free(self, length: int, held: tuple[int, ...]) -> bool:
        return self.n[length] > held.count(length)

    def pair(self, gap: int, held: tuple[int, ...], most: int) -> tuple[int, ...] | None:
        found = self.pairs[gap]
        k = bisect_right(found, most)
        for a in reversed(found[:k]):
            if self.free(a, held) and self.free(gap - a, (*held, a)):
                return a, gap - a
        if k == len(found):
            self.pairs[gap] = [a for a in found if self.n[a] and self.n[gap - a]]
        return None

    def triple(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        found = self.triples[gap]
        for a in reversed(found):
            if self.free(a, held) and (rest := self.pair(gap - a, (*held, a), a)):
                return a, *rest
        self.triples[gap] = [a for a in found if self.n[a] and self.pairs[gap - a]]
        return None

    def exact(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """Lengths in stock beside ``held`` that fill ``gap`` exactly, as few as can be."""
        return (gap,) if self.free(gap, held) else self.pair(gap, held, gap) or self.triple(gap, held)

    def fitting(self, gap: int, held: tuple[int, ...]) -> int:
        """Longest length in stock beside ``held`` that fits into ``gap``; 0 if there is none."""
        return next((k for k in range(gap, 0, -1) if self.n[k] and self.free(k, held)), 0)

    def use(self, parts: tuple[int, ...]) -> int:
        """Takes the parts as often as the counts allow; how often that is."""
        need = Counter(parts)
        times = min(self.n[p] // k for p, k in need.items())
        for p, k in need.items():
            self.n[p] -= times * k
        return times


def plan(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), using every counted length up.

    From the longest length down, the index is asked for lengths that fill its
    gap exactly, and each combination is used as often as the counts allow. What
    no combination fills is packed best-fit: the longest piece that fits goes
    in, and the index is asked again for the gap that it leaves.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    sums, done = Sums(counts), []
    for length in range(capacity, 0, -1):
        while sums.n[length]:
            parts: tuple[int, ...] = (length,)
            while (gap := capacity - sum(parts)) > 0:
                if rest := sums.exact(gap, parts):
                    parts += rest
                elif fit := sums.fitting(gap, parts):
                    parts += (fit,)
                else:
                    break
            done.append((parts, sums.use(parts)))
    return done


def places(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), by rank; ranks follow the plan."""
    used, runs, sequence = [0] * (capacity + 1), {}, 0
    for parts, times in planned:
        offset = 0
        for p in parts:
            runs.setdefault(p, []).append((used[p], sequence, offset))
            used[p] += times
            offset += p
        sequence += times
    return {p: np.array(r, dtype=np.int64) for p, r in runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, end: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and a gapless ``offset`` for each.

    Texts are encoded once; the pieces are written to the shared folder with a
    number for each row, as they are read again for the counts and for the
    places. Whole sequences, most of the pieces of long documents, take that
    number as their sequence's and are not shuffled. The others are ranked in
    buckets of their length; to the driver come ``capacity`` counts and at most
    ``capacity + BUCKETS`` counts of buckets, and the plan that goes back is
    bounded by ``capacity`` alone.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, end, capacity, id_col, text_col, tokens, keep).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    part = cut.where(F.col("length") < capacity)
    histogram = {r.length: r["count"] for r in part.groupBy("length").count().collect()}
    each = max(RANKED, -(-sum(histogram.values()) // BUCKETS))
    buckets = [-(-histogram.get(length, 0) // each) for length in range(1, capacity + 1)]
    part = part.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.expr(f"element_at(array({', '.join(map(str, buckets))}), cast(length as int))")).cast("int"))
    base, at = {}, dict.fromkeys(histogram, 0)
    for r in sorted(part.groupBy("length", "_bucket").count().collect()):
        base[r.length, r["_bucket"]] = at[r.length]
        at[r.length] += r["count"]
    planned = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast((base, places(planned, capacity)))
    ranked = part.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")))
    kept = [c for c in cut.columns if c != "_row"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, runs = shared.value
        for b in batches:
            lengths, buckets, ranks = (b.column(c).to_numpy() for c in ("length", "_bucket", "_rank"))
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for p, bucket in {*zip(lengths.tolist(), buckets.tolist(), strict=True)}:
                mine, run = (lengths == p) & (buckets == bucket), runs[p]
                rank = ranks[mine] - 1 + base[p, bucket]
                k = np.searchsorted(run[:, 0], rank, side="right") - 1
                sequence[mine] = run[k, 1] + rank - run[k, 0]
                offset[mine] = run[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "_row")
    whole = cut.where(F.col("length") == capacity).select(*kept, (F.col("_row") + sum(times for _, times in planned)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return map_batches(ranked, put, f"{fields}, sequence_id long, offset long").unionByName(whole)
