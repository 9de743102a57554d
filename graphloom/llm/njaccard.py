"""Exact Jaccard join on word n-grams as a blocked sparse product.

The incidence of documents and n-grams is multiplied with its transpose one
block of n-gram columns at a time (a shuffle partition holds a block). Size
bounds keep the product sparse: documents with equal sets are one row; of each
row only the columns that a partner must share at least one of are multiplied
(rarest first, by a fixed-size count sketch of all documents, so common passages
fall outside); a product term is discarded when the sizes, or what is left of
both rows behind the shared column, cannot reach the overlap that the threshold
asks for. For surviving pairs the whole rows are multiplied and the overlap is
compared exactly.

Each row also has a parity bitmap of its n-grams. Differing bits are a lower
bound of the symmetric difference, so most pairs that would fail are discarded
without their rows, and never one that would pass.

Only components are wanted, so pairs are compared until nothing is left that
could join two of them: first one partner a row, then one pair for each two
components, then whatever still lies between two components. A column shared by
more than ``NARROW`` rows is not expanded into all its pairs: each row is paired
with the next few in an order of hashes, which joins most near copies, and only
what is left in several components is paired across them. Nothing is capped.

N-grams stand for themselves as 64-bit hashes, and sets as 128-bit ones: sets
that share the first half are told apart by the other, so only n-grams of two
compared documents can be mistaken for each other, once in some 10^13 pairs of
documents of a thousand words.

Columns that the sketch shows to be very wide are dealt out in salted parts, in
two ways that cross each other, so that no task sorts a column that all
documents share and the parts still hang together; what they leave unconnected
is paired across components like any wide column.

Defined results: words are cut at ASCII white space after lower-casing A-Z; a
document with fewer words than ``n`` has its whole sequence as its one n-gram;
null, empty and blank texts have none and link with nothing; equal documents
link; a null id is passed through with a null component and links with
nothing; ids are cast to long; an id of several rows stands for all of them; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, materialize
from .components import components

#: Counters of the sketch and the blocks it travels in.
SKETCH, SKETCH_BLOCKS = 1 << 20, 64
#: A column with more rows is not expanded into all their pairs.
NARROW = 10
#: Ids of candidates that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Rows of a column, by the sketch, that one part of it holds.
PART = 2048
_SEEN = 100_000
#: Bytes of text whose words are hashed at a time.
_CHUNK = 1 << 18
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte at each place of a word, upper-case letters as their lower-case ones; places repeat after 64, times ``_ROUND`` each time.
_TABLE = np.random.default_rng(20240101).integers(0, 1 << 64, (64, 256), dtype=np.uint64)
_TABLE[:, 0x41:0x5B] = _TABLE[:, 0x61:0x7B]
_ROUND, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _words_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a buffer, and the byte each begins at; a text that begins at one of ``begins`` begins a word."""
    solid = ~_WHITE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = begins[begins < len(data)]
    first[edge] = solid[edge]
    at = np.flatnonzero(first)
    if not len(at):
        return np.array([], dtype=np.uint64), at
    where = np.flatnonzero(solid)
    word = np.cumsum(first[where]) - 1
    place = where - at[word]
    value = _TABLE[place & 63, data[where]]
    if int(place.max()) > 63:
        far = np.flatnonzero(place > 63)
        turns = np.full(int(place.max() >> 6) + 1, _ROUND, dtype=np.uint64)
        turns[0] = 1
        value[far] *= np.cumprod(turns)[place[far] >> 6]
    return _mix(np.add.reduceat(value, np.searchsorted(where, at))), at


class Shingler:
    """Distinct n-gram hashes of many texts at once, straight from a column's bytes."""

    def __init__(self, n: int) -> None:
        self.n = n

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of a buffer and where the words begin, some white-space-bounded bytes at a time."""
        hashes, starts, low = [], [], 0
        while low < len(data):
            high = min(len(data), low + _CHUNK)
            while high < len(data) and not _WHITE[data[high]]:  # never inside a word
                gap = np.flatnonzero(_WHITE[data[high : high + _CHUNK]])
                high = high + int(gap[0]) if len(gap) else min(len(data), high + _CHUNK)
            inside = offsets[(offsets >= low) & (offsets < high)] - low
            h, at = _words_of(data[low:high], inside)
            hashes.append(h)
            starts.append(at + low)
            low = high
        return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.array([], dtype=np.uint64), np.array([], dtype=np.int64))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text its distinct n-grams' hashes, ascending; none for a null or blank one."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.array([], dtype=np.uint8)
        words, at = self._words(raw, offsets[:-1] - offsets[0])
        bounds = np.searchsorted(at, offsets - offsets[0])
        # n-grams of the whole buffer; those that reach over a text's end are not taken below
        grams = self._grams(words, self.n)
        out = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if high - low >= self.n:
                out.append(np.unique(grams[low : high - self.n + 1]))
            else:
                out.append(self._grams(words[low:high], high - low))
        return out

    @staticmethod
    def _grams(w: np.ndarray, n: int) -> np.ndarray:
        if n < 1 or len(w) < n:
            return np.array([], dtype=np.uint64)
        h = _mix(w[: len(w) - n + 1] + np.uint64(n))
        for k in range(1, n):
            h = _mix(h * _STEP + w[k : len(w) - n + 1 + k])
        return h


def set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit keys of a set."""
    digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


class Keys:
    """The key of a set: the first half of its digest, or, for the few that several sets share, the second."""

    def __init__(self, shared: frozenset[int] = frozenset()) -> None:
        self.shared = shared

    def __call__(self, hashes: np.ndarray) -> int:
        first, second = set_keys(hashes)
        return second if first in self.shared else first


def parity(hashes: np.ndarray) -> bytes:
    """How often each place is hit, modulo 2; 2 to 4 places an n-gram. The bitmap of half the places is the halves' XOR."""
    places = 1 << max(8, (2 * len(hashes) - 1).bit_length())
    at = (hashes >> np.uint64(24)).astype(np.int64) & (places - 1)
    return np.packbits(np.bincount(at, minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """At most the symmetric difference of the two sets."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    n, m = len(x), len(y)
    if n < m:
        a, b, n, m = b, a, m, n
    while n > m:
        n //= 2
        a = (a >> 8 * n) ^ (a & ((1 << 8 * n) - 1))
    return (a ^ b).bit_count()


def folded(bits: bytes) -> list[int]:
    """A bitmap folded to 256 places, as four 64-bit numbers."""
    x, n = int.from_bytes(bits, "little"), len(bits)
    while n > 32:
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    return np.frombuffer(x.to_bytes(32, "little"), dtype=np.int64).tolist()


def need(size: int | np.ndarray, num: int, den: int):
    """Least overlap that a set of this size must have with any partner: ceil(threshold * size)."""
    return -(-num * size // den)


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """Size and keys of each document's set, and each task's share of the sketch."""
    schema = "id long, n_shingles long, key long, other long, parity binary, fold array<long>, block int, counts binary"

    names = ["id", "n_shingles", "key", "other", "parity", "fold", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, seen = Shingler(n), np.zeros(SKETCH, dtype=np.uint32), set()
        for b in batches:
            sizes, keys, others, bits, folds, fresh = [], [], [], [], [], []
            for h in shingler.batch(b.column(1)):
                sizes.append(len(h))
                both = set_keys(h)
                keys.append(both[0])
                others.append(both[1])
                bits.append(None)
                folds.append(None)
                if both not in seen:
                    fresh.append(h)
                    bits[-1] = parity(h)
                    folds[-1] = folded(bits[-1])
                    if len(seen) < _SEEN:
                        seen.add(both)
            if fresh:
                counts += np.bincount((np.concatenate(fresh) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            none = len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array(bits, pa.binary()), pa.array(folds, pa.list_(pa.int64())), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
        parts = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(np.split(counts, SKETCH_BLOCKS)) if x.any()]
        none = len(parts)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(none, pa.int64()) for _ in range(4)), pa.nulls(none, pa.binary()), pa.nulls(none, pa.list_(pa.int64())), pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names)

    return map_batches(docs, run, schema)


def _sketch(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' shares on the executors; one byte a counter (16 steps for each doubling) comes back, 1 MB in all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(raw.as_py()), dtype=np.uint32)
                total[k] = total.get(k, 0) + x.astype(np.uint64)
        levels = [np.minimum(255, np.round(16 * np.log2(1 + x.astype(float)) / 2)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["block", "levels"])

    out = np.zeros(SKETCH, dtype=np.uint8)
    wide = SKETCH // SKETCH_BLOCKS
    for r in map_batches(parts.select("block", "counts").repartition(SKETCH_BLOCKS, "block"), add, "block int, levels binary").collect():
        out[r.block * wide : (r.block + 1) * wide] = np.frombuffer(r.levels, dtype=np.uint8)
    return out


def _columns(docs: DataFrame, n: int, num: int, den: int, sketch: np.ndarray, key_of: Keys) -> DataFrame:
    """The columns of each row that its partners must meet: key, size, gram, the part of the column, and how many columns follow."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level, seen = Shingler(n), shared.value, set()
        # at most so many rows have a gram of each level, hence so many parts
        parts = np.ceil(np.exp2((np.arange(256) + 0.5) * 2 / 16) / PART).astype(np.int64)
        for b in batches:
            grams, keys, sizes, rest, part = [], [], [], [], []
            for h in shingler.batch(b.column(1)):
                if not (size := len(h)) or (key := key_of(h)) in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(key)
                some = size - need(size, num, den) + 1
                common = level[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
                if some < size:
                    cut = np.partition(common, some - 1)[some - 1]
                    below, at = np.flatnonzero(common < cut), np.flatnonzero(common == cut)
                    first = np.concatenate([below, at[: some - len(below)]])
                else:
                    first = np.arange(size)
                first = first[np.lexsort((first, common[first]))]
                grams.append(h[first])
                keys.append(np.full(some, key, dtype=np.int64))
                sizes.append(np.full(some, size, dtype=np.int32))
                rest.append(np.arange(size - 1, size - 1 - some, -1, dtype=np.int32))
                several = parts[common[first]]
                part.append(np.where(several > 1, key % several + 1, 0).astype(np.int32))
                if len(again := np.flatnonzero(several > 1)):  # dealt out a second time, another way, so that the parts hang together
                    grams.append(h[first[again]])
                    keys.append(np.full(len(again), key, dtype=np.int64))
                    sizes.append(np.full(len(again), size, dtype=np.int32))
                    rest.append(size - 1 - again.astype(np.int32))
                    part.append(-((key >> 24) % several[again] + 1).astype(np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([g.view(np.int64) for g in grams], part, keys, sizes, rest)], ["gram", "part", "key", "size", "rest"])

    return map_batches(docs, run, "gram long, part int, key long, size int, rest int")


def _rows(docs: DataFrame, n: int, key_of: Keys) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in batches:
            found = shingler.batch(b.column(1))
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.array([], dtype=np.uint64)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([key_of(h) for h in found], pa.int64()), grams], ["key", "grams"])

    return map_batches(docs, run, "key long, grams array<long>")


def _sizes_fit(num: int, den: int):
    return F.least("size", "size_b") * den >= F.greatest("size", "size_b") * num


def _reach_fits(num: int, den: int):
    """What follows the first shared column in both rows can reach the overlap."""
    return (F.least("rest", "rest_b") + 1) * (den + num) >= (F.col("size") + F.col("size_b")) * num


def _plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs whose bitmaps do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).to_numpy()
            apart = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(b.column(3), b.column(4), strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(apart * (den + num) <= total * (den - num)))

    of = classes.select("key", "size", "parity")
    x = pairs.distinct().join(of.select(F.col("key").alias("a"), F.col("size").alias("sa"), F.col("parity").alias("pa")), "a")
    x = x.join(of.select(F.col("key").alias("b"), F.col("size").alias("sb"), F.col("parity").alias("pb")), "b")
    return map_batches(x.select("a", "b", F.col("sa") + F.col("sb"), "pa", "pb"), run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int, key_of: Keys) -> DataFrame:
    """Pairs (a, b) whose whole rows overlap enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = materialize(classes.join(wanted, "key").select(F.col("first").alias("id")), "wanted")
    few = ids.count() <= MOST_BROADCAST
    some = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    rows = materialize(_rows(some, n, key_of), "rows")
    one = pairs.join(rows.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
    both = one.join(rows.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"), (F.size("ga").cast("long") + F.size("gb")).alias("s"))
    return materialize(both.where(F.col("o") * den >= (F.col("s") - F.col("o")) * num).select("a", "b"), "verified")


def _between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends lie in two components, with both."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"l{c}"))
    j = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return j.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).where("la <> lb")


def _settle(pairs: DataFrame, links: DataFrame | None, verify) -> DataFrame:
    """``links`` and enough of the passing ``pairs`` to have the same components as all of them."""
    tested: DataFrame | None = None
    left = pairs
    for turn in ("partner", "components", "rest"):
        if links is not None:
            left = _between(left.select("a", "b"), components(links))
        if tested is not None:
            left = left.join(tested, ["a", "b"], "left_anti")
        left = materialize(left, "left")
        if left.isEmpty():
            break
        if turn == "partner":
            ends = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select(F.col("b"), F.col("a")))
            chosen = ends.groupBy("u").agg(F.min("v").alias("v")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        elif turn == "components":
            chosen = left.groupBy(F.least("la", "lb"), F.greatest("la", "lb")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        else:
            chosen = left.select("a", "b")
        chosen = materialize(chosen, "chosen")
        passed = verify(chosen)
        links = passed if links is None else links.union(passed)
        tested = chosen if tested is None else tested.union(chosen)
    return links if links is not None else pairs.select("a", "b")


def ngram_jaccard(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id``: documents link when den * overlap >= num * union."""
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = materialize(_first_pass(docs, n), "sets")
    sets = first.where("block is null").select("id", "n_shingles", "key", "other", "parity", "fold")
    linked = sets.where("id is not null and n_shingles > 0")
    halves = linked.groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high")
    key_of = Keys(frozenset(r.key for r in halves.select("key").collect()))  # none is expected below some 10^9 sets
    if key_of.shared:
        again = F.when(F.col("key").isin(list(key_of.shared)), F.col("other")).otherwise(F.col("key"))
        sets, linked = sets.withColumn("key", again), linked.withColumn("key", again)
    # max: the bitmap is null where the set had been met before
    classes = materialize(linked.groupBy("key").agg(F.min("id").alias("first"), F.first("n_shingles").alias("size"), F.max("parity").alias("parity"), F.max("fold").alias("fold")), "classes")
    some = docs.where("id is not null")
    columns = _columns(some, n, num, den, _sketch(first.where("block is not null")), key_of).repartition("gram", "part")
    # rows of one class may come from several tasks; most columns hold one row and go before that is sorted out
    several = lambda x: x.withColumn("width", F.count("*").over(Window.partitionBy("gram", "part"))).where("width > 1 or part > 0")
    columns = materialize(several(several(columns).drop("width").dropDuplicates(["gram", "part", "key"])), "columns")
    a, b = F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")
    partner = lambda x, *more: x.select("gram", F.col("key").alias("key_b"), F.col("size").alias("size_b"), F.col("rest").alias("rest_b"), *more)
    # keys are hashes, so the next rows in their order are random ones; in a narrow column they are all there are
    order = Window.partitionBy("gram", "part").orderBy("key")
    is_wide = (F.col("width") > NARROW) | (F.col("part") != 0)
    after = F.array_compact(F.array(*[F.lead(F.struct("key", "size", "rest"), k).over(order) for k in range(1, NARROW)]))
    near = columns.withColumn("after", after).select("key", "size", "rest", is_wide.alias("wide"), F.explode("after").alias("n")).select("key", "size", "rest", "wide", F.col("n.key").alias("key_b"), F.col("n.size").alias("size_b"), F.col("n.rest").alias("rest_b"))
    # a pair may be missed in the wide column where it could first be told, so there the sizes alone decide
    near = near.where(_sizes_fit(num, den) & (F.col("wide") | _reach_fits(num, den))).select(a, b)
    wide = columns.where(is_wide & (F.col("part") >= 0))
    verify = lambda pairs: _verified(pairs, docs, classes, n, num, den, key_of)
    links = _settle(materialize(_plausible(near, classes, num, den), "plausible"), None, verify)
    label = components(links)
    places = [F.col("fold")[k].alias(f"p{k}") for k in range(4)]
    wide = wide.select("gram", "key", "size", "rest").join(classes.select("key", *places), "key")
    wide = materialize(wide.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")), "wide")
    # only columns whose rows are not all connected yet
    split = wide.groupBy("gram").agg(F.min("component").alias("low_c"), F.max("component").alias("high_c")).where("low_c <> high_c").select("gram")
    # sizes that can go together lie in the same or in neighbouring steps of the threshold's ratio, so these are part of the join's key
    step = F.floor(F.log(F.col("size").cast("double")) / float(np.log(den / num)) + 1e-9) if num < den else F.col("size")
    rest = wide.join(split, "gram").withColumn("step", step.cast("long"))
    apart = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(4)), F.lit(0))
    likely = apart * (den + num) <= (F.col("size") + F.col("size_b")) * (den - num)
    others = partner(rest, F.col("component").alias("component_b"), *(F.col(f"p{k}").alias(f"q{k}") for k in range(4)), F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step"))
    across = rest.join(others, ["gram", "step"]).where("key < key_b and component <> component_b").where(_sizes_fit(num, den) & _reach_fits(num, den) & likely).select(a, b)
    links = _settle(materialize(_plausible(across, classes, num, den), "plausible"), links, verify)
    label = components(links)
    named = classes.join(label, classes["key"] == label["node"], "left").select("key", "first", F.coalesce("component", "key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = materialize(named.join(lowest, "component").select("key", "component_id"), "named")
    sets = sets.select("id", "n_shingles", "key")
    out = sets.join(of_class, (sets["key"] == of_class["key"]) & (sets["n_shingles"] > 0) & sets["id"].isNotNull(), "left")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.coalesce("component_id", "id").cast(kind).alias("component_id"))
