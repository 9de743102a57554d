"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits by random directions near the median; vectors close to a split
go down both sides (spill), so that a pair is seldom parted, and several trees
make it rarer still. All pairs within a leaf are compared exactly. The upper part
of a tree is fitted on a bounded sample and broadcast; a leaf that comes out
larger than wished is split further by a tree of its own, fitted on a sample of
that leaf in a task of its own, until no leaf is too large or can be split. So
leaves, and the work for a vector, stay of one size however many vectors there are.

A pair may meet in several leaves and trees. It is counted only in the first
leaf it shares, which each side's list of leaves tells, so nothing has to be
emitted for each pair: a leaf returns one row a vector, with its number of
links and the smallest vector it hangs together with. Identical vectors are one
row with a count. A leaf that cannot be split well, such as thousands of near
copies, stays whole and is compared in blocks, each pair of blocks in a task of
its own.

Vectors are told apart by 128-bit hashes of their bytes, and a hash that stood
for two vectors would stop the run.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, link with nothing and are kept; only
vectors of equal length are compared; rows repeated with one id count each
other as links; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .components import components
from .vectors import matrix, packed

#: Bounds: vectors the upper trees are fitted on (of all lengths together), trees, wished size of a leaf, rows of a block.
SAMPLE, TREES, LEAF, BLOCK = 16_384, 5, 400, 1024
#: Least sampled vectors in a node that is split, and greatest share a split may send both ways.
LEAST, SPILLED = 24, 0.4
#: Half-width of the spill zone, in standard deviations of a linked pair's gap along a random direction.
SPILL = 0.6
_CODES = np.uint64(0x9E3779B97F4A7C15)


def _code(parent: np.ndarray | int, leaf: np.ndarray) -> np.ndarray:
    """Numbers for the leaves of a tree that stands in the place of ``parent``; two leaves that shared one would only be compared as one."""
    x = (np.asarray(parent, dtype=np.int64).view(np.uint64) + np.uint64(1)) * _CODES + np.asarray(leaf, dtype=np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class Tree:
    """Splits as arrays: direction, threshold and children of each node; leaves have no children."""

    def __init__(self, sample: np.ndarray, depth: int, margin: float, seed: int) -> None:
        self.margin, self.directions, self.thresholds, self.children = margin, [], [], []
        self.rng, self.leaves = np.random.default_rng(seed), 0
        self.sample = sample
        self.root = self._split(np.arange(len(sample)), depth)
        del self.sample, self.rng

    def _split(self, rows: np.ndarray, depth: int) -> int:
        """Node number, or ~leaf number."""
        if depth > 0 and len(rows) >= LEAST:
            best = None
            for _ in range(6):
                u = self.rng.standard_normal(self.sample.shape[1])
                u /= np.linalg.norm(u)
                x = self.sample[rows] @ u
                for q in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
                    t = float(np.quantile(x, q))
                    both = float((np.abs(x - t) <= self.margin).mean())
                    cost = both + abs(q - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, both, u, t, x)
            _, both, u, t, x = best
            left, right = rows[x <= t + self.margin], rows[x >= t - self.margin]
            if both <= SPILLED and max(len(left), len(right)) < 0.9 * len(rows):
                node = len(self.children)
                self.directions.append(u)
                self.thresholds.append(t)
                self.children.append((0, 0))
                self.children[node] = (self._split(left, depth - 1), self._split(right, depth - 1))
                return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, x: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(rows, leaf) for each leaf that gets rows."""
        out, todo = [], [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, ~node))
                continue
            d = x[rows] @ self.directions[node] - self.thresholds[node]
            left, right = self.children[node]
            todo += [(left, rows[d <= self.margin]), (right, rows[d >= -self.margin])]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares must neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hang_together(linked: np.ndarray) -> np.ndarray:
    """Smallest index each index is connected to, by a symmetric boolean matrix."""
    n = len(linked)
    low = np.arange(n)
    while True:
        near = np.where(linked, low[None, :], n).min(axis=1, initial=n)
        new = np.minimum(low, near)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def compare(keys: np.ndarray, x: np.ndarray, weight: np.ndarray, leaves: list[np.ndarray], here: int, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector that are first met here, and the smallest key it hangs together with here.

    ``side``: 0 and 1 for the two blocks of a task, whose cross pairs it
    compares; one block only (all equal) is compared with itself.
    """
    n = len(keys)
    x = unit(x)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    codes, inverse = np.unique(np.concatenate(leaves), return_inverse=True)
    member = np.zeros((n, int(np.searchsorted(codes, here))), dtype=np.float32)
    owner = np.repeat(np.arange(n), [len(p) for p in leaves])
    earlier = inverse < member.shape[1]
    member[owner[earlier], inverse[earlier]] = 1
    first = linked & (member @ member.T < 0.5) if member.shape[1] else linked
    order = np.argsort(keys, kind="stable")
    low = np.empty(n, dtype=np.int64)
    low[order] = keys[order][hang_together(linked[np.ix_(order, order)])]
    return first @ weight, low


def _routed(tree: Tree, x: np.ndarray, parent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf code) of all rows, for each leaf they go to."""
    got = tree.route(x)
    if not got:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    leaf = np.concatenate([np.full(len(rows), at) for rows, at in got])
    return np.concatenate([rows for rows, _ in got]), _code(np.full(len(leaf), parent), leaf)


def _split_further(met: DataFrame, big: DataFrame, leaf: int, margin_of: Callable[[int], float], sample: int) -> tuple[DataFrame, DataFrame]:
    """(rows in their new leaves, leaves that do not split) of the rows ``met`` in the leaves ``big`` (leaf, n).

    Each leaf's tree is fitted by one task on some ``sample`` rows of it. Rows
    and trees then lie sorted by leaf, a very large leaf in several parts, and
    rows stream past the tree of their leaf.
    """
    schema = "leaf long, tree binary"
    inside = met.join(big, "leaf")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        x = unit(matrix(group.vector.tolist(), int(group.dim.iloc[0])))
        depth = max(1, int(np.ceil(np.log2(max(2, int(group.n.iloc[0]) / leaf)))))
        tree = Tree(x, depth, margin_of(x.shape[1]), int(group.leaf.iloc[0]) & 0x7FFFFFFF)
        return pd.DataFrame({"leaf": group.leaf.iloc[:1], "tree": [pickle.dumps(tree) if tree.leaves > 1 else None]})

    chosen = inside.where(F.pmod(F.xxhash64("key", "leaf"), F.col("n")) < sample)
    trees = materialize(chosen.groupBy("leaf").applyInPandas(fit, schema), "trees")
    parts = F.ceil(F.col("n") / F.lit(16 * sample)).cast("int")
    some = inside.join(trees.where("tree is not null").select("leaf"), "leaf")
    rows = some.select("leaf", F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"), F.lit(1).alias("turn"), "key", "dim", "copies", "vector")
    lead = trees.where("tree is not null").join(big, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("dim"), F.lit(None).cast("long").alias("copies"), F.col("tree").alias("vector"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree = None, None
        for b in batches:
            leaves, turns = b.column(0).to_numpy(), b.column(2).to_numpy()
            edges = np.flatnonzero(np.diff(leaves) != 0) + 1
            for low, high in zip([0, *edges], [*edges, len(leaves)], strict=True):
                while low < high and turns[low] == 0:
                    here, tree = int(leaves[low]), pickle.loads(b.column(6)[low].as_py())
                    low += 1
                if low == high:
                    continue
                part = b.slice(low, high - low).take(pa.array(np.flatnonzero(turns[low:high] == 1)))
                assert here == int(leaves[low]), "rows came before their tree"
                row, code = _routed(tree, unit(matrix(part.column(6).to_pylist(), int(part.column(4)[0].as_py()))), here)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(3).take(at), part.column(4).take(at), part.column(5).take(at), part.column(6).take(at), pa.array(code)], ["key", "dim", "copies", "vector", "leaf"])

    mixed = rows.unionByName(lead).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "turn")
    moved = materialize(map_batches(mixed, route, "key long, dim int, copies long, vector binary, leaf long"), "split")
    return moved, trees.where("tree is null").select("leaf")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """``id_col, n_links, component_id, kept``."""
    kind = vectors.schema[id_col].dataType
    spark = vectors.sparkSession
    rows = materialize(packed(vectors, id_col, vector_col), "vectors")
    one = rows.groupBy("key", "other").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.min("vector").alias("vector"), F.max("vector").alias("same"))
    sure = F.when(F.col("vector") == F.col("same"), F.col("vector")).otherwise(F.raise_error(F.lit("two vectors have one 128-bit hash")).cast("binary"))
    # a class is known by its row number from here on
    classes = materialize(one.select(F.monotonically_increasing_id().alias("key"), F.col("key").alias("half"), "other", "first", "copies", "dim", sure.alias("vector")), "classes")
    dims = {r.dim: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    # the samples of all lengths together stay within one bound
    share = max(LEAST, sample // max(1, len(dims)))
    margin_of = lambda dim: SPILL * np.sqrt(max(0.0, 2 - 2 * cosine) / dim)
    total = spark.createDataFrame(list(dims.items()), "dim int, n long")
    chosen = classes.join(F.broadcast(total), "dim").where(F.pmod(F.xxhash64("half", "other"), F.col("n")) < share)
    samples: dict[int, list] = {dim: [] for dim in dims}
    for r in chosen.select("dim", "half", "other", "vector").collect():
        samples[r.dim].append(((r.half, r.other), bytes(r.vector)))
    forests: dict[int, list[Tree]] = {}
    for dim, some in samples.items():
        x = unit(matrix([v for _, v in sorted(some)], dim))
        depth = max(0, int(np.ceil(np.log2(max(1, dims[dim] / leaf)))))
        forests[dim] = [Tree(x, depth, margin_of(dim), seed) for seed in range(trees)]
    shared = spark.sparkContext.broadcast(forests)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                x = unit(matrix(part.column(3).to_pylist(), dim))
                found = [_routed(tree, x, dim << 8 | t) for t, tree in enumerate(shared.value[dim])]
                row, code = np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])
                order = np.lexsort((code, row))
                offsets = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[order]))], ["key", "dim", "copies", "vector", "leaves"])

    routed = map_batches(classes.select("key", "dim", "copies", "vector"), route, "key long, dim int, copies long, vector binary, leaves array<long>")
    met = routed.select("key", "dim", "copies", "vector", "leaves", F.explode("leaves").alias("leaf"))
    count = lambda df: df.groupBy("leaf").agg(F.count("*").alias("n"))
    most = 2 * leaf
    sizes = materialize(count(routed.select(F.explode("leaves").alias("leaf"))).where(F.col("n") > most), "leaves")
    whole: DataFrame | None = None  # leaves that do not split
    moved = False
    while True:
        big = sizes if whole is None else sizes.join(whole, "leaf", "left_anti")
        if big.isEmpty():
            break
        again, stuck = _split_further(met.select("key", "dim", "copies", "vector", "leaf"), big, leaf, margin_of, share)
        whole = materialize(stuck if whole is None else whole.unionByName(stuck), "whole")
        if again.isEmpty():
            break
        gone = big.join(stuck, "leaf", "left_anti").select("leaf")
        met = again.unionByName(met.select("key", "dim", "copies", "vector", "leaf").join(gone, "leaf", "left_anti"))
        sizes, moved = materialize(count(met).where(F.col("n") > most), "leaves"), True
    if moved:
        lists = met.groupBy("key").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
        met = met.distinct().join(lists, "key")
    blocks = sizes.where(F.col("n") > block).select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = met.join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "dim", "copies", "vector", "leaves", "leaf", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        side = (group.mine != group.i).to_numpy().astype(int)
        keys = group.key.to_numpy()
        links, low = compare(keys, matrix(group.vector.tolist(), int(group.dim.iloc[0])), group.copies.to_numpy().astype(float), [np.asarray(x) for x in group.leaves], int(group.leaf.iloc[0]), side, cosine)
        return pd.DataFrame({"key": keys, "links": links.astype(np.int64), "low": low})

    found = materialize(met.groupBy("dim", "leaf", "i", "j").applyInPandas(compared, "key long, links long, low long"), "compared")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    label = components(found.where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct())
    named = classes.select("key", "half", "other", "first", "copies").join(label, classes["key"] == label["node"], "left").select("key", "half", "other", "first", "copies", F.coalesce("component", "key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = materialize(named.join(lowest, "component").join(links, "key", "left").select("half", "other", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    # usable rows by the hash of their vector, all others as they are
    of_row = rows.select("id", F.col("key").alias("half"), "other").join(of_class, ["half", "other"]).groupBy("id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    out = vectors.select(F.col(id_col).alias("own")).join(of_row, F.col("own") == F.col("id"), "left")
    return out.select(F.col("own").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "own").cast(kind).alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
