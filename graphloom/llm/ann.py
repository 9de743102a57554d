"""Nearest neighbours by a vantage-point tree for each shard.

The shards themselves are the leaves of an upper vantage-point tree, fitted on a
bounded sample: a vector's distances to the vantage points on its way decide
where it lies, and with them how near to a query anything in a shard can be. In
each shard a tree of its own is built, once for all the queries that come there:
a node keeps a vantage point and, for both halves, the least and the greatest
distance to it. By the triangle inequality a leaf is at least as far from a
query as the largest gap along its path; a leaf is passed over by the queries for
which ``factor`` times that bound exceeds the k-th distance.

A query first searches the shard it would lie in. Its k-th distance there is a
radius, and it goes on only to shards whose bound times ``factor`` is inside it.
Factor one is exact; larger factors visit fewer shards and leaves.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part, as queries or candidates;
only vectors of equal length are compared; rows with the query's id are not its
candidates, and other rows repeated with one id are candidates each; a query id
that occurs more than once is searched once, with its vector of smallest hash;
ties go to the smaller id; fewer candidates than ``k`` are all returned, however
far; ids are cast to long; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, materialize
from .vectors import matrix, packed

#: Vectors a shard is meant to hold, queries of one shard that a task takes, and vectors in a leaf.
SHARD, QUERIES, LEAF = 8192, 65_536, 128
#: Leaves a query visits in an order of its own.
FIRST = 3
#: Bounds of the upper tree: vectors it is fitted on, of all lengths together, and least of them in a shard.
SAMPLE, LEAST = 16_384, 32
_NONE = np.iinfo(np.int64).max


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances over the last axis, also where squares would overflow or vanish."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        gap = a - b
        d = np.sqrt((gap * gap).sum(axis=-1))
        odd = ~((d > 1e-140) & (d < np.inf))
        if odd.any():
            some = gap[odd]
            most = np.abs(some).max(axis=-1, initial=0)
            d[odd] = np.where(most == 0, 0, np.where(np.isfinite(most), most * np.sqrt(((some / most[:, None]) ** 2).sum(axis=-1)), np.inf))
    return d


class VantageTree:
    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7) -> None:
        self.points, self.leaf = points, leaf
        self.vantage: list[int] = []
        self.leaves: list[np.ndarray] = []
        #: for each leaf: (vantage, least, greatest distance) along its path
        self.paths: list[list[tuple[int, float, float]]] = []
        self.rng = np.random.default_rng(seed)
        if len(points):
            self._build(np.arange(len(points)), [])

    def _build(self, rows: np.ndarray, path: list[tuple[int, float, float]]) -> None:
        if len(rows) <= self.leaf:
            self.leaves.append(rows)
            self.paths.append(path)
            return
        at = int(rows[self.rng.integers(len(rows))])
        d = distances(self.points[rows], self.points[at])
        half = len(rows) // 2
        order = np.argpartition(d, half)  # by position, so that equal distances split too
        self.vantage.append(at)
        k = len(self.vantage) - 1
        for part in (order[:half], order[half:]):
            self._build(rows[part], [*path, (k, float(d[part].min()), float(d[part].max()))])

    def search(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids (inf and the largest integer where there are fewer), nearest first; rows whose id is the query's ``own`` are left out.

        ``radius``: for each query, the distance that ``k`` others are known to lie within.
        """
        n = len(queries)
        best, names = np.full((n, k), np.inf), np.full((n, k), _NONE)
        if not len(self.leaves) or not n:
            return best, names
        radius = np.full(n, np.inf) if radius is None else radius
        v = self.points[self.vantage] if self.vantage else np.zeros((0, queries.shape[1]))
        far = np.stack([distances(queries, x) for x in v], axis=1) if len(v) else np.zeros((n, 0))
        bound = np.zeros((n, len(self.leaves)))
        with np.errstate(invalid="ignore"):
            for j, path in enumerate(self.paths):
                for at, low, high in path:
                    np.fmax(bound[:, j], np.fmax(low - far[:, at], far[:, at] - high), out=bound[:, j])
        order = np.argsort(bound, axis=1, kind="stable")[:, :FIRST]
        unseen = np.ones(bound.shape, dtype=bool)

        def visit(j: int, mine: np.ndarray) -> None:
            rows = self.leaves[j]
            unseen[mine, j] = False
            for some in np.array_split(mine, max(1, len(mine) * len(rows) // 40_000)):
                d = distances(queries[some][:, None, :], self.points[rows][None, :, :])
                self_ = ids[rows][None, :] == own[some][:, None]
                d = np.where(self_, np.inf, d)
                every = np.concatenate([best[some], d], axis=1)
                name = np.concatenate([names[some], np.where(self_, _NONE, ids[rows][None, :])], axis=1)
                pick = np.lexsort((name, every), axis=1)[:, :k]
                best[some], names[some] = np.take_along_axis(every, pick, 1), np.take_along_axis(name, pick, 1)

        def reached(near: np.ndarray, mine: np.ndarray | slice) -> np.ndarray:
            # rounding in the distances must not prune an exact tie
            return near * factor <= np.minimum(best[mine, -1], radius[mine]) * (1 + 1e-12) + 1e-12

        # each query's nearest leaves first, then every leaf with all queries that still reach it, nearest on the whole first
        live = np.arange(n)
        for r in range(order.shape[1]):
            leaf = order[live, r]
            ok = reached(bound[live, leaf], live)
            live, leaf = live[ok], leaf[ok]
            for j in np.unique(leaf).tolist():
                visit(j, live[leaf == j])
        for j in np.argsort(bound[live].sum(axis=0), kind="stable").tolist() if len(live) else ():
            mine = live[unseen[live, j]]
            if len(mine := mine[reached(bound[mine, j], mine)]):
                visit(j, mine)
        return best, names


class Upper:
    """The upper tree: vantage points and radii; a vector within the radius goes to the first child, others to the second. Shards are numbered leaves."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 11) -> None:
        self.points: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int]] = []
        #: for each shard: (node, within?) along its path
        self.paths: list[list[tuple[int, bool]]] = []
        self.rng = np.random.default_rng(seed)
        self.root = self._split(sample, shards, [])
        del self.rng

    def _split(self, x: np.ndarray, shards: int, path: list[tuple[int, bool]]) -> int:
        if shards > 1 and len(x) >= 2 * LEAST:
            at = x[int(self.rng.integers(len(x)))]
            d = distances(x, at)
            radius = float(np.median(d))
            near = d <= radius
            if np.isfinite(radius) and 0.1 < near.mean() < 0.9:
                node = len(self.points)
                self.points.append(at)
                self.radii.append(radius)
                self.children.append((0, 0))
                first = self._split(x[near], -(-shards // 2), [*path, (node, True)])
                self.children[node] = (first, self._split(x[~near], shards // 2, [*path, (node, False)]))
                return node
        self.paths.append(path)
        return ~(len(self.paths) - 1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The shard of each vector."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                near = distances(x[rows], self.points[node]) <= self.radii[node]
                todo += [(self.children[node][0], rows[near]), (self.children[node][1], rows[~near])]
        return out

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Queries by shards: how near anything in a shard can be."""
        far = np.stack([distances(x, p) for p in self.points], axis=1) if self.points else np.zeros((len(x), 0))
        out = np.zeros((len(x), len(self.paths)))
        with np.errstate(invalid="ignore"):
            for j, path in enumerate(self.paths):
                for node, within in path:
                    gap = far[:, node] - self.radii[node]
                    np.fmax(out[:, j], gap if within else -gap, out=out[:, j])
        return out


_COLUMNS = "dim int, shard int, part int, turn int, id long, radius double, vector binary"


def _searched(mixed: DataFrame, k: int, factor: float) -> DataFrame:
    """``query_id, vec, score`` of rows ``_COLUMNS``: of each (dim, shard, part) the vectors (turn 0) lie before the queries (turn 1), so that one tree is built and queries stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, tree = None, [], None
        for b in batches:
            dims, shards, parts, turns, ids = (b.column(i).to_numpy() for i in range(5))
            step = (np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(parts) != 0) | (np.diff(turns) != 0)
            edges = np.flatnonzero(step) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(dims)], strict=True):
                if low == high:
                    continue
                group, dim = (int(dims[low]), int(shards[low]), int(parts[low])), int(dims[low])
                if group != here:
                    here, held, tree = group, [], None
                x = matrix(b.column(6).slice(low, high - low).to_pylist(), dim)
                if turns[low] == 0:
                    held.append((ids[low:high], x))
                    continue
                if not held:
                    continue
                if tree is None:
                    names = np.concatenate([i for i, _ in held])
                    tree = VantageTree(np.concatenate([v for _, v in held]))
                own = ids[low:high]
                d, found = tree.search(x, names, own, k, factor, b.column(5).slice(low, high - low).to_numpy())
                hit = (found != _NONE).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[hit]), pa.array(found.ravel()[hit]), pa.array(d.ravel()[hit])], ["query_id", "vec", "score"])

    dealt = mixed.repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "turn", "id", "vector")
    return map_batches(dealt, run, "query_id long, vec long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 10, factor: float = 1.1, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the ``k`` nearest found for the rows where ``is_query``, of all rows.

    A task holds one shard and a batch of queries, whatever the data. To the
    driver come the sample and the number of rows and of queries in each shard;
    both are bounded by ``sample``. Shards that come out too large, since the
    sample tells no more of them apart, are dealt out further by a hash.
    """
    spark = vectors.sparkSession
    points = materialize(packed(vectors, id_col, vector_col), "vectors")
    queries = materialize(points.where(is_query(F.col("id"))).groupBy("id", "dim").agg(F.min_by("vector", F.struct("key", "other")).alias("vector")), "queries")
    dims = {r.dim: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    share = max(2 * LEAST, sample // max(1, len(dims)))
    total = spark.createDataFrame(list(dims.items()), "dim int, n long")
    some: dict[int, list] = {}
    for r in points.join(F.broadcast(total), "dim").where(F.pmod(F.xxhash64("key"), F.col("n")) < share).select("dim", "key", "vector").distinct().collect():
        some.setdefault(r.dim, []).append((r.key, bytes(r.vector)))
    upper = {dim: Upper(matrix([v for _, v in sorted(found)], dim), -(-dims[dim] // shard)) for dim, found in some.items()}
    upper |= {dim: Upper(np.zeros((0, dim)), 1) for dim in dims if dim not in upper}
    shared = spark.sparkContext.broadcast(upper)

    def by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        lengths = b.column("dim").to_numpy()
        for dim in np.unique(lengths).tolist():
            part = b.take(pa.array(np.flatnonzero(lengths == dim)))
            yield dim, part, matrix(part.column("vector").to_pylist(), dim)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, x in by_dim(b):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value[dim].route(x).astype(np.int32))], [*part.schema.names, "shard"])

    placed = materialize(map_batches(points.select("id", "dim", "key", "vector"), route, "id long, dim int, key long, vector binary, shard int"), "placed")
    sizes = {(r.dim, r.shard): -(-r["n"] // shard) for r in placed.groupBy("dim", "shard").agg(F.count("*").alias("n")).collect()}
    subs = spark.createDataFrame([(d, s, n) for (d, s), n in sizes.items()], "dim int, shard int, subs int")

    def search(asked: DataFrame) -> DataFrame:
        """``asked``: id, dim, vector, radius, shard."""
        load = {(r.dim, r.shard): -(-r["n"] // QUERIES) for r in asked.groupBy("dim", "shard").agg(F.count("*").alias("n")).collect()}
        parts = spark.createDataFrame([(d, s, n) for (d, s), n in load.items()], "dim int, shard int, parts int")
        both = F.broadcast(subs.join(parts, ["dim", "shard"]))
        several = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # a part of a shard's queries meets each hashed share of the shard's vectors
        part = lambda s, q: (s * F.col("parts") + q).cast("int").alias("part")
        data = placed.join(both, ["dim", "shard"]).withColumn("s", F.pmod(F.xxhash64("key", "id"), F.col("subs"))).withColumn("q", several("parts"))
        data = data.select("dim", "shard", part(F.col("s"), F.col("q")), F.lit(0).alias("turn"), "id", F.lit(0.0).alias("radius"), "vector")
        ask = asked.join(both, ["dim", "shard"]).withColumn("q", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("s", several("subs"))
        ask = ask.select("dim", "shard", part(F.col("s"), F.col("q")), F.lit(1).alias("turn"), "id", "radius", "vector")
        return _searched(data.unionByName(ask), k, factor)

    at_home = map_batches(queries.select("id", "dim", "vector"), route, "id long, dim int, vector binary, shard int")
    first = materialize(search(at_home.withColumn("radius", F.lit(float("inf")))), "first")
    reached = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec"))).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("radius"))
    known = queries.join(reached, "id", "left").select("id", "dim", "vector", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, x in by_dim(b):
                tree = shared.value[dim]
                radius = part.column("radius").to_numpy()
                near = tree.bounds(x) * factor <= (radius * (1 + 1e-12) + 1e-12)[:, None]
                near[np.arange(len(x)), tree.route(x)] = False  # searched already
                row, to = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns), pa.array(to.astype(np.int32))], [*part.schema.names, "shard"])

    further = materialize(map_batches(known, spread, "id long, dim int, vector binary, radius double, shard int"), "further")
    near = first.unionByName(search(further))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")
