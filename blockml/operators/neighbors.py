"""Nearest neighbours by cosine distance."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockml.operators.base import Estimator, block, width_of
from blockml.session import default_parallelism

MIN_FOUND = 0.9
BROADCAST_BYTES = 64 << 20
#: Distances that a task holds at once.
CELLS = 1 << 20
#: Of pairs in all directions, the share above which comparing all of them in blocks costs less than joins of tables.
DENSE = 0.02


def unit(x: Column) -> Column:
    """The array at length 1; a zero vector stays."""
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(length > 0, F.transform(x, lambda v: v / length)).otherwise(x)


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _sides(queries: DataFrame, points: DataFrame, key: str, x: str) -> tuple[DataFrame, DataFrame]:
    side = lambda df, k, p: df.select(F.col(key).alias(k), unit(F.col(x).cast("array<double>")).alias(p))
    return side(queries, "query", "q"), side(points, "neighbor", "p")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _all_pairs(queries: DataFrame, points: DataFrame, key: str, x: str) -> DataFrame:
    q, p = _sides(queries, points, key, x)
    return p.crossJoin(q).where("query <> neighbor").select("query", "neighbor", (1 - inner(F.col("q"), F.col("p"))).alias("distance"))


def _blocks(df: DataFrame, key: str, x: str, rows: int, names: tuple[str, str]) -> DataFrame:
    """Rows of up to ``rows`` keys and unit vectors, as binaries."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                m = block(part.column(1))
                length = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, length, out=m, where=length > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([m.tobytes()])], names=names)

    there = df.where(F.col(x).isNotNull()).select(F.col(key).cast("long"), F.col(x).cast("array<double>"))
    return there.mapInArrow(run, f"{names[0]} binary, {names[1]} binary")


def _nearest_of_blocks(k: int):
    """Of each pair of blocks the points that may be among the ``k`` nearest of a query, given what the task
    has seen: those as near as the ``k``-th so far."""

    def run(batches):
        seen: dict[bytes, np.ndarray] = {}  # by block of queries: how far the k-th nearest of each is
        for b in batches:
            for r in range(b.num_rows):  # views, no copies
                p, v, every, wanted = (np.frombuffer(c[r].as_buffer(), kind) for c, kind in zip(b.columns, (np.int64, float, np.int64, float)))
                v, wanted = v.reshape(len(p), -1), wanted.reshape(len(every), -1)
                last = seen.setdefault(hashlib.sha256(wanted).digest() + every[:1].tobytes(), np.full(len(every), np.inf))
                step = max(1, CELLS // len(p))
                for lo in range(0, len(every), step):
                    part = slice(lo, lo + step)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _nearest_cells(every[part], wanted[part], p, v, k, last[part])], names=["query", "neighbor", "distance"])

    return run


def _nearest_cells(q: np.ndarray, wanted: np.ndarray, p: np.ndarray, v: np.ndarray, k: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbor, distance) of the pairs no farther than ``last`` or the ``k`` nearest here; lowers ``last``."""
    far = wanted @ v.T
    np.subtract(1, far, out=far)
    far[q[:, None] == p[None, :]] = np.inf
    fresh = not np.isfinite(last).all()
    if fresh and k <= len(p):
        np.minimum(last, np.partition(far, k - 1, axis=1)[:, k - 1], out=last)
    # products of blocks of other shapes differ in the last bits, so distances are rounded; what is as near as
    # the last when rounded lies within 2e-12
    i, j = np.nonzero(far <= np.minimum(last + 2e-12, 9)[:, None])
    d = far[i, j]
    if not fresh:
        found = np.bincount(i, minlength=len(q))
        enough = np.flatnonzero(found >= k)
        ranked, begin = d[np.lexsort((d, i))], np.cumsum(found) - found
        last[enough] = np.minimum(last[enough], ranked[begin[enough] + k - 1])
    return q[i], p[j], np.round(d, 12)


def exact(queries: DataFrame, points: DataFrame, k: int, key: str = "row_id", x: str = "X") -> DataFrame:
    """(query, neighbor, distance, rank): the ``k`` nearest other points, ties by key.

    Every query is compared with every point, block by block as a matrix product, of which only the
    nearest leave the task. The queries' blocks are sent to all tasks where they take at most
    ``BROADCAST_BYTES``; else blocks meet blocks. The points' blocks are spread over all cores, whatever
    files they come from.
    """
    size = queries.count() * 8 * width_of(queries, x) if not queries.isEmpty() else 0
    asked = _blocks(queries, key, x, 1024, ("asked", "wanted"))
    spread = _blocks(points, key, x, 4096, ("ids", "vectors")).repartition(4 * default_parallelism(points.sparkSession))
    pairs = spread.crossJoin(F.broadcast(asked) if size <= BROADCAST_BYTES else asked)
    return _nearest(pairs.mapInArrow(_nearest_of_blocks(k), "query long, neighbor long, distance double"), k)


class LSHForest(Estimator):
    """Approximate cosine neighbours: signs of random projections, ``bits`` of them a table in
    ``n_tables`` tables; points that agree in a table, or differ in one bit of it, are compared
    exactly. The default tables find 97 to 99 % of the five nearest among 500 to 2,000 vectors of width 64
    that lie in all directions, at angles of 64 to 74 degrees; nearer neighbours are found more often.
    Of such vectors they compare two thirds of all pairs, so that ``kneighbors`` compares all instead."""

    def __init__(self, n_tables: int = 32, bits: int = 8, n_neighbors: int = 5, radius: float = 1.0, seed: int = 0, key: str = "row_id", x: str = "X"):
        self.n_tables, self.bits, self.n_neighbors, self.radius, self.seed, self.key, self.x = n_tables, bits, n_neighbors, radius, seed, key, x

    def fit(self, df: DataFrame) -> LSHForest:
        self.planes_ = np.random.default_rng(self.seed).standard_normal((self.n_tables, self.bits, width_of(df, self.x)))
        self._points = df
        return self

    def _codes(self, col: str) -> Column:
        """(table, code) of a unit vector. The planes are one literal: as an expression for each, the
        plan takes minutes."""
        planes = F.from_json(F.lit(json.dumps(self.planes_.tolist())), "array<array<array<double>>>")
        above = lambda w: inner(F.col(col), w) > 0
        code = lambda table: F.aggregate(F.reverse(table), F.lit(0), lambda s, w: 2 * s + above(w).cast("int"))
        return F.transform(planes, lambda table, t: F.struct(t.alias("table"), code(table).alias("code")))

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query, neighbor, distance) of all compared pairs."""
        q, p = _sides(queries, self._points, self.key, self.x)
        near = F.transform(F.array(F.lit(0), *(F.lit(1 << i) for i in range(self.bits))), lambda m: F.col("code").bitwiseXOR(m))
        asked = q.select("query", F.inline(self._codes("q"))).select("query", "table", F.explode(near).alias("code"))
        # vectors follow only the pairs that met
        met = asked.join(p.select("neighbor", F.inline(self._codes("p"))), ["table", "code"]).where("query <> neighbor").select("query", "neighbor").distinct()
        return met.join(p, "neighbor").join(q, "query").select("query", "neighbor", (1 - inner(F.col("q"), F.col("p"))).alias("distance"))

    def found(self, distance: float) -> float:
        """The chance that a pair at a cosine distance is compared."""
        same = 1 - np.arccos(np.clip(1 - distance, -1, 1)) / np.pi
        return float(1 - (1 - same**self.bits - self.bits * same ** (self.bits - 1) * (1 - same)) ** self.n_tables)

    def kneighbors(self, queries: DataFrame, n_neighbors: int | None = None) -> DataFrame:
        """(query, neighbor, distance, rank). Tables that compare more than ``DENSE`` of all pairs, as the
        defaults do, save nothing over comparing all in blocks, which finds every neighbour."""
        k = n_neighbors or self.n_neighbors
        return exact(queries, self._points, k, self.key, self.x) if self.found(1.0) > DENSE else _nearest(self.candidates(queries), k)

    def radius_neighbors(self, queries: DataFrame, radius: float | None = None) -> DataFrame:
        """(query, neighbor, distance) within ``radius``. All pairs are compared where the tables would
        find fewer than ``MIN_FOUND`` of those at that distance, as they would at the default."""
        radius = self.radius if radius is None else radius
        pairs = self.candidates(queries) if self.found(radius) >= MIN_FOUND else _all_pairs(queries, self._points, self.key, self.x)
        return pairs.where(F.col("distance") <= radius)
