"""k-means and density clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockml.functions.numeric import argmin, vector
from blockml.operators.base import Estimator, width_of
from blockml.session import materialise


def squared_distance(x: Column, values) -> Column:
    return F.aggregate(F.zip_with(x, vector(values), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


class KMeans(Estimator):
    """Lloyd's algorithm. ``init`` is k-means||, random (``n_init`` runs) or an array of centres; a point of equal distances
    goes to the first centre, and a centre without points stays."""

    def __init__(self, n_clusters: int = 8, init="k-means||", max_iter: int = 300, tol: float = 1e-4, seed: int = 0, n_init: int = 1, x: str = "X"):
        self.n_clusters, self.init, self.max_iter, self.tol, self.seed, self.n_init, self.x = n_clusters, init, max_iter, tol, seed, n_init, x

    def fit(self, df: DataFrame) -> KMeans:
        if self.init == "random" if isinstance(self.init, str) else False:
            return self._best_of_random(df)
        if isinstance(self.init, str):
            if self.init != "k-means||":
                raise ValueError(f"no init {self.init}")
            from pyspark.ml.clustering import KMeans as MLKMeans
            from pyspark.ml.functions import array_to_vector

            rows = df.select(array_to_vector(F.col(self.x).cast("array<double>")).alias("features"))
            model = MLKMeans(k=self.n_clusters, maxIter=self.max_iter, tol=self.tol, seed=self.seed).fit(rows)
            self.cluster_centers_ = np.array(model.clusterCenters())
            self.n_iter_ = model.summary.numIter
            return self
        return self._lloyd(df, np.asarray(self.init, float))

    def _best_of_random(self, df: DataFrame) -> KMeans:
        """``n_init`` runs from random rows; the one with the least inertia stays."""
        best = None
        rows = df.select(F.col(self.x)).where(F.col(self.x).isNotNull())
        for k in range(self.n_init):
            picked = rows.orderBy(F.xxhash64(F.col(self.x).cast("string"), F.lit(self.seed + k))).limit(self.n_clusters).collect()
            if len(picked) < self.n_clusters:
                raise ValueError(f"{len(picked)} rows for {self.n_clusters} clusters")
            self._lloyd(df, np.array([r[0] for r in picked], float))
            cost = self.inertia(df)
            if best is None or cost < best[0]:
                best = cost, self.cluster_centers_, self.n_iter_
        _, self.cluster_centers_, self.n_iter_ = best
        return self

    def inertia(self, df: DataFrame) -> float:
        """Sum of squared distances to the nearest centre."""
        far = F.array_min(F.array(*(squared_distance(F.col(self.x), c) for c in self.cluster_centers_)))
        return df.agg(F.sum(far)).first()[0] or 0.0

    def _lloyd(self, df: DataFrame, centres: np.ndarray) -> KMeans:
        d = width_of(df, self.x)
        cells = [F.avg(F.get(F.col(self.x), F.lit(i))) for i in range(d)]
        self.n_iter_ = 0
        for _ in range(self.max_iter):
            rows = df.groupBy(self._nearest(centres).alias("c")).agg(F.array(*cells).alias("m")).where("c IS NOT NULL").collect()
            new = centres.copy()
            for r in rows:
                new[r["c"]] = r["m"]
            moved = float(((new - centres) ** 2).sum())
            centres = new
            self.n_iter_ += 1
            if moved <= self.tol:
                break
        self.cluster_centers_ = centres
        return self

    def _nearest(self, centres: np.ndarray) -> Column:
        return argmin(F.array(*(squared_distance(F.col(self.x), c) for c in centres)))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._nearest(self.cluster_centers_))


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and for others with a chance of 2**-64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that edges (u, v) connect with each id in them.

    Every round all neighbours of a node take the smallest id around it; the number of rounds
    grows with the logarithm of the longest path. Rounds are written to the shared folder.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = materialise(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", F.col("m").alias("v2"))).toDF("u", "v").distinct(), "edges")
        if _signature(new) == _signature(edges):
            return new.select(F.col("u").alias("id"), F.col("v").alias("root")).union(new.select("v", F.col("v").alias("r")).distinct()).distinct()
        edges = new


def dbscan(df: DataFrame, eps: float, min_points: int, key: str = "row_id", x: str = "X") -> DataFrame:
    """(key, cluster): the cluster's name is the smallest key of its core points; noise has null.

    A point is core with ``min_points`` points, itself among them, within ``eps``. A border point
    goes to the cluster with the smallest name in reach. Points meet in cells of side ``eps``, so
    only those of neighbouring cells are compared; for a few dimensions.
    """
    return _dbscan(df, eps, min_points, key, x)[0]


class DBSCAN(Estimator):
    """``fit`` learns ``labels_`` (key, cluster), as ``dbscan``, and the core points; ``predict`` gives new
    points the smallest cluster that has a core point within ``eps``, or null."""

    def __init__(self, eps: float, min_points: int, key: str = "row_id", x: str = "X"):
        self.eps, self.min_points, self.key, self.x = eps, min_points, key, x

    def fit(self, df: DataFrame) -> DBSCAN:
        self.labels_, core = _dbscan(df, self.eps, self.min_points, self.key, self.x)
        points = df.select(F.col(self.key).alias("id"), F.col(self.x).cast("array<double>").alias("p"))
        self._core, self._width = materialise(core.join(points, "id"), "dbscan-core"), width_of(df, self.x)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``cluster``."""
        home, reach = _cells(df.select(F.col(self.key).alias("id"), F.col(self.x).cast("array<double>").alias("p")), self._width, self.eps)
        core, _ = _cells(self._core, self._width, self.eps, "cluster")
        near = core.select(F.col("p").alias("p1"), "cluster", "cell").join(reach, "cell").where(_squared("p1", "p2") <= self.eps**2)
        found = near.groupBy(F.col("id2").alias(self.key)).agg(F.min("cluster").alias("cluster"))
        return df.join(found, self.key, "left")

    def predict_point(self, point) -> int | None:
        """The cluster of one local point."""
        return self._core.where(_squared("p", vector(point)) <= self.eps**2).agg(F.min("cluster")).first()[0]


def _squared(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def _cells(points: DataFrame, d: int, eps: float, *extra: str) -> tuple[DataFrame, DataFrame]:
    """(id, p, cell, ...), and (id2, p2, cell) with a row for each cell around the point's."""
    cell = F.array(*(F.floor(F.get("p", F.lit(i)) / eps) for i in range(d)))
    home = points.select("id", "p", *extra, cell.alias("cell"))
    around = F.array(F.array().cast("array<bigint>"))

    def beside(c: Column, i: int) -> Column:
        return F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda o: F.concat(c, F.array((F.get("cell", F.lit(i)) + o).cast("bigint"))))

    def extended(cells: Column, i: int) -> Column:
        return F.flatten(F.transform(cells, lambda c: beside(c, i)))

    for i in range(d):
        around = extended(around, i)
    return home, home.select(F.col("id").alias("id2"), F.col("p").alias("p2"), F.explode(around).alias("cell"))


def _dbscan(df: DataFrame, eps: float, min_points: int, key: str, x: str) -> tuple[DataFrame, DataFrame]:
    """(key, cluster) of all rows, and (id, cluster) of the core points."""
    points = df.select(F.col(key).alias("id"), F.col(x).cast("array<double>").alias("p"))
    home, reach = _cells(points, width_of(df, x), eps)
    pairs = materialise(home.join(reach, "cell").where(_squared("p", "p2") <= eps * eps).select("id", "id2"), "dbscan-pairs")
    core = pairs.groupBy("id").count().where(F.col("count") >= min_points).select("id")
    links = pairs.join(core, "id").join(core.withColumnRenamed("id", "id2"), "id2")
    named = core.join(components(links.select(F.col("id").alias("u"), F.col("id2").alias("v"))), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    reached = pairs.join(named.withColumnRenamed("id", "id2"), "id2").groupBy("id").agg(F.min("cluster").alias("near"))
    out = points.select("id").join(named, "id", "left").join(reached, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", "near").alias("cluster")), named
