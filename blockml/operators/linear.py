"""Linear models: global fits by default, averages of block fits where asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from blockml.functions.numeric import argmax, dot
from blockml.operators.base import Classifier, Estimator, block, classes_of, summed


#: Numbers of triangles that a task holds before it passes them on.
HELD = 1 << 20


def triangles(names: list[str]):
    """From rows (block, x, y, 1 or nothing): for each block the triangle of a QR decomposition of its rows
    [x, 1, y], which has the same least squares; as many for a block as tasks or batches see it."""

    def run(batches):
        held: dict = {}

        def passed():
            rows = [(k, r.ravel().tolist(), r.shape[1]) for k, r in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], kind), pa.array([x[1] for x in rows], pa.list_(pa.float64())), pa.array([x[2] for x in rows], pa.int32())], names=names)

        kind = None
        for b in batches:
            if b.num_rows:
                kind = b.column(0).type
                found = b.column(0).dictionary_encode(null_encoding="encode")
                rows = np.hstack([block(b.column(1)), block(b.column(3)), b.column(2).to_numpy(zero_copy_only=False)[:, None]])
                codes = found.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                for k, at in zip(found.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(codes))[:-1])):
                    held[k] = np.linalg.qr(np.vstack([held[k], rows[at]]) if k in held else rows[at], "r")
                if len(held) * rows.shape[1] ** 2 > HELD:
                    yield passed()
        if held:
            yield passed()

    return run


def block_average(df: DataFrame, by: str, columns: list[str], fit_intercept: bool) -> np.ndarray:
    """Unweighted mean of the least squares, coefficients and intercept, of the blocks that ``by`` numbers.
    Blocks meet as triangles, whose size does not follow their rows."""

    def run(table: pa.Table) -> pa.Table:
        width = table.column(2)[0].as_py()
        a = np.concatenate([np.asarray(r, float).reshape(-1, width) for r in table.column(1).to_pylist()])
        w = np.linalg.lstsq(a[:, :-1], a[:, -1], rcond=None)[0]
        return pa.table({"w": pa.array([(w if fit_intercept else np.append(w, 0.0)).tolist()], pa.list_(pa.float64()))})

    x, y = columns
    one = F.array(F.lit(1.0)) if fit_intercept else F.array().cast("array<double>")
    rows = df.select(by, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), one.alias("one"))
    schema = S.StructType().add(by, df.schema[by].dataType).add("r", S.ArrayType(S.DoubleType())).add("width", "integer")
    got = rows.mapInArrow(triangles(schema.names), schema).groupBy(by).applyInArrow(run, "w array<double>")
    wide = got.select(F.posexplode("w").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in wide])


class LinearRegression(Estimator):
    """Ordinary least squares. ``strategy`` is global (normal equations, one pass) or
    block_average (a fit for each value of the column ``block``, averaged)."""

    def __init__(self, fit_intercept: bool = True, strategy: str = "global", block: str = "block", x: str = "X", y: str = "y"):
        self.fit_intercept, self.strategy, self.block, self.x, self.y = fit_intercept, strategy, block, x, y

    def fit(self, df: DataFrame) -> LinearRegression:
        if self.strategy == "block_average":
            w = block_average(df, self.block, [self.x, self.y], self.fit_intercept)
        elif self.strategy == "global":

            def part(b):
                a = np.hstack([block(b.column(0)), np.ones((b.num_rows, 1)), b.column(1).to_numpy()[:, None]])
                return a.T @ a

            g = summed(df, [F.col(self.x).cast("array<double>").alias("x"), F.col(self.y).cast("double").alias("y")], part)
            a, b = g[:-1, :-1], g[:-1, -1]
            w = np.linalg.lstsq(a, b, rcond=None)[0] if self.fit_intercept else np.append(np.linalg.lstsq(a[:-1, :-1], b[:-1], rcond=None)[0], 0.0)
        else:
            raise ValueError(f"no strategy {self.strategy}")
        self.coef_, self.intercept_ = w[:-1], float(w[-1])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", dot(F.col(self.x), self.coef_) + self.intercept_)


class _LinearClassifier(Classifier):
    """``classes_``, and ``coef_`` and ``intercept_`` with a row a class (one row for two)."""

    x: str
    y: str

    def decision(self) -> Column:
        return F.array(*(dot(F.col(self.x), w) + float(b) for w, b in zip(self.coef_, self.intercept_)))

    def predict(self, df: DataFrame) -> DataFrame:
        labels = F.array(*map(F.lit, self.classes_))
        s = self.decision()
        at = (F.get(s, F.lit(0)) > 0).cast("int") if len(self.coef_) == 1 else argmax(s)
        return df.withColumn("prediction", F.get(labels, at))

    def _one_vs_rest(self, df: DataFrame, classes: list | None, fit) -> None:
        self.classes_ = sorted(classes) if classes is not None else classes_of(df, self.y)
        if len(self.classes_) < 2:
            raise ValueError("two classes or more are needed")
        positive = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        # a fit reads its rows many times
        rows = df.select(F.col(self.x).cast("array<double>").alias("x"), F.col(self.y).alias("label")).persist()
        try:
            w = np.array([fit(rows.select("x", F.when(F.col("label") == c, 1.0).otherwise(-1.0).alias("y"))) for c in positive])
        finally:
            rows.unpersist()
        self.coef_, self.intercept_ = w[:, :-1], w[:, -1]


class LogisticRegression(_LinearClassifier):
    """L1 or L2 penalty; the intercept is free. Newton steps do the fit of L2, proximal Newton
    steps that of L1; each is one pass."""

    def __init__(self, penalty: str = "l2", C: float = 1.0, fit_intercept: bool = True, max_iter: int = 50, tol: float = 1e-6, x: str = "X", y: str = "y"):
        self.penalty, self.C, self.fit_intercept, self.max_iter, self.tol, self.x, self.y = penalty, C, fit_intercept, max_iter, tol, x, y

    def fit(self, df: DataFrame, classes: list | None = None) -> LogisticRegression:
        if self.penalty not in ("l1", "l2"):
            raise ValueError(f"no penalty {self.penalty}")
        self._one_vs_rest(df, classes, self._binary)
        return self

    def _binary(self, df: DataFrame) -> np.ndarray:
        def value(z, y):
            return np.logaddexp(0, -y * z)

        def slopes(z, y):
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return p - (y > 0), p * (1 - p)

        return newton(df, value, slopes, self.C, self.penalty, self.fit_intercept, False, self.max_iter, self.tol)


class LinearSVC(_LinearClassifier):
    """Squared or plain hinge, one class against the rest. As in the usual solver of this problem
    the intercept is the weight of a constant feature ``intercept_scaling`` and is penalised."""

    def __init__(self, C: float = 1.0, loss: str = "squared_hinge", fit_intercept: bool = True, intercept_scaling: float = 1.0, max_iter: int = 100, tol: float = 1e-6, x: str = "X", y: str = "y"):
        self.C, self.loss, self.fit_intercept, self.intercept_scaling = C, loss, fit_intercept, intercept_scaling
        self.max_iter, self.tol, self.x, self.y = max_iter, tol, x, y

    def fit(self, df: DataFrame, classes: list | None = None) -> LinearSVC:
        if self.loss not in ("squared_hinge", "hinge"):
            raise ValueError(f"no loss {self.loss}")
        self._one_vs_rest(df, classes, self._binary)
        return self

    def _binary(self, df: DataFrame) -> np.ndarray:
        smooth = 0.05  # the hinge's corner, rounded so that Newton steps apply

        def value(z, y):
            m = 1 - y * z
            if self.loss == "squared_hinge":
                return np.maximum(m, 0) ** 2
            return np.where(m <= 0, 0, np.where(m < smooth, m * m / (2 * smooth), m - smooth / 2))

        def slopes(z, y):
            m = 1 - y * z
            if self.loss == "squared_hinge":
                return np.where(m > 0, -2 * y * m, 0), np.where(m > 0, 2.0, 0)
            return np.where(m <= 0, 0, np.where(m < smooth, -y * m / smooth, -y)), np.where((m > 0) & (m < smooth), 1 / smooth, 0)

        return newton(df, value, slopes, self.C, "l2", self.fit_intercept, True, self.max_iter, self.tol, self.intercept_scaling)


def newton(df: DataFrame, value, slopes, C: float, penalty: str, fit_intercept: bool, penalise_intercept: bool, max_iter: int, tol: float, scaling: float = 1.0) -> np.ndarray:
    """Minimises C * sum of value(z, y) plus the penalty of the weights.

    A pass sums gradient and Hessian; a second one sums the loss at all step lengths at once.
    """
    d = df.select(F.size("x")).first()[0]
    w = np.zeros(d + 1)
    free = np.zeros(d + 1)
    free[:d] = 1
    free[d] = float(penalise_intercept)
    const = scaling if fit_intercept else 0.0

    def design(b):
        return np.hstack([block(b.column(0)), np.full((b.num_rows, 1), const)]), b.column(1).to_numpy()

    def cost(v):
        return np.abs(v * free).sum(-1) if penalty == "l1" else 0.5 * (v * v * free).sum(-1)

    steps = 0.5 ** np.arange(16)
    for _ in range(max_iter):

        def part(b, w=w):
            a, y = design(b)
            g, h = slopes(a @ w, y)
            return np.vstack([a.T @ (a * h[:, None]), (a.T @ g)[None, :]])

        total = summed(df, ["x", "y"], part)
        h, g = C * total[:-1], C * total[-1]
        if penalty == "l2":
            h, g = h + np.diag(free), g + w * free
        h = h + 1e-10 * np.eye(d + 1)
        if not fit_intercept:
            h[d, :], h[:, d], g[d], h[d, d] = 0, 0, 0, 1
        step = -np.linalg.solve(h, g) if penalty == "l2" else _lasso(h, g, w, free) - w
        if np.abs(step).max() <= tol * max(1.0, np.abs(w).max()):
            break
        tried = w[None, :] + np.concatenate([[0.0], steps])[:, None] * step[None, :]

        def losses(b, tried=tried):
            a, y = design(b)
            return value(a @ tried.T, y[:, None]).sum(axis=0)

        f = C * summed(df, ["x", "y"], losses) + cost(tried)
        at = int(f.argmin())
        if at == 0:
            break
        w = tried[at]
    w = w.copy()
    w[d] *= const
    return w


def _lasso(h: np.ndarray, g: np.ndarray, w: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Coordinate descent on the quadratic model plus the absolute values of the weights."""
    v = w.copy()
    slope = g.copy()
    for _ in range(200):
        most = 0.0
        for i in range(len(v)):
            u = v[i] - slope[i] / h[i, i]
            new = np.sign(u) * max(0.0, abs(u) - free[i] / h[i, i])
            if new != v[i]:
                slope += h[:, i] * (new - v[i])
                most, v[i] = max(most, abs(new - v[i])), new
        if most < 1e-9:
            break
    return v


class SGDClassifier(_LinearClassifier):
    """Averaged stochastic gradient descent: an epoch is one pass in which every partition walks
    its rows from the common weights; their averages are averaged by rows."""

    def __init__(self, loss: str = "hinge", penalty: str = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15, n_iter: int = 5, seed: int = 0, x: str = "X", y: str = "y"):
        self.loss, self.penalty, self.alpha, self.l1_ratio, self.n_iter, self.seed, self.x, self.y = loss, penalty, alpha, l1_ratio, n_iter, seed, x, y

    def fit(self, df: DataFrame, classes: list | None = None) -> SGDClassifier:
        if self.loss not in _SLOPES:
            raise ValueError(f"no loss {self.loss}")
        self._one_vs_rest(df, classes, self._binary)
        return self

    def _binary(self, df: DataFrame) -> np.ndarray:
        d = df.select(F.size("x")).first()[0]
        w, t = np.zeros(d + 1), 0
        l1 = {"l1": 1.0, "l2": 0.0, "elasticnet": self.l1_ratio}[self.penalty]
        slope, alpha, seed = _SLOPES[self.loss], self.alpha, self.seed
        for epoch in range(self.n_iter):

            def run(batches, w=w, t=t, epoch=epoch):
                v, total, n = w.copy(), np.zeros(d + 1), 0
                rng = np.random.default_rng(seed + epoch)
                for b in batches:
                    a, y = np.hstack([block(b.column(0)), np.ones((b.num_rows, 1))]), b.column(1).to_numpy()
                    for i in rng.permutation(len(y)):
                        rate = 1 / (alpha * (t + n + 1 / (alpha * 0.1)))
                        v[:-1] *= 1 - rate * alpha * (1 - l1)
                        if l1:
                            v[:-1] -= np.sign(v[:-1]) * np.minimum(np.abs(v[:-1]), rate * alpha * l1)
                        s = slope(float(a[i] @ v), float(y[i]))
                        if s:
                            v -= rate * s * a[i]
                        total += v
                        n += 1
                if n:
                    yield pa.RecordBatch.from_pydict({"w": [total.tolist()], "n": [n]})

            parts = df.select("x", "y").mapInArrow(run, "w array<double>, n long").collect()
            n = sum(r["n"] for r in parts)
            w, t = np.sum([r["w"] for r in parts], axis=0) / n, t + n
        return w


_SLOPES = {
    "hinge": lambda z, y: -y if y * z < 1 else 0.0,
    "squared_hinge": lambda z, y: -2 * y * (1 - y * z) if y * z < 1 else 0.0,
    "perceptron": lambda z, y: -y if y * z <= 0 else 0.0,
    "log": lambda z, y: -y / (1 + np.exp(min(500.0, y * z))),
    "modified_huber": lambda z, y: -4 * y if y * z < -1 else -2 * y * (1 - y * z) if y * z < 1 else 0.0,
}
