"""Truncated singular value decomposition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockml.operators.arrays import gram, matmul
from blockml.operators.base import Estimator, block, summed, width_of


def _signed(v: np.ndarray) -> np.ndarray:
    """Rows whose largest loading is positive."""
    at = np.abs(v).argmax(axis=1)
    return v * np.where(v[np.arange(len(v)), at] < 0, -1.0, 1.0)[:, None]


def svd(df: DataFrame, k: int, x: str = "X") -> tuple[np.ndarray, np.ndarray]:
    """(s, v): singular values and right vectors (rows) from XᵀX, for widths whose square fits."""
    w, q = np.linalg.eigh(gram(df, x))
    top = np.argsort(-w, kind="stable")[:k]
    return np.sqrt(np.maximum(w[top], 0)), _signed(q[:, top].T)


def svd_em(df: DataFrame, k: int, maxiter: int = 20, tol: float = 1e-6, seed: int | None = None, x: str = "X") -> tuple[np.ndarray, np.ndarray]:
    """(s, v) by EM subspace iteration: two passes a step, and never a square of the width."""
    d = width_of(df, x)
    cols = [F.col(x).cast("array<double>").alias("x")]
    c = np.random.default_rng(seed).standard_normal((k, d))

    def gram_in(basis: np.ndarray) -> np.ndarray:
        def part(b):
            z = block(b.column(0)) @ basis
            return z.T @ z

        return summed(df, cols, part)

    for _ in range(maxiter):
        plus = c.T @ np.linalg.inv(c @ c.T)  # (d, k)
        onto = plus @ np.linalg.inv(gram_in(plus))

        def part(b, onto=onto):
            m = block(b.column(0))
            return m.T @ (m @ onto)

        new = summed(df, cols, part).T
        change = float(((new - c) ** 2).sum())
        c = new
        if change <= tol:
            break
    q, _ = np.linalg.qr(c.T)
    w, e = np.linalg.eigh(gram_in(q))
    order = np.argsort(-w, kind="stable")
    return np.sqrt(np.maximum(w[order], 0)), _signed((q @ e[:, order]).T)


class TruncatedSVD(Estimator):
    def __init__(self, n_components: int = 2, algorithm: str = "em", n_iter: int = 30, random_state: int | None = None, tol: float = 1e-7, x: str = "X"):
        self.n_components, self.algorithm, self.n_iter, self.random_state, self.tol, self.x = n_components, algorithm, n_iter, random_state, tol, x

    def fit(self, df: DataFrame) -> TruncatedSVD:
        if self.algorithm == "gram":
            self.singular_values_, self.components_ = svd(df, self.n_components, self.x)
        elif self.algorithm == "em":
            self.singular_values_, self.components_ = svd_em(df, self.n_components, self.n_iter, self.tol, self.random_state, self.x)
        else:
            raise ValueError(f"no algorithm {self.algorithm}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.x, matmul(F.col(self.x), self.components_.T))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.x, matmul(F.col(self.x), self.components_))

    def left_vectors(self, df: DataFrame) -> DataFrame:
        """u: X vᵀ / s."""
        return df.withColumn(self.x, matmul(F.col(self.x), self.components_.T / self.singular_values_))
