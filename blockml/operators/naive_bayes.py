"""Naive Bayes by exact aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockml.functions.numeric import argmax, let, vector
from blockml.operators.base import Classifier, width_of


def log_sum_exp(x: Column) -> Column:
    """Of an array of numbers."""
    return let(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))))


class GaussianNB(Classifier):
    """Columns X (array) and y."""

    def __init__(self, x: str = "X", y: str = "y", var_floor: float = 1e-9):
        self.x, self.y, self.var_floor = x, y, var_floor

    def fit(self, df: DataFrame) -> GaussianNB:
        d = width_of(df, self.x)
        cells = [F.get(F.col(self.x), F.lit(i)).cast("double") for i in range(d)]
        rows = df.where(F.col(self.y).isNotNull()).groupBy(self.y).agg(F.count("*").alias("n"), F.array(*map(F.avg, cells)).alias("m"), F.array(*map(F.var_pop, cells)).alias("v")).orderBy(self.y).collect()
        self.classes_ = [r[self.y] for r in rows]
        self.class_count_ = np.array([r["n"] for r in rows], float)
        self.class_prior_ = self.class_count_ / self.class_count_.sum()
        self.theta_, self.sigma_ = np.array([r["m"] for r in rows]), np.array([r["v"] for r in rows])
        return self

    def _joint(self, df: DataFrame) -> DataFrame:
        """``df`` with the joint log-likelihood of each class, in an array ``joint``."""
        scores = []
        for prior, m, v in zip(self.class_prior_, self.theta_, self.sigma_):
            v = np.maximum(v, self.var_floor)
            const = float(np.log(prior) - 0.5 * np.log(2 * np.pi * v).sum())
            off = F.zip_with(F.col(self.x), vector(m), lambda a, b: (a - b) * (a - b))
            far = F.aggregate(F.zip_with(off, vector(v), lambda a, b: a / b), F.lit(0.0), lambda s, t: s + t)
            scores.append(F.lit(const) - far * 0.5)
        return df.withColumn("joint", F.array(*scores))

    def predict(self, df: DataFrame) -> DataFrame:
        labels = F.array(*map(F.lit, self.classes_))
        return self._joint(df).withColumn("prediction", F.get(labels, argmax(F.col("joint")))).drop("joint")

    def predict_log_proba(self, df: DataFrame) -> DataFrame:
        """Adds ``log_proba``, an array in the order of ``classes_``."""
        total = log_sum_exp(F.col("joint"))
        return self._joint(df).withColumn("log_proba", let(total, lambda t: F.transform("joint", lambda j: j - t))).drop("joint")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        got = self.predict_log_proba(df)
        return got.withColumn("proba", F.transform("log_proba", lambda v: F.exp(v))).drop("log_proba")


class _DiscreteNB(Classifier):
    """Learns from ``entries`` (key, feature, value) and ``labels`` (key, y, weight if named). Priors are
    ``class_prior``, else the classes' shares, or equal without ``fit_prior``."""

    def __init__(self, alpha: float = 1.0, key: str = "row_id", y: str = "y", weight: str | None = None, fit_prior: bool = True, class_prior: list[float] | None = None):
        self.alpha, self.key, self.y, self.weight, self.fit_prior, self.class_prior = alpha, key, y, weight, fit_prior, class_prior

    def _value(self):
        return F.col("value")

    def fit(self, data: tuple[DataFrame, DataFrame]) -> _DiscreteNB:
        entries, labels = data
        w = F.col(self.weight) if self.weight else F.lit(1.0)
        labels = labels.select(self.key, self.y, w.alias("w")).where(F.col(self.y).isNotNull())
        rows = labels.groupBy(self.y).agg(F.sum("w").alias("n")).orderBy(self.y).collect()
        self.classes_ = [r[self.y] for r in rows]
        self.class_count_ = np.array([r["n"] for r in rows], float)
        if self.class_prior is not None:
            if len(self.class_prior) != len(rows):
                raise ValueError(f"{len(rows)} classes need as many priors; got {len(self.class_prior)}")
            self.class_log_prior_ = np.log(np.asarray(self.class_prior, float))
        elif self.fit_prior:
            self.class_log_prior_ = np.log(self.class_count_ / self.class_count_.sum())
        else:
            self.class_log_prior_ = np.full(len(rows), -np.log(len(rows)))
        # one row a feature, with the classes' sums side by side
        sums = [F.sum(F.when(F.col(self.y) == c, F.col("w") * self._value()).otherwise(0.0)) for c in self.classes_]
        self.feature_count_ = entries.join(labels, self.key).groupBy("feature").agg(F.array(*sums).alias("counts"))
        return self

    def _weights(self) -> tuple[DataFrame, np.ndarray]:
        """(feature, w: array by class), and what every row of a class starts from."""
        raise NotImplementedError

    def joint(self, data: tuple[DataFrame, DataFrame]) -> DataFrame:
        """(key, joint): log-likelihoods by class, for every row of the second table."""
        entries, rows = data
        weights, start = self._weights()
        sums = [F.sum(self._value() * F.get("w", F.lit(i))) for i in range(len(self.classes_))]
        got = entries.join(weights, "feature").groupBy(self.key).agg(F.array(*sums).alias("s"))
        both = F.zip_with(F.coalesce("s", vector([0.0] * len(start))), vector(start), lambda a, b: a + b)
        return rows.join(got, self.key, "left").withColumn("joint", both).drop("s")

    def predict(self, data: tuple[DataFrame, DataFrame]) -> DataFrame:
        labels = F.array(*map(F.lit, self.classes_))
        return self.joint(data).withColumn("prediction", F.get(labels, argmax(F.col("joint")))).drop("joint")

    def predict_log_proba(self, data: tuple[DataFrame, DataFrame]) -> DataFrame:
        total = log_sum_exp(F.col("joint"))
        return self.joint(data).withColumn("log_proba", let(total, lambda t: F.transform("joint", lambda j: j - t))).drop("joint")

    def predict_proba(self, data: tuple[DataFrame, DataFrame]) -> DataFrame:
        got = self.predict_log_proba(data)
        return got.withColumn("proba", F.transform("log_proba", lambda v: F.exp(v))).drop("log_proba")


class MultinomialNB(_DiscreteNB):
    def _weights(self):
        k = range(len(self.classes_))
        total = self.feature_count_.agg(F.count("*").alias("v"), F.array(*(F.sum(F.get("counts", F.lit(i))) for i in k)).alias("n")).first()
        logs = [F.log((F.get("counts", F.lit(i)) + self.alpha) / (total["n"][i] + self.alpha * total["v"])) for i in k]
        return self.feature_count_.select("feature", F.array(*logs).alias("w")), self.class_log_prior_


class BernoulliNB(_DiscreteNB):
    """Presence of features: values above ``binarize``, or 1s of data that are binary already where that
    is None. Absent ones count by the log of one minus their probability."""

    def __init__(self, alpha: float = 1.0, key: str = "row_id", y: str = "y", weight: str | None = None, fit_prior: bool = True, class_prior: list[float] | None = None, binarize: float | None = 0.0):
        super().__init__(alpha, key, y, weight, fit_prior, class_prior)
        self.binarize = binarize

    def _value(self):
        if self.binarize is None:
            return F.col("value").cast("double")
        return F.when(F.col("value") > self.binarize, 1.0).otherwise(0.0)

    def _weights(self):
        k = range(len(self.classes_))
        p = [(F.get("counts", F.lit(i)) + self.alpha) / F.lit(float(self.class_count_[i]) + 2 * self.alpha) for i in k]
        base = self.feature_count_.agg(F.array(*(F.sum(F.log(1 - p[i])) for i in k)).alias("s")).first()["s"]
        logs = [F.log(p[i]) - F.log(1 - p[i]) for i in k]
        return self.feature_count_.select("feature", F.array(*logs).alias("w")), self.class_log_prior_ + np.array(base)
