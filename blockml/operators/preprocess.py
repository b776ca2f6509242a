"""Scaling, label numbers, feature selection."""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockml.functions.numeric import vector
from blockml.operators.arrays import Sparse
from blockml.operators.base import Estimator, term_ids, width_of


def moments(df: DataFrame, x: str = "X") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population variances of the columns of an array, in one aggregation."""
    d = width_of(df, x)
    cells = [F.get(F.col(x), F.lit(i)).cast("double") for i in range(d)]
    row = df.agg(F.count(x).alias("n"), F.array(*map(F.avg, cells)).alias("m"), F.array(*map(F.var_pop, cells)).alias("v")).first()
    return row["n"], np.array(row["m"]), np.array(row["v"])


def sparse_moments(x: Sparse) -> tuple[int, np.ndarray, np.ndarray]:
    """The same with the zeros that a sparse array leaves out."""
    n = x.rows.count()
    v = F.col("value").cast("double")
    mean, var = np.zeros(x.width), np.zeros(x.width)
    for r in x.entries.groupBy("feature").agg(F.count("*").alias("k"), F.avg(v).alias("m"), F.var_pop(v).alias("v")).collect():
        k, m = r["k"], r["m"]
        mean[r["feature"]] = k * m / n
        var[r["feature"]] = k * r["v"] / n + k * (n - k) / n * m * m / n
    return n, mean, var


class StandardScaler(Estimator):
    """Zero mean, unit population variance; constant columns are left at scale 1."""

    def __init__(self, with_mean: bool = True, with_std: bool = True, x: str = "X"):
        self.with_mean, self.with_std, self.x = with_mean, with_std, x

    def fit(self, data: DataFrame | Sparse) -> StandardScaler:
        self.n_samples_seen_, self.mean_, self.var_ = sparse_moments(data) if isinstance(data, Sparse) else moments(data, self.x)
        self.scale_ = np.where(self.var_ == 0, 1.0, np.sqrt(self.var_))
        return self

    def transform(self, data: DataFrame | Sparse) -> DataFrame | Sparse:
        if not (self.with_mean or self.with_std):
            raise ValueError("with_mean or with_std must be set")
        if isinstance(data, Sparse):
            if self.with_mean:
                raise ValueError("sparse data can't be centred; set with_mean=False")
            scale = F.get(vector(self.scale_), F.col("feature").cast("int"))
            return Sparse(data.entries.withColumn("value", F.col("value") / scale), data.rows, data.width, data.key)
        x = F.col(self.x)
        if self.with_mean:
            x = F.zip_with(x, vector(self.mean_), lambda a, b: a - b)
        if self.with_std:
            x = F.zip_with(x, vector(self.scale_), lambda a, b: a / b)
        return data.withColumn(self.x, x)


class VarianceThreshold(Estimator):
    """Keeps columns whose population variance is above ``threshold``."""

    def __init__(self, threshold: float = 0.0, x: str = "X"):
        self.threshold, self.x = threshold, x

    def fit(self, data: DataFrame | Sparse) -> VarianceThreshold:
        _, _, self.variances_ = sparse_moments(data) if isinstance(data, Sparse) else moments(data, self.x)
        if not (self.variances_ > self.threshold).any():
            raise ValueError(f"no feature has a variance above {self.threshold}")
        return self

    def get_support(self) -> np.ndarray:
        return self.variances_ > self.threshold

    def transform(self, data: DataFrame | Sparse) -> DataFrame | Sparse:
        kept = np.flatnonzero(self.get_support()).tolist()
        if isinstance(data, Sparse):
            new = F.create_map(*chain.from_iterable((F.lit(k), F.lit(i)) for i, k in enumerate(kept)))
            found = data.entries.withColumn("feature", F.try_element_at(new, F.col("feature").cast("int"))).where("feature IS NOT NULL")
            return Sparse(found, data.rows, len(kept), data.key)
        return data.withColumn(self.x, F.array(*(F.get(F.col(self.x), F.lit(i)) for i in kept)))


class LabelEncoder(Estimator):
    """Numbers of the sorted distinct labels."""

    def __init__(self, y: str = "y"):
        self.y = y

    def fit(self, df: DataFrame) -> LabelEncoder:
        labels = df.select(F.col(self.y).alias("label")).where("label IS NOT NULL").distinct()
        if dict(labels.dtypes)["label"] == "string":
            self.classes_ = term_ids(labels, "label", "index")
        else:
            values = sorted(r[0] for r in labels.collect())
            kind = labels.schema["label"].dataType.simpleString()
            self.classes_ = df.sparkSession.createDataFrame(list(zip(values, range(len(values)))), f"label {kind}, index long")
        return self

    def _replaced(self, df: DataFrame, by: str, to: str) -> DataFrame:
        """Unseen values raise when the result is computed."""
        table = self.classes_.select(F.col(by).alias("__from"), F.col(to).alias("__to"))
        got = df.join(table, F.col(self.y) == F.col("__from"), "left")
        unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(self.y).cast("string")))
        value = F.when(F.col("__to").isNotNull() | F.col(self.y).isNull(), F.col("__to")).otherwise(unseen.cast(table.schema["__to"].dataType))
        return got.withColumn(self.y, value).drop("__from", "__to")

    def transform(self, df: DataFrame) -> DataFrame:
        return self._replaced(df, "label", "index")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._replaced(df, "index", "label")
