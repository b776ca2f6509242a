"""What estimators share: parameters by name, export, ordered ids."""

from __future__ import annotations

import inspect
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockml.operators.local import LocalModel
from blockml.session import fresh, materialise

MOST_RUNS = 10_000


class Estimator:
    """Parameters are the constructor's keywords; what ``fit`` learns ends in an underscore and
    replaces what an earlier ``fit`` learnt."""

    def get_params(self, deep: bool = True) -> dict:
        return {k: getattr(self, k) for k in inspect.signature(type(self).__init__).parameters if k != "self"}

    def set_params(self, **params):
        known = self.get_params(deep=False)
        for k, v in params.items():
            if k not in known:
                raise ValueError(f"{type(self).__name__} has no parameter {k}")
            setattr(self, k, v)
        return self

    def clone(self):
        return type(self)(**self.get_params(deep=False))

    def to_local(self) -> LocalModel:
        """A copy of all that was learnt, as numpy arrays and plain values, that predicts or transforms
        local arrays; tables are collected."""
        out = {}
        for k, v in vars(self).items():
            if k.endswith("_") and not k.startswith("_"):
                if isinstance(v, DataFrame):
                    v = v.toPandas().to_dict("list")
                out[k] = v.copy() if isinstance(v, np.ndarray) else v
        return LocalModel(type(self).__name__, self.get_params(deep=False), out)

    def save(self, path: str) -> None:
        """Parameters and what was learnt, as JSON; ``local.load`` reads it."""
        self.to_local().save(path)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Classifier(Estimator):
    """``predict`` adds a column ``prediction``."""

    def score(self, df: DataFrame, weight: str | None = None) -> float:
        return accuracy(self.predict(df), weight=weight)


def accuracy(df: DataFrame, truth: str = "y", prediction: str = "prediction", weight: str | None = None) -> float:
    """Share, by weight where given, of rows whose prediction is right."""
    w = F.col(weight) if weight else F.lit(1.0)
    ok = (F.col(truth) == F.col(prediction)).cast("double")
    return df.agg((F.sum(w * ok) / F.sum(w)).alias("a")).first()["a"]


def positions(df: DataFrame, key: str, name: str = "pos", span: int = 1_000_000) -> DataFrame:
    """``df`` with the rank from 0 of its unique integer key.

    Where keys lie close together, ranks are counted within runs of ``span`` keys, after the count of all
    earlier runs. Else rows are sorted by range, written, and numbered by their place in the range, after
    the rows of earlier ranges. No task sees more than one run or range.
    """
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if ends["a"] is None or (ends["b"] - ends["a"]) // span < MOST_RUNS:
        return _in_runs(df, key, F.floor(F.col(key) / span), name)
    return _in_ranges(df, key, name)


def term_ids(df: DataFrame, term: str, name: str = "feature") -> DataFrame:
    """``df`` with the rank from 0 of its unique string column. It is written, so that what it was made
    of is not computed at each use."""
    return _in_ranges(df, term, name)


def _in_ranges(df: DataFrame, key: str, name: str) -> DataFrame:
    (place,) = fresh(df.columns, "place")
    placed = materialise(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn(place, F.monotonically_increasing_id()), "positions")
    part = F.shiftright(place, 33).cast("int")
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a range
    earlier = np.zeros(max(counts, default=0) + 1, np.int64)
    for p, n in counts.items():
        earlier[p + 1 :] += n
    starts = F.from_json(F.lit(json.dumps(earlier.tolist())), "array<bigint>")
    return placed.withColumn(name, F.get(starts, part) + F.col(place).bitwiseAND((1 << 33) - 1)).drop(place)


def _in_runs(df: DataFrame, key: str, run: Column, name: str) -> DataFrame:
    r, earlier, k = fresh(df.columns, "run", "earlier", "k")
    runs = df.select(run.alias(r)).groupBy(r).agg(F.count("*").alias(k))
    before = runs.select(r, F.coalesce(F.sum(k).over(Window.orderBy(r).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(earlier))
    rank = F.row_number().over(Window.partitionBy(r).orderBy(key)) - 1
    return df.withColumn(r, run).join(before, r).withColumn(name, (rank + F.col(earlier)).cast("long")).drop(r, earlier)


def matrix(df: DataFrame, x: str = "X") -> np.ndarray:
    """The array column as a local matrix."""
    rows = df.select(F.col(x).cast("array<double>").alias("x")).toArrow()["x"]
    return np.array(rows.to_pylist(), dtype=float)


def block(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def summed(df: DataFrame, columns: list[str | Column], function) -> np.ndarray | None:
    """Sum over all Arrow batches of ``function(batch)``, an array of fixed shape; None without rows.

    Tasks send their partial sum as one row; the driver holds one array a task.
    """

    def run(batches):
        total = shape = None
        for b in batches:
            if b.num_rows:
                part = np.asarray(function(b), dtype=np.float64)
                total, shape = (part if total is None else total + part), part.shape
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([shape], pa.list_(pa.int32()))], names=["s", "shape"])

    got = df.select(*columns).mapInArrow(run, "s array<double>, shape array<int>")
    wide = got.select(F.posexplode("s").alias("i", "v"), "shape").groupBy("i").agg(F.sum("v").alias("v"), F.first("shape").alias("shape")).orderBy("i").collect()
    return np.array([r["v"] for r in wide]).reshape(wide[0]["shape"]) if wide else None


def classes_of(df: DataFrame, y: str = "y") -> list:
    return [r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().orderBy(y).collect()]


def width_of(df: DataFrame, x: str = "X") -> int:
    first = df.select(F.size(x)).where(F.col(x).isNotNull()).first()
    if first is None:
        raise ValueError("no rows to learn from")
    return first[0]
