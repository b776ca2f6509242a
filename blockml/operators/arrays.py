"""Distributed arrays: dense ones are array columns, sparse ones (row_id, feature, value) rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockml.functions.numeric import OPERATIONS, dot, vector
from blockml.operators.base import block, summed, width_of

WIDE = 512  # up to this width an axis-0 reduction is one aggregate a column


def elementwise(x: Column, other, name: str) -> Column:
    """numpy's ``name`` of an array column and a local number or vector."""
    return _elementwise(x, other, OPERATIONS[name])


def _elementwise(x: Column, other, op) -> Column:
    if np.ndim(other) == 0:
        return F.transform(x, lambda v: op(v, F.lit(float(other))))
    flat = np.asarray(other, float).reshape(-1)
    return F.zip_with(x, vector(flat), op)


_FOLD = {
    "sum": lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v),
    "prod": lambda x: F.aggregate(x, F.lit(1.0), lambda s, v: s * v),
    "min": F.array_min,
    "max": F.array_max,
}
_MERGE = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "mean": F.avg}


def reduce(df: DataFrame, how: str, axis: int | None = None, x: str = "X", key: str = "row_id") -> DataFrame:
    """sum, mean, min, max or prod of a dense array.

    ``axis`` None: one row (value). 0: (feature, value), over all rows. 1: (key, value), of each
    row. Nested arrays have further axes, up to their depth: axis 0 gives (feature0, feature1, ...,
    value), and one within the row (key, value) with the row's other axes. No other axis.
    """
    depth = dict(df.dtypes)[x].count("array<")
    if depth > 1 and how in _MERGE and (axis is None or 0 <= axis <= depth):
        return _reduce_nested(df, how, axis, x, key, depth)
    if how not in _MERGE or axis not in (None, 0, 1):
        raise ValueError(f"no {how} over axis {axis}")
    col = F.col(x)
    by_row = _FOLD["sum"](col) / F.size(col) if how == "mean" else _FOLD[how](col)
    if axis == 1:
        return df.select(key, by_row.alias("value"))
    if axis is None:
        if how == "mean":
            return df.select(F.sum(_FOLD["sum"](col)).alias("s"), F.sum(F.size(col)).alias("n")).select((F.col("s") / F.col("n")).alias("value"))
        return df.select(_MERGE[how](by_row).alias("value"))
    merge = _MERGE[how]
    d = width_of(df, x)
    if d > WIDE:
        return df.select(F.posexplode(col).alias("feature", "v")).groupBy("feature").agg(merge("v").alias("value"))
    one = df.agg(F.array(*(merge(F.get(col, F.lit(i))) for i in range(d))).alias("v"))
    return one.select(F.posexplode("v").alias("feature", "value"))


_PAIR = {"sum": lambda a, b: a + b, "mean": lambda a, b: a + b, "prod": lambda a, b: a * b, "min": F.least, "max": F.greatest}


def _nested(function, levels: int, *columns: Column) -> Column:
    """``function`` of the numbers of one or two arrays nested ``levels`` deep."""
    if not levels:
        return function(*columns)
    if len(columns) == 1:
        return F.transform(columns[0], lambda e: _nested(function, levels - 1, e))
    return F.zip_with(*columns, lambda a, b: _nested(function, levels - 1, a, b))


def flat(x: Column, depth: int) -> Column:
    """All numbers of an array nested ``depth`` deep, in order."""
    for _ in range(depth - 1):
        x = F.flatten(x)
    return x


def flatten(df: DataFrame, x: str = "X", key: str = "row_id") -> DataFrame:
    """(key, feature, value): the numbers of each row in order, whatever the depth."""
    return df.select(key, F.posexplode(flat(F.col(x), dict(df.dtypes)[x].count("array<"))).alias("feature", "value"))


def _reduce_nested(df: DataFrame, how: str, axis: int | None, x: str, key: str, depth: int) -> DataFrame:
    if axis is None:
        return reduce(df.select(flat(F.col(x), depth).cast("array<double>").alias(x)), how, None, x, key)
    if axis == 0:
        rows = df.select(F.col(x).alias("v"))
        for k in range(depth):
            rows = rows.select(*(f"feature{i}" for i in range(k)), F.posexplode("v").alias(f"feature{k}", "v"))
        return rows.groupBy(*(f"feature{k}" for k in range(depth))).agg(_MERGE[how](F.col("v").cast("double")).alias("value"))

    def along(v: Column, level: int) -> Column:
        if level > 1:
            return F.transform(v, lambda e: along(e, level - 1))
        inside = depth - axis
        kind = "array<" * inside + "double" + ">" * inside
        total = F.aggregate(F.slice(v, F.lit(2), F.size(v)), F.get(v, F.lit(0)).cast(kind), lambda s, e: _nested(_PAIR[how], inside, s, e.cast(kind)))
        return _nested(lambda e: e / F.size(v), inside, total) if how == "mean" else total

    return df.select(key, along(F.col(x), axis).alias("value"))


class Array:
    """A dense array with numpy's arithmetic operators against local numbers and vectors; each gives a
    new array, and ``+=`` and the like rebind the name."""

    def __init__(self, df: DataFrame, x: str = "X", key: str = "row_id"):
        self.df, self.x, self.key = df, x, key

    def _with(self, function) -> Array:
        return Array(self.df.withColumn(self.x, function(F.col(self.x).cast("array<double>"))), self.x, self.key)

    def to_array(self) -> np.ndarray:
        """All rows on the driver, in key order."""
        return np.array([r[0] for r in self.df.orderBy(self.key).select(self.x).collect()], float)

    def dot(self, local) -> Array:
        return self._with(lambda c: matmul(c, local))

    def flatten(self) -> DataFrame:
        return flatten(self.df, self.x, self.key)


def _operator(name: str, reflected: bool):
    def apply(self: Array, other) -> Array:
        op = OPERATIONS[name]
        swapped = (lambda a, b: op(b, a)) if reflected else op
        return self._with(lambda c: _elementwise(c, other, swapped))

    return apply


for _sign, _name in (("add", "add"), ("sub", "subtract"), ("mul", "multiply"), ("truediv", "divide"), ("floordiv", "floor_divide"), ("mod", "mod"), ("pow", "power")):
    setattr(Array, f"__{_sign}__", _operator(_name, False))
    setattr(Array, f"__r{_sign}__", _operator(_name, True))
for _how in ("sum", "mean", "min", "max", "prod"):
    setattr(Array, _how, lambda self, axis=None, how=_how: reduce(self.df, how, axis, self.x, self.key))


def matmul(x: Column, local) -> Column:
    """Row times a local matrix (d, k)."""
    return F.array(*(dot(x, column) for column in np.asarray(local, float).T))


def gram(df: DataFrame, x: str = "X") -> np.ndarray:
    """XᵀX, summed over Arrow batches."""

    def part(b):
        m = block(b.column(0))
        return m.T @ m

    return summed(df, [F.col(x).cast("array<double>").alias("x")], part)


@dataclass
class Sparse:
    """``entries`` (row_id, feature, value) without zeros; ``rows`` (row_id) has all rows."""

    entries: DataFrame
    rows: DataFrame
    width: int
    key: str = "row_id"

    @classmethod
    def from_dense(cls, df: DataFrame, x: str = "X", key: str = "row_id") -> Sparse:
        entries = df.select(key, F.posexplode(x).alias("feature", "value")).where("value <> 0")
        return cls(entries, df.select(key), width_of(df, x), key)

    def to_dense(self) -> DataFrame:
        """(row_id, X)."""
        maps = self.entries.groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature").cast("long"), F.col("value").cast("double")))).alias("m"))
        cells = F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("long")), F.lit(0.0)))
        return self.rows.join(maps, self.key, "left").select(self.key, F.coalesce(cells, F.array_repeat(F.lit(0.0), self.width)).alias("X"))

    def to_array(self) -> np.ndarray:
        """A dense array of all rows on the driver, in key order."""
        return np.array([r[0] for r in self.to_dense().orderBy(self.key).select("X").collect()], float).reshape(-1, self.width)

    def reduce(self, how: str, axis: int | None = None) -> DataFrame:
        """As ``reduce`` of the dense array, zeros included; axis 0 and 1 leave out results that
        have no entry (they are 0)."""
        if how not in ("sum", "mean", "min", "max") or axis not in (None, 0, 1):
            raise ValueError(f"no {how} over axis {axis}")
        v, n = F.col("value"), F.count("*")
        merge = {"sum": F.sum(v), "mean": F.sum(v), "min": F.min(v), "max": F.max(v)}[how]
        if axis == 1:
            cells, by = F.lit(self.width), self.key
        else:
            cells, by = F.lit(self.rows.count() * (self.width if axis is None else 1)), "feature"
        grouped = self.entries.groupBy(by) if axis is not None else self.entries.groupBy()
        got = grouped.agg(merge.alias("m"), n.alias("n"))
        m = F.coalesce(F.col("m").cast("double"), F.lit(0.0))
        missing = F.col("n") < cells
        value = {"sum": m, "mean": m / cells, "min": F.when(missing, F.least(m, F.lit(0.0))).otherwise(m), "max": F.when(missing, F.greatest(m, F.lit(0.0))).otherwise(m)}[how]
        return got.select(*([by] if axis is not None else []), value.alias("value"))

    def dot(self, other: DataFrame) -> DataFrame:
        """(row_id, col, value): the product with a table (feature, col, weight)."""
        return self.entries.join(other, "feature").groupBy(self.key, "col").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
