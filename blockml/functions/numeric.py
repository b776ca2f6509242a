"""numpy-faithful arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b with numpy's infinities and nan instead of an error."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / b)


def floor_divide(a: Column, b: Column) -> Column:
    """Rounded towards minus infinity; a quotient too large for a long is whole already."""
    q = a / b
    return F.when(b == 0, divide(a, b)).when(F.abs(q) < 9e15, F.floor(q).cast("double")).otherwise(q)


def mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a - floor_divide(a, b) * b)


def fmod(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a % b)


OPERATIONS = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide,
    "true_divide": divide,
    "floor_divide": floor_divide,
    "power": F.power,
    "mod": mod,
    "remainder": mod,
    "fmod": fmod,
}


def let(value: Column, use) -> Column:
    """``use(value)`` with one evaluation of ``value``, also where ``use`` has lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(x: Column, values) -> Column:
    """Inner product of an array column and local numbers."""
    return F.aggregate(F.zip_with(x, vector(values), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def argmax(scores: Column) -> Column:
    """Index from 0 of the largest element, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmin(scores: Column) -> Column:
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")
