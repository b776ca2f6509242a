"""Datasets: a DataFrame with a unique integer row id, and blocks of consecutive rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockml.operators.base import positions


class Dataset:
    """``df`` in the order of ``key``, cut into ``partitions`` equal runs of rows and these into
    blocks of ``block_size`` rows (None: one block a run). Lazy, but for the counts that block numbers need
    and, where keys lie far apart, the numbering of rows."""

    def __init__(self, df: DataFrame, key: str = "row_id", block_size: int | None = None, partitions: int = 1):
        if key not in df.columns:
            raise ValueError(f"no column {key}")
        if block_size is not None and block_size < 1:
            raise ValueError("block_size must be positive")
        self.df, self.key, self.block_size, self.partitions = df, key, block_size, partitions
        self._count: int | None = None

    # metadata

    def count(self) -> int:
        if self._count is None:
            self._count = self.df.count()
        return self._count

    __len__ = count

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.key]

    @property
    def dtypes(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    @property
    def context(self):
        return self.df.sparkSession

    def __contains__(self, column: str) -> bool:
        return column in self.columns

    def __repr__(self) -> str:
        return f"Dataset({self.df.schema.simpleString()}, key={self.key}, block_size={self.block_size}, partitions={self.partitions})"

    def get_params(self) -> dict:
        return {"key": self.key, "block_size": self.block_size, "partitions": self.partitions}

    def ndim(self, column: str) -> int:
        return 1 + self.dtypes[column].count("array<")

    def shape(self, column: str) -> tuple[int, ...]:
        """Rows, and the lengths of the nested arrays of the first row."""
        dims, x = [], F.col(column)
        for _ in range(self.ndim(column) - 1):
            dims.append(F.size(x))
            x = F.get(x, F.lit(0))
        first = self.df.where(F.col(column).isNotNull()).select(*(d.alias(f"d{i}") for i, d in enumerate(dims))).first() if dims else ()
        return (self.count(), *(first or ()))

    def size(self, column: str) -> int:
        return math.prod(self.shape(column))

    def _starts(self) -> list[int]:
        n, p = self.count(), self.partitions
        return [i * n // p for i in range(p + 1)]

    def block_count(self) -> int:
        s = self._starts()
        return sum(self._blocks_of(b - a) for a, b in zip(s, s[1:]))

    def _blocks_of(self, rows: int) -> int:
        return 0 if not rows else 1 if self.block_size is None else -(-rows // self.block_size)

    # blocks

    def blocked(self) -> DataFrame:
        """``df`` with ``pos`` (rank of the row), ``part`` and ``block`` (numbers from 0)."""
        n, p = self.count(), self.partitions
        starts = self._starts()
        earlier = [0]
        for a, b in zip(starts, starts[1:]):
            earlier.append(earlier[-1] + self._blocks_of(b - a))
        part = F.floor(((F.col("pos") + 1) * p - 1) / F.lit(max(1, n))).cast("int")
        at = lambda values: F.get(F.lit(values).cast("array<bigint>"), F.col("part"))
        inner = F.floor((F.col("pos") - at(starts)) / self.block_size) if self.block_size else F.lit(0)
        return positions(self.df, self.key).withColumn("part", part).withColumn("block", (at(earlier) + inner).cast("long"))

    def collect_blocks(self, column: str) -> list[list]:
        """The column's values block by block, on the driver."""
        rows = self.blocked().groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", column))).alias("rows")).orderBy("block").collect()
        return [[x[1] for x in r["rows"]] for r in rows]

    def to_list(self, column: str) -> list:
        return [r[0] for r in self.df.orderBy(self.key).select(column).collect()]

    def to_array(self, column: str):
        import numpy as np

        return np.array(self.to_list(column))

    # selection

    def _picked(self, index) -> list[int]:
        n = self.block_count()
        if isinstance(index, bool):
            raise KeyError(f"unexpected index: {index!r}")
        if isinstance(index, int):
            index = [index]
        if isinstance(index, slice):
            return list(range(n))[index]
        if isinstance(index, (list, tuple)) and all(isinstance(i, int) for i in index):
            if lost := [i for i in index if not -n <= i < n]:
                raise IndexError(f"no blocks {lost}; there are {n}")
            return list(dict.fromkeys(i + n if i < 0 else i for i in index))
        raise KeyError(f"unexpected index: {index!r}")

    def blocks(self, index) -> DataFrame:
        """Rows of the picked blocks with ``out_block``, their place in the order asked for.

        ``index`` is a block number, a slice, or a list of numbers; negative numbers count from
        the end, and repeated ones count once. A number out of range raises IndexError; a slice takes what
        there is.
        """
        picked = self._picked(index)
        rows = self.blocked()
        if not picked:
            return rows.where(F.lit(False)).withColumn("out_block", F.lit(0).cast("long"))
        place = self.df.sparkSession.createDataFrame([(b, i) for i, b in enumerate(picked)], "block long, out_block long")
        return rows.join(F.broadcast(place), "block") if len(picked) < 100_000 else rows.join(place, "block")

    def __getitem__(self, index) -> Dataset:
        """``ds[blocks]``, ``ds[blocks, columns]``; columns are a name, a list, or a slice. Picked blocks
        are cut into blocks afresh, as one run."""
        if isinstance(index, tuple):
            if len(index) != 2:
                raise IndexError("Too many indices")
            rows, cols = index
            cols = self.columns[cols] if isinstance(cols, slice) else [cols] if isinstance(cols, str) else list(cols)
            if unknown := [c for c in cols if c not in self.columns]:
                raise KeyError(f"no columns {unknown}")
        else:
            rows, cols = index, self.columns
        df = self.df if isinstance(rows, slice) and rows == slice(None) else self.blocks(rows)
        if df is self.df:
            return Dataset(df.select(self.key, *cols), self.key, self.block_size, self.partitions)
        # in the order asked for; the rows' own ids give way to ones of that order
        place = F.shiftleft(F.col("out_block"), 40) + F.col("pos")
        return Dataset(df.select(place.alias(self.key), *cols), self.key, self.block_size)

    def get(self, index) -> Dataset:
        """``ds[index]``."""
        return self[index]

    @property
    def ix(self) -> Dataset:
        """``ds.ix[blocks, columns]`` is ``ds[blocks, columns]``."""
        return self

    # transformation

    def transform(self, column: str | list[str], function: Callable[..., Column], name: str | list[str] | None = None) -> Dataset:
        """Columns replaced by expressions over them; other columns pass unchanged."""
        cols = [column] if isinstance(column, str) else list(column)
        made = function(*(F.col(c) for c in cols))
        made = list(made) if isinstance(made, (list, tuple)) else [made]
        names = [name] if isinstance(name, str) else list(name or cols)
        if len(made) != len(names):
            raise ValueError(f"{len(names)} columns need as many results; got {len(made)}")
        return Dataset(self.df.withColumns(dict(zip(names, made))), self.key, self.block_size, self.partitions)

    def map_batches(self, function, schema: str) -> DataFrame:
        """``function`` over iterators of Arrow batches."""
        return self.df.mapInArrow(function, schema)

    def transform_blocks(self, function, schema: str) -> DataFrame:
        """``function`` of each block, as an Arrow table in row order; it returns a table of ``schema``."""

        def run(block):
            return function(block.sort_by("pos").drop_columns(["pos", "part", "block"]))

        return self.blocked().groupBy("block").applyInArrow(run, schema)

    def where(self, condition) -> Dataset:
        return Dataset(self.df.where(condition), self.key, self.block_size, self.partitions)

    def zip(self, *others: Dataset) -> Dataset:
        """Rows with equal ids side by side; column names must differ."""
        df = self.df
        for o in others:
            if clash := set(o.columns) & set(df.columns):
                raise ValueError(f"columns {sorted(clash)} occur twice")
            df = df.join(o.df.withColumnRenamed(o.key, self.key), self.key)
        return Dataset(df, self.key, self.block_size, self.partitions)

    def persist(self) -> Dataset:
        self.df.persist()
        return self

    def unpersist(self) -> Dataset:
        self.df.unpersist()
        return self
