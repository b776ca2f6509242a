"""Minimax contiguous sharding of ordered atomic groups.

The smallest shard capacity for which greedy filling needs at most ``n_shards`` shards is found
by binary search; the cuts are those of the greedy filling at that capacity. The driver holds sums
over consecutive groups, at first those of ``coarse`` stretches at most, and decides most capacities
from these alone. Only stretches in which a cut may fall are read more finely, as ``FAN`` parts each, down
to blocks of a few groups and then the groups, so what it reads at once does not follow the input.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockml.session import col, fresh, materialise

FAN = 32
GROUP = -1  # the level of single groups; a segment of level d is FAN ** d blocks
LOW = (1 << 32) - 1


def _number_blocks(block_rows: int):
    """``block``: the partition's number and, below, that of the block within it."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            block = (part << 32) + np.arange(seen, seen + n, dtype=np.int64) // block_rows
            seen += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], names=["key", "size", "block"])

    return run


def _within(wanted: list[int], per: int) -> Column:
    """``block`` is in one of the segments of ``per`` blocks, as ranges, which Parquet statistics can prune by."""
    runs = np.split(np.array(wanted, np.int64), np.flatnonzero(np.diff(wanted) > 1) + 1)
    first = lambda n: (int(n) & ~LOW) + (int(n) & LOW) * per
    terms = [F.col("block").between(first(r[0]), first(r[-1]) + per - 1) for r in runs]
    while len(terms) > 1:  # a flat tree
        terms = [functools.reduce(operator.or_, terms[k : k + 2]) for k in range(0, len(terms), 2)]
    return terms[0]


class _Plan:
    """Consecutive segments of groups with their sums; ``fetch(level, names)`` gives the parts of
    segments, by name: sizes and names."""

    def __init__(self, sums: np.ndarray, names: np.ndarray, level: int, fetch):
        self.sums, self.names, self.fetch = sums, names.astype(object), fetch
        self.level = np.full(len(sums), level, np.int8)
        self._total()

    def _total(self):
        self.ends = np.cumsum(self.sums)
        self.starts = self.ends - self.sums

    def refine(self, want) -> None:
        """Puts their parts in the place of the segments ``want``."""
        want = sorted(set(want))
        parts: dict = {}
        for level in {int(self.level[b]) for b in want}:
            names = [self.names[b] for b in want if self.level[b] == level]
            parts |= {(level, n): got for n, got in self.fetch(level, names).items()}
        pieces: list = [([], [], [])]
        last = 0
        for b in want:
            level = self.level[b]
            sums, names = parts[level, self.names[b]]
            pieces += [(self.sums[last:b], self.names[last:b], self.level[last:b]), (sums, names, np.full(len(sums), level - 1, np.int8))]
            last = b + 1
        pieces.append((self.sums[last:], self.names[last:], self.level[last:]))
        self.sums, self.names, self.level = np.concatenate([p[0] for p in pieces]).astype(np.int64), np.concatenate([np.asarray(p[1], object) for p in pieces]), np.concatenate([p[2] for p in pieces]).astype(np.int8)
        self._total()

    def at(self, position: int) -> int:
        """The first segment that ends beyond a prefix sum."""
        return int(np.searchsorted(self.ends, position, "right"))

    def cuts(self, capacity: int, way: str, limit: int):
        """Greedy cuts as prefix sums, and the segments of several groups in which one fell; these are
        taken whole for nothing ("low") or not at all ("high"). Stops beyond ``limit`` shards."""
        place, out, open_ = 0, [], []
        total = int(self.ends[-1])
        while place < total and len(out) <= limit:
            b = self.at(place + capacity)
            if b == len(self.ends):
                out.append(total)
                break
            to = int(self.starts[b])
            if self.level[b] != GROUP:
                open_.append(b)
                to = int(self.ends[b]) if way == "low" else to
            if to <= place:
                return None, open_
            out.append(to)
            place = to
        return out, open_

    def feasible(self, capacity: int, k: int) -> bool:
        while True:
            low, need = self.cuts(capacity, "low", k)
            if low is not None and len(low) > k:
                return False
            high, more = self.cuts(capacity, "high", k)
            if high is not None and len(high) <= k:
                return True
            if not need and not more:
                return low is not None and len(low) <= k
            want = {*need, *more}
            for i, cut in enumerate(low or []):
                if high and i < len(high):
                    want.update(range(self.at(high[i]), self.at(cut) + 1))
            self.refine(b for b in want if b < len(self.ends) and self.level[b] != GROUP)

    def exact(self, capacity: int, k: int) -> list[int]:
        while True:
            found, need = self.cuts(capacity, "low", k)
            if not need:
                return found
            self.refine(need)

    def first_group(self, position: int):
        """The name of the group that begins a shard there."""
        while self.level[b := self.at(position)] != GROUP:
            self.refine([b])
        return self.names[b]


def _tree(key: Column, cuts: list, low: int, high: int) -> Column:
    """Number of cuts at or before ``key``, as a balanced comparison tree."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < F.lit(cuts[mid]), _tree(key, cuts, low, mid)).otherwise(_tree(key, cuts, mid + 1, high))


def minimax_shards(
    docs: DataFrame,
    n_shards: int = 64,
    key: str = "doc_id",
    size: Column | None = None,
    block_rows: int = 32,
    coarse: int = 32_768,
) -> DataFrame:
    """``docs`` with a column ``shard`` (0, 1, ...): contiguous in ``key`` order, no group of
    equal ``key`` divided, the largest shard as small as possible.

    ``size`` is a row's weight, by default the text's UTF-8 bytes; null and negative ones count as 0. Null keys
    form one group, which comes first. Repeated rows belong to their key's group, so they weigh
    twice and stay together. Fewer groups than shards leave the last shards unused; a group
    larger than all others sets the capacity. An empty table gives an empty table. A column
    named ``shard`` is replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    weight = F.greatest(F.coalesce(F.octet_length(F.col("text")) if size is None else size, F.lit(0)), F.lit(0)).cast("long")
    groups = materialise(docs.select(col(key).alias("key"), weight.alias("size")).groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    kind = groups.schema["key"].dataType.simpleString()
    order = F.col("key").asc_nulls_first()
    numbered = materialise(groups.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(_number_blocks(block_rows), f"key {kind}, size long, block long"), "shard-numbered")
    blocks = materialise(numbered.groupBy("block").agg(F.sum("size").alias("s"), F.max("size").alias("m")).sort("block"), "shard-blocks")
    whole = blocks.agg(F.count("*").alias("n"), F.max("m").alias("m")).first()
    if not whole["n"]:
        return docs.drop("shard").withColumn("shard", F.lit(0))
    depth = 0
    while FAN**depth * coarse < whole["n"]:
        depth += 1

    def segment(level: int) -> Column:
        low = F.col("block").bitwiseAND(LOW)
        return (F.col("block") - low + F.floor(low / FAN**level)).alias("name")

    def segments(rows: DataFrame, level: int) -> pa.Table:
        return rows.groupBy(segment(level)).agg(F.sum("s").alias("s")).orderBy("name").toArrow()

    def fetch(level: int, wanted: list) -> dict:
        if level:
            got = segments(blocks.where(_within(wanted, FAN**level)), level - 1)
            sums, names = got["s"].to_numpy(), got["name"].to_numpy()
            at = (names & ~LOW) + (names & LOW) // FAN
        else:
            got = numbered.where(_within(wanted, 1)).orderBy("block", order).select("block", "size", "key").toArrow()
            at, sums, names = got["block"].to_numpy(), got["size"].to_numpy(), np.array([*got["key"].to_pylist(), None], object)[:-1]
        return {w: (sums[i:j], names[i:j]) for w in wanted for i, j in [np.searchsorted(at, [w, w + 1])]}

    top = segments(blocks, depth)  # coarse rows, and one more a partition at most
    plan = _Plan(top["s"].to_numpy().astype(np.int64), top["name"].to_numpy(), depth, fetch)
    total = int(plan.ends[-1])
    low = max(whole["m"], -(-total // n_shards))
    high = min(total, -(-total // n_shards) + low)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if plan.feasible(mid, n_shards) else (mid + 1, high)
    cuts = plan.exact(low, n_shards)[:-1] if total else []
    first = [plan.first_group(c) for c in cuts]
    (name,) = fresh(docs.columns, "shard")
    shard = F.when(col(key).isNull(), 0).otherwise(_tree(col(key), first, 0, len(first)))
    return docs.withColumn(name, shard.cast("int")).drop("shard").withColumnRenamed(name, "shard")


def brute_force(sizes: list[int], n_shards: int) -> list[int]:
    """Shard of each group, by trying every capacity that a shard can have."""
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    for capacity in sorted({int(prefix[j] - prefix[i]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}):
        if capacity < max(sizes):
            continue
        shard, room, out = 0, capacity, []
        for s in sizes:
            if s > room:
                shard, room = shard + 1, capacity
            room -= s
            out.append(shard)
        if shard < n_shards:
            return out
    return []


__all__ = ["brute_force", "minimax_shards"]
