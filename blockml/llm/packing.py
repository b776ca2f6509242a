"""Best-fit packing planned on the histogram of lengths.

Texts longer than a bin are cut into pieces: whole-bin pieces and one remainder. The planner
runs best-fit decreasing over the counts per length, so its cost depends on the bin size and
not on the number of documents. Pieces then take the planned slots by joining on their rank
within their length; the text itself never moves.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockml.session import col

PLAN = "length int, rank_from long, rank_to long, first_bin long, per_bin int, offset int"


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: the bins that placing the items one by one gives.

    Rows (length, rank_from, rank_to, first_bin, per_bin, offset): the items of that length with
    rank in [rank_from, rank_to) fill bins from first_bin on, per_bin each, from offset on.
    Bins with equal free space are taken in the order in which they came to have it.
    """
    free: dict[int, deque[tuple[int, int]]] = {}  # free space -> ranges (first bin, bins)
    spaces: list[int] = []  # keys of free, ascending
    plan, bins = [], 0

    def put(space: int, first: int, count: int, front: bool = False) -> None:
        if count and space:
            if space not in free:
                free[space] = deque()
                insort(spaces, space)
            (free[space].appendleft if front else free[space].append)((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = free[space].popleft()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            per = space // length
            whole = min(count, left // per)
            if whole:
                plan.append((length, rank, rank + whole * per, first, per, capacity - space))
                rank, left = rank + whole * per, left - whole * per
                put(space - per * length, first, whole)
                first, count = first + whole, count - whole
            if left and count:
                plan.append((length, rank, rank + left, first, left, capacity - space))
                put(space - left * length, first, 1)
                left, first, count = 0, first + 1, count - 1
            put(space, first, count, front=True)
    return plan


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item by item, for tests: indexes of the items in each bin."""
    room, bins = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b, r in enumerate(room) if r >= lengths[i]]
        b = min(fits, key=lambda b: room[b], default=None)
        if b is None:
            b = len(room)
            room.append(capacity)
            bins.append([])
        room[b] -= lengths[i]
        bins[b].append(i)
    return bins


def pack(
    docs: DataFrame,
    capacity: int = 8192,
    key: str = "doc_id",
    length: Column | None = None,
    rank_span: int = 1_000_000,
) -> DataFrame:
    """A place in a bin of ``capacity`` for every piece of every document.

    Columns: the ``key`` column, ``piece`` (0, 1, ... within the document), ``start`` and
    ``length`` (the piece's range in the document), ``bin_id`` and ``offset`` (its place).
    ``length`` is by default the text's UTF-8 bytes, the tokens of a byte-level vocabulary.
    Documents of null, zero or negative length have nothing to pack and give no row; an empty
    table gives none. Repeated rows and repeated keys are packed as often as they occur; null
    keys are packed too. Extra columns are left out, so none can clash, but a ``key`` with the name of
    another column of the result raises ValueError.

    Ranks come from a window over (length, run of ``rank_span`` keys) plus the counts of earlier
    runs, so one frequent length is not one task.
    """
    if key.lower() in ("piece", "start", "length", "bin_id", "offset"):
        raise ValueError(f"the key can't be called {key}")
    spark = docs.sparkSession
    size = (F.octet_length(F.col("text")) if length is None else length).cast("long")
    numeric = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    run = F.floor(F.col("key") / rank_span) if numeric else F.pmod(F.xxhash64("key"), F.lit(1024))
    sized = docs.select(col(key).alias("key"), size.alias("n")).where("n > 0")
    pieces = sized.select(
        "key",
        "n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"),
    ).select(
        "key",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"),
        F.coalesce(run, F.lit(-1)).cast("long").alias("run"),
    )
    counts = pieces.groupBy("length", "run").count()
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.select("length", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = (
        pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "run").orderBy("key", "piece")) - 1)
        .join(runs, ["length", "run"])
        .withColumn("rank", F.col("rank") + F.col("earlier"))
    )
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_best_fit(histogram, capacity)
    names = ["length", "rank_from", "rank_to", "first_bin", "per_bin", "offset"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    slots = spark.createDataFrame(
        pa.table({n: pa.array([p[i] for p in plan], k) for i, (n, k) in enumerate(zip(names, kinds))}), PLAN
    )
    # The plan's size is bounded by capacity, not by the input: each length meets few groups.
    if len(plan) <= 1_000_000:
        slots = F.broadcast(slots)
    at = F.col("rank") - F.col("rank_from")
    found = ranked.alias("r").join(
        slots.alias("s"),
        (F.col("r.length") == F.col("s.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    return found.select(
        F.col("key").alias(key),
        "piece",
        "start",
        F.col("r.length").alias("length"),
        (F.col("first_bin") + F.floor(at / F.col("per_bin"))).alias("bin_id"),
        (F.col("offset") + F.pmod(at, F.col("per_bin")) * F.col("r.length")).cast("int").alias("offset"),
    )
