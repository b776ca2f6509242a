"""Exact deduplication with a two-pass Bloom filter.

Pass 1 hashes every text in the JVM and sends the 8-byte hashes, no text, to tasks by range. Each
holds its part of a Bloom filter with two levels, where a bit of the upper level is set when two or
more hashes hit it; a hash that finds all its upper bits set is possibly repeated. These hashes go
into a second filter, whose size follows the repeated hashes and has a bound, and which is sent to
every executor. Pass 2 looks every row up in it: a row that misses is certainly the only one with its
text and passes straight through. Just the rest is shuffled and grouped by SHA-256 of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockml.llm.toxicity import mix
from blockml.session import col, fresh, materialise

SEGMENT_BITS = 1 << 23
PART_ROWS = 1 << 21
_HASHES = pa.schema([("part", pa.int32()), ("hashes", pa.binary())])
_WORDS = pa.schema([("segment", pa.int32()), ("words", pa.binary())])


def _send_hashes(parts: int):
    """A task's hashes by range, each twice at most: a text that fills the table does not fill a range."""

    def packed(held):
        u, n = np.unique(np.concatenate(held), return_counts=True)
        h = np.repeat(u, np.minimum(n, 2))
        part = ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, part = h[order], part[order]
        cut = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(part)]):
            yield pa.RecordBatch.from_pylist([{"part": int(part[lo]), "hashes": h[lo:hi].tobytes()}], _HASHES)

    def run(batches):
        held = []
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy())
            if sum(map(len, held)) > 2_000_000:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return run


def _repeated(bits_per_row: int, hashes: int):
    """The hashes of one range that its part of the filter holds possible to be repeated."""

    def run(batches):
        held = [np.frombuffer(x.as_buffer(), "<i8") for b in batches for x in b["hashes"]]
        if not held:
            return
        h = np.concatenate(held)
        bits = max(64, bits_per_row * len(h))
        at = [(mix(h.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits)).astype(np.int64) for k in range(hashes)]
        hits = np.sort(np.concatenate(at))
        upper = np.zeros(bits, bool)
        upper[hits[1:][hits[1:] == hits[:-1]]] = True
        found = np.unique(h[np.logical_and.reduce([upper[a] for a in at])])
        yield from pa.table({"h": found}).to_batches(100_000)

    return run


def _positions(h: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(bits)) for k in range(hashes)]


def _pack(batches):
    """Bits of one task, one row per touched segment."""
    held = [c.to_numpy() for b in batches for c in b.columns]
    if not held:
        return
    pos = np.unique(np.concatenate(held))
    seg = pos // SEGMENT_BITS
    for part in np.split(pos, np.flatnonzero(np.diff(seg)) + 1):
        if len(part):
            s = int(part[0] // SEGMENT_BITS)
            yield pa.RecordBatch.from_pylist([{"segment": s, "words": (part - s * SEGMENT_BITS).astype("<u4").tobytes()}], _WORDS)


def _merge(batches):
    """The segments of one task as bit maps."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for s, bits in zip(b["segment"].to_pylist(), b["words"]):
            held.setdefault(s, np.zeros(SEGMENT_BITS, bool))[np.frombuffer(bits.as_buffer(), "<u4")] = True
    for s, flags in held.items():
        yield pa.RecordBatch.from_pylist([{"segment": s, "words": np.packbits(flags, bitorder="little").tobytes()}], _WORDS)


def _assemble(words: int):
    def run(batches):
        out = np.zeros(-(-words * 64 // SEGMENT_BITS) * SEGMENT_BITS // 64, "<i8")
        per = SEGMENT_BITS // 64
        for b in batches:
            for s, w in zip(b["segment"].to_pylist(), b["words"]):
                out[s * per : (s + 1) * per] = np.frombuffer(w.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(out[:words]))], names=["words"])

    return run


def possibly_repeated(docs: DataFrame, text: str, bits_per_row: int = 24, hashes: int = 3) -> DataFrame:
    """(h): hashes of texts that two or more rows may have; none that two rows do have lacks."""
    rows = docs.count()
    parts = max(1, -(-rows // PART_ROWS))
    known = docs.where(col(text).isNotNull()).select(F.xxhash64(col(text)).alias("h"))
    sent = known.mapInArrow(_send_hashes(parts), "part int, hashes binary").repartitionById(parts, F.col("part"))
    return sent.mapInArrow(_repeated(bits_per_row, hashes), "h long")


def filter_of(suspects: DataFrame, count: int, max_filter_mb: float) -> tuple[DataFrame, int, int]:
    """One row with the filter's 64-bit words, its bits, and the number of its hashes."""
    bits = -(-int(min(16 * count, max(64, max_filter_mb * 8e6))) // 64) * 64
    hashes = min(4, max(1, round(0.69 * bits / count)))
    segments = -(-bits // SEGMENT_BITS)
    sent = suspects.select(*(p.alias(f"p{k}") for k, p in enumerate(_positions(F.col("h"), bits, hashes)))).mapInArrow(_pack, "segment int, words binary")
    merged = sent.repartitionById(segments, F.col("segment")).mapInArrow(_merge, "segment int, words binary")
    return materialise(merged.repartition(1).mapInArrow(_assemble(bits // 64), "words array<bigint>"), "dedup-filter"), bits, hashes


def exact_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id", bits_per_row: int = 24, hashes: int = 3, max_filter_mb: float = 256) -> DataFrame:
    """One row of each set of rows with byte-identical ``text``; all columns are kept.

    The row with the smallest ``order`` stays (null last; then the smallest JSON form of the
    other columns). Rows with null text are equal to nothing and all stay; the empty text is a
    text like any other. Repeated rows collapse to one. An empty table gives an empty table.
    Column names are free: internal names avoid those present, and names may have dots.

    The filter of pass 1 takes ``bits_per_row`` bits a row and is never in one place. That of pass 2
    takes 16 bits a possibly repeated hash, however often it is repeated, and ``max_filter_mb`` at
    most: where that is too little, more rows than needed are shuffled, and the result is the same.
    """
    columns = docs.columns
    h, maybe, digest, rest, words = fresh(columns, "h", "maybe", "digest", "rest", "words")
    suspects = materialise(possibly_repeated(docs, text, bits_per_row, hashes), "dedup-suspects")
    count = suspects.count()
    if not count:
        return docs
    table, bits, hashes = filter_of(suspects, count, max_filter_mb)
    # one row of at most max_filter_mb
    probe = docs.withColumn(h, F.xxhash64(col(text))).crossJoin(F.broadcast(table.withColumnRenamed("words", words)))
    hit = col(text).isNotNull()
    for p in _positions(F.col(h), bits, hashes):
        hit = hit & (F.getbit(F.get(F.col(words), F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    probe = probe.withColumn(maybe, hit)
    alone = probe.where(~F.col(maybe)).select(*map(col, columns))
    others = [c for c in columns if c not in (text, order)]
    rank = F.struct(col(order).isNull(), col(order), F.to_json(F.struct(*map(col, others))) if others else F.lit(""))
    kept = (
        probe.where(F.col(maybe))
        .groupBy(F.col(h), F.sha2(col(text).cast("binary"), 256).alias(digest))
        .agg(F.min_by(F.struct(*(col(c).alias(f"c{i}") for i, c in enumerate(columns))), rank).alias(rest))
        .select(*(F.col(rest).getField(f"c{i}").alias(c) for i, c in enumerate(columns)))
    )
    return alone.unionByName(kept)
