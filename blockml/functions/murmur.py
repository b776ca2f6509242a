"""MurmurHash3, 32 bits, over UTF-8."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_M = 0xFFFFFFFF


def murmur3(data: bytes, seed: int = 0) -> int:
    """Signed hash."""
    h = seed
    whole = len(data) & ~3
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & _M
        k = (k << 15 | k >> 17) & _M
        h ^= k * 0x1B873593 & _M
        h = (h << 13 | h >> 19) & _M
        h = (h * 5 + 0xE6546B64) & _M
    if tail := data[whole:]:
        k = int.from_bytes(tail, "little") * 0xCC9E2D51 & _M
        k = (k << 15 | k >> 17) & _M
        h ^= k * 0x1B873593 & _M
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def murmur3_all(terms: pa.Array, seed: int = 0) -> np.ndarray:
    """Signed hashes of all strings at once: the k-th words of all that have one are mixed together."""
    terms = pa.concat_arrays([terms.cast(pa.large_binary()), pa.array([b"\0" * 4], pa.large_binary())])  # never without a buffer
    upto = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms)]
    data = np.frombuffer(terms.buffers()[2], np.uint8)
    begin, size = upto[:-1], np.diff(upto)
    h = np.full(len(size), seed, np.uint32)

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    at, block = np.flatnonzero(size >= 4), 0
    while len(at):
        k = np.zeros(len(at), np.uint32)
        for i in range(4):
            k |= data[begin[at] + 4 * block + i].astype(np.uint32) << np.uint32(8 * i)
        x = h[at] ^ mixed(k)
        h[at] = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        block += 1
        at = at[size[at] >= 4 * block + 4]
    k = np.zeros(len(size), np.uint32)
    for i in range(3):
        has = np.flatnonzero(size % 4 > i)
        k[has] |= data[begin[has] + size[has] // 4 * 4 + i].astype(np.uint32) << np.uint32(8 * i)
    h ^= mixed(k)
    h ^= size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def _hash(terms: pa.Array) -> pa.Array:
    return pa.array(murmur3_all(terms.fill_null("")), pa.int32(), mask=terms.is_null().to_numpy(zero_copy_only=False))


_hash.__annotations__ = {"terms": pa.Array, "return": pa.Array}
murmur3_column = F.arrow_udf(_hash, IntegerType())
