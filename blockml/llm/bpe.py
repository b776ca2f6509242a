"""Byte-level BPE encoding and decoding.

A text is split into words by the vocabulary's pattern, in the JVM. Every distinct word is folded
once: ``aggregate`` starts from the ids of the word's bytes and at each step merges the pair of
neighbours with the lowest rank, looked up in a rank map that is part of the plan as literals (the
ranks of the first pairs are found in Arrow batches).
The most frequent words become a dictionary of checked size that is sent to the executors; the
words outside it are folded where they stand, once a row, so the text never moves. Words go to
Python in pieces of ``PIECE``, because Spark bounds the rows of an Arrow batch and, by default at
64 MB, its bytes, of which a task holds several times as much while it writes them. Decoding takes
each id's bytes from a literal and puts them one after the other, as they are.
"""

from __future__ import annotations

import base64
import heapq
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockml.functions.numeric import let
from blockml.session import col, default_parallelism, fresh, materialise

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Java reads \s as ASCII without (?U).
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ID_BITS = 17
PRIME = (1 << 34) + 25  # above every pair's key
_NONE = 1 << ID_BITS  # above all ids
_EMPTY = 1 << 60
ROWS = 512
#: Words of a row that goes to Python.
PIECE = 64


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """Bytes -> rank (the id) of a rank file: a base64 piece and its rank in each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in lines}


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> merged id: the last merge of every piece of two or more bytes."""
    out: dict[tuple[int, int], int] = {}
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(piece) > 1:
            last = merge_bytes(piece, ranks, out)
            if len(last) == 2:
                out[last[0], last[1]] = rank
    return out


def merge_bytes(word: bytes, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ids of one word. Neighbours wait in a heap by (rank, place), so long words cost n log n."""
    ids = [ranks[word[i : i + 1]] for i in range(len(word))]
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := pairs.get((ids[x], ids[y]))) is not None:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [ids[i] for i in range(n) if alive[i]]


def _literal(values, kind: str) -> Column:
    """An array literal: the optimizer folds the split and the cast of one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(multipliers, slots): key k lies at slot (k + 1) * multipliers[k % len(multipliers)] % PRIME % len(slots)."""
    groups = max(1, len(keys) // 3) | 1
    size = int(len(keys) * 1.3) | 1
    by_group = np.argsort(keys % groups, kind="stable")
    cut = np.searchsorted((keys % groups)[by_group], np.arange(groups + 1))
    multipliers, slots = np.ones(groups, np.int64), np.full(size, -1, np.int64)
    rng = np.random.default_rng(0)
    tries = rng.integers(1, 1 << 29, 1 << 16)
    for g in np.argsort(-np.diff(cut), kind="stable"):
        mine = keys[by_group[cut[g] : cut[g + 1]]]
        if not len(mine):
            break
        for m in tries:
            at = (mine + 1) * m % PRIME % size
            if (slots[at] < 0).all() and len(set(at.tolist())) == len(at):
                slots[at], multipliers[g] = mine, m
                break
        else:
            raise ValueError("no multiplier places all keys")
    return multipliers, slots


class Vocabulary:
    """Ranks, merges, and their literals."""

    def __init__(self, path: str = DEFAULT_RANKS):
        self.ranks = load_ranks(path)
        if max(self.ranks.values()) >> ID_BITS:
            raise ValueError(f"ids must be below {1 << ID_BITS}")
        self.pairs = merges(self.ranks)
        keys = np.array([(a << ID_BITS) | b for a, b in self.pairs], np.int64)
        self.multipliers, slots = perfect_hash(keys)
        self._literals: dict[str, Column] = {}
        value = {(a << ID_BITS) | b: r for (a, b), r in self.pairs.items()}
        # key and merged id in one number
        self.slots = np.array([_EMPTY if k < 0 else (k << ID_BITS) | value[k] for k in slots.tolist()], np.int64)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pieces: list[str | None] = [None] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = base64.b64encode(piece).decode()
        self.pieces = json.dumps(pieces)

    def _literal(self, name: str) -> Column:
        """One Column for all uses, so that the plan holds one copy."""
        if name not in self._literals:
            self._literals[name] = _literal(getattr(self, name), "bigint")
        return self._literals[name]

    def _packed(self, a: Column, b: Column) -> Column:
        """The merged id of a and b, or a number above all ids, and below it a. No b, nothing to merge."""

        def merged(key: Column) -> Column:
            m = F.get(self._literal("multipliers"), key % len(self.multipliers))
            found = F.get(self._literal("slots"), (key + 1) * m % PRIME % len(self.slots))
            return found.bitwiseXOR(F.shiftleft(key, ID_BITS))  # the id where the keys are equal, else a larger number

        # least takes no heed of nulls
        return F.shiftleft(F.least(let(F.shiftleft(a, ID_BITS).bitwiseOR(b), merged), F.lit(_NONE)), ID_BITS).bitwiseOR(a)

    def fold(self, start: Column) -> Column:
        """Ids of a word by a fold of ranked merges, from ``start_of`` its bytes. Each number holds an id and
        above it the id that it and the next one merge to, which is also the merge's rank: the least number
        is the next merge."""
        mask = (1 << ID_BITS) - 1

        def merge(state: Column, best: Column, k: Column) -> Column:
            new = F.shiftright(best, ID_BITS)

            def place(x: Column, i: Column) -> Column:
                after = F.when(i == k, self._packed(new, F.get(state, i + 2).bitwiseAND(mask)))
                return F.when((i < k - 1) | (i > k + 1), x).otherwise(F.coalesce(after, F.when(i < k, self._packed(x.bitwiseAND(mask), new)), F.lit(-1)))

            return F.array_remove(F.transform(state, place), -1)

        def step(state: Column, _: Column) -> Column:
            at = lambda best: (F.array_position(state, best) - 1).cast("int")
            return let(F.array_min(state), lambda best: F.when(best < _NONE << ID_BITS, let(at(best), lambda k: merge(state, best, k))).otherwise(state))

        ids = lambda state: F.transform(state, lambda x: x.bitwiseAND(mask).cast("int"))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(start))), start, step, ids)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``start_of`` needs."""
        return self.bytes, self.multipliers, self.slots


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _pieces(text: Column) -> Column:
    """The words of a text in arrays of ``PIECE``: one, without words, for an empty text, and null for null."""

    def cut(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found)), F.lit(PIECE))
        return F.when(found.isNotNull(), F.transform(starts, lambda i: F.slice(found, i, PIECE)))

    return let(words(text), cut)


def _count_words(batches):
    """Distinct words of a partition with their counts."""
    held, size = [], 0

    def merged():
        table = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return pa.table({"word": table["word"], "n": table["n_sum"]})

    for b in batches:
        found = b[0].flatten().value_counts()
        held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
        size += len(found)
        if size > 2_000_000:
            held = [merged()]
            size = len(held[0])
            if size > 1_000_000:
                yield from held[0].to_batches(100_000)
                held, size = [], 0
    if held:
        yield from merged().to_batches(100_000)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def start_of(words: pa.Array, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.ListArray:
    """For each word what a fold starts from: the ids of its bytes, each below what it merges to with the next."""
    code, multipliers, slots = tables
    words = pa.concat_arrays([words, pa.array([""], pa.string())])  # never without a buffer
    upto = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)].astype(np.int64)
    a = code[np.frombuffer(words.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]]
    upto = upto - upto[0]
    key = (a << ID_BITS) | np.append(a[1:], 0)
    found = slots[(key + 1) * multipliers[key % len(multipliers)] % PRIME % len(slots)] ^ (key << ID_BITS)
    merged = np.minimum(found, _NONE)
    merged[upto[1:][np.diff(upto) > 0] - 1] = _NONE  # the last byte of a word has no next one
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(merged << ID_BITS | a))


def _starts(tables):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["word"], start_of(b["word"], tables)], names=["word", "start"])

    return run


def _whole(batches):
    """Batches of whole rows from rows in pieces: the first piece has number 0 and all other columns, the words
    come last. A row's pieces may lie in several batches."""

    def joined(parts):
        b = pa.concat_batches(parts)
        *others, number, lists = b.columns
        first = np.flatnonzero(number.to_numpy() == 0)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        at = pa.array(first)
        upto = pa.array(ends[np.append(first, len(number))], pa.int32())
        together = pa.ListArray.from_arrays(upto, lists.flatten(), mask=lists.is_null().take(at))
        return pa.RecordBatch.from_arrays([*(x.take(at) for x in others), together], names=[*b.schema.names[:-2], b.schema.names[-1]])

    open_row: list[pa.RecordBatch] = []  # its last piece may be still to come
    for b in batches:
        first = np.flatnonzero(b.column(b.num_columns - 2).to_numpy() == 0)
        if len(first):
            if open_row or first[-1]:
                yield joined([*open_row, b.slice(0, first[-1])])
            b, open_row = b.slice(first[-1]), []
        open_row.append(b)
    if open_row:
        yield joined(open_row)


def _lookup(held, fold_bytes: int, names: tuple[str, str]):
    """Batches of word lists as segments, each the ids of known words and then one unknown word, or none
    at the row's end; and the starts of the row's unknown words, to which segments refer."""

    def convert(b):
        dictionary, begin, width, ids, ranks, pairs, tables = held.value
        *others, lists = b.columns
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        unique = coded.dictionary
        at = pc.fill_null(pc.index_in(unique, value_set=dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.binary_length(unique).to_numpy(zero_copy_only=False)
        known = at >= 0
        starts, widths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[known], widths[known] = begin[at[known]], width[at[known]]
        unknown, long, total = ~known, [ids], len(ids)
        for k in np.flatnonzero(unknown & (size > fold_bytes)):  # a fold is quadratic in the word
            own = np.array(merge_bytes(unique[int(k)].as_py().encode(), ranks, pairs), np.int32)
            starts[k], widths[k], unknown[k] = total, len(own), False
            long.append(own)
            total += len(own)
        flat = np.concatenate(long) if len(long) > 1 else ids
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        w = widths[word]
        found = flat[_ranges(starts[word], w)].astype(np.int32)
        upto, ends = np.concatenate([[0], np.cumsum(w)]), np.cumsum(counts)
        places = np.flatnonzero(unknown[word])
        # the row's unknown words, each once
        row = np.searchsorted(ends, places, "right")
        once, which = np.unique(row * max(1, len(unique)) + word[places], return_inverse=True)
        own_row = once // max(1, len(unique))
        number = np.arange(len(once)) - np.searchsorted(own_row, own_row)
        own_words = start_of(unique.take(pa.array(once % max(1, len(unique)))), tables)
        own_ends = pa.array(np.searchsorted(own_row, np.arange(len(counts) + 1)), pa.int32())
        # segments end at unknown words and at the ends of rows
        order = np.argsort(np.concatenate([places * 2, ends * 2 - 1]), kind="stable")
        cut = np.concatenate([upto[places], upto[ends]])[order]
        refers = pa.array(np.concatenate([number[which], np.full(len(ends), -1)])[order], pa.int32())
        pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cut]), pa.int32()), pa.array(found))
        segments = pa.StructArray.from_arrays([pieces, refers], names=["known", "word"])
        offsets = pa.array(np.concatenate([[0], np.flatnonzero(order >= len(places)) + 1]), pa.int32())
        missing = lists.is_null()
        return pa.RecordBatch.from_arrays([*others, pa.ListArray.from_arrays(offsets, segments, mask=missing), pa.ListArray.from_arrays(own_ends, own_words, mask=missing)], names=[*b.schema.names[:-1], *names])

    def run(batches):
        for b in _whole(batches):
            for k in range(0, b.num_rows, ROWS):  # memory follows this number, not the batch
                yield convert(b.slice(k, ROWS))

    return run


def dictionary_of(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", max_words: int = 400_000, fold_bytes: int = 128) -> pa.Table:
    """(word, ids) of the most frequent words, ``max_words`` at most, of two or more occurrences.

    Words are counted over all documents; those left out are folded where they occur, so the
    bound decides about speed and not about results.
    """
    counts = materialise(
        docs.where(col(text).isNotNull()).select(F.explode(_pieces(col(text))).alias("w")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")),
        "bpe-words",
    ).where((F.octet_length("word") <= fold_bytes) & (F.col("n") > 1))
    per = sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, taken = 2, 0
    for n, k in per:
        taken += k
        if taken > max_words:
            least = n + 1
            break
    frequent = counts.where(F.col("n") >= least).select("word").repartition(2 * default_parallelism(docs.sparkSession))
    started = frequent.mapInArrow(_starts(vocabulary.tables()), "word string, start array<bigint>")
    return started.select("word", vocabulary.fold(F.col("start")).alias("ids")).toArrow()


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    name: str = "tokens",
    max_words: int = 400_000,
    fold_bytes: int = 128,
) -> DataFrame:
    """``docs`` with the ids of ``text`` as an array of int.

    Null texts give null, empty texts an empty array. The whole text counts. Special tokens are
    ordinary text. Words of more than ``fold_bytes`` bytes, for which a fold is too slow, are
    merged with a heap, with the same result. Repeated rows get the same ids; an empty table
    gives an empty one; a column called ``name`` is replaced and other columns pass unchanged.
    """
    spark = docs.sparkSession
    table = dictionary_of(docs, vocabulary, text, max_words, fold_bytes).combine_chunks()
    lists = table["ids"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    width = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    known = pa.concat_arrays(table["word"].cast(pa.string()).chunks) if table.num_rows else pa.array([], pa.string())
    held = spark.sparkContext.broadcast(
        (known, np.cumsum(width) - width, width, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), vocabulary.ranks, vocabulary.pairs, vocabulary.tables())
    )  # max_words words
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    segments, unknown = fresh(columns, "segments", "unknown")
    # mapInArrow takes no names with dots, so columns go by number
    numbered = [f"c{i}" for i in range(len(columns))]
    cut = docs.select(*(col(c).alias(i) for c, i in zip(columns, numbered)), F.posexplode_outer(_pieces(col(text))).alias("piece", "split"))
    number = F.coalesce("piece", F.lit(0))
    said = cut.select(*(F.when(number == 0, F.col(i)).alias(i) for i in numbered), number.alias("piece"), "split")
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in said.schema.fields[:-2])
    found = said.mapInArrow(_lookup(held, fold_bytes, (segments, unknown)), f"{kinds}{segments} array<struct<known: array<int>, word: int>>, {unknown} array<array<bigint>>")

    def filled(folded: Column) -> Column:
        return F.flatten(F.transform(segments, lambda s: F.when(s["word"] < 0, s["known"]).otherwise(F.concat(s["known"], F.get(folded, s["word"])))))

    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), let(F.transform(unknown, vocabulary.fold), filled).alias(name))


def decode(docs: DataFrame, vocabulary: Vocabulary, tokens: str = "tokens", name: str = "text") -> DataFrame:
    """``docs`` with the bytes of the ids in ``tokens``, one after the other, as a string.

    Null gives null, an empty array the empty string. A null id or one that the vocabulary lacks
    makes the whole text null. Repeated rows get the same text; an empty table gives an empty one. A
    column called ``name`` is replaced; others pass unchanged.
    """
    pieces = F.from_json(F.lit(vocabulary.pieces), "array<binary>").cast("array<string>")  # bytes as they are
    known = F.transform(col(tokens), lambda t: F.get(pieces, t))
    text = let(known, lambda found: F.when(~F.exists(found, lambda p: p.isNull()), F.array_join(found, "")))
    return docs.select(*(col(c) for c in docs.columns if c.lower() != name.lower()), text.alias(name))
