"""N-gram Jaccard self-join with a prefix tree.

0. Rows with equal texts are one unit, named by a 64-bit hash of the text; a task sends a text once.
1. A text becomes the set of its word n-grams, as 64-bit hashes. The sets are shuffled once by
   n-gram, packed in arrays, which gives every n-gram its document frequency. N-grams of a single
   text can be in no overlap, so only the others go back to their texts, with the size
   of the full set.
2. All n-grams are ordered by (binary order of magnitude of the document frequency, hash). Two sets with a Jaccard similarity of
   at least t share an n-gram among the first |x| - ceil(t |x|) + 1 of each (its prefix). A
   text whose prefix is made of its own n-grams only is done.
3. A text goes to the group of each of its ``heads``, the prefix n-grams with the smallest
   hashes. A group puts its ordered sets into a trie and walks all of them down the trie at once:
   sets with a common start share the partial overlap of it, and a subtree is left as soon as
   what remains of either side can't lift the overlap to the bound.
4. Pairs that meet in the prefix but have no common head come from the prefix n-grams directly,
   are counted, cut by the same bound, and verified on their sets. So the join is exact.
5. ``near_classes`` never writes a group's pairs: a group gives each of its texts the number of its
   links and the smallest text that it is connected to, and connected components join the groups.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockml.llm.toxicity import mix
from blockml.operators.cluster import components
from blockml.session import fresh, materialise, shuffle_partitions

BUCKET_BYTES = 64 << 20


@functools.lru_cache
def word_characters() -> np.ndarray:
    """Code point -> its lower-case form, or 0 outside words."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch == "_" or unicodedata.category(ch)[0] in "LN":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_M = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_M, -1, 1 << 64)


@functools.lru_cache
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(count, _M, np.uint64)
    up[0] = 1
    down = np.full(count, _INV, np.uint64)
    down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-case words, in order."""
    c = word_characters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.concatenate([[False], c != 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    room = 1 << max(12, int(len(c)).bit_length())
    up, down = _powers(room)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(c.astype(np.uint64)) * up[: len(c)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def ngram_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of all words where there are fewer than n."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(_M) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _column(table, name: str, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(b.as_buffer(), dtype) for b in table[name])])


def _send_grams(n: int, buckets: int):
    """Rows (bucket, ids, counts, grams): a batch's n-grams by bucket of the hash. A task sends each
    text once, so a text that fills the table is sent once a task."""

    def run(batches):
        ids, sets, size = [], [], 0
        seen: set[int] = set()

        def rows():
            lens = np.array([len(s) for s in sets])
            grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lens)
            bucket = (grams % np.uint64(buckets)).astype(np.uint16 if buckets <= 65536 else np.int64)
            order = np.argsort(bucket, kind="stable")
            grams, owner, bucket = grams[order], owner[order], bucket[order]
            name = np.array(ids, np.int64)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(bucket)]):
                mine = owner[lo:hi]
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                yield {"bucket": int(bucket[lo]), "ids": name[mine[first]].tobytes(), "counts": np.diff(np.append(first, hi - lo)).astype("<u4").tobytes(), "grams": grams[lo:hi].tobytes()}

        for b in batches:
            for key, text in zip(b[0].to_pylist(), b[1]):
                if key in seen:
                    continue
                if len(seen) > 2_000_000:  # memory only
                    seen.clear()
                seen.add(key)
                s = ngram_set(text.as_py(), n)
                if len(s):
                    ids.append(key)
                    sets.append(s)
                    size += len(s)
                if size > 2_000_000:
                    yield pa.RecordBatch.from_pylist(list(rows()), _GRAMS)
                    ids, sets, size = [], [], 0
        if sets:
            yield pa.RecordBatch.from_pylist(list(rows()), _GRAMS)

    return run


_GRAMS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])
_BACK = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("level", pa.binary())])
_SETS = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("prefix", pa.int32()), ("heads", pa.list_(pa.int64())), ("grams", pa.binary()), ("order", pa.binary())])


def _whole(function):
    """``function`` of the table that a partition is, for mapInArrow."""

    def run(batches):
        held = list(batches)
        if held:
            yield from function(pa.Table.from_batches(held)).to_batches()

    return run


def _frequencies(parts: int):
    """One bucket: n-grams of two or more documents, with their frequency's order of magnitude (one
    byte instead of a count), by part of the document."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.repeat(_column(table, "ids", "<i8"), _column(table, "counts", "<u4").astype(np.int64))
        grams = _column(table, "grams", "<u8")
        order = np.lexsort((ids, grams))
        grams, ids = grams[order], ids[order]
        run_of = np.cumsum(np.concatenate([[True], grams[1:] != grams[:-1]])) - 1
        once = np.concatenate([[True], (run_of[1:] != run_of[:-1]) | (ids[1:] != ids[:-1])])
        ids, run_of, grams = ids[once], run_of[once], grams[once]
        df = np.bincount(run_of)[run_of]
        part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((ids, part))
        ids, grams, df, part = ids[order], grams[order], df[order], part[order]
        rows = []
        cut = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(part)]) if len(part) else ():
            mine, shared = ids[lo:hi], df[lo:hi] > 1
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            sizes = np.diff(np.append(first, hi - lo))
            rows.append({"part": int(part[lo]), "ids": mine[first].tobytes(), "sizes": sizes.astype("<u4").tobytes(), "counts": np.add.reduceat(shared, first).astype("<u4").tobytes(), "grams": grams[lo:hi][shared].tobytes(), "level": np.frexp(df[lo:hi][shared])[1].astype("u1").tobytes()})
        return pa.Table.from_pylist(rows, _BACK)

    return run


def _collect_sets(threshold: float, heads: int):
    """One part of the texts: ordered shared n-grams, for texts that can have a partner."""

    def run(table: pa.Table) -> pa.Table:
        ids = _column(table, "ids", "<i8")
        sizes, counts = _column(table, "sizes", "<u4").astype(np.int64), _column(table, "counts", "<u4").astype(np.int64)
        grams, level = _column(table, "grams", "<u8"), _column(table, "level", "u1")
        name, at = np.unique(ids, return_inverse=True)
        size = np.bincount(at, sizes, len(name)).astype(np.int64)
        owner = np.repeat(at, counts)
        order = np.lexsort((grams, level, owner))
        grams, level, owner = grams[order], level[order], owner[order]
        shared = np.bincount(owner, minlength=len(name))
        begin = np.cumsum(shared) - shared
        prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1 - (size - shared)
        prefix = np.minimum(prefix, shared)
        rows = []
        for i in np.flatnonzero((prefix > 0) & (shared >= np.ceil(threshold * size - 1e-9))):
            mine = grams[begin[i] : begin[i] + shared[i]]
            rows.append({"id": int(name[i]), "size": int(size[i]), "prefix": int(prefix[i]), "heads": _heads(mine, prefix[i], heads).view(np.int64).tolist(), "grams": mine.tobytes(), "order": level[begin[i] : begin[i] + shared[i]].tobytes()})
        return pa.Table.from_pylist(rows, _SETS)

    return run


def needed(a, b, threshold: float):
    """Least overlap of sets of sizes a and b that reaches the threshold."""
    return np.ceil(threshold / (1 + threshold) * (np.asarray(a) + np.asarray(b)) - 1e-9).astype(np.int64)


class Trie:
    """A path-compressed trie of integer sequences, in arrays. Nodes are numbered breadth first;
    node k holds tokens[start[k]:end[k]] and the sequences low[k] to high[k] (exclusive) of the
    sorted ones pass through it; ``ends`` of its sequences end in it and come first."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: sequences[i].tolist())
        seqs = [sequences[i] for i in self.order]
        self.tokens = np.concatenate([np.zeros(0, np.int64), *seqs])
        lens = np.array([len(s) for s in seqs], np.int64)
        at = np.cumsum(lens) - lens
        common = np.zeros(len(seqs), np.int64)  # with the sequence before
        for i in range(1, len(seqs)):
            m = min(lens[i], lens[i - 1])
            differ = np.flatnonzero(seqs[i][:m] != seqs[i - 1][:m])
            common[i] = differ[0] if len(differ) else m
        nodes, children, queue = [], [], [(0, len(seqs), 0)] if seqs else []
        for low, high, depth in queue:
            inner = common[low + 1 : high]
            end = int(min(lens[low], inner.min())) if high - low > 1 else int(lens[low])
            stop = low
            while stop < high and lens[stop] == end:
                stop += 1
            nodes.append((int(at[low]) + depth, int(at[low]) + end, low, high, stop - low))
            cuts = [k for k in range(stop, high) if k == stop or common[k] <= end]
            children.append((len(queue), len(queue) + len(cuts)))
            queue += [(k, to, end) for k, to in zip(cuts, [*cuts[1:], high])]
        self.start, self.end, self.low, self.high, self.ends = np.array(nodes, np.int64).reshape(-1, 5).T
        self.first_child, self.last_child = np.array(children, np.int64).reshape(-1, 2).T
        self.longest = np.array([lens[a:b].max() for a, b in zip(self.low, self.high)], np.int64)
        self.depth_end = self.end - at[self.low]


def trie_join(sequences: list[np.ndarray], sizes: np.ndarray, width: int, threshold: float, chunk: int = 1 << 22):
    """Pairs (i, j, overlap) with sizes[i] and sizes[j] reaching the threshold.

    ``sequences``: sets of numbers below ``width``, ascending in the global order. Every sequence
    walks down the trie of all; (walker, node) pairs advance one level at a time.
    """
    trie = Trie(sequences)
    lens = np.array([len(s) for s in sequences], np.int64)
    rank = np.empty(len(sequences), np.int64)
    rank[trie.order] = np.arange(len(sequences))
    size_sorted = sizes[trie.order]
    smallest = np.array([size_sorted[a:b].min() for a, b in zip(trie.low, trie.high)], np.int64)
    found = []
    step = max(1, chunk // max(1, width))
    for lo in range(0, len(sequences), step):
        walkers = np.arange(lo, min(lo + step, len(sequences)))
        # before[w, t]: how many tokens below t walker w has; token t is in it where this grows
        has = np.zeros((len(walkers), width + 1), np.int32)
        for k, i in enumerate(walkers):
            has[k, sequences[i] + 1] = 1
        before = np.cumsum(has, axis=1, dtype=np.int32)
        w = np.arange(len(walkers))
        node = np.zeros(len(w), np.int64)
        overlap = np.zeros(len(w), np.int64)
        while len(w):
            counts = trie.end[node] - trie.start[node]
            out_w, out_node, out_overlap = [], [], []
            # bound the expansion of one round
            limit = np.searchsorted(np.cumsum(counts), np.arange(chunk, counts.sum() + chunk, chunk), "right")
            for a, b in zip([0, *limit], [*limit, len(w)]):
                if a >= b:
                    continue
                c = counts[a:b]
                tokens = trie.tokens[_ranges(trie.start[node[a:b]], c)]
                ww = np.repeat(w[a:b], c)
                hits = has[ww, tokens + 1]
                total = np.concatenate([[0], np.cumsum(hits)])
                ends = np.cumsum(c)
                o = overlap[a:b] + total[ends] - total[ends - c]
                nd, wk = node[a:b], w[a:b]
                me = walkers[wk]
                # what remains of the walker after the node's last token, and of the subtree
                last = trie.tokens[np.maximum(trie.end[nd] - 1, 0)] if len(trie.tokens) else np.zeros(len(nd), np.int64)
                passed = np.where(trie.end[nd] > 0, before[wk, last + 1], 0)
                rest = np.minimum(lens[me] - passed, trie.longest[nd] - trie.depth_end[nd])
                # a pair is found by the one of it that comes first in the trie
                alive = (o + rest >= needed(sizes[me], smallest[nd], threshold)) & (trie.high[nd] > rank[me])
                o, nd, wk, me = o[alive], nd[alive], wk[alive], me[alive]
                e = trie.ends[nd]
                if e.any():
                    other = _ranges(trie.low[nd], e)
                    i, oo = np.repeat(me, e), np.repeat(o, e)
                    j = np.asarray(trie.order)[other]
                    good = (other > rank[i]) & (oo >= needed(sizes[i], sizes[j], threshold)) & (oo > 0)
                    found.append(np.stack([i[good], j[good], oo[good]], 1))
                kids = trie.last_child[nd] - trie.first_child[nd]
                out_node.append(_ranges(trie.first_child[nd], kids))
                out_w.append(np.repeat(wk, kids))
                out_overlap.append(np.repeat(o, kids))
            w, node, overlap = np.concatenate(out_w), np.concatenate(out_node), np.concatenate(out_overlap)
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


def _heads(grams: np.ndarray, prefix: int, heads: int) -> np.ndarray:
    return np.sort(mix(grams[:prefix]))[:heads]


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64())])
PAIRS = "a long, b long, overlap long, size_a long, size_b long"
_STARS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
STARS = "id long, links long, root long"


def _pairs(table_rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.Table:
    i, j, o = table_rows.T
    swap = ids[i] > ids[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pa.table([pa.array(x, pa.int64()) for x in (ids[i], ids[j], o, sizes[i], sizes[j])], schema=_PAIRS)


def _smallest_common(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that rows i and j of ``own`` have in common; the largest number if none."""
    out = np.full(len(i), np.iinfo(np.uint64).max, np.uint64)
    for p in range(own.shape[1]):
        for q in range(own.shape[1]):
            x = own[i, p]
            np.minimum(out, x, out=out, where=x == own[j, q])
    return out


def _stars(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> pa.Table:
    """Of pairs (i, j): for each in one, how many it is in and the smallest id that they connect it to."""
    links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = ids.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(links)
    return pa.table([pa.array(x[at], pa.int64()) for x in (ids, links, root)], schema=_STARS)


def _join_group(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes, and the pairs (i, j, overlap) of one head's group whose smallest common head it is."""
    head = np.array(table["head"][0].as_py()).view(np.uint64)
    ids, sizes = table["id"].to_numpy(), table["size"].to_numpy().astype(np.int64)
    grams = [np.frombuffer(g.as_buffer(), "<u8") for g in table["grams"]]
    if len(ids) == 2:  # a trie of two is their common start
        o = len(np.intersect1d(*grams, assume_unique=True))
        found = np.array([[0, 1, o]] if o and o >= needed(sizes[0], sizes[1], threshold) else np.zeros((0, 3)), np.int64)
    else:
        every, level = np.concatenate(grams), _column(table, "order", "u1")
        u, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        number = np.empty(len(u), np.int64)
        number[np.lexsort((u, level[first]))] = np.arange(len(u))
        sequences = np.split(number[inverse], np.cumsum(list(map(len, grams)))[:-1])
        found = trie_join(sequences, sizes, len(u), threshold)
    if len(found):
        own = [h.as_py() for h in table["heads"]]
        width = max(map(len, own))
        own = np.array([h + h[:1] * (width - len(h)) for h in own], np.int64).view(np.uint64)
        found = found[_smallest_common(own, found[:, 0], found[:, 1]) == head]
    return ids, sizes, found


def _join_groups(threshold: float, stars: bool):
    """Over a partition that is sorted by head: a group at a time, so that no more than one is held."""

    def groups(batches):
        held, current = [], None
        for b in batches:
            heads = b.column("head").to_numpy()
            cut = np.flatnonzero(heads[1:] != heads[:-1]) + 1
            for lo, hi in zip([0, *cut], [*cut, len(heads)]):
                if lo == hi:
                    continue
                if heads[lo] != current:
                    if sum(map(len, held)) > 1:
                        yield pa.Table.from_batches(held)
                    held, current = [], heads[lo]
                held.append(b.slice(lo, hi - lo))
        if sum(map(len, held)) > 1:
            yield pa.Table.from_batches(held)

    def run(batches):
        out, rows = [], 0
        for table in groups(batches):
            ids, sizes, found = _join_group(table, threshold)
            if len(found):
                out.append(_stars(found[:, 0], found[:, 1], ids) if stars else _pairs(found, ids, sizes))
                rows += len(out[-1])
            if rows > 100_000:
                yield from pa.concat_tables(out).combine_chunks().to_batches(100_000)
                out, rows = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches(100_000)

    return run


_ENTRIES = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("rest", pa.binary()), ("heads", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])


def _send_prefixes(heads: int, buckets: int):
    """Prefix n-grams by bucket, with what the count bound needs."""

    def run(batches):
        for b in batches:
            got = b.to_pylist()
            if not got:
                continue
            pre = [np.frombuffer(r["grams"], "<u8")[: r["prefix"]] for r in got]
            own = np.array([r["heads"] + r["heads"][:1] * (heads - len(r["heads"])) for r in got], np.int64)
            ids, sizes = np.array([r["id"] for r in got]), np.array([r["size"] for r in got], "<u4")
            rest = np.array([len(r["grams"]) // 8 - r["prefix"] for r in got], "<u4")
            grams, owner = np.concatenate(pre), np.repeat(np.arange(len(got)), list(map(len, pre)))
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            grams, owner, bucket = grams[order], owner[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for lo, hi in zip([0, *cut], [*cut, len(bucket)]):
                mine = owner[lo:hi]
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                m = mine[first]
                rows.append({"bucket": int(bucket[lo]), "ids": ids[m].tobytes(), "sizes": sizes[m].tobytes(), "rest": rest[m].tobytes(), "heads": own[m].tobytes(), "counts": np.diff(np.append(first, hi - lo)).astype("<u4").tobytes(), "grams": grams[lo:hi].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _ENTRIES)

    return run


def _meet(heads: int, threshold: float, chunk: int = 1 << 21, large: int = 32):
    """Pairs of one bucket with a common prefix n-gram and no common head, with their count."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, rest = _column(table, "ids", "<i8"), _column(table, "sizes", "<u4").astype(np.int64), _column(table, "rest", "<u4").astype(np.int64)
        own = _column(table, "heads", "<u8").reshape(-1, heads)
        counts, grams = _column(table, "counts", "<u4").astype(np.int64), _column(table, "grams", "<u8")
        # an id has a row for each batch of n-grams that it came in
        ids, first, at = np.unique(ids, return_index=True, return_inverse=True)
        sizes, rest, own = sizes[first], rest[first], own[first]
        owner = np.repeat(at, counts)
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(grams)))
        # In a large group, those with the group's most common head have it in common: they are put last,
        # and only the others look for partners among all after them.
        idle = np.zeros(len(grams), bool)
        for lo, n in zip(first[length > large], length[length > large]):
            members = owner[lo : lo + n]
            heads_there, many = np.unique(own[members], return_counts=True)
            has = (own[members] == heads_there[many.argmax()]).any(axis=1)
            owner[lo : lo + n] = np.concatenate([members[~has], members[has]])
            idle[lo + n - has.sum() : lo + n] = True
        partners = np.where(idle, 0, np.repeat(first + length, length) - np.arange(len(grams)) - 1)  # those after it in its group
        total = np.cumsum(partners)
        out = []
        lo = 0
        while lo < len(grams):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + chunk, "right")))
            c = partners[lo:hi]
            i, j = owner[np.repeat(np.arange(lo, hi), c)], owner[_ranges(np.arange(lo, hi) + 1, c)]
            ok = np.minimum(sizes[i], sizes[j]) >= np.ceil(threshold * np.maximum(sizes[i], sizes[j]) - 1e-9)
            i, j = i[ok], j[ok]
            apart = np.ones(len(i), bool)
            for p in range(heads):
                for q in range(heads):
                    apart &= own[i, p] != own[j, q]
            i, j = i[apart], j[apart]
            pair, n = np.unique(np.minimum(i, j) * len(ids) + np.maximum(i, j), return_counts=True)
            out.append(np.stack([pair // max(1, len(ids)), pair % max(1, len(ids)), n], 1))
            lo = hi
        a, b, n = np.concatenate([np.zeros((0, 3), np.int64), *out]).T
        lack = needed(sizes[a], sizes[b], threshold) - np.maximum(rest[a], rest[b])
        return pa.table({"a": ids[a], "b": ids[b], "n": n, "lack": lack})

    return run


def _verify(batches):
    for t in batches:
        rows = [(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(t["grams_a"].to_pylist(), t["grams_b"].to_pylist())]
        n = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in rows]
        yield pa.RecordBatch.from_arrays([t["a"], t["b"], pa.array(n, pa.int64()), t["size_a"], t["size_b"]], schema=_PAIRS)


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _unit(text: str) -> Column:
    """The name of a text."""
    return F.xxhash64(_col(text))


def _has_words(text: str) -> Column:
    return F.coalesce(_col(text).rlike(r"[\p{L}\p{N}_]"), F.lit(False))


def shared_sets(docs: DataFrame, n: int, threshold: float, heads: int, text: str, key: str) -> DataFrame:
    """Per text that can have a partner: its name, the size of its set, prefix length, heads, and its
    shared n-grams in global order with the orders of magnitude of their document frequencies."""
    named = docs.where(_col(key).isNotNull() & _col(text).isNotNull()).select(_unit(text).alias("id"), _col(text).alias("text"))
    # a character gives about a byte and a half of n-grams, so a bucket's size does not follow the input
    volume = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), -(-volume * 3 // (2 * BUCKET_BYTES)))
    return (
        named.mapInArrow(_send_grams(n, parts), "bucket int, ids binary, counts binary, grams binary")
        .repartitionById(parts, F.col("bucket"))
        .mapInArrow(_whole(_frequencies(parts)), "part int, ids binary, sizes binary, counts binary, grams binary, level binary")
        .repartitionById(parts, F.col("part"))
        .mapInArrow(_whole(_collect_sets(threshold, heads)), "id long, size int, prefix int, heads array<bigint>, grams binary, order binary")
    )


def _links(docs: DataFrame, n: int, threshold: float, heads: int, text: str, key: str, stars: bool) -> tuple[DataFrame, DataFrame]:
    """What the groups of heads give, pairs or stars, and the pairs without a common head; of texts."""
    sets = materialise(shared_sets(docs, n, threshold, heads, text, key), "jaccard-sets")
    parts = shuffle_partitions(docs.sparkSession)
    near = (
        sets.select("id", "size", "heads", "grams", "order", F.explode("heads").alias("head"))
        .repartition("head")
        .sortWithinPartitions("head")
        .mapInArrow(_join_groups(threshold, stars), STARS if stars else PAIRS)
    )
    met = (
        sets.mapInArrow(_send_prefixes(heads, parts), "bucket int, ids binary, sizes binary, rest binary, heads binary, counts binary, grams binary")
        .repartitionById(parts, F.col("bucket"))
        .mapInArrow(_whole(_meet(heads, threshold)), "a long, b long, n long, lack long")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n"), F.first("lack").alias("lack"))
        .where("n >= lack")
    )
    side = sets.select("id", F.col("size").cast("long").alias("size"), "grams")
    far = (
        met.join(side.toDF("a", "size_a", "grams_a"), "a")
        .join(side.toDF("b", "size_b", "grams_b"), "b")
        .select("a", "b", "size_a", "size_b", "grams_a", "grams_b")
        .mapInArrow(_verify, PAIRS)
        .where(_similarity() >= threshold - 1e-9)
    )
    return near, far


def _similarity() -> Column:
    return F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))


def text_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, first, n): the rows of each text with a word, by its name: their smallest key and number."""
    return docs.where(_col(key).isNotNull() & _has_words(text)).groupBy(_unit(text).alias("id")).agg(F.min(_col(key)).alias("first"), F.count("*").alias("n"))


def jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, heads: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All pairs of different texts whose sets of word ``n``-grams have a Jaccard similarity of at
    least ``threshold``; columns doc_a, doc_b (doc_a < doc_b), overlap, jaccard (6 decimals).

    A text stands under the smallest key of the rows that have it; rows with equal texts (similarity
    1) are no pairs here, ``text_classes`` says which they are. Words are runs of letters, digits and
    underscores, in lower case. A text of fewer than ``n`` words has one gram, all its words; a text of
    none has an empty set, and like null texts is in no pair. Rows with a null key are left out. Keys
    are of any type that has an order and should be unique: of a key with several texts each counts for
    itself, and if two of these are similar doc_a equals doc_b. Repeated rows count once. The whole
    text counts. Extra columns are left out; an empty table gives no pairs. Texts are told apart by
    64-bit hashes, as n-grams are.
    """
    near, far = _links(docs, n, threshold, heads, text, key, stars=False)
    first = text_classes(docs, text, key).select("id", "first")
    pairs = near.where(_similarity() >= threshold - 1e-9).unionByName(far)
    named = pairs.join(first.toDF("a", "first_a"), "a").join(first.toDF("b", "first_b"), "b")
    return named.select(F.least("first_a", "first_b").alias("doc_a"), F.greatest("first_a", "first_b").alias("doc_b"), "overlap", F.round(_similarity(), 6).alias("jaccard"))


def near_classes(docs: DataFrame, n: int = 3, threshold: float = 0.5, heads: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: its key, ``class_id``, ``copies`` and ``links``.

    ``links`` is the number of other texts that are similar to the row's, as in ``jaccard_join``, and
    ``copies`` that of the other rows with the same text. ``class_id`` is the smallest key that links and
    copies lead to, over any number of steps; its own where there are none. Rows whose text is null or
    has no word are alone, with 0 and 0; those with a null key too, and their class is null. Repeated
    rows are copies of each other; an empty table gives an empty one. Extra columns are left out.

    Link numbers are exact, so the work in a group of near copies of n different texts is n squared
    comparisons at most, but its result is n rows.
    """
    found = _classes(docs, text, key, n, threshold, heads)
    return found.select(F.col("key").alias(key), "class_id", "copies", "links")


def _classes(docs: DataFrame, text: str, key: str, n: int = 3, threshold: float = 0.5, heads: int = 4) -> DataFrame:
    """(key, id, class_id, copies, links) of every row; id names the text."""
    near, far = _links(docs, n, threshold, heads, text, key, stars=True)
    both = far.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("links"), F.least("a", "b").alias("root"))
    stars = materialise(near.unionByName(both), "jaccard-stars")
    links = stars.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(stars.select(F.col("id").alias("u"), F.col("root").alias("v")))
    units = text_classes(docs, text, key).join(links, "id", "left").join(found, "id", "left").where("n > 1 OR links > 0")
    units = units.withColumn("root", F.coalesce("root", "id"))
    classes = units.groupBy("root").agg(F.min("first").alias("class"))
    units = units.join(classes, "root").select("id", "class", (F.col("n") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = docs.select(_col(key).alias("key"), F.when(_col(key).isNotNull() & _has_words(text), _unit(text)).alias("id"))
    zero = F.lit(0).cast("long")
    return rows.join(units, "id", "left").select("key", "id", F.coalesce("class", "key").alias("class_id"), F.coalesce("copies", zero).alias("copies"), F.coalesce("links", zero).alias("links"))


def keep_one_of_near(docs: DataFrame, text: str = "text", key: str = "doc_id", **parameters) -> DataFrame:
    """``docs`` with one document of each class of near duplicates (``near_classes``): that with the
    smallest key. Rows that are alone, null keys and null texts among them, stay; repeated rows of a
    key that stays all stay; columns are unchanged, and an empty table stays empty."""
    k, unit = fresh(docs.columns, "key", "unit")
    drop = _classes(docs, text, key, **parameters).where("key <> class_id").select(F.col("key").alias(k), F.col("id").alias(unit)).distinct()
    return docs.join(drop, (_col(key) == F.col(k)) & (_unit(text) == F.col(unit)), "left_anti")
