"""The ten operators against brute force, round trips and held-out labels; nulls, empty and very
long texts, repeated rows, empty tables and clashing column names."""

import base64
import hashlib
import random
import re
import string
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockml.llm import bpe, langid, nbsvm, quality_rules, toxicity, warc
from blockml.llm.exact_dedup import exact_dedup, possibly_repeated
from blockml.llm.jaccard_join import jaccard_join, keep_one_of_near, near_classes
from blockml.llm.packing import best_fit_decreasing, pack, plan_best_fit
from blockml.llm.sharding import brute_force, minimax_shards

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, h long, words string, maybe int, rank string, segments string, bin_id int, shard string, score string, toxicity string, count int, key string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, copies and a very long text."""
    rng = random.Random(1)
    long = words(rng, 60_000)
    rows = [
        (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (3, None, None, None, None), (4, "", "en", None, 0), (5, "", None, "s", 0),
        (None, "a b c d", "de", "s", 7), (None, None, "de", "s", 7), (6, long, "fr", "s", 1), (7, long + " tail", "fr", "s", 1),
        (8, "   \n", "en", "s", 4), (9, "é" * 3000, "es", "s", 3000), (1, "a b c d", "en", "s", 7), (10, "﻿\U0001f600 x", "en", "s", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    row = ("1", "2", 3, "4", "5", 6, "7", "8", "9", 1, "k")
    return spark.createDataFrame([(i, t, i, *row[1:2], 1, *["x"] * 2, 1, *["x"] * 3, 1, "k") for i, t in enumerate(["one two three", "one two three", None, ""])], CLASHING)


def brute_jaccard(rows, n, threshold):
    """Pairs (doc_a, doc_b, overlap) of different texts, each under its smallest key."""
    first = {}
    for key, text in rows:
        if key is not None and re.search(r"\w", text or ""):
            first[text] = min(key, first.get(text, key))
    sets = {}
    for text, key in first.items():
        w = re.findall(r"\w+", text.lower())
        sets[key] = {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and o / len(sets[a] | sets[b]) >= threshold - 1e-12:
                out.add((a, b, o))
    return out


def brute_classes(rows, n, threshold):
    """(key, class_id, copies, links) of every row."""
    pairs = brute_jaccard(rows, n, threshold)
    there = lambda r: r[0] is not None and re.search(r"\w", r[1] or "")
    first = {t: min(k for k, u in filter(there, rows) if u == t) for _, t in filter(there, rows)}
    root = {k: k for k in first.values()}
    for _ in root:
        for a, b, _ in pairs:
            root[a] = root[b] = min(root[a], root[b])
    links = {k: sum(k in p[:2] for p in pairs) for k in root}
    return sorted((r[0], root[first[r[1]]], sum(u[1] == r[1] for u in filter(there, rows)) - 1, links[first[r[1]]]) if there(r) else (r[0], r[0], 0, 0) for r in rows if r[0] is not None)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_jaccard_join_equals_brute_force(spark, threshold):
    rng = random.Random(7)
    rows, base = [], [words(rng, rng.randrange(5, 60), 60) for _ in range(12)]
    for i in range(140):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    for i in range(70):  # one group of many near copies
        w = base[0].split()
        w[i % len(w)] = f"x{i}"
        rows.append((300 + i, " ".join(w)))
    rows += [(500 + i, "ab") for i in range(4)] + [(600, None), (None, "ab"), (601, ""), (500, "ab"), (602, "Ab, ab!"), (603, "ab ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join(df, threshold=threshold).collect()
    assert {(r["doc_a"], r["doc_b"], r["overlap"]) for r in got} == brute_jaccard(rows, 3, threshold) and len(got) == len({(r[0], r[1]) for r in got})
    classes = near_classes(df, threshold=threshold).where("doc_id IS NOT NULL").collect()
    assert sorted(map(tuple, classes)) == brute_classes(rows, 3, threshold)
    if threshold != 0.5:
        return
    # keys of another type, a name with a dot
    named = spark.createDataFrame([(f"k{k:03}" if k is not None else None, t) for k, t in rows], "`doc.id` string, text string")
    found = near_classes(named, threshold=threshold, key="doc.id").collect()
    assert len(found) == len(rows) and sorted((int(r[0][1:]), int(r[1][1:]), r[2], r[3]) for r in found if r[0]) == brute_classes(rows, 3, threshold)
    assert keep_one_of_near(named, threshold=threshold, key="doc.id").where("`doc.id` IS NOT NULL").distinct().count() == len({c[1] for c in brute_classes(rows, 3, threshold)})


def test_jaccard_join_odd_input(spark, odd, empty, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {(r["doc_a"], r["doc_b"], r["overlap"]) for r in jaccard_join(odd).collect()} == brute_jaccard(rows, 3, 0.5)
    assert sorted(map(tuple, near_classes(odd).where("doc_id IS NOT NULL").collect())) == brute_classes(rows, 3, 0.5)
    assert [tuple(r) for r in near_classes(odd).where("doc_id IS NULL").collect()] == [(None, None, 0, 0)] * 2
    assert jaccard_join(empty).count() == 0 and near_classes(empty).count() == 0
    kept = keep_one_of_near(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 0, 1, 1, 3, 4, 5, 6, 8, 9, 10]
    assert sorted(r["doc_id"] for r in keep_one_of_near(clashing).collect()) == [0, 2, 3] and keep_one_of_near(clashing).columns == clashing.columns
    assert keep_one_of_near(empty).count() == 0
    # of a key with two texts each counts for itself
    twice = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (2, "a b c d"), (3, "x y z")], "doc_id long, text string")
    assert sorted(map(tuple, keep_one_of_near(twice).collect())) == [(1, "a b c d"), (2, "x y z")]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


def test_bpe_equals_the_public_encoder(spark, vocabulary, odd):
    import public_tokenizers as P
    import tiktoken

    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice(string.printable + "äéß漢字😀  ") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["don't  stop<|endoftext|>\n\n x", "x" * 1000, "ab" * 100, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for max_words in (0, 1_000_000):
        got = bpe.decode(bpe.encode(df, vocabulary, max_words=max_words), vocabulary, name="back").orderBy("doc_id").collect()
        assert [r["tokens"] for r in got] == [None if t is None else encoder.encode_ordinary(t) for t in texts]
        assert [r["back"] for r in got] == texts
    whole = bpe.encode(odd, vocabulary).collect()
    assert [r["tokens"] for r in whole] == [None if r["text"] is None else encoder.encode_ordinary(r["text"]) for r in whole]


def test_bpe_odd_input(spark, vocabulary, empty, clashing):
    assert bpe.encode(empty, vocabulary).count() == 0
    got = bpe.encode(clashing, vocabulary)
    assert set(got.columns) == {*clashing.columns, "tokens"} and got.where("segments = 'x'").count() == 4
    bad = spark.createDataFrame([([1, 10**6],), ([None],), ([],), (None,)], "tokens array<int>")
    assert [r["text"] for r in bpe.decode(bad, vocabulary).collect()] == [None, None, "", None]


def test_bpe_batches_do_not_follow_the_texts(spark, vocabulary, monkeypatch):
    # a task holds several times a batch while it writes it; with whole rows the first batch had 30 MB
    def watched(run, most=12e6):
        def watch(batches):
            def each():
                for b in batches:
                    if b.nbytes > most:
                        raise ValueError(f"{b.nbytes} bytes in a batch")
                    yield b

            return run(each())

        return watch

    count, lookup = bpe._count_words, bpe._lookup
    monkeypatch.setattr(bpe, "_count_words", watched(count))
    monkeypatch.setattr(bpe, "_lookup", lambda *args: watched(lookup(*args)))
    docs = spark.range(1000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat(' w', id % 10, ' ab'), 1666) AS text")
    got = bpe.encode(docs, vocabulary).selectExpr("doc_id", "text", "size(tokens) AS n", "tokens").where("doc_id < 20").collect()
    assert len(got) == 20
    for r in got:
        assert r["tokens"] == 1666 * bpe_ids(vocabulary, [" w", str(r["doc_id"] % 10), " ab"])


def bpe_ids(vocabulary, found):
    return [i for w in found for i in bpe.merge_bytes(w.encode(), vocabulary.ranks, vocabulary.pairs)]


def test_bpe_rows_in_pieces(spark, vocabulary, odd):
    rng = random.Random(5)
    rows = [None if k % 7 == 3 else [f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 40]))] for k in range(60)]
    pieces = [(i if at == 0 else None, at // 4, None if row is None else row[at : at + 4]) for i, row in enumerate(rows) for at in range(0, max(1, len(row or ())), 4)]
    table = pa.table([pa.array(x, kind) for x, kind in zip(zip(*pieces), (pa.int64(), pa.int32(), pa.list_(pa.string())))], names=["c0", "piece", "split"])
    for size in (1, 2, 3, 7, 50, 10_000):
        got = [r for b in bpe._whole(table.to_batches(size)) for r in b.to_pylist()]
        assert got == [{"c0": i, "split": row} for i, row in enumerate(rows)]
    assert list(bpe._whole([])) == []
    want = sorted(map(repr, bpe.encode(odd, vocabulary).collect()))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        assert sorted(map(repr, bpe.encode(odd, vocabulary).collect())) == want
    finally:
        spark.conf.set(setting, before)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 34, 5000))
    multipliers, slots = bpe.perfect_hash(keys)
    at = (keys + 1) * multipliers[keys % len(multipliers)] % bpe.PRIME % len(slots)
    assert (slots[at] == keys).all()


def test_language_id(spark, odd, empty, clashing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.train(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), profiles).where("n_chars >= 200").collect()
    assert np.mean([r["predicted"] == r["lang"] for r in got]) > 0.95
    rank = langid.Ranker(profiles, 300)
    for r in got[:20]:
        doc = langid.profile([r["text"]], 300).tolist()
        far = {name: sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(doc)) for name, p in ((n, q.tolist()) for n, q in profiles.items())}
        assert (r["predicted"], r["distance"]) == min(((n, d) for n, d in far.items()), key=lambda x: (x[1], x[0])) == rank(r["text"])
    found = {r["text"]: r["predicted"] for r in langid.identify(odd, profiles).collect()}
    assert found[None] is None and found[""] is None and found["   \n"] is None
    assert langid.identify(empty, profiles).count() == 0 and langid.train(empty) == {}
    assert langid.identify(clashing, {}).where("predicted IS NULL").count() == 4
    tie = langid.identify(odd, {"b": profiles["en"], "a": profiles["en"]}).where("predicted IS NOT NULL").collect()
    assert tie and {r["predicted"] for r in tie} == {"a"}


@pytest.fixture(scope="module")
def dotted(spark):
    """Names with dots, and those that operators use themselves."""
    rows = [(i, t, "x", 1, "en", 2, 3) for i, t in enumerate(["one two three", "one two three", None, ""])]
    return spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, __found int, lang string, `c.d.e` int, __h int")


def test_names_with_dots_and_internal_names(spark, dotted, vocabulary):
    names = dotted.columns
    assert exact_dedup(dotted).columns == names and exact_dedup(dotted).count() == 3
    assert keep_one_of_near(dotted).columns == names and keep_one_of_near(dotted).count() == 3
    assert nbsvm.reject_low_quality(dotted, {None: -1.0}).columns == names and nbsvm.reject_low_quality(dotted, {None: -1.0}).count() == 2
    assert toxicity.reject_toxic(dotted, None).columns == names and toxicity.reject_toxic(dotted, None).count() == 4
    for made, more in (
        (langid.identify(dotted, {}), ["predicted", "distance"]),
        (quality_rules.judge(dotted, quality_rules.references(dotted)), ["class_distance", "word_distance", "kept"]),
        (bpe.decode(bpe.encode(dotted, vocabulary), vocabulary, name="back"), ["tokens", "back"]),
        (minimax_shards(dotted, 2), ["shard"]),
    ):
        assert made.columns == names + more and len(made.collect()) == 4
    assert pack(dotted).count() == 2
    with pytest.raises(ValueError, match="piece"):
        pack(dotted.withColumnRenamed("doc_id", "piece"), key="piece")


def test_exact_dedup_shuffles_only_suspected_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2 if i < 10 else i}") for i in range(2000)], "doc_id long, text string")
    got = exact_dedup(docs)
    assert got.count() == 1995
    suspects = possibly_repeated(docs, "text")
    assert 5 <= suspects.count() < 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the only exchange that carries rows is that of the partial aggregate of the rows that hit the filter
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact_dedup(docs, max_filter_mb=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("megabytes", [256, 0.001, 0])
def test_exact_dedup(spark, odd, empty, clashing, megabytes):
    kept = exact_dedup(odd, max_filter_mb=megabytes).collect()
    texts = [r["text"] for r in odd.collect()]
    assert sorted(r["text"] or "" for r in kept if r["text"] is not None) == sorted(set(t for t in texts if t is not None))
    assert sum(r["text"] is None for r in kept) == 2
    assert {r["text"]: r["doc_id"] for r in kept}["a b c d"] == 1
    assert exact_dedup(empty, max_filter_mb=megabytes).count() == 0
    got = exact_dedup(clashing, max_filter_mb=megabytes)
    assert got.columns == clashing.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3]


def test_packing(spark, odd, empty, clashing):
    rng = random.Random(5)
    lengths = [rng.choice([0, 1, 3, 7, 50, 99, 100, 101, 250]) for _ in range(400)]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)] + [(None, "abc"), (3, "abc")], "doc_id long, text string")
    got = pack(df, 100, rank_span=50).collect()
    pieces = [100] * sum(n // 100 for n in lengths) + [n % 100 for n in lengths if n % 100] + [3, 3]
    assert sorted(r["length"] for r in got) == sorted(pieces)
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append((r["offset"], r["offset"] + r["length"]))
    want = best_fit_decreasing(pieces, 100)
    assert sorted(sorted(b - a for a, b in v) for v in bins.values()) == sorted(sorted(pieces[i] for i in w) for w in want)
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 100
    assert pack(empty).count() == 0 and pack(clashing).count() == 2 and plan_best_fit({}, 10) == []
    total = odd.agg(F.sum(F.octet_length("text"))).first()[0]
    assert pack(odd).agg(F.sum("length")).first()[0] == total


def test_sharding(spark, odd, empty, clashing):
    rng = random.Random(9)
    sizes = [rng.choice([0, 1, 5, 80, 300]) for _ in range(150)]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    for n in (1, 4, 7, 200):
        got = [r["shard"] for r in minimax_shards(df, n, block_rows=2, coarse=2).orderBy("doc_id").collect()]
        assert got == brute_force(sizes, n)
    shards = minimax_shards(odd, 3).collect()
    assert len({r["shard"] for r in shards if r["doc_id"] == 1}) == 1 and {r["shard"] for r in shards if r["doc_id"] is None} == {0}
    assert minimax_shards(empty, 3).count() == 0 and minimax_shards(clashing, 2).count() == 4
    with pytest.raises(ValueError):
        minimax_shards(df, 0)


def _split(spark, label, train):
    """Labelled documents to train on, and others."""
    texts, y = nbsvm.training_rows(spark, "/root/testdata/sf0.1", label, 4000)
    order = np.random.default_rng(0).permutation(len(texts))
    texts, y = [texts[i] for i in order], y[order]
    return texts[:train], y[:train], texts[train:], y[train:]


def test_quality_classifier(spark, odd, empty, clashing):
    texts, y, held, truth = _split(spark, "quality", 1000)
    model = nbsvm.fit(texts, y == 0)
    got = np.array([nbsvm.score(t, model) > 0 for t in held])
    assert (got == (truth == 0)).mean() > 0.9
    fast = nbsvm.Scorer(model)
    np.testing.assert_allclose([fast(t) for t in held[:50]], [nbsvm.score(t, model) for t in held[:50]], atol=1e-9)
    _, s = nbsvm.solve(texts, y == 0, epochs=200)
    # log-count ratios by counting
    sets = [nbsvm.grams(t) for t in texts]
    counts = [defaultdict(lambda: 1.0) for _ in (0, 1)]
    for found, label in zip(sets, y):
        for g in found & s["vocabulary"].keys():
            counts[int(label == 0)][g] += 1
    totals = [sum(c[g] for g in s["vocabulary"]) for c in counts]
    want = [np.log(counts[1][g] / totals[1] / (counts[0][g] / totals[0])) for g in s["vocabulary"]]
    np.testing.assert_allclose(s["ratio"], want, atol=1e-9)
    # the dual solution is feasible, gives the weights, and closes the gap to the primal problem
    x = np.zeros((len(texts), len(want) + 1))
    for i, (row, scale) in enumerate(zip(s["rows"], s["scale"])):
        x[i, row], x[i, -1] = s["ratio"][row] * scale, scale
    np.testing.assert_allclose((x**2).sum(axis=1), 1)
    assert (s["a"] >= 0).all() and (s["a"] <= s["cost"] + 1e-12).all()
    w = np.append(s["w"], s["b"])
    np.testing.assert_allclose(x.T @ (s["a"] * s["y"]), w, atol=1e-8)
    primal = w @ w / 2 + (s["cost"] * np.maximum(0, 1 - s["y"] * (x @ w))).sum()
    dual = s["a"].sum() - w @ w / 2
    assert 0 <= primal - dual <= 1e-2 * primal
    rows = {r["doc_id"]: r["score"] for r in nbsvm.with_score(odd, model).collect()}
    assert rows[3] is None and rows[4] == model[None]
    assert {3, 4, 5, 8}.isdisjoint(r["doc_id"] for r in nbsvm.reject_low_quality(odd, {None: -1.0}).collect())
    assert nbsvm.reject_low_quality(empty, model).count() == 0
    assert nbsvm.reject_low_quality(clashing, {None: -1.0}).columns == clashing.columns


def test_classifiers_without_labels(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for rows in ([], [(1, 1, 0), (2, 1, 0), (None, 0, 1), (3, None, None)]):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        assert nbsvm.fit_on_labels(spark, str(tmp_path)) == {None: -1.0} and toxicity.fit_on_labels(spark, str(tmp_path)) is None


def test_toxicity_gradients():
    """The joint gradient of embeddings and softmax against differences."""
    rng = np.random.default_rng(0)
    E, S, c = rng.normal(size=(12, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    row, idx = np.repeat(np.arange(5), 4), rng.integers(0, 10, 20)
    share, marks, weight = rng.random(20), np.array([0.0, 1, 1, 0, 1]), rng.random(5) + 0.5

    def loss():
        z = np.stack([(E[idx[row == r]] * share[row == r, None]).sum(0) for r in range(5)]) @ S + c
        return (weight * (np.log(np.exp(z).sum(1)) - z[np.arange(5), marks.astype(int)])).mean()

    used, gE, gS, gc = toxicity.gradients(E, S, c, idx, share, row, marks, weight)
    whole = np.zeros_like(E)
    whole[used] = gE
    for x, g in ((E, whole), (S, gS), (c, gc)):
        for at in np.ndindex(x.shape):
            old = x[at]
            x[at] = old + 1e-5
            up = loss()
            x[at] = old - 1e-5
            down = loss()
            x[at] = old
            np.testing.assert_allclose(g[at], (up - down) / 2e-5, atol=1e-7)


def test_toxicity_scores_equal_brute_force():
    rng = random.Random(4)
    model = {"gain": np.random.default_rng(1).normal(size=256), "bias": -0.1, "window": 10, "buckets": 256, "floor": 40}
    texts = ["", "a", "same same same", *(words(rng, n) for n in (5, 14, 15, 40, 200))]

    def brute(text):
        said = re.findall(r"\w+", text.lower())
        said = [w for i, w in enumerate(said) if not i or said[i - 1] != w]
        if not said:
            return float("-inf")
        best = []
        for i, j in toxicity.windows(len(said), 10):
            bags = [toxicity.subwords([w], 256)[0] for w in said[i:j]]
            best.append(sum(model["gain"][b].sum() for b in bags) / max(40, sum(map(len, bags))))
        return max(best) - 0.1

    np.testing.assert_allclose(toxicity.Scorer(model)(texts), [brute(t) for t in texts])
    spans = toxicity.windows(200, 10)
    assert spans[0][0] == 0 and spans[-1][1] == 200 and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))


def test_toxicity_memory_does_not_follow_the_words():
    rng = random.Random(0)
    long = "".join(rng.choices(string.ascii_lowercase, k=1_000_000))
    fresh = " ".join("".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(100_000))
    gain = np.random.default_rng(0).normal(size=4096).astype(np.float32)
    model = {"gain": gain, "bias": 0.5, "window": 60, "buckets": 4096, "floor": 400}
    for text in (long, fresh):
        tracemalloc.start()
        (got,) = toxicity.Scorer(model)([text])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1e8  # n-grams of all characters at once: some 200 bytes each
        words = text.split()
        flat, width = toxicity.subwords(words, 4096)
        sums = np.bincount(np.repeat(np.arange(len(words)), width), gain[flat], len(words))
        want = max(sums[i:j].sum() / max(400, width[i:j].sum()) for i, j in toxicity.windows(len(words), 60)) + 0.5
        assert got == pytest.approx(want, abs=1e-9)


def test_toxicity(spark, odd, empty, clashing):
    texts, y, held, truth = _split(spark, "toxic", 3000)
    model = toxicity.fit(texts, y == 1)
    scorer = toxicity.Scorer(model)
    got = np.array(scorer(held)) > 0
    assert got[truth == 1].mean() > 0.7 and got[truth == 0].mean() < 0.02
    kept = toxicity.reject_toxic(odd, model).collect()
    assert {3, 4, 5, 8} <= {r["doc_id"] for r in kept}
    rows = {r["doc_id"]: r["toxicity"] for r in toxicity.with_toxicity(odd, model).collect()}
    assert rows[3] is None and rows[4] == float("-inf")
    assert toxicity.reject_toxic(empty, model).count() == 0
    assert toxicity.reject_toxic(clashing, None).count() == 4


def test_quality_rules(spark, odd, empty, clashing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    refs = quality_rules.references(docs)
    judged = quality_rules.judge(docs, refs).collect()
    assert np.mean([r["kept"] for r in judged]) > 0.6
    assert quality_rules.jensen_shannon(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1)
    assert quality_rules.jensen_shannon(np.array([2, 2]), np.array([5, 5])) == 0
    got = quality_rules.judge(odd, refs).collect()
    assert all(r["kept"] for r in got if not r["text"]) and quality_rules.judge(empty, refs).count() == 0
    assert next(r for r in got if r["doc_id"] == 9)["class_distance"] is not None
    assert quality_rules.judge(clashing, {}, lang="words").where("kept").count() == 4
    assert quality_rules.references(empty) == {}


def test_warc_round_trip(spark):
    rng = random.Random(2)
    pages = [(1, "http://a/", "<p>é</p>"), (2, " odd\nurl ", ""), (3, None, None), (None, "u", "\r\n\r\nWARC/1.0"), (1, "http://a/", "<p>é</p>"), (4, "v", "".join(rng.choices(string.printable, k=3_000_000)))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.warc_round_trip(df).collect()
    assert sorted(map(str, ((r["page_id"], r["url"], r["html"]) for r in got))) == sorted(map(str, pages))
    assert all(r["status"] == "ok" for r in got)
    assert all(r["html"] is None or r["sha1"] == hashlib.sha1(r["html"].encode()).hexdigest() for r in got)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_damage(spark, tmp_path):
    good = warc.record(1, "u", "text", "d")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(good + warc.record(2, "u", "text", "d")[:-9])
    got = warc.read_warc(spark, [f"file://{path}"]).collect()
    assert [r["status"] for r in got] == ["ok", "corrupt"]
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4\r\nWARC-Block-Digest: sha1:AAAA\r\n\r\n"
    assert warc.parse(head + b"text\r\n\r\n")["status"] == "bad_digest"
    assert warc.parse(head + b"tex\r\n\r\n")["status"] == "bad_length"
    assert warc.parse(b"HTTP\r\n\r\n")["status"] == "bad_header"
    # after damage, reading goes on at the next gzip header
    flipped = bytearray(warc.record(2, "u", "text " * 50, "d"))
    flipped[40] ^= 0xFF
    path.write_bytes(good + bytes(flipped) + b"no gzip at all" + warc.record(3, "u", "third", "d") + good[:20] + warc.record(4, "u", "fourth", "d"))
    got = [(r["page_id"], r["status"]) for r in warc.read_warc(spark, [f"file://{path}"]).collect()]
    assert [g for g in got if g[1] == "ok"] == [(1, "ok"), (3, "ok"), (4, "ok")] and {g[1] for g in got} == {"ok", "corrupt"}
    path.write_bytes(b"plain text" * 10)
    assert [r["status"] for r in warc.read_warc(spark, [f"file://{path}"]).collect()] == ["corrupt"]


@pytest.mark.parametrize("lines", ["X: \xff", "WARC-Record-ID: <urn:page:abc>", "X-Target-URI: {no json", "X-Target-URI: 3", "WARC-Record-ID: <urn:page:99999999999999999999>", "Content-Length: \xb2"])
def test_warc_headers_that_cannot_be_read(lines):
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4\r\n{lines}\r\n\r\n".encode("latin-1" if "\xff" in lines else "utf-8")
    assert warc.parse(head + b"text\r\n\r\n") == {"status": "bad_header"}
    foreign = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nContent-Length: 4\r\n\r\ntext\r\n\r\n"
    got = warc.parse(foreign)
    assert (got["page_id"], got["html"], got["status"]) == (None, "text", "no_digest")


@pytest.mark.parametrize("algorithm", ["sha1", "SHA1", "Sha-1", "sha256", "sha-512", "md5", "sha3-256", "blake2b"])
def test_warc_digests(algorithm):
    name = {"sha-1": "sha1", "sha-512": "sha512", "sha3-256": "sha3_256"}.get(algorithm.lower(), algorithm.lower())
    read = lambda value: warc.parse(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\nWARC-Block-Digest: {algorithm}:{value}\r\n\r\ntext\r\n\r\n".encode())
    right, wrong = (hashlib.new(name, b).digest() for b in (b"text", b"tex!"))
    for written in (bytes.hex, lambda d: d.hex().upper(), lambda d: base64.b32encode(d).decode(), lambda d: base64.b32encode(d).decode().rstrip("=").lower(), lambda d: base64.b64encode(d).decode()):
        assert (read(written(right))["status"], read(written(right))["html"]) == ("ok", "text")
        assert read(written(wrong))["status"] == "bad_digest" and "html" not in read(written(wrong))


@pytest.mark.parametrize("digest", ["crc32:1234", "AAAA", "shake_128:00"])
def test_warc_unknown_digest(digest):
    got = warc.parse(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\nWARC-Block-Digest: {digest}\r\n\r\ntext\r\n\r\n".encode())
    assert (got["status"], got["html"]) == ("unknown_digest", "text")
