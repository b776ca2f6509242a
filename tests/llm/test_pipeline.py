"""Stages of the pipeline, and the queries of the subpackage against their SQL."""

import glob
import os
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from blockml.llm import nbsvm, queries, toxicity
from blockml.llm.packing import best_fit_decreasing
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    assert docs.select("text").distinct().count() == counts[-1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_stages_on_odd_input(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "some text here", "en", "s", 14), (1, "some text here", "en", "s", 14), (2, None, None, None, None), (3, "", "en", None, 0), (None, "some text here", "de", "s", 14), (None, None, None, None, None), (4, "word " * 30_000, "fr", "s", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
        docs = docs.cache()
        left = docs.count()
        assert left <= 3
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == left


def test_pipeline_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    quality, toxic = nbsvm.fit_on_labels(spark, SF), toxicity.fit_on_labels(spark, SF)
    rows = [(k, t) for k, t in rows if t and t.strip() and nbsvm.score(t, quality) <= 0]
    if toxic:
        scores = toxicity.Scorer(toxic)([t for _, t in rows])
        rows = [r for r, v in zip(rows, scores) if v <= 0]
    once = {}
    for k, t in rows:
        once.setdefault(t, k)
    rows = sorted((k, t) for t, k in once.items())
    classes = brute_classes(rows, 3, 0.5)
    rows = [(k, t) for (k, t), c in zip(rows, classes) if c[1] == k]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in rows}
    pieces = []
    for _, t in rows:
        n = len(t.encode())
        pieces += [8192] * (n // 8192) + [n % 8192] * (n % 8192 > 0)
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r["length"])
    want = [[pieces[i] for i in b] for b in best_fit_decreasing(pieces, 8192)]
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, want))


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=key)
    want = sorted(con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=key)
    assert got == want
