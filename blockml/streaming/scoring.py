"""Scoring of streams. Fitted transformers and models that work row by row are Column expressions,
so the same code runs on ``readStream`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, *steps) -> DataFrame:
    """``stream`` through transformers and, at the end, a model with ``predict``."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    for step in steps:
        stream = step.predict(stream) if hasattr(step, "predict") else step.transform(stream)
    return stream


def windowed_moments(stream: DataFrame, ts: str, value: str, by: list[str], window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Count, mean and population variance of ``value`` by window; rows later than ``lateness``
    are left out and state is dropped behind it."""
    w = F.window(ts, window)
    got = stream.withWatermark(ts, lateness).groupBy(w, *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    return got.select(F.col("window.start").alias("start"), *by, "n", "mean", "var")


def start(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends to Parquet files at ``path``."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).start()
