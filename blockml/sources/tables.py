"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockml.operators.base import positions
from blockml.operators.dataset import Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(df: DataFrame, key: str, block_size: int | None = None, partitions: int = 1) -> Dataset:
    """A dataset over ``df`` whose row id is the rank of the unique integer ``key``."""
    return Dataset(positions(df, key, "row_id"), "row_id", block_size, partitions)


def from_rows(spark: SparkSession, rows: list, schema: str, block_size: int | None = None, partitions: int = 1) -> Dataset:
    """Local rows in their order; values go by name where rows are dicts. No rows: ValueError."""
    if not rows:
        raise ValueError("no rows")
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    plain = [tuple(r.get(n) for n in names) if isinstance(r, dict) else r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(plain)], f"row_id long, {schema}")
    return Dataset(df, "row_id", block_size, partitions)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Files of ``kind`` (parquet, orc, json, csv, text), in folders by the columns ``by``."""
    out = df.write
    if by:
        out = out.partitionBy(*by)
    out.format(kind).save(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, for corpora kept as text."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
