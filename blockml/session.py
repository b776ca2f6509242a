"""Session helpers: code shipping, the shared folder, names that do not clash."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Spark's file server sends the archive, so the package need not be installed on the
    executors; the archive itself is only ever read on the driver.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="blockml-code-")) / "blockml-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local master may do without that setting: it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="blockml-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_FOLDERS: set[str] = set()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/blockml-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation. The write's own shuffle files go when it ends."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that do not occur in ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        new, k = f"__{name}", 0
        while new.lower() in taken:
            k += 1
            new = f"__{name}_{k}"
        taken.add(new.lower())
        out.append(new)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def default_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)

