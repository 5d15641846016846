"""Shared helpers: reading tables, scratch tables in the cluster's shared folder, text keys."""

from __future__ import annotations

import atexit
import contextlib
import string
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables of this process that exist: path -> what it takes to delete them.
MADE: dict[str, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is set and all tasks run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    What is not deleted by ``release`` or ``scratch`` is deleted when the application's Python process ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stratalog-{uuid.uuid4().hex}"
    if not MADE:
        atexit.register(clear)
    MADE[path] = spark._jvm.org.apache.hadoop.fs.Path, path, spark._jsc.hadoopConfiguration()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def latest() -> list[str]:
    """The path of the table that was made last."""
    return list(MADE)[-1:]


def delete(path: str) -> None:
    made = MADE.pop(path)
    folder = made[0](made[1])
    folder.getFileSystem(made[2]).delete(folder, True)


def clear() -> None:
    """Delete all tables that ``materialize`` made and nobody deleted; at the end, so a closed connection is no error."""
    with contextlib.suppress(Exception):
        for path in list(MADE):
            delete(path)


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for name in {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}:
        for path in [p for p in MADE if p.endswith(f"/{name}")]:
            delete(path)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Deletes at its end the tables that were made within it, but for the paths that the caller adds to the list."""
    before, kept = set(MADE), []
    yield kept
    for path in [p for p in MADE if p not in before and p not in kept]:
        delete(path)


def small_side(df: DataFrame, n_rows: int, most: int = 500_000) -> DataFrame:
    """Broadcast ``df`` where its counted rows are at most ``most``; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if n_rows <= most else df
