"""Sends this package to the Python workers of a session that was started without it."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIPPED: set[str] = set()
#: Bytes of an Arrow batch: texts have any length, so a number of rows alone doesn't bound what a Python worker holds.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def ship(spark: SparkSession) -> SparkSession:
    """Make ``stratalog`` importable on all executors, once per application; Spark's own file server carries it.

    Arrow batches are bounded by ``BATCH`` unless the application sets its own bound.
    """
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app not in SHIPPED:
        top = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "stratalog.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(path)
        SHIPPED.add(app)
    return spark


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder: where they differ, what was derived from it before no longer holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in there))


def small_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Broadcast a short dimension or request table after counting its rows; beyond ``most`` Spark joins by shuffle, with the same result."""
    return F.broadcast(df) if df.count() <= most else df


def hashed_side(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Beyond ``most`` rows, join by the hash of this side's rows: a task holds its share of them alone, where a sorted join would hold the other side's as well. For a side whose keys are unique."""
    return df.hint("shuffle_hash") if df.count() > most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one is made only where none is set and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of this process that ``stored`` made and nobody deleted: path -> what it takes to delete them.
KEPT: dict[str, tuple] = {}


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back, where several steps or lost executors would compute it anew.

    The table goes at the end of the surrounding ``scratch``, or else of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalog-{uuid.uuid4().hex}"
    if not KEPT:
        atexit.register(discard, KEPT)
    KEPT[path] = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(paths) -> None:
    """Delete tables that ``stored`` made; at the end of the process a closed connection is no error."""
    with contextlib.suppress(ConnectionError, OSError):
        for path in list(paths):
            of, conf = KEPT.pop(path)
            folder = of(path)
            folder.getFileSystem(conf).delete(folder, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the tables that were stored within it: what is computed from them must be written or collected by then."""
    before = set(KEPT)
    try:
        yield
    finally:
        discard([p for p in KEPT if p not in before])
