"""Which paths each snapshot has, stored by snapshot: a new one is compared with its neighbours by reading theirs alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import gate
from ..session import stored

KEY = [*gate.SNAPSHOT, "release_name"]
#: Partitions: a snapshot's folder is named by these.
FOLDER = ["channel", "era", "day", "release_name"]
ROWS = "entity_path string, channel string, era string, day string, release_name string"


def day_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HHmmss.SSSSSS")


def put(obs: DataFrame, path: str) -> None:
    """Write the paths of the snapshots in ``obs``, each into a folder of its own, in place of what that had."""
    rows = obs.select("entity_path", "channel", "era", day_of(F.col("snapshot_date")).alias("day"), "release_name").distinct()
    rows.repartition(*FOLDER, F.pmod(F.xxhash64("entity_path"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDER).parquet(path)


def read(spark: SparkSession, path: str, snapshots: DataFrame) -> DataFrame:
    """``entity_path`` and the snapshot's columns of these snapshots; the folders of others are not read."""
    wanted = stored(snapshots.select("channel", "era", "snapshot_date", "release_name", day_of(F.col("snapshot_date")).alias("day")).distinct())
    asked = wanted.select("channel", "day").collect()  # a row for each snapshot of a run and its neighbours
    rows = spark.read.schema(ROWS).parquet(path).filter(F.col("channel").isin({r.channel for r in asked}) & F.col("day").isin({r.day for r in asked}))
    return rows.join(F.broadcast(wanted), FOLDER).select("entity_path", *KEY)


def neighbours(accepted: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all ``accepted`` snapshots, those that ``new`` ones have changed the comparison of (themselves and the next of their channel), and these with the ones before them."""
    turn = W.partitionBy("channel").orderBy("snapshot_date", "release_name")
    marked = accepted.select(*KEY).distinct().join(new.select(*KEY, F.lit(True).alias("_new")).distinct(), KEY, "left")
    marked = marked.withColumn("_due", F.coalesce("_new", F.lit(False)) | F.coalesce(F.lag("_new").over(turn), F.lit(False)))
    marked = stored(marked.withColumn("_needed", F.col("_due") | F.coalesce(F.lead("_due").over(turn), F.lit(False))))
    return marked.filter("_due").select(*KEY), marked.filter("_needed").select(*KEY)


def turnover(spark: SparkSession, path: str, accepted: DataFrame, new: DataFrame) -> DataFrame:
    """``gate.births_deaths`` of the snapshots whose comparison changes by ``new`` ones; only these, the next ones and those before them are read."""
    due, needed = neighbours(accepted, new)
    return gate.births_deaths(read(spark, path, needed)).join(F.broadcast(due), KEY, "left_semi")
