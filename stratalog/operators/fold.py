"""Observations to intervals: fold, late merge, duplicate repair, delta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import depth

KEY = ["entity_path", "version"]
META = ["name", "description", "license_raw", "advisories_raw", "platforms_raw"]


def as_bounds(obs: DataFrame) -> DataFrame:
    """An observation as a one-point interval with the order keys of both ends."""
    own = F.when(F.col("source_path").isNotNull(), F.col("ord"))
    return obs.select(*KEY, *META, "source_path", F.col("commit_hash").alias("first_commit"), F.col("commit_hash").alias("last_commit"), F.col("ord").alias("first_ord"), F.col("ord").alias("last_ord"), own.alias("source_ord"))


def merge(bounds: DataFrame) -> DataFrame:
    """One row per (path, version): the earliest first end, the latest last end with its metadata, the last source path that isn't null.

    Associative and commutative, so partial sums on the map side, batches in any order and late data all give the same result.
    """
    last = F.max(F.struct("last_ord", *META, "last_commit"))  # the order keys decide, as no two observations share them
    first = F.min(F.struct("first_ord", "first_commit"))
    source = F.max(F.when(F.col("source_ord").isNotNull(), F.struct("source_ord", "source_path")))
    return unpacked(bounds.groupBy(*KEY).agg(last.alias("l"), first.alias("f"), source.alias("s")))


def merge_points(obs: DataFrame) -> DataFrame:
    """``merge`` of observations: each is both ends of its interval, so what is sorted has its order key and commit once, not for each end."""
    at = lambda end: F.col("ord").alias(f"{end}_ord")
    commit = lambda end: F.col("commit_hash").alias(f"{end}_commit")
    source = F.when(F.col("source_path").isNotNull() & F.col("ord").isNotNull(), F.struct(at("source"), "source_path"))
    return unpacked(obs.groupBy(*KEY).agg(F.max(F.struct(at("last"), *META, commit("last"))).alias("l"), F.min(F.struct(at("first"), commit("first"))).alias("f"), F.max(source).alias("s")))


def unpacked(packed: DataFrame) -> DataFrame:
    return packed.select(*KEY, *[F.col(f"l.{c}").alias(c) for c in META], "s.source_path", "f.first_commit", "l.last_commit", "f.first_ord", "l.last_ord", "s.source_ord")


def intervals(bounds: DataFrame, *more: str) -> DataFrame:
    return bounds.select(*more, *KEY, F.col("first_ord.snapshot_date").alias("first_date"), "first_commit", F.col("last_ord.snapshot_date").alias("last_date"), "last_commit", *META, "source_path", depth(F.col("entity_path")).alias("depth"))


def fold(obs: DataFrame) -> DataFrame:
    return intervals(merge_points(obs))


def merge_late(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored bounds with a batch of observations that may be older; bounds only widen."""
    return merge(stored.unionByName(as_bounds(batch)))


def dedupe(rows: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame] | DataFrame:
    """Collapse repeated (path, version) intervals: the earliest first end's row survives, the latest last end is taken. Second: figures.

    A dry run gives the figures alone, with nothing updated or deleted.
    """
    if dry_run:
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("n_rows"))
        return figures(sizes).withColumns({"rows_after": F.col("rows_before"), "rows_updated": F.lit(0).cast("bigint"), "rows_deleted": F.lit(0).cast("bigint")})
    first, last = F.struct("first_date", "channel"), F.struct("last_date", "channel")
    out = rows.groupBy(*KEY).agg(F.min("first_date").alias("first_date"), F.min_by("first_commit", first).alias("first_commit"), F.max("last_date").alias("last_date"), F.max_by("last_commit", last).alias("last_commit"), F.min_by("description", first).alias("description"), F.count("*").alias("n_rows"))
    return out, figures(out)


def figures(sizes: DataFrame) -> DataFrame:
    many = F.col("n_rows") > 1
    return sizes.agg(F.count("*").alias("n_groups"), F.count_if(many).alias("groups_with_duplicates"), F.sum("n_rows").alias("rows_before"), F.count("*").alias("rows_after"), F.count_if(many).alias("rows_updated"), (F.sum("n_rows") - F.count("*")).alias("rows_deleted"))


def apply_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Replace rows by key with the delta's, keep the others."""
    tagged = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    columns = [c for c in base.columns if c not in KEY]
    return tagged.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "_new").alias("r")).select(*KEY, "r.*")
