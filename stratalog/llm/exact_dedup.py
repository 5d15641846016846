"""Exact duplicates: groups by a 128-bit content hash, with the texts compared inside each group of several rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_side

#: Rules for the row that stays: the smallest or the largest id.
KEEPERS = {"smallest": F.min, "largest": F.max}


def normalized(text: Column) -> Column:
    """Null counts as empty; A-Z are lower-cased, nothing else changes."""
    return F.coalesce(ascii_lower(text), F.lit(""))


def keys_of(text: Column) -> list[Column]:
    norm = normalized(text)
    return [F.md5(norm).alias("own"), F.sha2(norm, 256).alias("own_sha")]


def repeated_texts(rows: DataFrame, keyed: DataFrame, keep: str) -> DataFrame:
    """``digest, sha, keep_id, group_size`` of the groups whose MD5 several rows have, from rows (doc_id, text) and their keys.

    Only the texts of such rows are sent, as a grouping key beside their MD5, so equal hashes of unlike texts make two
    groups; each task sends one row per text that it has, whatever the number of copies.
    """
    many = materialize(keyed.groupBy("own").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("own").alias("digest")))
    norm = normalized(F.col("text"))
    texts = rows.select("doc_id", norm.alias("norm"), F.md5(norm).alias("digest")).join(small_side(many, many.count()), "digest", "left_semi")
    groups = texts.groupBy("digest", "norm").agg(KEEPERS[keep]("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return materialize(groups.select("digest", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``; other columns, whatever their names, are ignored.

    Texts of any length are read whole and are equal when identical after lower-casing A-Z; a null text counts as empty. The row
    with the smallest (or largest) id of a group stays. Repeated rows with that id are all marked kept. A null id never
    wins against another; in a group without ids ``keep_id`` is null and its rows are kept. An empty table
    gives an empty result. A row whose MD5 no other row has needs no group and is not shuffled where the groups can be broadcast.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = materialize(rows.select("doc_id", *keys_of(F.col("text"))))
    groups = repeated_texts(rows, keyed, keep)
    found = keyed.join(small_side(groups, groups.count()), (F.col("own") == F.col("digest")) & (F.col("own_sha") == F.col("sha")), "left")
    alone = F.col("digest").isNull()
    found = found.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("own_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each group of equal texts, as in ``exact_duplicates``.

    Of rows that repeat the id which stays, one is kept, whichever comes first; only such rows are shuffled with all their columns.
    Columns may have any names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = materialize(rows.select("doc_id", *keys_of(F.col("text"))))
    groups = repeated_texts(rows, keyed, keep)
    groups = small_side(groups.drop("group_size"), groups.count())
    same = (F.col("own") == F.col("digest")) & (F.col("own_sha") == F.col("sha"))
    twice = keyed.groupBy("own", "own_sha", "doc_id").agg(F.count("*").alias("n")).filter("n > 1").join(groups, same & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    twice = materialize(twice.select(F.col("own").alias("twice"), F.col("own_sha").alias("twice_sha")))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), *keys_of(F.col(text_col)))
    kept = whole.join(groups, same, "left").filter(F.col("digest").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("row", "own", "own_sha")
    n = twice.count()
    if not n:
        return kept.select("row.*")
    repeats, is_repeat = small_side(twice, n), (F.col("own") == F.col("twice")) & (F.col("own_sha") == F.col("twice_sha"))
    one_each = kept.join(repeats, is_repeat, "left_semi").dropDuplicates(["own", "own_sha"])
    return kept.join(repeats, is_repeat, "left_anti").unionAll(one_each).select("row.*")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
