"""Snapshot documents, listings and published datasets as files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import fold
from ..operators.history import index_stats
from ..session import small_side
from .versions import drop_versions, latest_of, publish, read_table, table_names, versions

__all__ = ["drop_versions", "publish", "versions"]


def read_envelopes(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents ``{"version": 2, "packages": {path: entry}}``: (file, raw_path, entry) rows, and rejected files.

    A document that is malformed or of another version gives no rows at all. One document is one row, so files should be of modest size.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "version string, packages map<string,variant>, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("d"))
    good = F.col("d.bad").isNull() & (F.col("d.version") == "2") & F.col("d.packages").isNotNull()
    rows = docs.filter(good).select("file", F.explode("d.packages").alias("raw_path", "entry"))
    return rows, docs.filter(~F.coalesce(good, F.lit(False))).select("file")


def read_bare(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents ``{path: entry}`` of the older form: rows and rejected files, as above."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").alias("d"))
    return docs.filter("d is not null").select("file", F.explode("d").alias("raw_path", "entry")), docs.filter("d is null").select("file")


def read_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents of one entity per line, ``{"path": ..., "entry": ...}``, with a last line ``{"entries": number}``: rows and rejected documents, as above.

    For large snapshots: a document, a file or a folder of files, is read by many tasks. It is rejected if a line is malformed or the number differs.
    """
    v = F.try_parse_json("value")
    get = lambda p, kind: F.try_variant_get(v, p, kind)
    document = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*?[.]jsonl)(?:/.*)?$", 1)
    lines = spark.read.text(path).filter("trim(value) <> ''").select(document.alias("file"), get("$.path", "string").alias("raw_path"), get("$.entry", "variant").alias("entry"), get("$.entries", "bigint").alias("total"))
    entry = F.col("raw_path").isNotNull() & F.col("entry").isNotNull()
    sums = lines.groupBy("file").agg(F.count_if(entry).alias("n"), F.count_if(~entry & F.col("total").isNull()).alias("bad"), F.max("total").alias("total"))
    sums = sums.select("file", F.coalesce((F.col("bad") == 0) & (F.col("n") == F.col("total")), F.lit(False)).alias("whole"))
    rows = lines.filter(entry).join(small_side(sums.filter("whole")), "file", "left_semi").select("file", "raw_path", "entry")
    return rows, sums.filter("not whole").select("file")


def normalize(entries: DataFrame) -> DataFrame:
    """Clean observation columns of raw entries; an entry without a version or with an empty path is dropped."""
    at = lambda p: F.try_variant_get("entry", f"$.{p}", "variant")
    s = lambda p: E.text_of(F.col("entry"), f"$.{p}")
    parts = E.path_segments(F.col("raw_path"))
    derived = F.nullif(F.regexp_extract(s("name"), r"^(.*?)-[0-9]", 1), F.lit(""))
    name = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.coalesce(s("pname"), derived, F.element_at(parts, -1)))
    out = entries.select("file", F.array_join(parts, ".").alias("entity_path"), name.alias("name"), E.version_of(s("name"), s("version")).alias("version"), s("meta.description").alias("description"), E.homepage(at("meta.homepage")).alias("homepage"), E.licenses(at("meta.license")).alias("license"), E.maintainers(at("meta.maintainers")).alias("maintainers"), E.platforms(at("meta.platforms")).alias("platforms"), E.source_path(s("meta.position")).alias("source_path"), F.when(F.size(F.try_variant_get("entry", "$.meta.knownVulnerabilities", "array<string>")) > 0, F.try_variant_get("entry", "$.meta.knownVulnerabilities", "array<string>")).alias("advisories"))
    return out.filter("version is not null and entity_path <> ''")


def list_releases(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Names in an XML listing's common prefixes, without the listing's prefix and the last slash; nested and empty ones are left out.

    ``path`` may name many documents, one for each page of a listing.
    """
    rows = spark.read.format("xml").option("rowTag", "CommonPrefixes").schema("Prefix string").load(path)
    return under(rows.select("Prefix"), prefix).distinct()


def list_directory(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """The same from a folder that is listed: the first folder below ``path/prefix`` of each file in it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    inner = F.regexp_replace("path", r"^.*?" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    first = F.concat(F.lit(prefix), F.split(F.substring(inner, len(prefix) + 1, 10_000), "/")[0], F.lit("/"))
    return under(files.filter(F.startswith(inner, F.lit(prefix))).select(first.alias("Prefix")), prefix).distinct()


def under(rows: DataFrame, prefix: str) -> DataFrame:
    name = F.regexp_replace(F.substring("Prefix", len(prefix) + 1, 10_000), "/$", "")
    return rows.filter(F.startswith("Prefix", F.lit(prefix))).select("Prefix", name.alias("release_name")).filter("release_name <> '' and not contains(release_name, '/')")


def laid_out(intervals: DataFrame, files: int | None = None) -> DataFrame:
    """Intervals as they are stored: files of disjoint ranges of lower-case paths, sorted, so that a prefix is in few parts of few files; as many as their size asks for, or ``files``."""
    low = intervals.withColumn("path_lc", E.ascii_lower(F.col("entity_path")))
    return low.repartitionByRange(*([files] if files else []), "path_lc").sortWithinPartitions("path_lc")


#: Columns of stored intervals; those of OPTIONAL need not be there and are null then.
INTERVALS = "entity_path string, version string, first_date timestamp_ntz, first_commit string, last_date timestamp_ntz, last_commit string, name string, description string, license_raw string, depth bigint"
OPTIONAL = "advisories_raw string, platforms_raw string, source_path string, path_lc string"


def read_published(spark: SparkSession, path: str, name: str = "intervals", prefixes: DataFrame | None = None) -> DataFrame:
    """A table of the newest published version; with ``prefixes`` only files that may have a path with one of them."""
    return read_table(spark, path, name, prefixes=prefixes)


def read_intervals(spark: SparkSession, path: str, requests: DataFrame | None = None) -> DataFrame:
    """Stored intervals (with ``requests``, of files only in which a path may start with one's ``q``) with a fixed schema: optional columns that are not stored are null (``path_lc``: made), dates in epoch seconds become UTC timestamps."""
    prefixes = None if requests is None else requests.select(E.ascii_lower(F.col("q")))
    rows = read_published(spark, path, "intervals", prefixes) if "intervals" in table_names(spark, path) else of_bounds(read_published(spark, path, "bounds", prefixes))
    kinds = dict(rows.dtypes)
    for one in INTERVALS.split(", "):
        if one.split()[0] not in kinds:
            raise ValueError(f"stored intervals have no column {one.split()[0]}")
    date = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz") if kinds[c] in ("bigint", "int") else F.col(c)
    out = []
    for one in f"{INTERVALS}, {OPTIONAL}".split(", "):
        c, kind = one.split()
        out.append(E.ascii_lower(F.col("entity_path")).alias(c) if c == "path_lc" and c not in kinds else (date(c) if kind == "timestamp_ntz" else F.col(c) if c in kinds else F.lit(None)).cast(kind).alias(c))
    return rows.select(*out)


def of_bounds(bounds: DataFrame) -> DataFrame:
    """Intervals of stored bounds: the same rows without their order keys, so nothing is moved."""
    return fold.intervals(bounds, "path_lc")


def lookup(pairs: DataFrame, key: str) -> str | None:
    """The value of a key in a stored (key, value) table; null if it isn't there."""
    found = pairs.filter(F.col("key") == key).select("value").first()
    return found[0] if found else None


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """Index statistics of the newest version: as stored with it, if its marker is the manifest's and no figure is missing; else counted anew."""
    marker = latest_of(spark, path)
    if "stats" in table_names(spark, path):
        kept = read_table(spark, path, "stats")
        row = kept.first()
        if row and row.marker == marker and None not in tuple(row):
            return kept.drop("marker")
    return index_stats(read_intervals(spark, path))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated rows with a header; ``-`` for missing values, dates as yyyy-MM-dd."""
    shown = [F.coalesce(F.date_format(c, "yyyy-MM-dd") if t.startswith("timestamp") else F.col(c).cast("string"), F.lit("-")).alias(c) for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
