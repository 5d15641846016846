"""Queries that write what others read and read it back: listings, folders, result files, kept stream values; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import history, ledger
from ..sources import adapters, snapshots
from ..sources.adapters import INT, LEDGER, table
from ..streaming import jobs
from . import ingest
from .ingest import LISTED, folder, listed
from .searches import iv


def listing_pages(spark, d):
    """Orders as pages of an XML listing: a fifth are nested folders, and a seventh lies under another prefix."""
    place = F.when(F.col("key") % 7 == 3, "other/").otherwise("some/")
    inner = F.when(F.col("key") % 5 == 0, "/deep/").otherwise("/")
    path = folder(spark, "listing")
    listed(spark, d).select(F.concat(place, "release_name", inner).alias("Prefix")).repartition(8).write.format("xml").option("rootTag", "List").option("rowTag", "CommonPrefixes").save(path)
    return snapshots.list_releases(spark, path, "some/").select("release_name")


def listing_folders(spark, d):
    """The ledger's releases as folders of files, found by listing them."""
    path = folder(spark, "releases")
    adapters.ledger(spark, d).select("release_name", "channel", "status").write.partitionBy("release_name").json(path)
    return snapshots.list_directory(spark, path, "release_name=").select("release_name")


def written_tsv(spark, d):
    """All intervals as tab-separated files, read as plain text columns."""
    path, columns = folder(spark, "tsv"), ["entity_path", "version", "first_date", "last_date", "source_path", "depth"]
    snapshots.write_tsv(iv(spark, d).select(*columns), path)
    return spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{c} string" for c in columns))


def written_json(spark, d):
    """All intervals as lines of JSON, whose arrays are arrays to a reader."""
    path = folder(spark, "json")
    snapshots.write_json(iv(spark, d).select("entity_path", "version", *[E.decode_array(F.col(f"{c}_raw")).alias(c) for c in ("platforms", "advisories")]), path)
    back = spark.read.schema("entity_path string, version string, platforms array<string>, advisories array<string>").json(path)
    return back.select("entity_path", "version", E.shown(F.col("platforms")).alias("platforms"), F.coalesce(F.size("advisories"), F.lit(0)).cast("bigint").alias("n_advisories"))


def written_report(spark, d):
    """The index run's report as a file."""
    path, report = folder(spark, "report"), ingest.index_report(spark, d)
    snapshots.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


def fallback_history(spark, d):
    """For each release, what its day knew: the channel's newest ingested one, its age, and whether the fallback was due."""
    return ledger.lag_history(adapters.ledger(spark, d)).select("channel", "release_name", "newest", "lag_hours", "fallback_due")


def stream_latency(spark, d):
    """Percentiles of the last values of each event type, kept from a stream of files in no order."""
    rows = table(spark, d, "events").select("event_type", "value", "ts")
    path, store = folder(spark, "values"), folder(spark, "recent")
    rows.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    jobs.keep_last_values(stream, store, folder(spark, "checkpoint"), buckets=4).awaitTermination()
    return history.latency_percentiles(snapshots.read_published(spark, store, "recent").withColumnRenamed("key", "event_type"), "event_type", "value", "at")


QUERIES = (listing_pages, listing_folders, written_tsv, written_json, written_report, fallback_history, stream_latency)

ORACLE = {
    "listing_pages": f"WITH {LISTED} SELECT DISTINCT release_name FROM l WHERE o_orderkey % 7 <> 3 AND o_orderkey % 5 <> 0",
    "listing_folders": f"WITH {LEDGER} SELECT DISTINCT release_name FROM ledger",
    "written_tsv": f"WITH {INT} SELECT entity_path, version, strftime(first_date, '%Y-%m-%d') AS first_date, strftime(last_date, '%Y-%m-%d') AS last_date, coalesce(source_path, '-') AS source_path, CAST(depth AS VARCHAR) AS depth FROM iv",
    "written_json": f"WITH {INT} SELECT entity_path, version, CASE WHEN platforms_raw = '~' THEN '-' ELSE array_to_string(CAST(platforms_raw AS JSON)::VARCHAR[], ', ') END AS platforms, json_array_length(advisories_raw)::BIGINT AS n_advisories FROM iv",
    "written_report": ingest.ORACLE["index_report"],
    "fallback_history": f"WITH {LEDGER}, t AS (SELECT channel, release_name, release_date, max(release_date) FILTER (status = 'ingested') OVER (PARTITION BY channel ORDER BY release_date) AS newest FROM ledger) SELECT channel, release_name, newest, date_diff('hour', newest, release_date) AS lag_hours, coalesce(date_diff('hour', newest, release_date) >= 24, true) AS fallback_due FROM t",
    "stream_latency": "WITH a AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS k FROM events WHERE value IS NOT NULL AND ts IS NOT NULL), r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM a WHERE k <= 1024) SELECT event_type, max(n) AS n, max(value) FILTER (i = round((n - 1) * 0.5)) AS p50, max(value) FILTER (i = round((n - 1) * 0.95)) AS p95, max(value) FILTER (i = round((n - 1) * 0.99)) AS p99 FROM r GROUP BY event_type",
}
