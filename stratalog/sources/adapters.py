"""The given star-schema tables as observations, intervals, ledger and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hashed_side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The month from which snapshots stand for the newer form.
ENVELOPES = "1996-01-01"


#: Observations that one task folds, where there are more than the session's shuffle partitions take.
DEAL_ROWS = 250_000


def dealt(rows: DataFrame, n_rows: int, *by: str) -> DataFrame:
    """``rows`` moved to the task of their key, in as many parts as the rows ask for: what is grouped by the key afterwards is not moved again.

    Into more parts than ``spark.shuffle.sort.bypassMergeThreshold`` a task can't write its rows as they come, but holds all of them until its end, however many it reads; so there are no more than that.
    """
    context = rows.sparkSession.sparkContext
    usual, most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(context.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    parts = -(-n_rows // DEAL_ROWS)
    if parts <= usual <= most:
        return rows.repartition(*by)
    return rows.repartition(max(1, min(max(parts, context.defaultParallelism), most)), *by)


def observations(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    """One row per line item: a dotted path seen at a version in a channel's monthly snapshot; ``ord`` is a total order.

    With ``by_key`` the rows of a path and version lie together, moved as the few columns that they are made of: a fold then sorts a bounded number of them a task and moves none.
    A long part table is joined by its hash, so line items are not sorted to meet it.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_linestatus")
    rows = items.join(hashed_side(part), F.col("l_partkey") == F.col("p_partkey"))
    name, kind = F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(F.lower("p_type"), F.lit("Packages."))
    path = F.when(F.col("l_partkey") % 3 == 0, name).when(F.col("l_partkey") % 3 == 1, F.concat(kind, name)).otherwise(F.concat(kind, F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("."), name))
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    rows = rows.select("*", path.alias("entity_path"), F.concat_ws(".", F.col("p_size") % 4, F.col("l_suppkey") % 7, "l_linenumber").alias("version"))
    if by_key:
        rows = dealt(rows, items.count(), "entity_path", "version")
    rows = rows.select("*", F.col("l_linestatus").alias("channel"), month.alias("snapshot_date"))
    quarter, third = F.col("l_partkey") % 4, F.col("p_size") % 3
    return rows.select(
        "entity_path", "version", "channel", "snapshot_date", F.when(F.col("snapshot_date") < F.lit(ENVELOPES).cast("timestamp_ntz"), "bare").otherwise("envelope").alias("era"),
        F.md5(F.concat("channel", F.lit("|"), F.date_format("snapshot_date", "yyyy-MM"))).alias("commit_hash"),
        F.element_at(F.split("entity_path", r"\."), -1).alias("name"),
        F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("description"),
        F.when(quarter == 0, '{"spdxId":"MIT"}').when(quarter == 1, '["BSD",{"shortName":"mpl"}]').when(quarter == 2, '"Apache-2.0"').otherwise("[]").alias("license_raw"),
        F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit('["ADV-'), F.col("l_suppkey").cast("string"), F.lit('"]'))).otherwise("[]").alias("advisories_raw"),
        F.when(third == 0, '["x86_64-linux"]').when(third == 1, '["x86_64-linux","aarch64-darwin"]').alias("platforms_raw"),
        F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("pkgs/"), "entity_path")).alias("source_path"),
        F.struct("snapshot_date", "channel", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").alias("ord"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per channel and month of the observations; status and attempts follow from the month's number."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("channel"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("release_date")).distinct()
    n = F.year("release_date") * 12 + F.month("release_date")
    status = F.when(n % 11 == 0, "pending").when(n % 13 == 0, "failed").when(n % 17 == 0, "skipped").otherwise("ingested")
    return seen.select("channel", F.concat("channel", F.lit("-"), F.date_format("release_date", "yyyy-MM")).alias("release_name"), "release_date", status.alias("status"), F.when(status == "failed", n % 6).otherwise(0).cast("int").alias("attempts"), (F.col("release_date") + F.expr("interval 1 hour")).alias("last_attempt_at"))


OBS = """
j AS (SELECT *, CASE l_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN lower(p_type) || 'Packages.' || replace(p_name, ' ', '-')
    ELSE lower(p_type) || 'Packages.' || replace(p_brand, '#', '_') || '.' || replace(p_name, ' ', '-') END AS entity_path,
    concat_ws('.', p_size % 4, l_suppkey % 7, l_linenumber) AS version, l_linestatus AS channel, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS snapshot_date
  FROM lineitem JOIN part ON l_partkey = p_partkey),
obs AS (SELECT entity_path, version, channel, snapshot_date, md5(channel || '|' || strftime(snapshot_date, '%Y-%m')) AS commit_hash, string_split(entity_path, '.')[-1] AS name, CASE WHEN snapshot_date < TIMESTAMP '1996-01-01' THEN 'bare' ELSE 'envelope' END AS era,
    p_name || ' ' || lower(p_type) AS description,
    CASE l_partkey % 4 WHEN 0 THEN '{"spdxId":"MIT"}' WHEN 1 THEN '["BSD",{"shortName":"mpl"}]' WHEN 2 THEN '"Apache-2.0"' ELSE '[]' END AS license_raw,
    CASE WHEN l_suppkey % 10 = 0 THEN '["ADV-' || l_suppkey || '"]' ELSE '[]' END AS advisories_raw,
    CASE p_size % 3 WHEN 0 THEN '["x86_64-linux"]' WHEN 1 THEN '["x86_64-linux","aarch64-darwin"]' END AS platforms_raw,
    CASE WHEN l_orderkey % 3 <> 0 THEN 'pkgs/' || entity_path END AS source_path,
    row(snapshot_date, channel, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS ord FROM j)"""
INT = OBS + """,
iv AS (SELECT entity_path, version, min(snapshot_date) AS first_date, arg_min(commit_hash, ord) AS first_commit, max(snapshot_date) AS last_date, arg_max(commit_hash, ord) AS last_commit,
    arg_max(name, ord) AS name, arg_max(description, ord) AS description, arg_max(license_raw, ord) AS license_raw, arg_max(advisories_raw, ord) AS advisories_raw,
    arg_max(coalesce(platforms_raw, '~'), ord) AS platforms_raw, arg_max(source_path, ord) FILTER (source_path IS NOT NULL) AS source_path,
    length(entity_path) - length(replace(entity_path, '.', '')) AS depth, max(CASE WHEN advisories_raw IN ('', '[]', 'null') THEN 0 ELSE 1 END) AS dummy
  FROM obs GROUP BY entity_path, version)"""
LEDGER = """
m AS (SELECT DISTINCT l_linestatus AS channel, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS release_date FROM lineitem),
n AS (SELECT *, year(release_date) * 12 + month(release_date) AS n FROM m),
ledger AS (SELECT channel, channel || '-' || strftime(release_date, '%Y-%m') AS release_name, release_date,
    CASE WHEN n % 11 = 0 THEN 'pending' WHEN n % 13 = 0 THEN 'failed' WHEN n % 17 = 0 THEN 'skipped' ELSE 'ingested' END AS status,
    CASE WHEN n % 11 <> 0 AND n % 13 = 0 THEN CAST(n % 6 AS INT) ELSE 0 END AS attempts, release_date + INTERVAL 1 HOUR AS last_attempt_at FROM n)"""
