"""Version histories, statistics and reports over intervals and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import exprs as E
from ..session import small_side, stored


def version_history(rows: DataFrame) -> DataFrame:
    """Per path and version its span, and whether that version string is insecure in any path at all."""
    bad = stored(rows.filter(E.insecure(F.col("advisories_raw"))).select("version").distinct().withColumn("bad", F.lit(True)))
    spans = rows.groupBy("entity_path", "version").agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    return spans.join(small_side(bad), "version", "left").select("entity_path", "version", "first_date", "last_date", F.coalesce("bad", F.lit(False)).alias("insecure"))


def first_last(rows: DataFrame) -> DataFrame:
    """The first and the last version of each path: by date, then by version text."""
    ends = lambda d: F.struct(d, "version")
    out = rows.groupBy("entity_path").agg(F.min(ends("first_date")).alias("a"), F.max(ends("last_date")).alias("b"))
    return out.select("entity_path", F.col("a.version").alias("first_version"), F.col("a.first_date").alias("first_date"), F.col("b.version").alias("last_version"), F.col("b.last_date").alias("last_date"))


def index_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("name").alias("n_names"), F.count_distinct("version").alias("n_versions"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def timeline_extent(rows: DataFrame) -> DataFrame:
    """Span of each path in days, at least 90, with a margin of 4% or 14 days, whichever is more."""
    days = F.greatest(F.datediff("b", "a"), F.lit(90)).cast("bigint")
    out = rows.groupBy("entity_path").agg(F.min("first_date").alias("a"), F.max("last_date").alias("b")).select("entity_path", F.col("a").alias("first_date"), F.col("b").alias("last_date"), days.alias("days"))
    return out.withColumn("margin_days", F.greatest(F.lit(14.0), F.col("days") * 0.04))


def platforms_by_os(rows: DataFrame) -> DataFrame:
    """Per path, its platforms by operating system, sorted."""
    p = rows.select("entity_path", F.explode(E.decode_array(F.col("platforms_raw"))).alias("platform")).distinct()
    system = F.when(F.contains("platform", F.lit("linux")), "linux").when(F.contains("platform", F.lit("darwin")), "darwin").otherwise("other")
    return p.groupBy("entity_path", system.alias("os")).agg(F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"))


def last_values(events: DataFrame, key: str, value: str, ts: str, last: int = 1024, parts: int = 64) -> DataFrame:
    """The ``last`` newest values of each key, of one moment the greatest.

    A key's rows are dealt over ``parts`` tasks, each of which keeps its last ones; only those meet in one task.
    """
    newest = [F.col(ts).desc(), F.col(value).desc()]
    part = F.pmod(F.xxhash64(ts, value), F.lit(parts))
    recent = events.select(key, value, ts, part.alias("_part")).withColumn("_n", F.row_number().over(W.partitionBy(key, "_part").orderBy(*newest))).filter(F.col("_n") <= last)
    recent = recent.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*newest))).filter(F.col("_n") <= last)
    return recent.drop("_part", "_n")


def latency_percentiles(events: DataFrame, key: str, value: str, ts: str, last: int = 1024, parts: int = 64) -> DataFrame:
    """Nearest-rank p50, p95 and p99 of each key's last ``last`` values (``last_values``): the value at round((n - 1) * q), from 0."""
    r = last_values(events, key, value, ts, last, parts).select(key, value, (F.row_number().over(W.partitionBy(key).orderBy(value)) - 1).alias("i"), F.count("*").over(W.partitionBy(key)).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.round((F.col("n") - 1) * q), F.col(value)))
    return r.groupBy(key).agg(F.max("n").alias("n"), *[at(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])


def latency_sketches(events: DataFrame, key: str, value: str, ts: str, k: int = 200) -> DataFrame:
    """``key, minute, n, sketch``: a mergeable sketch of the values of each key and minute, whose size doesn't depend on their number."""
    minute = F.date_trunc("minute", ts).cast("timestamp_ntz").alias("minute")
    return events.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), minute).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_percentiles(sketches: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Approximate percentiles over any window of ``latency_sketches``, from the merged sketches alone; ranks are within about 1.7 % (99 % of cases, ``k`` 200)."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(f"p{int(q * 100)}") for q in quantiles])


def key_counts(rows: DataFrame) -> DataFrame:
    """``kind, key, n``: in how many rows each name and each version stands. Such counts add up, so distinct numbers follow from what changes."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in ("name", "version")])
    return rows.select(F.explode(kinds).alias("x")).select("x.*").filter("key is not null").groupBy("kind", "key").agg(F.count("*").alias("n"))


def moved_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """What ``key_counts`` change by when rows ``old`` become rows ``new``; unchanged ones are left out."""
    minus = key_counts(old).withColumn("n", -F.col("n"))
    return key_counts(new).unionAll(minus).groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n <> 0")


def added_counts(counts: DataFrame, moved: DataFrame) -> DataFrame:
    """Counts after a change; keys that no row has any more go."""
    return counts.unionByName(moved).groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n <> 0")


def counted_stats(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``index_stats`` of ``rows`` with the distinct numbers from their ``key_counts``: no key is shuffled."""
    sums = counts.agg(F.count_if(F.col("kind") == "name").alias("n_names"), F.count_if(F.col("kind") == "version").alias("n_versions"))
    ends = rows.agg(F.count("*").alias("n_rows"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(ends).join(one(sums), "_k").select("n_rows", "n_names", "n_versions", "first_date", "last_date")


def activity(events: DataFrame, ts: str, minutes: int = 30) -> DataFrame:
    """Events in each of the last ``minutes`` minutes up to the newest event, none left out."""
    minute = events.select(F.date_trunc("minute", ts).cast("timestamp_ntz").alias("minute"))
    end = minute.agg(F.max("minute").alias("end"))
    spine = end.select(F.explode(F.sequence(F.col("end") - F.make_interval(mins=F.lit(minutes - 1)), F.col("end"), F.expr("interval 1 minute"))).alias("minute"))
    counts = minute.groupBy("minute").agg(F.count("*").alias("c"))
    return spine.join(counts, "minute", "left").select("minute", F.coalesce("c", F.lit(0)).alias("n_events"))
