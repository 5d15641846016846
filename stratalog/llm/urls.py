"""URL rules: host-suffix and path-prefix expressions, matched by short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_side

#: Hexadecimal digits of a digest that the equi-join compares first.
SHORT = 8
#: Verdict where no rule fits.
DEFAULT = "allow"
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, labels: list[int]) -> Column:
    """The host's endings of these numbers of labels, as far as it has so many."""
    own = F.size(F.split(host, r"\."))
    return F.filter(F.array(*[F.when(own >= n, F.substring_index(host, ".", -n)) for n in labels]).cast("array<string>"), lambda s: s.isNotNull())


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with its own.
    The longest ``host + path`` wins, and of equal rules ``block``. Only host suffixes with as many labels and path prefixes of
    such lengths as rules have are expanded, so hosts and paths of any length cost no more than others. The join compares short hash
    prefixes; what it finds counts only where the full digests are equal. Urls are judged once per distinct (host, path), so a
    repeated url costs one row. A null url, or one without ``://``, has an empty host and path and fits no
    rule; rules with a null are ignored. Null ids and repeated rows pass; other columns, whatever their names, are ignored.
    An empty table gives an empty result, and without rules every url has the default verdict.
    """
    listed = rules.dropna(subset=["verdict", "host", "path"]).select("verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("labels")).withColumn("digest", F.sha2("rule", 256))
    listed = materialize(listed.groupBy("rule", "digest", "n", "labels").agg(F.max("verdict").alias("rule_verdict")).withColumn("short", F.substring("digest", 1, SHORT)))
    distinct = lambda c: sorted(r[0] for r in listed.select(c).distinct().collect())  # noqa: E731  # as many as a path has characters, or a host labels, at most
    lengths = F.array(*map(F.lit, distinct("n"))).cast("array<int>")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    places = rows.select("host", "path").filter("host <> ''").distinct()
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    made = places.select("host", "path", F.explode(suffixes(F.col("host"), distinct("labels"))).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    made = made.select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("own")).withColumn("own_short", F.substring("own", 1, SHORT))
    hits = made.join(small_side(listed, listed.count()), F.col("own_short") == F.col("short"))
    sure = F.when(F.col("own") == F.col("digest"), F.struct(F.length("rule").alias("n"), "rule", "rule_verdict"))
    best = hits.groupBy("host", "path").agg(F.max(sure).alias("best"))
    told = rows.filter("host <> ''").join(best, ["host", "path"], "left")
    none = rows.filter("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))  # all alike, and no rule fits them
    out = told.unionByName(none)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


SQL = """
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT page_id, host, path,
    (SELECT max_by(struct_pack(rule := rhost || rpath, verdict := rules.verdict), length(rhost || rpath)) FROM rules
     WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best
  FROM split)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""
