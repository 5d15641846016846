"""Queries that answer tables of search requests on stored intervals, and their SQL twins.

Requests are drawn from ``part``: every row whose key is divisible by 100, with options by the key; they are put to all intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import fold, history, search, text
from ..session import shared_dir, state_of, stored
from ..sources import snapshots
from ..sources.adapters import INT, observations, table

STORES: dict[tuple, str] = {}


def store(spark: SparkSession, d: str) -> str:
    """Where the intervals of a folder's tables are published; done once per application and state of the tables, sorted by lower-case path within files."""
    key = spark.sparkContext.applicationId, d, state_of(spark, d)
    if key not in STORES:
        rows = stored(fold.fold(observations(spark, d, True)))
        path = f"{shared_dir(spark)}/stratalog-store-{abs(hash(key)):x}"
        if not snapshots.versions(spark, path):
            snapshots.publish({"intervals": snapshots.laid_out(rows), "stats": history.index_stats(rows).withColumn("marker", F.lit(d))}, path, d, orders={"intervals": "path_lc"})
        STORES[key] = path
    return STORES[key]


def iv(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.read_intervals(spark, store(spark, d))


def asking(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose key is divisible by 100, with the words of their names and the number ``k`` that deals out the options."""
    p = table(spark, d, "part").filter("p_partkey % 100 = 0")
    return p.select(F.col("p_partkey").cast("bigint").alias("request_id"), (F.floor(F.col("p_partkey") / 100) % 8).cast("int").alias("k"), F.split("p_name", " ")[0].alias("first"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("path"), F.lower(F.split("p_type", " ")[0]).alias("kind"), "p_name")


def requests(spark: SparkSession, d: str) -> DataFrame:
    a = asking(spark, d)
    k = lambda *n: F.col("k").isin(*n)
    q = F.when(k(1, 7), F.col("path")).when(k(5), F.col("kind")).when(k(6), F.upper("first")).otherwise(F.col("first"))
    return a.select(
        "request_id", q.alias("q"), F.when(k(2, 7), "1.").when(k(3), "2.").alias("version"), k(1, 7).alias("exact"), k(3).alias("all_depths"), F.when(k(4), "mit").alias("license"),
        F.when(k(3), "version").when(k(4), "date").when(k(5), "name").otherwise("relevance").alias("sort"), k(4).alias("reverse"), F.lit(False).alias("full"),
        F.when(k(7), 0).when(k(1), 500).otherwise(F.col("k") * 10 + 20).cast("int").alias("page_limit"), F.when(k(5), 10).otherwise(0).cast("int").alias("page_offset"),
        F.when(k(6), "aarch64-darwin").alias("arch"), k(6).alias("hide_insecure"),
    )


def search_requests(spark, d):
    return search.search(iv(spark, d), requests(spark, d)).select("request_id", "rnk", "entity_path", "version", "last_date", "description", "total", "has_more")


def search_totals(spark, d):
    """The totals of the same requests with 40 candidates looked at: whether each is a lower bound."""
    return search.search(iv(spark, d), requests(spark, d), 40).select("request_id", "total", "lower_bound").distinct()


def refused_requests(spark, d):
    """Requests with options that exclude each other, after all options are filled in."""
    a = asking(spark, d).select("request_id", F.col("first").alias("q"), F.when(F.col("k") < 5, "1.").alias("version"), (F.col("k") % 2 == 0).alias("exact"), (F.col("k") % 3 == 0).alias("all_depths"), F.when(F.col("k") == 7, "size").alias("sort"), F.when(F.col("k") == 1, 900).cast("int").alias("page_limit"))
    return search.prepared(a).select("request_id", F.coalesce("refused", F.lit("-")).alias("refused"), "page_limit", "page_offset", "sort")


def prefix_paths(spark, d):
    """For every part, the intervals whose path starts with the first word of its name and a dash and a part of the next: many prefixes, of files that they can hit."""
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    asked = p.select(F.col("p_partkey").cast("bigint").alias("request_id"), F.upper(F.concat(words[0], F.lit("-"), F.substring(words[1], 1, 3))).alias("q"))
    rows = lambda q: snapshots.read_intervals(spark, store(spark, d), q).select("entity_path", "path_lc")
    return search.answered(asked, lambda q: search.prefix_join(rows(q), q).groupBy("request_id").agg(F.count("*").alias("n_intervals"), F.min("entity_path").alias("first_path")))


def wanted(spark, d, exact: bool):
    a = asking(spark, d)
    version = F.lit("9.9.9") if exact else F.when(F.col("k") == 7, "zz1").otherwise(F.concat_ws(".", (F.col("request_id") / 100 % 4).cast("int"), (F.col("request_id") / 100 % 9).cast("int"), F.lit(9)))
    return a.select("request_id", F.col("path" if exact else "first").alias("q"), version.alias("version"))


def suggest_versions(spark, d):
    return search.suggest(iv(spark, d), wanted(spark, d, False)).select("request_id", "rnk", "entity_path", "version", "shared", "gap")


def suggest_on_exact_miss(spark, d):
    return search.suggest_exact(iv(spark, d), wanted(spark, d, True)).select("request_id", "rnk", "entity_path", "version", "shared", "gap")


def name_lookup(spark, d):
    return search.named(search.narrow(iv(spark, d), "name"), asking(spark, d).select("request_id", F.col("path").alias("q")), True).select("request_id", "rnk", "entity_path", "version", "last_date")


def name_prefix_lookup(spark, d):
    return search.named(search.narrow(iv(spark, d), "name"), asking(spark, d).select("request_id", F.upper(F.concat("first", F.lit("-"))).alias("q")), False, None).select("request_id", "rnk", "entity_path", "version", "last_date")


def known_names(spark, d):
    """Every part's name and a name that no part has: is it a path at any version?"""
    p = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"))
    keys = p.select(F.explode(F.array("n", F.concat("n", F.lit("-x")))).alias("key")).distinct()
    paths = iv(spark, d).select(F.col("entity_path").alias("key"), F.lit(True).alias("hit")).distinct()
    return keys.join(paths, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("known"))


def description_requests(spark, d):
    """The last two words of names as phrases, on names and descriptions, with paging."""
    words = F.split("p_name", " ")
    phrases = asking(spark, d).select("request_id", F.upper(F.array_join(F.slice(words, -2, 2), " ")).alias("phrase"))
    rows = iv(spark, d).select("entity_path", "version", "depth", "last_date", "name", "description")
    found = lambda asked: text.description_search(rows, asked).drop("name", "description")
    return search.answered(phrases, lambda asked: search.page(search.ranked(found(asked), "last_date", None), 40, 10)).select("request_id", "rnk", "entity_path", "version", "total", "has_more")


def request_split(spark, d):
    """Free text of names, words and versions as it is typed."""
    n = F.col("p_partkey") % 6
    typed = F.concat(F.col("p_name"), F.when(n == 0, " v1.2").when(n == 1, "  3.11-rc1 ").when(n == 2, "7 8.1").when(n == 3, " 2.0+b").when(n == 4, "").otherwise(" V9"))
    name, version = E.request_parts(F.col("typed"))
    return table(spark, d, "part").select("p_partkey", typed.alias("typed")).select("p_partkey", name.alias("name"), version.alias("version"))


def version_parts(spark, d):
    """Numbers and family of the intervals' versions with endings of all kinds."""
    n = F.length("entity_path") % 5
    v = F.concat("version", F.when(n == 0, "").when(n == 1, "rc1").when(n == 2, "-x.2").when(n == 3, "_7+b").otherwise(".99999999999999999999"))
    rows = iv(spark, d).select("entity_path", F.when(F.length("entity_path") % 7 == 0, F.concat(F.lit("v"), "version")).otherwise(v).alias("v"))
    return rows.select("entity_path", "v", F.concat_ws(",", F.transform(E.numeric_parts(F.col("v")), lambda x: x.cast("string"))).alias("numbers"), E.family(F.col("v")).alias("family"))


def usage_command(spark, d):
    bad, when = E.insecure(F.col("advisories_raw")), F.col("last_date") + F.expr("interval 25 years")
    args = F.col("entity_path"), F.col("last_commit"), when, bad
    return iv(spark, d).select("entity_path", "version", bad.alias("insecure"), E.usage_command(*args).alias("shell"), E.usage_command(*args, run=True).alias("run"))


def prefix_bounds(spark, d):
    """Paths that a range of keys finds for each part's name, against the least text above the prefix."""
    a = asking(spark, d).select("request_id", F.col("kind").alias("q"), E.upper_bound(F.col("kind")).alias("stop"))
    rows = iv(spark, d).select("entity_path").distinct()
    within = (F.col("entity_path") >= F.col("q")) & (F.col("entity_path") < F.col("stop"))
    return search.answered(a, lambda q: search.prefix_join(rows, q).filter(within).groupBy("request_id", "q", "stop").agg(F.count("*").alias("n_paths")))


def stored_statistics(spark, d):
    return snapshots.statistics(spark, store(spark, d))


QUERIES = (search_requests, search_totals, prefix_paths, refused_requests, suggest_versions, suggest_on_exact_miss, name_lookup, name_prefix_lookup, known_names, description_requests, request_split, version_parts, usage_command, prefix_bounds, stored_statistics)

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
A = "a AS (SELECT CAST(p_partkey AS BIGINT) AS request_id, CAST((p_partkey // 100) % 8 AS INT) AS k, string_split(p_name, ' ')[1] AS first, replace(p_name, ' ', '-') AS path, lower(string_split(p_type, ' ')[1]) AS kind, p_name FROM part WHERE p_partkey % 100 = 0)"
BY = "CAST(row_number() OVER (PARTITION BY request_id ORDER BY depth, {} DESC, entity_path, version) AS BIGINT) AS rnk"
NEAR = """n AS (SELECT *, CASE WHEN NOT told THEN 0 WHEN a1[1] <> b1[1] THEN 0 WHEN a1[2] <> b1[2] THEN 1 WHEN a1[3] <> b1[3] THEN 2 ELSE 3 END AS shared FROM
  (SELECT *, list_transform(string_split(version, '.'), lambda x: CAST(x AS BIGINT)) AS a1, CASE WHEN want <> 'zz1' THEN list_transform(string_split(want, '.'), lambda x: CAST(x AS BIGINT)) END AS b1, want <> 'zz1' AS told FROM c)),
g AS (SELECT *, CASE WHEN told AND shared < 3 THEN abs(a1[shared + 1] - b1[shared + 1]) ELSE 0 END AS gap FROM n),
s AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY told DESC, shared DESC, gap, entity_path <> q, length(entity_path), last_date DESC, entity_path, version DESC) AS BIGINT) AS rnk, entity_path, version, CAST(shared AS BIGINT) AS shared, CAST(gap AS BIGINT) AS gap FROM g)
SELECT * FROM s WHERE rnk <= 5"""
QUOTED = "array_to_string(list_transform(string_split(entity_path, '.'), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_''-]*$') AND x NOT IN ('assert', 'else', 'if', 'in', 'inherit', 'let', 'or', 'rec', 'then', 'with') THEN x ELSE '\"' || x || '\"' END), '.')"
PLAIN = "' ' || array_to_string(list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' '"
ORACLE = {
    "search_requests": f"""WITH {INT}, {A}, rq AS (SELECT request_id, CASE WHEN k IN (1, 7) THEN path WHEN k = 5 THEN kind WHEN k = 6 THEN upper(first) ELSE first END AS q, CASE WHEN k IN (2, 7) THEN '1.' WHEN k = 3 THEN '2.' END AS want, k IN (1, 7) AS exact, k = 3 AS deep, CASE WHEN k = 4 THEN 'mit' END AS lic,
      CASE k WHEN 3 THEN 'version' WHEN 4 THEN 'date' WHEN 5 THEN 'name' ELSE 'relevance' END AS sort, k = 4 AS rev, CASE k WHEN 7 THEN 0 WHEN 1 THEN 100 ELSE least(k * 10 + 20, 100) END AS lim, CASE WHEN k = 5 THEN 10 ELSE 0 END AS off, CASE WHEN k = 6 THEN 'aarch64-darwin' END AS arch, k = 6 AS hide FROM a),
      m AS (SELECT rq.*, iv.* FROM iv JOIN rq ON exact AND entity_path = q UNION ALL SELECT rq.*, iv.* FROM iv JOIN rq ON NOT exact AND starts_with({LOW.format('entity_path')}, {LOW.format('q')})),
      sc AS (SELECT *, min(depth) OVER (PARTITION BY request_id) AS least_depth FROM m),
      v AS (SELECT *, CASE WHEN want IS NULL OR exact THEN last_date ELSE first_date END AS dt FROM sc WHERE (exact OR want IS NULL OR deep OR depth = least_depth) AND (want IS NULL OR starts_with(version, want))),
      r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY depth, dt DESC, entity_path, version) AS r0 FROM v),
      f AS (SELECT * FROM r WHERE (exact OR r0 <= 5000) AND (lic IS NULL OR contains(lower(license_raw), lic)) AND (arch IS NULL OR contains(platforms_raw, '"' || arch || '"')) AND NOT (hide AND advisories_raw NOT IN ('', '[]', 'null'))),
      s AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN sort = 'date' THEN -epoch_us(last_date) END NULLS FIRST, CASE WHEN sort = 'version' THEN list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) END NULLS FIRST, CASE WHEN sort = 'name' THEN name END NULLS FIRST, r0) AS k, count(*) OVER (PARTITION BY request_id) AS total FROM f),
      t AS (SELECT *, CASE WHEN rev THEN total + 1 - k ELSE k END AS rnk FROM s)
      SELECT request_id, rnk, entity_path, version, last_date, description, total, lim > 0 AND total > off + lim AS has_more FROM t WHERE rnk > off AND (lim = 0 OR rnk <= off + lim)""",
    "prefix_paths": f"""WITH {INT}, rq AS (SELECT CAST(p_partkey AS BIGINT) AS request_id, {LOW.format("string_split(p_name, ' ')[1] || '-' || left(string_split(p_name, ' ')[2], 3)")} AS q FROM part),
      k AS (SELECT entity_path, n, left({LOW.format('entity_path')}, n) AS pre FROM iv, (SELECT DISTINCT length(q) AS n FROM rq))
      SELECT request_id, count(*) AS n_intervals, min(entity_path) AS first_path FROM k JOIN rq ON pre = q AND n = length(q) GROUP BY request_id""",
    "refused_requests": f"WITH {A} SELECT request_id, CASE WHEN k % 3 = 0 AND k >= 5 THEN 'all depths need a version' WHEN k % 3 = 0 AND k % 2 = 0 THEN 'all depths and exact exclude each other' WHEN k = 7 THEN 'unknown order' ELSE '-' END AS refused, CAST(CASE WHEN k = 1 THEN 100 ELSE 50 END AS INT) AS page_limit, CAST(0 AS INT) AS page_offset, CASE WHEN k = 7 THEN 'size' ELSE 'relevance' END AS sort FROM a",
    "suggest_versions": f"""WITH {INT}, {A}, rq AS (SELECT request_id, first AS q, CASE WHEN k = 7 THEN 'zz1' ELSE concat_ws('.', (request_id // 100) % 4, (request_id // 100) % 9, 9) END AS want FROM a),
      m AS (SELECT rq.*, iv.*, min(depth) OVER (PARTITION BY request_id) AS least_depth FROM iv JOIN rq ON starts_with({LOW.format('entity_path')}, {LOW.format('q')})),
      p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY NOT starts_with(version, CASE WHEN want = 'zz1' THEN want ELSE concat_ws('.', string_split(want, '.')[1], string_split(want, '.')[2]) END), entity_path <> q, last_date DESC, entity_path, version) AS k0 FROM m WHERE depth = least_depth),
      c AS (SELECT * FROM p WHERE k0 <= 512), {NEAR}""",
    "suggest_on_exact_miss": f"WITH {INT}, {A}, c AS (SELECT request_id, path AS q, '9.9.9' AS want, iv.* FROM iv JOIN a ON entity_path = path), {NEAR}",
    "name_lookup": f"WITH {INT}, {A}, r AS (SELECT request_id, {BY.format('last_date')}, entity_path, version, last_date FROM iv JOIN a ON name = path) SELECT * FROM r WHERE rnk <= 5000",
    "name_prefix_lookup": f"WITH {INT}, {A} SELECT request_id, {BY.format('last_date')}, entity_path, version, last_date FROM iv JOIN a ON starts_with({LOW.format('name')}, {LOW.format('first')} || '-')",
    "known_names": f"WITH {INT}, k AS (SELECT DISTINCT unnest([replace(p_name, ' ', '-'), replace(p_name, ' ', '-') || '-x']) AS key FROM part) SELECT key, key IN (SELECT entity_path FROM iv) AS known FROM k",
    "description_requests": f"WITH {INT}, {A}, rq AS (SELECT request_id, {PLAIN.format('array_to_string(string_split(p_name, chr(32))[-2:], chr(32))')} AS f FROM a), r AS (SELECT request_id, {BY.format('last_date')}, entity_path, version, count(*) OVER (PARTITION BY request_id) AS total FROM iv JOIN rq ON contains({PLAIN.format('name')}, f) OR contains({PLAIN.format('description')}, f)) SELECT *, total > 50 AS has_more FROM r WHERE rnk BETWEEN 11 AND 50",
    "request_split": "SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 2 THEN '7 8.1' WHEN 3 THEN ' 2.0+b' ELSE '' END AS name, CASE p_partkey % 6 WHEN 0 THEN '1.2' WHEN 1 THEN '3.11-rc1' WHEN 5 THEN '9' END AS version FROM part",
    "version_parts": f"""WITH {INT}, x AS (SELECT entity_path, CASE WHEN length(entity_path) % 7 = 0 THEN 'v' || version ELSE version || CASE length(entity_path) % 5 WHEN 0 THEN '' WHEN 1 THEN 'rc1' WHEN 2 THEN '-x.2' WHEN 3 THEN '_7+b' ELSE '.99999999999999999999' END END AS v FROM iv),
      d AS (SELECT *, list_transform(regexp_split_to_array(v, '[.\\-_+]'), lambda p: regexp_extract(p, '^[0-9]*')) AS d FROM x),
      n AS (SELECT entity_path, v, list_filter(list_transform(CASE WHEN list_position(d, '') > 0 THEN d[1:list_position(d, '') - 1] ELSE d END, lambda p: TRY_CAST(p AS BIGINT)), lambda p: p IS NOT NULL) AS n FROM d)
      SELECT entity_path, v, array_to_string(n, ',') AS numbers, CASE WHEN len(n) >= 2 THEN n[1] || '.' || n[2] WHEN len(n) = 1 THEN CAST(n[1] AS VARCHAR) ELSE regexp_extract(v, '^[A-Za-z0-9]*') END AS family FROM n""",
    "usage_command": f"""WITH {INT}, c AS (SELECT entity_path, version, last_commit, advisories_raw NOT IN ('', '[]', 'null') AS insecure, {QUOTED} AS quoted, last_date + INTERVAL 25 YEAR < TIMESTAMP '2020-03-26' AS old FROM iv),
      r AS (SELECT *, CASE WHEN insecure THEN 'NIXPKGS_ALLOW_INSECURE=1 ' ELSE '' END AS allow, 'nix-shell -p ''(import (builtins.fetchTarball "https://github.com/NixOS/nixpkgs/archive/' || last_commit || '.tar.gz") {{}}).' || quoted || '''' AS legacy, CASE WHEN insecure THEN ' --impure ' ELSE ' ' END || CASE WHEN contains(quoted, '"') THEN '''nixpkgs/' || last_commit || '#' || quoted || '''' ELSE 'nixpkgs/' || last_commit || '#' || quoted END AS ref FROM c)
      SELECT entity_path, version, insecure, allow || CASE WHEN old THEN legacy ELSE 'nix shell' || ref END AS shell, allow || CASE WHEN old THEN legacy || ' --run ' || entity_path ELSE 'nix run' || ref END AS run FROM r""",
    "prefix_bounds": f"WITH {INT}, {A} SELECT request_id, kind AS q, left(kind, length(kind) - 1) || chr(ord(right(kind, 1)) + 1) AS stop, count(DISTINCT entity_path) AS n_paths FROM iv JOIN a ON starts_with(entity_path, kind) GROUP BY ALL",
    "stored_statistics": f"WITH {INT} SELECT count(*) AS n_rows, count(DISTINCT name) AS n_names, count(DISTINCT version) AS n_versions, min(first_date) AS first_date, max(last_date) AS last_date FROM iv",
}
#: The requests' twin with the smaller cap: a total is a lower bound where a candidate has the last rank under it.
ORACLE["search_totals"] = ORACLE["search_requests"].replace("r0 <= 5000", "r0 <= 40").replace("SELECT request_id, rnk, entity_path, version, last_date, description, total, lim > 0 AND total > off + lim AS has_more FROM t", "SELECT DISTINCT request_id, total, request_id IN (SELECT request_id FROM r WHERE r0 = 40 AND NOT exact) AS lower_bound FROM t")
