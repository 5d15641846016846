"""All queries by name on the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import fold, gate, history, ledger, search, text
from ..sources import adapters
from ..sources.adapters import INT, LEDGER, OBS, observations, table
from ..session import small_side, stored
from . import exchange, ingest, searches
from .searches import iv

ENDS = ["entity_path", "version", "first_date", "first_commit", "last_date", "last_commit", "source_path"]
REQUESTS = [(1, "blue", None), (2, "small", "2."), (3, "standard", "1.2"), (4, "ECONOMY", "0.3.1"), (5, "nosuch", "1"), (6, "medium", "3.9")]
PHRASES = ["the of", "le la", "de la", "Été", "und die"]
NOW = "2002-01-15 00:00:00"


def obs(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d)


def asked(spark: SparkSession, versions: bool) -> DataFrame:
    return spark.createDataFrame([r for r in REQUESTS if bool(r[2]) == versions or not versions], "request_id bigint, q string, version string")


def fold_intervals(spark, d):
    return fold.fold(observations(spark, d, True)).select(*ENDS, "description", "license_raw", "advisories_raw", "depth")


def merge_late_batch(spark, d):
    """The later half is stored first and the earlier half comes late; the result is the fold of all."""
    o = observations(spark, d, True)
    late = F.col("snapshot_date") < F.lit("1995-06-01").cast("timestamp_ntz")
    return fold.intervals(fold.merge_late(fold.merge(fold.as_bounds(o.filter(~late))), o.filter(late))).select(*ENDS)


def per_channel(spark, d):
    return observations(spark, d, True).groupBy("channel", "entity_path", "version").agg(F.min("snapshot_date").alias("first_date"), F.min_by("commit_hash", "ord").alias("first_commit"), F.max("snapshot_date").alias("last_date"), F.max_by("commit_hash", "ord").alias("last_commit"), F.min("description").alias("description"))


def dedupe_intervals(spark, d):
    return fold.dedupe(per_channel(spark, d))[0]


def dedupe_stats(spark, d):
    return fold.dedupe(per_channel(spark, d))[1]


def search_prefix_top(spark, d):
    found = search.page(search.first_of_each(search.prefix_search(iv(spark, d), asked(spark, False).filter("request_id = 1"))), 50)
    return found.select("request_id", "rnk", "entity_path", "version", "depth", "last_date", "total", "has_more")


def part_requests(spark, d):
    """Every part's name as a path that is asked for exactly."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("request_id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("q"), F.lit("1.").alias("version"))


def search_exact_all(spark, d):
    rows = search.narrow(iv(spark, d))
    return search.answered(part_requests(spark, d).drop("version"), lambda asked: search.ranked(rows.join(small_side(asked), F.col("entity_path") == F.col("q")), "last_date", None)).select("request_id", "rnk", "entity_path", "version", "last_date")


def search_exact_version_all(spark, d):
    rows = search.narrow(iv(spark, d))
    return search.answered(part_requests(spark, d), lambda asked: search.ranked(search.with_version(search.exact_join(rows, asked)), "last_date", None)).select("request_id", "rnk", "entity_path", "version", "last_date")


def search_all_depths(spark, d):
    return search.all_depths(search.narrow(iv(spark, d)), asked(spark, True), None).select("request_id", "rnk", "entity_path", "version", "depth", "first_date")


def search_shallowest_version(spark, d):
    return search.shallowest(search.narrow(iv(spark, d)), asked(spark, True), None).select("request_id", "rnk", "entity_path", "version", "depth", "first_date")


def search_resolution(spark, d):
    return search.resolution(iv(spark, d), asked(spark, True))


def search_license_filtered(spark, d):
    found = search.licensed(search.prefix_search(iv(spark, d), asked(spark, False).filter("request_id = 1")), F.lit("mit"))
    return search.page(search.sorted_by(found, "date"), 100, 20).select("rnk", "entity_path", "version", "last_date", "total", "has_more")


def search_sorted_semver(spark, d):
    found = search.prefix_search(iv(spark, d), asked(spark, False).filter("request_id = 1"))
    return search.sorted_by(found, "version", reverse=True).select("rnk", "entity_path", "version")


def tiered_lookup_all(spark, d):
    """All parts by id; the other requests have negative numbers, as parts have theirs."""
    others = asked(spark, True).withColumn("request_id", -F.col("request_id"))
    return search.tiered(iv(spark, d), part_requests(spark, d).unionAll(others)).select("request_id", "rnk", "tier", "entity_path", "version")


def complete_prefix(spark, d):
    return search.complete(iv(spark, d), asked(spark, False))


def distinct_paths(spark, d):
    return iv(spark, d).select("entity_path", "depth").distinct()


def version_history(spark, d):
    return history.version_history(iv(spark, d))


def first_last_occurrence(spark, d):
    return history.first_last(iv(spark, d))


def index_stats(spark, d):
    return history.index_stats(iv(spark, d))


def timeline_extent(spark, d):
    return history.timeline_extent(iv(spark, d))


def platforms_by_os(spark, d):
    return history.platforms_by_os(obs(spark, d))


def channel_coverage(spark, d):
    return ledger.coverage(adapters.ledger(spark, d))


def unsettled_holes(spark, d):
    return ledger.unsettled(adapters.ledger(spark, d))


def retry_worklist(spark, d):
    return ledger.worklist(adapters.ledger(spark, d), F.lit(NOW).cast("timestamp_ntz")).select("channel", "release_name", "status", "attempts")


def order_coverage(spark, d):
    """Orders as a second ledger: priorities as channels, with tied dates."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ingested").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    return ledger.coverage(o.select(F.col("o_orderpriority").alias("channel"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("release_name"), F.col("o_orderdate").alias("release_date"), status.alias("status")))


def snapshot_counts(spark, d):
    return gate.counts(obs(spark, d))


def gate_tables(spark):
    """Floors and sentinels that fit the sizes and paths of the given tables."""
    floors = gate.floor_ladder(spark, {"bare": ((1993, 20), (None, 30)), "envelope": ((1999, 30), (2000, 40), (None, 60))})
    return floors, gate.sentinels(spark, (("blue", "^blue", None), ("brand", "^economy.*[.]Brand_11[.]", "1997-03-01"), ("never", "^nowhere$", "2001-10-15")))


def verdicts(spark, d):
    o = obs(spark, d)
    floors, due = gate_tables(spark)
    return gate.judged(stored(gate.counts(o)), floors, gate.missing_sentinels(o, due))  # a row for each snapshot, asked for twice


def missing_sentinels(spark, d):
    return gate.missing_sentinels(obs(spark, d), gate_tables(spark)[1])


def births_deaths(spark, d):
    """Between accepted snapshots of one era."""
    return gate.births_deaths(obs(spark, d), stored(verdicts(spark, d)))


def rolling_baseline(spark, d):
    return gate.rolling_baseline(gate.counts(obs(spark, d)))


def gate_results(spark, d):
    return verdicts(spark, d).withColumns({c: F.array_join(c, "; ") for c in ("failures", "warnings")})


def gated_fold(spark, d):
    return fold.fold(gate.accepted(observations(spark, d, True), verdicts(spark, d))).select(*ENDS)


def json_array_decode(spark, d):
    return obs(spark, d).select("advisories_raw", "platforms_raw").distinct().select("advisories_raw", F.coalesce("platforms_raw", F.lit("")).alias("platforms_raw"), E.shown(E.decode_array(F.col("advisories_raw"))).alias("advisories"), E.shown(E.decode_array(F.col("platforms_raw"))).alias("platforms"), E.insecure(F.col("advisories_raw")).alias("insecure"))


def normalize_license(spark, d):
    return obs(spark, d).groupBy("license_raw").agg(F.count("*").alias("n")).select("license_raw", "n", F.array_join(E.licenses(F.parse_json("license_raw")), "+").alias("license"))


def split_path(spark, d):
    return obs(spark, d).select("entity_path").distinct().select("entity_path", E.depth(F.col("entity_path")).alias("depth"), F.array_join(E.path_segments(F.col("entity_path")), "/").alias("segments"), E.leaf(F.col("entity_path")).alias("leaf"))


def history_export(spark, d):
    return iv(spark, d).select("entity_path", "version", F.date_format("first_date", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_date", "yyyy-MM-dd").alias("last_seen"), E.short_hash(F.col("first_commit")).alias("first_hash"), E.short_hash(F.col("last_commit")).alias("last_hash"), F.coalesce("source_path", F.lit("-")).alias("source"))


def snapshot_delta_all(spark, d):
    """The delta has all that came since the cut."""
    o = obs(spark, d)
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    pick = ["entity_path", "version", "last_date", "last_commit"]
    return fold.apply_delta(fold.fold(o.filter(F.col("snapshot_date") < cut)).select(*pick), fold.fold(o.filter(F.col("snapshot_date") >= cut)).select(*pick))


def run_report(spark, d):
    """One row: ledger totals, folded figures and the lag of the newest accepted snapshot in hours at a fixed moment."""
    led = adapters.ledger(spark, d)
    sums = led.agg(F.count("*").alias("planned"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ingested", "failed", "skipped")], F.max(F.when(F.col("status") == "ingested", F.col("release_date"))).alias("newest"))
    seen = obs(spark, d).agg(F.count_distinct("entity_path").alias("n_paths"), F.count_distinct("entity_path", "version").alias("n_intervals"))
    lag = F.expr(f"timestampdiff(HOUR, newest, timestamp_ntz'{NOW}')").cast("bigint")
    keyed = sums.withColumn("k", F.lit(1)).join(seen.withColumn("k", F.lit(1)), "k").drop("k")
    return keyed.withColumn("lag_hours", lag).withColumn("healthy", (F.col("failed") == 0) & (F.col("lag_hours") <= 72))


def phrase_search(spark, d):
    return text.phrase_search(table(spark, d, "documents"), PHRASES)


def latency_percentiles(spark, d):
    return history.latency_percentiles(table(spark, d, "events").filter("event_type <> 'error'"), "event_type", "value", "ts")


def latency_sketches(spark, d):
    """Percentiles of each event type from sketches by minute, merged over all time: whether each one's exact rank is as close as the sketch says."""
    e = table(spark, d, "events")
    approx = history.merged_percentiles(history.latency_sketches(e, "event_type", "value", "ts"), ["key"])
    few = approx.select(F.col("key").alias("event_type"), F.col("n").alias("n_sketched"), F.array("p50", "p95", "p99").alias("p"))
    at = [F.avg((F.col("value") <= F.col("p")[i]).cast("double")).alias(f"r{i}") for i in range(3)]
    ranks = e.join(F.broadcast(few), "event_type").groupBy("event_type").agg(F.count("value").alias("n"), F.first("n_sketched").alias("n_sketched"), *at)  # a row for each type
    near = [(F.abs(F.col(f"r{i}") - q) <= 0.03).alias(f"p{int(q * 100)}_near") for i, q in enumerate((0.5, 0.95, 0.99))]
    return ranks.select("event_type", "n", "n_sketched", *near)


def activity_minutes(spark, d):
    return history.activity(table(spark, d, "events"), "ts")


QUERIES = (fold_intervals, merge_late_batch, dedupe_intervals, dedupe_stats, search_prefix_top, search_all_depths, search_shallowest_version, search_resolution, search_license_filtered, search_sorted_semver, complete_prefix, distinct_paths, version_history, first_last_occurrence, index_stats, timeline_extent, platforms_by_os, channel_coverage, unsettled_holes, retry_worklist, order_coverage, snapshot_counts, missing_sentinels, births_deaths, rolling_baseline, gate_results, gated_fold, json_array_decode, normalize_license, split_path, history_export, run_report, phrase_search, latency_percentiles, latency_sketches, activity_minutes, search_exact_all, search_exact_version_all, tiered_lookup_all, snapshot_delta_all)


def queries() -> dict:
    return {f.__name__: f for f in (*QUERIES, *searches.QUERIES, *ingest.QUERIES, *exchange.QUERIES)}


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ASKED = "rq(request_id, q, want) AS (VALUES (2, 'small', '2.'), (3, 'standard', '1.2'), (4, 'ECONOMY', '0.3.1'), (5, 'nosuch', '1'), (6, 'medium', '3.9'))"
MATCH = f"found AS (SELECT request_id, q, want, iv.* FROM iv JOIN rq ON starts_with({LOW.format('entity_path')}, {LOW.format('q')}))"
EXACT = "rq AS (SELECT p_partkey AS request_id, replace(p_name, ' ', '-') AS q, '1.' AS want FROM part)"
RANK = "CAST(row_number() OVER (PARTITION BY request_id ORDER BY depth, {} DESC, entity_path, version) AS BIGINT) AS rnk"
BLUE = f"b AS (SELECT 1 AS request_id, * FROM iv WHERE starts_with({LOW.format('entity_path')}, 'blue')), r AS (SELECT *, {RANK.format('last_date')} FROM b), top AS (SELECT * FROM r WHERE rnk <= 5000)"
PER = OBS + ", pc AS (SELECT channel, entity_path, version, min(snapshot_date) AS first_date, arg_min(commit_hash, ord) AS first_commit, max(snapshot_date) AS last_date, arg_max(commit_hash, ord) AS last_commit, min(description) AS description FROM obs GROUP BY ALL), dd AS (SELECT entity_path, version, min(first_date) AS first_date, arg_min(first_commit, row(first_date, channel)) AS first_commit, max(last_date) AS last_date, arg_max(last_commit, row(last_date, channel)) AS last_commit, arg_min(description, row(first_date, channel)) AS description, count(*) AS n_rows FROM pc GROUP BY ALL)"
COUNTS = OBS + ", cnt AS (SELECT channel, era, snapshot_date, count(*) AS n_rows, count(DISTINCT (entity_path, version)) AS n_entries, count(DISTINCT entity_path) AS n_paths FROM obs GROUP BY ALL)"
MISSED = """due(label, pattern, since) AS (VALUES ('blue', '^blue', NULL), ('brand', '^economy.*[.]Brand_11[.]', DATE '1997-03-01'), ('never', '^nowhere$', DATE '2001-10-15')),
missed AS (SELECT channel, era, snapshot_date, label FROM (SELECT DISTINCT channel, era, snapshot_date FROM obs) o, due WHERE (since IS NULL OR snapshot_date >= since)
  AND NOT EXISTS (SELECT 1 FROM obs b WHERE b.channel = o.channel AND b.snapshot_date = o.snapshot_date AND regexp_matches(b.entity_path, pattern)))"""
STEPS = """floors(era, y1, y2, floor) AS (VALUES ('bare', 0, 1993, 20), ('bare', 1994, 9999, 30), ('envelope', 0, 1999, 30), ('envelope', 2000, 2000, 40), ('envelope', 2001, 9999, 60)),
why AS (SELECT channel, cnt.era, snapshot_date, 'count ' || n_entries || ' under floor ' || floor AS why FROM cnt JOIN floors ON cnt.era = floors.era AND year(snapshot_date) BETWEEN y1 AND y2 AND n_entries < floor UNION ALL SELECT channel, era, snapshot_date, 'sentinel missing: ' || label FROM missed),
sn AS (SELECT cnt.channel, cnt.era, cnt.snapshot_date, n_entries, coalesce(pre, []) AS pre, row_number() OVER (PARTITION BY cnt.channel, cnt.era ORDER BY cnt.snapshot_date) AS n FROM cnt LEFT JOIN (SELECT channel, era, snapshot_date, list(why) AS pre FROM why GROUP BY ALL) USING (channel, era, snapshot_date)),
st AS (SELECT channel, era, snapshot_date, n_entries, n, CAST(NULL AS BIGINT) AS baseline, list_sort(pre) AS failures, CAST([] AS VARCHAR[]) AS warnings, CASE WHEN len(pre) > 0 THEN CAST([] AS BIGINT[]) ELSE [n_entries] END AS recent FROM sn WHERE n = 1
  UNION ALL SELECT channel, era, snapshot_date, n_entries, n, base, failures, CASE WHEN NOT low AND n_entries < CAST(trunc(base * 0.90::DOUBLE) AS BIGINT) THEN ['count ' || n_entries || ' under 90% of ' || base] ELSE [] END, CASE WHEN len(failures) > 0 THEN recent ELSE list_append(recent, n_entries)[-10:] END FROM (
    SELECT *, list_sort(CASE WHEN low THEN list_append(pre, 'count ' || n_entries || ' under 70% of ' || base) ELSE pre END) AS failures FROM (
      SELECT *, coalesce(n_entries < CAST(trunc(base * 0.70::DOUBLE) AS BIGINT), false) AS low
      FROM (SELECT sn.channel, sn.era, sn.snapshot_date, sn.n_entries, sn.pre, sn.n, list_max(st.recent) AS base, st.recent FROM st JOIN sn ON sn.channel = st.channel AND sn.era = st.era AND sn.n = st.n + 1))))"""
JUDGED = COUNTS.replace("j AS", "RECURSIVE j AS", 1) + ", " + MISSED + ", " + STEPS
OUT = "entity_path, version, first_date, first_commit, last_date, last_commit, source_path"
FOLD = "SELECT entity_path, version, min(snapshot_date) AS first_date, arg_min(commit_hash, ord) AS first_commit, max(snapshot_date) AS last_date, arg_max(commit_hash, ord) AS last_commit, arg_max(source_path, ord) FILTER (source_path IS NOT NULL) AS source_path FROM {} GROUP BY entity_path, version"
PLAIN = "' ' || array_to_string(list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' '"
ORACLE = {
    "fold_intervals": f"WITH {INT} SELECT {OUT}, description, license_raw, advisories_raw, depth FROM iv",
    "merge_late_batch": f"WITH {INT} SELECT {OUT} FROM iv",
    "dedupe_intervals": f"WITH {PER} SELECT * FROM dd",
    "dedupe_stats": f"WITH {PER} SELECT count(*) AS n_groups, count(*) FILTER (n_rows > 1) AS groups_with_duplicates, CAST(sum(n_rows) AS BIGINT) AS rows_before, count(*) AS rows_after, count(*) FILTER (n_rows > 1) AS rows_updated, CAST(sum(n_rows) - count(*) AS BIGINT) AS rows_deleted FROM dd",
    "search_prefix_top": f"WITH {INT}, {BLUE} SELECT CAST(1 AS BIGINT) AS request_id, rnk, entity_path, version, depth, last_date, (SELECT count(*) FROM top) AS total, (SELECT count(*) FROM top) > 50 AS has_more FROM top WHERE rnk <= 50",
    "search_exact_all": f"WITH {INT}, {EXACT} SELECT request_id, {RANK.format('last_date')}, entity_path, version, last_date FROM iv JOIN rq ON entity_path = q",
    "search_exact_version_all": f"WITH {INT}, {EXACT} SELECT request_id, {RANK.format('last_date')}, entity_path, version, last_date FROM iv JOIN rq ON entity_path = q WHERE starts_with(version, want)",
    "search_all_depths": f"WITH {INT}, {ASKED}, {MATCH} SELECT CAST(request_id AS BIGINT) AS request_id, {RANK.format('first_date')}, entity_path, version, depth, first_date FROM found WHERE starts_with(version, want)",
    "search_shallowest_version": f"WITH {INT}, {ASKED}, {MATCH}, s AS (SELECT *, min(depth) OVER (PARTITION BY request_id) AS least FROM found) SELECT CAST(request_id AS BIGINT) AS request_id, {RANK.format('first_date')}, entity_path, version, depth, first_date FROM s WHERE depth = least AND starts_with(version, want)",
    "search_resolution": f"WITH {INT}, {ASKED}, {MATCH}, s AS (SELECT *, min(depth) OVER (PARTITION BY request_id) AS least, starts_with(version, want) AS hit FROM found), g AS (SELECT request_id, min(least) AS scope_depth, count(*) FILTER (hit AND depth = least) AS hits, bool_or(hit AND depth > least) AS deeper FROM s GROUP BY request_id) SELECT CAST(rq.request_id AS BIGINT) AS request_id, scope_depth, coalesce(hits, 0) AS hits, coalesce(deeper, false) AS deeper, CASE WHEN hits > 0 THEN 'found' WHEN deeper THEN 'deeper only' WHEN scope_depth IS NOT NULL THEN 'version missing' ELSE 'unknown' END AS outcome FROM rq LEFT JOIN g USING (request_id)",
    "search_license_filtered": f"WITH {INT}, {BLUE}, l AS (SELECT *, CAST(row_number() OVER (ORDER BY last_date DESC, rnk) AS BIGINT) AS k FROM top WHERE contains(lower(license_raw), 'mit')) SELECT k AS rnk, entity_path, version, last_date, (SELECT count(*) FROM l) AS total, (SELECT count(*) FROM l) > 120 AS has_more FROM l WHERE k BETWEEN 21 AND 120",
    "search_sorted_semver": f"WITH {INT}, {BLUE} SELECT CAST(row_number() OVER (ORDER BY CAST(split_part(version, '.', 1) AS INT) DESC, CAST(split_part(version, '.', 2) AS INT) DESC, CAST(split_part(version, '.', 3) AS INT) DESC, rnk DESC) AS BIGINT) AS rnk, entity_path, version FROM top",
    "tiered_lookup_all": f"WITH {INT}, {EXACT.replace('rq AS', 'ra AS')}, {ASKED.replace('rq(', 'rb(')}, rq AS (SELECT * FROM ra UNION ALL SELECT -request_id, q, want FROM rb), ex AS (SELECT request_id, want, iv.* FROM iv JOIN rq ON entity_path = q), pf AS (SELECT request_id, want, iv.* FROM iv JOIN rq ON starts_with({LOW.format('entity_path')}, {LOW.format('q')}) WHERE request_id NOT IN (SELECT request_id FROM ex)), u AS (SELECT *, 'exact' AS tier FROM ex UNION ALL SELECT *, 'prefix' AS tier FROM pf) SELECT CAST(request_id AS BIGINT) AS request_id, {RANK.format('last_date')}, tier, entity_path, version FROM u WHERE starts_with(version, want)",
    "complete_prefix": f"WITH {OBS}, {ASKED.replace('VALUES', 'VALUES (1, ' + chr(39) + 'blue' + chr(39) + ', NULL),')}, p AS (SELECT DISTINCT entity_path FROM obs), c AS (SELECT CAST(request_id AS BIGINT) AS request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY entity_path) AS BIGINT) AS rnk, entity_path FROM p JOIN rq ON starts_with({LOW.format('entity_path')}, {LOW.format('q')})) SELECT * FROM c WHERE rnk <= 20",
    "distinct_paths": f"WITH {INT} SELECT DISTINCT entity_path, depth FROM iv",
    "version_history": f"WITH {INT} SELECT entity_path, version, first_date, last_date, version IN (SELECT version FROM iv WHERE advisories_raw NOT IN ('', '[]', 'null')) AS insecure FROM iv",
    "first_last_occurrence": f"WITH {INT} SELECT entity_path, min(row(first_date, version))[2] AS first_version, min(first_date) AS first_date, max(row(last_date, version))[2] AS last_version, max(last_date) AS last_date FROM iv GROUP BY entity_path",
    "index_stats": f"WITH {INT} SELECT count(*) AS n_rows, count(DISTINCT name) AS n_names, count(DISTINCT version) AS n_versions, min(first_date) AS first_date, max(last_date) AS last_date FROM iv",
    "timeline_extent": f"WITH {INT}, t AS (SELECT entity_path, min(first_date) AS first_date, max(last_date) AS last_date FROM iv GROUP BY entity_path), u AS (SELECT *, greatest(date_diff('day', first_date, last_date), 90) AS days FROM t) SELECT *, greatest(CAST(14 AS DOUBLE), days * CAST(0.04 AS DOUBLE)) AS margin_days FROM u",
    "platforms_by_os": f"WITH {OBS}, p AS (SELECT DISTINCT entity_path, unnest(CASE WHEN platforms_raw LIKE '%darwin%' THEN ['x86_64-linux', 'aarch64-darwin'] ELSE ['x86_64-linux'] END) AS platform FROM obs WHERE platforms_raw IS NOT NULL) SELECT entity_path, CASE WHEN contains(platform, 'linux') THEN 'linux' WHEN contains(platform, 'darwin') THEN 'darwin' ELSE 'other' END AS os, string_agg(platform, ',' ORDER BY platform) AS platforms FROM p GROUP BY ALL",
    "channel_coverage": f"WITH {LEDGER} SELECT channel, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'ingested') AS n_ingested, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'skipped') AS n_skipped, arg_max(release_name, release_date) FILTER (status = 'ingested') AS newest_name, max(release_date) FILTER (status = 'ingested') AS newest_date FROM ledger GROUP BY channel",
    "unsettled_holes": f"WITH {LEDGER} SELECT channel, count(*) AS n_unsettled FROM ledger JOIN (SELECT channel, max(release_date) AS mark FROM ledger WHERE status = 'ingested' GROUP BY channel) USING (channel) WHERE status IN ('pending', 'failed') AND release_date < mark GROUP BY channel",
    "retry_worklist": f"WITH {LEDGER} SELECT channel, release_name, status, attempts FROM ledger WHERE status = 'pending' OR status = 'failed' AND last_attempt_at + to_seconds(3600 * CAST(pow(2, least(greatest(attempts - 1, 0), 16)) AS INT)) <= TIMESTAMP '{NOW}'",
    "order_coverage": "WITH o AS (SELECT o_orderpriority AS channel, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS release_name, o_orderdate AS release_date, CASE o_orderstatus WHEN 'F' THEN 'ingested' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status FROM orders) SELECT channel, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'ingested') AS n_ingested, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'skipped') AS n_skipped, arg_max(release_name, row(release_date, release_name)) FILTER (status = 'ingested') AS newest_name, max(release_date) FILTER (status = 'ingested') AS newest_date FROM o GROUP BY channel",
    "snapshot_counts": f"WITH {COUNTS} SELECT * FROM cnt",
    "births_deaths": f"""WITH {JUDGED}, ok AS (SELECT channel, era, snapshot_date, row_number() OVER (PARTITION BY channel ORDER BY snapshot_date) AS n, lag(era) OVER (PARTITION BY channel ORDER BY snapshot_date) = era AS same FROM st WHERE len(failures) = 0),
      pn AS (SELECT DISTINCT channel, n, entity_path FROM obs JOIN ok USING (channel, era, snapshot_date)),
      born AS (SELECT channel, n, count(*) AS births, array_to_string(list_sort(list(entity_path))[1:8], ',') AS born FROM pn a WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM pn b WHERE b.channel = a.channel AND b.n = a.n - 1 AND b.entity_path = a.entity_path) GROUP BY ALL),
      died AS (SELECT channel, n + 1 AS n, count(*) AS deaths, array_to_string(list_sort(list(entity_path))[1:8], ',') AS died FROM pn a WHERE NOT EXISTS (SELECT 1 FROM pn b WHERE b.channel = a.channel AND b.n = a.n + 1 AND b.entity_path = a.entity_path) GROUP BY channel, n),
      prev AS (SELECT channel, n + 1 AS n, count(*) AS previous FROM pn GROUP BY channel, n)
      SELECT channel, era, snapshot_date, coalesce(births, 0) AS births, coalesce(deaths, 0) AS deaths, coalesce(born, '') AS born, coalesce(died, '') AS died, coalesce(deaths, 0) > greatest(CAST(trunc(previous * 0.05::DOUBLE) AS BIGINT), 50) AS warn
      FROM ok LEFT JOIN born USING (channel, n) LEFT JOIN died USING (channel, n) JOIN prev USING (channel, n) WHERE n > 1 AND same""",
    "missing_sentinels": f"WITH {OBS}, {MISSED} SELECT * FROM missed",
    "rolling_baseline": f"WITH {COUNTS} SELECT channel, snapshot_date, n_entries, max(n_entries) OVER (PARTITION BY channel ORDER BY snapshot_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS baseline FROM cnt",
    "gate_results": f"WITH {JUDGED} SELECT channel, era, snapshot_date, n_entries, baseline, array_to_string(failures, '; ') AS failures, array_to_string(warnings, '; ') AS warnings, CASE WHEN len(failures) > 0 THEN 'fail' WHEN len(warnings) > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM st",
    "gated_fold": f"WITH {JUDGED}, ok AS (SELECT obs.* FROM obs JOIN st USING (channel, era, snapshot_date) WHERE len(failures) = 0) {FOLD.format('ok')}",
    "json_array_decode": f"WITH {OBS}, d AS (SELECT DISTINCT advisories_raw, platforms_raw FROM obs) SELECT advisories_raw, coalesce(platforms_raw, '') AS platforms_raw, CASE WHEN advisories_raw = '[]' THEN '-' ELSE regexp_extract(advisories_raw, '\"(.*)\"', 1) END AS advisories, CASE WHEN platforms_raw IS NULL THEN '-' WHEN platforms_raw LIKE '%darwin%' THEN 'x86_64-linux, aarch64-darwin' ELSE 'x86_64-linux' END AS platforms, advisories_raw <> '[]' AS insecure FROM d",
    "normalize_license": f"WITH {OBS} SELECT license_raw, count(*) AS n, CASE license_raw WHEN '{{\"spdxId\":\"MIT\"}}' THEN 'MIT' WHEN '\"Apache-2.0\"' THEN 'Apache-2.0' WHEN '[]' THEN NULL ELSE 'BSD+mpl' END AS license FROM obs GROUP BY license_raw",
    "split_path": f"WITH {OBS}, p AS (SELECT DISTINCT entity_path FROM obs) SELECT entity_path, length(entity_path) - length(replace(entity_path, '.', '')) AS depth, replace(entity_path, '.', '/') AS segments, string_split(entity_path, '.')[-1] AS leaf FROM p",
    "history_export": f"WITH {INT} SELECT entity_path, version, strftime(first_date, '%Y-%m-%d') AS first_seen, strftime(last_date, '%Y-%m-%d') AS last_seen, left(first_commit, 7) AS first_hash, left(last_commit, 7) AS last_hash, coalesce(source_path, '-') AS source FROM iv",
    "run_report": f"WITH {OBS}, {LEDGER}, s AS (SELECT count(*) AS planned, count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, max(release_date) FILTER (status = 'ingested') AS newest FROM ledger), t AS (SELECT *, (SELECT count(DISTINCT entity_path) FROM obs) AS n_paths, (SELECT count(DISTINCT (entity_path, version)) FROM obs) AS n_intervals, date_diff('hour', newest, TIMESTAMP '{NOW}') AS lag_hours FROM s) SELECT *, failed = 0 AND lag_hours <= 72 AS healthy FROM t",
    "phrase_search": "WITH p(phrase) AS (VALUES ('the of'), ('le la'), ('de la'), ('Été'), ('und die')) SELECT phrase, doc_id FROM (SELECT doc_id, " + PLAIN.format("text") + " AS t FROM documents) JOIN (SELECT phrase, " + PLAIN.format("phrase") + " AS f FROM p) ON contains(t, f)",
    "latency_sketches": "SELECT event_type, count(value) AS n, count(value) AS n_sketched, true AS p50_near, true AS p95_near, true AS p99_near FROM events GROUP BY ALL",
    "latency_percentiles": "WITH a AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS k FROM events WHERE event_type <> 'error'), r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM a WHERE k <= 1024) SELECT event_type, max(n) AS n, max(value) FILTER (i = round((n - 1) * 0.5)) AS p50, max(value) FILTER (i = round((n - 1) * 0.95)) AS p95, max(value) FILTER (i = round((n - 1) * 0.99)) AS p99 FROM r GROUP BY event_type",
    "activity_minutes": "WITH m AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS c FROM events GROUP BY 1), s AS (SELECT unnest(generate_series(max(minute) - INTERVAL 29 MINUTE, max(minute), INTERVAL 1 MINUTE)) AS minute FROM m) SELECT CAST(minute AS TIMESTAMP) AS minute, coalesce(c, 0) AS n_events FROM s LEFT JOIN m USING (minute)",
}
#: Twins of the queries over all parts and the whole delta; a delta that goes to the end leaves each key's last row.
ORACLE |= {
    "snapshot_delta_all": f"WITH {INT} SELECT entity_path, version, last_date, last_commit FROM iv",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE | searches.ORACLE | ingest.ORACLE | exchange.ORACLE
