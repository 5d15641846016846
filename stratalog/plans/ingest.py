"""Queries that list, normalize, ingest and stream snapshots, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import fold, gate, ledger, search, text
from ..session import shared_dir, state_of, stored
from ..sources import snapshots, versions
from ..sources.adapters import INT, OBS, observations, table
from ..streaming import jobs
from . import index_run

NOW = "2002-01-15 00:00:00"
FLOORS = {"bare": ((1993, 20), (None, 30)), "envelope": ((1999, 30), (2000, 40), (None, 60))}
DENIED, BROKEN, LINES, SHARED = "F-1994-05", ("O-1998-02", "F-2000-05"), "1999-01-01", "R-1995-06"
#: Where the first of the two index runs ends.
CUT = "1996-12-31"
RUNS: dict[tuple, tuple[str, list[DataFrame]]] = {}


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratalog-{name}-{uuid.uuid4().hex}"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def listed(spark, d):
    """Orders as a listing: priorities as channels, names of all shapes, good and bad ones, and commits."""
    key, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    sha = F.sha1(key)
    name = F.when(n == 0, F.concat(F.lit("nixos-20.03pre"), key, F.lit("."), F.substring(sha, 1, 7))).when(n == 1, F.concat(F.lit("nixpkgs-21.11."), key, F.lit("."), F.substring(sha, 1, 12))).when(n == 2, F.concat(F.lit("nixos-19.09beta"), key, F.lit("."), F.substring(sha, 1, 9)))
    name = name.when(n == 3, F.concat(F.lit("nixpkgs-1.0pre"), key, F.lit("_"), F.substring(sha, 1, 7))).when(n == 4, F.concat(F.lit("nixos-20.03pre"), key, F.lit(".zz"))).otherwise(F.concat(F.lit("nixos-20.03pre"), key, F.lit(".abcdef1")))
    commit = F.when(F.col("o_orderkey") % 7 == 0, F.substring(sha, 1, 39)).otherwise(sha)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("channel"), name.alias("release_name"), commit.alias("commit_hash"), F.col("o_orderdate").alias("release_date"))


def discover_releases(spark, d):
    rows = listed(spark, d)
    return ledger.discover(rows, rows.filter("key % 11 = 0")).select("channel", "release_name", "commit_count", "rev")


def refused_releases(spark, d):
    return ledger.refused(listed(spark, d))


def book(spark, d):
    """Orders as a ledger, with eras and attempts."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ingested").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("channel"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("release_name"), F.col("o_orderdate").alias("release_date"), F.when(F.col("o_custkey") % 2 == 0, "bare").otherwise("envelope").alias("era"), status.alias("status"), F.when(status == "failed", F.col("o_custkey") % 5).otherwise(0).cast("int").alias("attempts"), F.col("o_orderdate").alias("last_attempt_at"))


def ledger_window(spark, d):
    """What a run with dates, channels, an era and a bound takes; the bound is the feature."""
    got = ledger.windowed(book(spark, d), E.date_arg(F.lit("1995-01-01")), E.date_arg(F.lit("1998-06-30T00:00:00Z")), ("1-URGENT", "5-LOW"), ("bare",), 500)
    return got.select("channel", "release_name", "release_date", "status")


def denied_releases(spark, d):
    deny = book(spark, d).filter("key % 13 = 0").select("release_name", F.lit("known to be malformed").alias("reason"))
    return ledger.deny(book(spark, d), deny).select("channel", "release_name", "status", F.coalesce("error", F.lit("-")).alias("error"))


def requeued_releases(spark, d):
    return ledger.requeue(book(spark, d)).groupBy("channel", "status").agg(F.count("*").alias("n_rows"), F.sum("attempts").alias("attempts"), F.count("last_attempt_at").alias("tried"))


def settled_releases(spark, d):
    """Every third row was tried, every ninth without success."""
    tried = book(spark, d).filter("key % 3 = 0 and status <> 'ingested'").select("channel", "release_name", (F.col("key") % 100).alias("n_entries"), F.when(F.col("key") % 9 == 0, "count under floor").alias("error"))
    return ledger.settled(book(spark, d), tried, ntz(NOW)).select("channel", "release_name", "status", "attempts", "last_attempt_at", F.coalesce("n_entries", F.lit(-1)).alias("n_entries"), F.coalesce("error", F.lit("-")).alias("error"))


def dedupe_dry_run(spark, d):
    """What the duplicate repair would do, per channel folded apart; nothing is written."""
    o = observations(spark, d, True)
    per = o.groupBy("channel", "entity_path", "version").agg(F.min("snapshot_date").alias("first_date"), F.min_by("commit_hash", "ord").alias("first_commit"), F.max("snapshot_date").alias("last_date"), F.max_by("commit_hash", "ord").alias("last_commit"), F.min("description").alias("description"))
    return fold.dedupe(per, dry_run=True)


def raw_entries(spark, d):
    """Parts as raw entries in all forms that entries come in."""
    m = F.col("p_partkey") % 12
    path, key = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string")
    raw = F.when(m % 4 == 0, path).when(m % 4 == 1, F.concat(F.lit('set."a.b".'), path)).when(m % 4 == 2, F.concat(path, F.lit('."or"'))).otherwise(F.concat(F.lit(r'x."q\"r".'), path))
    size = F.col("p_size").cast("string")
    name = F.when(m == 7, path).otherwise(F.concat(path, F.lit("-"), size, F.lit(".1-2b")))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    field = lambda k, c: F.concat(F.lit(f'"{k}":'), c)
    pick = lambda n, *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (m % n + 1).cast("int"))
    meta = F.concat_ws(
        ",", field("description", text(F.col("p_name"))), field("homepage", pick(3, text(F.concat(F.lit("https://h/"), key)), '["https://l/1","x"]', "null")),
        field("license", pick(4, '{"spdxId":"MIT"}', '["BSD",{"shortName":"mpl"},{"fullName":"Full"}]', '"Apache"', "[]")),
        field("maintainers", pick(3, '[{"github":"gh1","name":"N"},{"email":"e@x"}]', '["plain"]', "null")), field("platforms", pick(3, '"x86_64-linux"', '["a",{"system":"b"}]', "[]")),
        field("position", pick(4, '"/b/pkgs/x/d.nix:12"', '"/b/nixos/m.nix:"', '"/else/where.nix:3"', "null")), field("knownVulnerabilities", pick(5, '["CVE-1","CVE-2"]', "[]", "null", "null", "null")),
    )
    entry = F.concat(F.lit("{"), F.concat_ws(",", field("name", text(name)), field("pname", pick(3, '""', text(F.concat(F.lit("pn"), key)), "null")), field("version", F.when((m % 4 == 0) | (m == 7), "null").when(m % 4 == 1, '""').otherwise(text(F.concat(size, F.lit("."), m.cast("string"))))), F.concat(F.lit('"meta":{'), meta, F.lit("}"))), F.lit("}"))
    return table(spark, d, "part").select(key.alias("file"), raw.alias("raw_path"), F.parse_json(entry).alias("entry"))


def normalize_entries(spark, d):
    out = snapshots.normalize(raw_entries(spark, d))
    several = [F.coalesce(F.array_join(c, "+"), F.lit("-")).alias(c) for c in ("license", "maintainers", "platforms", "advisories")]
    return out.select(F.col("file").cast("bigint").alias("p_partkey"), "entity_path", "name", "version", "description", F.coalesce("homepage", F.lit("-")).alias("homepage"), F.coalesce("source_path", F.lit("-")).alias("source_path"), *several)


def column_helpers(spark, d):
    """Dates as arguments, storage prefixes, commit labels, encoded arrays, milliseconds and shared beginnings, on orders."""
    n = F.col("o_orderkey") % 3
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    given = F.when(n == 0, day).when(n == 1, F.concat(day, F.lit("T06:30:00Z"))).otherwise(F.concat(day, F.lit("T06:30:00.250+01:00")))
    channel = F.when(n == 0, "nixpkgs-unstable").otherwise(F.concat(F.lit("nixos-"), F.lower("o_orderstatus")))
    sha = F.sha1(F.col("o_orderkey").cast("string"))
    words = F.filter(F.split("o_orderpriority", "[- ]"), lambda x: (x != "") & (n > 0))
    return table(spark, d, "orders").select("o_orderkey", E.date_arg(given).alias("given"), E.channel_prefix(channel).alias("place"), E.commit_label(sha).alias("label"), F.coalesce(E.encode_array(words), F.lit("-")).alias("words"), E.micros_to_millis(F.col("o_orderkey") * 999_983).alias("millis"), E.shared_prefix(F.concat(F.lit("4-not "), "o_orderstatus"), F.col("o_orderpriority")).alias("shared"))


def documents(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Snapshot documents from the observations (one version per path, the greatest), and their listing.

    Those before 1996 are bare maps, those before 1999 envelopes, each one row as in its source, and the later ones have one entity per line, dealt over several files. Two are cut short.
    Septembers have a second release of the same date (``-c``, the least versions), and Junes from 1996 on one that lacks paths of odd length (``-b``); one name stands for a
    release of either channel.
    """
    month, year = F.month("snapshot_date"), F.year("snapshot_date")
    rows = observations(spark, d).groupBy("channel", "era", "snapshot_date", "entity_path").agg(F.max("version").alias("version"), F.min("version").alias("low"))
    also = F.when(month == 9, F.array(F.lit(""), F.lit("-c"))).when((month == 6) & (year >= 1996) & (F.length("entity_path") % 2 == 0), F.array(F.lit(""), F.lit("-b"))).otherwise(F.array(F.lit("")))
    rows = rows.withColumn("again", F.explode(also)).withColumn("version", F.when(F.col("again") == "-c", F.col("low")).otherwise(F.col("version")))
    entry = F.struct(F.lit(None).cast("string").alias("name"), "version", F.struct(F.concat(F.lit("/b/pkgs/"), F.col("entity_path"), F.lit(":1")).alias("position")).alias("meta")).alias("entry")
    base = F.when(F.date_format("snapshot_date", "yyyy-MM") == SHARED[2:], SHARED).otherwise(F.concat("channel", F.lit("-"), F.date_format("snapshot_date", "yyyy-MM")))
    rows = stored(rows.select("*", entry, F.concat(base, "again").alias("release_name")))
    path, by_line = folder(spark, "documents"), F.col("snapshot_date") >= ntz(LINES)
    maps = rows.filter(~by_line).groupBy("channel", "release_name", "era").agg(F.map_from_entries(F.collect_list(F.struct("entity_path", "entry"))).alias("packages"))
    text = F.when(F.col("era") == "bare", F.to_json("packages")).otherwise(F.to_json(F.struct("packages", F.lit("2").alias("version"))))
    text = F.when(F.col("release_name") == BROKEN[0], F.left(text, F.length(text) - 20)).otherwise(text)
    maps.select("channel", F.concat("release_name", F.lit(".json")).alias("doc"), text.alias("text")).repartition("channel", "doc").write.partitionBy("channel", "doc").text(path)
    lines = rows.filter(by_line).select("channel", "release_name", F.to_json(F.struct(F.col("entity_path").alias("path"), "entry")).alias("text"))
    ends = rows.filter(by_line & (F.col("release_name") != BROKEN[1])).groupBy("channel", "release_name").agg(F.to_json(F.struct(F.count("*").alias("entries"))).alias("text"))
    part = F.pmod(F.xxhash64("text"), F.lit(3))
    lines.unionByName(ends).select("channel", F.concat("release_name", F.lit(".jsonl")).alias("doc"), "text").repartition("channel", "doc", part).write.mode("append").partitionBy("channel", "doc").text(path)
    listing = rows.select("channel", "era", "snapshot_date", "release_name").distinct()
    return path, stored(listing.select("channel", "release_name", F.sha1("release_name").alias("commit_hash"), F.col("snapshot_date").alias("release_date"), "era"))


def indexed(spark: SparkSession, d: str) -> tuple[str, list[DataFrame]]:
    """Two runs of the index over all snapshots, the first up to 1996, once per application and state of the tables: where it is published, and the reports."""
    key = spark.sparkContext.applicationId, d, state_of(spark, d)
    if key not in RUNS:
        path, listing = documents(spark, d)
        store, now = folder(spark, "index"), ntz(NOW)
        floors, denylist = gate.floor_ladder(spark, FLOORS), spark.createDataFrame([(DENIED, "known to be malformed")], "release_name string, reason string")
        given = {"floors": floors, "denylist": denylist, "parse": False}
        reports = [index_run.run(spark, listing, path, store, now, **given, options=index_run.Options(until=until, buckets=4, tokens=True, turnover=True)) for until in (CUT, None)]
        RUNS[key] = store, reports
    return RUNS[key]


def index_intervals(spark, d):
    return snapshots.read_intervals(spark, indexed(spark, d)[0]).select("entity_path", "version", "first_date", "first_commit", "last_date", "last_commit", "source_path")


def index_caught_up(spark, d):
    """A reader of the first version, brought up to the newest by the published deltas."""
    store = indexed(spark, d)[0]
    first = versions.versions(spark, store)[0]
    have = versions.read_table(spark, store, "bounds", first)
    return fold.intervals(versions.catch_up(spark, store, "bounds", have, first, fold.KEY)).select("entity_path", "version", "first_date", "first_commit", "last_date", "last_commit", "source_path")


def index_turnover(spark, d):
    """Births and deaths between accepted releases, each run having compared those that it changed."""
    out = snapshots.read_published(spark, indexed(spark, d)[0], "turnover")
    return out.select("channel", "release_name", "births", "deaths", "warn")


def index_statistics(spark, d):
    """Statistics as the second run left them, distinct numbers by counts that moved with the changes."""
    return snapshots.statistics(spark, indexed(spark, d)[0])


def index_phrases(spark, d):
    """Every part's name and first word as phrases, looked up in the words that the index run keeps with their places."""
    words = F.split("p_name", " ")
    p = table(spark, d, "part")
    asked = p.select((F.col("p_partkey") * 2).cast("bigint").alias("request_id"), F.upper("p_name").alias("phrase")).unionByName(p.filter("p_partkey % 100 = 0").select((F.col("p_partkey") * 2 + 1).cast("bigint").alias("request_id"), words[0].alias("phrase")))
    tokens = snapshots.read_published(spark, indexed(spark, d)[0], "tokens")
    return search.answered(asked, lambda phrases: text.phrase_hits(tokens, phrases).groupBy("request_id").agg(F.count("*").alias("n_intervals"), F.min("entity_path").alias("first_path")))


def index_changes(spark, d):
    """What the deltas from the first version on say."""
    store = indexed(spark, d)[0]
    steps = versions.deltas(spark, store, "bounds", versions.versions(spark, store)[0])
    return versions.composed(steps, fold.KEY).select("op", "entity_path", "version", F.col("last_ord.snapshot_date").alias("last_date"))


def index_damage(spark, d):
    """Files of the newest version by table, as listed and as they are: none is missing, changed or extra."""
    store = indexed(spark, d)[0]
    bad = versions.verify(spark, store).groupBy(F.split("file", "/")[1].alias("table")).agg(F.count("*").alias("n_bad"))
    listed = versions.manifest(spark, store, versions.newest_version(spark, store)).filter("file is not null and `from` is null").select("table").distinct()
    return listed.join(bad, "table", "left").select("table", F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def index_ledger(spark, d):
    return snapshots.read_published(spark, indexed(spark, d)[0], "ledger").select("channel", "release_name", "era", "status", "attempts", F.coalesce("n_entries", F.lit(-1)).alias("n_entries"), F.coalesce("error", F.lit("-")).alias("error"))


def index_report(spark, d):
    """The second run's report; the lag makes it unhealthy."""
    return indexed(spark, d)[1][1].select("planned", "ingested", "failed", "skipped", "unsettled", "n_paths", "n_intervals", "lag_hours", "healthy")


def index_paths(spark, d):
    return snapshots.read_published(spark, indexed(spark, d)[0], "paths")


#: Batches that the streamed observations come in, and rows of one of their files.
WAVES, STREAM_ROWS = 3, 500_000


def file_count(n_rows: int) -> int:
    """Files of a stream, so many that a task writes few rows, however many there are: two a batch at least."""
    return max(2 * WAVES, -(-n_rows // STREAM_ROWS))


def stream_fold(spark, d):
    """All observations as a stream of files, folded batch by batch."""
    rows = observations(spark, d)
    path, store = folder(spark, "obs"), folder(spark, "bounds")
    files = file_count(table(spark, d, "lineitem").count())
    rows.repartition(files).write.parquet(path)
    jobs.fold_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // WAVES)).parquet(path), store, folder(spark, "checkpoint"), buckets=4).awaitTermination()
    return fold.intervals(snapshots.read_published(spark, store, "bounds")).select("entity_path", "version", "first_date", "first_commit", "last_date", "last_commit", "source_path")


def stream_gate(spark, d):
    """All snapshots as a stream in no order, each held until those listed before it have come, and judged then."""
    rows = observations(spark, d)
    path, store, checkpoint = folder(spark, "snapshots"), folder(spark, "gated"), folder(spark, "checkpoint")
    expected = stored(rows.select(*gate.SNAPSHOT).distinct())
    files, wave = file_count(table(spark, d, "lineitem").count()) // WAVES, F.pmod(F.xxhash64("snapshot_date", "channel"), F.lit(WAVES))
    for n in range(WAVES):  # a snapshot lies in one batch whole, in files of many tasks
        rows.filter(wave == n).repartition(files).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        jobs.fold_stream(stream, store, checkpoint, gated=True, floors=gate.floor_ladder(spark, FLOORS), expected=expected, buckets=4).awaitTermination()
    return snapshots.read_published(spark, store, "ledger").select(*gate.SNAPSHOT, "n_entries", "status")


def stream_activity(spark, d):
    """Events as a stream of files, counted per minute."""
    rows = table(spark, d, "events").select("ts")
    path, store = folder(spark, "events"), folder(spark, "minutes")
    rows.repartition(4).write.parquet(path)
    counts = jobs.activity_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path), delay="100 days")
    jobs.keep_counts(counts, store, folder(spark, "checkpoint"), buckets=4).awaitTermination()
    return snapshots.read_published(spark, store, "minutes")


QUERIES = (discover_releases, refused_releases, ledger_window, denied_releases, requeued_releases, settled_releases, dedupe_dry_run, normalize_entries, column_helpers, index_intervals, index_caught_up, index_turnover, index_statistics, index_phrases, index_changes, index_damage, index_ledger, index_report, index_paths, stream_fold, stream_gate, stream_activity)

LISTED = """o AS (SELECT *, sha1(CAST(o_orderkey AS VARCHAR)) AS sha, CAST(o_orderkey AS VARCHAR) AS key FROM orders),
l AS (SELECT o_orderkey, o_orderpriority AS channel, CASE o_orderkey % 6 WHEN 0 THEN 'nixos-20.03pre' || key || '.' || left(sha, 7) WHEN 1 THEN 'nixpkgs-21.11.' || key || '.' || left(sha, 12) WHEN 2 THEN 'nixos-19.09beta' || key || '.' || left(sha, 9) WHEN 3 THEN 'nixpkgs-1.0pre' || key || '_' || left(sha, 7) WHEN 4 THEN 'nixos-20.03pre' || key || '.zz' ELSE 'nixos-20.03pre' || key || '.abcdef1' END AS release_name,
  left(sha, CASE o_orderkey % 6 WHEN 0 THEN 7 WHEN 1 THEN 12 ELSE 9 END) AS rev, CASE WHEN o_orderkey % 6 IN (3, 4) THEN 'name' WHEN o_orderkey % 7 = 0 THEN 'commit' WHEN o_orderkey % 6 = 5 THEN 'revision' END AS refused FROM o)"""
BOOK = "b AS (SELECT o_orderkey AS key, o_orderpriority AS channel, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS release_name, o_orderdate AS release_date, CASE WHEN o_custkey % 2 = 0 THEN 'bare' ELSE 'envelope' END AS era, CASE o_orderstatus WHEN 'F' THEN 'ingested' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, CAST(CASE WHEN o_orderstatus = 'O' THEN o_custkey % 5 ELSE 0 END AS INT) AS attempts FROM orders)"
FULL = "SELECT entity_path, version, min(snapshot_date) AS first_date, arg_min(commit_hash, ord) AS first_commit, max(snapshot_date) AS last_date, arg_max(commit_hash, ord) AS last_commit, arg_max(source_path, ord) FILTER (source_path IS NOT NULL) AS source_path FROM {} GROUP BY entity_path, version"
#: The gate with feedback over snapshots ``cnt``: ``st`` has each one's failures.
GATE = """floors(era, y1, y2, floor) AS (VALUES ('bare', 0, 1993, 20), ('bare', 1994, 9999, 30), ('envelope', 0, 1999, 30), ('envelope', 2000, 2000, 40), ('envelope', 2001, 9999, 60)),
sn AS (SELECT cnt.*, CASE WHEN n_entries < floor THEN ['count ' || n_entries || ' under floor ' || floor] ELSE CAST([] AS VARCHAR[]) END AS pre, row_number() OVER (PARTITION BY channel, cnt.era ORDER BY snapshot_date, release_name) AS n FROM cnt JOIN floors ON cnt.era = floors.era AND year(snapshot_date) BETWEEN y1 AND y2),
st AS (SELECT channel, era, snapshot_date, release_name, n_entries, n, list_sort(pre) AS failures, CASE WHEN len(pre) > 0 THEN CAST([] AS BIGINT[]) ELSE [n_entries] END AS recent FROM sn WHERE n = 1
  UNION ALL SELECT channel, era, snapshot_date, release_name, n_entries, n, failures, CASE WHEN len(failures) > 0 THEN recent ELSE list_append(recent, n_entries)[-10:] END FROM (
    SELECT *, list_sort(CASE WHEN coalesce(n_entries < CAST(trunc(base * 0.70::DOUBLE) AS BIGINT), false) THEN list_append(pre, 'count ' || n_entries || ' under 70% of ' || base) ELSE pre END) AS failures
    FROM (SELECT sn.*, list_max(st.recent) AS base, st.recent FROM st JOIN sn ON sn.channel = st.channel AND sn.era = st.era AND sn.n = st.n + 1)))"""
RECURSIVE = OBS.replace("j AS", "RECURSIVE j AS", 1)
#: Observations of the documents, the gate over them, and the ledger that follows.
RUN = RECURSIVE + f""",
nm AS (SELECT channel, era, snapshot_date, entity_path, max(version) AS version, min(version) AS low, CASE WHEN strftime(snapshot_date, '%Y-%m') = '{SHARED[2:]}' THEN '{SHARED}' ELSE channel || '-' || strftime(snapshot_date, '%Y-%m') END AS base FROM obs GROUP BY ALL),
dv AS (SELECT channel, era, snapshot_date, entity_path, version, base AS release_name FROM nm UNION ALL SELECT channel, era, snapshot_date, entity_path, low, base || '-c' FROM nm WHERE month(snapshot_date) = 9
  UNION ALL SELECT channel, era, snapshot_date, entity_path, version, base || '-b' FROM nm WHERE month(snapshot_date) = 6 AND year(snapshot_date) >= 1996 AND length(entity_path) % 2 = 0),
cnt AS (SELECT channel, era, snapshot_date, release_name, count(*) AS n_entries FROM dv WHERE release_name NOT IN ('{DENIED}', '{BROKEN[0]}', '{BROKEN[1]}') GROUP BY ALL),
{GATE},
lb AS (SELECT DISTINCT dv.channel, dv.release_name, dv.era, dv.snapshot_date, CASE WHEN dv.release_name = '{DENIED}' THEN 'skipped' WHEN dv.release_name IN ('{BROKEN[0]}', '{BROKEN[1]}') OR len(failures) > 0 THEN 'failed' ELSE 'ingested' END AS status,
  st.n_entries, CASE WHEN dv.release_name = '{DENIED}' THEN 'known to be malformed' WHEN dv.release_name IN ('{BROKEN[0]}', '{BROKEN[1]}') THEN 'malformed document' WHEN len(failures) > 0 THEN array_to_string(failures, '; ') END AS error FROM dv LEFT JOIN st USING (channel, release_name)),
ok AS (SELECT dv.* FROM dv JOIN (SELECT channel, release_name FROM lb WHERE status = 'ingested') USING (channel, release_name)),
iv2 AS (SELECT entity_path, version, min(snapshot_date) AS first_date, sha1(arg_min(release_name, row(snapshot_date, channel, release_name))) AS first_commit, max(snapshot_date) AS last_date, sha1(arg_max(release_name, row(snapshot_date, channel, release_name))) AS last_commit, 'pkgs/' || entity_path AS source_path FROM ok GROUP BY entity_path, version)"""
ORACLE = {
    "discover_releases": f"WITH {LISTED} SELECT channel, release_name, o_orderkey AS commit_count, rev FROM l WHERE refused IS NULL AND o_orderkey % 11 <> 0",
    "refused_releases": f"WITH {LISTED} SELECT channel, refused, count(*) AS n_rows FROM l WHERE refused IS NOT NULL GROUP BY ALL",
    "ledger_window": f"WITH {BOOK} SELECT channel, release_name, release_date, status FROM b WHERE release_date BETWEEN DATE '1995-01-01' AND DATE '1998-06-30' AND channel IN ('1-URGENT', '5-LOW') AND era = 'bare' ORDER BY release_date, channel, release_name LIMIT 500",
    "denied_releases": f"WITH {BOOK} SELECT channel, release_name, CASE WHEN key % 13 = 0 AND status <> 'ingested' THEN 'skipped' ELSE status END AS status, CASE WHEN key % 13 = 0 AND status <> 'ingested' THEN 'known to be malformed' ELSE '-' END AS error FROM b",
    "requeued_releases": "SELECT o_orderpriority AS channel, 'pending' AS status, count(*) AS n_rows, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS tried FROM orders GROUP BY ALL",
    "settled_releases": f"WITH {BOOK}, t AS (SELECT *, key % 3 = 0 AND status <> 'ingested' AS tried, key % 9 = 0 AS bad FROM b) SELECT channel, release_name, CASE WHEN NOT tried THEN status WHEN NOT bad THEN 'ingested' WHEN attempts + 1 >= 5 THEN 'skipped' ELSE 'failed' END AS status, CAST(attempts + CASE WHEN tried THEN 1 ELSE 0 END AS INT) AS attempts, CASE WHEN tried THEN TIMESTAMP '{NOW}' ELSE release_date END AS last_attempt_at, CASE WHEN tried THEN key % 100 ELSE -1 END AS n_entries, CASE WHEN tried AND bad THEN 'count under floor' ELSE '-' END AS error FROM t",
    "dedupe_dry_run": f"WITH {OBS}, pc AS (SELECT DISTINCT channel, entity_path, version FROM obs), dd AS (SELECT count(*) AS n_rows FROM pc GROUP BY entity_path, version) SELECT count(*) AS n_groups, count(*) FILTER (n_rows > 1) AS groups_with_duplicates, CAST(sum(n_rows) AS BIGINT) AS rows_before, CAST(sum(n_rows) AS BIGINT) AS rows_after, CAST(0 AS BIGINT) AS rows_updated, CAST(0 AS BIGINT) AS rows_deleted FROM dd",
    "normalize_entries": r"""WITH p AS (SELECT *, p_partkey % 12 AS m, replace(p_name, ' ', '-') AS path FROM part),
      v AS (SELECT *, CASE WHEN m = 7 THEN NULL WHEN m % 4 IN (0, 1) THEN p_size || '.1-2b' ELSE p_size || '.' || m END AS version FROM p)
      SELECT p_partkey, CASE m % 4 WHEN 0 THEN path WHEN 1 THEN 'set.a.b.' || path WHEN 2 THEN path || '.or' ELSE 'x.q"r.' || path END AS entity_path,
        CASE WHEN m % 4 = 2 THEN 'or' WHEN m % 4 <> 0 THEN path WHEN m % 3 = 1 THEN 'pn' || p_partkey ELSE path END AS name, version, p_name AS description,
        CASE m % 3 WHEN 0 THEN 'https://h/' || p_partkey WHEN 1 THEN 'https://l/1' ELSE '-' END AS homepage, CASE m % 4 WHEN 0 THEN 'pkgs/x/d.nix' WHEN 1 THEN 'nixos/m.nix' ELSE '-' END AS source_path,
        CASE m % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'BSD+mpl+Full' WHEN 2 THEN 'Apache' ELSE '-' END AS license, CASE m % 3 WHEN 0 THEN 'gh1+e@x' WHEN 1 THEN 'plain' ELSE '-' END AS maintainers,
        CASE m % 3 WHEN 0 THEN 'x86_64-linux' WHEN 1 THEN 'a+b' ELSE '-' END AS platforms, CASE m % 5 WHEN 0 THEN 'CVE-1+CVE-2' ELSE '-' END AS advisories FROM v WHERE version IS NOT NULL""",
    "column_helpers": """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL '6 hours 30 minutes' ELSE o_orderdate + INTERVAL '5 hours 30 minutes' + INTERVAL 250 MILLISECOND END AS TIMESTAMP) AS given,
      CASE o_orderkey % 3 WHEN 0 THEN 'nixpkgs/' ELSE 'nixos/' || lower(o_orderstatus) || '/' END AS place, 'master-' || left(sha1(CAST(o_orderkey AS VARCHAR)), 12) AS label,
      CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '["' || replace(replace(o_orderpriority, ' ', '-'), '-', '","') || '"]' END AS words, least(o_orderkey * 999983, 4294967295) / 1000.0::DOUBLE AS millis,
      CAST(CASE WHEN left(o_orderpriority, 2) <> '4-' THEN 0 WHEN o_orderstatus = 'S' THEN 7 ELSE 6 END AS BIGINT) AS shared FROM orders""",
    "index_intervals": f"WITH {RUN} SELECT * FROM iv2",
    "index_caught_up": f"WITH {RUN} SELECT * FROM iv2",
    "index_turnover": f"""WITH {RUN}, o AS (SELECT channel, era, release_name, row_number() OVER w AS n, lag(era) OVER w = era AS same FROM (SELECT * FROM lb WHERE status = 'ingested') WINDOW w AS (PARTITION BY channel ORDER BY snapshot_date, release_name)),
      pr AS (SELECT DISTINCT o.channel, n, entity_path FROM ok JOIN o USING (channel, release_name)), sz AS (SELECT channel, n, count(*) AS size FROM pr GROUP BY ALL),
      b AS (SELECT channel, n, count(*) AS births FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.channel = pr.channel AND q.n = pr.n - 1 AND q.entity_path = pr.entity_path) GROUP BY ALL),
      e AS (SELECT channel, n + 1 AS n, count(*) AS deaths FROM pr WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.channel = pr.channel AND q.n = pr.n + 1 AND q.entity_path = pr.entity_path) GROUP BY ALL)
      SELECT o.channel, release_name, coalesce(births, 0) AS births, coalesce(deaths, 0) AS deaths, coalesce(deaths, 0) > greatest(CAST(trunc(size * 0.05::DOUBLE) AS BIGINT), 50) AS warn
      FROM o JOIN sz ON sz.channel = o.channel AND sz.n = o.n - 1 LEFT JOIN b ON b.channel = o.channel AND b.n = o.n LEFT JOIN e ON e.channel = o.channel AND e.n = o.n WHERE same""",
    "index_statistics": f"WITH {RUN} SELECT count(*) AS n_rows, count(DISTINCT string_split(entity_path, '.')[-1]) AS n_names, count(DISTINCT version) AS n_versions, min(first_date) AS first_date, max(last_date) AS last_date FROM iv2",
    "index_phrases": f"""WITH {RUN}, t AS (SELECT entity_path, version, ' ' || replace(string_split(entity_path, '.')[-1], '-', ' ') || ' ' AS name FROM iv2),
      rq AS (SELECT CAST(p_partkey * 2 AS BIGINT) AS request_id, ' ' || p_name || ' ' AS f FROM part UNION ALL SELECT CAST(p_partkey * 2 + 1 AS BIGINT), ' ' || string_split(p_name, ' ')[1] || ' ' FROM part WHERE p_partkey % 100 = 0)
      SELECT request_id, count(*) AS n_intervals, min(entity_path) AS first_path FROM t JOIN rq ON contains(name, f) GROUP BY request_id""",
    "index_changes": f"WITH {RUN} SELECT CASE WHEN min(snapshot_date) > DATE '{CUT}' THEN 'insert' ELSE 'change' END AS op, entity_path, version, max(snapshot_date) AS last_date FROM ok GROUP BY entity_path, version HAVING max(snapshot_date) > DATE '{CUT}'",
    "index_damage": "SELECT unnest(['bounds', 'paths', 'counts', 'tokens', 'ledger', 'stats', 'turnover']) AS \"table\", CAST(0 AS BIGINT) AS n_bad",
    "index_ledger": f"WITH {RUN} SELECT channel, release_name, era, status, CAST(CASE WHEN status = 'skipped' THEN 0 ELSE 1 END AS INT) AS attempts, coalesce(n_entries, -1) AS n_entries, coalesce(error, '-') AS error FROM lb",
    "index_report": f"""WITH {RUN}, p AS (SELECT * FROM lb WHERE snapshot_date > DATE '1996-12-31' AND status <> 'skipped'), m AS (SELECT max(snapshot_date) AS mark FROM lb WHERE status = 'ingested')
      SELECT count(*) AS planned, count(*) FILTER (status = 'ingested') AS ingested, count(*) FILTER (status = 'failed') AS failed, CAST(0 AS BIGINT) AS skipped, (SELECT count(*) FROM lb, m WHERE status = 'failed' AND snapshot_date < mark) AS unsettled,
      (SELECT count(DISTINCT entity_path) FROM iv2) AS n_paths, (SELECT count(*) FROM iv2) AS n_intervals, (SELECT date_diff('hour', mark, TIMESTAMP '{NOW}') FROM m) AS lag_hours, false AS healthy FROM p""",
    "index_paths": f"WITH {RUN} SELECT DISTINCT entity_path, translate(entity_path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS path_lc FROM iv2",
    "stream_fold": f"WITH {INT} SELECT entity_path, version, first_date, first_commit, last_date, last_commit, source_path FROM iv",
    "stream_gate": f"WITH {RECURSIVE}, cnt AS (SELECT channel, era, snapshot_date, '' AS release_name, count(*) AS n_entries FROM obs GROUP BY ALL), {GATE} SELECT channel, era, snapshot_date, n_entries, CASE WHEN len(failures) > 0 THEN 'failed' ELSE 'ingested' END AS status FROM st",
    "stream_activity": "SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS n_events FROM events GROUP BY ALL",
}
