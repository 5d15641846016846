"""The index run: new snapshots into a published dataset, in one job.

Listing -> ledger -> snapshot documents -> gate -> fold -> bounds, ledger, paths and statistics, published together. A release is named by its channel and
name: several of one date, or one name in several channels, are judged and folded each by itself. Bounds and paths are stored in buckets of paths, of which a run
reads and writes those alone that its observations touch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import fold, gate, history, ledger, text
from ..session import scratch, small_side, stored
from ..sources import large, presence, snapshots
from ..sources.versions import BUCKETS, Bucketed, bucket_count, bucket_of, read_table, table_names, versions

#: Versions back from which a run publishes deltas.
DELTA_STEPS = (1, 8)
LEDGER = "channel string, release_name string, commit_hash string, release_date timestamp_ntz, era string, status string, attempts int, last_attempt_at timestamp_ntz, n_entries bigint, error string"


@dataclass
class Options:
    """What a run takes: dates, channels, eras, most snapshots, failed ones again, everything anew, warnings as failures."""

    since: str | None = None
    until: str | None = None
    channels: tuple[str, ...] = ()
    eras: tuple[str, ...] = ()
    most: int | None = None
    retry_failed: bool = False
    requeue: bool = False
    strict: bool = False
    #: Where the report goes as JSON; None: nowhere.
    report: str | None = None
    #: Buckets of a dataset that is published for the first time: so many that one is rewritten in little time.
    buckets: int = BUCKETS
    #: Also keep the words of names and descriptions with their places, for phrase searches; kept up to date from then on.
    tokens: bool = False
    #: Also keep which paths each snapshot has, and births and deaths from one accepted snapshot to the next.
    turnover: bool = False


class Unhealthy(ValueError):
    """A strict run that is not healthy; what it published stays published."""


#: A snapshot's document in a path, the release's name in that (a file or a folder, ``.../<name>.json`` or, one entity per line, ``.../doc=<name>.jsonl/part-0``), and
#: the folder that says which channel's it is; without one it is that of any channel with such a release. Bytes from which one is read in fragments.
LARGE = 32 << 20
DOCUMENT, NAME, CHANNEL = r"^(.*?[.]jsonl?)(?:/.*)?$", r"([^/=]+)[.]jsonl?(?:/[^/]*)?$", r"/channel=([^/]+)/"


def of_path(path: str) -> list[Column]:
    """``release_name`` and ``folder``, the channel that a document's path names (null: none)."""
    return [F.regexp_extract(path, NAME, 1).alias("release_name"), F.nullif(F.regexp_extract(path, CHANNEL, 1), F.lit("")).alias("folder")]


def placed(spark: SparkSession, documents: str | list[str], work: DataFrame) -> DataFrame:
    """``work`` with the path and size of each release's document (null: there is none); one in the channel's own folder goes before others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(documents).select("path", "length")  # contents are not read
    there = files.groupBy(F.regexp_extract("path", DOCUMENT, 1).alias("doc")).agg(F.sum("length").alias("size")).select("doc", "size", *of_path("doc")).filter("release_name <> ''")
    rows = work.select("channel", "release_name", "era", "commit_hash", F.col("release_date").alias("snapshot_date"))
    met = rows.join(there, "release_name", "left").filter(F.col("folder").isNull() | (F.col("folder") == F.col("channel")))
    first = met.groupBy("channel", "release_name").agg(F.min(F.struct(F.col("folder").isNull().alias("any"), "doc", "folder", "size")).alias("d"))
    return rows.join(first, ["channel", "release_name"], "left").select(*rows.columns, "d.doc", "d.folder", "d.size")


def observations(spark: SparkSession, documents: str | list[str], work: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations of the snapshots in ``work`` from their documents, and (channel, release_name, why) of those that can't be read.

    Only the documents of ``work`` are read, each whole or not at all; those of ``LARGE`` bytes and more by many tasks each.
    """
    todo = stored(placed(spark, documents, work))
    why = todo.filter("doc is null").select("channel", "release_name", F.lit("no document").alias("why"))
    parts = []
    by_line, long = F.col("doc").endswith("l"), F.col("size") >= LARGE
    readers = [(by_line, snapshots.read_lines)]
    for era, read, split in (("envelope", snapshots.read_envelopes, large.read_large), ("bare", snapshots.read_bare, partial(large.read_large, bare=True))):
        readers += [(~by_line & (F.col("era") == era) & ~long, read), (~by_line & (F.col("era") == era) & long, split)]
    for these, read in readers:
        own = stored(todo.filter(these))
        paths = [r.doc for r in own.select("doc").distinct().collect()]  # one for each snapshot of the run
        if paths:
            rows, bad = read(spark, paths)
            mine = F.broadcast(own.drop("doc", "size").withColumnsRenamed({"release_name": "_name", "folder": "_folder"}))  # one for each path just collected
            named = lambda df: df.select("*", *of_path("file")).join(mine, (F.col("release_name") == F.col("_name")) & F.col("folder").eqNullSafe(F.col("_folder")))  # noqa: B023, E731
            parts.append(named(snapshots.normalize(rows)).drop("_name", "_folder", "folder"))
            why = why.unionByName(named(bad).select("channel", "release_name", F.lit("malformed document").alias("why")))
    if not parts:
        nothing = spark.createDataFrame([], "file string, raw_path string, entry variant")
        parts = [snapshots.normalize(nothing).withColumn("release_name", F.lit("")).join(todo.drop("doc", "folder", "size"), "release_name")]
    obs = reduce(DataFrame.unionByName, parts)
    order = F.struct("snapshot_date", "channel", F.col("release_name"), F.lit(0).cast("bigint").alias("a"))
    texts = {"license_raw": E.encode_array(F.col("license")), "advisories_raw": E.encode_array(F.col("advisories")), "platforms_raw": E.encode_array(F.col("platforms"))}
    return obs.withColumns({**texts, "ord": order}), why


TOKEN = [*fold.KEY, "column", "pos"]


def touched_by(keys: DataFrame, column: str, parts: int) -> list[int]:
    return sorted(r[0] for r in keys.select(bucket_of(F.col(column), parts).alias("b")).distinct().collect())  # at most ``parts``


def merged_buckets(spark: SparkSession, store: str, new: DataFrame, buckets: int = BUCKETS, tokens: bool = False) -> tuple[dict[str, Bucketed], DataFrame, DataFrame]:
    """Tables with ``new`` bounds merged in, as buckets to be published: bounds, paths, counts of names and versions and, once asked for, words with their places.

    Also all bounds, of which the untouched buckets are not read before they are asked for, and all counts.
    """
    new, parts = stored(new), bucket_count(spark, store, "bounds", buckets)
    there = table_names(spark, store) if versions(spark, store) else set()
    touched = touched_by(new, "entity_path", parts)
    low = lambda df: df.withColumn("path_lc", E.ascii_lower(F.col("entity_path")))
    if "bounds" in there:
        old = read_table(spark, store, "bounds", buckets=touched)
        rows = stored(low(fold.merge(old.drop("path_lc").unionByName(new))))
        rest = read_table(spark, store, "bounds", buckets=sorted(set(range(parts)) - set(touched)))
        whole = rows.unionByName(rest)
    else:
        rows = whole = stored(low(new))
        old = rows.limit(0)
    paths = rows.select("entity_path", "path_lc").distinct()
    out = {"bounds": Bucketed(rows, touched, fold.KEY, "path_lc", parts), "paths": Bucketed(paths, touched, ["entity_path"], "path_lc", parts, False)}
    # counts move by what the touched rows were and are
    moved = stored(history.moved_counts(old, rows) if "counts" in there or not there else history.key_counts(whole))
    here = touched_by(moved, "key", parts)
    was = lambda only: read_table(spark, store, "counts", buckets=only) if "counts" in there else moved.limit(0)
    now = stored(history.added_counts(was(here), moved))
    counts = now.unionByName(was(sorted(set(range(parts)) - set(here))))
    out["counts"] = Bucketed(now, here, ["key", "kind"], "key", parts, False)
    if tokens or "tokens" in there:
        every = "tokens" in there or not there
        out["tokens"] = Bucketed(text.token_rows(rows if every else whole), touched if every else list(range(parts)), TOKEN, "token", parts, False)
    return out, whole, counts


def run(spark: SparkSession, listing: DataFrame, documents: str | list[str], store: str, now: Column | str, floors: DataFrame | None = None, sentinels: DataFrame | None = None, denylist: DataFrame | None = None, fallback: DataFrame | None = None, parse: bool = True, options: Options | None = None) -> DataFrame:
    """Ingest what is new and return the report, one row per run.

    ``listing``: channel, release_name, commit_hash, release_date, era; names are checked unless ``parse`` is off. ``fallback``: commit_hash, release_date, era of
    a source that is taken, as channel ``master``, only where the newest accepted snapshot is a day old or there is none. A snapshot that fails the gate, or whose document can't be read whole, writes no
    observation and is failed in the ledger, to be tried again later; accepted ones widen the stored bounds, in whatever order they
    come. The new bounds, ledger, paths and statistics become visible together, by the manifest, so a run that ends early leaves everything pending and a
    repeated run finds nothing to do. ``documents`` is a folder, or a list of documents, to which the run keeps then. Tables that it needs on its way are deleted.
    """
    with scratch():
        report = ran(spark, listing, documents, store, now, floors, sentinels, denylist, fallback, parse, options or Options())
        return spark.createDataFrame(report.collect(), report.schema)  # one row


def ran(spark: SparkSession, listing: DataFrame, documents: str | list[str], store: str, now: Column | str, floors: DataFrame | None, sentinels: DataFrame | None, denylist: DataFrame | None, fallback: DataFrame | None, parse: bool, o: Options) -> DataFrame:
    now = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    since, until = (None if d is None else F.lit(spark.range(1).select(E.date_arg(F.lit(d))).first()[0]) for d in (o.since, o.until))  # a bad date fails at once
    old = snapshots.versions(spark, store)
    book = read_table(spark, store, "ledger") if old else spark.createDataFrame([], LEDGER)
    if o.requeue:
        book = ledger.requeue(book)
    listing = listing.select("channel", "release_name", "commit_hash", "release_date", "era")
    found = ledger.discover(listing, book) if parse else listing.join(book.select("channel", "release_name"), ["channel", "release_name"], "left_anti")
    if fallback is not None and ledger.lag_hours(book, now).first().fallback_due:
        named = fallback.select(F.lit("master").alias("channel"), E.commit_label(F.col("commit_hash")).alias("release_name"), "commit_hash", "release_date", "era")
        found = found.select(*named.columns).unionByName(named.join(book.select("channel", "release_name"), ["channel", "release_name"], "left_anti"))
    new = found.select("channel", "release_name", "commit_hash", "release_date", "era").withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})
    book = book.unionByName(new.dropDuplicates(["channel", "release_name"]), allowMissingColumns=True)
    if denylist is not None:
        book = ledger.deny(book, denylist)
    book = stored(book)
    work = stored(ledger.windowed(ledger.worklist(book, now, o.retry_failed), since, until, o.channels, o.eras, o.most))
    if not isinstance(documents, str):
        work = stored(work.join(placed(spark, documents, work).filter("doc is not null").select("channel", "release_name"), ["channel", "release_name"], "left_semi"))
    obs, broken = observations(spark, documents, work)
    obs = stored(obs)
    broken = stored(broken)
    missing = gate.missing_sentinels(obs, sentinels) if sentinels is not None else None
    # what earlier runs accepted stands in the baseline
    key = gate.key_of(obs)
    before = book.filter("status = 'ingested'").select("channel", "era", F.col("release_date").alias("snapshot_date"), "release_name", "n_entries")
    counts = stored(obs.groupBy(*key).agg(F.count("*").alias("n_entries")))
    judged = stored(gate.judged(before.unionByName(counts), floors, missing).join(counts.select(*key), key, "left_semi"))
    buckets, bounds, counted = merged_buckets(spark, store, fold.merge(fold.as_bounds(gate.accepted(obs, judged))), o.buckets, o.tokens)
    verdict = judged.select("channel", "release_name", "n_entries", F.when(F.size("failures") > 0, F.array_join("failures", "; ")).alias("error"))
    told = work.select("channel", "release_name").join(verdict, ["channel", "release_name"], "left").join(broken, ["channel", "release_name"], "left")
    empty = F.when(F.col("n_entries").isNull(), F.lit("no entries"))
    told = told.select("channel", "release_name", "n_entries", F.coalesce("why", "error", empty).alias("error"))
    book = stored(ledger.settled(book, told, now))
    tables = {"ledger": book}
    if o.turnover:
        tables["turnover"] = turned(spark, store, book, gate.accepted(obs, judged))
    latest = book.filter("status = 'ingested'").agg(F.max(F.struct("release_date", "release_name")).alias("m")).select("m.release_name").first()[0] or ""
    stats = history.counted_stats(fold.intervals(bounds), counted).withColumn("marker", F.lit(latest))
    snapshots.publish({**tables, "stats": stats}, store, latest, bucketed=buckets, delta_steps=DELTA_STEPS)
    report = stored(report_of(book, work, judged, snapshots.read_intervals(spark, store), now, o.strict))
    if o.report:
        snapshots.write_json(report, o.report)
    if o.strict and not report.first().healthy:
        raise Unhealthy("index run is unhealthy under strict")
    return report


def turned(spark: SparkSession, store: str, book: DataFrame, new: DataFrame) -> DataFrame:
    """Births and deaths of all accepted snapshots, of which those are compared that ``new`` observations change.

    Paths by snapshot are written beside the versions; those of a run that ends early are not seen, as the ledger doesn't accept them, and are written again.
    """
    place = f"{store}/presence"
    new = stored(new.select(*presence.KEY, "entity_path"))
    presence.put(new, place)
    accepted = book.filter("status = 'ingested'").select("channel", "era", F.col("release_date").alias("snapshot_date"), "release_name")
    fresh = stored(presence.turnover(spark, place, accepted, new.select(*presence.KEY)))
    if versions(spark, store) and "turnover" in table_names(spark, store):
        fresh = fresh.unionByName(read_table(spark, store, "turnover").join(fresh.select(*presence.KEY), presence.KEY, "left_anti").join(accepted, presence.KEY, "left_semi"))
    return fresh


def report_of(book: DataFrame, work: DataFrame, judged: DataFrame, intervals: DataFrame, now: Column, strict: bool) -> DataFrame:
    """One row: what was planned and became of it, anomalies, coverage of channels, the newest snapshot's lag, holes before it, figures of the intervals, health."""
    one = lambda df: df.withColumn("_k", F.lit(1))
    tried = work.select("channel", "release_name").join(book.select("channel", "release_name", "status"), ["channel", "release_name"])
    sums = tried.agg(F.count("*").alias("planned"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ingested", "failed", "skipped")])
    odd = F.size("failures") + F.size("warnings") > 0
    anomalies = judged.agg(F.count_if(F.size("warnings") > 0).alias("warned"), F.array_sort(F.collect_list(F.when(odd, F.struct("channel", "release_name", "snapshot_date", "failures", "warnings")))).alias("anomalies"))
    channels = ledger.coverage(book).agg(F.array_sort(F.collect_list(F.struct("channel", "n_ingested", "n_pending", "n_failed", "n_skipped", "newest_name", "newest_date"))).alias("channels"))
    mark = book.agg(F.max(F.when(F.col("status") == "ingested", F.col("release_date")))).first()[0]
    holes = book.filter(F.col("status").isin("pending", "failed") & (F.col("release_date") < F.lit(mark))).agg(F.count("*").alias("unsettled"))
    totals = intervals.agg(F.count_distinct("entity_path").alias("n_paths"), F.count("*").alias("n_intervals"))
    out = one(sums)
    for part in (anomalies, channels, ledger.lag_hours(book, now).select("lag_hours"), holes, totals):
        out = out.join(one(part), "_k")
    return out.drop("_k").withColumn("healthy", gate.health(F.col("failed") + F.col("skipped"), F.col("warned"), F.col("lag_hours"), strict))
