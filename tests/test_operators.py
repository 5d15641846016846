import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalog.functions import exprs as E
from stratalog.operators import fold, gate, history, ledger, search, text
from stratalog.plans import index_run, registry
from stratalog.session import hashed_side, state_of
from stratalog.sources import adapters, snapshots
from stratalog.streaming import jobs

DATA = "/root/testdata/sf0.001"


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_fold_does_not_depend_on_batches(spark):
    obs = adapters.observations(spark, DATA)
    whole = fold.fold(obs)
    bounds = fold.merge(fold.as_bounds(obs.filter("crc32(cast(ord as string)) % 3 = 0")))
    for k in (2, 1):
        bounds = fold.merge_late(bounds, obs.filter(f"crc32(cast(ord as string)) % 3 = {k}"))
    assert whole.exceptAll(fold.intervals(bounds)).isEmpty() and fold.intervals(bounds).exceptAll(whole).isEmpty()


def test_stream_fold_is_the_batch_fold_and_repeats_nothing(spark, tmp_path):
    obs = adapters.observations(spark, DATA)
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = str(tmp_path / "out")
    jobs.fold_stream(stream, store, str(tmp_path / "ck")).awaitTermination()
    got = fold.intervals(snapshots.read_published(spark, store, "bounds"))
    assert got.exceptAll(fold.fold(obs)).isEmpty() and got.count() == fold.fold(obs).count()
    marks = snapshots.read_published(spark, store, "ledger")
    assert marks.agg(F.sum("n_entries")).first()[0] == obs.count() and {r.batch for r in marks.collect()} == {0, 1, 2}
    assert len(snapshots.versions(spark, store)) == 2  # older ones are deleted
    # a batch that is repeated, as after a lost checkpoint, finds itself done
    jobs.fold_stream(stream, store, str(tmp_path / "ck2")).awaitTermination()
    assert snapshots.read_published(spark, store, "ledger").count() == marks.count()


def test_stream_gates_in_date_order(spark, tmp_path):
    """Snapshots of 100 and 60 entries come in the wrong order inside a batch, then 80 and 50: 60 and 50 fail."""
    sizes = [("b", 2, 60), ("a", 1, 100), ("c", 3, 80), ("d", 4, 50)]
    rows = [(f"p{i}", "1", "x", "envelope", dt.datetime(2020, 1, day), f"c{day}", "n", None, None, None, None, None, day) for _, day, n in sizes for i in range(n)]
    obs = spark.createDataFrame(rows, "entity_path string, version string, channel string, era string, snapshot_date timestamp_ntz, commit_hash string, name string, description string, license_raw string, advisories_raw string, platforms_raw string, source_path string, d int").withColumn("ord", F.struct("snapshot_date", "channel"))
    obs.filter("d < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: jobs.fold_stream(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), gated=True).awaitTermination()
    run()
    obs.filter("d >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    marks = {r.snapshot_date.day: r.status for r in snapshots.read_published(spark, str(tmp_path / "out"), "ledger").collect()}
    assert marks == {1: "ingested", 2: "failed", 3: "ingested", 4: "failed"}
    assert {r.last_commit for r in fold.intervals(snapshots.read_published(spark, str(tmp_path / "out"), "bounds")).collect()} == {"c1", "c3"}


def test_latency_stream_goes_by_time(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_type", "value", "ts")
    events.orderBy(F.col("ts").desc()).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.latency_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = out.writeStream.format("memory").queryName("latency").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    want = {r.event_type: r for r in history.latency_percentiles(events, "event_type", "value", "ts").collect()}
    for r in spark.table("latency").collect():
        assert (r.n, r.p50, r.p99) == (want[r.key].n, want[r.key].p50, want[r.key].p99)


def test_last_values_alone_count(spark):
    rows = [("k", float(i), i) for i in range(3000)] + [("one", 7.0, 1)]
    df = spark.createDataFrame(rows, "key string, value double, at int").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.key: (r.n, r.p50, r.p95) for r in history.latency_percentiles(df, "key", "value", "ts").collect()}
    assert got == {"k": (1024, 1976.0 + round(1023 * 0.5), 1976.0 + round(1023 * 0.95)), "one": (1, 7.0, 7.0)}


def test_kept_last_values(spark, tmp_path):
    """A frequent key, late values, equal moments, null values and keys, and a batch that is repeated."""
    kinds = "key string, value double, at int"
    batches = [
        [("k", float(i), i) for i in range(1500, 3000)] + [("one", 7.0, 1), ("one", None, 9), (None, 3.0, 2), ("x", 1.0, None)],
        [("k", -1.0, i) for i in range(1500)] + [("k", 5000.0, 2999), ("one", 7.0, 1), ("one", 6.0, 0)],
        [("late", 2.0, 5)],
    ]
    of = lambda rows: spark.createDataFrame(rows, kinds).select("key", "value", F.timestamp_seconds("at").alias("ts"))
    source, store, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def run(checkpoint):
        stream = spark.readStream.schema(of(batches[0]).schema).parquet(source)
        jobs.keep_last_values(stream, store, checkpoint, key="key", last=1024, buckets=4).awaitTermination()

    for rows in batches:
        of(rows).coalesce(1).write.mode("append").parquet(source)
        run(mark)
    kept = snapshots.read_published(spark, store, "recent")
    want = history.latency_percentiles(of([r for b in batches for r in b]).filter("value is not null and ts is not null"), "key", "value", "ts")
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(history.latency_percentiles(kept, "key", "value", "at")) == key(want)
    assert {r.key: r.n for r in kept.groupBy("key").agg(F.count("*").alias("n")).collect()} == {"k": 1024, "one": 3, None: 1, "late": 1}
    before = snapshots.versions(spark, store)
    run(str(tmp_path / "lost"))  # a lost checkpoint: batch 0 is known as done
    assert snapshots.versions(spark, store) == before and snapshots.read_published(spark, store, "recent").count() == 1029


def test_lag_of_every_day(spark):
    day = lambda n: dt.datetime(2021, 5, n)
    rows = [("a", "r1", day(1), "failed"), ("a", "r2", day(2), "ingested"), ("a", "r3", day(2), "pending"), ("a", "r4", day(4), "failed"), ("b", "r5", day(3), "pending")]
    book = spark.createDataFrame(rows, "channel string, release_name string, release_date timestamp_ntz, status string")
    got = {r.release_name: (r.newest, r.lag_hours, r.fallback_due) for r in ledger.lag_history(book).collect()}
    assert got == {"r1": (None, None, True), "r2": (day(2), 0, False), "r3": (day(2), 0, False), "r4": (day(2), 48, True), "r5": (None, None, True)}
    assert ledger.lag_history(book.limit(0)).count() == 0


def test_full_cap_makes_totals_lower_bounds(spark):
    day = dt.datetime(2021, 5, 1)
    rows = spark.createDataFrame([(f"p.{i}", "1", day, day, f"{i}", None, '["x"]' if i % 2 else "[]", None, 1) for i in range(10)], "entity_path string, version string, first_date timestamp_ntz, last_date timestamp_ntz, name string, license_raw string, advisories_raw string, platforms_raw string, depth int")
    asked = spark.createDataFrame([(1, "p", False, True), (2, "p", False, False), (3, "p.1", True, False)], "request_id long, q string, exact boolean, hide_insecure boolean")
    of = lambda cap: {(r.request_id, r.total, r.lower_bound) for r in search.search(rows, asked, cap).collect()}
    assert of(6) == {(1, 3, True), (2, 6, True), (3, 1, False)}
    assert of(11) == of(None) == {(1, 5, False), (2, 10, False), (3, 1, False)}


def test_changed_tables_are_noticed(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    before = state_of(spark, str(tmp_path))
    assert before == state_of(spark, str(tmp_path)) and len(before) == 1
    spark.range(4).write.parquet(str(tmp_path / "u.parquet"))
    assert before != state_of(spark, str(tmp_path))


def test_dense_minutes(spark):
    m = lambda k: dt.datetime(2021, 5, 5, 10, k)
    counts = spark.createDataFrame([(m(40), 3), (m(12), 5), (m(2), 1)], "minute timestamp_ntz, n_events bigint")
    got = {r.minute: r.n_events for r in jobs.dense(counts).collect()}
    assert len(got) == 30 and got[m(40)] == 3 and got[m(12)] == 5 and m(2) not in got and got[m(11)] == 0
    assert jobs.dense(counts.limit(0)).count() == 0


# documents, listings and datasets


def document(entries, version=2):
    return json.dumps({"packages": entries, "version": version})


def test_snapshot_documents(spark, tmp_path):
    full = {'set."in"': {"pname": "p", "version": "4.2", "meta": {"license": {"spdxId": "Zlib"}, "platforms": ["k1", {"system": "k2"}], "position": "/src/pkgs/tools/t.nix:77", "maintainers": [{"github": "gh"}, {"email": "m@x"}], "knownVulnerabilities": ["V-1"]}}, "editor": {"name": "editor-9.1", "meta": {"license": ["one", {"shortName": "two"}], "homepage": ["https://e"]}}, "unversioned": {"name": "unversioned"}}
    (tmp_path / "good.json").write_text(document(full))
    (tmp_path / "text.json").write_text(document(full, "2"))
    (tmp_path / "newer.json").write_text(document(full, "3"))
    (tmp_path / "none.json").write_text(json.dumps({"packages": full}))
    (tmp_path / "short.json").write_text(document(full)[:-40])
    found, rejected = snapshots.read_envelopes(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[-1] for r in rejected.collect()) == ["newer.json", "none.json", "short.json"]
    rows = {r.entity_path: r for r in snapshots.normalize(found.filter("file like '%good%'")).collect()}
    assert set(rows) == {"set.in", "editor"}
    r = rows["set.in"]
    assert (r.name, r.version, r.license, r.platforms, r.source_path, r.maintainers, r.advisories) == ("in", "4.2", ["Zlib"], ["k1", "k2"], "pkgs/tools/t.nix", ["gh", "m@x"], ["V-1"])
    r = rows["editor"]
    assert (r.name, r.version, r.license, r.homepage, r.platforms, r.advisories) == ("editor", "9.1", ["one", "two"], "https://e", None, None)


def test_bare_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tool": {"name": "tool-3"}, "lib.tool": {"version": "3"}}))
    (tmp_path / "b.json").write_text('{"tool": {"name": "to')
    rows, rejected = snapshots.read_bare(spark, str(tmp_path))
    assert sorted(values(snapshots.normalize(rows), "entity_path", "version")) == [("lib.tool", "3"), ("tool", "3")]
    assert [r.file.rsplit("/", 1)[-1] for r in rejected.collect()] == ["b.json"]


def test_documents_by_line(spark, tmp_path):
    line = lambda p, v: json.dumps({"path": p, "entry": {"version": v}})
    put_lines = lambda name, *lines: (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    put_lines("good", line("a", "1"), line("b", "2"), '{"entries": 2}')
    put_lines("short", line("a", "1"), '{"entries": 2}')
    put_lines("open", line("a", "1"))
    put_lines("broken", line("a", "1"), '{"path": "b", "ent', '{"entries": 2}')
    put_lines("none", '{"entries": 0}')
    (tmp_path / "doc=parts.jsonl").mkdir()
    (tmp_path / "doc=parts.jsonl" / "part-0.txt").write_text(line("c", "3") + "\n")
    (tmp_path / "doc=parts.jsonl" / "part-1.txt").write_text('{"entries": 2}\n' + line("d", "4") + "\n")
    rows, rejected = snapshots.read_lines(spark, [str(p) for p in tmp_path.iterdir()])
    assert sorted(values(snapshots.normalize(rows), "entity_path", "version")) == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    assert sorted(r.file.rsplit("/", 1)[-1] for r in rejected.collect()) == ["broken.jsonl", "open.jsonl", "short.jsonl"]


def test_listings(spark, tmp_path):
    page = lambda *names: '<?xml version="1.0"?><List><Name>b</Name><Odd x="1"/>' + "".join(f"<CommonPrefixes><Prefix>{n}</Prefix><Else/></CommonPrefixes>" for n in names) + "</List>"
    (tmp_path / "p1.xml").write_text(page("chan/r-1/", "chan/r-2/", "chan/", "chan/deep/er/"))
    (tmp_path / "p2.xml").write_text(page("chan/r-2/", "chan/r-3/", "other/r-9/"))
    assert sorted(r.release_name for r in snapshots.list_releases(spark, str(tmp_path / "*.xml"), "chan/").collect()) == ["r-1", "r-2", "r-3"]
    for n in ("r-1", "r-2"):
        (tmp_path / "dir" / "chan" / n).mkdir(parents=True)
        (tmp_path / "dir" / "chan" / n / "x.json").write_text("{}")
    (tmp_path / "dir" / "else").mkdir()
    (tmp_path / "dir" / "else" / "y.json").write_text("{}")
    assert sorted(r.release_name for r in snapshots.list_directory(spark, str(tmp_path / "dir"), "chan/").collect()) == ["r-1", "r-2"]


def test_publishing(spark, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(ValueError, match="nothing is published"):
        snapshots.read_published(spark, path)
    first = snapshots.publish({"t": spark.range(10)}, path, "abc")
    assert first.agg(F.min(F.length("sha256"))).first()[0] == 64 and {r.latest for r in first.collect()} == {"abc"}
    reader = snapshots.read_published(spark, path, "t")
    snapshots.publish({"t": spark.range(20)}, path, "def")
    assert reader.count() == 10 and snapshots.read_published(spark, path, "t").count() == 20  # readers of the old version are not disturbed
    spark.range(99).write.parquet(f"{path}/v=2/t")  # a run that ended before its manifest
    assert snapshots.read_published(spark, path, "t").count() == 20 and snapshots.versions(spark, path) == [0, 1]
    for bad in (3, 5):
        with pytest.raises(ValueError, match="can't be served"):
            snapshots.publish({"t": spark.range(1)}, path, "x", bad)
    spark.read.json(f"{path}/v=1/manifest").withColumn("min_schema_version", F.lit(5)).coalesce(1).write.json(f"{path}/v=7/manifest")
    with pytest.raises(ValueError, match="needs schema 5"):
        snapshots.read_published(spark, path, "t")


def test_interval_schema_and_statistics(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = spark.createDataFrame([("a.b", "1", 86400, "c1", 172800, "c2", "b", None, None, 1)], "entity_path string, version string, first_date long, first_commit string, last_date long, last_commit string, name string, description string, license_raw string, depth int")
    stats = history.index_stats(rows.withColumns({c: F.timestamp_seconds(c).cast("timestamp_ntz") for c in ("first_date", "last_date")}))
    snapshots.publish({"intervals": rows, "stats": stats.withColumns({"n_rows": F.lit(77).cast("bigint"), "marker": F.lit("m1")})}, path, "m1")
    r = snapshots.read_intervals(spark, path).first()
    assert (r.first_date, r.last_date, r.source_path, r.platforms_raw) == (dt.datetime(1970, 1, 2), dt.datetime(1970, 1, 3), None, None)
    assert snapshots.statistics(spark, path).first().n_rows == 77  # as stored
    snapshots.publish({"intervals": rows, "stats": stats.withColumn("marker", F.lit("m1"))}, path, "m2")
    assert snapshots.statistics(spark, path).first().n_rows == 1  # the marker is another's
    snapshots.publish({"intervals": rows}, path, "m3")
    assert snapshots.statistics(spark, path).first().n_rows == 1
    snapshots.publish({"intervals": rows.drop("name")}, path, "m4")
    with pytest.raises(ValueError, match="no column name"):
        snapshots.read_intervals(spark, path)
    pairs = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    assert (snapshots.lookup(pairs, "a"), snapshots.lookup(pairs, "b"), snapshots.lookup(pairs, "c")) == ("1", None, None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, dt.datetime(2021, 2, 3, 4), ["x", "y"])], "k string, v string, d timestamp_ntz, l array<string>").coalesce(1)
    snapshots.write_tsv(df.drop("l"), str(tmp_path / "t"))
    assert next((tmp_path / "t").glob("*.csv")).read_text() == "k\tv\td\na\t-\t2021-02-03\n"
    snapshots.write_json(df.select("k", "l"), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("*.json")).read_text()) == {"k": "a", "l": ["x", "y"]}


# the index run


def release(day, rev="abcdef1", channel="nixos-x"):
    return (channel, f"nixos-24.05pre{1000 + day}.{rev}", rev + "0" * 33, dt.datetime(2024, 3, day), "envelope")


LISTING = "channel string, release_name string, commit_hash string, release_date timestamp_ntz, era string"
NOW = "2024-03-09 12:00:00"


def put(folder, listed, paths, version="1.0"):
    folder.mkdir(exist_ok=True)
    (folder / f"{listed[1]}.json").write_text(document({p: {"version": version} for p in paths}))


def test_index_run(spark, tmp_path):
    docs, store = tmp_path / "docs", str(tmp_path / "store")
    many = [f"p{i}" for i in range(100)]
    a, b, c, d, e, f = (release(k) for k in range(1, 7))
    put(docs, a, many)
    put(docs, b, many + ["new"], "1.1")
    put(docs, c, many[:60])  # under 70% of 101
    put(docs, d, many)
    (docs / f"{e[1]}.json").write_text(document(dict.fromkeys(many, {"version": "9"}))[:-9])
    listing = spark.createDataFrame([a, b, c, d, e, f, ("nixos-x", "odd-name", "0" * 40, a[3], "envelope")], LISTING)
    deny = spark.createDataFrame([(d[1], "known to be malformed")], "release_name string, reason string")
    due = gate.sentinels(spark, (), extra=("p0", "p1.x")).filter("label = 'p0'")
    report = index_run.run(spark, listing, str(docs), store, NOW, denylist=deny, sentinels=due).first()
    assert (report.planned, report.ingested, report.failed, report.n_intervals, report.n_paths) == (5, 2, 3, 201, 101)
    assert not report.healthy and report.lag_hours == 180 and [x.failures for x in report.anomalies] == [["count 60 under 70% of 101"]] and report.channels[0].n_skipped == 1
    book = {r.release_name: (r.status, r.attempts, r.error) for r in snapshots.read_published(spark, store, "ledger").collect()}
    assert book == {a[1]: ("ingested", 1, None), b[1]: ("ingested", 1, None), c[1]: ("failed", 1, "count 60 under 70% of 101"), d[1]: ("skipped", 0, "known to be malformed"), e[1]: ("failed", 1, "malformed document"), f[1]: ("failed", 1, "no document")}
    ends = {(r.entity_path, r.version): (r.first_commit, r.last_commit) for r in snapshots.read_intervals(spark, store).collect()}
    assert ends["p5", "1.0"] == (a[2], a[2]) and ends["new", "1.1"] == (b[2], b[2]) and ("p5", "9") not in ends
    # nothing is due: the failed ones wait for their hour
    again = index_run.run(spark, listing, str(docs), store, NOW, denylist=deny).first()
    assert (again.planned, again.n_intervals, again.unsettled) == (0, 201, 0)
    # a day later the repaired documents and a late, older snapshot come in
    put(docs, c, many, "1.0")
    put(docs, e, many, "1.1")
    early = ("nixos-x", "nixos-24.05pre990.abcdef2", "abcdef2" + "0" * 33, dt.datetime(2024, 2, 1), "envelope")
    put(docs, early, many, "1.0")
    later = "2024-03-10 12:00:00"
    report = index_run.run(spark, listing.unionAll(spark.createDataFrame([early], LISTING)), str(docs), store, later, denylist=deny).first()
    assert (report.planned, report.ingested, report.failed) == (4, 3, 1)
    ends = {(r.entity_path, r.version): (r.first_commit, r.last_commit) for r in snapshots.read_intervals(spark, store).collect()}
    assert ends["p5", "1.0"] == (early[2], c[2]) and ends["p5", "1.1"] == (b[2], e[2]) and ends["new", "1.1"] == (b[2], b[2])
    assert snapshots.read_published(spark, store, "paths").count() == 101 and snapshots.statistics(spark, store).first().n_rows == 201
    # everything anew gives the same intervals
    index_run.run(spark, listing.unionAll(spark.createDataFrame([early], LISTING)), str(docs), store, later, options=index_run.Options(requeue=True, until="2024-03-02"))
    assert {(r.entity_path, r.version): (r.first_commit, r.last_commit) for r in snapshots.read_intervals(spark, store).collect()} == ends


def test_strict_runs_and_options(spark, tmp_path):
    docs, store = tmp_path / "docs", str(tmp_path / "store")
    a, b = release(8), release(9)
    put(docs, a, [f"p{i}" for i in range(100)])
    put(docs, b, [f"p{i}" for i in range(80)])
    listing = spark.createDataFrame([a, b], LISTING)
    assert index_run.run(spark, listing, str(docs), store, NOW, options=index_run.Options(until="2024-03-08T12:00:00Z", strict=True, report=str(tmp_path / "report"))).first().healthy
    assert spark.read.json(str(tmp_path / "report")).first().ingested == 1
    assert index_run.run(spark, listing, str(docs), store, NOW, options=index_run.Options(since="2024-03-09", channels=("other",))).first().planned == 0
    with pytest.raises(index_run.Unhealthy):  # 80 of 100 is a warning, which strict runs don't accept
        index_run.run(spark, listing, str(docs), store, NOW, options=index_run.Options(strict=True))
    assert {r.status for r in snapshots.read_published(spark, store, "ledger").collect()} == {"ingested"}
    with pytest.raises(PySparkException, match="not a date"):
        index_run.run(spark, listing, str(docs), store, NOW, options=index_run.Options(since="last week"))


def test_fallback_source(spark, tmp_path):
    docs, store = tmp_path / "docs", str(tmp_path / "store")
    a, sha = release(9), "0123456789abcdef0123456789abcdef01234567"
    put(docs, a, ["p"])
    put(docs, (None, "master-0123456789ab"), ["p"], "2.0")
    head = spark.createDataFrame([(sha, dt.datetime(2024, 3, 11), "envelope")], "commit_hash string, release_date timestamp_ntz, era string")
    listing = spark.createDataFrame([a], LISTING)
    at = lambda day: f"2024-03-{day} 12:00:00"
    index_run.run(spark, listing, str(docs), store, at("09"))
    assert index_run.run(spark, listing, str(docs), store, at("09"), fallback=head).first().planned == 0  # 12 hours old
    assert index_run.run(spark, listing, str(docs), store, at("11"), fallback=head).first().ingested == 1
    assert index_run.run(spark, listing, str(docs), store, at("11"), fallback=head).first().planned == 0
    assert {r.channel for r in snapshots.read_published(spark, store, "ledger").collect()} == {"nixos-x", "master"}


def test_index_stream_takes_documents_as_they_come(spark, tmp_path):
    docs, store = tmp_path / "docs", str(tmp_path / "store")
    a, b = release(8), release(9)
    put(docs, a, ["p", "q"])
    listing = spark.createDataFrame([a, b], LISTING)
    run = lambda: jobs.index_stream(spark, str(docs), lambda: listing, store, str(tmp_path / "ck"), NOW).awaitTermination()
    run()
    assert values(snapshots.read_published(spark, store, "ledger"), "release_name", "status") == [(a[1], "ingested")]
    put(docs, b, ["p", "q"], "2.0")
    run()
    assert snapshots.read_intervals(spark, store).count() == 4
    assert {r.attempts for r in snapshots.read_published(spark, store, "ledger").collect()} == {1}


# gate


def counted(spark, rows):
    return spark.createDataFrame([("c", era, dt.datetime(year, 1, day), n) for era, year, day, n in rows], "channel string, era string, snapshot_date timestamp_ntz, n_entries bigint")


def test_floors(spark):
    rows = counted(spark, [("bare", 2016, 1, 7_999), ("bare", 2016, 2, 8_000), ("bare", 2030, 1, 17_999), ("envelope", 2019, 1, 50_000), ("envelope", 2026, 1, 129_999), ("envelope", 2026, 2, 130_000)])
    got = {(r.era, r.snapshot_date.year, r.snapshot_date.day): r.failures for r in gate.judged(rows, gate.floor_ladder(spark)).collect()}
    assert {k for k, v in got.items() if v} == {("bare", 2016, 1), ("bare", 2030, 1), ("envelope", 2026, 1)}
    assert got["envelope", 2026, 1] == ["count 129999 under floor 130000"]


def test_baseline_learns_from_accepted_snapshots_of_its_era(spark):
    rows = counted(spark, [("envelope", 2022, 1, 1000), ("envelope", 2022, 2, 690), ("envelope", 2022, 3, 700), ("envelope", 2022, 4, 899), ("envelope", 2022, 5, 900), ("bare", 2022, 6, 10)])
    got = {r.snapshot_date.day: (r.verdict, r.baseline) for r in gate.judged(rows).collect()}
    assert got == {1: ("pass", None), 2: ("fail", 1000), 3: ("warn", 1000), 4: ("warn", 1000), 5: ("pass", 1000), 6: ("pass", None)}
    long = counted(spark, [("envelope", 2023, 1, 1000), *[("envelope", 2023, d, 800) for d in range(2, 14)]])
    assert [r.baseline for r in gate.judged(long).orderBy("snapshot_date").collect()] == [None, *[1000] * 10, 800, 800]
    backfill = counted(spark, [("envelope", 2024, 2, 2000), ("envelope", 2024, 1, 1000)])
    assert {r.verdict for r in gate.judged(backfill).collect()} == {"pass"}  # an older snapshot does not meet a newer baseline


def observed(spark, snaps):
    rows = [("c", era, dt.datetime(2023, month, 1), p, "1") for era, month, paths in snaps for p in paths]
    return spark.createDataFrame(rows, "channel string, era string, snapshot_date timestamp_ntz, entity_path string, version string")


def test_sentinels(spark):
    obs = observed(spark, [("bare", 1, ["firefox", "thunderbird", "python27Packages.requests"]), ("envelope", 2, ["firefox", "xfirefox", "python3Packages.requestsx"])])
    miss = lambda wanted: {(r.snapshot_date.month, r.label) for r in gate.missing_sentinels(obs, wanted).collect()}
    assert miss(gate.sentinels(spark)) == {(2, "thunderbird"), (2, "python*Packages.requests")}  # nh is due from 2024 on
    since = spark.createDataFrame([("a", "^no$", dt.datetime(2023, 2, 1), None), ("b", "^no$", None, "bare")], "label string, pattern string, active_from timestamp_ntz, era string")
    assert miss(since) == {(2, "a"), (1, "b")}
    assert miss(gate.sentinels(spark, (), ("fire.ox", "firefox"))) == {(1, "fire.ox"), (2, "fire.ox")}
    verdicts = gate.judged(gate.counts(obs), None, gate.missing_sentinels(obs, gate.sentinels(spark)))
    assert {r.snapshot_date.month: r.verdict for r in verdicts.collect()} == {1: "pass", 2: "fail"}


def test_births_and_deaths_between_accepted_snapshots(spark):
    old = [f"a{i}" for i in range(2000)]
    obs = observed(spark, [("bare", 1, old), ("bare", 2, old[:10]), ("bare", 3, old[101:] + ["b"]), ("envelope", 4, ["z"])])
    verdicts = spark.createDataFrame([("c", "bare", dt.datetime(2023, m, 1), "fail" if m == 2 else "pass") for m in (1, 2, 3)] + [("c", "envelope", dt.datetime(2023, 4, 1), "pass")], "channel string, era string, snapshot_date timestamp_ntz, verdict string")
    rows = gate.births_deaths(obs, verdicts).collect()
    assert [(r.snapshot_date.month, r.births, r.deaths, r.born, r.warn) for r in rows] == [(3, 1, 101, "b", True)]
    assert rows[0].died.split(",") == sorted(old[:101])[:8]
    assert [(r.snapshot_date.month, r.deaths) for r in gate.births_deaths(obs).orderBy("snapshot_date").collect()] == [(2, 1990), (3, 10)]


@pytest.mark.parametrize(("failed", "warned", "lag", "strict", "healthy"), [(0, 0, 72, True, True), (0, 0, 73, False, False), (0, 2, 1, False, True), (0, 2, 1, True, False), (1, 0, 1, False, False), (0, 0, None, True, True)])
def test_health(spark, failed, warned, lag, strict, healthy):
    one = spark.range(1).select(gate.health(F.lit(failed), F.lit(warned), F.lit(lag).cast("bigint"), strict).alias("h"))
    assert one.first().h is healthy


# ledger


def test_worklist_and_attempts(spark):
    rows = [("c", "a", "failed", 1, 3600), ("c", "b", "failed", 2, 3600), ("c", "p", "pending", 0, 0), ("c", "s", "skipped", 5, 0), ("c", "f", "failed", 4, 0), ("c", "i", "ingested", 1, 0)]
    led = spark.createDataFrame(rows, "channel string, release_name string, status string, attempts int, s long").withColumns({"last_attempt_at": F.timestamp_seconds("s").cast("timestamp_ntz"), "release_date": F.timestamp_seconds("s").cast("timestamp_ntz")})
    at = lambda s: F.lit(f"1970-01-01 {s}").cast("timestamp_ntz")
    names = lambda df: [r.release_name for r in df.collect()]
    assert names(ledger.worklist(led, at("02:00:00"))) == ["p", "a"] and names(ledger.worklist(led, at("01:59:59"))) == ["p"]
    assert set(names(ledger.worklist(led, at("02:00:00"), everything=True))) == {"a", "b", "p", "s", "f"}
    after = {r.release_name: (r.status, r.attempts) for r in ledger.attempted(led, led.filter("release_name in ('f', 'p')"), at("02:00:00")).collect()}
    assert after["f"] == ("skipped", 5) and after["p"] == ("failed", 1) and after["a"] == ("failed", 1)
    assert {(r.status, r.attempts, r.last_attempt_at) for r in ledger.requeue(led).collect()} == {("pending", 0, None)}


def test_insert_keeps_what_the_ledger_has(spark):
    led = spark.createDataFrame([("c", "a", dt.datetime(2020, 1, 1), "failed", 3)], "channel string, release_name string, release_date timestamp_ntz, status string, attempts int")
    found = spark.createDataFrame([("c", "a", dt.datetime(2021, 1, 1)), ("c", "b", dt.datetime(2021, 1, 1)), ("c", "b", dt.datetime(2021, 1, 1))], "channel string, release_name string, release_date timestamp_ntz")
    assert sorted(values(ledger.insert_pending(led, found), "release_name", "status", "attempts")) == [("a", "failed", 3), ("b", "pending", 0)]


def test_discovery_is_newest_first(spark):
    good = lambda n, rev="abcdef1": ("c", f"nixos-23.11pre{n}.{rev}", rev.lower() + "0" * (40 - len(rev)))
    rows = [good(9), good(100), good(20), ("c", "nixpkgs-1.0pre5_abc", "0" * 40), ("c", "nixos-23.11pre7.abcdef1", "f" * 40), ("c", "nixos-23.11pre8.abcdef1", None)]
    listing = spark.createDataFrame(rows, "channel string, release_name string, commit_hash string")
    assert [r.commit_count for r in ledger.discover(listing, listing.filter("release_name like '%pre20.%'")).collect()] == [100, 9]
    assert {(r.refused, r.n_rows) for r in ledger.refused(listing).collect()} == {("name", 1), ("revision", 1), ("commit", 1)}


# expressions


def test_semver_order(spark):
    want = ["0.4.0-a", "0.4.0-a.2", "0.4.0-a.b", "0.4.0-b.3", "0.4.0-b.12", "0.4.0", "2.8.0", "2.12.0", "2.21.0", "7.7", "zzz"]
    df = spark.createDataFrame([(v,) for v in reversed(want)], "v string")
    assert [r.v for r in df.orderBy(E.semver_key(F.col("v"))).collect()] == want


def test_numbers_and_arrays(spark):
    df = spark.createDataFrame([("6.5beta2-y.8",), ("rc4",), ("11.0.3",)], "v string")
    assert [r[0] for r in df.select(E.numeric_parts(F.col("v"))).collect()] == [[6, 5], [], [11, 0, 3]]
    raw = spark.createDataFrame([(x,) for x in ('["x","y"]', "plain", "null", "None", "  ", "[7,null,false]", "[broken", None)], "v string")
    assert [r[0] for r in raw.select(E.decode_array(F.col("v"))).collect()] == [["x", "y"], ["plain"], [], [], [], ["7", "false"], ["[broken"], []]
    back = raw.select(E.encode_array(E.decode_array(F.col("v"))).alias("j"))
    assert [r.j for r in back.collect()] == ['["x","y"]', '["plain"]', None, None, None, '["7","false"]', '["[broken"]', None]


def test_names_and_places(spark):
    names = ["nixos-21.05pre77.0a1b2c3", "nixpkgs-21.05.88.ABC", "nixos-21.05beta5.9", "nixos-21.05", "nixpkgs-0.9", "other-21.05pre7.abc", "nixos-21.05pre7.xyz"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert values(df, E.snapshot_name_part(F.col("n"), "count"), E.snapshot_name_part(F.col("n"), "rev")) == [("77", "0a1b2c3"), ("88", "ABC"), ("5", "9"), (None, None), (None, None), (None, None), (None, None)]
    channels = spark.createDataFrame([("nixpkgs-unstable",), ("nixos-21.05-small",), ("nixpkgs-other",)], "c string")
    assert [r[0] for r in channels.filter("c not like '%other'").select(E.channel_prefix(F.col("c"))).collect()] == ["nixpkgs/", "nixos/21.05-small/"]
    with pytest.raises(PySparkException, match="unknown channel"):
        channels.select(E.channel_prefix(F.col("c"))).collect()


def test_dates(spark):
    df = spark.createDataFrame([("2023-04-05",), ("2023-04-05T06:07:08Z",), ("2023-04-05T06:07:08.5-02:00",), (None,)], "s string")
    assert [r[0] for r in df.select(E.date_arg(F.col("s"))).collect()] == [dt.datetime(2023, 4, 5), dt.datetime(2023, 4, 5, 6, 7, 8), dt.datetime(2023, 4, 5, 8, 7, 8, 500_000), None]
    for bad in ("2023-4-5", "yesterday", "2023-13-01", "2023-04-05T06"):
        with pytest.raises(PySparkException, match="not a date"):
            spark.createDataFrame([(bad,)], "s string").select(E.date_arg(F.col("s"))).collect()


def test_bounds_of_prefixes(spark):
    df = spark.createDataFrame([(p,) for p in ("ab", "a~", "é", "日", "\U0001f600", "", "x퟿", "x\U0010ffff")], "p string")
    assert [r[0] for r in df.select(E.upper_bound(F.col("p"))).collect()] == ["ac", "a\x7f", "ê", "旦", "\U0001f601", None, None, None]


def test_commands(spark):
    day = lambda y: dt.datetime(y, 3, 26)
    rows = [("tool", "c0", dt.datetime(2020, 3, 25), False), ("set.in.x", "c1", day(2020), True), ("set.a b", "c2", day(2021), False), ("9x", "c3", dt.datetime(2019, 1, 1), True)]
    df = spark.createDataFrame(rows, "p string, c string, d timestamp_ntz, bad boolean")
    old = "nix-shell -p '(import (builtins.fetchTarball \"https://github.com/NixOS/nixpkgs/archive/{}.tar.gz\") {{}}).{}'"
    args = [F.col(c) for c in ("p", "c", "d", "bad")]
    assert [r[0] for r in df.select(E.usage_command(*args)).collect()] == [old.format("c0", "tool"), "NIXPKGS_ALLOW_INSECURE=1 nix shell --impure 'nixpkgs/c1#set.\"in\".x'", "nix shell 'nixpkgs/c2#set.\"a b\"'", "NIXPKGS_ALLOW_INSECURE=1 " + old.format("c3", '"9x"')]
    assert [r[0] for r in df.select(E.usage_command(*args, run=True)).collect()][::3] == [old.format("c0", "tool") + " --run tool", "NIXPKGS_ALLOW_INSECURE=1 " + old.format("c3", '"9x"') + " --run 9x"]


# search


INTERVALS = "entity_path string, version string, depth bigint, first_date timestamp_ntz, last_date timestamp_ntz, name string, license_raw string, advisories_raw string, platforms_raw string"


def interval(path, version, last, licence=None, bad="[]", platforms="[]"):
    return (path, version, path.count("."), dt.datetime(2020, 1, 1), dt.datetime(2020, 1, last), path.rsplit(".", 1)[-1], licence, bad, platforms)


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [interval("pen", "1.0.0", 5, '["MIT"]'), interval("pen", "2.0.0", 9, None, '["V"]'), interval("pencil", "2.1.0", 9, '"mit license"', platforms='["lin","mac"]'), interval("PEN%x", "0.1.0", 9), interval("box.pen", "2.0.5", 20), interval("pen.box", "3.0.0", 30, '["É"]'), interval("pen.set.red", "abc", 3)]
    return spark.createDataFrame(rows, INTERVALS)


def ask(spark, shelf, **options):
    kinds = {"q": "string", **search.OPTIONS}
    row = (1, *options.values())
    asked = spark.createDataFrame([row], "request_id long, " + ", ".join(f"{c} {kinds[c]}" for c in options))
    return [(r.entity_path, r.version, r.total, r.has_more) for r in search.search(shelf, asked).orderBy("rnk").collect()]


def test_search_orders_filters_and_pages(spark, shelf):
    everything = [r[:2] for r in ask(spark, shelf, q="pen")]
    assert everything == [("PEN%x", "0.1.0"), ("pen", "2.0.0"), ("pencil", "2.1.0"), ("pen", "1.0.0"), ("pen.box", "3.0.0"), ("pen.set.red", "abc")]
    assert [r[:2] for r in ask(spark, shelf, q="pen", reverse=True)] == everything[::-1]
    assert ask(spark, shelf, q="pen", page_limit=2, page_offset=3) == [("pen", "1.0.0", 6, True), ("pen.box", "3.0.0", 6, True)]
    assert [r[2:] for r in ask(spark, shelf, q="pen", page_limit=0)] == [(6, False)] * 6
    assert [r[1] for r in ask(spark, shelf, q="PEN", sort="version")] == ["0.1.0", "1.0.0", "2.0.0", "2.1.0", "3.0.0", "abc"]
    assert [r[0] for r in ask(spark, shelf, q="pen", sort="date")][:1] == ["pen.box"]
    assert [r[0] for r in ask(spark, shelf, q="pen", sort="name")] == ["PEN%x", "pen.box", "pen", "pen", "pencil", "pen.set.red"]
    assert [r[:2] for r in ask(spark, shelf, q="pen", license="MIT")] == [("pencil", "2.1.0"), ("pen", "1.0.0")]
    assert [r[0] for r in ask(spark, shelf, q="pen", license="é")] == ["pen.box"]  # regardless of case in all scripts
    assert [r[0] for r in ask(spark, shelf, q="pen", arch="mac")] == ["pencil"]
    hidden = ask(spark, shelf, q="pen", hide_insecure=True, page_limit=2)
    assert ("pen", "2.0.0") not in [r[:2] for r in hidden] and hidden[0][2:] == (5, True)
    assert [r[0] for r in ask(spark, shelf, q="pen%")] == ["PEN%x"]


def test_search_by_version(spark, shelf):
    assert [r[:2] for r in ask(spark, shelf, q="pen", version="2")] == [("pen", "2.0.0"), ("pencil", "2.1.0")]
    assert ask(spark, shelf, q="pen", version="3") == []  # the shallowest depth alone
    assert [r[0] for r in ask(spark, shelf, q="pen", version="3", all_depths=True)] == ["pen.box"]
    assert [r[:2] for r in ask(spark, shelf, q="pen", version="2", exact=True)] == [("pen", "2.0.0")]
    assert ask(spark, shelf, q="Pen", exact=True) == [] and ask(spark, shelf, q="pen", all_depths=True) == []


def test_search_does_not_depend_on_other_requests(spark, shelf):
    asked = [(i, q, v, e, s) for i, (q, v, e, s) in enumerate((q, v, e, s) for q in ("pen", "box", "p", "") for v in (None, "2") for e in (False, True) for s in ("date", "relevance"))]
    schema = "request_id long, q string, version string, exact boolean, sort string"
    together = sorted(values(search.search(shelf, spark.createDataFrame(asked, schema)), "request_id", "rnk", "entity_path", "version", "total"))
    alone = sorted(x for r in asked[::5] for x in values(search.search(shelf, spark.createDataFrame([r], schema)), "request_id", "rnk", "entity_path", "version", "total"))
    assert [x for x in together if x[0] % 5 == 0] == alone


def test_repeated_rows_are_shown_once_unless_asked_for(spark, shelf):
    twice = shelf.unionAll(shelf.filter("entity_path = 'pencil'").withColumn("last_date", F.lit("2020-01-02").cast("timestamp_ntz")))
    asked = spark.createDataFrame([(1, "pencil", False), (2, "pencil", True)], "request_id long, q string, full boolean")
    assert sorted({(r.request_id, r.rnk, r.total) for r in search.search(twice, asked).collect()}) == [(1, 1, 1), (2, 1, 2), (2, 2, 2)]


def test_numbers_go_through_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 3).alias("request_id"), (F.col("id") * 7919 % 5000).alias("o")).repartition(5)
    got = search.numbered(df, [F.col("o")]).collect()
    for g in {r.request_id for r in got}:
        mine = sorted((r.o, r.rnk) for r in got if r.request_id == g)
        assert [k for _, k in mine] == list(range(1, len(mine) + 1))


def test_suggestions(spark):
    rows = spark.createDataFrame([interval("lib", v, d) for v, d in (("3.4.1", 1), ("3.5.9", 2), ("3.2.0", 3), ("nightly", 4), ("3.4", 5))] + [interval("library", "3.4.2", 9)], INTERVALS)
    asked = spark.createDataFrame([(1, "lib", "3.4.3"), (2, "lib", "nightfall")], "request_id long, q string, version string")
    got = search.suggest(rows, asked)
    assert values(got.filter("request_id = 1").orderBy("rnk"), "entity_path", "version") == [("lib", "3.4"), ("library", "3.4.2"), ("lib", "3.4.1"), ("lib", "3.5.9"), ("lib", "3.2.0")]
    assert got.filter("request_id = 2 and rnk = 1").first().version == "nightly"
    assert values(search.suggest_exact(rows, asked).filter("request_id = 1 and rnk = 1"), "version") == [("3.4",)]
    assert search.suggest_exact(rows, spark.createDataFrame([(1, "lib", "3.4"), (2, "no", "1")], asked.schema)).count() == 0


def test_literal_wildcards_and_ascii_case(spark):
    rows = spark.createDataFrame([("a%b",), ("axb",), ("A%c",), ("ÉA",)], "entity_path string")
    asked = spark.createDataFrame([(1, "a%"), (2, "éa"), (3, "a")], "request_id long, q string")
    got = sorted((r.request_id, r.entity_path) for r in search.prefix_join(rows, asked).collect())
    assert got == [(1, "A%c"), (1, "a%b"), (3, "A%c"), (3, "a%b"), (3, "axb")]


def test_phrases_in_names_or_descriptions(spark):
    rows = spark.createDataFrame([("a", "Šťastný den", "one two three"), ("b", "two", "three one-two"), ("c", None, None), ("d", "x one", "two y")], "k string, name string, description string")
    asked = spark.createDataFrame([(1, "ONE Two"), (2, "stastny"), (3, "?!"), (4, "two three")], "request_id long, phrase string")
    assert sorted(values(text.description_search(rows, asked), "request_id", "k")) == [(1, "a"), (1, "b"), (2, "a"), (4, "a")]


def test_free_text(spark):
    df = spark.createDataFrame([("editor v4.5",), ("gcc 12 13",), ("py3 3.11",), (" two  words 1.0-rc1 ",), ("x 1.0+b",), ("plain",)], "q string")
    assert values(df, *E.request_parts(F.col("q"))) == [("editor", "4.5"), ("gcc 12 13", None), ("py3 3.11", None), ("two  words", "1.0-rc1"), ("x 1.0+b", None), ("plain", None)]


def test_name_lookups_answer_equal_questions_once(spark):
    rows = spark.createDataFrame([(f"set.blue-{n}", "1", 1, None, None, f"blue-{n}") for n in range(3)] + [("red-0", "1", 0, None, None, "red-0")], "entity_path string, version string, depth int, first_date timestamp_ntz, last_date timestamp_ntz, name string")
    asked = spark.createDataFrame([(n, "BLUE-") for n in range(900)] + [(900, "red-0"), (901, "no"), (902, None)], "request_id bigint, q string")
    found = search.named(rows, asked, False, None)
    got = values(found, "request_id", "rnk", "entity_path")
    assert sorted(got) == [(n, k + 1, f"set.blue-{k}") for n in range(900) for k in range(3)] + [(900, 1, "red-0")]
    # rows are ranked for each question, not for each request
    questions, asks = search.once(asked)
    assert questions.count() == 4 and asks.count() == 903
    assert sorted(values(search.to_all(search.ranked(search.prefix_join(rows, questions, "name"), "last_date", None), asks, 1), "request_id", "rnk", "entity_path")) == sorted(got)


@pytest.fixture
def ranked_ids(monkeypatch):
    """The requests whose rows are ranked, call by call."""
    calls, real = [], search.ranked
    monkeypatch.setattr(search, "ranked", lambda found, *more: (calls.append(sorted(r[0] for r in found.select("request_id").distinct().collect())), real(found, *more))[1])
    return calls


@pytest.fixture
def blues(spark):
    kinds = "entity_path string, version string, depth int, first_date timestamp_ntz, last_date timestamp_ntz, name string, description string, license_raw string, advisories_raw string, platforms_raw string"
    return spark.createDataFrame([(f"blue-{n}", f"1.{n}", 0, None, None, f"blue-{n}", f"Blue {n} kind", "mit", "[]", "[]") for n in range(3)], kinds)


def test_search_answers_equal_requests_once(spark, blues, ranked_ids):
    asked = spark.createDataFrame([(n, "blue") for n in range(40)] + [(40, "blue-1")], "request_id bigint, q string")
    got = sorted(values(search.search(blues, asked), "request_id", "rnk", "entity_path", "total"))
    assert got == [(n, k + 1, f"blue-{k}", 3) for n in range(40) for k in range(3)] + [(40, 1, "blue-1", 1)]
    assert ranked_ids == [[0, 40]]


def test_totals_of_equal_requests_are_counted_once(spark, blues, ranked_ids):
    asked = spark.createDataFrame([(n, "blue") for n in range(40)], "request_id bigint, q string")
    assert sorted(set(values(search.search(blues, asked, 2), "request_id", "total", "lower_bound"))) == [(n, 2, True) for n in range(40)]
    assert ranked_ids == [[0]]


def test_description_requests_rank_each_phrase_once(spark, blues, ranked_ids, monkeypatch):
    from stratalog.plans import searches

    monkeypatch.setattr(searches, "iv", lambda *_: blues)
    asked = spark.createDataFrame([(100 * n, "x blue 1", "KIND A") for n in range(30)], "p_partkey bigint, p_name string, p_type string")
    monkeypatch.setattr(searches, "table", lambda *_: asked)
    assert searches.description_requests(spark, "").count() == 0  # one row each, before the page
    assert ranked_ids == [[0]]


def test_tiered_answers_equal_requests_once(spark, blues, ranked_ids):
    asked = spark.createDataFrame([(n, "blue-1", "1.") for n in range(30)] + [(30, "blu", "1.2")], "request_id bigint, q string, version string")
    got = sorted(values(search.tiered(blues, asked), "request_id", "rnk", "tier", "entity_path"))
    assert got == [(n, 1, "exact", "blue-1") for n in range(30)] + [(30, 1, "prefix", "blue-2")]
    assert ranked_ids == [[0, 30]]


@pytest.mark.parametrize("name", ["search_exact_all", "search_exact_version_all"])
def test_exact_requests_of_equal_paths_are_ranked_once(spark, blues, ranked_ids, monkeypatch, name):
    from stratalog.plans import registry

    monkeypatch.setattr(registry, "iv", lambda *_: blues)
    monkeypatch.setattr(registry, "part_requests", lambda *_: spark.createDataFrame([(n, "blue-1", "1.") for n in range(30)], "request_id bigint, q string, version string"))
    assert sorted(values(registry.queries()[name](spark, ""), "request_id", "rnk", "entity_path")) == [(n, 1, "blue-1") for n in range(30)]
    assert ranked_ids == [[0]]


def test_suggestions_of_equal_requests_are_made_once(spark, blues, monkeypatch):
    seen, real = [], search.nearest_versions
    monkeypatch.setattr(search, "nearest_versions", lambda at: (seen.append(sorted(values(at, "request_id", "version"))), real(at))[1])
    asked = spark.createDataFrame([(n, "blue", "1.1") for n in range(20)] + [(20, "blue", "1.2")], "request_id bigint, q string, version string")
    got = sorted(values(search.suggest(blues, asked).filter("rnk = 1"), "request_id", "version"))
    assert got == [(n, "1.1") for n in range(20)] + [(20, "1.2")]
    assert seen == [[(r, f"1.{n}") for r in (0, 20) for n in range(3)]]


def test_prefix_paths_join_each_prefix_once(spark, blues, monkeypatch):
    from stratalog.plans import searches

    seen, real = [], search.prefix_join
    monkeypatch.setattr(search, "prefix_join", lambda rows, q, *more: (seen.append(q.count()), real(rows, q, *more))[1])
    monkeypatch.setattr(searches, "store", lambda *_: "")
    monkeypatch.setattr(snapshots, "read_intervals", lambda *_: blues.withColumn("path_lc", F.col("entity_path")))
    monkeypatch.setattr(searches, "table", lambda *_: spark.createDataFrame([(n, "blue 1x") for n in range(20)] + [(20, "blue 2")], "p_partkey bigint, p_name string"))
    assert sorted(values(searches.prefix_paths(spark, ""), "request_id", "n_intervals", "first_path")) == [(20, 1, "blue-2")]
    assert seen == [2]


def test_index_phrases_look_up_equal_phrases_once(spark, blues, monkeypatch):
    from stratalog.plans import ingest

    seen, real = [], text.phrase_hits
    monkeypatch.setattr(text, "phrase_hits", lambda tokens, asked: (seen.append(asked.count()), real(tokens, asked))[1])
    monkeypatch.setattr(ingest, "indexed", lambda *_: ("", []))
    monkeypatch.setattr(snapshots, "read_published", lambda *_: text.token_rows(blues))
    monkeypatch.setattr(ingest, "table", lambda *_: spark.createDataFrame([(n, "blue 1") for n in range(1, 21)], "p_partkey bigint, p_name string"))
    assert sorted(values(ingest.index_phrases(spark, ""), "request_id", "n_intervals", "first_path")) == [(2 * n, 1, "blue-1") for n in range(1, 21)]
    assert seen == [1]


def test_stream_files_grow_with_the_rows():
    from stratalog.plans import ingest

    assert [ingest.file_count(n) for n in (0, 600_000, 36_000_000, 216_000_000)] == [6, 6, 72, 432]


def test_gate_stream_batches_have_whole_snapshots_in_many_files(spark, monkeypatch):
    from types import SimpleNamespace

    from stratalog.plans import ingest

    seen, took = [], set()

    def fold_stream(stream, *_, **__):
        files = set(stream.sparkSession.read.parquet(place[0]).inputFiles()) - took
        took.update(files)
        seen.append((len(files), {tuple(r) for r in spark.read.parquet(*files).select("snapshot_date", "channel").distinct().collect()}))
        return SimpleNamespace(awaitTermination=lambda: None)

    place, real = [], ingest.folder
    monkeypatch.setattr(ingest, "folder", lambda s, name: (place.append(real(s, name)), place[-1])[1])
    monkeypatch.setattr(ingest, "STREAM_ROWS", 500)
    monkeypatch.setattr(jobs, "fold_stream", fold_stream)
    monkeypatch.setattr(snapshots, "read_published", lambda *_: spark.createDataFrame([], "channel string, era string, snapshot_date timestamp, n_entries bigint, status string"))
    ingest.stream_gate(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in seen] == [4, 4, 4]
    assert sum(len(s) for _, s in seen) == len(set().union(*[s for _, s in seen]))


def test_names_of_equal_requests_are_ranked_once(spark, blues, ranked_ids):
    asked = spark.createDataFrame([(n, "blue-1") for n in range(30)], "request_id bigint, q string")
    assert sorted(values(search.named(blues, asked, True), "request_id", "rnk", "entity_path")) == [(n, 1, "blue-1") for n in range(30)]
    assert ranked_ids == [[0]]


def test_observations_are_moved_once_before_their_wide_columns_are_made(spark, monkeypatch):
    monkeypatch.setattr(adapters, "DEAL_ROWS", 1000)  # 6,000 rows
    folded = fold.fold(adapters.observations(spark, DATA, True))
    assert folded.rdd.getNumPartitions() == 6
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression"):]
    assert "md5" not in moved and "spdxId" not in moved  # made after the move
    physical = folded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert physical.count("Exchange hashpartitioning") == 1
    assert sorted(map(repr, folded.collect())) == sorted(map(repr, fold.fold(adapters.observations(spark, DATA)).collect()))


def test_observations_are_dealt_into_no_more_parts_than_are_written_as_they_come(spark):
    parts = lambda n: adapters.dealt(spark.range(10), n, "id").rdd.getNumPartitions()
    assert parts(1_500_000) == 6 and parts(216_000_000) == 200
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        assert parts(10) == spark.sparkContext.defaultParallelism and parts(216_000_000) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_observations_of_many_parts_are_not_sorted_to_meet_them(spark, monkeypatch):
    monkeypatch.setattr(adapters, "hashed_side", lambda part: hashed_side(part, 100))  # of 200 parts
    hashed = adapters.observations(spark, DATA)
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    monkeypatch.setattr(adapters, "hashed_side", lambda part: hashed_side(part, 200))
    plain = adapters.observations(spark, DATA)
    assert "ShuffledHashJoin" not in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, hashed.collect())) == sorted(map(repr, plain.collect()))


def test_a_fold_sorts_an_observation_with_its_order_key_once(spark):
    obs = adapters.observations(spark, DATA)
    folded = fold.fold(obs)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "AS ord#" in plan and "AS last_ord#" not in plan and "AS last_commit#" not in plan.split("Sort [")[1]
    assert sorted(map(repr, folded.collect())) == sorted(map(repr, fold.intervals(fold.merge(fold.as_bounds(obs))).collect()))


@pytest.mark.parametrize("query", ["search_all_depths", "search_shallowest_version"])
def test_version_searches_rank_narrow_rows(spark, monkeypatch, query):
    moved, real = [], search.numbered
    monkeypatch.setattr(search, "numbered", lambda found, *a, **b: (moved.append(found.columns), real(found, *a, **b))[1])
    assert registry.queries()[query](spark, DATA).count()
    assert len(moved) == 1 and not {"description", "license_raw", "platforms_raw", "last_commit"} & set(moved[0])


def test_answers_that_many_requests_share_are_given_by_many_tasks(spark):
    asks = spark.range(0, 1000, 1, 1).select(F.col("id").alias("request_id"), F.lit(7).cast("bigint").alias("_ask"))
    answers = spark.range(0, 20, 1, 1).select(F.lit(7).cast("bigint").alias("request_id"), F.col("id").alias("rnk"))
    given = search.to_all(answers, asks)
    assert given.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(tuple, given.collect())) == [(r, n) for r in range(1000) for n in range(20)]


def test_many_requests_take_their_answers_in_many_tasks(spark):
    asks = spark.range(0, 1000, 1, 1).select(F.col("id").alias("request_id"), F.lit(7).cast("bigint").alias("_ask"))
    answers = spark.range(0, 20, 1, 1).select(F.lit(7).cast("bigint").alias("request_id"), F.col("id").alias("rnk"))
    for most, tasks in ((100, 2), (10, 1)):  # fewer answers than ``most``, and more
        given = search.to_all(answers, asks, most)
        assert given.select(F.spark_partition_id()).distinct().count() >= tasks
        assert sorted(map(tuple, given.collect())) == [(r, n) for r in range(1000) for n in range(20)]


def test_answers_of_many_requests_take_few_bytes_a_row(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(search, "GIVEN_ROWS", 40_000, raising=False)
    asks = spark.range(32_000).select((F.col("id") * 100).alias("request_id"), (F.col("id") * 7919 % 8).alias("_ask"))
    answers = spark.range(160).select((F.col("id") % 8).alias("request_id"), F.floor(F.col("id") / 8).alias("rnk"), F.concat(F.lit("blue-"), "id").alias("entity_path"))
    search.to_all(answers, asks).write.parquet(path := str(tmp_path / "given"))
    given = spark.read.parquet(path)
    assert given.count() == given.distinct().count() == 640_000  # each of 4,000 requests a question, and 20 answers
    assert given.join(asks, "request_id").filter("entity_path = 'blue-' || (rnk * 8 + _ask)").count() == 640_000
    assert sum(f.stat().st_size for f in (tmp_path / "given").glob("*.parquet")) < 1.5 * 640_000


def test_the_gate_counts_snapshots_once(spark):
    plan = registry.verdicts(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # the distinct entries of snapshots are counted before, not in each use
