"""Versioned datasets in buckets: copy on write, deltas, verification, concurrent writers; streams and runs on them."""

import datetime as dt
import json
import os
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalog import session
from stratalog.operators import fold, gate, history, search, text
from stratalog.plans import index_run
from stratalog.sources import large, presence, snapshots, versions
from stratalog.streaming import jobs

OBS = "entity_path string, version string, channel string, era string, snapshot_date timestamp_ntz, commit_hash string, name string, description string, license_raw string, advisories_raw string, platforms_raw string, source_path string"
KEY = ["k"]


def seen(spark, rows):
    """Observations (path, version, channel, day)."""
    full = [(p, v, c, "envelope", dt.datetime(2020, 1, 1) + dt.timedelta(days=d), f"{c}{d}", "n", None, None, None, None, None) for p, v, c, d in rows]
    return spark.createDataFrame(full, OBS).withColumn("ord", F.struct("snapshot_date", "channel"))


def put(spark, store, rows, gone=(), steps=(1,), buckets=8):
    """A version of a table (k, v) in which these rows are set and those keys gone."""
    new = spark.createDataFrame(rows, "k string, v long")
    touched = sorted({r.b for r in spark.createDataFrame([(k,) for k, _ in rows] + [(k,) for k in gone], "k string").select(versions.bucket_of(F.col("k"), buckets).alias("b")).collect()})
    if versions.versions(spark, store):
        out = {k for k, _ in rows} | set(gone)
        old = versions.read_table(spark, store, "t", buckets=touched).filter(~F.col("k").isin(*out))
        new = old.unionByName(new)
    return versions.publish({}, store, "x", bucketed={"t": versions.Bucketed(new, touched, KEY, "k", buckets)}, delta_steps=steps)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    store = str(tmp_path / "set")
    first = seen(spark, [(f"p{i}", "1", "a", i % 3) for i in range(1000)])
    with session.scratch():
        merged, whole, _ = index_run.merged_buckets(spark, store, fold.merge(fold.as_bounds(first)), 16)
        assert merged["bounds"].touched == list(range(16)) and whole.count() == 1000
        versions.publish({}, store, "0", bucketed=merged)
    few = [r.entity_path for r in first.filter(versions.bucket_of(F.col("entity_path"), 16).isin(3, 7)).limit(10).collect()]
    late = seen(spark, [(p, "1", "a", 9) for p in few] + [(few[0], "2", "b", 0)])
    with session.scratch():
        merged, whole, _ = index_run.merged_buckets(spark, store, fold.merge(fold.as_bounds(late)))  # the table keeps its 16 buckets
        assert merged["bounds"].touched == [3, 7] and merged["bounds"].buckets == 16 and whole.count() == 1001
        versions.publish({}, store, "1", bucketed=merged)
    files = [versions.files_of(versions.listing(spark, store, n), "bounds") for n in (0, 1)]
    assert {f: b for f, b in files[1].items() if b not in (3, 7)} == {f: b for f, b in files[0].items() if b not in (3, 7)}
    assert {p.parent.name for p in Path(store, "v=1", "bounds").rglob("*.parquet")} == {"bucket=3", "bucket=7"}
    want = fold.fold(first.unionByName(late))
    got = fold.intervals(snapshots.read_published(spark, store, "bounds"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # a reader of some buckets has their files alone
    assert {f.split("/bucket=")[1][0] for f in versions.read_table(spark, store, "bounds", buckets=[3]).inputFiles()} == {"3"}


def test_deltas_lead_every_version_to_the_newest(spark, tmp_path):
    store, have = str(tmp_path / "set"), []
    draw = random.Random(1)
    for n in range(7):
        rows = [(f"k{draw.randrange(40)}", n * 100 + i) for i in range(6)]
        put(spark, store, list(dict(rows).items()), [f"k{draw.randrange(40)}" for _ in range(3) if n] if n < 5 else [], steps=(1, 3))
        have.append(content(versions.read_table(spark, store, "t")))
    newest = have[-1]
    for n, rows in enumerate(have):
        old = spark.createDataFrame(rows, "k string, v long")
        assert content(versions.catch_up(spark, store, "t", old, n, KEY)) == newest, n
    edges = {(r["from"], r["to"]) for r in versions.listing(spark, store, 6) if r["from"] is not None}
    assert versions.chain(edges, 0, 6) == [(0, 3), (3, 6)] and versions.chain(edges, 6, 6) == []
    with pytest.raises(versions.NoChain):
        versions.chain(edges - {(5, 6), (3, 6)}, 0, 6)
    # a delta says what came, changed and went
    put(spark, store, [("k1", -1), ("new", 5)], ["k2", "not there"])
    was, step = dict(newest), versions.composed(versions.deltas(spark, store, "t", 6), KEY)
    want = {("insert", "new", 5), ("change" if "k1" in was else "insert", "k1", -1)} | ({("delete", "k2", None)} if "k2" in was else set())
    assert {(r.op, r.k, r.v) for r in step.collect()} == want
    # older versions go, but not the files and deltas that the newest lists
    versions.drop_versions(spark, store, 1)
    assert versions.versions(spark, store) == [7] and versions.verify(spark, store).count() == 0
    assert content(versions.catch_up(spark, store, "t", spark.createDataFrame(have[2], "k string, v long"), 2, KEY)) == content(versions.read_table(spark, store, "t"))


def test_damage_is_found(spark, tmp_path):
    store = str(tmp_path / "set")
    put(spark, store, [(f"k{i}", i) for i in range(50)])
    put(spark, store, [("k3", 0)])
    listed = [r["file"] for r in versions.listing(spark, store, 1) if r["file"]]
    plain = sorted(f for f in listed if "delta" not in f)
    assert versions.verify(spark, store).count() == 0
    for sums in Path(store).rglob("*.crc"):  # of the local file system alone
        sums.unlink()
    with open(f"{store}/{plain[0]}", "r+b") as f:
        f.seek(8)
        f.write(b"\0\0")
    os.remove(f"{store}/{plain[1]}")
    shutil.copy(f"{store}/{plain[2]}", f"{store}/v=1/t/more.parquet")
    assert {(r.file, r.problem) for r in versions.verify(spark, store).collect()} == {(plain[0], "changed"), (plain[1], "missing"), ("v=1/t/more.parquet", "extra")}
    delta = next(f for f in listed if "delta" in f)
    with open(f"{store}/{delta}", "ab") as f:
        f.write(b"x")
    with pytest.raises(versions.Damaged, match="is changed"):
        versions.deltas(spark, store, "t", 0)


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "set")
    put(spark, store, [("a", 1)])
    assert versions.claimed(spark, store) == 1 and versions.claimed(spark, store) == 2  # folders that others have are taken by nobody
    own, other = versions.made, []

    def meanwhile(*args):
        if not other:
            other.append(1)
            put(spark, store, [("a", 2)])
        return own(*args)

    monkeypatch.setattr(versions, "made", meanwhile)
    with pytest.raises(versions.Outdated):
        put(spark, store, [("a", 3)])
    assert content(versions.read_table(spark, store, "t")) == [("a", 2)]


def test_an_empty_table_is_published_too(spark, tmp_path):
    store = str(tmp_path / "set")
    empty = spark.createDataFrame([], "k string, v long")
    versions.publish({"whole": empty}, store, "x", bucketed={"t": versions.Bucketed(empty, [], KEY, "k")})
    assert versions.read_table(spark, store, "t").columns == ["k", "v"] and versions.read_table(spark, store, "whole").count() == 0
    with pytest.raises(ValueError, match="no table other"):
        versions.read_table(spark, store, "other")


def left_over(spark):
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {p for p in os.listdir(top) if p.startswith("stratalog-")}


def test_nothing_stays_behind(spark, tmp_path):
    before = left_over(spark)
    rows = spark.createDataFrame([("pen", "1", 0, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1), "pen", None, "[]", None)], "entity_path string, version string, depth bigint, first_date timestamp_ntz, last_date timestamp_ntz, name string, license_raw string, advisories_raw string, platforms_raw string")
    with session.scratch():
        assert search.search(rows, spark.createDataFrame([(1, "pe")], "request_id long, q string")).count() == 1
    for n in range(10):
        seen(spark, [("p", "1", "a", n)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(seen(spark, [("p", "1", "a", 0)]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.fold_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), buckets=2)
    query.awaitTermination()
    assert len(query.recentProgress) >= 10 and left_over(spark) == before
    assert [p.name for p in (tmp_path / "out").glob("v=*") if (p / "manifest").exists()] and len(versions.versions(spark, str(tmp_path / "out"))) == 2


@pytest.mark.parametrize("split", [1, 2])
def test_any_split_into_batches_gives_the_batch_verdicts(spark, tmp_path, split):
    sizes = [100, 60, 75, 69, 90, 50, 72, 100, 30, 71]
    days = list(range(len(sizes)))
    obs = seen(spark, [(f"p{i}", "1", c, d) for c in "ab" for d, n in enumerate(sizes) for i in range(n)])
    draw = random.Random(split)
    draw.shuffle(days)
    for part in (days[i : i + 4] for i in range(0, len(days), 4)):
        dates = [dt.datetime(2020, 1, 1) + dt.timedelta(days=d) for d in part]
        obs.filter(F.col("snapshot_date").isin(dates)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = str(tmp_path / "out")
    jobs.fold_stream(stream, store, str(tmp_path / "ck"), gated=True, expected=obs.select(*gate.SNAPSHOT).distinct(), buckets=2).awaitTermination()
    counts = obs.groupBy(*gate.SNAPSHOT).agg(F.count("*").alias("n_entries"))
    want = {(r.channel, r.snapshot_date): r.verdict == "fail" for r in gate.judged(counts).collect()}
    got = {(r.channel, r.snapshot_date): r.status == "failed" for r in snapshots.read_published(spark, store, "ledger").collect()}
    assert got == want and snapshots.read_published(spark, store, "held").isEmpty()
    good = fold.fold(gate.accepted(obs, gate.judged(counts)))
    assert fold.intervals(snapshots.read_published(spark, store, "bounds")).exceptAll(good).isEmpty()


def test_a_missing_snapshot_is_waited_for_until_patience_is_over(spark):
    batch = seen(spark, [("p", "1", "a", d) for d in (2, 3, 5)])
    none = batch.select(*gate.SNAPSHOT).limit(0)
    expected = seen(spark, [("p", "1", "a", d) for d in (1, 2, 3, 4, 5)]).select(*gate.SNAPSHOT)
    days = lambda **k: sorted(r.snapshot_date.day - 1 for r in jobs.ready(batch, k.get("seen", none), expected, k.get("patience")).collect())
    assert days() == [] and days(seen=expected.filter("day(snapshot_date) = 2")) == [2, 3]
    assert days(patience="3 days") == [2, 3]  # the first is over, the fourth isn't
    assert days(patience="1 hour") == [2, 3, 5]


@pytest.mark.parametrize("from_size", [1 << 30, 50])
def test_releases_of_one_date_are_judged_each_by_itself(spark, tmp_path, monkeypatch, from_size):
    monkeypatch.setattr(index_run, "LARGE", from_size)  # the same whether documents are read whole or in fragments
    docs, store = tmp_path / "docs", str(tmp_path / "store")
    day = dt.datetime(2024, 3, 8)
    text = lambda n, v: json.dumps({"version": 2, "packages": {f"p{i}": {"version": v} for i in range(n)}})
    for channel, name, n, v in (("x", "r0", 100, "1"), ("x", "r1", 100, "2"), ("x", "r2", 3, "3"), ("y", "r1", 90, "4")):
        (docs / f"channel={channel}").mkdir(parents=True, exist_ok=True)
        (docs / f"channel={channel}" / f"{name}.json").write_text(text(n, v))
    listing = [("x", "r0", "0" * 40, day - dt.timedelta(1), "envelope"), ("x", "r1", "1" * 40, day, "envelope"), ("x", "r2", "2" * 40, day, "envelope"), ("y", "r1", "3" * 40, day, "envelope")]
    listing = spark.createDataFrame(listing, "channel string, release_name string, commit_hash string, release_date timestamp_ntz, era string")
    report = index_run.run(spark, listing, str(docs), store, "2024-03-09 12:00:00", parse=False, options=index_run.Options(buckets=2)).first()
    assert (report.planned, report.ingested, report.failed) == (4, 3, 1)
    book = {(r.channel, r.release_name): (r.status, r.n_entries, r.error) for r in snapshots.read_published(spark, store, "ledger").collect()}
    assert book == {("x", "r0"): ("ingested", 100, None), ("x", "r1"): ("ingested", 100, None), ("x", "r2"): ("failed", 3, "count 3 under 70% of 100"), ("y", "r1"): ("ingested", 90, None)}
    rows = {(r.version, r.first_commit): 0 for r in snapshots.read_intervals(spark, store).collect()}
    assert set(rows) == {("1", "0" * 40), ("2", "1" * 40), ("4", "3" * 40)}


def test_activity_state_is_dropped(spark, tmp_path):
    """2,000 minutes in order, a batch each 100: the state never has more than the delay's minutes and one batch's."""
    rows = spark.range(4000).select((F.timestamp_seconds(F.col("id") * 30)).alias("ts"), F.floor(F.col("id") / 200).alias("b"))
    for b in range(20):
        rows.filter(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.keep_counts(jobs.activity_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"), buckets=2)
    query.awaitTermination()
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert len(states) >= 20 and max(states) <= 220
    kept = snapshots.read_published(spark, str(tmp_path / "out"), "minutes")
    assert kept.count() == 2000 and kept.filter("n_events <> 2").isEmpty()


def test_entries_with_an_empty_path_are_dropped(spark):
    raw = spark.createDataFrame([("f", "", '{"version":"1"}'), ("f", '""', '{"version":"1"}'), ("f", "a", '{"version":"1"}')], "file string, raw_path string, e string").select("file", "raw_path", F.parse_json("e").alias("entry"))
    assert [r.entity_path for r in snapshots.normalize(raw).collect()] == ["a"]


# prefixes, words, counts


def test_many_prefixes_read_the_files_that_they_hit(spark, tmp_path):
    store, draw = str(tmp_path / "set"), random.Random(3)
    paths = sorted({"".join(draw.choices("abcdefghij", k=draw.randint(3, 9))) for _ in range(4000)})
    rows = spark.createDataFrame([(p, "1", 0) for p in paths], "entity_path string, version string, depth bigint")
    versions.publish({"intervals": snapshots.laid_out(rows, 4)}, store, "x", orders={"intervals": "path_lc"})
    files = versions.files_of(versions.listing(spark, store, 0), "intervals")
    assert len(files) == 4 and len({r["low"] for r in versions.listing(spark, store, 0)}) == 4
    asked = spark.range(100_000).select("id", F.concat(*[F.substring(F.lit("ABCDEFGHIJ"), (F.floor(F.col("id") / 10**k) % 10 + 1).cast("int"), F.lit(1)) for k in range(5)]).alias("q"))
    requests = asked.select(F.col("id").alias("request_id"), F.left("q", (F.col("id") % 5 + 1).cast("int")).alias("q"))
    read = lambda r: versions.read_table(spark, store, "intervals", prefixes=r.select(F.lower("q")))
    found = search.prefix_join(read(requests), requests)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "StartsWith" not in plan
    starts = {}
    for p in paths:
        for n in range(1, 6):
            starts[p[:n]] = starts.get(p[:n], 0) + (len(p) >= n)
    want = sum(starts.get(r.q.lower(), 0) for r in requests.collect())
    assert found.count() == want
    low = read(requests.filter("startswith(q, 'A')"))
    assert len(low.inputFiles()) < 4 and search.prefix_join(low, requests.filter("startswith(q, 'A')")).select("entity_path").distinct().count() == sum(p.startswith("a") for p in paths)
    assert read(spark.createDataFrame([("zz",)], "q string")).count() == 0 and read(requests.limit(0)).count() == 0


def test_words_with_places_answer_phrases(spark):
    draw = random.Random(6)
    words = ["on", "the", "Été", "x-ray", "of", "rare1", "the of"]
    rows = spark.createDataFrame([(f"p{i}", "1", " ".join(draw.choices(words[:5], k=3)), " ".join(draw.choices(words, k=draw.randint(0, 12))) if i % 7 else None) for i in range(200)], "entity_path string, version string, name string, description string")
    asked = [" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(60)] + ["", "?!", "nowhere", "the nowhere", "the the"]
    requests = spark.createDataFrame(list(enumerate(asked)), "request_id long, phrase string")
    tokens = text.token_rows(rows)
    want = {(r.request_id, r.entity_path) for r in text.description_search(rows, requests).collect()}
    got = text.phrase_hits(tokens, requests).collect()
    assert {(r.request_id, r.entity_path) for r in got} == want and len(got) == len(want)


def test_words_and_counts_follow_later_runs(spark, tmp_path):
    store = str(tmp_path / "set")
    fresh = lambda rows: fold.merge(fold.as_bounds(seen(spark, rows).withColumns({"name": F.concat(F.lit("n "), F.substring("entity_path", 1, 2)), "description": F.concat(F.lit("seen on "), "commit_hash")})))
    for day, rows in enumerate(([(f"p{i}", "1", "a", 0) for i in range(60)], [("p3", "1", "a", 1), ("p61", "2", "a", 1)], [("p3", "1", "b", 2)])):
        with session.scratch():
            merged, whole, counts = index_run.merged_buckets(spark, store, fresh(rows), 4, tokens=day == 1)
            stats = history.counted_stats(fold.intervals(whole), counts)
            assert content(stats) == content(history.index_stats(fold.intervals(whole)))
            versions.publish({}, store, str(day), bucketed=merged)
    bounds = snapshots.read_published(spark, store, "bounds")
    assert content(snapshots.read_published(spark, store, "counts").select("kind", "key", "n")) == content(history.key_counts(bounds))
    cols = ["entity_path", "version", "column", "pos", "token"]
    assert content(snapshots.read_published(spark, store, "tokens").select(cols)) == content(text.token_rows(bounds).select(cols))
    gone = history.moved_counts(bounds, bounds.filter("entity_path <> 'p61'"))
    assert content(history.added_counts(history.key_counts(bounds), gone)) == content(history.key_counts(bounds.filter("entity_path <> 'p61'")))


def test_sketches_merge_within_their_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("k"), F.timestamp_seconds(F.col("id") / 40).alias("ts"), (F.xxhash64("id") % 1_000_000).cast("double").alias("v"))
    got = {r.key: r for r in history.merged_percentiles(history.latency_sketches(rows, "k", "v", "ts"), ["key"]).collect()}
    for k, r in got.items():
        values = sorted(x.v for x in rows.filter(F.col("k") == k).collect())
        assert r.n == len(values) == 20_000
        assert all(abs(sum(v <= p for v in values) / r.n - q) <= 0.03 for q, p in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)))


def test_a_new_snapshot_reads_its_neighbours_alone(spark, tmp_path):
    draw, store = random.Random(9), str(tmp_path / "presence")
    obs = seen(spark, [(f"p{i}", "1", c, d) for c in "ab" for d in range(8) for i in range(40) if draw.random() < 0.7]).withColumn("release_name", F.date_format("snapshot_date", "'r'd"))
    presence.put(obs.filter("day(snapshot_date) <> 4"), store)
    snaps = obs.select(*presence.KEY).distinct()
    want = content(gate.births_deaths(obs).select("channel", "snapshot_date", "births", "deaths", "born", "died"))
    presence.put(obs.filter("day(snapshot_date) = 4"), store)
    new = snaps.filter("channel = 'a' and day(snapshot_date) = 4")
    due, needed = presence.neighbours(snaps, new)
    assert sorted(r.snapshot_date.day for r in due.collect()) == [4, 5] and sorted(r.snapshot_date.day for r in needed.collect()) == [3, 4, 5]
    rows = presence.read(spark, store, needed)
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pruned = next(line for line in plan.splitlines() if line.startswith("PartitionFilters") and "channel" in line)  # the folders of others are not read
    assert "2020-01-04T000000.000000" in pruned and "2020-01-06" not in pruned and "day" in pruned
    assert {(r.channel, r.snapshot_date.day) for r in rows.collect()} == {("a", 3), ("a", 4), ("a", 5)}
    got = content(presence.turnover(spark, store, snaps, new).select("channel", "snapshot_date", "births", "deaths", "born", "died"))
    assert got == [r for r in want if r[0] == "a" and r[1].day in (4, 5)]
    assert content(presence.turnover(spark, store, snaps, snaps).select("channel", "snapshot_date", "births", "deaths", "born", "died")) == want


# one large document


def odd_entry(draw):
    text = draw.choice(["plain", 'quote " brace } {', "back\\slash\\", "}{}", '\\"}', "é\n", "", "a,b"])
    return {"version": draw.choice(["1", "2"]), "meta": {"description": text, "x": {"y": [{}, {"z": text}]}}} if draw.random() < 0.9 else draw.choice([5, [1, {"a": 2}], {}, "text }"])


def both_readers(spark, folder, bare=False):
    out = []
    for rows, bad in (large.read_large(spark, str(folder), bare), (snapshots.read_bare if bare else snapshots.read_envelopes)(spark, str(folder))):
        name = F.regexp_extract("file", r"([^/]+)$", 1)
        out.append((sorted(map(tuple, rows.select(name, "raw_path", F.to_json("entry")).collect())), sorted(r[0] for r in bad.select(name).collect())))
    return out


@pytest.mark.parametrize("bare", [False, True])
def test_documents_in_fragments_are_read_as_whole_ones(spark, tmp_path, bare):
    draw, before = random.Random(bare), spark.conf.get("spark.sql.files.maxPartitionBytes")
    entries = {f"p{i}.{'q' * (i % 7)}": odd_entry(draw) for i in range(3000)}
    wrap = (lambda e, v=2: e) if bare else (lambda e, v=2: {"version": v, "packages": e})
    text = json.dumps(wrap(entries), indent=1)
    some = dict(list(entries.items())[:5])
    files = {
        "whole": text, "cut": text[: len(text) // 2], "no_end": text.rstrip()[:-1], "more": text + "}", "blank_end": text + "\n \n", "tight": json.dumps(wrap(entries), separators=(",", ":")), "empty": json.dumps(wrap({})), "few": json.dumps(wrap(some)),
        "scalars": json.dumps(wrap({"a": 1, "b": {"version": "1"}, "c": "x"})), "no_comma": json.dumps(wrap(some)).replace('}, "p1', '} "p1'), "nothing": "{", "list": "[]",
    }
    if not bare:
        files |= {"other": json.dumps(wrap(some, 3)), "version_last": json.dumps({"packages": some, "version": "2"})}
    for name, t in files.items():
        (tmp_path / name).write_text(t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text) // 8))
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "whole")).rdd.getNumPartitions() >= 8
        ours, theirs = both_readers(spark, tmp_path, bare)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    more = [r for r in theirs[0] if r[0] == "more"]  # a whole text's parser passes over what follows the document
    assert ours[1] == sorted({*theirs[1], "more"})
    assert ours[0] == [r for r in theirs[0] if r not in more] and len(ours[0]) > 8000
