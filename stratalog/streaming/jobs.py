"""Incremental forms: fold of late data, snapshot documents as they arrive, per-minute counts, sliding latency percentiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fold, gate, history
from ..plans import index_run
from ..session import scratch, small_side, stored
from ..sources.versions import BUCKETS, Bucketed, bucket_count, bucket_of, drop_versions, latest_of, publish, read_table, versions

LAST = 1024
MARKS = "n_entries bigint, status string, batch bigint"


def done(spark: SparkSession, store: str, n: int) -> bool:
    """Batch ``n`` is published already: it is repeated after a failure."""
    return bool(versions(spark, store)) and int(latest_of(spark, store)) >= n


def ready(batch: DataFrame, seen: DataFrame, expected: DataFrame, patience: str | None) -> DataFrame:
    """The snapshots of ``batch`` that no expected one goes before which has not come yet (in ``batch`` or ``seen``), by channel and era.

    With ``patience``, an interval, one that is missing is waited for no longer once its channel and era has one newer by that.
    """
    key = gate.key_of(batch)
    turn = F.struct(*[c for c in key if c not in ("channel", "era")])
    mine = batch.select(*key).distinct()
    come = mine.unionByName(seen.select(*key)).distinct()
    missing = expected.select(*key).distinct().join(come, key, "left_anti")
    if patience:
        newest = come.groupBy("channel", "era").agg(F.max("snapshot_date").alias("newest"))
        missing = missing.join(newest, ["channel", "era"]).filter(F.col("snapshot_date") >= F.col("newest") - F.expr(f"interval {patience}"))
    gap = missing.groupBy("channel", "era").agg(F.min(turn).alias("gap"))
    return mine.withColumn("turn", turn).join(gap, ["channel", "era"], "left").filter(F.col("gap").isNull() | (F.col("turn") < F.col("gap"))).select(*key)


def fold_stream(obs: DataFrame, store: str, checkpoint: str, gated: bool = False, floors: DataFrame | None = None, expected: DataFrame | None = None, patience: str | None = None, buckets: int = BUCKETS):
    """Fold a stream of observations into the bounds published under ``store``, together with a ledger of the snapshots seen.

    Late rows are never dropped: bounds only widen. Each batch publishes bounds (the buckets that it touches) and ledger at once as a new version that names the batch, so a batch
    that is repeated after a failure finds itself done. ``gated``: a batch's snapshots are judged in date order, with what
    earlier batches accepted as baseline, whatever order their rows come in; a failed one writes no rows. A snapshot must lie in one batch whole then.
    ``expected`` lists the snapshots (their columns as in observations) that are to come: one that comes before its predecessors waits in the table ``held``, published
    with the rest, until these have come or ``patience`` is over (see ``ready``); so any split into batches gives the same verdicts.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if done(spark, store, n):
            return
        with scratch():
            there = versions(spark, store)
            key = gate.key_of(batch)
            kinds = dict(batch.dtypes)
            seen = read_table(spark, store, "ledger") if there else spark.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in key) + f", {MARKS}")
            tables = {}
            if expected is not None:
                batch = stored(batch.unionByName(read_table(spark, store, "held")) if there else batch)
                now = small_side(stored(ready(batch, seen, expected, patience)))
                tables["held"] = batch.join(now, key, "left_anti")
                batch = batch.join(now, key, "left_semi")
            batch = stored(batch)
            counts = stored(batch.groupBy(*key).agg(F.count("*").alias("n_entries")))
            status = F.lit("ingested")
            if gated:
                before = seen.filter("status = 'ingested'").select(*key, "n_entries")
                judged = stored(gate.judged(before.unionByName(counts), floors).join(counts.select(*key), key, "left_semi"))
                batch = gate.accepted(batch, judged)
                counts, status = judged.select(*key, "n_entries", "verdict"), F.when(F.col("verdict") == "fail", "failed").otherwise("ingested")
            marks = counts.select(*key, "n_entries", status.alias("status"), F.lit(n).cast("bigint").alias("batch"))
            merged, _, _ = index_run.merged_buckets(spark, store, fold.merge(fold.as_bounds(batch)), buckets)
            publish({**tables, "ledger": seen.unionByName(marks)}, store, str(n), bucketed=merged)
            drop_versions(spark, store, keep=2)

    return obs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(spark: SparkSession, documents: str, listing: Callable[[], DataFrame], store: str, checkpoint: str, now: Column | str, **gates):
    """Run the index for snapshot documents as they arrive in a folder; the ledger decides what is still to be done.

    ``listing()`` gives the rows known at that time (see ``index_run.run``); a batch takes those whose documents have come with it, and lists no folder.
    """

    def ingest(batch: DataFrame, n: int) -> None:
        paths = [r.path for r in batch.select("path").distinct().collect()]  # one for each document file of the batch
        came = batch.sparkSession.createDataFrame([(p,) for p in paths], "path string").select(index_run.of_path("path")[0]).distinct()
        index_run.run(batch.sparkSession, listing().join(came, "release_name", "left_semi"), paths, store, now, **gates)

    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("recursiveFileLookup", "true").load(documents).select("path")  # contents are not read
    return files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_stream(events: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Events per minute. A minute's state is dropped ``delay`` after it, by the events' own time; later events of it are not counted."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", "1 minute").alias("w")).agg(F.count("*").alias("n_events")).select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "n_events")


def keep_counts(counts: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS):
    """Keep the counts of ``activity_stream`` under ``store``: each batch puts in the minutes that it changed, and publishes the buckets that have them."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if done(spark, store, n):
            return
        with scratch():
            new, parts = stored(batch), bucket_count(spark, store, "minutes", buckets)
            touched = sorted(r[0] for r in new.select(bucket_of(F.col("minute"), parts).alias("b")).distinct().collect())  # at most ``parts``
            if versions(spark, store):
                new = new.unionByName(read_table(spark, store, "minutes", buckets=touched).join(new, "minute", "left_anti"))
            publish({}, store, str(n), bucketed={"minutes": Bucketed(new, touched, ["minute"], "minute", parts, False)})
            drop_versions(spark, store, keep=2)

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_last_values(events: DataFrame, store: str, checkpoint: str, key: str = "event_type", value: str = "value", ts: str = "ts", last: int = LAST, buckets: int = BUCKETS):
    """Keep the ``last`` newest values of each key of a stream under ``store``, in the table ``recent`` (key, value, at).

    Late rows count by their own time, whatever batch they come in; rows without a value or a time don't count. Each batch is cut first, a
    frequent key by many tasks, and publishes the buckets of its keys; ``history.latency_percentiles`` of the table is that of all rows so far.
    """
    rows = events.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(ts).alias("at")).filter("value is not null and at is not null")

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if done(spark, store, n):
            return
        with scratch():
            cut = lambda df: history.last_values(df, "key", "value", "at", last)
            new, parts = stored(cut(batch)), bucket_count(spark, store, "recent", buckets)
            touched = index_run.touched_by(new, "key", parts)
            if versions(spark, store):
                new = cut(new.unionByName(read_table(spark, store, "recent", buckets=touched)))
            publish({}, store, str(n), bucketed={"recent": Bucketed(new, touched, ["key", "at", "value"], "key", parts, False)})
            drop_versions(spark, store, keep=2)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dense(counts: DataFrame, minutes: int = 30) -> DataFrame:
    """The last ``minutes`` minutes of per-minute counts up to the newest one, none left out."""
    spine = counts.agg(F.max("minute").alias("end")).filter("end is not null").select(F.explode(F.sequence(F.col("end") - F.make_interval(mins=F.lit(minutes - 1)), F.col("end"), F.expr("interval 1 minute"))).alias("minute"))
    return spine.join(counts, "minute", "left").select("minute", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def percentile(values: list[float], q: float) -> float:
    """Nearest rank: the value at round((n - 1) * q); 0 without values."""
    return sorted(values)[int((len(values) - 1) * q + 0.5)] if values else 0.0


def latency_stream(events: DataFrame, key: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """Percentiles of the LAST values of each key by time, updated with every batch."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = sorted(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held = sorted([*held, *zip(b["at"].tolist(), b["value"].tolist(), strict=True)])[-LAST:]
        state.update(([t for t, _ in held], [v for _, v in held]))
        values = [v for _, v in held]
        yield pd.DataFrame({"key": [k[0]], "n": [len(values)], "p50": [percentile(values, 0.5)], "p95": [percentile(values, 0.95)], "p99": [percentile(values, 0.99)]})

    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, p50 double, p95 double, p99 double", "at array<bigint>, held array<double>", "update", GroupStateTimeout.NoTimeout)
