"""Completeness gates of snapshots: floors, rolling baseline, sentinels, births and deaths.

A snapshot is (channel, era, snapshot_date) and, where rows have one, its ``release_name``: a channel can have several releases of one date, each of
which is judged by itself, in the order of their names. The era names the form of its source. Tables of floors and sentinels are short
dimension tables; ``floor_ladder`` and ``sentinels`` make the usual ones.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import small_side, stored

#: Shares of the baseline under which a snapshot fails or warns, length of the baseline, share and number of deaths that warn.
FAIL, WARN, LAST, DEATH_SHARE, DEATHS = 0.70, 0.90, 10, 0.05, 50
#: Least number of entries by era and, up to a year (None: from then on), and paths that must be there from a date on (fixed values).
FLOORS = {
    "bare": ((2016, 8_000), (2017, 10_000), (2018, 12_000), (2019, 15_000), (None, 18_000)),
    "envelope": ((2020, 50_000), (2021, 60_000), (2022, 75_000), (2023, 90_000), (2024, 100_000), (2025, 115_000), (None, 130_000)),
}
SENTINELS = (("firefox", "^firefox$", None), ("thunderbird", "^thunderbird$", None), ("python*Packages.requests", "^python[0-9]+Packages[.]requests$", None), ("nh", "^nh$", "2024-01-15"))
SNAPSHOT = ["channel", "era", "snapshot_date"]


def key_of(df: DataFrame) -> list[str]:
    """The columns that name a snapshot."""
    return [*SNAPSHOT, *[c for c in ("release_name",) if c in df.columns]]


def floor_ladder(spark: SparkSession, floors: dict = FLOORS) -> DataFrame:
    """(era, from_year, to_year, floor): one row for each step."""
    rows = []
    for era, steps in floors.items():
        start = 0
        for year, floor in steps:
            rows.append((era, start, 9999 if year is None else year, floor))
            start = (year or 0) + 1
    return spark.createDataFrame(rows, "era string, from_year int, to_year int, floor bigint")


def sentinels(spark: SparkSession, listed=SENTINELS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(label, pattern, active_from, era): a null date or era holds for all; ``extra`` are exact paths."""
    rows = [(label, pattern, since, None) for label, pattern, since in listed] + [(p, "^" + "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in p) + "$", None, None) for p in extra]
    return spark.createDataFrame(rows, "label string, pattern string, since string, era string").select("label", "pattern", F.col("since").cast("timestamp_ntz").alias("active_from"), "era")


def counts(obs: DataFrame) -> DataFrame:
    """Per snapshot: rows, distinct (path, version) entries and distinct paths."""
    return obs.groupBy(*[c for c in key_of(obs) if c in obs.columns]).agg(F.count("*").alias("n_rows"), F.count_distinct("entity_path", "version").alias("n_entries"), F.count_distinct("entity_path").alias("n_paths"))


def rolling_baseline(snapshots: DataFrame) -> DataFrame:
    """The baseline without feedback: the largest of all of the last ten counts of a channel."""
    order = [c for c in key_of(snapshots) if c not in ("channel", "era")]
    w = W.partitionBy("channel").orderBy(*order).rowsBetween(-LAST, -1)
    return snapshots.select("channel", *order, "n_entries", F.max("n_entries").over(w).alias("baseline"))


def missing_sentinels(obs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A snapshot's columns and ``label`` of the sentinels due in a snapshot that none of its paths matches.

    Paths are tested once each, however many snapshots have them; only the few that match any pattern are joined with the snapshots.
    """
    key = key_of(obs)
    wanted = small_side(wanted)
    patterns = wanted.select("label", "pattern").distinct()
    hits = stored(obs.select("entity_path").distinct().join(small_side(patterns), F.expr("rlike(entity_path, pattern)")).select("entity_path", "label"))
    met = obs.select(*key, "entity_path").join(small_side(hits), "entity_path").select(*key, "label").distinct()
    snaps = obs.select(*key).distinct()
    w = wanted.withColumnRenamed("era", "only")
    due = snaps.join(small_side(w), (F.col("active_from").isNull() | (F.col("snapshot_date") >= F.col("active_from"))) & (F.col("only").isNull() | (F.col("only") == F.col("era"))))
    return due.select(*key, "label").join(met, [*key, "label"], "left_anti")


def step(recent: deque[int], n_entries: int, failures: list[str]) -> tuple[int | None, list[str], list[str]]:
    """Judge one count against the largest of the ``recent`` accepted ones: baseline, failures, warnings. An accepted count joins ``recent``."""
    base = max(recent) if recent else None
    failures, warnings = list(failures), []
    if base is not None and n_entries < int(base * FAIL):
        failures.append(f"count {n_entries} under 70% of {base}")
    elif base is not None and n_entries < int(base * WARN):
        warnings.append(f"count {n_entries} under 90% of {base}")
    if not failures:
        recent.append(n_entries)
    return base, sorted(failures), warnings


def verdicts(pdf: pd.DataFrame) -> pd.DataFrame:
    """One channel and era in order: each count against the largest of the last ten accepted ones."""
    recent: deque[int] = deque(maxlen=LAST)
    key = [c for c in [*SNAPSHOT, "release_name"] if c in pdf.columns]
    pdf = pdf.sort_values(key)
    told = [step(recent, n, f) for n, f in zip(pdf["n_entries"].tolist(), pdf["failures"], strict=True)]
    made = pdf[[*key, "n_entries"]].reset_index(drop=True)
    made[["baseline", "failures", "warnings"]] = pd.DataFrame(told, columns=["baseline", "failures", "warnings"], dtype=object)
    return made.astype({"baseline": "Int64"})


def verdict(failures: Column, warnings: Column) -> Column:
    return F.when(F.size(failures) > 0, "fail").when(F.size(warnings) > 0, "warn").otherwise("pass")


def unready(snapshots: DataFrame, floors: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """Snapshots with ``n_entries`` and the ``failures`` that don't depend on others: under the floor, a sentinel missing."""
    key = key_of(snapshots)
    rows = snapshots.select(*key, "n_entries").withColumn("failures", F.array().cast("array<string>"))
    if floors is not None:
        low = rows.join(small_side(floors), "era").filter((F.year("snapshot_date").between(F.col("from_year"), F.col("to_year"))) & (F.col("n_entries") < F.col("floor")))
        rows = failing(rows, low.select(*key, F.concat(F.lit("count "), F.col("n_entries").cast("string"), F.lit(" under floor "), F.col("floor").cast("string")).alias("why")))
    if missing is not None:
        rows = failing(rows, missing.select(*key, F.concat(F.lit("sentinel missing: "), "label").alias("why")))
    return rows


JUDGED = "n_entries bigint, baseline bigint, failures array<string>, warnings array<string>"


def judged(snapshots: DataFrame, floors: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """A snapshot's columns and ``n_entries, baseline, failures, warnings, verdict``.

    Fails: fewer entries than its era's and year's floor, a sentinel missing, or under 70% of the baseline, which is the largest of the last
    ten *accepted* counts of its channel and era before it; under 90% warns. A verdict changes later baselines, so each channel and era is
    judged in order of date and release name by one task. It has one short row per snapshot (daily for a century is under 40,000).
    """
    rows = unready(snapshots, floors, missing)
    kinds = {"snapshot_date": "timestamp_ntz"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in key_of(rows)) + f", {JUDGED}"
    out = rows.groupBy("channel", "era").applyInPandas(verdicts, schema)
    return out.withColumn("verdict", verdict(F.col("failures"), F.col("warnings")))


def failing(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    key = key_of(rows)
    more = reasons.groupBy(*key).agg(F.collect_list("why").alias("more"))
    return rows.join(more, key, "left").withColumn("failures", F.concat("failures", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def births_deaths(obs: DataFrame, accepted_only: DataFrame | None = None) -> DataFrame:
    """Paths that appear or vanish from one snapshot of a channel to the next, with the eight smallest of each as samples.

    With verdicts only accepted snapshots are compared, each with the accepted one before it; across eras nothing is told. More deaths
    than 5% of the previous paths (at least 50) warn. Each path's snapshots are looked through in turn, one short row for each, so no snapshot's paths are gathered anywhere.
    """
    if accepted_only is not None:
        obs = accepted(obs, accepted_only)
    key = key_of(obs)
    paths = stored(obs.select(*key, "entity_path").distinct())
    in_turn = W.partitionBy("channel").orderBy(*[c for c in key if c not in ("channel", "era")])
    order = stored(paths.select(*key).distinct().withColumns({"n": F.row_number().over(in_turn), "same": F.lag("era").over(in_turn) == F.col("era")}))
    p = paths.join(small_side(order), key).select("channel", "n", "entity_path")
    # of a path's snapshots in turn, one without the one before it is a birth, and one without the one after it a death in that
    last = order.groupBy("channel").agg(F.max("n").alias("last"))
    by_path = W.partitionBy("channel", "entity_path").orderBy("n")
    ends = p.join(small_side(last), "channel").withColumns({"was": F.lag("n").over(by_path), "next": F.lead("n").over(by_path)})
    born = F.when((F.col("n") > 1) & (F.coalesce("was", F.lit(0)) < F.col("n") - 1), F.struct(F.col("n").alias("n"), F.lit(1).alias("now")))
    died = F.when((F.col("n") < F.col("last")) & (F.coalesce("next", F.lit(0)) != F.col("n") + 1), F.struct((F.col("n") + 1).alias("n"), F.lit(0).alias("now")))
    change = ends.select("channel", "entity_path", F.explode(F.array_compact(F.array(born, died))).alias("e")).select("channel", "entity_path", "e.n", "e.now")
    change = stored(change)
    # the eight smallest of each half of 64, then of all: no task sorts a whole snapshot
    part = F.pmod(F.xxhash64("entity_path"), F.lit(64))
    few = change.withColumn("k", F.row_number().over(W.partitionBy("channel", "n", "now", part).orderBy("entity_path"))).filter("k <= 8")
    few = few.withColumn("k", F.row_number().over(W.partitionBy("channel", "n", "now").orderBy("entity_path"))).filter("k <= 8")
    sample = lambda now: F.array_join(F.array_sort(F.collect_list(F.when(F.col("now") == now, F.col("entity_path")))), ",")
    samples = few.groupBy("channel", "n").agg(sample(1).alias("born"), sample(0).alias("died"))
    sums = change.groupBy("channel", "n").agg(F.sum("now").alias("births"), F.sum(1 - F.col("now")).alias("deaths"))
    sizes = p.groupBy("channel", (F.col("n") + 1).alias("n")).agg(F.count("*").alias("previous"))
    out = order.filter("n > 1 and same").join(sums, ["channel", "n"], "left").join(samples, ["channel", "n"], "left").join(sizes, ["channel", "n"])
    warn = F.coalesce("deaths", F.lit(0)) > F.greatest((F.col("previous") * DEATH_SHARE).cast("bigint"), F.lit(DEATHS))
    return out.select(*key, F.coalesce("births", F.lit(0)).alias("births"), F.coalesce("deaths", F.lit(0)).alias("deaths"), F.coalesce("born", F.lit("")).alias("born"), F.coalesce("died", F.lit("")).alias("died"), warn.alias("warn"))


def accepted(obs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Observations of snapshots that did not fail; a failed snapshot contributes nothing."""
    key = key_of(verdicts)
    good = stored(verdicts.filter("verdict <> 'fail'").select(*key))
    return obs.join(small_side(good), key, "left_semi")


def health(failed: Column, warnings: Column, lag_hours: Column, strict: bool = False, most_lag: int = 72) -> Column:
    """A run is healthy without failures and with a newest snapshot of at most 72 hours (or none); in ``strict`` mode also without warnings."""
    return (failed == 0) & (lag_hours.isNull() | (lag_hours <= most_lag)) & ((warnings == 0) if strict else F.lit(True))
