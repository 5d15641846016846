"""The snapshot ledger: discovery, worklist, coverage and state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import exprs as E
from ..session import small_side

MOST_ATTEMPTS, FALLBACK_HOURS = 5, 24
COMMIT = "^[0-9a-fA-F]{40}$"


def parsed(listing: DataFrame) -> DataFrame:
    """Listed (channel, release_name, commit_hash) rows with ``commit_count``, ``rev`` and why a row is refused (null: it is not)."""
    rows = listing.withColumns({"commit_count": E.snapshot_name_part(F.col("release_name"), "count").try_cast("bigint"), "rev": E.snapshot_name_part(F.col("release_name"), "rev")})
    bad = F.when(F.col("rev").isNull() | F.col("commit_count").isNull(), "name").when(~F.coalesce(F.col("commit_hash").rlike(COMMIT), F.lit(False)), "commit").when(~F.startswith("commit_hash", "rev"), "revision")
    return rows.withColumn("refused", bad)


def discover(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listed rows that are new and valid, newest first by commit count."""
    good = parsed(listing).filter("refused is null").drop("refused")
    return good.join(known.select("channel", "release_name"), ["channel", "release_name"], "left_anti").orderBy(F.col("commit_count").desc(), "channel", "release_name")


def refused(listing: DataFrame) -> DataFrame:
    """Per channel and reason, how many listed rows are refused."""
    return parsed(listing).filter("refused is not null").groupBy("channel", "refused").agg(F.count("*").alias("n_rows"))


def windowed(ledger: DataFrame, since: Column | None = None, until: Column | None = None, channels: tuple[str, ...] = (), eras: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """The rows of a run: from ``since`` to ``until``, both included, of these channels and eras, the oldest ``most`` of them."""
    out = ledger
    if since is not None:
        out = out.filter(F.col("release_date") >= since)
    if until is not None:
        out = out.filter(F.col("release_date") <= until)
    for column, values in (("channel", channels), ("era", eras)):
        if values:
            out = out.filter(F.col(column).isin(*values))
    return out if most is None else out.orderBy("release_date", "channel", "release_name").limit(most)


def deny(ledger: DataFrame, denylist: DataFrame) -> DataFrame:
    """Skip the pending and failed rows that the denylist (release_name, reason) names, with its reason as ``error``."""
    bad = small_side(denylist.groupBy(F.col("release_name").alias("denied")).agg(F.min("reason").alias("reason")))
    hit = F.col("denied").isNotNull() & F.col("status").isin("pending", "failed")
    error = F.col("error") if "error" in ledger.columns else F.lit(None).cast("string")
    out = ledger.join(bad, F.col("release_name") == F.col("denied"), "left")
    return out.withColumns({"error": F.when(hit, F.col("reason")).otherwise(error), "status": F.when(hit, "skipped").otherwise(F.col("status"))}).drop("denied", "reason")


def requeue(ledger: DataFrame) -> DataFrame:
    """All rows are pending again, without attempts."""
    return ledger.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "last_attempt_at": F.lit(None).cast("timestamp_ntz")})


def settled(ledger: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """The ledger after a run: rows of ``verdicts`` (channel, release_name, n_entries, error) are ingested, or failed where there is an error.

    A failure counts an attempt, and the fifth skips the row for good.
    """
    done = verdicts.select("channel", "release_name", F.col("n_entries").alias("seen"), F.col("error").alias("why"), F.lit(True).alias("tried"))
    old = {c: F.col(c) if c in ledger.columns else F.lit(None).cast(t) for c, t in (("n_entries", "bigint"), ("error", "string"))}
    n = F.col("attempts") + F.when(F.col("tried"), 1).otherwise(0)
    failed = F.when(n >= MOST_ATTEMPTS, "skipped").otherwise("failed")
    status = F.when(F.col("tried"), F.when(F.col("why").isNull(), "ingested").otherwise(failed)).otherwise(F.col("status"))
    out = ledger.join(done, ["channel", "release_name"], "left")
    return out.withColumns({"status": status, "attempts": n.cast("int"), "last_attempt_at": F.when(F.col("tried"), now).otherwise(F.col("last_attempt_at")), "n_entries": F.coalesce("seen", old["n_entries"]), "error": F.when(F.col("tried"), F.col("why")).otherwise(old["error"])}).drop("seen", "why", "tried")


def lag_hours(ledger: DataFrame, now: Column) -> DataFrame:
    """One row: whole hours since the newest ingested snapshot (null without one), and whether a fallback source is due (24 hours or none)."""
    newest = ledger.agg(F.max(F.when(F.col("status") == "ingested", F.col("release_date"))).alias("newest"))
    return newest.select("newest", *lag_columns(now))


def lag_columns(now: Column) -> list[Column]:
    lag = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600)
    return [lag.alias("lag_hours"), (F.coalesce(lag, F.lit(FALLBACK_HOURS)) >= FALLBACK_HOURS).alias("fallback_due")]


def lag_history(ledger: DataFrame) -> DataFrame:
    """``lag_hours`` as of the date of each row of the ledger, by channel: what a run of that day would have found.

    A channel is one task's, as in the gate, with one short row for each snapshot.
    """
    till = W.partitionBy("channel").orderBy("release_date")  # rows of one date see each other
    newest = ledger.withColumn("newest", F.max(F.when(F.col("status") == "ingested", F.col("release_date"))).over(till))
    return newest.select("channel", "release_name", "release_date", "newest", *lag_columns(F.col("release_date")))


def insert_pending(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """Add new snapshots; rows that the ledger has stay as they are."""
    new = found.select("channel", "release_name", "release_date").distinct().join(ledger.select("channel", "release_name"), ["channel", "release_name"], "left_anti")
    return ledger.unionByName(new.withColumns({"status": F.lit("pending"), "attempts": F.lit(0)}), allowMissingColumns=True)


def worklist(ledger: DataFrame, now: Column, everything: bool = False) -> DataFrame:
    """Pending rows, failed ones whose delay is over, and on request all failed and skipped ones; oldest first."""
    due = F.col("last_attempt_at") + F.make_dt_interval(secs=E.backoff_seconds(F.col("attempts"))) <= now
    take = (F.col("status") == "pending") | ((F.col("status") == "failed") & due)
    if everything:
        take = take | F.col("status").isin("failed", "skipped")
    return ledger.filter(take).orderBy("release_date", "channel")


def coverage(ledger: DataFrame) -> DataFrame:
    """Per channel: rows by status and the newest ingested snapshot (of equal dates the last by name)."""
    by = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pending", "ingested", "failed", "skipped")]
    newest = F.max(F.when(F.col("status") == "ingested", F.struct("release_date", "release_name")))
    return ledger.groupBy("channel").agg(*by, newest.alias("newest")).select("channel", "n_pending", "n_ingested", "n_failed", "n_skipped", F.col("newest.release_name").alias("newest_name"), F.col("newest.release_date").alias("newest_date"))


def unsettled(ledger: DataFrame) -> DataFrame:
    """Per channel: pending and failed snapshots older than the newest ingested one."""
    newest = ledger.filter("status = 'ingested'").groupBy("channel").agg(F.max("release_date").alias("mark"))
    return ledger.join(small_side(newest), "channel").filter(F.col("status").isin("pending", "failed") & (F.col("release_date") < F.col("mark"))).groupBy("channel").agg(F.count("*").alias("n_unsettled"))


def attempted(ledger: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Count a failed attempt; the fifth skips the snapshot for good."""
    hit = failed.select("channel", "release_name", F.lit(True).alias("_hit"))
    n = F.col("attempts") + F.when(F.col("_hit"), 1).otherwise(0)
    status = F.when(F.col("_hit"), F.when(n >= MOST_ATTEMPTS, "skipped").otherwise("failed")).otherwise(F.col("status"))
    return ledger.join(hit, ["channel", "release_name"], "left").withColumns({"status": status, "attempts": n, "last_attempt_at": F.when(F.col("_hit"), now).otherwise(F.col("last_attempt_at"))}).drop("_hit")
