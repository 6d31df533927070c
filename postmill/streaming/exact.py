"""Stream jobs whose results do not depend on the order, lateness or repetition of deliveries.

Each job keeps its state in stored tables (``StoredTable``) that a micro-batch reads in part and commits its
changes to, labelled with the query's id and the batch's number. A micro-batch that runs again after a
failure finds what it committed and only does the rest; one that is done is passed over. State is read by
joins, which split hot keys, and every batch is combined by key before it meets the state, so no key is one
task's work. Nothing is forgotten, and no row is dropped because it came late.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.common import unique_join
from postmill.session import stage
from postmill.sources.tables import StoredTable, append_once
from postmill.streaming.jobs import query_id, run_batches


def run_once(stream: DataFrame, checkpoint: str, last: StoredTable, handle: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Handle micro-batches, passing over those whose label ``last`` (the table a batch commits to at its
    end) has taken in."""
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        label = f"{query_id(spark, checkpoint)}-{batch_id}"
        if not last.has(label):
            handle(batch, label)

    return run_batches(stream, checkpoint, take)


# First alerts


def seen_keys(spark: SparkSession, root: str, key: str, kind: str) -> StoredTable:
    return StoredTable(spark, f"{root}/seen", {key: kind, "first_at": "timestamp"}, key)


def first_alerts(stream: DataFrame, key: str, at: str, root: str, checkpoint: str) -> StreamingQuery:
    """One alert ``(key, first_at)`` for each key, whenever it comes again: keys that were ever seen are kept
    in a stored table. Alerts are one folder per micro-batch under ``root/alerts``. Null keys give none."""
    kind = dict(stream.dtypes)[key]
    seen = seen_keys(stream.sparkSession, root, key, kind)

    def handle(batch: DataFrame, label: str) -> None:
        first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("first_at"))
        fresh = stage(first.join(seen.read().select(key), key, "left_anti"), "alerts")
        append_once(fresh, f"{root}/alerts", label)
        seen.commit(fresh, label=label)

    return run_once(stream, checkpoint, seen, handle)


# totals


def stored_totals(spark: SparkSession, root: str, keys: dict[str, str], sums: dict[str, str]) -> StoredTable:
    counts = {"rows": "bigint", "late_rows": "bigint"}
    return StoredTable(spark, f"{root}/totals", {**keys, **sums, **counts}, tuple(keys))


def exact_totals(
    stream: DataFrame, identity: str, at: str, keys: dict[str, Column], sums: dict[str, Column], root: str, checkpoint: str,
    lateness: timedelta = timedelta(days=2),
) -> StreamingQuery:
    """Sums and row counts by ``keys`` over every row once, by its ``identity``, at its time ``at``.

    The watermark is the latest time of the batches before, less ``lateness``. Rows behind it are written to
    the late log (``root/late``) and merged into the totals of their keys as corrections, counted in
    ``late_rows``: a window that was published can be published again where that number has grown. Rows that
    were delivered before, in this batch or another, are passed over; identities are kept by day, so a batch
    reads those of its own days. Rows without an identity count each, rows without a time are never late.
    Sums must be exact types (integers, decimals), which add up alike in any order."""
    spark = stream.sparkSession
    kinds = dict(stream.select(identity, *[c.alias(n) for n, c in {**keys, **sums}.items()]).dtypes)
    for name in sums:
        if kinds[name].startswith("decimal"):  # as wide as a sum of them
            width, digits = kinds[name][8:-1].split(",")
            kinds[name] = f"decimal({min(38, int(width) + 10)},{digits})"
        else:
            kinds[name] = "bigint"
    totals = stored_totals(spark, root, {k: kinds[k] for k in keys}, {s: kinds[s] for s in sums})
    taken = StoredTable(spark, f"{root}/taken", {"day": "date", "id": kinds[identity]}, ("day", "id"), part="day")
    clock = StoredTable(spark, f"{root}/clock", {"name": "string", "at": "timestamp"}, "name")

    def handle(batch: DataFrame, label: str) -> None:
        day = F.coalesce(F.col(at).cast("date"), F.lit("1970-01-01").cast("date"))
        whole = stage(batch.withColumns({"_day": day, "_at": F.col(at).cast("timestamp")}), "delivered")
        days = [r[0] for r in whole.select("_day").distinct().collect()]  # as many as days were delivered
        known = taken.read(parts=days).select(F.col("day").alias("_day"), F.col("id").alias(identity))
        named = whole.where(F.col(identity).isNotNull()).dropDuplicates([identity, "_day"])
        fresh = named.join(known, ["_day", identity], "left_anti").select(*whole.columns)
        fresh = stage(fresh.unionAll(whole.where(F.col(identity).isNull())), "fresh")
        before = clock.read().where(F.col("name") != label).agg(F.max(F.unix_micros("at"))).first()[0]
        late = F.lit(False) if before is None else F.coalesce(F.unix_micros("_at") < F.lit(before - lateness // timedelta(microseconds=1)), F.lit(False))
        append_once(fresh.where(late).select(*batch.columns), f"{root}/late", label)
        parts = fresh.select(*[c.alias(k) for k, c in keys.items()], *[c.alias(s) for s, c in sums.items()], late.alias("_late"))
        added = parts.groupBy(*keys).agg(
            *[F.sum(s).cast(kinds[s]).alias(s) for s in sums], F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late_rows")
        )
        columns = [*sums, "rows", "late_rows"]
        old = totals.read().select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in columns])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        merged = added.join(old, same, "left").select(
            *keys, *[(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns]
        )
        totals.commit(merged, label=label)
        clock.commit(whole.agg(F.max("_at").alias("at")).where("at IS NOT NULL").withColumn("name", F.lit(label)), label=label)
        taken.commit(fresh.where(F.col(identity).isNotNull()).select(F.col("_day").alias("day"), F.col(identity).alias("id")), label=label)

    return run_once(stream, checkpoint, taken, handle)


# Failure streaks


def streak_tables(spark: SparkSession, root: str) -> tuple[StoredTable, StoredTable]:
    """The last success of each source (null where it had none), and the failures since then."""
    point = {"at": "timestamp", "attempt_id": "bigint"}
    return (
        StoredTable(spark, f"{root}/sources", {"source": "string", **point}, "source"),
        StoredTable(spark, f"{root}/open", {"source": "string", **point}, ("source", "attempt_id")),
    )


def track_streaks(attempts: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Failures by event time, cut at each success, of attempts ``(source, attempt_id, at, ok)`` as they
    land. A micro-batch reads the last successes and the open failures, never the log; a success that
    lands late closes only the failures before it, a failure that lands late counts if none came after."""
    sources, open_ = streak_tables(attempts.sparkSession, root)

    def handle(batch: DataFrame, label: str) -> None:
        rows = stage(batch.where(F.col("source").isNotNull()).select("source", F.col("at").cast("timestamp").alias("at"), F.col("attempt_id").cast("bigint").alias("attempt_id"), "ok"), "attempts")
        point = F.struct("at", "attempt_id")
        best = rows.groupBy("source").agg(F.max(F.when(F.col("ok"), point)).alias("ok"))
        old = sources.read().select("source", F.struct("at", "attempt_id").alias("was"))
        moved = best.join(old, "source", "left").withColumn("was", F.when(F.col("was.at").isNotNull(), F.col("was")))
        last = stage(moved.select("source", F.greatest("ok", "was").alias("last"), F.col("was").isNull().alias("new"), "was"), "last-ok")
        changed = last.where("new OR last > was")
        sources.commit(changed.select("source", F.col("last.at").alias("at"), F.col("last.attempt_id").alias("attempt_id")), label=label)
        # ``last`` has every source of the batch, so failures of the batch and open ones are judged by it
        since = F.col("last").isNull() | (point > F.col("last"))
        failed = rows.where(~F.col("ok")).select("source", "at", "attempt_id").dropDuplicates(["source", "attempt_id"])
        fresh = unique_join(failed, last.select("source", "last"), "source").where(since)
        closed = unique_join(open_.read(), last.select("source", "last"), "source").where(~since)
        open_.commit(fresh.select("source", "at", "attempt_id"), gone=closed.select("source", "at", "attempt_id"), label=label)

    return run_once(attempts, checkpoint, open_, handle)


def streaks(spark: SparkSession, root: str) -> DataFrame:
    """(source, last_fetch_ok_at, consecutive_errors) of every source that was tried."""
    sources, open_ = streak_tables(spark, root)
    failures = open_.read().groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sources.read().join(failures, "source", "left").select(
        "source", F.col("at").alias("last_fetch_ok_at"), F.coalesce("n", F.lit(0)).alias("consecutive_errors")
    )
