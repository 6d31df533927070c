"""Runs and sources from append-only logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.expr import instant
from postmill.operators.common import unique_join


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """S13. The latest runs, newest first."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def missing_runs(runs: DataFrame, first: datetime | Column, last: datetime | Column, minutes: int) -> DataFrame:
    """U10. Expected ticks between ``first`` and ``last`` in which no run finished. A run counts
    for the tick it started in; a run without an end was lost."""
    step = minutes * 60_000_000
    start = F.unix_micros(instant(first))
    stop = F.unix_micros(instant(last))
    ticks = runs.sparkSession.range(1).select(
        F.explode(F.sequence(start, stop, F.lit(step))).alias("_us")
    )
    done = (
        runs.where(F.col("finished_at").isNotNull())
        .select(
            (F.floor((F.unix_micros(F.col("started_at").cast("timestamp")) - start) / step) * step + start)
            .cast("long")
            .alias("_us")
        )
        .distinct()
    )
    return ticks.join(done, "_us", "left_anti").select(F.timestamp_micros("_us").alias("tick"))


def source_state(attempts: DataFrame) -> DataFrame:
    """A17, U12. Per source: last attempt, last success and the failures since then.

    ``attempts(source, attempt_id, at, ok)`` is append-only. The streak is the number of
    failures after the last success, which two map-side combined aggregates give; no source
    is ever gathered into one window.
    """
    point = F.struct("at", "attempt_id")
    last = attempts.groupBy("source").agg(
        F.max("at").alias("last_fetch_started_at"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_fetch_ok_at"),
        F.max(F.when(F.col("ok"), point)).alias("_last_ok"),
    )
    # One row per source: Spark broadcasts it while it is small and splits skew beyond that.
    failed = attempts.where(~F.col("ok")).select("source", point.alias("_at"), "attempt_id")
    since = (
        unique_join(failed, last.select("source", "_last_ok"), "source")
        .where(F.col("_last_ok").isNull() | (F.col("_at") > F.col("_last_ok")))
        .groupBy("source")
        .agg(F.count("*").alias("consecutive_errors"))
    )
    return (
        last.join(since, "source", "left")
        .select(
            "source", "last_fetch_started_at", "last_fetch_ok_at",
            F.coalesce("consecutive_errors", F.lit(0)).alias("consecutive_errors"),
        )
    )


def due_sources(state: DataFrame, intervals: DataFrame, as_of: datetime) -> DataFrame:
    """P14. Sources never fetched, or last started before ``min_interval_seconds`` ago.
    ``intervals(source, min_interval_seconds)`` lists every configured source."""
    started = F.unix_micros(F.col("last_fetch_started_at").cast("timestamp"))
    limit = F.unix_micros(instant(as_of)) - F.col("min_interval_seconds") * 1_000_000
    return (
        intervals.join(state, "source", "left")
        .where(F.col("last_fetch_started_at").isNull() | (started < limit))
        .select("source", "last_fetch_started_at")
    )
