"""Stream jobs over the events file; each must give what the batch result gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import spend as S
from postmill.schemas import ddl
from postmill.session import scratch
from postmill.streaming import exact as X
from postmill.streaming import jobs as J
from queries.binding import ATTEMPTS, STATUS_EVENTS, USAGE, bound, oracle, stamp, stamp_sql
from queries.registry import query
from queries.spend_q import PRICED


FILES = 3


def _times(events):
    """The time of each event in microseconds, and the first and the last of them."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return us, *events.select(us.alias("us")).agg(F.min("us"), F.max("us")).first()


def _landed(spark, events, label, landings):
    """The events that meet each of the conditions as files that land one after the other, as a stream of a micro-batch
    for each landing. Every landing has as many files, so that no micro-batch ends within one or takes in the next."""
    root = scratch(spark, label)
    rows = events.agg(*[F.count_if(rows).alias(f"n{i}") for i, rows in enumerate(landings)]).first()
    # so many rows a file that none stays empty, as an empty one is not written
    files = max(1, min(events.rdd.getNumPartitions(), min(rows) // 1000))
    for i, rows in enumerate(landings):
        events.where(rows).repartition(files).write.parquet(f"{root}/landed-{i}")
    return J.file_stream(spark, root, ddl(dict(events.dtypes)), files_per_trigger=files, recursiveFileLookup="true")


def _events(spark, sf):
    """The events as files that land one after the other, a span of time in each, one a micro-batch."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    us, first, last = _times(events)
    span = F.coalesce(F.floor((us - first) * FILES / (last - first + 1)), F.lit(0))
    return _landed(spark, events, "events", [span == i for i in range(FILES)])


def _untidy(spark, sf):
    """The events in three spans of time, of which the first lacks a part that lands after the last; then the
    second span lands once more."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    us, first, last = _times(events)
    span = F.coalesce(F.floor((us - first) * 3 / (last - first + 1)), F.lit(0))
    held = (span == 0) & (F.col("event_id") % 4 == 1)
    return _landed(spark, events, "untidy", [(span == 0) & ~held, span == 1, span == 2, held, span == 1])


def _run(spark, label, start):
    """Run a stream job in a fresh folder and return where its output is."""
    root = scratch(spark, label)
    start(f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


@query("stream_first_last", "SELECT user_id AS posting_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS"
       " first_seen_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen_at, count(*) AS n FROM events"
       " GROUP BY 1")
def stream_first_last(spark, sf):
    seen = _events(spark, sf).withColumnRenamed("user_id", "posting_key")
    out = _run(spark, "first-last", lambda o, c: J.changelog(
        J.sightings(seen, "posting_key", F.col("ts")), o, c
    ))
    return J.latest(spark, out, "posting_key").select(
        "posting_key", stamp("first_seen_at"), stamp("last_seen_at"), "n"
    )


@query("stream_daily_spend", oracle(
    "SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(micros) AS BIGINT) AS micros, count(*) AS calls FROM"
    " p GROUP BY 1", "usage", p=PRICED,
))
def stream_daily_spend(spark, sf):
    usage = bound(_events(spark, sf), USAGE)
    spend = S.with_cost(usage, S.rates_table(spark)).withColumn(
        "created_at", F.col("created_at").cast("timestamp")
    )
    out = _run(spark, "daily-spend", lambda o, c: J.changelog(J.daily_spend(spend), o, c))
    return J.latest(spark, out, "day").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        (F.col("cost_usd") * 1_000_000).cast("bigint").alias("micros"), "calls",
    )


@query("stream_weekly", oracle(
    "SELECT strftime(date_trunc('week', \"at\"), '%Y-%m-%d') AS week, status, count(*) AS n FROM"
    " status_events GROUP BY 1, 2", "status_events",
))
def stream_weekly(spark, sf):
    applied = bound(_events(spark, sf), STATUS_EVENTS).select(
        F.col("at").cast("timestamp").alias("applied_at"), "status"
    )
    out = _run(spark, "weekly", lambda o, c: J.changelog(J.weekly_counts(applied), o, c))
    return J.latest(spark, out, "week", "status").select(
        F.date_format("week", "yyyy-MM-dd").alias("week"), "status", "n"
    )


STREAKS = (
    "SELECT a.source, count(*) FILTER (WHERE NOT a.ok AND (l.x IS NULL OR a.\"at\" > l.x)) AS"
    " consecutive_errors FROM attempts a LEFT JOIN (SELECT source, max(\"at\") AS x FROM attempts WHERE ok"
    " GROUP BY 1) l ON l.source = a.source GROUP BY 1"
)


@query("stream_failure_streaks", oracle(STREAKS, "attempts"))
def stream_failure_streaks(spark, sf):
    """Part of the attempts land late and some twice."""
    attempts = bound(_untidy(spark, sf), ATTEMPTS)
    root = scratch(spark, "streaks")
    X.track_streaks(attempts, root, f"{root}/checkpoint").awaitTermination()
    return X.streaks(spark, root).select("source", "consecutive_errors")


@query("stream_late_spend", oracle(
    "SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(micros) AS BIGINT) AS micros, count(*) AS calls FROM"
    " p GROUP BY 1", "usage", p=PRICED,
))
def stream_late_spend(spark, sf):
    """Daily spend where a file lands behind the watermark and another one twice."""
    usage = bound(_untidy(spark, sf), USAGE)
    priced = S.with_cost(usage, S.rates_table(spark)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    root = scratch(spark, "late-spend")
    X.exact_totals(
        priced, "call_id", "created_at", {"spent_on": F.to_date("created_at")}, {"cost_usd": F.col("cost_usd")}, root, f"{root}/checkpoint"
    ).awaitTermination()
    totals = X.stored_totals(spark, root, {"spent_on": "date"}, {"cost_usd": "decimal(20,6)"}).read()
    return totals.select(
        F.date_format("spent_on", "yyyy-MM-dd").alias("day"), (F.col("cost_usd") * 1_000_000).cast("bigint").alias("micros"), F.col("rows").alias("calls")
    )


@query("stream_late_log", "WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events), b AS (SELECT min(us) AS f, max(us) AS l FROM e)"
       " SELECT event_id FROM e, b WHERE (us - f) * 3 < l - f + 1 AND event_id % 4 = 1 AND us < l - 2 * 86400000000")
def stream_late_log(spark, sf):
    """The rows of the late file that were behind the watermark, which the totals took in as corrections."""
    stamped = _untidy(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    root = scratch(spark, "late-log")
    X.exact_totals(stamped, "event_id", "at", {"kind": F.col("event_type")}, {}, root, f"{root}/checkpoint").awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/late").select("event_id")


@query("stream_late_weekly", oracle(
    "SELECT strftime(date_trunc('week', \"at\"), '%Y-%m-%d') AS week, status, count(*) AS n FROM"
    " status_events GROUP BY 1, 2", "status_events",
))
def stream_late_weekly(spark, sf):
    """Weekly counts from the same deliveries."""
    applied = bound(_untidy(spark, sf), STATUS_EVENTS).withColumn("at", F.col("at").cast("timestamp"))
    root = scratch(spark, "late-weekly")
    keys = {"week": F.date_trunc("week", "at").cast("date"), "status": F.col("status")}
    X.exact_totals(applied, "event_id", "at", keys, {}, root, f"{root}/checkpoint").awaitTermination()
    totals = X.stored_totals(spark, root, {"week": "date", "status": "string"}, {}).read()
    return totals.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "status", F.col("rows").alias("n"))


@query("stream_first_alerts", "SELECT user_id AS posting_key, count(*) AS alerts FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def stream_first_alerts(spark, sf):
    """Postings that come again after 60 days and more raise no second alert: every event lands once more
    as a repost 90 days later."""
    seen = _untidy(spark, sf).select(F.col("user_id").alias("posting_key"), F.col("ts").cast("timestamp").alias("seen_at"))
    again = F.explode(F.array(F.col("seen_at"), F.col("seen_at") + F.expr("INTERVAL 90 DAYS"))).alias("seen_at")
    root = scratch(spark, "alerts")
    X.first_alerts(seen.select("posting_key", again), "posting_key", "seen_at", root, f"{root}/checkpoint").awaitTermination()
    alerts = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/alerts")
    return alerts.groupBy("posting_key").agg(F.count(F.lit(1)).alias("alerts"))


@query("stream_new_postings", "SELECT DISTINCT user_id AS posting_key FROM events")
def stream_new_postings(spark, sf):
    seen = _events(spark, sf).select(
        F.col("user_id").alias("posting_key"), F.col("ts").cast("timestamp").alias("seen_at")
    )

    def start(out, checkpoint):
        def write(batch, batch_id):
            J.append_once(batch, out, str(batch_id))

        return J.run_batches(J.new_postings(seen, "posting_key", "seen_at", "60 days"), checkpoint, write)

    return spark.read.parquet(_run(spark, "new", start)).select("posting_key")
