"""Stream jobs on Spark's stream state.

Each job reads files as they land, handles what is there and stops (``availableNow``), or keeps
running with another trigger. Results that change over time are written as one folder of
changes per micro-batch: a micro-batch that runs again after a failure replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.plans.discover import judged_batch, store_batch
from postmill.plans.workspace import Workspace
from postmill.session import Staging, spare_shuffles
from postmill.functions.rules import RuleSet
from postmill.schemas import RAW_POSTING, conform, ddl
from postmill.sources.feeds import (
    CORRUPT,
    SourceSpec,
    corrupt_rows,
    json_options,
    landed_stories,
    only_latest,
    payload_schema,
    split_sound,
    with_token,
)
from postmill.sources.tables import append_once
from postmill.vocab import PlaceVocab


def file_stream(
    spark: SparkSession,
    path: str,
    schema: str,
    form: str = "parquet",
    files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """R2. A file source; ``files_per_trigger`` bounds the work of one micro-batch and the
    checkpoint remembers where the next run goes on."""
    reader = spark.readStream.schema(schema).format(form).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_batches(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Handle everything that has landed, one micro-batch at a time, and stop."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def changelog(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changed rows of an update-mode aggregate, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_once(batch, out, str(batch_id))

    return run_batches(stream, checkpoint, write, "update")


def latest(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The current rows of a change log."""
    log = spark.read.parquet(out)
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col("batch").cast("bigint")).alias("_row"))
        .select(*keys, "_row.*")
    )


def ingest(
    ws: Workspace,
    landing: str,
    specs: SourceSpec | Iterable[SourceSpec],
    checkpoint: str,
    as_of: datetime,
    files_per_trigger: int | None = None,
    rules: RuleSet | None = None,
    vocab: PlaceVocab | None = None,
    lines: bool = False,
    vacuum: bool = False,
) -> StreamingQuery:
    """R1, R7. Landed payloads of one or more feeds into the stored postings, as one stream: a
    workspace has one writer. Batches are merged by fingerprint, so repeated and duplicate deliveries
    change nothing. Logs are labelled with the checkpoint's own id, so a new checkpoint adds to them.

    Every micro-batch deletes its steps and its shuffle files. With ``vacuum`` it also deletes what the stored
    tables are no longer read from, for workspaces that nobody reads while the stream is at work."""
    raws, broken = [], []
    for spec in [specs] if isinstance(specs, SourceSpec) else specs:
        payloads = with_token(
            file_stream(
                ws.spark, f"{landing}/source={spec.name}", payload_schema(spec), "json", files_per_trigger,
                **json_options(lines),
            )
        )
        whole = payloads.where(F.col(CORRUPT).isNull())
        stories = landed_stories(ws.spark, landing, lines) if spec.threads else None
        raws.append(conform(spec.to_raw(whole if stories is None else only_latest(whole, stories)), RAW_POSTING))
        broken.append(corrupt_rows(payloads, spec))
    rows = reduce(DataFrame.unionByName, raws).select(F.struct("*").alias("raw"))
    lost = reduce(DataFrame.unionByName, broken).select(F.struct("*").alias("broken"))

    def store(batch: DataFrame, batch_id: int) -> None:
        own = Workspace(batch.sparkSession, ws.root)  # the stream's session, whose settings are its own
        spare_shuffles(own.spark)
        steps = Staging(own.spark, "ingest-steps", "zstd")
        try:
            whole = steps(batch, "delivered")
            good, bad = split_sound(whole.where("raw IS NOT NULL").select("raw.*"))
            label = f"{query_id(own.spark, checkpoint)}-{batch_id}"
            append_once(bad, own.log_path("quarantine"), label)
            append_once(whole.where("broken IS NOT NULL").select("broken.*"), own.log_path("unreadable"), label)
            judged = steps(judged_batch(good, as_of, rules, vocab), "judged")
            steps.free(whole)
            if not judged.isEmpty():
                store_batch(own, judged, steps)
        finally:
            steps.clear()
        if vacuum:
            own.postings.vacuum()
            own.companies.vacuum()

    return run_batches(rows.unionByName(lost, allowMissingColumns=True), checkpoint, store)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint when it was made."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def sightings(events: DataFrame, key: str, at: Column) -> DataFrame:
    """R3. First and last sighting and the count per fingerprint, kept as stream state."""
    return events.groupBy(key).agg(
        F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count("*").alias("n")
    )


def daily_spend(spend: DataFrame, lateness: str = "2 days") -> DataFrame:
    """R4. Spend per UTC day over ``(created_at timestamp, cost_usd)`` as stream state, without rows later
    than the watermark; ``exact.exact_totals`` takes those in as well."""
    return (
        spend.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day"))
        .agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))
        .select(F.col("window.start").alias("day"), "cost_usd", "calls")
    )


def weekly_counts(applied: DataFrame, lateness: str = "14 days") -> DataFrame:
    """R5. Applications per Monday week and status over ``(applied_at timestamp, status)``. The
    epoch was a Thursday, hence the offset of four days."""
    return (
        applied.withWatermark("applied_at", lateness)
        .groupBy(F.window("applied_at", "7 days", "7 days", "4 days"), "status")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("week"), "status", "n")
    )


def new_postings(stream: DataFrame, key: str, at: str, lateness: str = "30 days") -> DataFrame:
    """R3. The first delivery of each fingerprint within ``lateness``; ``exact.first_alerts`` remembers all."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def parquet_schema(spark: SparkSession, path: str) -> str:
    """Schema of landed files as DDL, since a stream needs it up front."""
    return ddl(dict(spark.read.parquet(path).dtypes))
