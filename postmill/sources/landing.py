"""Landed payload files: what changed, and whether a board looks healthy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.sources.feeds import CORRUPT, SOURCES, read_payloads

SEEN_COLUMNS = ["url", "etag", "last_modified", "content_hash", "fetched_at"]


def snapshot_index(spark: SparkSession, landing: str) -> DataFrame:
    """One row per landed file with the hash of its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing)
    return files.select(
        F.col("path").alias("file"),
        F.regexp_extract("path", r"(source=.*)/[^/]+$", 1).alias("url"),
        F.sha2("content", 256).alias("content_hash"),
        F.col("modificationTime").alias("fetched_at"),
    )


FILE = {"file": "string", "length": "bigint", "modified": "timestamp"}


def file_index(spark: SparkSession, landing: str) -> DataFrame:
    """One row per landed file; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing)
    return files.select(F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def new_files(spark: SparkSession, landing: str, seen: DataFrame) -> DataFrame:
    """S8. Landed files that are not in the log of read ones, or were written again since."""
    return file_index(spark, landing).join(seen.select(*FILE), list(FILE), "left_anti")


def unseen(landed: DataFrame, seen: DataFrame) -> DataFrame:
    """S8. Landed snapshots whose content was not read before."""
    return landed.join(seen.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def newest_validators(seen: DataFrame, landed: DataFrame) -> DataFrame:
    """S8. Per address, the validators of the latest fetch; a gap keeps the older value."""
    both = seen.select(*SEEN_COLUMNS).unionByName(landed.select(*SEEN_COLUMNS))

    def last(name: str):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("fetched_at"))).alias(name)

    return both.groupBy("url").agg(
        last("etag"), last("last_modified"), last("content_hash"),
        F.max("fetched_at").alias("fetched_at"),
    )


def board_status(boards: DataFrame) -> DataFrame:
    """S9. Status per board from ``(source, token, n, meta_total, bad)``, one row per payload
    or per posting. Counts are summed, so a board may be spread over many rows."""
    totals = boards.groupBy("source", "token").agg(
        F.sum("n").cast("long").alias("n"),
        F.max("meta_total").alias("meta_total"),
        F.max(F.col("bad").cast("int")).alias("bad"),
    )
    return totals.select(
        "source",
        "token",
        "n",
        F.when(F.col("bad") == 1, "failed")
        .when(F.col("n") == 0, "empty")
        .when(F.col("meta_total") != F.col("n"), "truncated")
        .otherwise("ok")
        .alias("status"),
    )


def landed_boards(spark: SparkSession, landing: str) -> DataFrame:
    """Every board with a landed file; only paths are listed, no content is read."""
    return boards_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing))


def boards_of(files: DataFrame) -> DataFrame:
    """(source, token) of files by their ``path``."""
    return files.select(
        F.regexp_extract("path", r"/source=([^/]+)/", 1).alias("source"),
        F.nullif(F.regexp_extract("path", r"/token=([^/]+)/", 1), F.lit("")).alias("token"),
    ).where(F.col("source").isin(*SOURCES)).distinct()


def landed_status(spark: SparkSession, landing: str, lines: bool = False, fresh: DataFrame | None = None) -> DataFrame:
    """S9 over landed files of all feeds, or the ``fresh`` ones. A bare array without postings gives no payload
    rows, so boards are taken from the files."""
    boards = landed_boards(spark, landing) if fresh is None else boards_of(fresh.select(F.col("file").alias("path")))
    frames = boards.select(
        "source", "token", F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("long").alias("meta_total"), F.lit(False).alias("bad"),
    )
    for spec in SOURCES.values():
        payloads = read_payloads(spark, landing, spec, lines, fresh)
        broken = F.col(CORRUPT).isNotNull()
        if spec.items:
            n = F.when(F.col(spec.items).isNotNull(), F.size(spec.items)).otherwise(0)
            broken = broken | F.col(spec.items).isNull()
        else:
            present = payloads.columns[0]  # the posting id; a broken payload has none
            n = F.when(F.col(present).isNotNull(), 1).otherwise(0)
        total = F.col("meta.total") if "meta" in payloads.columns else F.lit(None).cast("long")
        frames = frames.unionByName(
            payloads.select(
                F.lit(spec.name).alias("source"), "token",
                n.cast("long").alias("n"), total.alias("meta_total"), broken.alias("bad"),
            )
        )
    return board_status(frames)
