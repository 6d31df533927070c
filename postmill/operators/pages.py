"""Pages of a sorted table at any depth.

A sorted table is dealt into ranges of its order, so that no task sorts more than its range; rows are numbered
inside their range and the rows of the ranges before are added. The numbered rows are kept in folders of
``GROUP`` rows: a page reads one folder, or two, however deep it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.session import stage
from postmill.sources.tables import absent

#: Rows of a folder.
GROUP = 10_000


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in the order, from 0. The order must be total: name a unique column last."""
    own = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranges.withColumns({"_range": F.shiftright(own, 33), "_nth": own.bitwiseAND(F.lit((1 << 33) - 1))})
    written = stage(numbered, "ranges")
    counts = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return written.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_nth")).drop("_range", "_nth", "_start")


def write_pages(rows: DataFrame, order: Sequence[Column], root: str, group: int = GROUP) -> None:
    """Write the numbered rows, a folder for each ``group`` of them."""
    placed = ranked(rows, order).withColumn("folder", F.floor(F.col("rank") / group).cast("bigint"))
    placed.write.mode("overwrite").partitionBy("folder").parquet(root)


def read_rows(spark: SparkSession, root: str, schema: str, first: int, rows: int, group: int = GROUP) -> DataFrame:
    """``rows`` rows from place ``first`` on, in order; ``schema`` is that of the written rows."""
    folders = list(range(first // group, (first + max(rows, 1) - 1) // group + 1))
    try:
        written = spark.read.schema(f"{schema}, rank bigint, folder bigint").parquet(root)
    except AnalysisException as problem:
        if not absent(problem):  # an empty table has no folders
            raise
        return spark.createDataFrame([], schema)
    wanted = written.where(F.col("folder").isin(folders) & F.col("rank").between(first, first + rows - 1))
    return wanted.orderBy("rank").drop("rank", "folder")


def read_page(spark: SparkSession, root: str, schema: str, number: int, limit: int = 50, group: int = GROUP) -> DataFrame:
    """T2. Page ``number`` (from 0) and one row more, which tells whether a next page exists."""
    return read_rows(spark, root, schema, number * limit, limit + 1, group)
