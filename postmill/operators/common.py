"""Shared table idioms: capped groups, salted joins and running totals that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import stage


def cap_per_group(df: DataFrame, group: str, order: Sequence[Column], cap: int) -> DataFrame:
    """W1/W2. At most ``cap`` rows per group, best first.

    The rank filter lets Spark trim every group to ``cap`` rows inside each input partition
    before the shuffle (WindowGroupLimit), so a group holding a third of the table reaches its
    reducer as at most ``cap`` rows per upstream task.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def unique_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """J1. Join a fact table to a table with unique ``key``, of any size.

    Where Spark knows the dimension to be small it is broadcast, and a hot key is no one task's work.
    Beyond that both sides are shuffled, and adaptive execution splits a hot key's partition, since
    nothing after the join asks for its partitioning. The dimension is not repeated: a repeated one
    looks as small as before to Spark, which would send all its copies through the driver.
    """
    return fact.join(dim, key, how)


def salted_join(
    fact: DataFrame, dim: DataFrame, key: str, spread_by: str, how: str = "inner", salts: int = 16
) -> DataFrame:
    """J1. Join a fact table to a table of few rows with unique ``key``, hot keys spread over ``salts``
    tasks whatever the session's settings are. The dimension is repeated per salt, by a shuffle and never
    through the driver.
    """
    salted_fact = fact.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    return salted_fact.join(dim.withColumn("_salt", every).hint("merge"), [key, "_salt"], how).drop("_salt")


def running_total(
    df: DataFrame, group: str, order: Sequence[str], value: str, out: str, slices: int | None = None
) -> DataFrame:
    """W4. ``out`` = sum of ``value`` over the rows of the group before this one.

    A single window per group would put a hot day into one task. The rows are range-partitioned
    along ``order`` instead, so a hot group spans many slices: a window runs inside each slice,
    and the total of the earlier slices of the group is added, from a table of at most groups +
    slices rows. The slices are written out first; every later step then sees the same ones,
    also when executors are lost.
    """
    spark = df.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, group, *order)
    sliced = stage(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    totals = sliced.groupBy(group, "_slice").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        group, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = (
        Window.partitionBy(group, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [group, "_slice"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_slice", "_inside", "_before")
    )


def with_labels(df: DataFrame, column: str, labels: dict[str, str], out: str = "label") -> DataFrame:
    """J12. Display label of a code; an unlisted code shows as itself."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
