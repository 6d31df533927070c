"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of a hash that make a draw: 13 hex digits are 52 bits, exact in a double.
DRAW_DIGITS = 13


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def uniform(*parts: Column) -> Column:
    """A draw in (0, 1) that depends on the parts alone; null parts count as empty."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digits = F.conv(F.substring(F.md5(key), 1, DRAW_DIGITS), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def uniform_sql(key: str) -> str:
    """The same draw in the oracle dialect; ``key`` is the joined key as SQL."""
    return f"((('0x' || substr(md5({key}), 1, {DRAW_DIGITS}))::BIGINT::DOUBLE + 0.5) / {16**DRAW_DIGITS}.0)"


def text_crc32(text: Column) -> Column:
    """CRC-32 of the text in UTF-8, unsigned; that of no bytes (0) for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def split_of(key: Column, parts: int) -> Column:
    """Fold of a row for hold-out splits: CRC-32 of the key as text, modulo ``parts``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``: what is added beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def hash_sample(keys: DataFrame, key: str, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of ``key``; the same ones on every run. Only for fitting.
    The rows are counted first; a limit on the hash then leaves about twice as many as wanted, so what is
    sorted depends on ``rows`` alone."""
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    few = keys.withColumn("_draw", draw).where(F.col("_draw") * F.lit(float(keys.count())) <= 2 * rows + 20)
    return few.orderBy("_draw", key).limit(rows).drop("_draw")
