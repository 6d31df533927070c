"""Mixing sources to target weights by Poisson replication (operator 6, DataFrame functions only).

Each source has a mean repetition rate: rows wanted of it over rows it has. Each document draws a
uniform number from the hash of its id and text, and its number of copies is the inverse of the Poisson
distribution with that mean at the draw. Documents are exploded by their copies and dealt out globally.

Defined cases: a null source is a source of its own; rows with equal id and equal text draw alike; a
null text counts as an empty one in the draw; sources without a target weight get none (rate 0); an
empty table gives no rows; input columns named like the added ones are replaced, others of any name are
kept; very long texts are hashed whole. ``docs`` is read as a table: numbers follow its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import uniform, whole_row
from postmill.session import stage

ADDED = ("mix_rate", "mix_copies", "mix_copy")
#: Steps of all sources' distributions together up to which their table is broadcast (8 MB).
BROADCAST_STEPS = 1_000_000
#: Parts that a hot source is dealt to where the table is too large for that.
SALTS = 64


def tempered_rates(docs: DataFrame, alpha: float = 0.5, epochs: float = 1.0, source: str = "source") -> DataFrame:
    """Rate of each source if its weight is its row count to the power ``alpha`` and the mixture has
    ``epochs`` times the rows of the corpus. All rows are counted."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    # Exact sums: weights are rounded to whole millionths, so the order of addition can't matter.
    weighed = counts.withColumn("weight", F.round(F.pow(F.col("rows").cast("double"), F.lit(alpha)) * 1e6).cast("decimal(38,0)"))
    rows, weight = weighed.agg(F.sum("rows"), F.sum("weight")).first()
    share = F.col("weight").cast("double") / F.lit(float(weight or 1))
    return weighed.select("source", "rows", (F.lit(epochs) * share * F.lit(float(rows or 0)) / F.col("rows")).alias("mix_rate"))


def target_rates(docs: DataFrame, weights: dict[str | None, float], epochs: float = 1.0, source: str = "source") -> DataFrame:
    """Rate of each source from given weights, which are scaled to sum 1 over the sources that occur."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    named = {k: v for k, v in weights.items() if k is not None and v is not None and v > 0}
    table = F.create_map(*[F.lit(x) for kv in named.items() for x in (kv[0], float(kv[1]))]) if named else None
    known = F.try_element_at(table, F.col("source")) if named else F.lit(None).cast("double")
    weighed = counts.withColumn("weight", F.when(F.col("source").isNull(), F.lit(float(weights.get(None) or 0))).otherwise(F.coalesce(known, F.lit(0.0))))
    rows, weight = weighed.agg(F.sum("rows"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(weight or 1))
    return weighed.select("source", "rows", (F.lit(epochs) * share * F.lit(float(rows or 0)) / F.col("rows")).alias("mix_rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, mix_rate, cdf): the distribution function of each source at 0, 1, 2, ... as far as a
    draw of 52 bits can reach. Sums of logarithms instead of powers, so that no rate under- or overflows."""
    last = F.ceil(F.col("mix_rate") + 12 * F.sqrt("mix_rate") + 40).cast("int")
    steps = rates.where("mix_rate > 0").select("source", "mix_rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source", "mix_rate").orderBy("k")
    log_k = F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)
    mass = steps.withColumn("p", F.exp(F.col("k") * F.log("mix_rate") - F.col("mix_rate") - F.sum(log_k).over(upto)))
    summed = mass.withColumn("below", F.sum("p").over(upto))
    return summed.groupBy("source", "mix_rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "below"))), lambda s: s["below"]).alias("cdf"))


def copies(draw: Column, cdf: Column) -> Column:
    """Inverse of the distribution: the smallest count whose distribution function reaches the draw."""
    return F.coalesce(F.size(F.filter(cdf, lambda p: p < draw)), F.lit(0))


def poisson_copies(docs: DataFrame, rates: DataFrame, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture as (row, mix_rate, mix_copies, mix_copy): ``row`` holds the columns of ``docs``, mix_rate
    is that of its source, mix_copies counts this document's copies and mix_copy numbers them from 0. The
    rows are in a global random order.

    The table of distributions is broadcast after its size is checked; beyond that size the documents
    are joined by source and a salt, so a source that holds a third of all rows is dealt to many tasks.
    """
    steps = stage(poisson_steps(rates), "mix-steps").withColumnRenamed("source", "_source")
    size = steps.agg(F.sum(F.size("cdf"))).first()[0] or 0
    draw = uniform(F.lit(seed), F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    # numbered where the rows are read, before any shuffle: a task that runs again numbers its rows as before
    drawn = docs.select(whole_row(docs), F.col(source).alias("_of"), draw.alias("draw"), F.monotonically_increasing_id().alias("_row"))
    same = F.col("_of").eqNullSafe(F.col("_source"))
    if size <= BROADCAST_STEPS:
        joined = drawn.join(F.broadcast(steps), same)
    else:
        salted = steps.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = drawn.withColumn("_salt", F.pmod(F.xxhash64("draw"), F.lit(SALTS)).cast("int"))
        joined = drawn.join(salted, same & (F.col("_salt") == F.col("_part")))
    counted = joined.withColumn("mix_copies", copies(F.col("draw"), F.col("cdf"))).where("mix_copies > 0")
    # rows that repeat one id and text still go to different places
    place = F.xxhash64(F.lit(seed), "draw", "_row").alias("place")
    each = F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("mix_copy")
    exploded = counted.select("row", "mix_rate", "mix_copies", each, place).withColumn("place", F.xxhash64("place", "mix_copy"))
    return exploded.repartition("place").sortWithinPartitions("place").drop("place")


def poisson_mix(docs: DataFrame, rates: DataFrame, seed: int = 11, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture as the columns of ``docs`` with mix_rate, mix_copies and mix_copy, a row for each copy."""
    mixed = poisson_copies(docs, rates, seed, key, text, source)
    return mixed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


MIX_SQL_HEAD = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, round(pow(n::DOUBLE, {alpha}) * 1e6)::DECIMAL(38,0) AS w FROM counts),
rates AS (SELECT source, {epochs} * (w::DOUBLE / (sum(w) OVER ())::DOUBLE) * (sum(n) OVER ())::DOUBLE / n AS rate FROM weighed),
steps AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, range(0, 2000) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM steps),
draws AS (SELECT *, {draw} AS draw FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.rate AS mix_rate, count(*) FILTER (WHERE c.below < d.draw) AS mix_copies
  FROM draws d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY d.doc_id, d.text, d.lang, d.source, d.n_chars, c.rate)
SELECT doc_id, text, lang, source, n_chars, mix_rate, mix_copies::INTEGER AS mix_copies, unnest(range(0, mix_copies))::INTEGER AS mix_copy
FROM counted WHERE mix_copies > 0
"""
