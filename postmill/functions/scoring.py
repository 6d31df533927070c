"""Score components and their blend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.expr import round_half_even
from postmill.functions.keys import city_key
from postmill.functions.rules import DEFAULT_PAY_FLOOR

# Blend weights, similarity band, stretch share.
W_SIMILARITY, W_RULES, W_FRESHNESS = 0.55, 0.25, 0.20
SIMILARITY_FLOOR, SIMILARITY_CEILING = 0.60, 0.85
STRETCH_RATE = 0.07

# Arrangement scores, score of unknown pay, pay target as a multiple of the floor.
ARRANGEMENT_SCORE = {"remote": 1.0, "hybrid": 0.7, "onsite": 0.4}
UNKNOWN_PAY = 0.55
TARGET_FACTOR = 1.2

# Cities within a short commute.
NEARBY = (
    "san leandro", "oakland", "san francisco", "berkeley", "emeryville", "alameda", "hayward",
    "fremont", "san mateo", "palo alto", "mountain view", "sunnyvale", "santa clara", "san jose",
    "redwood city", "menlo park", "burlingame", "south san francisco", "walnut creek", "richmond",
)


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)


def freshness_score(posted_at: Column, as_of: Column) -> Column:
    """F23. Steps at 48 hours, 7 days and 30 days; undated sits in the middle."""
    hours = (_seconds(as_of) - _seconds(posted_at)) / 3600
    return (
        F.when(posted_at.isNull(), F.lit(0.5))
        .when(hours <= 48, F.lit(1.0))
        .when(hours <= 7 * 24, F.lit(0.7))
        .when(hours <= 30 * 24, F.lit(0.4))
        .otherwise(F.lit(0.15))
    )


def rule_score(
    kind: Column,
    location: Column,
    salary_min: Column,
    salary_max: Column,
    salary_source: Column,
    pay_floor: int = DEFAULT_PAY_FLOOR,
    nearby: Sequence[str] = NEARBY,
) -> Column:
    """F24."""
    table = F.create_map(*[F.lit(x) for kv in ARRANGEMENT_SCORE.items() for x in kv])
    fit = F.coalesce(F.try_element_at(table, kind), F.lit(ARRANGEMENT_SCORE["onsite"]))
    near = F.when((kind == "onsite") & ~city_key(location).isin(*nearby), 0.3).otherwise(1.0)
    ceiling = F.coalesce(salary_max, salary_min)
    target = pay_floor * TARGET_FACTOR
    ramp = F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), (ceiling - F.lit(pay_floor)) / F.lit(target - pay_floor))
    )
    pay = F.when((salary_source == "none") | ceiling.isNull(), F.lit(UNKNOWN_PAY)).otherwise(ramp)
    return round_half_even(0.45 * fit + 0.20 * near + 0.35 * pay)


def rescale_similarity(cosine: Column) -> Column:
    """F25."""
    span = SIMILARITY_CEILING - SIMILARITY_FLOOR
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - SIMILARITY_FLOOR) / F.lit(span)))


def blend(similarity: Column, rules: Column, freshness: Column) -> Column:
    """F26."""
    total = W_SIMILARITY * similarity + W_RULES * rules + W_FRESHNESS * freshness
    return round_half_even(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def is_stretch(key: Column, seed: int = 0, rate: float = STRETCH_RATE) -> Column:
    """F27. A fixed pseudo-random slice: the same key and seed always fall on the same side, in any
    engine that has SHA-256."""
    digest = F.sha2(F.concat_ws(":", key.cast("string"), F.lit(seed)).cast("binary"), 256)
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    return F.pmod(draw, F.lit(10_000)) < F.lit(round(rate * 10_000))


def cosine(vector: Column, reference: Sequence[float]) -> Column:
    """V1. Cosine with one reference vector; 0.0 for a zero vector, an error on other lengths.

    The reference and its norm are plan literals. Both sums fold inside the JVM over one pass
    of the array.
    """
    ref = [float(x) for x in reference]
    ref_norm = sum(x * x for x in ref) ** 0.5
    literal = F.lit(ref).cast("array<double>")
    doubles = vector.cast("array<double>")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with(doubles, literal, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(doubles, lambda a: a * a)))
    scaled = norm * F.lit(ref_norm)
    value = F.when(scaled == 0, F.lit(0.0)).otherwise(F.try_divide(dot, scaled))
    wrong = F.raise_error(
        F.concat(F.lit("vector length "), F.size(vector).cast("string"), F.lit(f" is not {len(ref)}"))
    ).cast("double")
    return F.when(F.size(vector) != len(ref), wrong).otherwise(value)
