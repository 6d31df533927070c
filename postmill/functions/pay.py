"""Pay from prose and from structured components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.expr import let

HOURS_PER_YEAR = 2080

# Bounds outside which a figure is a misreading.
MIN_ANNUAL, MAX_ANNUAL = 30_000, 1_000_000
MIN_HOURLY, MAX_HOURLY = 20, 500

# Currency marks, figure shapes (longest first) and separators.
CURRENCY = r"(?:USD|US\$|\$)"
FIGURE = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?\s?[kK]\b|\d+(?:\.\d+)?"
DASH = r"\s*(?:-|–|—|\bto\b)\s*"
RANGES = (
    rf"(?iU){CURRENCY}\s?({FIGURE}){DASH}(?:{CURRENCY}\s?)?({FIGURE})",
    rf"(?iU){CURRENCY}\s?({FIGURE})\s+and\s+{CURRENCY}\s?({FIGURE})",
    rf"(?iU)({FIGURE}){DASH}({FIGURE})\s?(?:USD|US\$)",
)
SINGLE = rf"(?iU){CURRENCY}\s?({FIGURE})|({FIGURE})\s?(?:USD|US\$)"
HOURLY = r"(?iU)(?:per\s+hour|/\s?h(?:ou)?r\b|hourly)"
FOREIGN = "[€£¥]"

# Factor to a year for each published pay interval.
INTERVAL_FACTORS = {"1 YEAR": 1, "1 MONTH": 12, "1 WEEK": 52, "1 DAY": 260, "1 HOUR": HOURS_PER_YEAR}


def _number(token: Column) -> Column:
    digits = F.regexp_replace(token, "[^0-9.]", "").try_cast("double")
    return digits * F.when(F.lower(token).endswith("k"), 1000).otherwise(1)


def _annual(value: Column, hourly: Column) -> Column:
    """Whole dollars per year, null where implausible."""
    yearly = F.when(
        hourly, F.when(value.between(MIN_HOURLY, MAX_HOURLY), value * HOURS_PER_YEAR)
    ).otherwise(value)
    return let(
        yearly, lambda y: F.when(y.between(MIN_ANNUAL, MAX_ANNUAL), F.bround(y, 0).cast("int"))
    )


def _figures(text: Column) -> Column:
    """The one or two figures of the first shape that matches, else null."""
    found = None
    for shape in RANGES:
        pair = F.array(F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2))
        hit = text.rlike(shape)
        found = F.when(hit, pair) if found is None else found.when(hit, pair)
    single = F.concat(F.regexp_extract(text, SINGLE, 1), F.regexp_extract(text, SINGLE, 2))
    return found.when(text.rlike(SINGLE), F.array(single))


def parse_pay(text: Column) -> Column:
    """F3. ``struct<low int, high int>`` of annual dollars, null where the text is not clear.

    Shapes are tried in a fixed order and the first that matches decides. Both ends of a range
    must be plausible; a half-read range would misstate the offer.
    """
    readable = F.when(text.rlike(r"(?i)\$|usd") & ~text.rlike(FOREIGN), _figures(text))
    hourly = text.rlike(HOURLY)
    amounts = F.transform(F.transform(readable, _number), lambda v: _annual(v, hourly))
    band = let(
        amounts,
        lambda a: F.when(
            ~F.exists(a, lambda x: x.isNull()),
            F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high")),
        ),
    )
    return band


def structured_pay(published: Column, tiers: Column) -> Column:
    """F5. First usable salary component over all tiers, annualised.

    ``tiers`` is ``array<struct<components: array<struct<compensationType, interval,
    currencyCode, minValue, maxValue>>>>``. An unset ``published`` counts as published.
    """
    factors = F.create_map(*[F.lit(x) for kv in INTERVAL_FACTORS.items() for x in kv])

    def factor(c: Column) -> Column:
        return F.try_element_at(factors, F.coalesce(F.nullif(c["interval"], F.lit("")), F.lit("1 YEAR")))

    def usable(c: Column) -> Column:
        return (
            (c["compensationType"] == "Salary")
            & (F.coalesce(F.nullif(c["currencyCode"], F.lit("")), F.lit("USD")) == "USD")
            & factor(c).isNotNull()
            & F.coalesce(c["minValue"], c["maxValue"]).isNotNull()
        )

    def annual(c: Column) -> Column:
        low = (c["minValue"] * factor(c)).cast("int")
        high = (c["maxValue"] * factor(c)).cast("int")
        return F.struct(
            F.least(low, high).alias("low"),  # least and greatest skip a null end
            F.greatest(low, high).alias("high"),
        )

    parts = F.flatten(
        F.filter(F.transform(tiers, lambda t: t["components"]), lambda cs: cs.isNotNull())
    )
    bands = F.transform(F.filter(parts, usable), annual)
    return F.when(F.coalesce(published, F.lit(True)), F.get(bands, F.lit(0)))
