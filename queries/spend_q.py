"""Model usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import spend as S
from queries.binding import USAGE, events_as, oracle
from queries.registry import query

RATE_IN = "CASE model " + " ".join(f"WHEN '{r.model}' THEN {r.input_rate}" for r in S.RATES) + " ELSE 0 END"
RATE_OUT = "CASE model " + " ".join(f"WHEN '{r.model}' THEN {r.output_rate}" for r in S.RATES) + " ELSE 0 END"
MINIMUM = "CASE model " + " ".join(f"WHEN '{r.model}' THEN {r.min_cacheable}" for r in S.RATES) + " END"
# Cost in units of 1e-10 dollars is a whole number; halves of a millionth round to even.
UNITS = (
    f"CAST(input_tokens * ({RATE_IN}) * 10000 + cached_input_tokens * ({RATE_IN}) * 1000"
    f" + cache_write_tokens * ({RATE_IN}) * 12500 + output_tokens * ({RATE_OUT}) * 10000 AS HUGEINT)"
)
MICROS = (
    "CASE WHEN u % 10000 > 5000 OR (u % 10000 = 5000 AND (u // 10000) % 2 = 1) THEN u // 10000 + 1"
    " ELSE u // 10000 END"
)
PRICED = f"SELECT *, CAST({MICROS} AS BIGINT) AS micros FROM (SELECT *, {UNITS} AS u FROM usage)"


def _spend(spark, sf):
    return S.with_cost(events_as(spark, sf, USAGE), S.rates_table(spark))


def _micros(name: str):
    return (F.col(name) * 1_000_000).cast("bigint").alias("micros")


@query("spend_cost", oracle("SELECT call_id, model, micros FROM p", "usage", p=PRICED))
def spend_cost(spark, sf):
    return _spend(spark, sf).select("call_id", "model", _micros("cost_usd"))


@query("spend_by_day", oracle(
    "SELECT strftime(day, '%Y-%m-%d') AS day, purpose, CAST(sum(micros) AS BIGINT) AS micros, count(*)"
    " AS calls, CAST(sum(cached_input_tokens) AS BIGINT) AS cached FROM p GROUP BY 1, 2",
    "usage", p=PRICED,
))
def spend_by_day(spark, sf):
    daily = S.spend_by_day(_spend(spark, sf))
    return daily.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "purpose", _micros("cost_usd"), "calls",
        "cached",
    )


@query("usage_rollup", oracle(
    "SELECT strftime(day, '%Y-%m-%d') AS day, purpose, model, CAST(grouping(day, purpose, model) AS"
    " BIGINT) AS level, count(*) AS calls, CAST(sum(cached_input_tokens) AS BIGINT) AS cached,"
    " CAST(sum(cache_write_tokens) AS BIGINT) AS written, CAST(sum(input_tokens) AS BIGINT) AS fresh,"
    " CAST(sum(micros) AS BIGINT) AS micros FROM p GROUP BY ROLLUP (day, purpose, model)",
    "usage", p=PRICED,
))
def usage_rollup(spark, sf):
    rolled = S.usage_rollup(_spend(spark, sf))
    return rolled.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "purpose", "model", "level", "calls",
        "cached", "written", "fresh", _micros("cost_usd"),
    )


@query("spend_under_cap", oracle(
    "SELECT call_id, CAST(before AS BIGINT) AS micros, before < 1500000 AS allowed FROM (SELECT"
    " call_id, COALESCE(sum(micros) OVER (PARTITION BY day ORDER BY created_at, call_id ROWS BETWEEN"
    " UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)", "usage", p=PRICED,
))
def spend_under_cap(spark, sf):
    return S.under_cap(_spend(spark, sf)).select("call_id", _micros("spent_before"), "allowed")


@query("cache_miss_flag", oracle(
    f"SELECT call_id, model, COALESCE(prefix_tokens >= {MINIMUM}, FALSE) AS prefix_effective,"
    " cache_requested AND cached_input_tokens = 0 AND cache_write_tokens = 0 AS cache_missed FROM usage",
    "usage",
))
def cache_miss_flag(spark, sf):
    flagged = S.cache_flags(events_as(spark, sf, USAGE), S.rates_table(spark))
    return flagged.select("call_id", "model", "prefix_effective", "cache_missed")
