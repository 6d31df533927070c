"""Row constraints, checked in one pass before a table is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.reports import STATUSES
from postmill.operators.screen import VERDICTS


def posting_rules() -> dict[str, Column]:
    return {
        "filtered_has_reason": F.col("filtered_out") == F.col("filter_reason").isNotNull(),
        "key_present": F.col("posting_key").isNotNull(),
        "title_present": F.col("title").isNotNull(),
    }


def score_rules() -> dict[str, Column]:
    judged = F.col("relevance_verdict").isNotNull()
    return {
        "verdict_names_model": judged == F.col("model").isNotNull(),
        "total_in_range": F.col("total_score").between(0, 1),
    }


def application_rules() -> dict[str, Column]:
    return {
        "status_known": F.col("status").isin(*STATUSES),
        "applied_has_time": F.col("status").isin("queued", "dismissed")
        | F.col("applied_at").isNotNull(),
    }


def company_rules() -> dict[str, Column]:
    return {"verdict_known": F.col("verdict").isin(*VERDICTS)}


def audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """P13. Violations per rule in one scan; a rule that cannot be decided is violated."""
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()],
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    )
    return counted.select("_rows", F.explode(pairs).alias("p")).select(
        "p.rule", F.col("_rows").alias("checked"), "p.violations"
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """P13. Key values held by more than one row; null keys never collide."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """P13. The rows unchanged; a violated rule fails the job that writes them."""
    out = df
    for name, rule in rules.items():
        broken = F.raise_error(F.lit(f"constraint {name} is violated")).cast("boolean")
        out = out.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(broken))
    return out
