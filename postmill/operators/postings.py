"""Reads over stored postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.places import location_verdict
from postmill.operators.common import unique_join


def is_open() -> Column:
    """P5."""
    return F.col("closed_at").isNull()


def is_live() -> Column:
    """P5. Open and not rejected."""
    return is_open() & ~F.col("filtered_out")


def canonical(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """S10. Postings with their employer; an unset arrangement reads as onsite."""
    names = companies.select("company_key", F.col("name").alias("company_name"))
    return unique_join(
        postings.withColumn("remote_type", F.coalesce("remote_type", F.lit("onsite"))), names, "company_key"
    )


def unscored(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """J2, T3. Live postings without a score; the whole set, not a batch."""
    return postings.where(is_live()).join(scores.select("posting_key"), "posting_key", "left_anti")


def posting_detail(
    postings: DataFrame, companies: DataFrame, scores: DataFrame, applications: DataFrame
) -> DataFrame:
    """J5. The denormalised table behind a detail page; unset status reads as queued."""
    employer = companies.select(
        "company_key",
        F.col("name").alias("company_name"),
        "verdict",
        F.col("reason").alias("verdict_reason"),
        "verdict_source",
    )
    marks = scores.select(
        "posting_key", "total_score", "embed_similarity", "rule_score", "freshness_score",
        "relevance_verdict", "rationale", "is_stretch",
    )
    state = applications.select("posting_key", "status", "applied_at", "notes")
    keyed = postings.join(marks, "posting_key", "left").join(state, "posting_key", "left")
    return unique_join(keyed, employer, "company_key").withColumn(
        "status", F.coalesce("status", F.lit("queued"))
    )


def audit_listing(
    postings: DataFrame, show: str | None = None, sample: str | None = None, limit: int = 40
) -> DataFrame:
    """P15. Open postings of one class, all rejected ones (``show='rejected'``), or those whose
    location holds ``sample``; the first ``limit`` by key, since a person reads them."""
    verdict = location_verdict(F.col("location_class"), F.col("remote_type"))
    wanted = F.lit(False)
    if show == "rejected":
        wanted = wanted | F.col("place_reason").isNotNull()
    elif show:
        wanted = wanted | (F.col("location_class") == show)
    if sample:
        place = F.lower(F.coalesce("location", F.lit("")))
        wanted = wanted | place.contains(sample.lower())
    return (
        postings.where(is_open())
        .withColumn("place_reason", verdict)
        .where(wanted)
        .orderBy("posting_key")
        .limit(limit)
    )
