"""The review queue: eligibility, filters, per-employer cap, sorting, paging, facets
(J3, P6-P12, W2, T1, T2, A5)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.expr import instant
from postmill.operators.common import cap_per_group
from postmill.operators.postings import is_live

DEFAULT_SORT = "score"
DEFAULT_CAP = 3

# Sort name -> leading columns as (column, direction); None follows the caller's direction.
SORTS: dict[str, tuple[tuple[str, bool | None], ...]] = {
    "score": (("total_score", None), ("posting_key", True)),
    "posted": (("posted_at", None), ("posting_key", True)),
    "salary": (("salary_ceiling", None), ("posting_key", True)),
    "company": (("company_lower", None), ("total_score", True), ("posting_key", True)),
}


@dataclass(frozen=True)
class QueueFilters:
    """Parameters of a queue query."""

    sort: str = DEFAULT_SORT
    descending: bool = True
    min_score: float = 0.0
    remote_types: tuple[str, ...] = ()
    location_classes: tuple[str, ...] = ()
    min_salary: int | None = None
    posted_within_days: int | None = None
    company: str = ""
    judged_only: bool = False
    per_company_cap: int = DEFAULT_CAP

    def normalized(self) -> QueueFilters:
        """P12. An unknown sort falls back to the default."""
        return replace(self, sort=self.sort if self.sort in SORTS else DEFAULT_SORT)

    @property
    def is_active(self) -> bool:
        """P12. Whether anything narrows the queue."""
        narrowing = (
            self.min_score, self.remote_types, self.location_classes, self.min_salary,
            self.posted_within_days, self.company, self.judged_only,
        )
        return any(narrowing)

    @classmethod
    def from_text(cls, given: Mapping[str, str | list[str]]) -> QueueFilters:
        """P12. From text parameters; junk and empty numbers give the defaults."""

        def number(name: str, kind: type, default):
            try:
                value = kind(given.get(name, ""))
            except (ValueError, TypeError):
                return default
            return value if isfinite(value) else default

        def several(name: str) -> tuple[str, ...]:
            value = given.get(name) or ()
            return (value,) if isinstance(value, str) else tuple(value)

        return cls(
            sort=str(given.get("sort", DEFAULT_SORT)),
            descending=given.get("dir", "desc") != "asc",
            min_score=number("min_score", float, 0.0),
            remote_types=several("remote"),
            location_classes=several("location"),
            min_salary=number("min_salary", int, None),
            posted_within_days=number("posted_within", int, None),
            company=str(given.get("company", "")).strip(),
            judged_only=str(given.get("judged_only", "")).lower() in ("true", "1", "on", "yes"),
            per_company_cap=cap if (cap := number("per_company", int, DEFAULT_CAP)) >= 1 else DEFAULT_CAP,
        ).normalized()


def eligible(postings: DataFrame, scores: DataFrame, applications: DataFrame) -> DataFrame:
    """P6 without the employer's verdict: live, scored, and not acted on yet. All three inputs
    join on the posting key, which no row shares, so no key is hot here."""
    acted = applications.where(F.col("status") != "queued").select("posting_key")
    return (
        postings.where(is_live())
        .join(scores, "posting_key")
        .join(acted, "posting_key", "left_anti")
    )


def narrow(queue: DataFrame, filters: QueueFilters, as_of: datetime) -> DataFrame:
    """P6-P9, P11. Posting-level conditions; what was not published is kept."""
    ceiling = F.coalesce("salary_max", "salary_min")
    out = queue.where(F.col("total_score") >= filters.min_score)
    if filters.remote_types:
        out = out.where(F.col("remote_type").isin(*filters.remote_types))
    if filters.location_classes:
        out = out.where(F.col("location_class").isin(*filters.location_classes))
    if filters.min_salary:
        out = out.where(ceiling.isNull() | (ceiling >= filters.min_salary))
    if filters.posted_within_days:
        since = instant(as_of) - F.make_dt_interval(days=F.lit(filters.posted_within_days))
        out = out.where(F.col("posted_at").isNull() | (F.col("posted_at") >= since))
    if filters.judged_only:
        out = out.where(F.col("judged_at").isNotNull())
    return out


def employers(companies: DataFrame, filters: QueueFilters) -> DataFrame:
    """P6, P10. Employers that are not excluded and match the name filter."""
    out = companies.where(F.col("verdict") != "excluded")
    if filters.company:
        out = out.where(F.col("name").ilike(f"%{filters.company}%"))
    return out.select(
        "company_key",
        F.col("name").alias("company_name"),
        "verdict",
        F.col("reason").alias("verdict_reason"),
    )


def sort_columns(filters: QueueFilters) -> list[Column]:
    """T1. The whitelisted order; unknown values last, the posting key breaks ties."""
    out = []
    for name, fixed in SORTS[filters.normalized().sort]:
        descending = filters.descending if fixed is None else fixed
        column = F.col(name)
        out.append(column.desc_nulls_last() if descending else column.asc_nulls_last())
    return out


def ranked_queue(
    postings: DataFrame,
    companies: DataFrame,
    scores: DataFrame,
    applications: DataFrame,
    as_of: datetime,
    filters: QueueFilters | None = None,
) -> DataFrame:
    """J3, W2, T1. The queue in order, at most ``per_company_cap`` postings per employer.

    Employer conditions keep or drop an employer's postings as a whole, so the cap may run
    before the employer join: that join then sees at most ``cap`` rows per employer, however
    many postings one of them has.
    """
    f = (filters or QueueFilters()).normalized()
    columns = postings.select(
        "posting_key", "company_key", "title", "location", "remote_type", "location_class",
        "salary_min", "salary_max", "apply_url", "posted_at", "closed_at", "filtered_out",
    )
    marks = scores.select(
        "posting_key", "total_score", "embed_similarity", "relevance_verdict", "rationale",
        "is_stretch", "judged_at",
    )
    capped = cap_per_group(
        narrow(eligible(columns, marks, applications), f, as_of),
        "company_key",
        [F.col("total_score").desc(), F.col("posting_key").desc()],
        f.per_company_cap,
    )
    return (
        capped.join(employers(companies, f), "company_key")
        .withColumns(
            {
                "salary_ceiling": F.coalesce("salary_max", "salary_min"),
                "company_lower": F.lower("company_name"),
            }
        )
        .drop("closed_at", "filtered_out")
        .orderBy(*sort_columns(f))
    )


def page(queue: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """T2. One page and one row more, which tells whether a next page exists."""
    return queue.offset(offset).limit(limit + 1) if offset else queue.limit(limit + 1)


def after(filters: QueueFilters, last: Mapping[str, object]) -> Column:
    """T2. Rows after ``last`` in the queue's order, for deep pages without an offset."""
    beyond, tied = F.lit(False), F.lit(True)
    for name, fixed in SORTS[filters.normalized().sort]:
        descending = filters.descending if fixed is None else fixed
        column, value = F.col(name), last[name]
        if value is not None:
            further = (column < F.lit(value)) if descending else (column > F.lit(value))
            beyond = beyond | (tied & (further | column.isNull()))
        tied = tied & column.eqNullSafe(F.lit(value))
    return beyond


def queue_facets(
    postings: DataFrame, companies: DataFrame, scores: DataFrame, applications: DataFrame
) -> DataFrame:
    """A5. ``(facet, value, n, judged)`` over the unfiltered queue.

    Postings are first counted per employer, arrangement and class, so the employer join and
    the grouping sets work on counts, not on postings.
    """
    base = eligible(
        postings.select(
            "posting_key", "company_key", "remote_type", "location_class", "closed_at",
            "filtered_out",
        ),
        scores.select("posting_key", "judged_at"),
        applications,
    )
    counts = base.groupBy("company_key", "remote_type", "location_class").agg(
        F.count("*").alias("n"), F.count("judged_at").alias("judged")
    )
    named = counts.join(employers(companies, QueueFilters()), "company_key")
    sets = named.groupingSets(
        [[], ["company_name"], ["remote_type"], ["location_class"]],
        "company_name", "remote_type", "location_class",
    ).agg(
        F.sum("n").alias("n"),
        F.sum("judged").alias("judged"),
        F.grouping_id().alias("_set"),
    )
    # Bit 2 is the employer, bit 1 the arrangement, bit 0 the class; a set bit is rolled up.
    facet = (
        F.when(F.col("_set") == 7, "total")
        .when(F.col("_set") == 3, "company")
        .when(F.col("_set") == 5, "remote_type")
        .otherwise("location_class")
    )
    value = F.coalesce("company_name", "remote_type", "location_class")
    return sets.select(facet.alias("facet"), value.alias("value"), "n", "judged").orderBy(
        "facet", F.col("n").desc(), "value"
    )
