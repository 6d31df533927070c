"""Table schemas. Timestamps are UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns(text: str) -> dict[str, str]:
    """Column name -> type, from ``name type, name type``."""
    return dict(item.split() for item in text.split(", "))


RAW_POSTING = columns(
    "source string, source_job_id string, company_name string, title string, location string,"
    " description string, apply_url string, posted_at timestamp, remote_type_hint string,"
    " salary_min int, salary_max int, salary_source string"
)

# A posting as it is stored. ``posting_key`` is the content fingerprint.
POSTING = columns(
    "posting_key string, company_key string, source string, source_job_id string, title string,"
    " location string, remote_type string, salary_min int, salary_max int, salary_source string,"
    " description string, apply_url string, posted_at timestamp, first_seen_at timestamp,"
    " last_seen_at timestamp, closed_at timestamp, filtered_out boolean, filter_reason string,"
    " location_class string"
)

COMPANY = columns(
    "company_key string, name string, ats_type string, board_token string, verdict string,"
    " sector string, reason string, verdict_source string, decided_at timestamp"
)

SCORE = columns(
    "posting_key string, embed_similarity double, rule_score double, freshness_score double,"
    " total_score double, relevance_verdict string, rationale string, is_stretch boolean,"
    " model string, judged_at timestamp, scored_at timestamp"
)

APPLICATION = columns(
    "posting_key string, status string, applied_at timestamp, responded_at timestamp,"
    " interview_at timestamp, closed_at timestamp, notes string, updated_at timestamp"
)

SPEND = columns(
    "call_id string, created_at timestamp, day date, model string, purpose string,"
    " input_tokens long, cached_input_tokens long, cache_write_tokens long, output_tokens long,"
    " cost_usd decimal(10,6)"
)

ANSWER = columns(
    "question string, answer string, category string, question_key string, updated_at timestamp"
)

RUN = columns(
    "run_id string, started_at timestamp, finished_at timestamp, jobs_seen long, jobs_new long,"
    " jobs_filtered long, errors long, duration_ms long, budget_hit boolean, notes string"
)


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in schema.items())


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Project to ``schema``: absent columns become nulls, others are cast."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in schema.items()
        ]
    )
