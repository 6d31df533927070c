"""Registered queries: each runs a library job on the benchmark tables, next to the SQL that must
give the same rows. ``binding`` says how the tables stand in for postings, employers and logs."""

from queries.registry import ORACLES, QUERIES

from queries import (  # noqa: E402,F401  (importing registers the queries)
    answers_q,
    feeds_q,
    merges_q,
    queue_q,
    reports_q,
    scoring_q,
    spend_q,
    stream_q,
    text_q,
)

__all__ = ["ORACLES", "QUERIES"]
