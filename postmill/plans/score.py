"""Scoring: score what is unscored, pick candidates, take in verdicts (E2; J2, V2, V5, U4, U7)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.expr import instant
from postmill.operators.postings import unscored
from postmill.operators.scoring import awaiting_vector, judge_export, merge_scores, score_postings, top_unjudged
from postmill.operators.screen import clean_relevance, screen_companies, settle_verdicts
from postmill.plans.workspace import Workspace
from postmill.session import stage
from postmill.sources.tables import append_once
from postmill.vocab import TermLists


def score_unscored(
    ws: Workspace, vectors: DataFrame, reference: Sequence[float], as_of: datetime, batch_id: str | None = None
) -> DataFrame:
    """Score every live posting that has no score yet; a score is not aged afterwards. With a ``batch_id``
    the postings that still await a vector are written to the log ``awaiting_vector``."""
    todo = unscored(ws.postings.read(), ws.scores.read())
    fresh = stage(score_postings(todo, vectors, reference, as_of), "scores")
    if batch_id is not None:
        append_once(awaiting_vector(todo, vectors), ws.log_path("awaiting_vector"), batch_id)
    ws.scores.commit(fresh)
    return fresh


def rescore(
    ws: Workspace, vectors: DataFrame, reference: Sequence[float], as_of: datetime
) -> None:
    """Score all live postings anew, with freshness as of now; judgements stay."""
    live = ws.postings.read().where(~F.col("filtered_out") & F.col("closed_at").isNull())
    fresh = stage(score_postings(live, vectors, reference, as_of), "scores")
    known = ws.scores.read().join(fresh.select("posting_key"), "posting_key", "left_semi")
    ws.scores.commit(merge_scores(known, fresh))


def candidates(ws: Workspace, limit: int, per_company_cap: int) -> DataFrame:
    """Texts of the best unjudged postings, for an outside judge."""
    postings, companies = ws.postings.read(), ws.companies.read()
    chosen = top_unjudged(postings, ws.scores.read(), companies, limit, per_company_cap)
    return judge_export(chosen, postings, companies)


def ingest_judgements(ws: Workspace, judged: DataFrame, model: str, as_of: datetime) -> None:
    """Take in ``(posting_key, relevance_verdict, relevance_score, rationale)``."""
    clean = clean_relevance(judged).select(
        "posting_key", "relevance_verdict", "rationale",
        F.lit(model).alias("model"), instant(as_of).alias("judged_at"),
    )
    clean = stage(clean, "judgements")
    known = ws.scores.read().join(clean.select("posting_key"), "posting_key", "left_semi")
    ws.scores.commit(merge_scores(known, clean))


def screen(
    ws: Workspace,
    rulings: DataFrame,
    verdicts: DataFrame,
    as_of: datetime,
    lists: TermLists | None = None,
) -> None:
    """Settle every employer's verdict and store the ones that changed."""
    companies = ws.companies.read()
    settled = settle_verdicts(
        screen_companies(companies, ws.postings.read(), lists), rulings, verdicts, as_of
    )
    written = F.struct("verdict", "verdict_source", "sector", "reason")
    old = companies.select("company_key", written.alias("_old"))
    changed = settled.join(old, "company_key").where(~F.col("_old").eqNullSafe(written))
    ws.companies.commit(changed.drop("_old"))
