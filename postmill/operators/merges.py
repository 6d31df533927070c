"""Merges of a batch into stored state (U1-U3, U6, U9, O5, A10). Running the same batch twice
gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.rules import LAST_PART, PARTS, RuleSet, first_change, judgement, rejection_reason, terms_reason, with_judgement
from postmill.operators.postings import is_open
from postmill.operators.reports import STATUSES
from postmill.schemas import POSTING, conform
from postmill.session import FEW_ROWS, dealt, stage
from postmill.vocab import PlaceVocab

VERDICT_COLUMNS = ("filtered_out", "filter_reason", "location_class")
CONTENT = [
    c for c in POSTING if c not in ("posting_key", "first_seen_at", "last_seen_at", "closed_at")
]
# Feeds that tell which applicant system an employer uses.
BOARD_SOURCES = ("greenhouse", "lever", "ashby")


def collapse_batch(batch: DataFrame) -> DataFrame:
    """One row per fingerprint: the latest sighting's content, and the first and last sighting.
    The latest sighting speaks for the whole batch, also for the source id it came under.

    ``batch`` has posting columns plus ``seen_at`` and ``seq`` (its order of arrival).
    ``max_by`` keeps one row per fingerprint and task before the shuffle, so a posting repeated
    in a third of the batch costs no more than any other.
    """
    sighted = conform(batch, {**POSTING, "seen_at": "timestamp", "seq": "bigint"})
    latest = F.max_by(F.struct(*CONTENT, "seq"), "seq").alias("_row")
    return (
        sighted.groupBy("posting_key")
        .agg(latest, F.min("seen_at").alias("_first"), F.max("seen_at").alias("_last"))
        .select("posting_key", "_row.*", "_first", "_last")
    )


def spread(source_id: Column) -> Column:
    """The source id, or a key of its own where there is none."""
    return F.coalesce(source_id, F.concat(F.lit("\0"), F.col("posting_key")))


def posting_changes(
    current: DataFrame, rows: DataFrame, few: int = FEW_ROWS, step: Callable[[DataFrame, str], DataFrame] = stage
) -> DataFrame:
    """U1, U2. The stored rows a batch changes, with ``change``: ``new``, ``seen`` (refreshed),
    ``touched`` (only sighting and verdict) or ``replaced`` (gives way to an edited version).

    Identity is the fingerprint; ``(source, source_job_id)`` is unique as well, which gives:

    * known fingerprint: content is refreshed and ``first_seen_at`` is kept;
    * known fingerprint whose source id belongs to another stored posting: only the sighting
      and the verdict are updated, both postings keep their ids;
    * unknown fingerprint whose source id is stored: the posting was edited, so the newer
      content replaces the old row and ``first_seen_at`` is carried over.

    ``rows`` is a collapsed batch, best a staged table since it is read several times. Only
    stored rows that share a key with it take part: while the batch has no more than ``few`` rows
    its keys may be broadcast and the stored table is scanned, not shuffled. What becomes of a row is
    decided by its keys and written as a ``step``; its content meets that once, and stored content is
    read for ``touched`` rows only, so that what is shuffled and kept on disk does not grow with the texts.
    """
    stored = conform(current, POSTING)
    size = rows.count()

    def side(df: DataFrame) -> DataFrame:  # each has a row for a row of the batch at most
        return dealt(df, size, few)

    # Postings without a source id never share one; their own key spreads them over the tasks.
    content = rows.select(F.col("posting_key").alias("_own"), *CONTENT)
    rows = rows.select("posting_key", "source", "source_job_id", "seq", "_first", "_last", spread(F.col("source_job_id")).alias("_key"))
    keyed = ["source", "_key"]
    batch_ids = rows.where(F.col("source_job_id").isNotNull()).select(*keyed).distinct()
    own_ids = stored.where(F.col("source_job_id").isNotNull()).select(
        "posting_key", "source", F.col("source_job_id").alias("_key"), "first_seen_at"
    )
    sighted = rows.select(F.col("posting_key").alias("_owner"), F.lit(True).alias("_owner_sighted"))
    # Each step that reads stored keys is written by itself, so that no two of their shuffles are kept at once.
    owners = step(
        own_ids.join(side(batch_ids), keyed, "left_semi")
        .select(
            *keyed, F.col("posting_key").alias("_owner"),
            F.col("first_seen_at").alias("_owner_first"),
        )
        .join(side(sighted), "_owner", "left"),
        "owners",
    )
    old = stored.select("posting_key", "first_seen_at", "last_seen_at", "closed_at", "source", "source_job_id")
    old = step(old.join(side(rows.select("posting_key")), "posting_key", "left_semi"), "old")
    was = old.select(
        "posting_key",
        F.col("first_seen_at").alias("_old_first"),
        F.col("source").alias("_old_source"),
        F.col("source_job_id").alias("_old_id"),
    )
    known = step(rows.join(side(was), "posting_key", "left").join(side(owners), keyed, "left"), "known")
    matched = F.col("_old_first").isNotNull()
    free = matched & F.col("_owner").isNull() & F.col("source_job_id").isNotNull()
    # Of several stored postings that turn up under one id nobody had, the first one takes it.
    takers = known.where(free).groupBy(*keyed).agg(F.min_by("posting_key", "seq").alias("_taker"))
    known = known.join(side(takers), keyed, "left")
    own_id = F.col("source_job_id").isNull() | F.col("_owner").eqNullSafe(F.col("posting_key"))
    takes = ~matched | own_id | (free & (F.col("_taker") == F.col("posting_key")))
    # The id each sighted posting holds: the one it came with, or the one it had.
    known = known.withColumns({"_matched": matched, "_takes": takes}).withColumns(
        {
            "_source": F.when(F.col("_takes"), F.col("source")).otherwise(F.col("_old_source")),
            "_id": F.when(F.col("_takes"), F.col("source_job_id")).otherwise(F.col("_old_id")),
        }
    ).withColumn("_held", spread(F.col("_id")))
    # Stored postings now hold different ids. An unknown fingerprint under a held id is an
    # edited version: the later sighting of the two stays.
    held, edit = F.col("_matched"), ~F.col("_matched")
    holds = (
        known.where(F.col("_id").isNotNull())
        .groupBy("_source", "_held")
        .agg(
            F.max(F.when(held, F.col("posting_key"))).alias("_holder"),
            F.max(F.when(held, F.col("seq"))).alias("_holder_seq"),
            F.max_by("posting_key", F.when(edit, F.col("seq"))).alias("_edited"),
            F.max(F.when(edit, F.col("seq"))).alias("_edited_seq"),
            F.min("_first").alias("_id_first"),
        )
    )
    edit_wins = F.col("_edited").isNotNull() & (
        F.col("_holder").isNull() | (F.col("_edited_seq") > F.col("_holder_seq"))
    )
    holds = holds.select(
        "_source", "_held", "_id_first",
        F.when(edit_wins, F.col("_edited")).otherwise(F.col("_holder")).alias("_winner"),
    )
    stays = F.col("_id").isNull() | (F.col("_winner") == F.col("posting_key"))
    decided = known.join(side(holds), ["_source", "_held"], "left").withColumn(
        "change",
        F.when(stays & edit, "new")
        .when(edit, "dropped")
        .when(stays & F.col("_takes"), "seen")
        .when(stays, "touched")
        .otherwise("replaced"),
    )
    carried = F.least("_first", "_old_first", "_id_first", "_owner_first")
    # An edit also gives the row it replaces, unless that posting was sighted and is decided
    # itself.
    edits = (
        (F.col("change") == "new")
        & F.col("_owner").isNotNull()
        & F.col("_owner_sighted").isNull()
    )
    both = F.array(F.lit(False), F.lit(True))
    outcome = (
        decided.where(F.col("change") != "dropped")
        .withColumn("_row", F.col("posting_key"))
        .withColumn("_gone", F.explode(F.when(edits, both).otherwise(F.array(F.lit(False)))))
        .withColumns(
            {
                "posting_key": F.when(F.col("_gone"), F.col("_owner")).otherwise(
                    F.col("posting_key")
                ),
                "first_seen_at": F.when(F.col("change") == "new", carried).otherwise(
                    F.least("_first", "_old_first")
                ),
                "change": F.when(F.col("_gone"), "replaced").otherwise(F.col("change")),
            }
        )
    )
    outcome = step(outcome.select("posting_key", "_row", "first_seen_at", "_last", "change"), "outcome")
    touched = F.col("change") == "touched"

    def changed(part: DataFrame, stored_part: DataFrame, own: Sequence[str]) -> DataFrame:
        """Rows of the outcome beside their stored ones, whose content they keep but for the columns ``own``."""
        return (
            part.join(side(content), F.col("_row").eqNullSafe(F.col("_own")))
            .alias("n")
            .join(stored_part.alias("o"), F.col("n.posting_key") == F.col("o.posting_key"), "left")
            .select(
                "n.posting_key",
                *[f"n.{c}" if c in own else f"o.{c}" for c in CONTENT],
                "n.first_seen_at",
                F.greatest(F.col("n._last"), F.col("o.last_seen_at")).alias("last_seen_at"),
                "o.closed_at",
                "n.change",
            )
            .select(*POSTING, "change")
        )

    times = old.select("posting_key", "last_seen_at", "closed_at")
    changes = changed(outcome.where(~touched), side(times), CONTENT)
    kept = outcome.where(touched)
    if count := kept.count():
        before = stored.join(dealt(kept.select("posting_key"), count, few), "posting_key", "left_semi")
        changes = changes.unionByName(changed(kept, dealt(before, count, few), VERDICT_COLUMNS))
    return changes


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """U1. All stored postings after a batch, with ``change`` (``kept`` where untouched)."""
    stored = conform(current, POSTING)
    kept = stored.join(dealt(changes.select("posting_key"), changes.count()), "posting_key", "left_anti")
    return kept.withColumn("change", F.lit("kept")).unionByName(
        changes.where(F.col("change") != "replaced")
    )


def merge_postings(current: DataFrame, batch: DataFrame) -> DataFrame:
    """U1, U2. ``collapse_batch``, ``posting_changes`` and ``apply_changes`` in turn, each step
    staged in the shared folder."""
    rows = stage(collapse_batch(batch), "collapsed")
    changes = stage(posting_changes(current, rows), "changes")
    return apply_changes(current, changes)


def run_counters(merged: DataFrame, batch: DataFrame) -> DataFrame:
    """A10. Seen, new and rejected counts of one batch; ``merged`` has its changes."""
    seen = batch.agg(
        F.count("*").alias("jobs_seen"), F.count_if(F.col("filtered_out")).alias("jobs_filtered")
    )
    new = merged.agg(F.count_if(F.col("change") == "new").alias("jobs_new"))
    key = F.lit(0)
    return seen.withColumn("_k", key).join(new.withColumn("_k", key), "_k").drop("_k")


def merge_companies(current: DataFrame, sightings: DataFrame) -> DataFrame:
    """U3. Employers after a batch of ``(company_key, name, ats_type, board_token, seq)``: the
    last name wins, the first known board is kept, verdict columns are never touched."""

    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    fresh = sightings.groupBy("company_key").agg(
        F.max_by("name", "seq").alias("name"), first_known("ats_type"), first_known("board_token")
    )
    o, n = current.alias("o"), fresh.alias("n")
    joined = o.join(n, F.col("o.company_key") == F.col("n.company_key"), "full_outer")
    return joined.select(
        F.coalesce(F.col("o.company_key"), F.col("n.company_key")).alias("company_key"),
        F.coalesce(F.col("n.name"), F.col("o.name")).alias("name"),
        F.coalesce(F.col("o.ats_type"), F.col("n.ats_type")).alias("ats_type"),
        F.coalesce(F.col("o.board_token"), F.col("n.board_token")).alias("board_token"),
        F.coalesce(F.col("o.verdict"), F.lit("unknown")).alias("verdict"),
        *[F.col(f"o.{c}").alias(c) for c in ("sector", "reason", "verdict_source", "decided_at")],
    )


def company_sightings(batch: DataFrame) -> DataFrame:
    """Employer sightings of a posting batch; only board feeds tell the applicant system."""
    boarded = F.col("source").isin(*BOARD_SOURCES)
    return batch.select(
        "company_key",
        F.col("company_name").alias("name"),
        F.when(boarded, F.col("source")).alias("ats_type"),
        F.when(boarded, F.col("board_token")).alias("board_token"),
        "seq",
    )


def fold_status(events: DataFrame) -> DataFrame:
    """U6. Application state from a log ``(posting_key, status, at, event_id)``. ``applied_at``
    is the first move out of queued and dismissed and is never rewritten; an unlisted status is
    an error."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(
        F.raise_error(F.concat(F.lit("unknown status: "), F.col("status")))
    )
    moved = ~F.col("status").isin("queued", "dismissed")

    def first(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("at")))

    return events.groupBy("posting_key").agg(
        F.max_by(known, F.struct("at", "event_id")).alias("status"),
        first(moved).alias("applied_at"),
        first(F.col("status") == "responded").alias("responded_at"),
        first(F.col("status") == "interview").alias("interview_at"),
        first(F.col("status") == "rejected").alias("closed_at"),
        F.max("at").alias("updated_at"),
    )


def rejudge(
    postings: DataFrame, rules: RuleSet | None = None, vocab: PlaceVocab | None = None
) -> DataFrame:
    """U9. Open postings under new rules, with the old verdict in ``_was`` and the new one in
    ``_judged``, for ``rejudge_diff``; closed postings keep theirs."""
    was = F.struct("location_class", "filter_reason")
    judged = F.when(is_open(), judgement(rules, vocab)).otherwise(was)
    # Staged: a filter on the verdict would otherwise judge every posting twice.
    return with_judgement(stage(postings.withColumns({"_was": was, "_judged": judged}), "judgement"))


def rejudge_changed(postings: DataFrame, old: RuleSet, new: RuleSet, keep: Sequence[str] = ("posting_key",)) -> DataFrame:
    """U9 for postings that were judged under ``old``: only those that a changed part of the rules can touch are
    judged, in the form that ``rejudge_diff`` takes, with the columns ``keep`` beside the verdict. A posting
    that a part before the first changed one decided keeps its verdict; place classes don't depend on the rules
    and are taken as stored. So no description or location is read, and no title unless a title rule changed."""
    first = first_change(old, new)
    table = F.create_map(*[F.lit(x) for pair in LAST_PART.items() for x in pair])
    decided = F.coalesce(F.try_element_at(table, F.col("filter_reason")), F.lit(len(PARTS)))
    touched = postings.where(is_open() & (decided >= F.lit(len(PARTS) + 1 if first is None else first)))
    title = first is not None and first < PARTS.index("pay_floor")
    reason = rejection_reason(F.col("location_class"), new) if title else terms_reason(F.col("location_class"), new)
    was = F.struct("location_class", "filter_reason").alias("_was")
    now = F.struct("location_class", reason.alias("filter_reason")).alias("_judged")
    return with_judgement(touched.select(*keep, was, now))


def rejudge_diff(judged: DataFrame) -> DataFrame:
    """O5. Postings whose verdict or class changed, with the reasons ``was`` and ``now``."""
    differs = ~F.col("_judged").eqNullSafe(F.col("_was"))
    changed = judged.where(differs)
    return changed.withColumns(
        {
            "was": F.coalesce("_was.filter_reason", F.lit("passes")),
            "now": F.coalesce("_judged.filter_reason", F.lit("passes")),
        }
    ).drop("_was", "_judged")
