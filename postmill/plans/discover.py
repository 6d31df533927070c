"""Discovery: landed payloads to stored postings and employers (E1; U1-U3, U10, A10)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.expr import instant
from postmill.functions.normalize import normalize_postings
from postmill.functions.rules import RuleSet, apply_rules
from postmill.operators.merges import (
    collapse_batch,
    company_sightings,
    merge_companies,
    posting_changes,
)
from postmill.plans.workspace import Workspace
from postmill.schemas import RUN, conform, ddl
from postmill.session import Staging, dealt, stage
from postmill.sources.feeds import read_raw, split_sound, unreadable
from postmill.sources.landing import FILE, landed_status, new_files
from postmill.sources.tables import append_once
from postmill.vocab import PlaceVocab


BOARD = {"source": "string", "token": "string", "n": "bigint", "status": "string", "run_id": "string"}


def judged_batch(
    raw: DataFrame, as_of: datetime, rules: RuleSet | None = None, vocab: PlaceVocab | None = None
) -> DataFrame:
    """Raw postings normalised and judged, with ``seen_at`` and ``seq``. Rows of one batch have
    no order of arrival of their own, so ``seq`` orders them by posting time, then content."""
    judged = apply_rules(normalize_postings(raw), rules, vocab)
    order = F.struct("posted_at", F.xxhash64("source", "source_job_id", "title", "description"))
    micros = F.coalesce(F.unix_micros(order["posted_at"]), F.lit(0))
    # Whole seconds, then 31 bits of the content hash.
    seq = F.floor(micros / 1_000_000) * F.lit(1 << 31) + F.pmod(order["col2"], F.lit(1 << 31))
    return judged.withColumns({"seen_at": instant(as_of), "seq": seq.cast("bigint")})


def store_batch(
    ws: Workspace, judged: DataFrame, step: Callable[[DataFrame, str], DataFrame] = stage
) -> DataFrame:
    """Merge a staged batch into the stored postings and employers, with steps written by ``step``, which may be a
    ``Staging`` that has the batch as well; returns the changes."""
    current = ws.postings.read()
    rows = step(collapse_batch(judged), "collapsed")
    changes = step(posting_changes(current, rows, step=step), "changes")
    if isinstance(step, Staging):
        step.free_others(judged, changes)
    replaced = F.col("change") == "replaced"
    ws.postings.commit(changes.where(~replaced), gone=changes.where(replaced))

    sighted = company_sightings(judged.withColumn("board_token", F.lit(None).cast("string")))
    named = dealt(sighted.select("company_key").distinct(), judged.count())
    known = ws.companies.read().join(named, "company_key", "left_semi")
    ws.companies.commit(merge_companies(known, sighted))
    return changes


def discover(
    ws: Workspace,
    landing: str,
    as_of: datetime,
    batch_id: str,
    sources: Iterable[str] | None = None,
    rules: RuleSet | None = None,
    vocab: PlaceVocab | None = None,
    lines: bool = False,
    changed_only: bool = True,
) -> DataFrame:
    """One discovery run; returns its run-log row, which is written last. A run that has one is not
    run again, one that broke off is finished. Files that an earlier run has read are passed over, unless
    ``changed_only`` is off. The state of every board that was read goes into the log ``boards`` (S9)."""
    done = ws.log("runs", RUN).where(F.col("run_id") == batch_id)
    if not done.isEmpty():
        return done
    started = datetime.now(timezone.utc)
    fresh = stage(new_files(ws.spark, landing, ws.log("files", FILE)), "files") if changed_only else None
    raw = stage(read_raw(ws.spark, landing, sources, lines, fresh), "raw")
    good, bad = split_sound(raw)
    broken = stage(unreadable(ws.spark, landing, sources, lines, fresh), "unreadable")
    append_once(bad, ws.log_path("quarantine"), batch_id)
    append_once(broken, ws.log_path("unreadable"), batch_id)
    boards = landed_status(ws.spark, landing, lines, fresh)
    boards = boards if sources is None else boards.where(F.col("source").isin(*sources))
    append_once(conform(boards.withColumn("run_id", F.lit(batch_id)), BOARD), ws.log_path("boards"), batch_id)
    judged = stage(judged_batch(good, as_of, rules, vocab), "judged")
    changes = store_batch(ws, judged)
    seen = judged.agg(F.count("*"), F.count_if("filtered_out")).first()
    new = changes.where(F.col("change") == "new").count()
    errors = bad.count() + broken.count()
    odd = ws.log("boards", BOARD).where((F.col("run_id") == batch_id) & (F.col("status") != "ok")).count()
    finished = datetime.now(timezone.utc)
    run = ws.spark.createDataFrame(
        [
            (
                batch_id, started, finished, seen[0], new, seen[1], errors,
                int((finished - started).total_seconds() * 1000), False, f"{odd} boards not ok" if odd else None,
            )
        ],
        ddl(RUN),
    )
    if fresh is not None:
        append_once(fresh, ws.log_path("files"), batch_id)
    append_once(run.coalesce(1), ws.log_path("runs"), batch_id)
    return run
