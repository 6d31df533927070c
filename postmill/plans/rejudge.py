"""Re-judging stored postings under changed rules (E4; U9, O5, A11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.rules import RuleSet
from postmill.operators.merges import rejudge, rejudge_changed, rejudge_diff
from postmill.operators.reports import rejudge_transitions
from postmill.operators.common import unique_join
from postmill.plans.workspace import Workspace
from postmill.session import stage
from postmill.vocab import PlaceVocab


def rejudge_stored(
    ws: Workspace,
    rules: RuleSet | None = None,
    vocab: PlaceVocab | None = None,
    dry_run: bool = False,
    previous: RuleSet | None = None,
) -> DataFrame:
    """Apply the rules to every open posting and store the changed ones, unless ``dry_run``.
    Returns the transition counts with examples. Where the rules under which the postings were judged are given
    as ``previous``, and the place lists are the same, only postings that the change can touch are judged."""
    stored = ws.postings.read()
    if previous is None or vocab is not None:
        changed = stage(rejudge_diff(rejudge(stored, rules, vocab)), "rejudged")
    else:
        verdict = ["filter_reason", "filtered_out", "was", "now"]
        diff = rejudge_diff(rejudge_changed(stored, previous, rules or RuleSet())).select("posting_key", *verdict)
        changed = stage(stored.drop(*verdict).join(diff, "posting_key"), "rejudged")
    if not dry_run:
        ws.postings.commit(changed)
    names = ws.companies.read().select("company_key", F.col("name").alias("company_name"))
    return rejudge_transitions(unique_join(changed, names, "company_key"))
