"""Append-only logs of a workspace: model spend (U11) and fetch attempts (U12). A batch that runs again
replaces its own rows, so nothing is counted twice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postmill.operators.runs import source_state
from postmill.operators.spend import rates_table, with_cost
from postmill.plans.workspace import Workspace
from postmill.schemas import SPEND, conform
from postmill.sources.tables import append_once

ATTEMPT = {"source": "string", "attempt_id": "bigint", "at": "timestamp", "ok": "boolean"}


def record_spend(ws: Workspace, usage: DataFrame, batch_id: str, rates: DataFrame | None = None) -> None:
    """U11. Model calls with their cost into the spend log."""
    known = conform(usage, {name: kind for name, kind in SPEND.items() if name != "cost_usd"})
    priced = with_cost(known, rates if rates is not None else rates_table(ws.spark))
    append_once(conform(priced, SPEND), ws.log_path("spend"), batch_id)


def spend(ws: Workspace) -> DataFrame:
    return ws.log("spend", SPEND)


def record_attempts(ws: Workspace, attempts: DataFrame, batch_id: str) -> None:
    """U12. Fetch attempts into the attempt log."""
    append_once(conform(attempts, ATTEMPT), ws.log_path("attempts"), batch_id)


def sources(ws: Workspace) -> DataFrame:
    """A17. State of every source that was tried."""
    return source_state(ws.log("attempts", ATTEMPT))
