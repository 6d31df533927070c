"""Published tables behind the queue and detail pages."""

from __future__ import annotations

from datetime import datetime

from postmill import schemas as S
from postmill.operators.merges import fold_status
from postmill.operators.postings import posting_detail
from postmill.operators.pages import write_pages
from postmill.operators.queue import QueueFilters, queue_facets, ranked_queue, sort_columns
from postmill.plans.workspace import Workspace

STATUS_EVENT = S.columns("posting_key string, status string, at timestamp, event_id string")


def publish(ws: Workspace, out: str, as_of: datetime, filters: QueueFilters | None = None) -> None:
    """Write the ranked queue, in pages that ``operators.pages`` reads, its facets and the detail table."""
    events = ws.log("status_events", STATUS_EVENT)
    applications = S.conform(fold_status(events), S.APPLICATION)
    postings, companies, scores = ws.postings.read(), ws.companies.read(), ws.scores.read()
    ranked = ranked_queue(postings, companies, scores, applications, as_of, filters)
    ranked.write.mode("overwrite").parquet(f"{out}/queue")
    write_pages(ranked, sort_columns(filters or QueueFilters()), f"{out}/pages")
    facets = queue_facets(postings, companies, scores, applications)
    facets.write.mode("overwrite").parquet(f"{out}/facets")
    detail = posting_detail(postings, companies, scores, applications)
    detail.write.mode("overwrite").parquet(f"{out}/detail")
