"""Breakdowns, funnel, audits and the employer screen's reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.places import CLASS_LABELS, CLASSES
from postmill.operators import quality as K
from postmill.operators import reports as R
from postmill.operators import runs as N
from postmill.operators import screen as C
from postmill.operators.common import with_labels
from postmill.operators.postings import is_live
from queries.binding import (
    AS_OF,
    AS_OF_SQL,
    ATTEMPTS,
    RUNS,
    applications,
    companies,
    events_as,
    oracle,
    postings,
    scores,
    stamp,
    stamp_sql,
)
from queries.registry import query


@query("intake_breakdown", oracle(
    "SELECT COALESCE(filter_reason, 'passes') AS reason, count(*) AS n,"
    f" count(*) FILTER (WHERE first_seen_at >= {AS_OF_SQL} - INTERVAL 7 DAY) AS this_week,"
    " CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM postings WHERE closed_at IS NULL) AS share"
    " FROM postings WHERE closed_at IS NULL GROUP BY 1",
    "postings",
))
def intake_breakdown(spark, sf):
    return R.intake_breakdown(postings(spark, sf), AS_OF)


GRID = (
    "SELECT location_class, remote_type, count(*) AS n, count(*) FILTER (WHERE filter_reason IN"
    " ('location_outside_area', 'remote_outside_us')) AS rejected FROM postings"
    " WHERE closed_at IS NULL GROUP BY 1, 2"
)


@query("place_grid", oracle(GRID, "postings"))
def place_grid(spark, sf):
    return R.place_grid(postings(spark, sf))


@query("place_grid_wide", oracle(
    "SELECT location_class, "
    + ", ".join(
        f"CAST(COALESCE(sum(n) FILTER (WHERE remote_type = '{a}'), 0) AS BIGINT) AS {a}"
        for a in R.ARRANGEMENTS
    )
    + ", CAST(sum(rejected) AS BIGINT) AS rejected FROM grid GROUP BY 1",
    "postings", grid=GRID,
))
def place_grid_wide(spark, sf):
    return R.place_grid_wide(postings(spark, sf))


VERDICT = (
    "CASE WHEN location_class = 'elsewhere' THEN CASE WHEN remote_type = 'remote' THEN"
    " 'remote_outside_us' ELSE 'location_outside_area' END WHEN location_class = 'us' AND"
    " COALESCE(remote_type, '') <> 'remote' THEN 'location_outside_area' ELSE 'passes' END"
)


@query("place_audit_sets", oracle(
    "SELECT 'class' AS audit, location_class, NULL AS remote_type, NULL AS verdict, count(*) AS n,"
    " CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM o) AS share FROM o GROUP BY location_class"
    " UNION ALL SELECT 'verdict', NULL, NULL, verdict, count(*), NULL FROM o GROUP BY verdict"
    " UNION ALL SELECT 'pair', location_class, remote_type, verdict, count(*), NULL FROM o"
    " GROUP BY location_class, remote_type, verdict",
    "postings", o=f"SELECT *, {VERDICT} AS verdict FROM postings WHERE closed_at IS NULL",
))
def place_audit_sets(spark, sf):
    return R.place_audit(postings(spark, sf))


@query("place_class_labels", oracle(
    "SELECT location_class, count(*) AS n, CASE location_class "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_LABELS.items())
    + " END AS label, CASE location_class "
    + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(CLASSES))
    + " END AS ord FROM postings GROUP BY 1",
    "postings",
))
def place_class_labels(spark, sf):
    counts = postings(spark, sf).groupBy("location_class").agg(F.count("*").alias("n"))
    labelled = with_labels(counts, "location_class", CLASS_LABELS)
    return labelled.withColumn("ord", R.class_order().cast("int"))


SCREEN = (
    "SELECT c.company_key, c.name, c.verdict, c.sector, c.reason, c.verdict_source,"
    " count(p.posting_key) FILTER (WHERE NOT p.filtered_out AND p.closed_at IS NULL) AS live_jobs"
    " FROM companies c LEFT JOIN postings p USING (company_key) WHERE c.verdict <> 'unknown'"
    " GROUP BY ALL"
)


@query("company_cost", oracle(SCREEN, "companies", "postings"))
def company_cost(spark, sf):
    return C.company_screen(companies(spark, sf), postings(spark, sf)).select(
        "company_key", "name", "verdict", "sector", "reason", "verdict_source", "live_jobs"
    )


@query("screen_cost", oracle(
    "SELECT verdict, count(*) AS companies, CAST(sum(live_jobs) AS BIGINT) AS live_jobs FROM s"
    " GROUP BY 1", "companies", "postings", s=SCREEN,
))
def screen_cost(spark, sf):
    return C.screen_cost(companies(spark, sf), postings(spark, sf))


@query("reviewable_companies", oracle(
    "SELECT company_key, name, verdict, sector, reason, verdict_source FROM companies"
    " WHERE verdict IN ('flagged', 'excluded') OR verdict_source = 'user'", "companies",
))
def reviewable_companies(spark, sf):
    return C.reviewable(companies(spark, sf)).select(
        "company_key", "name", "verdict", "sector", "reason", "verdict_source"
    )


NEWEST = (
    "SELECT c.company_key, c.name, COALESCE(p.description, '') AS description FROM companies c"
    " LEFT JOIN (SELECT company_key, description FROM (SELECT *, row_number() OVER (PARTITION BY"
    " company_key ORDER BY last_seen_at DESC, posting_key DESC) AS rk FROM postings) WHERE rk = 1) p"
    " USING (company_key)"
)


@query("latest_per_company", oracle(NEWEST, "companies", "postings"))
def latest_per_company(spark, sf):
    return C.newest_text(companies(spark, sf), postings(spark, sf)).select(
        "company_key", "name", "description"
    )


@query("funnel", oracle(
    "SELECT s.ord, s.status, count(a.posting_key) AS n FROM (VALUES (0, 'queued'), (1, 'applied'),"
    " (2, 'responded'), (3, 'interview'), (4, 'rejected')) s(ord, status) LEFT JOIN applications a"
    " USING (status) GROUP BY 1, 2", "applications",
))
def funnel(spark, sf):
    return R.funnel(applications(spark, sf))


@query("weekly_conversion", oracle(
    "SELECT strftime(date_trunc('week', applied_at), '%Y-%m-%d %H:%M:%S') AS week,"
    " count(*) AS applied, count(*) FILTER (WHERE status IN ('responded', 'interview')) AS responded,"
    " count(*) FILTER (WHERE status = 'interview') AS interviewed, CAST(count(*) FILTER (WHERE"
    " status IN ('responded', 'interview')) AS DOUBLE) / count(*) AS response_rate FROM applications"
    " WHERE applied_at >= date_trunc('week', TIMESTAMP '2024-01-31 00:00:00') - INTERVAL 14 DAY"
    " GROUP BY 1", "applications",
))
def weekly_conversion(spark, sf):
    from datetime import datetime

    weekly = R.weekly_conversion(applications(spark, sf), datetime(2024, 1, 31), weeks=2)
    return weekly.select(
        stamp("week"), "applied", "responded", "interviewed", "response_rate"
    )


@query("score_histogram", oracle(
    "SELECT measure, CAST(floor(x * 20) AS INT) AS bin, count(*) AS n,"
    " floor(x * 20) / 20 AS low FROM (SELECT 'embed_similarity' AS measure, embed_similarity AS x"
    " FROM scores UNION ALL SELECT 'total_score', total_score FROM scores) GROUP BY ALL", "scores",
))
def score_histogram(spark, sf):
    return R.score_histogram(scores(spark, sf))


def _extreme_sql(order: str, k: int) -> str:
    return oracle(
        "SELECT p.posting_key, p.title, s.total_score FROM postings p JOIN scores s"
        " USING (posting_key) WHERE NOT p.filtered_out AND p.closed_at IS NULL"
        f" ORDER BY s.total_score {order}, p.posting_key DESC LIMIT {k}", "postings", "scores",
    )


def _scored(spark, sf):
    live = postings(spark, sf).where(is_live()).select("posting_key", "title")
    return live.join(scores(spark, sf).select("posting_key", "total_score"), "posting_key")


@query("score_top", _extreme_sql("DESC", 25))
def score_top(spark, sf):
    return R.extremes(_scored(spark, sf), 25)


@query("score_bottom", _extreme_sql("ASC", 10))
def score_bottom(spark, sf):
    return R.extremes(_scored(spark, sf), 10, best=False)


@query("health_summary", oracle(
    "SELECT (SELECT count(*) FROM postings WHERE NOT filtered_out AND closed_at IS NULL) AS live,"
    " run_id, jobs_new, errors FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1",
    "postings", "runs",
))
def health_summary(spark, sf):
    return R.health(postings(spark, sf), events_as(spark, sf, RUNS)).select(
        "live", "last_run.run_id", "last_run.jobs_new", "last_run.errors"
    )


@query("pass_rate_by_source", oracle(
    "SELECT source, count(*) AS n, count(*) FILTER (WHERE filter_reason IS NULL) AS passed,"
    " CAST(count(*) FILTER (WHERE filter_reason IS NULL) AS DOUBLE) / count(*) AS pass_rate"
    " FROM postings GROUP BY 1", "postings",
))
def pass_rate_by_source(spark, sf):
    return R.pass_rate(postings(spark, sf))


@query("pay_disclosure", oracle(
    "SELECT source, salary_source, count(*) AS n FROM postings GROUP BY 1, 2", "postings",
))
def pay_disclosure(spark, sf):
    return R.pay_disclosure(postings(spark, sf))


@query("recent_runs", oracle(
    f"SELECT run_id, {stamp_sql('started_at')}, jobs_seen, jobs_new, errors FROM runs"
    " ORDER BY runs.started_at DESC, run_id DESC LIMIT 20", "runs",
))
def recent_runs(spark, sf):
    return N.recent_runs(events_as(spark, sf, RUNS)).select(
        "run_id", stamp("started_at"), "jobs_seen", "jobs_new", "errors"
    )


@query("missing_runs", oracle(
    "SELECT strftime(t.tick, '%Y-%m-%d %H:%M:%S') AS tick FROM (SELECT unnest(generate_series("
    "TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-07 00:00:00', INTERVAL 10 MINUTE)) AS tick)"
    " t LEFT JOIN (SELECT DISTINCT time_bucket(INTERVAL 10 MINUTE, started_at,"
    " TIMESTAMP '2024-01-01 00:00:00') AS tick FROM runs WHERE finished_at IS NOT NULL) d"
    " ON d.tick = t.tick WHERE d.tick IS NULL", "runs",
))
def missing_runs(spark, sf):
    from datetime import datetime

    runs = events_as(spark, sf, RUNS)
    return N.missing_runs(runs, datetime(2024, 1, 1), datetime(2024, 1, 7), 10).select(stamp("tick"))


STATE = (
    "SELECT a.source, max(a.\"at\") AS last_fetch_started_at, max(l.at) AS last_fetch_ok_at,"
    " count(*) FILTER (WHERE NOT a.ok AND (l.id IS NULL OR a.\"at\" > l.at OR (a.\"at\" = l.at AND"
    " a.attempt_id > l.id))) AS consecutive_errors FROM attempts a LEFT JOIN (SELECT source,"
    " \"at\", attempt_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY"
    " \"at\" DESC, attempt_id DESC) AS rk FROM attempts WHERE ok) WHERE rk = 1) l"
    " ON l.source = a.source GROUP BY a.source"
).replace("l.at", 'l."at"')


@query("failure_streaks", oracle(
    f"SELECT source, {stamp_sql('last_fetch_started_at')}, {stamp_sql('last_fetch_ok_at')},"
    " consecutive_errors FROM s", "attempts", s=STATE,
))
def failure_streaks(spark, sf):
    return N.source_state(events_as(spark, sf, ATTEMPTS)).select(
        "source", stamp("last_fetch_started_at"), stamp("last_fetch_ok_at"), "consecutive_errors"
    )


@query("due_sources", oracle(
    f"SELECT i.source, {stamp_sql('last_fetch_started_at')} FROM intervals i LEFT JOIN s"
    " USING (source) WHERE s.last_fetch_started_at IS NULL OR s.last_fetch_started_at <"
    " TIMESTAMP '2024-01-31 00:00:00' - to_seconds(i.min_interval_seconds)",
    "attempts", s=STATE,
    intervals="SELECT 'feed' || CAST(s_suppkey AS VARCHAR) AS source,"
    " s_suppkey * 3600 * 3 AS min_interval_seconds FROM supplier",
))
def due_sources(spark, sf):
    from datetime import datetime

    from queries.binding import table

    intervals = table(spark, sf, "supplier").selectExpr(
        "'feed' || CAST(s_suppkey AS STRING) AS source",
        "s_suppkey * 3600 * 3 AS min_interval_seconds",
    )
    state = N.source_state(events_as(spark, sf, ATTEMPTS))
    return N.due_sources(state, intervals, datetime(2024, 1, 31)).select(
        "source", stamp("last_fetch_started_at")
    )


@query("constraint_audit", oracle(
    "SELECT 'filtered_has_reason' AS rule, count(*) AS checked, count(*) FILTER (WHERE filtered_out"
    " <> (filter_reason IS NOT NULL)) AS violations FROM postings UNION ALL"
    " SELECT 'verdict_names_model', count(*), count(*) FILTER (WHERE (relevance_verdict IS NULL) <>"
    " (model IS NULL)) FROM scores UNION ALL SELECT 'total_in_range', count(*), count(*) FILTER"
    " (WHERE NOT total_score BETWEEN 0 AND 1) FROM scores UNION ALL SELECT 'key_present', count(*),"
    " count(*) FILTER (WHERE posting_key IS NULL) FROM postings UNION ALL SELECT 'title_present',"
    " count(*), count(*) FILTER (WHERE title IS NULL) FROM postings UNION ALL SELECT"
    " 'applied_has_time', count(*), count(*) FILTER (WHERE status NOT IN ('queued', 'dismissed') AND"
    " applied_at IS NULL) FROM applications UNION ALL SELECT 'status_known', count(*), count(*) FILTER"
    " (WHERE status IS NULL) FROM applications UNION ALL SELECT 'verdict_known', count(*), count(*)"
    " FILTER (WHERE verdict NOT IN ('allowed', 'excluded', 'flagged', 'unknown')) FROM companies"
    " UNION ALL SELECT 'one_row_per_title', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT title,"
    " count(*) AS n FROM postings GROUP BY title)",
    "postings", "scores", "applications", "companies",
))
def constraint_audit(spark, sf):
    ps = postings(spark, sf)
    per_title = ps.groupBy("title").agg(F.count("*").alias("n"))
    return (
        K.audit(ps, K.posting_rules())
        .unionByName(K.audit(scores(spark, sf), K.score_rules()))
        .unionByName(K.audit(applications(spark, sf), K.application_rules()))
        .unionByName(K.audit(companies(spark, sf), K.company_rules()))
        .unionByName(K.audit(per_title, {"one_row_per_title": F.col("n") == 1}))
    )


@query("duplicate_source_ids", oracle(
    "SELECT source, title, count(*) AS n FROM postings GROUP BY 1, 2 HAVING count(*) > 1",
    "postings",
))
def duplicate_source_ids(spark, sf):
    return K.duplicate_keys(postings(spark, sf), "source", "title")
