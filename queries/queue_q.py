"""Queue, detail and candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import pages as G
from postmill.operators import postings as P
from postmill.operators import queue as Q
from postmill.operators import reports as R
from postmill.operators import scoring as S
from postmill.session import scratch
from queries.binding import (
    AS_OF,
    AS_OF_SQL,
    applications,
    companies,
    oracle,
    postings,
    scores,
    stamp,
    stamp_sql,
)
from queries.registry import query

COLUMNS = [
    "posting_key", "company_name", "title", "location", "remote_type", "location_class",
    "salary_min", "salary_max", "apply_url", "verdict", "verdict_reason", "total_score",
    "embed_similarity", "relevance_verdict", "rationale", "is_stretch",
]


def _queue(spark, sf, filters=None):
    ranked = Q.ranked_queue(
        postings(spark, sf), companies(spark, sf), scores(spark, sf), applications(spark, sf),
        AS_OF, filters,
    )
    return ranked


def _shape(df):
    return df.select(*COLUMNS, stamp("posted_at"))


def _sql(where: str = "TRUE", cap: int = 3, order: str = "total_score DESC, posting_key DESC",
         tail: str = "") -> str:
    return oracle(
        f"SELECT {', '.join(COLUMNS)}, {stamp_sql('posted_at')} FROM ranked WHERE rk <= {cap}"
        f" ORDER BY {order} {tail}",
        "postings", "scores", "companies", "applications",
        ranked=(
            "SELECT p.*, c.name AS company_name, c.verdict, c.reason AS verdict_reason,"
            " s.total_score, s.embed_similarity, s.relevance_verdict, s.rationale, s.is_stretch,"
            " s.judged_at, row_number() OVER (PARTITION BY p.company_key ORDER BY"
            " s.total_score DESC, p.posting_key DESC) AS rk"
            " FROM scores s JOIN postings p USING (posting_key)"
            " JOIN companies c ON c.company_key = p.company_key"
            " LEFT JOIN applications a ON a.posting_key = p.posting_key"
            " WHERE NOT p.filtered_out AND p.closed_at IS NULL AND c.verdict <> 'excluded'"
            f" AND (a.status IS NULL OR a.status = 'queued') AND {where}"
        ),
    )


@query("ranked_queue", _sql())
def ranked_queue(spark, sf):
    return _shape(_queue(spark, sf))


FILTERED = Q.QueueFilters(
    min_score=0.2, remote_types=("remote", "hybrid"), location_classes=("local", "us_wide", "us"),
    min_salary=150_000, posted_within_days=1500, company="#0000001", per_company_cap=2,
)


@query(
    "queue_filtered",
    _sql(
        "s.total_score >= 0.2 AND p.remote_type IN ('remote', 'hybrid')"
        " AND p.location_class IN ('local', 'us_wide', 'us')"
        " AND (COALESCE(p.salary_max, p.salary_min) IS NULL"
        " OR COALESCE(p.salary_max, p.salary_min) >= 150000)"
        f" AND (p.posted_at IS NULL OR p.posted_at >= {AS_OF_SQL} - INTERVAL 1500 DAY)"
        " AND c.name ILIKE '%#0000001%'",
        cap=2,
    ),
)
def queue_filtered(spark, sf):
    return _shape(_queue(spark, sf, FILTERED))


@query("queue_judged_only", _sql("s.judged_at IS NOT NULL"))
def queue_judged_only(spark, sf):
    return _shape(_queue(spark, sf, Q.QueueFilters(judged_only=True)))


BY_SALARY = Q.QueueFilters(sort="salary")


@query(
    "queue_sorted_salary",
    _sql(order="COALESCE(salary_max, salary_min) DESC NULLS LAST, posting_key DESC"),
)
def queue_sorted_salary(spark, sf):
    return _shape(_queue(spark, sf, BY_SALARY))


@query(
    "queue_sorted_company",
    _sql(order="lower(company_name) ASC, total_score DESC, posting_key DESC"),
)
def queue_sorted_company(spark, sf):
    f = Q.QueueFilters(sort="company", descending=False)
    return _shape(_queue(spark, sf, f))


@query(
    "queue_page2",
    _sql(order="posted_at DESC NULLS LAST, posting_key DESC", tail="LIMIT 51 OFFSET 50"),
)
def queue_page2(spark, sf):
    return _shape(Q.page(_queue(spark, sf, Q.QueueFilters(sort="posted")), limit=50, offset=50))


PAGED = "posting_key bigint, total_score double"


def _paged(spark, sf, first):
    """51 rows of the queue from a place on, from its written pages."""
    f = Q.QueueFilters()
    root = scratch(spark, "pages")
    G.write_pages(_queue(spark, sf, f).select("posting_key", "total_score"), Q.sort_columns(f), root, group=500)
    return G.read_rows(spark, root, PAGED, first, 51, group=500)


@query("queue_after", oracle(
    "SELECT q.posting_key, q.total_score FROM q, cut WHERE q.total_score < cut.total_score"
    " OR (q.total_score = cut.total_score AND q.posting_key < cut.posting_key)"
    " ORDER BY q.total_score DESC, q.posting_key DESC LIMIT 51",
    q=_sql(), cut="SELECT total_score, posting_key FROM q ORDER BY total_score DESC,"
    " posting_key DESC LIMIT 1 OFFSET 99",
))
def queue_after(spark, sf):
    """The page after the hundredth row."""
    return _paged(spark, sf, 100)


@query("queue_deep_page", oracle(
    "SELECT posting_key, total_score FROM q ORDER BY total_score DESC, posting_key DESC LIMIT 51 OFFSET 980", q=_sql(),
))
def queue_deep_page(spark, sf):
    """A page that two folders hold, read without the rows before it."""
    return _paged(spark, sf, 980)


@query("queue_from_text", _sql(where="total_score >= 0.25 AND remote_type IN ('remote', 'hybrid')", order="lower(company_name) ASC, total_score DESC, posting_key DESC"))
def queue_from_text(spark, sf):
    """Filters from text parameters, of which some are junk and fall back."""
    given = {"min_score": "0.25", "remote": ["remote", "hybrid"], "min_salary": "plenty", "per_company": "-4", "sort": "company", "dir": "asc", "posted_within": ""}
    return _shape(_queue(spark, sf, Q.QueueFilters.from_text(given)))


@query(
    "posting_detail",
    oracle(
        "SELECT p.posting_key, p.title, c.name AS company_name, c.verdict,"
        " c.reason AS verdict_reason, c.verdict_source, s.total_score, s.embed_similarity,"
        " s.rule_score, s.freshness_score, s.relevance_verdict, s.rationale, s.is_stretch,"
        " COALESCE(a.status, 'queued') AS status,"
        " strftime(a.applied_at, '%Y-%m-%d %H:%M:%S') AS applied_at FROM postings p"
        " JOIN companies c USING (company_key) LEFT JOIN scores s USING (posting_key)"
        " LEFT JOIN applications a USING (posting_key)",
        "postings", "companies", "scores", "applications",
    ),
)
def posting_detail(spark, sf):
    detail = P.posting_detail(
        postings(spark, sf), companies(spark, sf), scores(spark, sf), applications(spark, sf)
    )
    return detail.select(
        "posting_key", "title", "company_name", "verdict", "verdict_reason", "verdict_source",
        "total_score", "embed_similarity", "rule_score", "freshness_score", "relevance_verdict",
        "rationale", "is_stretch", "status", stamp("applied_at"),
    )


@query(
    "canonical_postings",
    oracle(
        "SELECT p.posting_key, p.source, p.title, COALESCE(p.remote_type, 'onsite') AS remote_type,"
        " c.name AS company_name FROM postings p JOIN companies c USING (company_key)",
        "postings", "companies",
    ),
)
def canonical_postings(spark, sf):
    return P.canonical(postings(spark, sf), companies(spark, sf)).select(
        "posting_key", "source", "title", "remote_type", "company_name"
    )


@query(
    "unscored_postings",
    oracle(
        "SELECT p.posting_key, p.title FROM postings p LEFT JOIN judged s USING (posting_key)"
        " WHERE NOT p.filtered_out AND p.closed_at IS NULL AND s.posting_key IS NULL",
        "postings", "scores",
        judged="SELECT posting_key FROM scores WHERE judged_at IS NOT NULL",
    ),
)
def unscored_postings(spark, sf):
    judged = scores(spark, sf).where(F.col("judged_at").isNotNull())
    return P.unscored(postings(spark, sf), judged).select("posting_key", "title")


@query(
    "place_listing",
    oracle(
        "SELECT posting_key, title, location FROM postings WHERE closed_at IS NULL AND"
        " (location_class = 'elsewhere' OR (location_class = 'us' AND"
        " COALESCE(remote_type, '') <> 'remote') OR contains(lower(COALESCE(location, '')), 'oakland'))"
        " ORDER BY posting_key LIMIT 40",
        "postings",
    ),
)
def place_listing(spark, sf):
    listed = P.audit_listing(postings(spark, sf), show="rejected", sample="Oakland")
    return listed.select("posting_key", "title", "location")


def _ranked_sql(cap: int, limit: int, excluded: bool) -> str:
    clause = "AND c.verdict <> 'excluded'" if excluded else ""
    return oracle(
        "SELECT posting_key, company_key, total_score FROM ranked WHERE rk <= "
        f"{cap} ORDER BY total_score DESC, posting_key DESC LIMIT {limit}",
        "postings", "scores", "companies",
        ranked=(
            "SELECT p.posting_key, p.company_key, s.total_score, row_number() OVER (PARTITION BY"
            " p.company_key ORDER BY s.total_score DESC, p.posting_key DESC) AS rk FROM scores s"
            " JOIN postings p USING (posting_key) JOIN companies c USING (company_key)"
            " WHERE s.judged_at IS NULL AND NOT p.filtered_out AND p.closed_at IS NULL " + clause
        ),
    )


@query("top_unjudged", _ranked_sql(3, 50, False))
def top_unjudged(spark, sf):
    return S.top_unjudged(postings(spark, sf), scores(spark, sf))


@query("judge_candidates", _ranked_sql(3, 50, True))
def judge_candidates(spark, sf):
    return S.top_unjudged(postings(spark, sf), scores(spark, sf), companies(spark, sf))


@query("best_per_company", oracle(
    "SELECT posting_key, company_key, total_score FROM ranked WHERE rk = 1"
    " ORDER BY total_score DESC, posting_key DESC LIMIT 10",
    "postings", "scores",
    ranked=(
        "SELECT p.posting_key, p.company_key, s.total_score, row_number() OVER (PARTITION BY"
        " p.company_key ORDER BY s.total_score DESC, p.posting_key DESC) AS rk FROM scores s"
        " JOIN postings p USING (posting_key) WHERE NOT p.filtered_out AND p.closed_at IS NULL"
    ),
))
def best_per_company(spark, sf):
    live = postings(spark, sf).where(P.is_live()).select("posting_key", "company_key")
    scored = live.join(scores(spark, sf).select("posting_key", "total_score"), "posting_key")
    return R.best_per_company(scored)


@query("judge_input_export", oracle(
    "SELECT k.posting_key, k.total_score, 0 AS chunk_no, 'Title: ' || p.title || chr(10) || 'Company: ' || c.name"
    " || chr(10) || 'Location: ' || COALESCE(p.location, 'unspecified') || ' (' ||"
    " COALESCE(p.remote_type, 'onsite') || ')' || chr(10) || chr(10) || 'Description:' || chr(10)"
    " || p.description AS text FROM chosen k JOIN postings p USING (posting_key)"
    " JOIN companies c ON c.company_key = p.company_key",
    "postings", "companies", chosen=_ranked_sql(3, 50, True),
))
def judge_input_export(spark, sf):
    ps, cs = postings(spark, sf), companies(spark, sf)
    return S.judge_export(S.top_unjudged(ps, scores(spark, sf), cs), ps, cs)


@query("queue_facets", oracle(
    "SELECT 'total' AS facet, NULL AS value, CAST(count(*) AS BIGINT) AS n,"
    " CAST(count(judged_at) AS BIGINT) AS judged FROM base"
    " UNION ALL SELECT 'company', name, count(*), count(judged_at) FROM base GROUP BY name"
    " UNION ALL SELECT 'remote_type', remote_type, count(*), count(judged_at) FROM base"
    " GROUP BY remote_type"
    " UNION ALL SELECT 'location_class', location_class, count(*), count(judged_at) FROM base"
    " GROUP BY location_class",
    "postings", "scores", "companies", "applications",
    base=(
        "SELECT c.name, p.remote_type, p.location_class, s.judged_at FROM scores s JOIN postings p"
        " USING (posting_key) JOIN companies c ON c.company_key = p.company_key LEFT JOIN"
        " applications a ON a.posting_key = p.posting_key WHERE NOT p.filtered_out AND"
        " p.closed_at IS NULL AND c.verdict <> 'excluded' AND (a.status IS NULL OR"
        " a.status = 'queued')"
    ),
))
def queue_facets(spark, sf):
    return Q.queue_facets(
        postings(spark, sf), companies(spark, sf), scores(spark, sf), applications(spark, sf)
    )
