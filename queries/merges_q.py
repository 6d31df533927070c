"""Merges: a stored state, a batch, and what the state becomes. Events and orders are cut in two
halves that play the stored rows and the arriving batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import rules as U
from postmill.operators import merges as G
from postmill.operators import reports as R
from postmill.operators import scoring as O
from postmill.operators import screen as C
from postmill.operators.common import unique_join
from postmill.session import scratch, stage
from postmill.sources.tables import StoredTable
from queries.binding import (
    AS_OF,
    COMPANIES,
    STATUS_EVENTS,
    bound,
    companies,
    events_as,
    oracle,
    postings,
    scores,
    stamp,
    stamp_sql,
    table,
)
from queries.registry import query
from queries.text_q import JUDGED, TEXTED, _texted

# Sightings: several lines are sightings of one part's posting, under one source id for each
# posting or none. How ids that collide are settled is what ``upsert_collisions`` shows.
SIGHTINGS = {
    "posting_key": "'fp' || CAST(l_partkey AS STRING)",
    "company_key": "'co' || CAST(l_partkey % 7 AS STRING)",
    "source": "CASE WHEN l_suppkey % 3 = 0 THEN 'lever' ELSE 'ashby' END",
    "source_job_id": "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 'fp' || CAST(l_partkey AS STRING) END",
    "title": "'Line ' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
    "salary_source": "'none'",
    "filtered_out": "l_linenumber = 2",
    "filter_reason": "CASE WHEN l_linenumber = 2 THEN 'title_not_target' END",
    "location_class": "'unknown'",
    "seen_at": "l_shipdate",
    "seq": "(l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey % 1000",
}
EVERY = "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in SIGHTINGS.items()) + " FROM lineitem"
# One source id per (source, fingerprint): latest content, first and last sighting. Null ids too.
STATE = (
    "SELECT posting_key, source, title, filter_reason, first_seen_at, last_seen_at FROM (SELECT *,"
    " min(seen_at) OVER w AS first_seen_at, max(seen_at) OVER w AS last_seen_at, row_number() OVER"
    " (PARTITION BY posting_key ORDER BY seq DESC) AS rk FROM every WINDOW w AS (PARTITION BY"
    " posting_key)) WHERE rk = 1"
)


def _sightings(spark, sf):
    return bound(table(spark, sf, "lineitem"), SIGHTINGS)


def _twice(spark, sf):
    """Two batches after each other, the second one delivered twice."""
    every = _sightings(spark, sf)
    first, second = every.where("seq % 20000 < 10000"), every.where("seq % 20000 >= 10000")
    empty = every.where(F.lit(False))
    start = G.merge_postings(empty, first).drop("change")
    return start, second


@query("upsert_batch", oracle(
    f"SELECT posting_key, source, title, filter_reason, {stamp_sql('first_seen_at')},"
    f" {stamp_sql('last_seen_at')}, 'new' AS change FROM s", every=EVERY, s=STATE,
))
def upsert_batch(spark, sf):
    every = _sightings(spark, sf)
    merged = G.merge_postings(every.where(F.lit(False)), every)
    return merged.select(
        "posting_key", "source", "title", "filter_reason", stamp("first_seen_at"),
        stamp("last_seen_at"), "change",
    )


HALVES = (
    "SELECT *, seq % 20000 >= 10000 AS late FROM every"
)
CONVERGED = (
    "SELECT posting_key, title, first_seen_at, last_seen_at FROM (SELECT *, min(seen_at) OVER w AS"
    " first_seen_at, max(seen_at) OVER w AS last_seen_at, row_number() OVER (PARTITION BY posting_key"
    " ORDER BY late DESC, seq DESC) AS rk FROM h WINDOW w AS (PARTITION BY posting_key)) WHERE rk = 1"
)


@query("upsert_converges", oracle(
    f"SELECT posting_key, title, {stamp_sql('first_seen_at')}, {stamp_sql('last_seen_at')} FROM s",
    every=EVERY, h=HALVES, s=CONVERGED,
))
def upsert_converges(spark, sf):
    """The second batch merged twice over gives what merging it once gives."""
    start, second = _twice(spark, sf)
    once = G.merge_postings(start, second).drop("change")
    again = G.merge_postings(once, second)
    return again.select("posting_key", "title", stamp("first_seen_at"), stamp("last_seen_at"))


# Collisions of the two unique keys, by place in a block of seven orders. Stored are places 1, 2, 3, 4 and 7, each under
# its own id. In the batch, place 1 comes as an edited posting under the stored id, 2 and 7 come again, 3
# comes under the id of place 4 (which is stored if the block has that order, else free), 5 is new and 6 is
# new without an id. Place 4 is not sighted.
PLACES = "(SELECT *, (o_orderkey - o_orderkey % 7) / 7 AS block, o_orderkey % 7 + 1 AS place FROM orders)"
LINE = "CAST(CAST(block AS BIGINT) AS STRING) || '-' || CAST(place AS STRING)"
BEFORE = {
    "posting_key": f"'fp-' || {LINE}", "source": "'lever'", "source_job_id": LINE, "title": "'old'",
    "salary_source": "'none'", "filtered_out": "FALSE", "location_class": "'us'",
    "first_seen_at": "o_orderdate", "last_seen_at": "o_orderdate",
}
AFTER = {
    "posting_key": f"CASE WHEN place IN (2, 3, 7) THEN 'fp-' ELSE 'new-' END || {LINE}", "source": "'lever'",
    "source_job_id": f"CASE WHEN place = 3 THEN CAST(CAST(block AS BIGINT) AS STRING) || '-4' WHEN place <> 6 THEN {LINE} END",
    "title": "'fresh'", "salary_source": "'none'", "filtered_out": "place = 3",
    "filter_reason": "CASE WHEN place = 3 THEN 'management_role' END", "location_class": "'local'",
    "seen_at": "o_orderdate + INTERVAL '10' DAY", "seq": "o_orderkey",
}
BOTH_SEEN = "o_orderdate AS first_seen_at, o_orderdate + INTERVAL '10' DAY AS last_seen_at"


@query("upsert_collisions", f"""
WITH l AS (SELECT *, {LINE} AS line, block IN (SELECT block FROM {PLACES} WHERE place = 4) AS four
  FROM {PLACES}),
out AS (
  SELECT 'new-' || line AS posting_key, line AS id, 'fresh' AS title, NULL AS filter_reason, 'local' AS location_class,
    'new' AS change, {BOTH_SEEN} FROM l WHERE place = 1
  UNION ALL SELECT 'fp-' || line, line, 'fresh', NULL, 'local', 'seen', {BOTH_SEEN} FROM l WHERE place IN (2, 7)
  UNION ALL SELECT 'fp-' || line, CASE WHEN four THEN line ELSE block::BIGINT::VARCHAR || '-4' END,
    CASE WHEN four THEN 'old' ELSE 'fresh' END, 'management_role', 'local', CASE WHEN four THEN 'touched' ELSE 'seen' END,
    {BOTH_SEEN} FROM l WHERE place = 3
  UNION ALL SELECT 'fp-' || line, line, 'old', NULL, 'us', 'kept', o_orderdate, o_orderdate FROM l WHERE place = 4
  UNION ALL SELECT 'new-' || line, CASE WHEN place = 5 THEN line END, 'fresh', NULL, 'local', 'new',
    o_orderdate + INTERVAL '10' DAY, o_orderdate + INTERVAL '10' DAY FROM l WHERE place IN (5, 6))
SELECT posting_key, id, title, filter_reason, location_class, change, {stamp_sql('first_seen_at')}, {stamp_sql('last_seen_at')} FROM out
""")
def upsert_collisions(spark, sf):
    """Edited, repeated, moved and new postings against stored ones, a posting for every order."""
    lines = table(spark, sf, "orders").selectExpr("*", "(o_orderkey - o_orderkey % 7) / 7 AS block", "o_orderkey % 7 + 1 AS place")
    stored = bound(lines.where("place IN (1, 2, 3, 4, 7)"), BEFORE)
    batch = bound(lines.where("place <> 4"), AFTER)
    return G.merge_postings(stored, batch).select(
        "posting_key", F.col("source_job_id").alias("id"), "title", "filter_reason", "location_class", "change",
        stamp("first_seen_at"), stamp("last_seen_at"),
    )


@query("run_counters", oracle(
    "SELECT (SELECT count(*) FROM h WHERE late) AS jobs_seen, (SELECT count(*) FROM h WHERE late AND"
    " filtered_out) AS jobs_filtered, (SELECT count(DISTINCT posting_key) FROM h WHERE posting_key NOT IN"
    " (SELECT posting_key FROM h WHERE NOT late)) AS jobs_new", every=EVERY, h=HALVES,
))
def run_counters(spark, sf):
    start, second = _twice(spark, sf)
    return G.run_counters(G.merge_postings(start, second), second)


SEEN = {
    "company_key": "'co' || CAST(o_custkey AS STRING)",
    "name": "'Company ' || CAST(o_orderkey AS STRING)",
    "ats_type": "CASE WHEN o_orderstatus = 'F' THEN 'lever' WHEN o_orderkey % 50 = 0 THEN 'ashby' END",
    "board_token": "CASE WHEN o_orderstatus = 'F' THEN 'b' || CAST(o_orderkey AS STRING) END",
    "seq": "o_orderkey",
}
STORED = {
    **COMPANIES,
    "company_key": "CASE WHEN c_custkey % 2 = 0 THEN 'co' ELSE 'old' END || CAST(c_custkey AS STRING)",
}


@query("company_merge", "WITH c AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in STORED.items())
       + " FROM customer), n AS (SELECT company_key, arg_max(name, seq) AS name,"
       " arg_min(ats_type, seq) FILTER (WHERE ats_type IS NOT NULL) AS ats_type, arg_min(board_token, seq)"
       " FILTER (WHERE board_token IS NOT NULL) AS board_token FROM (SELECT "
       + ", ".join(f'{e} AS "{n}"' for n, e in SEEN.items())
       + " FROM orders) GROUP BY 1) SELECT COALESCE(c.company_key, n.company_key) AS company_key,"
       " COALESCE(n.name, c.name) AS name, COALESCE(c.ats_type, n.ats_type) AS ats_type,"
       " COALESCE(c.board_token, n.board_token) AS board_token, COALESCE(c.verdict, 'unknown') AS verdict,"
       " c.verdict_source FROM c FULL JOIN n ON c.company_key = n.company_key")
def company_merge(spark, sf):
    stored = bound(table(spark, sf, "customer"), STORED)
    seen = bound(table(spark, sf, "orders"), SEEN)
    return G.merge_companies(stored, seen).select(
        "company_key", "name", "ats_type", "board_token", "verdict", "verdict_source"
    )


@query("score_merge", oracle(
    "SELECT COALESCE(o.posting_key, n.posting_key) AS posting_key, COALESCE(n.total_score, o.total_score)"
    " AS total_score, COALESCE(n.rule_score, o.rule_score) AS rule_score, COALESCE(n.relevance_verdict,"
    " o.relevance_verdict) AS relevance_verdict, COALESCE(n.model, o.model) AS model FROM scores o FULL JOIN"
    " n ON n.posting_key = o.posting_key", "scores",
    n="SELECT o_orderkey AS posting_key, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS total_score,"
    " CAST(o_orderkey % 10 AS DOUBLE) / 10 AS rule_score, CASE WHEN o_orderkey % 6 = 0 THEN 'weak' END AS"
    " relevance_verdict, CASE WHEN o_orderkey % 6 = 0 THEN 'm2' END AS model FROM orders",
))
def score_merge(spark, sf):
    fresh = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS posting_key", "CAST(o_orderkey % 100 AS DOUBLE) / 100 AS total_score",
        "CAST(o_orderkey % 10 AS DOUBLE) / 10 AS rule_score",
        "CASE WHEN o_orderkey % 6 = 0 THEN 'weak' END AS relevance_verdict",
        "CASE WHEN o_orderkey % 6 = 0 THEN 'm2' END AS model",
    )
    return O.merge_scores(scores(spark, sf), fresh).select(
        "posting_key", "total_score", "rule_score", "relevance_verdict", "model"
    )


@query("status_fold", oracle(
    f"SELECT posting_key, status, {stamp_sql('applied_at')}, {stamp_sql('responded_at')},"
    f" {stamp_sql('interview_at')}, {stamp_sql('closed_at')}, {stamp_sql('updated_at')} FROM applications",
    "applications",
))
def status_fold(spark, sf):
    folded = G.fold_status(events_as(spark, sf, STATUS_EVENTS))
    return folded.select(
        "posting_key", "status",
        *[stamp(c) for c in ("applied_at", "responded_at", "interview_at", "closed_at", "updated_at")],
    )


JUDGEMENTS = {
    "posting_key": "doc_id",
    "relevance_verdict": "CASE doc_id % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' WHEN 2 THEN 'Superb' END",
    "relevance_score": "CAST(quality AS DOUBLE) * 3 - CAST(toxic AS DOUBLE) - 0.5",
    "rationale": "'  because ' || CAST(doc_id AS STRING) || ' '",
}


@query("verdict_ingest", "SELECT posting_key, CASE WHEN relevance_verdict IN ('strong', 'possible', 'weak')"
       " THEN relevance_verdict ELSE 'possible' END AS relevance_verdict, least(1, greatest(0,"
       " relevance_score)) AS relevance_score, trim(rationale) AS rationale FROM (SELECT "
       + ", ".join(f"{e} AS {n}" for n, e in JUDGEMENTS.items()) + " FROM labels)")
def verdict_ingest(spark, sf):
    return C.clean_relevance(bound(table(spark, sf, "labels"), JUDGEMENTS))


RULINGS = {
    "company_key": "CAST(user_id AS BIGINT)",
    "verdict": "CASE WHEN event_id % 2 = 0 THEN 'allowed' ELSE 'excluded' END",
    "decided_at": "ts",
}
MODEL = {
    "company_key": "s_suppkey * 2",
    "verdict": "CASE WHEN s_suppkey % 3 = 0 THEN 'sure' WHEN s_suppkey % 3 = 1 THEN 'allowed' ELSE"
    " 'excluded' END",
    "sector": "'model sector'",
    "reason": "'model reason ' || CAST(s_suppkey AS STRING)",
}
LISTED = "contains(name, ' Bank') AND NOT contains(name, 'Blood Bank')"
KEPT = "verdict_source = 'user' OR (verdict_source IS NOT NULL AND verdict <> 'unknown')"


def _pick(user: str, kept: str, listed: str, model: str, other: str) -> str:
    return (
        f"CASE WHEN u.v IS NOT NULL THEN {user} WHEN {KEPT} THEN {kept} WHEN {LISTED} THEN {listed} WHEN"
        f" m.mv IS NOT NULL THEN {model} ELSE {other} END"
    )


@query("verdict_precedence", oracle(
    "SELECT company_key, name, "
    + _pick("u.v", "verdict", "'excluded'", "m.mv", "'unknown'") + " AS verdict, "
    + _pick("sector", "sector", "'interest_finance'", "m.ms", "sector") + " AS sector, "
    + _pick("'Set manually.'", "reason", "'Company name contains ''bank'' (interest_finance).'", "m.mr",
            "reason") + " AS reason, "
    + _pick("'user'", "verdict_source", "'blocklist'", "'llm'", "verdict_source") + " AS verdict_source"
    " FROM companies LEFT JOIN (SELECT user_id AS k, arg_max(CASE WHEN event_id % 2 = 0 THEN 'allowed' ELSE"
    " 'excluded' END, ts) AS v FROM events GROUP BY 1) u ON u.k = company_key LEFT JOIN (SELECT s_suppkey * 2"
    " AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'flagged' WHEN s_suppkey % 3 = 1 THEN 'allowed' ELSE 'excluded'"
    " END AS mv, 'model sector' AS ms, 'model reason ' || CAST(s_suppkey AS VARCHAR) AS mr FROM supplier) m"
    " ON m.k = company_key", "companies",
))
def verdict_precedence(spark, sf):
    screened = C.screen_companies(companies(spark, sf), postings(spark, sf))
    rulings = events_as(spark, sf, RULINGS)
    verdicts = bound(table(spark, sf, "supplier"), MODEL)
    return C.settle_verdicts(screened, rulings, verdicts, AS_OF).select(
        "company_key", "name", "verdict", "sector", "reason", "verdict_source"
    )


def _rejudged(spark, sf):
    return G.rejudge(_texted(spark, sf), U.RuleSet())


CHANGED = (
    "SELECT p.posting_key, p.title, p.company_key, COALESCE(p.filter_reason, 'passes') AS was,"
    " COALESCE(j.filter_reason, 'passes') AS now FROM postings p JOIN j USING (posting_key) WHERE"
    " p.closed_at IS NULL AND (p.filter_reason IS DISTINCT FROM j.filter_reason OR p.location_class IS"
    " DISTINCT FROM j.location_class)"
)


@query("rejudge_diff", oracle(
    "SELECT posting_key, was, now FROM d", "postings", t=TEXTED, j=JUDGED, d=CHANGED,
))
def rejudge_diff(spark, sf):
    return G.rejudge_diff(_rejudged(spark, sf)).select("posting_key", "was", "now")


RAISED = 160_000


@query("rejudge_pay_floor", oracle(
    "SELECT a.posting_key, COALESCE(a.filter_reason, 'passes') AS was, COALESCE(b.filter_reason, 'passes') AS now FROM j a JOIN k b USING (posting_key)"
    " JOIN postings p USING (posting_key) WHERE p.closed_at IS NULL AND a.filter_reason IS DISTINCT FROM b.filter_reason",
    "postings", t=TEXTED, j=JUDGED, k=JUDGED.replace("125000", str(RAISED)),
))
def rejudge_pay_floor(spark, sf):
    """A higher pay floor over stored postings: judged are those that no rule on titles had rejected, by their pay and
    their stored place class."""
    stored = stage(U.apply_rules(_texted(spark, sf)), "judged")
    return G.rejudge_diff(G.rejudge_changed(stored, U.RuleSet(), U.RuleSet(pay_floor=RAISED))).select("posting_key", "was", "now")


@query("commit_recovers", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE 'first' END AS v FROM orders WHERE o_orderkey % 7 <> 0")
def commit_recovers(spark, sf):
    """Orders as a stored table. A third changes in a commit that breaks off before its record, runs again and
    is delivered twice; a seventh is dropped; another writer's rows without a record are there and not read."""
    table_ = StoredTable(spark, scratch(spark, "stored"), {"k": "bigint", "v": "string"}, "k")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("first").alias("v"))
    table_.commit(rows, label="load")
    changed = rows.where("k % 3 = 0").withColumn("v", F.lit("late"))
    changed.selectExpr("k", "'torn' AS v", "false AS _gone", "1L AS _commit").write.parquet(f"{table_.root}/data/torn")
    for _ in range(2):
        table_.commit(changed, label="change")
    table_.commit(rows.limit(0), gone=rows.where("k % 7 = 0"))
    return table_.read()


@query("rejudge_transitions", oracle(
    "SELECT was, now, count(*) AS n, array_to_string((list(c.name || ': ' || left(d.title, 48) ORDER BY"
    " posting_key))[1:4], ' / ') AS examples FROM d JOIN companies c USING (company_key) GROUP BY 1, 2",
    "postings", "companies", t=TEXTED, j=JUDGED, d=CHANGED,
))
def rejudge_transitions(spark, sf):
    names = companies(spark, sf).selectExpr("company_key", "name AS company_name")
    diff = unique_join(G.rejudge_diff(_rejudged(spark, sf)), names, "company_key")
    return R.rejudge_transitions(diff).withColumn("examples", F.array_join("examples", " / "))
