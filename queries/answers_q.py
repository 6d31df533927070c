"""Form questions, answers, profile values and application platforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import forms as M
from postmill.functions import text as T
from postmill.operators import answers as A
from queries.binding import LINKS, bound, cases, oracle, postings, stamp, stamp_sql, table
from queries.registry import query

ASKED = [
    "What is your legal name?", "Is your work authorization open-ended, or will a visa follow?",
    "When could you start?", "Notice period", "Expected salary", "Link to your LinkedIn",
    "How did you find out about us?", "Years of relevant experience", "Do you need a visa?",
    "Username", "Rename this", "Ethnicity", "Current city", "E-mail", None, "Anything else?",
]
KEY_OF = [
    "full_name", "work_authorization", "start_date", "start_date", "salary_expectation", "linkedin",
    "referral", "years_experience", "sponsorship", None, None, "race", "location", "email", None, None,
]
QUESTION_TEXT = "text || ' ' || COALESCE(" + cases("CAST((conv_id + turn) % 16 AS INT)", ASKED) + ", '')"


def _edges(pattern: str) -> str:
    """Word edges that know letters outside ASCII, for a dialect without look-around."""
    body = pattern
    if body.startswith(r"\b"):
        body = r"(?:^|[^\p{L}\p{N}_])" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return body.replace(r"\b", r"(?:[^\p{L}\p{N}_]|^|$)").replace("'", "''")


MATCH = "CASE " + " ".join(
    "WHEN regexp_matches(q, '(?i)" + "|".join(f"(?:{_edges(p)})" for p in x.patterns) + f"') THEN '{x.key}'"
    for x in M.QUESTIONS
).replace(r"start(?:", r"start(?:") + " END"
USER = f"SELECT conv_id, turn, {QUESTION_TEXT} AS q FROM conversations WHERE role = 'user'"


def _user(spark, sf):
    said = table(spark, sf, "conversations").where("role = 'user'")
    return said.selectExpr("conv_id", "turn", f"{QUESTION_TEXT} AS q")


@query("question_match", "SELECT conv_id, turn, k AS question_key FROM (SELECT *, CASE"
       " CAST((conv_id + turn) % 16 AS INT) "
       + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KEY_OF) if k)
       + f" END AS k FROM ({USER}))")
def question_match(spark, sf):
    return _user(spark, sf).select("conv_id", "turn", M.match_question(F.col("q")).alias("question_key"))


@query("question_match_prose", f"SELECT doc_id, {MATCH} AS question_key FROM (SELECT doc_id, text || ' - '"
       " || source || ' how soon' AS q FROM documents)")
def question_match_prose(spark, sf):
    said = table(spark, sf, "documents").selectExpr(
        "doc_id", "text || ' - ' || source || ' how soon' AS q"
    )
    return said.select("doc_id", M.match_question(F.col("q")).alias("question_key"))


SIGHTED = {
    "question": "'Question ' || CAST(user_id AS STRING) || ' '",
    "question_key": "CASE WHEN user_id % 4 = 0 THEN 'key' || CAST(user_id % 8 AS STRING) END",
    "seen_at": "ts",
}
BANK = {
    "question": "'Question ' || CAST(p_partkey * 5 AS STRING)",
    "question_key": "CASE WHEN p_partkey % 40 = 1 THEN 'key4' END",
}


@query("question_gaps", "WITH s AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SIGHTED.items())
       + " FROM events), b AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in BANK.items())
       + " FROM part) SELECT trim(question) AS question, max(question_key) AS"
       " question_key, count(*) AS seen_count, strftime(min(seen_at), '%Y-%m-%d %H:%M:%S') AS first_seen,"
       " strftime(max(seen_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM s WHERE trim(question) NOT IN"
       " (SELECT question FROM b) AND COALESCE(question_key, '') NOT IN (SELECT question_key FROM b WHERE"
       " question_key IS NOT NULL) GROUP BY 1")
def question_gaps(spark, sf):
    sighted = bound(table(spark, sf, "events"), SIGHTED)
    bank = bound(table(spark, sf, "part"), BANK)
    gaps = A.question_gaps(sighted, bank)
    return gaps.select("question", "question_key", "seen_count", stamp("first_seen"), stamp("last_seen"))


# Profiles are customers; what each of them lacks follows from the key.
PROFILE = {
    "profile_id": "c_custkey",
    "name": "c_name",
    "email": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'c' || CAST(c_custkey AS STRING) || '@example.org' END",
    "phone": "CAST(NULL AS STRING)",
    "city": "CASE WHEN c_custkey % 2 = 0 THEN 'Oakland' END",
    "state": "'CA'",
    "work_authorization": "CASE WHEN c_custkey % 4 = 0 THEN 'citizen' END",
    "linkedin": "'in/' || CAST(c_custkey AS STRING)",
    "github": "''",
    "website": "CAST(NULL AS STRING)",
    "first_role": "CASE WHEN c_custkey % 5 <> 0 THEN CAST(1990 + c_custkey % 30 AS STRING) || CASE WHEN"
    " c_custkey % 2 = 0 THEN '-06' ELSE '' END ELSE 'unknown' END",
}
TODAY = "DATE '2024-03-06'"


def _profiles(spark, sf):
    people = bound(table(spark, sf, "customer"), PROFILE).withColumn(
        "starts", F.array("first_role", F.lit("2023-01"))
    )
    return people.withColumn(
        "values", M.profile_variables(F.expr(TODAY), 125_000, "San Leandro", "California")
    )


START = (
    "CASE WHEN profile_id % 5 = 0 THEN DATE '2023-01-01' ELSE make_date(CAST(1990 + profile_id % 30 AS"
    " BIGINT), CASE WHEN profile_id % 2 = 0 THEN 6 ELSE 1 END, 1) END"
)
YEARS = f"CAST(greatest(1, round_even(datediff('day', {START}, {TODAY}) / 365.25, 0)) AS INT)"
PEOPLE = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PROFILE.items()) + " FROM customer"


@query("profile_variables", f"SELECT profile_id, name AS full_name, COALESCE(city, 'San Leandro') AS city,"
       f" CAST({YEARS} AS VARCHAR) AS years_experience, '$150,000' AS salary_target, 'March 6, 2024' AS today,"
       f" 'Monday, March 25, 2024' AS start_date, '' AS phone FROM ({PEOPLE})")
def profile_variables(spark, sf):
    names = ["full_name", "city", "years_experience", "salary_target", "today", "start_date", "phone"]
    return _profiles(spark, sf).select("profile_id", *[F.col("values")[n].alias(n) for n in names])


STORED = {
    "profile_id": "c_custkey",
    "question": "CASE WHEN c_custkey % 2 = 0 THEN 'When?' ELSE 'Favourite colour?' END",
    "answer": "CASE WHEN c_custkey % 6 = 0 THEN 'From {{ start_date }} on' WHEN c_custkey % 6 = 1 THEN"
    " 'Blue' WHEN c_custkey % 6 = 2 THEN 'Ring {{phone}}' ELSE 'Ask me' END",
    "category": "CASE WHEN c_custkey % 3 = 0 THEN 'logistics' END",
    "question_key": "CASE WHEN c_custkey % 2 = 0 THEN 'start_date' END",
}


def _resolved(spark, sf):
    bank = bound(table(spark, sf, "customer"), STORED)
    return A.resolve_answers(_profiles(spark, sf).select("profile_id", "values"), bank)


OWN = (
    "CASE WHEN profile_id % 6 = 0 THEN 'From Monday, March 25, 2024 on' WHEN profile_id % 6 = 1 THEN 'Blue'"
    " WHEN profile_id % 6 = 2 THEN 'Ring {{phone}}' ELSE 'Ask me' END"
)
DERIVED = {
    "full_name": "name",
    "email": "email",
    "location": "COALESCE(city, 'San Leandro') || ', ' || state",
    "work_authorization": "CASE WHEN work_authorization IS NOT NULL THEN 'Permitted to work: citizen.' ELSE '' END",
    "sponsorship": "'None needed.'",
    "clearance": "CASE WHEN work_authorization IS NOT NULL THEN 'Can be cleared"
    " (citizen).' ELSE '' END",
    "start_date": "'From Monday, March 25, 2024 on.'",
    "salary_expectation": "'About $150,000 a year.'",
    "years_experience": f"CAST({YEARS} AS VARCHAR) || ' in total.'",
    "linkedin": "linkedin",
}
RESOLVED = " UNION ALL ".join(
    f"SELECT profile_id, '{q.key}' AS key, '{q.category}' AS category, "
    + (
        f"CASE WHEN profile_id % 2 = 0 THEN {OWN} ELSE {DERIVED[q.key]} END AS answer, CASE WHEN"
        " profile_id % 2 = 0 THEN 'bank' ELSE 'profile' END AS source"
        if q.key == "start_date"
        else f"{DERIVED.get(q.key, chr(39) * 2)} AS answer, CASE WHEN {DERIVED.get(q.key, chr(39) * 2)} <> ''"
        " THEN 'profile' ELSE 'missing' END AS source"
    )
    + " FROM p"
    for q in M.QUESTIONS
) + (
    " UNION ALL SELECT profile_id, 'Favourite colour?', CASE WHEN profile_id % 3 = 0 THEN 'logistics' ELSE"
    f" 'your answers' END, {OWN}, 'bank' FROM p WHERE profile_id % 2 = 1"
)


@query("answer_precedence", f"WITH p AS ({PEOPLE}) {RESOLVED}")
def answer_precedence(spark, sf):
    return _resolved(spark, sf).select("profile_id", "key", "category", "answer", "source")


@query("answers_by_category", f"WITH p AS ({PEOPLE}) SELECT category, count(*) AS questions, count(*) FILTER"
       f" (WHERE source = 'missing') AS missing FROM ({RESOLVED}) GROUP BY 1")
def answers_by_category(spark, sf):
    return A.by_category(_resolved(spark, sf))


EDITS = {
    "question": "' Question ' || CAST(user_id % 50 AS STRING)",
    "answer": "CASE WHEN event_id % 9 = 0 THEN '  ' ELSE 'Answer ' || CAST(event_id AS STRING) END",
    "category": "CASE WHEN event_type = 'click' THEN 'links' ELSE '' END",
    "question_key": "CASE WHEN user_id % 50 < 20 THEN 'key' || CAST(user_id % 50 % 10 AS STRING) ELSE '' END",
    "updated_at": "ts",
    "edit_id": "event_id",
}


@query("answer_fold", "WITH e AS (SELECT trim(question) AS question, trim(answer) AS answer,"
       " nullif(trim(category), '') AS category, nullif(trim(question_key), '') AS question_key, updated_at,"
       " edit_id FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in EDITS.items())
       + " FROM events)) SELECT question, answer, category, question_key FROM (SELECT *, row_number() OVER"
       " (PARTITION BY COALESCE(question_key, question) ORDER BY updated_at DESC, edit_id DESC) AS rk FROM e"
       " WHERE answer <> '' AND question <> '') WHERE rk = 1")
def answer_fold(spark, sf):
    folded = A.fold_answers(bound(table(spark, sf, "events"), EDITS))
    return A.answer_listing(folded).select("question", "answer", "category", "question_key")


EXPECTED = [
    "greenhouse", "lever", "ashby", "workday", "unknown", "unknown", "taleo", "rippling", "unknown",
]
PREFILL = {key: prefill for key, prefill, _ in M.PLATFORMS}


@query("platform_of_url", oracle(
    "SELECT posting_key, apply_url, CASE CAST(posting_key % 9 AS INT) "
    + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(EXPECTED))
    + " END AS platform, CASE CAST(posting_key % 9 AS INT) "
    + " ".join(f"WHEN {i} THEN '{PREFILL.get(k, 'manual')}'" for i, k in enumerate(EXPECTED))
    + " END AS prefill FROM postings", "postings",
))
def platform_of_url(spark, sf):
    assert len(LINKS) == len(EXPECTED)
    return postings(spark, sf).withColumn("p", M.platform_of(F.col("apply_url"))).select(
        "posting_key", "apply_url", "p.platform", "p.prefill"
    )


@query("page_hosts", "SELECT host, 'unknown' AS platform, count(*) AS n FROM (SELECT"
       " regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM"
       " pages) GROUP BY 1")
def page_hosts(spark, sf):
    links = table(spark, sf, "pages").select(
        M.link_host(F.col("url")).alias("host"), M.platform_of(F.col("url"))["platform"].alias("platform")
    )
    return links.groupBy("host", "platform").agg(F.count("*").alias("n"))


@query("start_monday", "SELECT event_id, strftime(CAST(d + CAST((8 - isodow(d)) % 7 AS INT) AS DATE),"
       " '%Y-%m-%d') AS start_date FROM (SELECT event_id, CAST(ts AS DATE) + 14 AS d FROM events)")
def start_monday(spark, sf):
    day = M.start_date(F.to_date("ts"))
    return table(spark, sf, "events").select(
        "event_id", F.date_format(day, "yyyy-MM-dd").alias("start_date")
    )


@query("resume_text", "SELECT conv_id, turn, array_to_string(list_filter([role || ': ' || 'a, b',"
       " trim(role || ' ' || CAST(turn AS VARCHAR)), text], lambda x: x <> ''),"
       " chr(10)) AS text FROM conversations")
def resume_text(spark, sf):
    turns = table(spark, sf, "conversations")
    resume = F.struct(
        F.lit("").alias("summary"),
        F.array(F.struct(F.col("role").alias("grp"), F.array(F.lit("a"), F.lit("b")).alias("items"))).alias("skills"),
        F.array(
            F.struct(
                F.col("role").alias("title"), F.col("turn").cast("string").alias("company"),
                F.array("text").alias("bullets"),
            )
        ).alias("experience"),
        F.lit(None).cast("array<struct<degree:string,school:string>>").alias("education"),
    )
    return turns.select("conv_id", "turn", T.resume_text(resume).alias("text"))
