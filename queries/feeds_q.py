"""Feed formats. Payloads are written as JSON text from table rows and read back through each
feed's schema; what every posting must look like is stated from the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.schemas import RAW_POSTING, conform
from postmill.session import stage
from postmill.sources import feeds as D
from postmill.sources import landing as L
from queries.binding import stamp, table
from queries.registry import query

OUT = [
    "source", "source_job_id", "company_name", "title", "location", "description", "apply_url",
    "remote_type_hint", "salary_min", "salary_max", "salary_source",
]


def _payloads(df, spec_name, body):
    """Rows -> JSON text -> payload structs of the feed, with the board token."""
    spec = D.SOURCES[spec_name]
    text = df.selectExpr("token", f"to_json({body}) AS body")
    return text.select("token", F.from_json("body", spec.schema).alias("p")).select("token", "p.*")


def _raw(df, spec_name, body):
    raw = conform(D.SOURCES[spec_name].to_raw(_payloads(df, spec_name, body)), RAW_POSTING)
    return raw.select(*OUT, stamp("posted_at"))


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("token", F.expr("'board' || CAST(o_custkey % 9 AS STRING)"))


TOKEN = "'board' || CAST(o_custkey % 9 AS VARCHAR)"
KEY = "CAST(o_orderkey AS VARCHAR)"
NOON = "strftime(o_orderdate, '%Y-%m-%d') || ' 12:30:00'"


@query("feed_object_with_array", f"SELECT 'greenhouse' AS source, {KEY} AS source_job_id, CASE WHEN"
       f" o_orderkey % 3 = 0 THEN {TOKEN} ELSE 'Acme ' || CAST(o_custkey AS VARCHAR) END AS company_name,"
       f" 'Job ' || {KEY} AS title, CASE WHEN o_orderkey % 4 <> 0 THEN 'Oakland' END AS location,"
       f" 'About <us> & ' || {KEY} AS description, 'https://x.example.com/' || {KEY} AS apply_url, NULL::VARCHAR AS"
       " remote_type_hint, NULL::INT AS salary_min, NULL::INT AS salary_max, 'none' AS salary_source,"
       f" CASE o_orderkey % 3 WHEN 0 THEN {NOON} WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 02:00:00'"
       " END AS posted_at FROM orders")
def feed_object_with_array(spark, sf):
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    body = (
        "named_struct('meta', named_struct('total', 1), 'jobs', array(named_struct('id', o_orderkey,"
        " 'title', 'Job ' || CAST(o_orderkey AS STRING), 'company_name', CASE WHEN o_orderkey % 3 <> 0 THEN"
        " 'Acme ' || CAST(o_custkey AS STRING) WHEN o_orderkey % 2 = 0 THEN '' END, 'absolute_url',"
        " 'https://x.example.com/' || CAST(o_orderkey AS STRING), 'content', '&lt;p class=\"a\"&gt;About"
        " &amp;lt;us&amp;gt;&amp;nbsp; &amp;amp; &lt;b&gt;' || CAST(o_orderkey AS STRING) ||"
        f" '&lt;/b&gt;&lt;/p&gt;', 'first_published', CASE o_orderkey % 3 WHEN 0 THEN {day} ||"
        " 'T12:30:00Z' WHEN 1 THEN 'soon' END, 'updated_at', CASE WHEN o_orderkey % 3 = 1 THEN"
        f" {day} || 'T04:00:00+02:00' END, 'location', CASE WHEN o_orderkey % 4 <> 0 THEN"
        " named_struct('name', 'Oakland') END)))"
    )
    return _raw(_orders(spark, sf), "greenhouse", body)


@query("feed_bare_array", f"SELECT 'lever' AS source, {KEY} AS source_job_id, {TOKEN} AS company_name, 'Job"
       f" ' || {KEY} AS title, 'Oakland' AS location, CASE WHEN o_orderkey % 2 = 0 THEN 'Plain text' ELSE"
       " 'From markup' END || chr(10) || chr(10) || 'Pay $100,000' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10)"
       " || chr(10) || 'The end' ELSE '' END AS description, CASE WHEN o_orderkey % 2 = 0 THEN"
       f" 'https://jobs.lever.co/' || {KEY} ELSE 'https://apply.example.com/' || {KEY} END AS apply_url,"
       " o_orderpriority AS remote_type_hint, NULL::INT AS salary_min, NULL::INT AS salary_max, 'none' AS"
       f" salary_source, CASE WHEN o_orderkey % 5 <> 0 AND o_orderdate >= TIMESTAMP '2001-09-09 01:46:40' -"
       f" INTERVAL 20 YEAR AND epoch_ms(o_orderdate) >= 1000000000000 THEN strftime(o_orderdate, '%Y-%m-%d"
       " %H:%M:%S') WHEN o_orderkey % 5 <> 0 THEN NULL END AS posted_at FROM orders")
def feed_bare_array(spark, sf):
    body = (
        "named_struct('id', CAST(o_orderkey AS STRING), 'text', 'Job ' || CAST(o_orderkey AS STRING),"
        " 'categories', named_struct('location', 'Oakland'), 'descriptionPlain', CASE WHEN o_orderkey % 2 = 0"
        " THEN ' Plain text ' ELSE '' END, 'description', '<i>From</i> markup', 'lists',"
        " array(named_struct('text', 'Pay', 'content', '<li>&#36;100,000</li>'), named_struct('text', ' ',"
        " 'content', '<br>')), 'additionalPlain', CASE WHEN o_orderkey % 3 = 0 THEN 'The end' END,"
        " 'hostedUrl', CASE WHEN o_orderkey % 2 = 0 THEN 'https://jobs.lever.co/' || CAST(o_orderkey AS"
        " STRING) END, 'applyUrl', 'https://apply.example.com/' || CAST(o_orderkey AS STRING), 'createdAt',"
        " CASE WHEN o_orderkey % 5 <> 0 THEN unix_millis(CAST(o_orderdate AS TIMESTAMP)) ELSE"
        " unix_seconds(CAST(o_orderdate AS TIMESTAMP)) END, 'workplaceType', o_orderpriority)"
    )
    return _raw(_orders(spark, sf), "lever", body)


AMOUNT = "CAST(floor(o_totalprice) AS INT)"


@query("feed_structured_pay", f"SELECT *, CASE WHEN salary_min IS NULL THEN 'none' ELSE 'structured' END AS"
       f" salary_source FROM (SELECT 'ashby' AS source, {KEY} AS source_job_id, {TOKEN} AS company_name,"
       f" 'Job ' || {KEY} AS title, 'Oakland' AS location, 'Plain' AS description,"
       f" 'https://apply.example.com/' || {KEY} AS apply_url, NULL::VARCHAR AS remote_type_hint, CASE o_orderkey % 6"
       f" WHEN 0 THEN {AMOUNT} WHEN 1 THEN {AMOUNT} * 12 WHEN 2 THEN {AMOUNT} * 2 WHEN 3 THEN NULL WHEN 4 THEN"
       f" NULL ELSE {AMOUNT} END AS salary_min, CASE o_orderkey % 6 WHEN 0 THEN {AMOUNT} + 5 WHEN 1 THEN"
       f" ({AMOUNT} + 5) * 12 WHEN 2 THEN {AMOUNT} * 2 WHEN 5 THEN {AMOUNT} + 5 END AS salary_max,"
       f" {NOON} AS posted_at FROM orders WHERE o_orderkey % 7 <> 0)")
def feed_structured_pay(spark, sf):
    part = (
        "named_struct('compensationType', '{kind}', 'interval', {every}, 'currencyCode', {money},"
        " 'minValue', CAST({low} AS DOUBLE), 'maxValue', CAST({high} AS DOUBLE))"
    )
    amount = "floor(o_totalprice)"
    none = "CAST(NULL AS DOUBLE)"
    equity = part.format(kind="EquityPercentage", every="'1 YEAR'", money="''", low=none, high=none)
    every = (
        "CASE o_orderkey % 6 WHEN 0 THEN '1 YEAR' WHEN 1 THEN '1 MONTH' WHEN 2 THEN '' WHEN 3 THEN"
        " '1 DECADE' ELSE '1 YEAR' END"
    )
    money = "CASE o_orderkey % 6 WHEN 4 THEN 'EUR' WHEN 5 THEN CAST(NULL AS STRING) ELSE 'USD' END"
    low = f"CASE WHEN o_orderkey % 6 = 2 THEN NULL ELSE {amount} + 5 END"
    high = f"CASE WHEN o_orderkey % 6 = 2 THEN {amount} * 2 ELSE {amount} END"
    pay = part.format(kind="Salary", every=every, money=money, low=low, high=high)
    body = (
        "named_struct('jobs', array(named_struct('id', CAST(o_orderkey AS STRING), 'title', 'Job ' ||"
        " CAST(o_orderkey AS STRING), 'location', 'Oakland', 'descriptionPlain', CASE WHEN o_orderkey % 2 = 0"
        " THEN 'Plain' END, 'descriptionHtml', '<p>Plain</p>', 'applyUrl', 'https://apply.example.com/' ||"
        " CAST(o_orderkey AS STRING), 'publishedAt', date_format(o_orderdate, 'yyyy-MM-dd') ||"
        " 'T12:30:00.000+00:00', 'isListed', CASE WHEN o_orderkey % 7 = 0 THEN FALSE WHEN o_orderkey % 7 = 1"
        " THEN TRUE END, 'compensation', named_struct('compensationTiers',"
        f" array(named_struct('components', array({equity})), named_struct('components', array({equity},"
        f" {pay})))))))"
    )
    return _raw(_orders(spark, sf), "ashby", body)


@query("feed_aggregator", f"SELECT 'remotive' AS source, {KEY} AS source_job_id, CASE WHEN o_orderkey % 4 = 0"
       f" THEN 'unknown' ELSE 'Acme' END AS company_name, 'Job ' || {KEY} AS title, 'USA' AS location,"
       f" 'Body' AS description, 'https://r.example.com/' || {KEY} AS apply_url, 'remote' AS remote_type_hint,"
       f" NULL::INT AS salary_min, NULL::INT AS salary_max, 'none' AS salary_source, {NOON} AS posted_at FROM"
       " orders")
def feed_aggregator(spark, sf):
    body = (
        "named_struct('jobs', array(named_struct('id', o_orderkey, 'url', 'https://r.example.com/' ||"
        " CAST(o_orderkey AS STRING), 'title', 'Job ' || CAST(o_orderkey AS STRING), 'company_name', CASE WHEN"
        " o_orderkey % 4 <> 0 THEN 'Acme' END, 'description', '<div>Body</div>', 'publication_date',"
        " date_format(o_orderdate, 'yyyy-MM-dd') || 'T12:30:00', 'candidate_required_location', 'USA')))"
    )
    return _raw(_orders(spark, sf), "remotive", body)


# Header lines with the employer, title and place they must give; nulls are dropped.
HEADERS = [
    ("Acme (https://acme.com) | Senior Engineer | Remote (US) | Full-time", "Acme", "Senior Engineer", "Remote (US)"),
    ("*Beta Co* | Onsite SF | Backend Developer | $120k", "Beta Co", "Backend Developer", "Onsite SF"),
    ("Gamma (gamma.example) - | Full time | Data Scientist | Hybrid", "Gamma", "Data Scientist", "Hybrid"),
    ("Just one segment", None, None, None),
    ("Delta | NYC | Remote", None, None, None),
    ("(https://nobody.example) | Engineer | Remote", None, None, None),
    ("Epsilon | Contract | Remote Security Lead | Berlin", "Epsilon", "Remote Security Lead", None),
    ("Zeta &amp; Sons | Founder &#x2F; CTO | remote", "Zeta & Sons", "Founder / CTO", "remote"),
]


def _arms(i):
    def text(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    return " ".join(f"WHEN {n} THEN {text(h[i])}" for n, h in enumerate(HEADERS))


@query("thread_header_parse", "SELECT * FROM (SELECT 'hn_algolia' AS source, CAST(o_orderkey AS VARCHAR) AS"
       f" source_job_id, CASE CAST(o_orderkey % 8 AS INT) {_arms(1)} END AS company_name, CASE"
       f" CAST(o_orderkey % 8 AS INT) {_arms(2)} END AS title, CASE CAST(o_orderkey % 8 AS INT) {_arms(3)} END"
       f" AS location, '{D.ITEM_LINK}' || CAST(o_orderkey AS VARCHAR) AS apply_url FROM orders WHERE"
       " o_orderkey % 3 <> 0) WHERE company_name IS NOT NULL")
def thread_header_parse(spark, sf):
    body = (
        "named_struct('nbPages', 1, 'hits', array(named_struct('objectID', CAST(o_orderkey AS STRING),"
        f" 'comment_text', CASE CAST(o_orderkey % 8 AS INT) {_arms(0)} END || '<p>We build things | Engineer"
        " | remote</p>', 'created_at', date_format(o_orderdate, 'yyyy-MM-dd') || 'T12:30:00Z', 'parent_id',"
        " CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 1 END, 'story_id', 1)))"
    )
    return _raw(_orders(spark, sf), "hn_algolia", body).select(
        "source", "source_job_id", "company_name", "title", "location", "apply_url"
    )


@query("latest_thread", "SELECT CAST(o_orderkey AS VARCHAR) AS story_id FROM orders WHERE o_orderkey % 3 = 0"
       " ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_thread(spark, sf):
    stories = table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS objectID",
        "CASE o_orderkey % 3 WHEN 0 THEN 'Ask: Who is  Hiring? (May)' WHEN 1 THEN 'Who wants to be hired?'"
        " ELSE 'Freelancer? Who is hiring a freelancer' END AS title",
        "date_format(o_orderdate, 'yyyy-MM-dd') || 'T00:00:00Z' AS created_at",
    )
    return D.latest_thread(stories)


@query("source_quality", "SELECT source, token, CAST(n AS BIGINT) AS n, CASE WHEN bad = 1 THEN 'failed' WHEN"
       " n = 0 THEN 'empty' WHEN total <> n THEN 'truncated' ELSE 'ok' END AS status FROM (SELECT 'greenhouse'"
       " AS source, 'b' || CAST(l_partkey % 50 AS VARCHAR) AS token, sum(CASE WHEN l_partkey % 50 = 3 THEN 0"
       " ELSE l_linenumber END) AS n, max(CASE WHEN l_partkey % 50 < 9 THEN 77 END) AS total, max(CASE WHEN"
       " l_partkey % 50 = 7 AND l_linenumber = 1 THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY 2)")
def source_quality(spark, sf):
    boards = table(spark, sf, "lineitem").selectExpr(
        "'greenhouse' AS source", "'b' || CAST(l_partkey % 50 AS STRING) AS token",
        "CASE WHEN l_partkey % 50 = 3 THEN 0 ELSE l_linenumber END AS n",
        "CASE WHEN l_partkey % 50 < 9 THEN 77 END AS meta_total",
        "l_partkey % 50 = 7 AND l_linenumber = 1 AS bad",
    )
    return L.board_status(boards)


SNAPSHOT = {
    "url": "url", "etag": "CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS STRING) END",
    "last_modified": "CAST(NULL AS STRING)", "content_hash": "html", "fetched_at": "page_id",
}


@query("skip_unchanged", "SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages s WHERE"
       " s.page_id % 2 = 0 AND s.url = p.url AND s.html = p.html)")
def skip_unchanged(spark, sf):
    landed = table(spark, sf, "pages").select(
        "page_id", "url", F.sha2("html", 256).alias("content_hash")
    )
    return L.unseen(landed, landed.where("page_id % 2 = 0")).select("page_id", "url")


@query("newest_validators", "SELECT host AS url, arg_max(etag, page_id) FILTER (WHERE etag IS NOT NULL) AS"
       " etag, max(page_id) AS fetched_at FROM (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS"
       " host, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS VARCHAR) END AS etag FROM pages) GROUP BY 1")
def newest_validators(spark, sf):
    pages = table(spark, sf, "pages").selectExpr(*[f"{e} AS {n}" for n, e in SNAPSHOT.items()])
    pages = pages.withColumn("url", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    old, new = pages.where("fetched_at % 2 = 0"), pages.where("fetched_at % 2 = 1")
    return L.newest_validators(old, new).select("url", "etag", "fetched_at")


@query("quarantine", "SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS sound FROM customer")
def quarantine(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS title",
        "CASE WHEN c_custkey % 5 <> 0 THEN 'u' END AS apply_url", "'1' AS source_job_id",
    )
    good, bad = D.split_sound(rows)
    return good.selectExpr("c_custkey", "TRUE AS sound").unionByName(
        bad.selectExpr("c_custkey", "FALSE AS sound")
    )


# -- landed files ------------------------------------------------------------------------------

LANDED_BODY = (
    "to_json(named_struct('jobs', array(named_struct('id', o_orderkey, 'title', 'Engineer ' ||"
    " CAST(o_orderkey % 2000 AS STRING), 'absolute_url', 'https://x.example.com/' || CAST(o_orderkey AS"
    " STRING), 'content', 'Pay $150,000', 'first_published', date_format(o_orderdate, 'yyyy-MM-dd') ||"
    " 'T12:30:00Z', 'location', named_struct('name', 'Oakland, CA')))))"
)


def land_orders(spark, sf) -> str:
    """Orders as payload lines of one feed, in board folders."""
    from postmill.session import scratch

    root = scratch(spark, "landing")
    lines = _orders(spark, sf).selectExpr("token", f"{LANDED_BODY} AS value")
    lines.write.partitionBy("token").text(f"{root}/source=greenhouse")
    return root


# Several orders share board and title, so they are sightings of one posting.
KEYED = (
    f"SELECT sha256({TOKEN} || '|engineer ' || CAST(o_orderkey % 2000 AS VARCHAR) || '|oakland') AS"
    f" posting_key, {TOKEN} AS company_key, o_orderkey, o_orderdate FROM orders"
)


@query("land_nested_json", "SELECT source, source_job_id, company_name, title, location, description,"
       " strftime(d, '%Y-%m-%d') || ' 12:30:00' AS posted_at FROM (SELECT 'greenhouse' AS source,"
       f" {KEY} AS source_job_id, {TOKEN} AS company_name, 'Engineer ' || CAST(o_orderkey % 2000 AS VARCHAR)"
       " AS title, 'Oakland, CA' AS location, 'Pay $150,000' AS description, o_orderdate AS d FROM orders)")
def land_nested_json(spark, sf):
    raw = D.read_raw(spark, land_orders(spark, sf), ["greenhouse"], lines=True)
    return raw.select(
        "source", "source_job_id", "company_name", "title", "location", "description",
        stamp("posted_at"),
    )


# Five feeds, an order in each by turns, a board of five orders, and for every feed a file that is no JSON, a board
# that is empty and a posting without a link. Comments belong to an old thread, the latest one, or a sibling.
FEEDS = ("greenhouse", "lever", "ashby", "remotive", "hn_algolia")
URL = "CASE WHEN o_orderkey % 11 <> 0 THEN 'https://x.example.com/' || CAST(o_orderkey AS STRING) END"
NAME = "'Engineer ' || CAST(o_orderkey AS STRING)"
BODIES = {
    "greenhouse": f"named_struct('meta', named_struct('total', 1 + CAST(o_orderkey % 3 = 0 AS INT)), 'jobs', array(named_struct('id', o_orderkey, 'title', {NAME}, 'absolute_url', {URL})))",
    "lever": f"named_struct('id', CAST(o_orderkey AS STRING), 'text', {NAME}, 'hostedUrl', {URL})",
    "ashby": f"named_struct('jobs', array(named_struct('id', CAST(o_orderkey AS STRING), 'title', {NAME}, 'jobUrl', {URL}, 'applyUrl', {URL})))",
    "remotive": f"named_struct('jobs', array(named_struct('id', o_orderkey, 'title', {NAME}, 'url', {URL}, 'company_name', 'Acme')))",
    "hn_algolia": "named_struct('nbPages', 1, 'hits', array(named_struct('objectID', CAST(o_orderkey AS STRING), 'comment_text',"
    " 'Acme | ' || CASE WHEN o_orderkey % 11 <> 0 THEN 'Engineer ' ELSE 'Potter ' END || CAST(o_orderkey AS STRING) || ' | remote', 'parent_id', 1 + o_orderkey % 3, 'story_id', 1 + o_orderkey % 3)))",
}


def land_feeds(spark, sf) -> str:
    """Orders as payload lines of five feeds in folders of boards, and the list of threads."""
    from postmill.session import scratch

    root = scratch(spark, "feeds")
    orders = _orders(spark, sf)
    stories = "array(named_struct('objectID', '1', 'title', 'Ask: Who is hiring? (May)', 'created_at', '2001-05-01T00:00:00Z'), named_struct('objectID', '2', 'title', 'Ask: Who is hiring? (June)', 'created_at', '2001-06-01T00:00:00Z'), named_struct('objectID', '3', 'title', 'Freelancer? Seeking one?', 'created_at', '2001-07-01T00:00:00Z'))"
    spark.range(1).selectExpr(f"to_json(named_struct('hits', {stories})) AS value").write.text(f"{root}/source=hn_stories/token=all")
    for i, name in enumerate(FEEDS):
        orders.where(F.col("o_orderkey") % 5 == i).selectExpr("token", f"to_json({BODIES[name]}) AS value").write.partitionBy("token").text(f"{root}/source={name}", compression="gzip")
        spark.createDataFrame([("{ not json",)], "value string").write.text(f"{root}/source={name}/token=torn")
        spark.createDataFrame([('{"hits": []}' if name == "hn_algolia" else '{"jobs": []}',)] if name != "lever" else [("",)], "value string").write.text(f"{root}/source={name}/token=vacant")
    return root


FEED = "CASE CAST(o_orderkey % 5 AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FEEDS)) + " END"
LANDED = (
    f"WITH o AS (SELECT *, {FEED} AS source, {TOKEN} AS token FROM orders), f AS (SELECT unnest(['greenhouse', 'lever', 'ashby', 'remotive', 'hn_algolia']) AS source)"
)


@query("land_five_feeds", LANDED + " SELECT CASE WHEN source <> 'hn_algolia' AND o_orderkey % 11 = 0 THEN 'quarantined' ELSE 'posting' END AS kind, source,"
       " CAST(o_orderkey AS VARCHAR) AS id, 'Engineer ' || CAST(o_orderkey AS VARCHAR) AS detail FROM o WHERE source <> 'hn_algolia' OR (o_orderkey % 3 = 1 AND o_orderkey % 11 <> 0)"
       " UNION ALL SELECT 'unreadable', source, 'torn', '{ not json' FROM f")
def land_five_feeds(spark, sf):
    """Every row of five landed feeds and its fate: a posting, a posting without a mandatory field, or a payload
    that could not be read. Of the threads the newest hiring thread counts."""
    landing = land_feeds(spark, sf)
    good, bad = D.split_sound(D.read_raw(spark, landing, lines=True))
    lost = stage(D.unreadable(spark, landing, lines=True), "unreadable")  # Spark reads the text only beside a field
    return (
        good.select(F.lit("posting").alias("kind"), "source", F.col("source_job_id").alias("id"), F.col("title").alias("detail"))
        .unionAll(bad.select(F.lit("quarantined"), "source", "source_job_id", "title"))
        .unionAll(lost.select(F.lit("unreadable"), "source", "token", "payload"))
    )


@query("landed_boards", LANDED + " SELECT source, token, count(*) AS n, CASE WHEN source = 'greenhouse' AND max(1 + CAST(o_orderkey % 3 = 0 AS INT)) <> count(*) THEN"
       " 'truncated' ELSE 'ok' END AS status FROM o GROUP BY 1, 2 UNION ALL SELECT source, 'torn', 0, 'failed' FROM f UNION ALL SELECT source, 'vacant', 0, 'empty' FROM f")
def landed_boards(spark, sf):
    """The state of every board of five landed feeds."""
    return L.landed_status(spark, land_feeds(spark, sf), lines=True)


@query("source_targets", "SELECT CASE c_nationkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS source, 'board' || CAST(c_custkey AS VARCHAR) AS token"
       " FROM customer UNION ALL SELECT 'remotive', NULL UNION ALL SELECT 'hn_algolia', NULL")
def source_targets(spark, sf):
    """Boards of the feeds from a settings table, which lists every customer's, and the feeds without boards."""
    feed = "CASE c_nationkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS source"
    return D.targets(table(spark, sf, "customer").selectExpr(feed, "'board' || CAST(c_custkey AS STRING) AS token"))


@query("stream_ingest", f"SELECT posting_key, company_key, strftime(max(o_orderdate), '%Y-%m-%d') ||"
       f" ' 12:30:00' AS posted_at FROM ({KEYED}) GROUP BY 1, 2")
def stream_ingest(spark, sf):
    """Landed files through the ingest stream into stored postings; a second run finds nothing."""
    from postmill.plans.workspace import Workspace
    from postmill.session import scratch
    from postmill.streaming.jobs import ingest
    from queries.binding import AS_OF

    landing, root = land_orders(spark, sf), scratch(spark, "ingest")
    ws = Workspace(spark, f"{root}/ws")
    for _ in range(2):
        ingest(
            ws, landing, D.SOURCES["greenhouse"], f"{root}/checkpoint", AS_OF, lines=True
        ).awaitTermination()
    return ws.postings.read().select("posting_key", "company_key", stamp("posted_at"))


@query("stream_ingest_feeds", LANDED + " SELECT sha256(company || '|engineer ' || id || '|' || place) AS posting_key, source FROM (SELECT source, CAST(o_orderkey AS VARCHAR)"
       " AS id, CASE WHEN source IN ('remotive', 'hn_algolia') THEN 'acme' ELSE token END AS company, CASE WHEN source = 'hn_algolia' THEN 'remote' ELSE '' END AS place"
       " FROM o WHERE o_orderkey % 11 <> 0 AND (source <> 'hn_algolia' OR o_orderkey % 3 = 1))")
def stream_ingest_feeds(spark, sf):
    """Five feeds as one stream, six files of each a micro-batch, with torn files and an old thread among them."""
    from postmill.plans.workspace import Workspace
    from postmill.session import scratch
    from postmill.streaming.jobs import ingest
    from queries.binding import AS_OF

    landing, root = land_feeds(spark, sf), scratch(spark, "ingest-feeds")
    ws = Workspace(spark, f"{root}/ws")
    ingest(ws, landing, list(D.SOURCES.values()), f"{root}/checkpoint", AS_OF, files_per_trigger=6, lines=True, vacuum=True).awaitTermination()
    return ws.postings.read().select("posting_key", "source")
