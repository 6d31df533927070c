"""Column transforms on small tables of cases."""

import html
import random
import re
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill.functions import arrangement as A
from postmill.functions import forms as M
from postmill.functions import keys as K
from postmill.functions import pay as Y
from postmill.functions import places as L
from postmill.functions import rules as U
from postmill.functions import scoring as S
from postmill.functions import text as T
from postmill.vocab import PlaceVocab


def apply(spark, values, expr, kind="string"):
    """Results of a column expression over one-column rows, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = rows.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in out]


HTML = [
    "<p>a&nbsp;&nbsp; b</p>", "&lt;p&gt;x &amp;amp; y&lt;/p&gt;", "&amp;lt;kept&amp;gt;", "", None,
    "no markup\n here\x1f!", "1 < 2 and 3 > 2", "caf&eacute; &#x2F; &#39;q&#39;", "<br/>only<br>",
]


def test_strip_html_equals_two_pass_decoding(spark):
    def want(raw):
        text = re.sub("<[^>]+>", " ", html.unescape(raw or ""))
        return re.sub(r"\s+", " ", html.unescape(text)).strip()

    assert apply(spark, HTML, T.strip_html) == [want(h) for h in HTML]


def test_join_sections_drops_blank_parts(spark):
    got = apply(spark, ["x "], lambda v: T.join_sections(v, F.lit(None), F.lit(" "), F.lit("y")))
    assert got == ["x\n\ny"]


@pytest.mark.parametrize(
    "text,band",
    [
        ("$150,000 - $200,000", (150000, 200000)),
        ("USD 145,000 to 185,000", (145000, 185000)),
        ("between $185,000 and $140,000", (140000, 185000)),
        ("150k–200K USD", (150000, 200000)),
        ("$45 - $60 per hour", (93600, 124800)),
        ("$19 per hour", None),
        ("210000 USD", (210000, 210000)),
        ("€90,000 or $100,000", None),
        ("150,000 customers", None),
        ("$132,000 and 9% of profits", (132000, 132000)),
        ("$5 - $200,000", None),
        ("$130 k base", (130000, 130000)),
        ("$2,000,000", None),
        ("", None),
        (None, None),
    ],
)
def test_pay_from_prose(spark, text, band):
    got = apply(spark, [text], Y.parse_pay)[0]
    assert (tuple(got) if got else None) == band


def test_structured_pay(spark):
    schema = (
        "p boolean, t array<struct<components:array<struct<compensationType:string,"
        "`interval`:string,currencyCode:string,minValue:double,maxValue:double>>>>"
    )
    equity = ("EquityPercentage", "1 YEAR", None, None, None)
    rows = [
        (None, [([equity, ("Salary", "1 HOUR", "USD", 50.0, None)],)]),
        (True, [([("Salary", "1 YEAR", "EUR", 9e4, 1e5)],), ([("Salary", None, "", 2e5, 1e5)],)]),
        (False, [([("Salary", "1 YEAR", "USD", 9e4, 1e5)],)]),
        (True, None),
    ]
    df = spark.createDataFrame(rows, schema).select(Y.structured_pay(F.col("p"), F.col("t")).alias("r"))
    assert [tuple(r.r) if r.r else None for r in df.collect()] == [
        (104000, 104000), (100000, 200000), None, None,
    ]


def test_references_decode_as_in_the_standard_library(spark):
    from html import unescape
    from html.entities import html5

    rng = random.Random(1)
    texts = [f"&{n}" for n in list(html5)[::9]] + [
        "&#0;", "&#x80;", "&#128", "&#129;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#1;", "&#xFFFE;", "&#x1fffe;", "&#13;", "&#11;",
        "&#x;", "&#;", "&unknown;", "&AMP;", "&notit;", "&notin;", "&#x1F600;", "&#0000000000000000065;", "&copycopy", "&#127;", "&#64976;", "&é;", "&" + "x" * 40,
    ]
    pieces = ["&", "#", "x", "amp", "lt", ";", "65", "not", "in", "é", " ", "<b>", "copy", "&#", "&#x41", "\n", "quot;", "&nbsp;"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    assert apply(spark, texts, T.decode_entities) == [unescape(t) for t in texts]


def test_the_table_of_references_stands_once_in_a_clean_up(spark):
    from postmill.schemas import RAW_POSTING, conform
    from postmill.sources import feeds as D

    def tables(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("CounterClockwiseContourIntegral;")

    texts = spark.createDataFrame([(1, "&amp;lt;b&gt; &notit; &copycopy")], "i int, v string")
    assert tables(texts.select(T.strip_html(F.col("v")))) == 1

    def raw(name):
        payloads = spark.createDataFrame([], f"{D.SOURCES[name].schema}, token string")
        return tables(conform(D.SOURCES[name].to_raw(payloads), RAW_POSTING))

    # comments are filtered by their header, which is read again for its fields
    assert {n: raw(n) for n in D.SOURCES} == {"greenhouse": 1, "lever": 1, "ashby": 1, "remotive": 1, "hn_algolia": 3}


def test_keys(spark):
    assert apply(spark, ["Acme, Inc.", "Inc", "The Co Company Group", "Ångström AG"], K.company_key) == [
        "acme", "inc", "the group", "ngstr m",
    ]
    assert apply(
        spark,
        ["Welder (wfh)", "Analyst (R&D/QA)", "B (k l m n hybrid)", "B (y (Hybrid)", "B (remote, some Fridays)"],
        K.title_key,
    ) == ["welder", "analyst r d qa", "b k l m n hybrid", "b", "b"]
    assert apply(
        spark, ["Santa Rosa, NM", "US-NM-Santa Rosa", "LV, NV", "", None, "Ames, IA", "-"], K.city_key
    ) == ["santa rosa", "santa rosa", "nv", "", "", "ames", ""]


def test_fingerprint_ignores_cosmetics_only(spark):
    rows = [
        ("Acme Inc", "Engineer (Remote)", "Oakland, CA"),
        ("ACME", "engineer", "Oakland"),
        ("ACME", "engineer (Search)", "Oakland"),
        ("ACME", "engineer", None),
    ]
    df = spark.createDataFrame(rows, "c string, t string, l string")
    keys = [r.k for r in df.select(K.fingerprint(F.col("c"), F.col("t"), F.col("l")).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3 and all(len(k) == 64 for k in keys)


@pytest.mark.parametrize(
    "title,place,text,hint,want",
    [
        ("Engineer", None, "remote", "On-Site", "onsite"),
        ("Engineer (hybrid)", "Remote", "", None, "hybrid"),
        ("Engineer", "Remote - US", "hybrid", "now and then", "remote"),
        ("Engineer", None, "We are hybrid and remote", None, "hybrid"),
        ("Engineer", None, "This role is not a remote job", None, "onsite"),
        ("Engineer", None, "Remote days are not planned", None, "onsite"),
        ("Engineer", None, "fully remote", "", "remote"),
        ("Engineer", None, "", None, "onsite"),
    ],
)
def test_arrangement(spark, title, place, text, hint, want):
    df = spark.createDataFrame([(title, place, text, hint)], "t string, l string, d string, h string")
    kind = A.arrangement(F.col("t"), F.col("l"), F.col("d"), F.col("h"))
    assert df.select(kind).first()[0] == want


PLACES = {
    "Hayward, CA": "local", "Alameda, Denver": "local", "SJC, Utah": "local",
    "Belmont": "unknown", "Belmont, CA": "local", "Belmont, Norway": "elsewhere", "Victoria, TX": "us",
    "Santa Clara, México, Panama": "local", "Santa Clara, Panama": "elsewhere", "On premises": "unknown", "Cedar Falls, OR": "unknown",
    "Nationwide (Portugal too)": "us_wide", "Nordics": "elsewhere", "U.S.A.": "us_wide", "nv": "us",
    "Fresno, California": "us", "": "unknown", "Boise or Emeryville": "local", "Queens, New York": "us",
    "Austria": "elsewhere", "Globally": "us_wide", "Campus": "unknown",
}


def test_place_class_of_the_field(spark):
    got = apply(spark, list(PLACES), lambda v: L.location_class(v, F.lit(None).cast("string")))
    assert dict(zip(PLACES, got)) == PLACES


def test_place_class_falls_back_to_the_header_without_common_words(spark):
    texts = ["Acme | Austin | join us", "join us at global scale", "x" * 300 + " Oakland", "Oakland | IN"]
    got = apply(spark, texts, lambda v: L.location_class(F.lit("N/A"), v, header_chars=300))
    assert got == ["us", "unknown", "unknown", "local"]
    whole = apply(spark, texts, lambda v: L.location_class(F.lit("N/A"), v))
    assert whole == ["us", "unknown", "local", "local"]


def test_foreign_cities_are_a_parameter(spark):
    vocab = PlaceVocab().with_lists({"non_us_cities": ["London", "Paris"]})
    got = apply(
        spark, ["London", "SF, London", "London, Paris"],
        lambda v: L.location_class(v, F.lit(None).cast("string"), vocab),
    )
    assert got == ["elsewhere", "local", "elsewhere"]


def test_factored_pattern_matches_what_the_plain_alternation_matches():
    vocab = PlaceVocab()
    terms = {*vocab.us_cities, *vocab.non_us_countries, *vocab.us_wide}
    plain = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    plain = re.compile(rf"(?<![a-z0-9])(?:{plain})(?![a-z0-9])")
    factored = re.compile(L.word_pattern(terms))
    words = [*terms, *(t + "x" for t in terms), *(t[:-1] for t in terms), *(f"in {t}, and" for t in terms)]
    for word in words:
        assert bool(plain.search(word)) == bool(factored.search(word)), word


POSTING = dict(
    title="Software Engineer", location="Oakland, CA", description="", remote_type="onsite",
    salary_min=None, salary_max=None, salary_source="none",
)


@pytest.mark.parametrize(
    "change,reason",
    [
        ({}, None),
        ({"title": "Sales Engineer"}, "title_not_target"),
        ({"title": "Engineering Manager"}, "management_role"),
        ({"title": "Rust Engineer, reports to the Director"}, None),
        ({"title": "Staff Software Engineer"}, "seniority_mismatch"),
        ({"title": "Carpenter"}, "title_not_target"),
        ({"salary_max": 120000, "salary_source": "parsed"}, "salary_below_floor"),
        ({"salary_min": 120000, "salary_source": "parsed"}, "salary_below_floor"),
        ({"salary_min": 100000, "salary_max": 125000, "salary_source": "structured"}, None),
        ({"salary_max": 1, "salary_source": "none"}, None),
        ({"location": "Lisbon, Portugal"}, "location_outside_area"),
        ({"location": "Canada", "remote_type": "remote"}, "remote_outside_us"),
        ({"location": "Austin, TX"}, "location_outside_area"),
        ({"location": "Austin, TX", "remote_type": "remote"}, None),
        ({"location": None}, None),
        ({"title": "Sales Manager", "location": "Canada"}, "title_not_target"),
    ],
)
def test_rule_cascade(spark, change, reason):
    row = {**POSTING, **change}
    schema = (
        "title string, location string, description string, remote_type string, salary_min int,"
        " salary_max int, salary_source string"
    )
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)
    out = U.apply_rules(df).first()
    assert out.filter_reason == reason and out.filtered_out == (reason is not None)


def test_freshness_steps(spark):
    now = datetime(2024, 3, 10, tzinfo=timezone.utc)
    days = {datetime(2024, 3, 11): 1.0, datetime(2024, 3, 8): 1.0, datetime(2024, 3, 7): 0.7,
            datetime(2024, 3, 3): 0.7, datetime(2024, 2, 20): 0.4, datetime(2023, 1, 1): 0.15}
    stamps = [d.replace(tzinfo=timezone.utc) for d in days] + [None]
    got = apply(spark, stamps, lambda v: S.freshness_score(v, F.lit(now)), "timestamp")
    assert got == [*days.values(), 0.5]


def test_similarity(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([-4.0, 3.0],)]
    df = spark.createDataFrame(rows, "e array<float>")
    assert [round(r[0], 9) for r in df.select(S.cosine(F.col("e"), [3.0, 4.0])).collect()] == [1, 0, 0]
    with pytest.raises(Exception, match="vector length"):
        df.select(S.cosine(F.col("e"), [1.0])).collect()
    got = apply(spark, [0.5, 0.6, 0.725, 0.9], S.rescale_similarity, "double")
    assert [round(x, 9) for x in got] == [0, 0, 0.5, 1]


def test_questions_in_catalog_order(spark):
    texts = {
        "Are you authorized to work without sponsorship?": "work_authorization",
        "Will you need a visa?": "sponsorship", "Notice period?": "start_date",
        "What is the earliest you can start": "start_date", "username": None, "": None,
        "Personal website": "portfolio", "prénom name": "full_name",
    }
    assert dict(zip(texts, apply(spark, list(texts), M.match_question))) == texts


def test_render_is_all_or_nothing(spark):
    values = F.create_map(F.lit("a"), F.lit("A"), F.lit("b"), F.lit("{{a}}"), F.lit("c"), F.lit(""))
    cases = {"x {{a}} y": "x A y", "{{ a }}{{b}}": "A{{a}}", "{{a}} {{c}}": "", "{{d}}": "", " z ": "z", "": ""}
    assert dict(zip(cases, apply(spark, list(cases), lambda v: M.render(v, values)))) == cases


def test_start_date_is_the_first_monday_from_two_weeks_on(spark):
    days = {date(2024, 3, 4): date(2024, 3, 18), date(2024, 3, 5): date(2024, 3, 25), date(2024, 3, 10): date(2024, 3, 25)}
    assert dict(zip(days, apply(spark, list(days), M.start_date, "date"))) == days


def test_platform_by_host_suffix(spark):
    links = {
        "https://crane.jobs.lever.co/x": "lever", "https://lever.co.imitation.test/": "unknown",
        "https://WWW.AshbyHQ.com/a": "ashby", "https://notlever.co/": "unknown", "not a link": "unknown",
        None: "unknown", "https://wd1.myworkdayjobs.com:443/q?x=1": "workday", "https://localhost/": "unknown",
    }
    assert dict(zip(links, apply(spark, list(links), lambda v: M.platform_of(v)["platform"]))) == links


def test_labels(spark):
    df = spark.createDataFrame(
        [(None, None), (120000, None), (None, 150500), (1000000, 1000000), (99999, 150000)], "a int, b int"
    )
    assert [r[0] for r in df.select(T.money_label(F.col("a"), F.col("b"))).collect()] == [
        "not listed", "$120k+", "up to $150k", "$1,000k", "$99k–$150k",
    ]
    assert apply(spark, [0.5, None, 0.125], T.percent_label, "double") == ["50%", "—", "12%"]


def test_question_literals_are_in_every_match():
    """Each way through a pattern's words holds one of the entry's literals."""
    samples = {
        "full_name": ["name", "legal name"], "email": ["email", "e-mail"], "phone": ["phone", "mobile", "cell"],
        "location": ["current location", "city", "where are you based", "where are you located"],
        "work_authorization": ["authorized to work", "authorization to work", "legally entitled to work",
                               "work authorization", "eligible to work"],
        "sponsorship": ["sponsor", "sponsorship", "visa", "h-1b", "h1b"],
        "clearance": ["security clearance", "clearance", "itar"],
        "start_date": ["when will you start", "start date", "notice period", "how soon", "how much notice"],
        "salary_expectation": ["salary expectation", "pay range", "desired compensation", "expected salary"],
        "years_experience": ["year of experience", "years of software experience"],
        "relocation": ["relocate", "relocation"], "referral": ["how did you hear", "how did you find out", "referral", "referred by", "refered by"],
        "linkedin": ["linkedin"], "github": ["github"], "portfolio": ["portfolio", "personal site", "personal website", "website"],
        "gender": ["gender"], "race": ["race", "ethnicity", "hispanic", "latino"], "veteran_status": ["veteran"],
        "disability_status": ["disability"],
    }
    for q in M.QUESTIONS:
        for text in samples[q.key]:
            assert any(re.search(p, text) for p in q.patterns), (q.key, text)
            assert any(n in text for n in q.needs), (q.key, text)


def test_scores_round_like_exact_arithmetic(spark):
    from postmill.functions.expr import round_half_even

    values = [i / 4e6 + 0.03 for i in range(0, 2000)] + [0.6498945, 0.0, 1.0, 0.5, 0.1234565, 2.5e-7, 5e-7, 1.5e-6]
    assert apply(spark, values, round_half_even, "double") == [round(v, 6) for v in values]


def test_rule_score_equals_plain_arithmetic(spark):
    rows = [(k, m) for k in ("remote", "hybrid", "onsite") for m in range(125000, 150001, 37)]
    df = spark.createDataFrame(rows, "k string, m int")
    score = S.rule_score(F.col("k"), F.lit("Nowhere"), F.lit(None).cast("int"), F.col("m"), F.lit("parsed"))
    fit = {"remote": 1.0, "hybrid": 0.7, "onsite": 0.4}
    for k, m, got in df.select("k", "m", score).collect():
        near = 0.3 if k == "onsite" else 1.0
        pay = min(1.0, max(0.0, (m - 125000) / (150000.0 - 125000)))
        assert got == round(0.45 * fit[k] + 0.20 * near + 0.35 * pay, 6)


def test_passages_of_items_with_several_phrases(spark):
    from postmill.operators.screen import screen_passages

    phrases = [(1, "a red fox jumps over walls today"), (1, "we ship ten large boxes every week"), (2, "cat"), (2, "dogs"), (3, "we ship ten large boxes every week")]
    texts = [(1, "Here a red fox jumps over walls today."), (2, "Here we ship ten large boxes every week."), (3, "and we ship ten large boxes every week"), (4, "a cat"), (5, "two dogs"), (6, "two dogs, a cat"), (7, "none")]
    found = screen_passages(spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(phrases, "item long, phrase string"))
    assert {r["doc"]: r["item"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}


def test_html_text_of_cut_references_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from queries import ORACLES, QUERIES

    rows = [(1, "<b>soap &amp</b> rope"), (2, "x &ampx; &copy &copy; &amp;"), (3, "&#38 &quot &quot; end&am"), (4, "plain"), (5, "&amp")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["html_text"]).fetchall())
    assert sorted(map(tuple, QUERIES["html_text"](spark, str(tmp_path)).collect())) == want
    # the transform itself decodes them, as browsers do
    got = [r[0] for r in spark.createDataFrame(rows, "i long, html string").orderBy("i").select(T.strip_html(F.col("html"))).collect()]
    assert got == ["soap & rope", "x &x; © © &", '& " " end&am', "plain", "&"]
