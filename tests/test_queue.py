"""Queue parameters and the tables behind the queue."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from postmill.operators import queue as Q
from postmill.operators import quality as K
from postmill.operators import screen as C
from postmill.schemas import POSTING, conform
from postmill.vocab import PlaceVocab, TermLists, overlaps

import pytest

NOW = datetime(2024, 3, 10, tzinfo=timezone.utc)


def test_junk_parameters_give_the_defaults():
    assert Q.QueueFilters.from_text({}) == Q.QueueFilters()
    f = Q.QueueFilters.from_text(
        {"sort": "drop table", "dir": "asc", "min_score": "x", "min_salary": "", "posted_within": "7",
         "remote": ["remote"], "company": "  acme ", "per_company": "0"}
    )
    assert (f.sort, f.descending, f.min_score, f.min_salary) == ("score", False, 0.0, None)
    assert (f.posted_within_days, f.remote_types, f.company, f.per_company_cap) == (7, ("remote",), "acme", 3)
    assert f.is_active and not Q.QueueFilters(sort="salary", descending=False).is_active
    odd = Q.QueueFilters.from_text({"remote": "remote", "location": ["us", "local"], "min_score": "nan", "min_salary": ["1"], "per_company": "-2"})
    assert (odd.remote_types, odd.location_classes) == (("remote",), ("us", "local"))
    assert (odd.min_score, odd.min_salary, odd.per_company_cap) == (0.0, None, 3)
    assert Q.QueueFilters.from_text({"min_score": "inf"}).min_score == 0.0


def tables(spark, n=40):
    rows = spark.range(n)
    postings = conform(
        rows.selectExpr(
            "CAST(id AS STRING) AS posting_key", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS company_key",
            "'t' AS title", "'remote' AS remote_type", "FALSE AS filtered_out",
            "CASE WHEN id % 5 <> 0 THEN CAST(id * 1000 AS INT) END AS salary_max",
            "CASE WHEN id % 7 <> 0 THEN timestamp_seconds(id * 86400) END AS posted_at",
        ),
        POSTING,
    )
    companies = postings.select("company_key").distinct().selectExpr(
        "company_key", "'Name ' || company_key AS name", "'allowed' AS verdict", "'r' AS reason"
    )
    scores = rows.selectExpr(
        "CAST(id AS STRING) AS posting_key", "id / 100.0D AS total_score", "0.5D AS embed_similarity",
        "CAST(NULL AS STRING) AS relevance_verdict", "CAST(NULL AS STRING) AS rationale", "FALSE AS is_stretch",
        "CAST(NULL AS TIMESTAMP) AS judged_at",
    )
    states = rows.where("id IN (38, 39)").selectExpr(
        "CAST(id AS STRING) AS posting_key", "CASE id WHEN 38 THEN 'queued' ELSE 'applied' END AS status"
    )
    return postings, companies, scores, states


def test_cap_counts_filtered_postings_only(spark):
    postings, companies, scores, states = tables(spark)
    top = Q.ranked_queue(postings, companies, scores, states, NOW)
    hot = [r.posting_key for r in top.where("company_name = 'Name hot'").collect()]
    assert hot == ["36", "33", "30"]  # 39 was acted on
    cheap = Q.ranked_queue(
        postings.where("CAST(posting_key AS INT) < 20"), companies, scores, states, NOW, Q.QueueFilters(per_company_cap=2)
    )
    assert [r.posting_key for r in cheap.where("company_name = 'Name hot'").collect()] == ["18", "15"]


@pytest.mark.parametrize("sort", list(Q.SORTS))
@pytest.mark.parametrize("descending", [True, False])
def test_keyset_pages_cover_the_queue(spark, sort, descending):
    f = Q.QueueFilters(sort=sort, descending=descending, per_company_cap=99)
    postings, companies, scores, states = tables(spark)
    queue = Q.ranked_queue(postings, companies, scores, states, NOW, f).cache()
    whole = [r.posting_key for r in queue.collect()]
    pages, rest = [], queue
    while True:
        rows = Q.page(rest, limit=15).collect()
        pages += [r.posting_key for r in rows[:15]]
        if len(rows) <= 15:
            break
        last = rows[14].asDict()
        rest = queue.where(Q.after(f, last)).orderBy(*Q.sort_columns(f))
    assert pages == whole and len(whole) == 39


def test_constraints(spark):
    postings = tables(spark)[0]
    broken = postings.withColumn("filtered_out", F.col("posting_key") == "1")
    found = {r.rule: r.violations for r in K.audit(broken, K.posting_rules()).collect()}
    assert found == {"filtered_has_reason": 1, "key_present": 0, "title_present": 0}
    assert K.require(postings, K.posting_rules()).count() == 40
    with pytest.raises(Exception, match="filtered_has_reason"):
        K.require(broken, K.posting_rules()).count()
    assert K.duplicate_keys(postings, "company_key").collect()[0].company_key == "hot"


def test_default_word_lists_do_not_overlap(spark):
    vocab = PlaceVocab().table(spark)
    pairs = [("bay_area", "us_cities"), ("bay_area", "non_us_countries"), ("bay_area_ambiguous", "us_cities"),
             ("bay_area", "bay_area_ambiguous"), ("us_cities", "non_us_countries"), ("us_states", "non_us_countries")]
    assert overlaps(vocab, pairs).collect() == []


def test_screen_order_and_overrides(spark):
    cases = {
        ("First National Bank", ""): ("interest_finance", "Company name contains 'bank' (interest_finance)."),
        ("City Blood Bank", "an online casino"): None,
        ("Databank Betting", ""): None,
        ("Riverbanks Ltd", "health insurance from the first day"): None,
        ("Royal Casino Bank", ""): ("interest_finance", "Company name contains 'bank' (interest_finance)."),
        ("Acme", "We make WEAPONS MANUFACTURER tools for sports betting"): ("gambling", "Description states 'sports betting' (gambling)."),
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, n string, d string")
    out = df.select("i", C.screen_terms(F.col("n"), F.col("d")).alias("r")).orderBy("i").collect()
    got = [(r.r.sector, r.r.reason) if r.r else None for r in out]
    assert got == list(cases.values())


def test_lists_from_files(spark, tmp_path):
    path = tmp_path / "terms.json"
    path.write_text('{"allowed_overrides": [], "name_terms": {"s": ["x y"]}, "description_terms": {}}')
    lists = TermLists.from_file(str(path))
    df = spark.createDataFrame([("Big X Y Co",)], "n string")
    assert df.select(C.screen_terms(F.col("n"), F.lit(""), lists)["sector"]).first()[0] == "s"
    places = spark.createDataFrame([("non_us_cities", "London"), ("us_cities", "Ames")], "section string, term string")
    vocab = PlaceVocab.from_table(places)
    assert vocab.non_us_cities == ("london",) and vocab.us_cities == ("ames",) and "oakland" in vocab.bay_area
