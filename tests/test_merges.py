"""Merges against a row-by-row simulation, and the properties they must keep."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from postmill.operators import merges as G
from postmill.schemas import POSTING, ddl

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)
SIGHTING = "posting_key string, source string, source_job_id string, title string, filter_reason string, filtered_out boolean, seen_at timestamp, seq bigint"


def state_rows(store):
    return {
        k: (r["source"], r["id"], r["title"], r["reason"], r["first"], r["last"]) for k, r in store.items()
    }


def simulate(store, batch):
    """One sighting after the other."""
    store = {k: dict(r) for k, r in store.items()}
    for fp, source, sid, title, reason, _, at, _ in sorted(batch, key=lambda r: r[7]):
        owner = next((k for k, r in store.items() if sid is not None and (r["source"], r["id"]) == (source, sid)), None)
        mine = store.get(fp)
        content = dict(source=source, id=sid, title=title, reason=reason)
        if mine and owner in (None, fp):
            mine.update(content, last=max(mine["last"], at))
        elif mine:
            mine.update(reason=reason, last=max(mine["last"], at))
        else:
            first = at
            if owner:
                first = min(at, store.pop(owner)["first"])
            store[fp] = dict(content, first=first, last=at)
    return store


def universe(rng, u):
    """Stored postings with one id each, then a batch of repeats, edits, id clashes and news."""
    store, batch, seq = {}, [], 0
    for i in range(3):
        store[f"{u}/fp{i}"] = dict(
            source=f"s{u}", id=f"id{i}" if i else None, title="old", reason=None,
            first=DAY - timedelta(days=9), last=DAY - timedelta(days=5),
        )
    kinds = rng.choices(["repeat", "edit", "clash", "new", "again"], k=rng.randint(1, 4))
    for kind in kinds:
        seq += 1
        i = rng.randint(0, 2)
        reason = rng.choice([None, "title_not_target"])
        at = DAY + timedelta(days=seq)
        row = dict(repeat=(f"fp{i}", f"id{i}" if i else None), edit=(f"edit{i}-{rng.randint(0, 1)}", f"id{i}"),
                   clash=("fp1", "id2"), new=(f"new{seq}", None), again=("new", "idn"))[kind]
        if row[1] == "id0":
            row = (row[0], None)
        batch.append((f"{u}/{row[0]}", f"s{u}", row[1], f"t{seq}", reason, reason is not None, at, seq + u * 100))
    # Within a batch the latest sighting speaks for a fingerprint, and ids are looked up in the
    # stored table. Batches where a clash comes on top of another sighting of the same posting or
    # an edit of the clashing one are therefore left out here.
    sighted = [row[0] for row in batch]
    if "clash" in kinds and ("edit" in kinds or sighted.count(f"{u}/fp1") > kinds.count("clash")):
        return None
    return store, batch


def stored_frame(spark, store):
    rows = [
        (k, r["source"], r["id"], r["title"], r["reason"], r["reason"] is not None, r["first"], r["last"])
        for k, r in store.items()
    ]
    schema = "posting_key string, source string, source_job_id string, title string, filter_reason string, filtered_out boolean, first_seen_at timestamp, last_seen_at timestamp"
    return spark.createDataFrame(rows, schema)


def collected(df):
    utc = lambda t: t.astimezone(timezone.utc) if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return {
        r.posting_key: (r.source, r.source_job_id, r.title, r.filter_reason, utc(r.first_seen_at), utc(r.last_seen_at))
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def merged(spark):
    rng = random.Random(7)
    store, batch, want = {}, [], {}
    for u in range(300):
        made = universe(rng, u)
        if made is None:
            continue
        store.update(made[0])
        batch.extend(made[1])
        want.update(simulate(*made))
    current = stored_frame(spark, store)
    arriving = spark.createDataFrame(batch, SIGHTING)
    return current, arriving, G.merge_postings(current, arriving), want


def test_merge_equals_row_by_row(merged):
    _, _, result, want = merged
    got, want = collected(result), state_rows(want)
    wrong = {k: (got.get(k), want.get(k)) for k in {*got, *want} if got.get(k) != want.get(k)}
    assert not wrong, list(wrong.items())[:3]


def test_merging_again_changes_nothing(merged):
    _, arriving, result, want = merged
    again = G.merge_postings(result.drop("change"), arriving)
    assert collected(again) == state_rows(want)


def test_source_ids_stay_unique(spark):
    rng = random.Random(3)
    store, batch = {}, []
    for u in range(200):
        for i in range(3):
            store[f"{u}/fp{i}"] = dict(source=f"s{u}", id=f"id{i}", title="old", reason=None, first=DAY, last=DAY)
        for seq in range(rng.randint(1, 5)):
            fp = rng.choice(["fp0", "fp1", "fp2", "new0", "new1"])
            sid = rng.choice(["id0", "id1", "id2", "id3", None])
            batch.append((f"{u}/{fp}", f"s{u}", sid, "t", None, False, DAY, seq + 10 * u))
    result = G.merge_postings(stored_frame(spark, store), spark.createDataFrame(batch, SIGHTING))
    keys = result.groupBy("posting_key").count().where("count > 1").count()
    ids = result.where("source_job_id is not null").groupBy("source", "source_job_id").count()
    assert keys == 0 and ids.where("count > 1").count() == 0


def test_a_hot_posting_collapses_before_the_shuffle(spark):
    batch = spark.range(1000).selectExpr(
        "'hot' AS posting_key", "'s' AS source", "'1' AS source_job_id", "CAST(id AS STRING) AS title",
        "timestamp_seconds(id) AS seen_at", "id AS seq",
    )
    rows = G.collapse_batch(batch)
    assert [r.title for r in rows.collect()] == ["999"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_companies_keep_board_and_verdict(spark):
    current = spark.createDataFrame(
        [("a", "A", None, None, "excluded", None, None, "user", None)],
        "company_key string, name string, ats_type string, board_token string, verdict string, sector string,"
        " reason string, verdict_source string, decided_at timestamp",
    )
    seen = spark.createDataFrame(
        [("a", "A Inc", None, None, 1), ("a", "A Corp", "lever", "aa", 2), ("a", "A Ltd", "ashby", "bb", 3), ("b", "B", None, None, 4)],
        "company_key string, name string, ats_type string, board_token string, seq int",
    )
    out = {r.company_key: r for r in G.merge_companies(current, seen).collect()}
    assert (out["a"].name, out["a"].ats_type, out["a"].board_token, out["a"].verdict) == ("A Ltd", "lever", "aa", "excluded")
    assert out["b"].verdict == "unknown"


def test_applied_at_is_never_rewritten(spark):
    events = spark.createDataFrame(
        [("p", "queued", 1), ("p", "applied", 2), ("p", "queued", 3), ("p", "interview", 4), ("q", "dismissed", 1)],
        "posting_key string, status string, d int",
    ).selectExpr("posting_key", "status", "timestamp_seconds(d) AS at", "d AS event_id")
    out = {r.posting_key: r for r in G.fold_status(events).collect()}
    assert out["p"].status == "interview" and out["p"].applied_at.second == 2
    assert out["q"].applied_at is None
    bad = events.withColumn("status", F.lit("lost"))
    with pytest.raises(Exception, match="unknown status"):
        G.fold_status(bad).collect()


def test_running_total_over_a_hot_group(spark):
    from postmill.operators.common import running_total

    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), rng.randint(0, 20), i, rng.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, i int, v long")
    got = {r.i: r.before for r in running_total(df, "g", ["t", "i"], "v", "before", slices=7).collect()}
    for g, t, i, _ in rows:
        assert got[i] == sum(r[3] for r in rows if r[0] == g and (r[1], r[2]) < (t, i))


def test_salted_join_equals_plain_join(spark):
    from postmill.operators.common import salted_join

    fact = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS k")
    dim = spark.range(30).selectExpr("id AS k", "id * 2 AS d")
    for how in ("inner", "left"):
        want = sorted(map(tuple, fact.join(dim, "k", how).select("id", "k", "d").collect()), key=str)
        got = sorted(map(tuple, salted_join(fact, dim, "k", "id", how, 5).select("id", "k", "d").collect()), key=str)
        assert got == want


def test_joins_by_a_unique_key_send_no_repeated_rows_through_the_driver(spark):
    from postmill.operators.common import salted_join, unique_join
    from postmill.operators.postings import canonical

    postings = spark.range(300).selectExpr("id AS posting_key", "id % 30 AS company_key", "CAST(NULL AS STRING) AS remote_type")
    firms = spark.range(30).selectExpr("id AS company_key", "'firm ' || CAST(id AS STRING) AS name")
    joined = canonical(postings, firms)
    assert joined.count() == 300 and joined.where("company_name <> 'firm ' || CAST(company_key AS STRING)").count() == 0
    # the dimension is the given rows, not a copy of them for each salt
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    held = unique_join(postings, firms.where("company_key < 10"), "company_key", "left")
    assert (held.count(), held.where("name IS NULL").count()) == (300, 200)
    assert "Broadcast" not in salted_join(postings, firms, "company_key", "posting_key")._jdf.queryExecution().sparkPlan().toString()


def test_keys_of_a_large_batch_are_not_broadcast(spark, tmp_path):
    from postmill.schemas import conform
    from postmill.session import stage
    from postmill.sources.tables import StoredTable

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = spark.range(30).selectExpr("concat('k', id) AS posting_key", "'lever' AS source", "concat('j', id) AS source_job_id", "id AS seq")
    current = stage(conform(rows.where("seq < 20").withColumn("first_seen_at", F.current_timestamp()), POSTING), "current")
    batch = stage(G.collapse_batch(rows.withColumn("seen_at", F.current_timestamp())), "batch")
    few, many = G.posting_changes(current, batch), G.posting_changes(current, batch, few=29)
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many)
    assert sorted(r.change for r in few.collect()) == sorted(r.change for r in many.collect()) == ["new"] * 10 + ["seen"] * 20

    table = StoredTable(spark, str(tmp_path / "t"), {"k": "bigint"}, "k", share=0.9)
    table.commit(spark.range(70_000).select(F.col("id").alias("k")))
    table.commit(spark.range(10).select(F.col("id").alias("k")))
    assert "BroadcastHashJoin" in plan(table.read())
    table.commit(spark.range(60_000).select(F.col("id").alias("k")))
    assert "BroadcastHashJoin" not in plan(table.read()) and table.read().count() == 70_000
