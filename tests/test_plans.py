"""Runs over landed files: discovery, scoring, re-judging, publishing, streaming."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill.functions.rules import RuleSet
from postmill.plans import discover as D
from postmill.plans import publish as B
from postmill.plans import rejudge as J
from postmill.plans import score as C
from postmill.plans.workspace import Workspace
from postmill.schemas import RUN
from postmill.session import discard
from postmill.sources import landing as L
from postmill.sources.feeds import SOURCES, read_raw, targets_table
from postmill.sources.tables import StoredTable, append_once
from postmill.streaming import exact as X
from postmill.streaming import jobs as S

NOW = datetime(2024, 3, 10, tzinfo=timezone.utc)
LATER = datetime(2024, 3, 11, tzinfo=timezone.utc)


def land(root, source, token, payload, name="a"):
    folder = root / f"source={source}" / f"token={token}"
    folder.mkdir(parents=True, exist_ok=True)
    text = payload if isinstance(payload, str) else json.dumps(payload)
    (folder / f"{name}.json").write_text(text)


def board(*jobs, total=None):
    return {"jobs": list(jobs), "meta": {"total": total or len(jobs)}}


def job(i, title="Software Engineer", place="Oakland, CA", **more):
    return {
        "id": i, "title": title, "company_name": "Acme Inc", "absolute_url": f"https://x/{i}",
        "content": "&lt;p&gt;Pay $150,000 - $180,000&lt;/p&gt;", "first_published": "2024-03-09T00:00:00Z",
        "location": {"name": place}, **more,
    }


@pytest.fixture
def landing(tmp_path):
    root = tmp_path / "landing"
    land(root, "greenhouse", "acme", board(
        job(1), job(2, "Sales Lead"), job(3, "Data Engineer", "Berlin, Germany"),
        job(4, "Software Engineer (Remote)"),  # the same posting as 1 under another id
    ))
    land(root, "greenhouse", "broken", "{not json")
    land(root, "greenhouse", "short", board(job(5, company_name="Short", title="Platform Engineer"), total=9))
    land(root, "lever", "beta", [{
        "id": "l1", "text": "Backend Engineer", "categories": {"location": "Remote - US"},
        "descriptionPlain": "Plain", "lists": [{"text": "Pay", "content": "<li>$200,000</li>"}],
        "hostedUrl": "https://jobs.lever.co/beta/l1", "createdAt": 1709900000000, "workplaceType": "remote",
    }, {"id": "l2", "text": None, "hostedUrl": "https://jobs.lever.co/beta/l2"}])
    land(root, "lever", "retired", [])
    land(root, "ashby", "gamma", {"jobs": [{
        "id": "g1", "title": "Security Engineer", "location": "SF", "descriptionHtml": "<p>x</p>",
        "applyUrl": "https://jobs.ashbyhq.com/g1", "publishedAt": "2024-03-01T00:00:00+00:00",
        "compensation": {"compensationTiers": [{"components": [
            {"compensationType": "Salary", "interval": "1 YEAR", "minValue": 100000, "maxValue": 110000}]}]},
    }]})
    land(root, "remotive", "all", {"jobs": [{
        "id": 9, "url": "https://r/9", "title": "Go Developer", "company_name": "Casino Royale",
        "description": "x", "publication_date": "2024-03-08T10:00:00", "candidate_required_location": "USA"}]})
    land(root, "hn_algolia", "all", {"nbPages": 1, "hits": [
        {"objectID": "77", "comment_text": "Eta (eta.io) | Rust Engineer | Remote US<p>hi", "parent_id": 1, "story_id": 1},
        {"objectID": "78", "comment_text": "Reply | Engineer | Remote", "parent_id": 77, "story_id": 1}]})
    return str(root)


def state(table):
    return {r.title + "|" + r.source: r for r in table.read().collect()}


def test_discovery_converges_and_quarantines(spark, tmp_path, landing):
    ws = Workspace(spark, str(tmp_path / "ws"))
    run = D.discover(ws, landing, NOW, "run1").first()
    assert (run.jobs_seen, run.jobs_new, run.errors) == (9, 8, 2)
    lost = ws.log("unreadable", {"source": "string", "token": "string", "path": "string", "payload": "string"}).collect()
    assert [(r.source, r.token, bool(r.payload)) for r in lost] == [("greenhouse", "broken", True)]
    first = ws.postings.read().collect()
    assert len(first) == 8
    reasons = {r.title: r.filter_reason for r in first}
    assert reasons["Sales Lead"] == "title_not_target"
    assert reasons["Data Engineer"] == "location_outside_area"
    assert reasons["Security Engineer"] == "salary_below_floor"
    assert reasons["Rust Engineer"] is None
    pay = {r.title: (r.salary_min, r.salary_max, r.salary_source) for r in first}
    assert pay["Backend Engineer"] == (200000, 200000, "parsed")
    assert pay["Security Engineer"] == (100000, 110000, "structured")
    boards = {(r.source, r.token): r.status for r in ws.log("boards", D.BOARD).collect()}
    assert boards["greenhouse", "short"] == "truncated" and boards["lever", "retired"] == "empty" and len(boards) == 8
    assert run.notes == "3 boards not ok"
    D.discover(ws, landing, LATER, "run2", changed_only=False)
    again = ws.log("runs", RUN).where("run_id = 'run2'").first()
    assert again.jobs_new == 0
    second = ws.postings.read().collect()
    assert len(second) == 8
    assert {r.first_seen_at for r in second} == {r.first_seen_at for r in first}
    assert all(r.last_seen_at > r.first_seen_at for r in second)
    before = sorted(map(str, second))
    assert D.discover(ws, landing, LATER, "run2").first() == again  # delivered twice
    assert sorted(map(str, ws.postings.read().collect())) == before
    names = {r.company_key: r for r in ws.companies.read().collect()}
    assert names["acme"].ats_type == "greenhouse" and names["eta"].ats_type is None


def test_files_that_were_read_are_skipped(spark, tmp_path):
    ws, landing = Workspace(spark, str(tmp_path / "ws")), tmp_path / "landing"
    land(landing, "greenhouse", "acme", board(job(1)))
    assert D.discover(ws, str(landing), NOW, "1").first().jobs_seen == 1
    assert D.discover(ws, str(landing), LATER, "2").first().jobs_seen == 0
    land(landing, "greenhouse", "beta", board(job(2, "Data Engineer")))
    assert D.discover(ws, str(landing), LATER, "3").first().jobs_seen == 1
    assert ws.postings.read().count() == 2


def test_an_edited_posting_replaces_its_old_version(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    land(tmp_path / "one", "greenhouse", "acme", board(job(1), job(2, "Data Engineer")))
    land(tmp_path / "two", "greenhouse", "acme", board(job(1, "Platform Engineer"), job(2, "Data Engineer")))
    D.discover(ws, str(tmp_path / "one"), NOW, "1", ["greenhouse"])
    D.discover(ws, str(tmp_path / "two"), LATER, "2", ["greenhouse"])
    rows = {r.title: r for r in ws.postings.read().collect()}
    assert set(rows) == {"Platform Engineer", "Data Engineer"}
    assert rows["Platform Engineer"].first_seen_at == rows["Data Engineer"].first_seen_at


def test_comments_of_the_newest_thread_only(spark, tmp_path):
    comment = lambda i, story: {"objectID": str(i), "comment_text": f"Kappa {i} | Rust Engineer | Remote", "parent_id": story, "story_id": story}
    land(tmp_path, "hn_algolia", "all", {"nbPages": 1, "hits": [comment(11, 5), comment(12, 6), comment(13, 7)]})
    names = lambda: {r.company_name for r in read_raw(spark, str(tmp_path), ["hn_algolia"]).collect()}
    assert names() == {"Kappa 13"}  # no list of threads has landed
    story = lambda i, title, day: {"objectID": str(i), "title": title, "created_at": f"2024-03-{day:02}T00:00:00Z"}
    land(tmp_path, "hn_stories", "all", {"hits": [
        story(5, "Ask: Who is hiring? (February)", 1), story(6, "Ask: Who is hiring? (March)", 4), story(7, "Ask: Who wants to be hired?", 5)]})
    assert names() == {"Kappa 12"}
    ws = Workspace(spark, str(tmp_path / "ws"))
    S.ingest(ws, str(tmp_path), SOURCES["hn_algolia"], str(tmp_path / "cp"), NOW).awaitTermination()
    assert ws.postings.read().count() == 1
    land(tmp_path, "hn_stories", "all", {"hits": []})
    assert names() == set()


def test_landing_checks(spark, landing):
    status = {(r.source, r.token): r.status for r in L.landed_status(spark, landing).collect()}
    assert status["greenhouse", "acme"] == "ok"
    assert status["greenhouse", "broken"] == "failed"
    assert status["greenhouse", "short"] == "truncated"
    assert status["lever", "beta"] == "ok" and status["lever", "retired"] == "empty"
    index = L.snapshot_index(spark, landing)
    seen = index.where(F.col("url").contains("acme"))
    left = {r.url for r in L.unseen(index, seen).collect()}
    assert len(left) == 7 and not any("acme" in u for u in left)


def test_a_missing_mandatory_field_is_kept_apart(spark, landing):
    raw = read_raw(spark, landing, ["lever"])
    good, bad = D.split_sound(raw)
    assert [r.source_job_id for r in good.collect()] == ["l1"]
    assert [r.source_job_id for r in bad.collect()] == ["l2"]


def test_targets(spark, tmp_path):
    path = tmp_path / "targets.json"
    path.write_text(json.dumps({"lever": ["a", "b"], "ashby": None}))
    got = {tuple(r) for r in targets_table(spark, str(path)).collect()}
    assert got == {("lever", "a"), ("lever", "b"), ("remotive", None), ("hn_algolia", None)}


def test_score_judge_screen_publish(spark, tmp_path, landing):
    ws = Workspace(spark, str(tmp_path / "ws"))
    D.discover(ws, landing, NOW, "run1")
    vectors = ws.postings.read().select(
        "posting_key", F.array(F.lit(1.0), F.length("title") / 20).alias("embedding")
    )
    some = vectors.orderBy("posting_key").limit(1)
    assert C.score_unscored(ws, some.limit(0), [1.0, 0.8], NOW, "score-0").count() == 0
    waiting = ws.log("awaiting_vector", {"posting_key": "string"}).count()
    fresh = C.score_unscored(ws, vectors, [1.0, 0.8], NOW, "score-1")
    assert waiting == fresh.count() == ws.log("awaiting_vector", {"posting_key": "string"}).count()
    live = ws.postings.read().where("not filtered_out").count()
    assert fresh.count() == live and ws.scores.read().count() == live
    assert C.score_unscored(ws, vectors, [1.0, 0.8], NOW).count() == 0

    none = spark.createDataFrame([], "company_key string, verdict string, decided_at timestamp")
    models = spark.createDataFrame([("eta", "perhaps", "s", "r")], "company_key string, verdict string, sector string, reason string")
    C.screen(ws, none, models, NOW)
    verdicts = {r.company_key: (r.verdict, r.verdict_source) for r in ws.companies.read().collect()}
    assert verdicts["casino royale"] == ("excluded", "blocklist")
    assert verdicts["eta"] == ("flagged", "llm") and verdicts["acme"] == ("unknown", None)
    ruled = spark.createDataFrame([("casino royale", "allowed", NOW)], none.schema)
    C.screen(ws, ruled, models, NOW)
    C.screen(ws, none, models, NOW)
    verdicts = {r.company_key: (r.verdict, r.verdict_source) for r in ws.companies.read().collect()}
    assert verdicts["casino royale"] == ("allowed", "user")

    chosen = C.candidates(ws, 3, 1)
    assert chosen.count() == 3 and "Description:" in chosen.first().text
    judged = chosen.select("posting_key").limit(1).withColumns(
        {"relevance_verdict": F.lit("great"), "relevance_score": F.lit(7.0), "rationale": F.lit(" ok ")}
    )
    C.ingest_judgements(ws, judged, "m", NOW)
    C.rescore(ws, vectors, [1.0, 0.8], LATER)
    marks = ws.scores.read().where("relevance_verdict is not null").collect()
    assert [(m.relevance_verdict, m.rationale, m.model) for m in marks] == [("possible", "ok", "m")]

    key = ws.postings.read().where("title = 'Rust Engineer'").first().posting_key
    events = spark.createDataFrame([(key, "applied", NOW, "e1")], "posting_key string, status string, at timestamp, event_id string")
    append_once(events, ws.log_path("status_events"), "1")
    B.publish(ws, str(tmp_path / "out"), LATER)
    queue = spark.read.parquet(str(tmp_path / "out/queue"))
    assert queue.count() == live - 1 and queue.where("title = 'Rust Engineer'").count() == 0
    detail = {r.title: r.status for r in spark.read.parquet(str(tmp_path / "out/detail")).collect()}
    assert detail["Rust Engineer"] == "applied" and detail["Sales Lead"] == "queued"


def test_rejudge_reports_then_writes(spark, tmp_path, landing):
    ws = Workspace(spark, str(tmp_path / "ws"))
    D.discover(ws, landing, NOW, "run1")
    strict = RuleSet(pay_floor=190_000)
    report = J.rejudge_stored(ws, strict, dry_run=True).collect()
    assert {(r.was, r.now): r.n for r in report} == {
        ("passes", "salary_below_floor"): 2, ("location_outside_area", "salary_below_floor"): 1,
    }
    assert all(len(r.examples) == r.n for r in report)
    assert ws.postings.read().where("filter_reason = 'salary_below_floor'").count() == 1
    J.rejudge_stored(ws, strict)
    assert ws.postings.read().where("filter_reason = 'salary_below_floor'").count() == 4


def test_stream_ingest_equals_batch(spark, tmp_path, landing):
    batch, stream = Workspace(spark, str(tmp_path / "b")), Workspace(spark, str(tmp_path / "s"))
    D.discover(batch, landing, NOW, "run1", ["greenhouse"])
    spec = SOURCES["greenhouse"]
    for _ in range(2):  # the second run finds nothing new
        S.ingest(stream, landing, spec, str(tmp_path / "cp"), NOW, files_per_trigger=1).awaitTermination()
    columns = ["posting_key", "company_key", "title", "filter_reason", "first_seen_at", "last_seen_at"]
    want = {tuple(r) for r in batch.postings.read().select(*columns).collect()}
    got = {tuple(r) for r in stream.postings.read().select(*columns).collect()}
    assert want == got and len(got) == 4


def test_stream_streaks_over_many_batches(spark, tmp_path):
    src = tmp_path / "in"
    runs = [[("a", 1, False), ("b", 2, True)], [("a", 3, True), ("a", 4, False), ("b", 5, False)], [("a", 6, False), ("c", 7, False)]]
    runs.append([("b", 3, True), ("c", 8, False)])  # a file that lands late: b succeeded before it failed
    schema = "source string, attempt_id int, ok boolean"
    for i, rows in enumerate(runs):
        df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("attempt_id"))
        df.coalesce(1).write.mode("append").parquet(str(src))
        stream = S.file_stream(spark, str(src), schema + ", at timestamp", files_per_trigger=1)
        X.track_streaks(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.source: r.consecutive_errors for r in X.streaks(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": 2, "b": 1, "c": 2}


def test_logs_count_a_batch_once(spark, tmp_path):
    from decimal import Decimal

    from postmill.plans import logs

    ws = Workspace(spark, str(tmp_path / "ws"))
    assert logs.spend(ws).count() == 0 and logs.sources(ws).count() == 0
    schema = "call_id string, model string, input_tokens long, output_tokens long, created_at timestamp"
    for batch, calls in (("1", ["a", "b"]), ("1", ["a", "b"]), ("2", ["c"])):
        rows = [(c, "m", 1_000_000, 0, NOW) for c in calls]
        rates = spark.createDataFrame([("m", Decimal("2.00"), Decimal("4.00"), 1)], "model string, input_rate decimal(8,2), output_rate decimal(8,2), min_cacheable long")
        logs.record_spend(ws, spark.createDataFrame(rows, schema), batch, rates)
    assert {r.call_id: r.cost_usd for r in logs.spend(ws).collect()} == dict.fromkeys("abc", Decimal("2.000000"))
    tries = spark.createDataFrame([("x", 1, NOW, True), ("x", 2, LATER, False)], "source string, attempt_id long, at timestamp, ok boolean")
    for _ in range(2):
        logs.record_attempts(ws, tries, "1")
    assert [(r.source, r.consecutive_errors) for r in logs.sources(ws).collect()] == [("x", 1)]


def test_two_feeds_and_a_second_checkpoint(spark, tmp_path, landing):
    ws = Workspace(spark, str(tmp_path / "ws"))
    specs = [SOURCES[n] for n in ("greenhouse", "lever", "remotive")]
    S.ingest(ws, landing, specs, str(tmp_path / "cp1"), NOW, files_per_trigger=1).awaitTermination()
    assert {r.source for r in ws.postings.read().collect()} == {"greenhouse", "lever", "remotive"}
    first = {r.posting_key for r in ws.postings.read().collect()}
    land(tmp_path / "more", "greenhouse", "acme", board(job(91, "Platform Engineer")))
    S.ingest(ws, str(tmp_path / "more"), SOURCES["greenhouse"], str(tmp_path / "cp2"), LATER).awaitTermination()
    after = {r.posting_key: r.title for r in ws.postings.read().collect()}
    assert first < set(after) and len(after) == len(first) + 1
    lost = ws.log("unreadable", {"source": "string", "path": "string"}).collect()
    assert len(lost) == 1 and "broken" in lost[0].path


def test_a_commit_costs_its_own_rows(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), {"k": "string", "v": "int"}, "k")
    assert table.read().count() == 0
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "k string, v int")
    for _ in range(2):  # delivered twice
        table.commit(rows)
        assert {tuple(r) for r in table.read().collect()} == {(f"k{i}", i) for i in range(40)}
    table.commit(spark.createDataFrame([("k3", 33)], "k string, v int"))
    assert table.records()[-1].rows == 1
    table.commit(rows.limit(0), gone=rows)
    assert table.read().count() == 0
    table.commit(spark.createDataFrame([("k3", 5)], "k string, v int"))
    assert [tuple(r) for r in table.read().collect()] == [("k3", 5)]


def test_a_broken_commit_loses_nothing(spark, tmp_path, monkeypatch):
    """Break a commit off after its rows are written, then delete what it wrote, then run it again."""
    table = StoredTable(spark, str(tmp_path / "t"), {"k": "int", "v": "int"}, "k")
    table.commit(spark.range(1000).selectExpr("CAST(id AS INT) k", "0 v"))
    changes = spark.range(500, 520).selectExpr("CAST(id AS INT) k", "1 v")

    def fails(self, record):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_record", fails)
        with pytest.raises(RuntimeError):
            table.commit(changes, label="b")
    folders = {str(p) for p in (tmp_path / "t" / "data").iterdir()}
    kept = {f"{tmp_path}/t/{r.path}" for r in table.records()}
    for left in folders - kept:
        assert discard(spark, left)
    assert table.read().where("v = 0").count() == 1000 and not table.has("b")
    assert table.commit(changes, label="b") and not table.commit(changes, label="b")
    assert table.read().count() == 1000 and table.read().where("v = 1").count() == 20
    assert table.records()[-1].rows == 20  # of 1000


def test_folding_and_whole_copies_keep_the_rows(spark, tmp_path):
    rng = random.Random(5)
    table = StoredTable(spark, str(tmp_path / "t"), {"a": "int", "b": "string", "v": "int"}, ("a", "b"), part="b", share=0.5, fold_at=3)
    want, kinds = {}, "a int, b string, v int"
    for i in range(14):
        keys = {(rng.randint(0, 30), rng.choice("xyz")) for _ in range(40 if i == 0 else 3)}
        gone = set(rng.sample(sorted(want), 2)) - keys if want else set()
        changed = {k: i for k in keys}
        table.commit(
            spark.createDataFrame([(*k, v) for k, v in changed.items()], kinds),
            gone=spark.createDataFrame([(*k, None) for k in gone], kinds) if gone else None, label=f"c{i}",
        )
        want = {k: v for k, v in {**want, **changed}.items() if k not in gone}
        assert {(r.a, r.b): r.v for r in table.read().collect()} == want
    kinds = [r.kind for r in table.records()]
    assert "folded" in kinds and kinds.count("whole") > 1
    assert {(r.a, r.b): r.v for r in table.read(parts=["x"]).collect()} == {k: v for k, v in want.items() if k[1] == "x"}
    assert table.vacuum() > 0 and {(r.a, r.b): r.v for r in table.read().collect()} == want


def test_stream_ingest_keeps_on_disk_what_the_tables_need(spark, tmp_path, landing):
    """Its steps, its shuffle files and old copies are gone at its end, and the session's own settings are as before."""
    import time
    from pathlib import Path

    from postmill.session import shared_dir

    def steps():
        return {p for p in Path(shared_dir(spark)).rglob("*.parquet") if p.stat().st_size}

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = steps(), shuffled()
    plain, spare = Workspace(spark, str(tmp_path / "p")), Workspace(spark, str(tmp_path / "s"))
    S.ingest(plain, landing, SOURCES["greenhouse"], str(tmp_path / "cp1"), NOW, files_per_trigger=1).awaitTermination()
    S.ingest(spare, landing, SOURCES["greenhouse"], str(tmp_path / "cp2"), NOW, files_per_trigger=1, vacuum=True).awaitTermination()
    for _ in range(50):  # files are deleted in the background
        if shuffled() <= before[1]:
            break
        time.sleep(0.2)
    assert steps() <= before[0] and shuffled() <= before[1]
    assert {tuple(r) for r in plain.postings.read().collect()} == {tuple(r) for r in spare.postings.read().collect()}
    for table in (spare.postings, spare.companies):
        records = table.records()
        whole, later = table._current(records)
        assert {p.name for p in (tmp_path / "s").glob(f"{table.root.rsplit('/', 1)[1]}/data/*")} == {r.path.split("/")[1] for r in (whole, *later)}
        assert len(records) > 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.optimizer.excludedRules", None) is None


def test_spared_shuffles_leave_nothing_where_a_side_is_empty(spark, tmp_path):
    """A join with nothing writes its other side's shuffle, which is deleted as any other."""
    from postmill.session import ENDS_EARLY, spare_shuffles

    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.optimizer.excludedRules", "some.Rule")
    for _ in range(2):
        spare_shuffles(own)
    assert own.conf.get("spark.sql.adaptive.optimizer.excludedRules") == f"some.Rule,{ENDS_EARLY}"
    own.conf.set("spark.sql.adaptive.optimizer.excludedRules", ENDS_EARLY)
    own.range(1000).write.parquet(str(tmp_path / "some"))
    own.range(0).write.parquet(str(tmp_path / "none"))
    some, none = own.read.parquet(str(tmp_path / "some")), own.read.parquet(str(tmp_path / "none"))
    joined = some.join(none.hint("merge"), "id", "left_anti")
    assert len(joined.collect()) == 1000
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_whole_copy_of_many_changes_shuffles_keys_only(spark, tmp_path, monkeypatch):
    plans = []
    write = StoredTable._write
    monkeypatch.setattr(StoredTable, "_write", lambda self, rows, *more: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, rows, *more))
    kinds = "a int, b string, v int"
    rows = spark.range(300).selectExpr("CAST(id AS INT) a", "CAST(id % 3 AS STRING) b", "0 v")
    for i, few in enumerate((10, 1000)):
        table = StoredTable(spark, str(tmp_path / f"t{i}"), {"a": "int", "b": "string", "v": "int"}, ("a", "b"), share=0.9)
        table.commit(rows.unionByName(spark.createDataFrame([(None, "x", 0)], kinds)))
        table.commit(spark.range(295, 500).selectExpr("CAST(id AS INT) a", "CAST(id % 3 AS STRING) b", "1 v"), gone=rows.where("a < 3"))
        plans.clear()
        table._copy(table.records(), few=few)
        assert [r.kind for r in table.records()] == ["whole", "changed", "whole"]
        assert "Exchange hashpartitioning" not in plans[0] and "BroadcastHashJoin" in plans[0]
        want = {(None, "x", 0), *[(k, str(k % 3), int(k >= 295)) for k in range(3, 500)]}
        assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == len(want)
