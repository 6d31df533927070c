"""Stream jobs on stored state: late, repeated and replayed deliveries."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from postmill.operators.runs import source_state
from postmill.streaming import exact as X
from postmill.streaming import jobs as J

DAY0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ATTEMPTS = "source string, attempt_id long, at timestamp, ok boolean"


def landed(spark, root, batches, schema):
    """A stream of one file for each batch of rows, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/b{i}")
    return J.file_stream(spark, root, schema, files_per_trigger=1, recursiveFileLookup="true")


def test_streaks_equal_the_batch_result(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{rng.choice([0, 0, 0, 1, 2, 3])}", i, DAY0 + timedelta(hours=rng.randint(0, 400)), rng.random() < 0.2) for i in range(200)]
    rows += [("never", 900 + i, DAY0, False) for i in range(3)] + [("tie", 950, DAY0, True), ("tie", 951, DAY0, False)]
    rng.shuffle(rows)  # times have nothing to do with deliveries
    batches = [rows[:70], rows[70:130], rows[130:], rows[40:90]]
    root = str(tmp_path / "state")
    X.track_streaks(landed(spark, str(tmp_path / "in"), batches, ATTEMPTS), root, str(tmp_path / "cp")).awaitTermination()
    want = source_state(spark.createDataFrame(rows, ATTEMPTS))
    got = X.streaks(spark, root)
    columns = ["source", "last_fetch_ok_at", "consecutive_errors"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The checkpoint is lost after the state was committed; and a batch breaks off between its commits."""
    schema = "id long, at timestamp, n long"
    rows = [(i, DAY0 + timedelta(days=i % 5), i) for i in range(40)]
    root = str(tmp_path / "state")
    stream = landed(spark, str(tmp_path / "in"), [rows[:20], rows[20:]], schema)
    keys, sums = {"day": F.to_date("at")}, {"n": F.col("n")}
    X.exact_totals(stream, "id", "at", keys, sums, root, str(tmp_path / "cp1")).awaitTermination()
    totals = X.stored_totals(spark, root, {"day": "date"}, {"n": "bigint"})
    first = sorted(map(tuple, totals.read().collect()))
    assert sum(r[1] for r in first) == sum(range(40))
    X.exact_totals(stream, "id", "at", keys, sums, root, str(tmp_path / "cp2")).awaitTermination()
    assert sorted((r[0], r[1], r[2]) for r in totals.read().collect()) == [(r[0], r[1], r[2]) for r in first]


def test_a_batch_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    schema = "id long, at timestamp, n long"
    rows = [(i, DAY0 + timedelta(days=i % 5), i) for i in range(40)] + [(None, None, 7), (None, None, 7)]
    root, cp = str(tmp_path / "state"), str(tmp_path / "cp")
    stream = landed(spark, str(tmp_path / "in"), [rows], schema)
    keys, sums = {"day": F.to_date("at")}, {"n": F.col("n")}
    plain = X.StoredTable.commit

    def breaks(self, *args, **kwargs):
        if self.root.endswith("/taken"):
            raise RuntimeError("lost")
        return plain(self, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(X.StoredTable, "commit", breaks)
        try:
            X.exact_totals(stream, "id", "at", keys, sums, root, cp).awaitTermination()
            raise AssertionError("it should have failed")
        except Exception as failed:
            assert "lost" in str(failed)
    X.exact_totals(stream, "id", "at", keys, sums, root, cp).awaitTermination()
    totals = X.stored_totals(spark, root, {"day": "date"}, {"n": "bigint"}).read()
    assert totals.agg(F.sum("n"), F.sum("rows")).first()[:] == (sum(range(40)) + 14, 42)


def test_late_rows_are_logged_and_merged(spark, tmp_path):
    schema = "id long, at timestamp, n long"
    batches = [[(1, DAY0 + timedelta(days=9), 1)], [(2, DAY0, 5), (3, DAY0 + timedelta(days=8), 7), (1, DAY0 + timedelta(days=9), 1)]]
    root = str(tmp_path / "state")
    X.exact_totals(landed(spark, str(tmp_path / "in"), batches, schema), "id", "at", {"k": F.lit("all")}, {"n": F.col("n")}, root, str(tmp_path / "cp")).awaitTermination()
    assert X.stored_totals(spark, root, {"k": "string"}, {"n": "bigint"}).read().first()[:] == ("all", 13, 3, 1)
    late = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/late")
    assert [r.id for r in late.collect()] == [2]


def test_a_repost_raises_no_second_alert(spark, tmp_path):
    schema = "k string, at timestamp"
    batches = [[("a", DAY0), ("a", DAY0), (None, DAY0)], [("b", DAY0)], [("a", DAY0 + timedelta(days=60)), ("c", DAY0 - timedelta(days=400))]]
    root = str(tmp_path / "state")
    X.first_alerts(landed(spark, str(tmp_path / "in"), batches, schema), "k", "at", root, str(tmp_path / "cp")).awaitTermination()
    alerts = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/alerts")
    assert sorted(r.k for r in alerts.collect()) == ["a", "b", "c"]


def test_landings_of_events_have_equally_many_files(spark, tmp_path):
    from pathlib import Path

    from postmill.session import shared_dir
    from queries import stream_q

    # files of uneven times, as in a table of several copies: some hold one span alone
    def events(first, last, seconds):
        at = f"CAST(timestamp_seconds(1704067200 + {seconds}) AS TIMESTAMP_NTZ) AS ts"
        return spark.range(first, last, 1, 1).selectExpr("id AS event_id", at, "id % 7 AS user_id", "'view' AS event_type")

    for part in (events(3000, 9000, "(id - 3000) * 50"), events(0, 3000, "id * 864"), events(9000, 15000, "2500000 - (id - 9000) * 50")):
        part.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")  # a task for each file and more
    try:
        stream_q._untidy(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    root = max(Path(shared_dir(spark)).glob("untidy-*"), key=lambda p: p.stat().st_mtime)
    files = [len(list((root / f"landed-{i}").glob("*.parquet"))) for i in range(5)]
    assert len(set(files)) == 1 and spark.read.option("recursiveFileLookup", True).parquet(str(root)).count() > 15000
