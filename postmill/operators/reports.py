"""What the screens and the funnel did."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.expr import instant
from postmill.functions.places import CLASSES, location_verdict
from postmill.operators.common import cap_per_group
from postmill.operators.postings import is_live, is_open

# Funnel stages in order, statuses, and the reasons the place screen gives.
FUNNEL_STAGES = ("queued", "applied", "responded", "interview", "rejected")
STATUSES = (*FUNNEL_STAGES, "dismissed")
PLACE_REASONS = ("location_outside_area", "remote_outside_us")
ARRANGEMENTS = ("hybrid", "onsite", "remote")


def _days_before(as_of: datetime, days: int) -> Column:
    return instant(as_of) - F.make_dt_interval(days=F.lit(days))


def intake_breakdown(postings: DataFrame, as_of: datetime) -> DataFrame:
    """A1. Open postings per reason, passes first, with the last week's count and the share."""
    counts = (
        postings.where(is_open())
        .groupBy(F.coalesce("filter_reason", F.lit("passes")).alias("reason"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("first_seen_at") >= _days_before(as_of, 7)).alias("this_week"),
        )
    )
    # The window runs over one row per reason.
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", share).orderBy(
        (F.col("reason") == "passes").desc(), F.col("n").desc(), "reason"
    )


def place_grid(postings: DataFrame) -> DataFrame:
    """A2. Open postings by class and arrangement; ``rejected`` counts this screen only."""
    return (
        postings.where(is_open())
        .groupBy("location_class", "remote_type")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("filter_reason").isin(*PLACE_REASONS)).alias("rejected"),
        )
        .orderBy("location_class", "remote_type")
    )


def place_grid_wide(postings: DataFrame) -> DataFrame:
    """A2. The grid with one column per arrangement and the rejected total per class."""
    grid = place_grid(postings)
    pivoted = grid.groupBy("location_class").pivot("remote_type", list(ARRANGEMENTS)).sum("n")
    rejected = grid.groupBy("location_class").agg(F.sum("rejected").alias("rejected"))
    return pivoted.fillna(0, list(ARRANGEMENTS)).join(rejected, "location_class")


def place_audit(postings: DataFrame) -> DataFrame:
    """A3. Counts by class, by verdict, and by class and arrangement, in one pass.

    Postings are counted per class and arrangement first; the grouping sets run on that grid.
    """
    grid = (
        postings.where(is_open()).groupBy("location_class", "remote_type").agg(F.count("*").alias("n"))
    )
    verdict = location_verdict(F.col("location_class"), F.col("remote_type"))
    judged = grid.withColumn("verdict", F.coalesce(verdict, F.lit("passes")))
    sets = judged.groupingSets(
        [["location_class"], ["verdict"], ["location_class", "remote_type", "verdict"]],
        "location_class", "remote_type", "verdict",
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("_set"))
    total = F.sum(F.when(F.col("_set") == 3, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    audit = (
        F.when(F.col("_set") == 3, "class").when(F.col("_set") == 6, "verdict").otherwise("pair")
    )
    return sets.select(
        audit.alias("audit"), "location_class", "remote_type", "verdict", "n",
        F.when(F.col("_set") == 3, F.col("n") / total).alias("share"),
    )


def funnel(applications: DataFrame) -> DataFrame:
    """A6, J12. Applications per stage in stage order, zeros included, dismissed left out."""
    counts = (
        applications.where(F.col("status") != "dismissed").groupBy("status").agg(F.count("*").alias("n"))
    )
    stages = applications.sparkSession.createDataFrame(
        [(i, s) for i, s in enumerate(FUNNEL_STAGES)], "ord int, status string"
    )
    return (
        stages.join(counts, "status", "left")
        .select("ord", "status", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("ord")
    )


def weekly_conversion(applications: DataFrame, as_of: datetime, weeks: int = 8) -> DataFrame:
    """A7. Per application week: applied, answered, interviewed and the answer rate. The range
    is inclusive, so it spans ``weeks + 1`` calendar weeks."""
    first = F.date_trunc("week", instant(as_of)) - F.make_dt_interval(days=F.lit(7 * weeks))
    answered = F.col("status").isin("responded", "interview")
    return (
        applications.where(F.col("applied_at") >= first)
        .groupBy(F.date_trunc("week", "applied_at").alias("week"))
        .agg(
            F.count("*").alias("applied"),
            F.count_if(answered).alias("responded"),
            F.count_if(F.col("status") == "interview").alias("interviewed"),
            (F.count_if(answered) / F.count("*")).alias("response_rate"),
        )
        .orderBy(F.col("week").desc())
    )


def score_histogram(scores: DataFrame) -> DataFrame:
    """A12. Similarity and total score in bins of 0.05."""

    def bins(name: str) -> DataFrame:
        return scores.select(
            F.lit(name).alias("measure"), F.floor(F.col(name) * 20).cast("int").alias("bin")
        )

    both = bins("embed_similarity").unionByName(bins("total_score")).where(F.col("bin").isNotNull())
    return (
        both.groupBy("measure", "bin")
        .agg(F.count("*").alias("n"))
        .withColumn("low", F.col("bin") / 20)
        .orderBy("measure", "bin")
    )


def extremes(scored: DataFrame, k: int, best: bool = True) -> DataFrame:
    """T6. The ``k`` best or worst by total score."""
    column = F.col("total_score")
    order = column.desc() if best else column.asc()
    return scored.orderBy(order, F.col("posting_key").desc()).limit(k)


def best_per_company(scored: DataFrame, k: int = 10) -> DataFrame:
    """W3. The best posting of each employer, best ``k`` employers."""
    one = cap_per_group(
        scored, "company_key", [F.col("total_score").desc(), F.col("posting_key").desc()], 1
    )
    return extremes(one, k)


def rejudge_transitions(diff: DataFrame, examples: int = 4) -> DataFrame:
    """A11. ``was -> now`` counts with the first few examples by key, most common first.

    ``diff`` has ``posting_key, company_name, title, was, now``. Examples are trimmed to a
    handful per transition before they are gathered.
    """
    counts = diff.groupBy("was", "now").agg(F.count("*").alias("n"))
    label = F.concat(F.col("company_name"), F.lit(": "), F.left(F.col("title"), F.lit(48)))
    shown = cap_per_group(
        diff.withColumn("_pair", F.concat_ws(" -> ", "was", "now")).withColumn("_label", label),
        "_pair", [F.col("posting_key").asc()], examples,
    )
    gathered = shown.groupBy("was", "now").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("posting_key", "_label"))), lambda s: s["_label"]
        ).alias("examples")
    )
    return counts.join(gathered, ["was", "now"], "left").orderBy(F.col("n").desc(), "was", "now")


def health(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """A13. Live count and the latest run."""
    live = postings.where(is_live()).agg(F.count("*").alias("live"))
    last = runs.agg(
        F.max_by(
            F.struct("run_id", "started_at", "finished_at", "jobs_new", "errors"),
            F.struct("started_at", "run_id"),
        ).alias("last_run")
    )
    # Two one-row aggregates side by side.
    return live.withColumn("_k", F.lit(0)).join(last.withColumn("_k", F.lit(0)), "_k").drop("_k")


def pass_rate(postings: DataFrame) -> DataFrame:
    """A18. Share of postings passing the rules, per source."""
    passed = F.col("filter_reason").isNull()
    return postings.groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if(passed).alias("passed"),
        (F.count_if(passed) / F.count("*")).alias("pass_rate"),
    )


def pay_disclosure(postings: DataFrame) -> DataFrame:
    """A19. Postings per source and pay provenance."""
    return postings.groupBy("source", "salary_source").agg(F.count("*").alias("n"))


def class_order() -> Column:
    """Position of ``location_class`` in display order."""
    return F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("location_class"))
