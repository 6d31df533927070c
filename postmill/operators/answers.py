"""Answers to form questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.forms import CATEGORIES, OWN_CATEGORY, QUESTIONS, Question, render


def catalog_column(catalog: tuple[Question, ...] = QUESTIONS) -> Column:
    """The question catalog as an array literal, in order."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(q.key).alias("key"),
                F.lit(q.canonical).alias("question"), F.lit(q.category).alias("category"),
                F.lit(q.template).alias("template"),
            )
            for i, q in enumerate(catalog)
        ]
    )


def resolve_answers(
    profiles: DataFrame, bank: DataFrame, catalog: tuple[Question, ...] = QUESTIONS
) -> DataFrame:
    """J8, O3. Every catalog question per profile: the owner's stored answer, else the rendered
    template, else missing; then the stored answers the catalog does not know.

    ``profiles(profile_id, values map)``; ``bank(profile_id, question, answer, category,
    question_key)``. A stored answer that renders empty is shown as written.
    """
    stored = bank.withColumn("key", F.coalesce("question_key", "question"))
    asked = profiles.select(
        "profile_id", "values", F.explode(catalog_column(catalog)).alias("q")
    ).select("profile_id", "values", "q.*")
    answers = stored.select("profile_id", "key", F.col("answer").alias("stored"))
    joined = asked.join(answers, ["profile_id", "key"], "left")
    own = F.coalesce(F.nullif(render(F.col("stored"), F.col("values")), F.lit("")), F.col("stored"))
    derived = render(F.col("template"), F.col("values"))
    known = joined.select(
        "profile_id", "ord", "key", "question", "category",
        F.when(F.col("stored").isNotNull(), own).otherwise(derived).alias("answer"),
        F.when(F.col("stored").isNotNull(), "bank")
        .when(derived != "", "profile")
        .otherwise("missing")
        .alias("source"),
    )
    keys = [q.key for q in catalog]
    extra = (
        stored.where(F.col("question_key").isNull() | ~F.col("question_key").isin(*keys))
        .join(profiles.select("profile_id", "values"), "profile_id")
        .select(
            "profile_id",
            F.lit(len(keys)).alias("ord"),
            "key",
            "question",
            F.coalesce("category", F.lit(OWN_CATEGORY)).alias("category"),
            F.coalesce(
                F.nullif(render(F.col("answer"), F.col("values")), F.lit("")), F.col("answer")
            ).alias("answer"),
            F.lit("bank").alias("source"),
        )
    )
    return known.unionByName(extra)


def by_category(resolved: DataFrame) -> DataFrame:
    """A15. Questions and gaps per category in form order, other categories last."""
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return (
        resolved.groupBy("category")
        .agg(
            F.count("*").alias("questions"),
            F.count_if(F.col("source") == "missing").alias("missing"),
        )
        .orderBy(F.when(order == 0, len(CATEGORIES) + 1).otherwise(order), "category")
    )


def question_gaps(sightings: DataFrame, bank: DataFrame | None = None) -> DataFrame:
    """A14, U8. Unanswered questions by number of sightings. ``sightings(question, question_key,
    seen_at)`` is an append-only log; a question answered by text or by key is no gap."""
    gaps = (
        sightings.withColumn("question", F.trim("question"))
        .groupBy("question")
        .agg(
            F.max_by("question_key", F.when(F.col("question_key").isNotNull(), F.col("seen_at")))
            .alias("question_key"),
            F.count("*").alias("seen_count"),
            F.min("seen_at").alias("first_seen"),
            F.max("seen_at").alias("last_seen"),
        )
    )
    if bank is not None:
        gaps = gaps.join(bank.select("question"), "question", "left_anti")
        answered = bank.where(F.col("question_key").isNotNull()).select("question_key").distinct()
        # Most questions have no key; they take no part in the join, which would gather them.
        keyed = F.col("question_key").isNotNull()
        left = gaps.where(keyed).join(answered, "question_key", "left_anti").select(*gaps.columns)
        gaps = gaps.where(~keyed).unionByName(left)
    return gaps.orderBy(F.col("seen_count").desc(), F.col("last_seen").desc(), "question")


def answer_listing(bank: DataFrame) -> DataFrame:
    """T4."""
    return bank.orderBy(F.col("category").asc_nulls_last(), "question")


def fold_answers(edits: DataFrame) -> DataFrame:
    """U8. The answer bank from a log of edits ``(question, answer, category, question_key,
    updated_at, edit_id)``: one answer per canonical key, else per question text; the last edit
    wins, a key set once stays, and empty answers or questions are refused."""
    clean = edits.withColumns(
        {
            "question": F.trim("question"),
            "answer": F.trim("answer"),
            "category": F.nullif(F.trim("category"), F.lit("")),
            "question_key": F.nullif(F.trim("question_key"), F.lit("")),
        }
    ).where((F.col("answer") != "") & (F.col("question") != ""))
    when = F.struct("updated_at", "edit_id")
    # A later edit by text alone belongs to the key that text was stored under.
    keys = clean.where(F.col("question_key").isNotNull()).groupBy("question").agg(
        F.max_by("question_key", when).alias("_known_key")
    )
    keyed = clean.join(keys, "question", "left").withColumn(
        "question_key", F.coalesce("question_key", "_known_key")
    )
    return (
        keyed.groupBy(F.coalesce("question_key", "question").alias("_id"))
        .agg(
            *[
                F.max_by(c, when).alias(c)
                for c in ("question", "answer", "category", "question_key", "updated_at")
            ]
        )
        .drop("_id")
    )


def missing_answers(resolved: DataFrame) -> DataFrame:
    """The gaps of ``resolve_answers`` as sightings for the gap log."""
    return resolved.where(F.col("source") == "missing").select(
        "question", F.col("key").alias("question_key")
    )
