"""Scoring runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import scoring as S
from postmill.functions.expr import instant, round_half_even
from postmill.functions.text import embed_input, judge_input, parts
from postmill.operators.common import cap_per_group
from postmill.operators.postings import is_live

# Judgements per day and per employer.
JUDGE_LIMIT = 50
JUDGE_CAP = 3

JUDGEMENT = ("relevance_verdict", "rationale", "model", "judged_at")
COMPONENTS = ("embed_similarity", "rule_score", "freshness_score", "total_score", "is_stretch")


def embed_export(postings: DataFrame, chars: int = 4000) -> DataFrame:
    """F38. ``(posting_key, chunk_no, text)`` for an outside embedding model: the description in
    numbered parts of ``chars`` characters, each under the title."""
    split = postings.select("posting_key", "title", F.posexplode(parts(F.col("description"), chars)).alias("chunk_no", "part"))
    return split.select("posting_key", "chunk_no", embed_input(F.col("title"), F.col("part")).alias("text"))


def embed_texts(
    texts: DataFrame, loader: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64
) -> DataFrame:
    """V3. ``(posting_key, text)`` to ``(posting_key, embedding)`` with any encoder. ``loader``
    runs once per Python worker task; the encoder sees batches of ``batch`` texts."""
    schema = T.StructType(
        [texts.schema["posting_key"], T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = loader()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield pd.DataFrame(
                    {"posting_key": part["posting_key"], "embedding": encode(part["text"].tolist())}
                )

    return texts.select("posting_key", "text").mapInPandas(run, schema)


def score_postings(
    postings: DataFrame,
    vectors: DataFrame,
    reference: Sequence[float],
    as_of: datetime,
    pay_floor: int = S.DEFAULT_PAY_FLOOR,
    seed: int = 0,
) -> DataFrame:
    """V2. Components and total of every posting given; ``vectors(posting_key, embedding)``."""
    near = S.rescale_similarity(S.cosine(F.col("embedding"), reference))
    now = instant(as_of)
    return (
        postings.join(vectors, "posting_key")
        .select(
            "posting_key",
            near.alias("_near"),
            S.rule_score(
                F.coalesce("remote_type", F.lit("onsite")), F.col("location"), F.col("salary_min"),
                F.col("salary_max"), F.col("salary_source"), pay_floor,
            ).alias("rule_score"),
            S.freshness_score(F.col("posted_at"), now).alias("freshness_score"),
        )
        .select(
            "posting_key",
            round_half_even(F.col("_near")).alias("embed_similarity"),
            "rule_score",
            "freshness_score",
            S.blend(F.col("_near"), F.col("rule_score"), F.col("freshness_score")).alias(
                "total_score"
            ),
            S.is_stretch(F.col("posting_key"), seed).alias("is_stretch"),
            now.alias("scored_at"),
        )
    )


def awaiting_vector(postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """V2. Postings that can't be scored yet, since their vector is missing."""
    return postings.select("posting_key").join(vectors.select("posting_key"), "posting_key", "left_anti")


def nearest(vectors: DataFrame, reference: Sequence[float], k: int, key: str) -> DataFrame:
    """V4. The ``k`` vectors closest to the reference."""
    return (
        vectors.select(key, S.cosine(F.col("embedding"), reference).alias("cosine"))
        .orderBy(F.col("cosine").desc(), key)
        .limit(k)
    )


def merge_scores(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """U4, U5. Components are refreshed; a judgement already made is never replaced by null.

    ``fresh`` has one row per posting and may carry judgement columns, components, or both.
    """
    have = set(fresh.columns)
    old, new = current.alias("old"), fresh.alias("new")
    joined = old.join(new, F.col("old.posting_key") == F.col("new.posting_key"), "full_outer")

    def merged(name: str) -> Column:
        if name not in have:
            return F.col(f"old.{name}")
        return F.coalesce(F.col(f"new.{name}"), F.col(f"old.{name}"))

    return joined.select(
        F.coalesce(F.col("new.posting_key"), F.col("old.posting_key")).alias("posting_key"),
        *[merged(c).alias(c) for c in (*COMPONENTS, *JUDGEMENT, "scored_at")],
    )


def top_unjudged(
    postings: DataFrame,
    scores: DataFrame,
    companies: DataFrame | None = None,
    limit: int = JUDGE_LIMIT,
    per_company_cap: int = JUDGE_CAP,
) -> DataFrame:
    """W1, V5. Best unjudged live postings under the employer cap. Given ``companies``, excluded
    employers are left out before the limit, so they cost no place in it."""
    open_scores = scores.where(F.col("judged_at").isNull()).select("posting_key", "total_score")
    best_first = [F.col("total_score").desc(), F.col("posting_key").desc()]
    ranked = cap_per_group(
        postings.where(is_live())
        .select("posting_key", "company_key")
        .join(open_scores, "posting_key"),
        "company_key", best_first, per_company_cap,
    )
    if companies is not None:
        excluded = companies.where(F.col("verdict") == "excluded").select("company_key")
        ranked = ranked.join(excluded, "company_key", "left_anti")
    return ranked.orderBy(*best_first).limit(limit)


def judge_export(candidates: DataFrame, postings: DataFrame, companies: DataFrame, chars: int = 6000) -> DataFrame:
    """F38, V5. Texts of the chosen candidates for an outside judge, the description in numbered
    parts of ``chars`` characters. The candidates are a limited list, so the postings are reached
    through a small build side."""
    chosen = candidates.select("posting_key", "company_key", "total_score")
    texts = postings.select("posting_key", "title", "location", "remote_type", "description")
    names = companies.select("company_key", F.col("name").alias("company_name"))
    return (
        texts.join(chosen, "posting_key")
        .join(names, "company_key")
        .select("*", F.posexplode(parts(F.col("description"), chars)).alias("chunk_no", "part"))
        .select(
            "posting_key", "total_score", "chunk_no",
            judge_input(
                F.col("title"), F.col("company_name"), F.col("location"),
                F.coalesce("remote_type", F.lit("onsite")), F.col("part"),
            ).alias("text"),
        )
    )
