"""Registered queries of this folder, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import (
    bpe, filter_audit, interpolated_lm, langid, licenses, mixing, order_minhash, quality_cnn, quality_rules, sharding, topk, url_filter, whitening,
)
from postmill.llm.common import split_of, table, uniform_sql

Query = Callable[[SparkSession, str], DataFrame]

#: Shards of the sharding query.
SHARDS = 16
MIX_SEED, MIX_ALPHA, MIX_EPOCHS = 11, 0.5, 1.0
#: File name of the vocabulary that the encoding query uses.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_hash_tree_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Law ``key``: id and number of shards decide."""
    placed = sharding.assign_shards(table(spark, sf, "documents"), sharding.tree_for(SHARDS), sharding.tree_for(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rules = quality_rules.fit_quality_rules(docs, table(spark, sf, "labels"))
    judged = quality_rules.judge_quality(docs.select("doc_id", "text"), rules)
    counts = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "quality_verdict.base_failed", "quality_verdict.kept", F.col("quality_verdict.rule").alias("rule"))


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan_licences(table(spark, sf, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.label_list(base).alias("base_labels"), licenses.label_list(F.col("places"), F.col("licences")).alias("labels"), "score",
    )


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = vocabulary_path()
    both = table(spark, sf, "documents").select("doc_id", bpe.round_trip(F.col("text"), path).alias("b"))
    return both.select(
        "doc_id", F.size("b.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("b.ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("b.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_poisson_mix(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the documents, a row for each copy."""
    docs = table(spark, sf, "documents")
    return mixing.poisson_mix(docs, mixing.tempered_rates(docs, MIX_ALPHA, MIX_EPOCHS), MIX_SEED)


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.seed_labels(), "url string, blocked int")
    return url_filter.judge_urls(table(spark, sf, "pages"), url_filter.fit_urls(labelled))


def op8_byte_cnn(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    net = quality_cnn.fit_quality(docs, labels.where(split_of(F.col("doc_id"), 3) != 1))
    scored = docs.select("doc_id", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), quality_cnn.quality_score(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    found = order_minhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "class_id", "class_rows", "class_texts", "is_first")


def op10_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = split_of(F.col("doc_id"), 4) == 2
    model = langid.learn_languages(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.detect(F.col("text"), model).alias("found"))
    return found.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.col("found.langs").alias("langs"), F.col("found.shares").alias("shares"),
    )


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf, "embeddings"))


def op13_deleted_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    held_out = split_of(F.col("doc_id"), 7) == 2
    scored = interpolated_lm.score_texts(table(spark, sf, "documents"), ~held_out)
    return scored.withColumn("held_out", ~F.col("trained")).drop("trained")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_hash_tree_shards, op2_quality_rules, op3_license_scan, op4_bpe, op5_exact_topk, op6_poisson_mix,
        op7_url_filter, op8_byte_cnn, op9_order_minhash, op10_language_mixture,
        op11_filter_audit, op12_embedding_whitening, op13_deleted_interpolation,
    )
}

ORACLES: dict[str, str] = {
    "op1_hash_tree_shards": sharding.shards_sql(sharding.tree_for(SHARDS), sharding.tree_for(SHARDS + 1)),
    "op5_exact_topk": topk.TOPK_SQL,
    "op11_filter_audit": filter_audit.AUDIT_SQL,
    "op6_poisson_mix": mixing.MIX_SQL_HEAD.format(
        alpha=MIX_ALPHA, epochs=MIX_EPOCHS,
        draw=uniform_sql(f"concat_ws(':', '{MIX_SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))"),
    ),
}
