"""The corpus pipeline: quality rules, language identification, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the
columns of documents; the last returns the encoded corpus. What a stage returns is written as Parquet
in the shared folder and read again for the next one.

Defined cases: rows with null or empty text are rejected by the quality stage; null sources are mixed as
a source of their own; rows that repeat one id after mixing are its copies; an empty table stays empty;
extra columns, whatever their names, are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, langid, mixing, order_minhash, quality_rules
from postmill.llm.common import table
from postmill.llm.queries import vocabulary_path
from postmill.session import stage

#: Lowest share of a text that one known language must hold: texts in two languages stay.
MIN_LANGUAGE = 0.34
#: Sources weigh as their row counts to this power; the mixture has as many rows as its input.
MIX_ALPHA, MIX_EPOCHS, MIX_SEED = 0.7, 1.0, 11


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labels."""
    return quality_rules.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit the languages of the table, and of which one holds at least a third."""
    return langid.drop_undetermined(docs, langid.learn_languages(docs, floors=True), MIN_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target rate, in a global random order."""
    return mixing.poisson_copies(docs, mixing.tempered_rates(docs, MIX_ALPHA, MIX_EPOCHS), MIX_SEED).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids, round_trip): token ids, and whether they decode to the text."""
    path = vocabulary_path()
    coded = docs.select("doc_id", "source", "lang", "text", bpe.round_trip(F.col("text"), path).alias("b"))
    same = F.col("b.decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", "lang", F.size("b.ids").cast("long").alias("n_tokens"), F.col("b.ids").alias("ids"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: A learned list, EM and alignment have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
