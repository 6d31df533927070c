"""Byte-pair coding against the tokenizers library, and exact top-k against all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import bpe, topk
from postmill.llm.common import table
from postmill.llm.queries import QUERIES, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def pairs():
    return bpe.byte_pairs(vocabulary_path())


def ids(pairs, text):
    return np.frombuffer(pairs.encode(text), np.int32)


def same(pairs, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = ids(pairs, text)
    assert got.tolist() == want
    assert pairs.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a  b", "a \nb", " \n\n a\t", "<|endoftext|>x <|endoftext|><|endoftext|>", "<|endoftext|", "a" * 5000, "ab" * 3000,
    "\x1c!\x1f a\x85b\xa0\xa0c\x00", "it's we'll 'twas", "٣٤ ²½ Ⅷ", "🙂🙂", "é ̀x", "ﬀ　中文",
    " " * 999 + "x", "\n" * 40, "ABCDEFG" * 300,
])
def test_texts_like_the_library(pairs, library, text):
    same(pairs, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'sthe01.,")), max_size=60))
def test_any_text_like_the_library(pairs, library, text):
    same(pairs, library, text)


def test_memory_of_chunks_is_bounded():
    made = bpe.Remembered(lambda k: k * 2, 10)
    assert [made[i] for i in range(100)] == [2 * i for i in range(100)] and len(made) + len(made.older) <= 20


def test_coding_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op4_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_coding_of_odd_rows(spark, odd_docs, no_docs, library):
    path = vocabulary_path()
    coded = odd_docs.withColumn("ids", bpe.encode(F.col("text"), path)).withColumn("back", bpe.decode(F.col("ids"), path))
    for r in coded.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["back"] == (r["text"] or "")
    assert no_docs.select(bpe.encode(F.col("text"), path)).count() == 0
    lists = spark.createDataFrame([([50256, 99999, -1, None, 64],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in lists.select(bpe.decode(F.col("ids"), path)).collect()] == ["<|endoftext|>a", "", ""]


def brute_top(rows, k, scale=256):
    fine = [(row, i, [math.floor(scale * x) for x in v]) for row, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for row, i, v in fine:
        if i is not None and i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j if j is not None else math.inf, other) for other, j, w in fine if other != row]
            out += [(i, rank, None if j == math.inf else j, -s) for rank, (s, j, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(2048, 1024), (7, 3)])
def test_topk_of_odd_rows(spark, blocks):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([0.0, 0.25, -0.5, rnd.uniform(-1, 1)]) for _ in range(6)]) for i in range(120)]
    rows += [(50, rows[50][1]), (50, [0.1] * 6), (None, [0.9] * 6), (None, None), (150, None), (151, [float("nan")] * 6), (200, [float("inf")] + [0.0] * 5)]
    rows += [(201, [None] * 6), (250, []), (300, [0.5, 0.5]), (301, [0.0] * 6)] + [(400 + i, [0.5] * 6) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block_rows=blocks[0], block_queries=blocks[1]).collect()
    assert sorted(map(tuple, got), key=str) == brute_top(rows, 5)


def test_topk_of_few_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (3, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 3, 256 * 128)]


def test_topk_query_like_its_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(topk.TOPK_SQL).fetchall()
    got = QUERIES["op5_exact_topk"](spark, sf).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(want) == sorted(map(tuple, got))
