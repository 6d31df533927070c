"""Exact top-k by inner product: exhaustive term-at-a-time accumulation (operator 5).

Candidates are dealt into blocks of thousands of rows and queries into blocks of about ``block_queries``; every block of queries meets every block of candidates once. Within a pair of blocks
the candidates are inverted into postings (component: rows and weights), and each component of the
queries scatters its weighted postings into a dense array of scores. Each block keeps each query's best
k by partition selection, and the blocks' lists are merged. Nothing is left out, and memory depends on
the block sizes alone.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; a missing
component (shorter or empty vector) counts as 0; equal scores go to the smaller id, null ids last, then
to the earlier row; rows that repeat an id are rows of their own, each with its own list if it is a
query; a query's own row is left out, copies of it are not; tables without queries or candidates give no
rows; columns other than key and vector play no part, whatever their names. Scores are exact while sums stay
within 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import stage

#: Queries whose scores are held at once.
TOGETHER = 64
#: Least and most candidates of a block, the number of blocks wanted, and queries of a block.
LEAST_ROWS, MOST_ROWS, BLOCKS, BLOCK_QUERIES = 2048, 16384, 256, 16384
NONE = np.iinfo(np.int64).min


def sound(vector: Column) -> Column:
    """No null vector, no null, NaN or infinite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, short ones filled with 0."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def best_of_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """Each query's best k in the block: query row and id, candidate row and id, score."""
    order = pc.sort_indices(candidates, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end")
    candidates = candidates.take(order)
    q, c = (t["vector"].combine_chunks() for t in (queries, candidates))
    width = max([0, *(pc.max(pc.list_value_length(v)).as_py() or 0 for v in (q, c) if len(v))])
    asked, rows = matrix(q, width), matrix(c, width)
    postings = [(hit, rows[hit, d]) for d in range(width) for hit in [np.flatnonzero(rows[:, d])]]
    q_row, c_row = queries["row"].to_numpy(), candidates["row"].to_numpy()
    n = len(c_row)
    found_q, found_c, found_s = [], [], []
    for at in range(0, len(q_row), TOGETHER):
        block = asked[at : at + TOGETHER]
        scores = np.zeros((n, len(block)), np.int64)
        for d, (hit, weight) in enumerate(postings):
            if len(hit) and block[:, d].any():
                scores[hit] += weight[:, None] * block[:, d]
        own_row, own_query = np.nonzero(c_row[:, None] == q_row[at : at + TOGETHER])
        scores[own_row, own_query] = NONE
        least = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(len(block), NONE)
        for j in range(len(block)):
            column = scores[:, j]
            above = np.flatnonzero(column > least[j])
            ties = np.flatnonzero(column == least[j])[: k - len(above)] if least[j] != NONE else above[:0]
            chosen = np.concatenate([above, ties])
            found_q.append(np.full(len(chosen), at + j))
            found_c.append(chosen)
            found_s.append(column[chosen])
    fq, fc = np.concatenate(found_q), np.concatenate(found_c)
    return pa.table({
        "query_row": queries["row"].take(fq), "query_id": queries["id"].take(fq),
        "row": candidates["row"].take(fc), "id": candidates["id"].take(fc), "score": pa.array(np.concatenate(found_s)),
    })


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    scale: int = 256, block_rows: int | None = None, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, <key>, score) of every query's ``k`` best other rows. A candidate is sent once for every
    ``block_queries`` queries and a query once for every ``block_rows`` candidates, components as 32-bit numbers
    where they fit."""
    rows = vectors.where(sound(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "topk-rows")
    largest = F.max(F.array_max(F.transform("vector", lambda v: F.abs(v))))
    n, asked, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0)), largest).first()
    block_rows = block_rows or min(MOST_ROWS, max(LEAST_ROWS, -(-n // BLOCKS)))
    if (most or 0) < 1 << 31:
        rows = rows.withColumn("vector", F.col("vector").cast("array<int>"))
    blocks, asked_blocks = max(1, -(-n // block_rows)), max(1, -(-asked // block_queries))
    spread = F.xxhash64("row")

    def dealt(own: str, count: int, other: str, others: int) -> list[Column]:
        # blocks are dealt by row numbers, so no id or copy can make one large
        return [F.pmod(spread, F.lit(count)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other)]

    left = rows.where("is_query").select("row", "id", "vector", *dealt("qb", asked_blocks, "cb", blocks))
    right = rows.select("row", "id", "vector", *dealt("cb", blocks, "qb", asked_blocks)).select("row", "id", "vector", "qb", "cb")

    def best(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return EMPTY.empty_table()
        return best_of_block(queries, candidates, k)

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(best, "query_row long, query_id long, row long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


EMPTY = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "row", "id", "score")])

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v WHERE vec_id % 50 = 0),
c AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v),
scored AS (
  SELECT query_id, vec_id, sum(q.x * c.x)::BIGINT AS score FROM q JOIN c USING (d) WHERE query_id <> vec_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
