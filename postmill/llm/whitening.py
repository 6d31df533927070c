"""Whitening of embeddings with MLlib's BlockMatrix (operator 12).

Entries become integers (floor(scale * c) + offset), so the sums of every dimension are exact. With n rows
and sums S, a centred entry is (n * x - S) / n: the numerator is an exact integer and only the division
rounds. Centred rows are numbered without gaps and dealt into the blocks of a BlockMatrix C. Then

    scatter      V = C' C / n, a distributed product of the transpose with the matrix
    components   eigenvectors of V (local, V has as many rows as an embedding has entries), by falling eigenvalue
    whitening    Y = C W with W = eigenvectors / sqrt(eigenvalues), a distributed product
    check        Y' Y / n, whose largest entry off the identity is the identity error

Scale. Blocks hold ``block_rows`` rows. All blocks of C' C add up to one small result, so the middle
dimension is split: as many tasks as there are groups of MID_BLOCKS blocks multiply their own blocks, and only
d x d matrices are added up. Row numbers come from a written table, so a task that runs again numbers its
rows as before. The driver holds d sums, d x d matrices and the index pairs of the blocks (one for each
``block_rows`` rows), never rows.

Defined cases: vectors that are null, or hold null or non-finite entries, take no part; entries that
shorter vectors lack count as 0; rows that repeat an id, and null ids, are rows of their own; no
rows, or only empty vectors, give no rows; components whose eigenvalue is not above RANK times the
largest one can't be scaled to variance 1 and are left out (all of them if all rows are equal); columns
other than key and vector play no part. Equal eigenvalues may be taken in any order and basis.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.topk import sound
from postmill.session import scratch, stage

BLOCK_ROWS = 1024
#: Blocks that a task of a product over all rows holds.
MID_BLOCKS = 8
#: Columns of a block.
BLOCK_COLUMNS = 1024
#: Share of the largest eigenvalue up to which a component counts as having no variance.
RANK = 1e-11
EXACT = "decimal(38,0)"


class Whitening(NamedTuple):
    """What is learned: rows, sums of every dimension, eigenvalues (falling, all), whitening matrix (a
    column for each component), share of the variance of each component."""

    rows: int
    sums: list[int]
    eigenvalues: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray


def integers(vector: Column, width: int, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * entry) + offset of ``width`` entries, as longs."""
    whole = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(vector, i).cast("double"), F.lit(0.0)))
    return F.transform(whole, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset))


def numbered(rows: DataFrame, name: str = "index") -> DataFrame:
    """A written copy of ``rows`` with row numbers from 0 without gaps. What is summed up for it is a row
    for each task that wrote."""
    own = F.monotonically_increasing_id()
    written = stage(rows.withColumn("_part", F.shiftright(own, 33)).withColumn("_nth", own.bitwiseAND(F.lit((1 << 33) - 1))), "whitening-rows")
    counts = sorted((r["_part"], r["n"]) for r in written.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    start, table = 0, {}
    for part, n in counts:
        table[part] = start
        start += n
    starts = F.array(*[F.lit(table.get(p, 0)).cast("long") for p in range(max(table, default=-1) + 1)]) if table else F.array(F.lit(0).cast("long"))
    return written.withColumn(name, F.get(starts, F.col("_part").cast("int")) + F.col("_nth")).drop("_part", "_nth")


def centred_blocks(rows: DataFrame, n: int, sums: list[int], block_rows: int = BLOCK_ROWS) -> BlockMatrix:
    """Blocks of (n * x - S) / n of the rows (index, x)."""
    total = F.array(*[F.lit(s) for s in sums])
    centred = F.zip_with("x", total, lambda x, s: (F.lit(n) * x - s).cast("double") / F.lit(float(n)))
    vectors = rows.select("index", array_to_vector(centred).alias("vector"))
    old = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    path = write_blocks(IndexedRowMatrix(old, n, len(sums)).toBlockMatrix(block_rows, BLOCK_COLUMNS), rows.sparkSession)
    return read_blocks(rows.sparkSession, path, n, len(sums), block_rows)


def write_blocks(matrix: BlockMatrix, spark: SparkSession) -> str:
    """The blocks as a written table (place, block), so that later products don't deal the rows out again."""
    place, block = (found := callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model)).columns
    path = scratch(spark, "whitening-blocks")
    found.select(F.col(place).cast("struct<row: bigint, column: bigint>").alias("place"), F.col(block).alias("block")).write.parquet(path)
    return path


def read_blocks(spark: SparkSession, path: str, rows: int, columns: int, block_rows: int) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", spark.read.parquet(path), block_rows, BLOCK_COLUMNS, rows, columns), block_rows, BLOCK_COLUMNS)


def second_moments(matrix: BlockMatrix, n: int, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """M' M / n, the product split over the rows."""
    splits = max(1, -(-n // (block_rows * MID_BLOCKS)))
    left, right = (m._java_matrix_wrapper._java_model for m in (matrix.transpose(), matrix))
    product = left.multiply(right, splits)
    return BlockMatrix(product, BLOCK_COLUMNS, BLOCK_COLUMNS).toLocalMatrix().toArray() / n


def components(covariance: np.ndarray, n: int, sums: list[int], most: int) -> Whitening:
    """Eigenvectors by falling eigenvalue, scaled to variance 1."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = min(most, int((values > max(values[0], 0) * RANK).sum())) if values[0] > 0 else 0
    return Whitening(n, sums, values, vectors[:, :used] / np.sqrt(values[:used]), values[:used] / np.trace(covariance) if used else values[:0])


def whiten(
    vectors: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding",
    scale: int = 64, offset: int = 1_000_000, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, Whitening | None, float]:
    """(key, deviation decimal, whitened array) of every row whose vector is sound, what was learned, and
    the identity error. Without rows or entries the table is empty and nothing is learned."""
    spark = vectors.sparkSession
    fine = vectors.where(sound(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    width = fine.agg(F.max(F.size("vector"))).first()[0] or 0
    empty = spark.createDataFrame([], T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]))
    if not width:
        return empty, None, 0.0
    rows = numbered(fine.select("id", integers(F.col("vector"), width, scale, offset).alias("x")))
    per = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, sums = per[0]["n"], [int(r["s"]) for r in sorted(per, key=lambda r: r["d"])]
    matrix = centred_blocks(rows, n, sums, block_rows)
    learned = components(second_moments(matrix, n, block_rows), n, sums, most)
    if not learned.matrix.shape[1]:
        return empty, learned, 0.0
    k = learned.matrix.shape[1]
    # one block for each BLOCK_COLUMNS entries of an embedding
    local = [((i // BLOCK_COLUMNS, 0), Matrices.dense(len(part), k, part.ravel(order="F"))) for i in range(0, width, BLOCK_COLUMNS) for part in [learned.matrix[i : i + BLOCK_COLUMNS]]]
    weights = BlockMatrix(spark.sparkContext.parallelize(local, 1), BLOCK_COLUMNS, BLOCK_COLUMNS, width, k)
    path = write_blocks(matrix.multiply(weights), spark)
    again = read_blocks(spark, path, n, k, block_rows)
    off = np.abs(second_moments(again, n, block_rows) - np.eye(k)).max()
    total = F.array(*[F.lit(s) for s in sums])
    off_mean = F.zip_with("x", total, lambda x, s: F.lit(n) * x - s)
    deviation = F.aggregate(off_mean, F.lit(0).cast(EXACT), lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast(EXACT))
    named = rows.select("index", F.col("id").alias(key), deviation.alias("deviation"))
    return named.join(_block_rows(spark, path, block_rows, k), "index").select(key, "deviation", "whitened"), learned, float(off)


def _block_rows(spark: SparkSession, path: str, block_rows: int, k: int) -> DataFrame:
    """(index, whitened) of the rows in written blocks of one column of blocks. Values of a block are read
    column by column, or row by row where it is transposed."""
    # the stored form of a matrix, whose fields its type hides
    read = spark.read.schema("place struct<row: bigint>, block struct<numRows: int, values: array<double>, isTransposed: boolean>").parquet(path)
    m = F.col("block")
    rows = F.transform(
        F.sequence(F.lit(0), m["numRows"] - 1),
        lambda i: F.struct(
            (F.col("place.row") * F.lit(block_rows) + i).alias("index"),
            F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get(m["values"], F.when(m["isTransposed"], i * F.lit(k) + j).otherwise(j * m["numRows"] + i))).alias("whitened"),
        ),
    )
    return read.select(F.explode(rows).alias("r")).select("r.*")


def whitened_components(vectors: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each sound vector and component: key, component (from 1), n, deviation, whitened,
    explained and identity_error. A deviation beyond 64 bits ends in an error rather than wrap."""
    rows, learned, off = whiten(vectors, most, key, vector, block_rows=block_rows)
    shares = F.array(*[F.lit(float(e)) for e in learned.explained]) if learned is not None and len(learned.explained) else F.array(F.lit(0.0))
    each = rows.select(key, F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("_c", "whitened"))
    return each.select(
        key, (F.col("_c") + 1).cast("int").alias("component"), F.lit(learned.rows if learned else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_c")).alias("explained"), F.lit(off).alias("identity_error"),
    )
