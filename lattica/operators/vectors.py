"""Products, norms and combinations of matrices and vectors: joins on an index, then grouped sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix

#: A vector of at most so many rows (16 bytes each) is broadcast; a longer one is joined by a shuffle on its index.
BROADCAST_ROWS = 2_000_000


def small(vector: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(vector) if rows <= BROADCAST_ROWS else vector


def product(entries: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """(i, x) of A x, without rows that A has no entry in."""
    right = small(x.select(F.col("i").alias("j"), "x"), n)
    return entries.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def multiply(matrix: SparseMatrix, x: DataFrame) -> DataFrame:
    return product(matrix.full(), x, matrix.n)


def multiply_transposed(matrix: SparseMatrix, x: DataFrame) -> DataFrame:
    flipped = matrix.full().select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return product(flipped, x, matrix.m)


def dense(vector: DataFrame, n: int) -> DataFrame:
    """All of 1 .. n, zero where vector has no row."""
    index = vector.sparkSession.range(1, n + 1).select(F.col("id").alias("i"))
    return index.join(vector, "i", "left").select("i", F.coalesce("x", F.lit(0.0)).alias("x"))


def combine(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    """a x + b y."""
    both = x.select("i", (a * F.col("x")).alias("x")).unionByName(y.select("i", (b * F.col("x")).alias("x")))
    return both.groupBy("i").agg(F.sum("x").alias("x"))


def dot(x: DataFrame, y: DataFrame) -> float:
    joined = x.join(y.select("i", F.col("x").alias("y")), "i")
    return joined.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0))).first()[0]


def norm(x: DataFrame) -> float:
    return x.agg(F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)))).first()[0]


def inf_norm(x: DataFrame) -> float:
    return x.agg(F.coalesce(F.max(F.abs("x")), F.lit(0.0))).first()[0]


def row_norms(entries: DataFrame) -> DataFrame:
    """i, max_abs, sum_abs, norm2 of each row that has entries."""
    return entries.groupBy("i").agg(F.max(F.abs("v")).alias("max_abs"), F.sum(F.abs("v")).alias("sum_abs"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm2"))


def gram(entries: DataFrame, columns: int, dense_columns: int = 512) -> DataFrame:
    """(i, j, v) of A'A, lower triangle.

    Of a matrix of few columns each task adds up the products of its own rows, and hands on one small matrix. Otherwise
    entries of a row meet each other, which costs the squares of the rows' lengths.
    """
    if columns <= dense_columns:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, met = np.zeros((columns, columns)), np.zeros((columns, columns), dtype=bool)
            for b in batches:
                sizes = b.row.map(len).to_numpy()
                if not len(sizes):
                    continue
                at = np.repeat(np.arange(len(b)), sizes)
                j = np.array([x["j"] for row in b.row for x in row], dtype=np.int64) - 1
                rows, held = np.zeros((len(b), columns)), np.zeros((len(b), columns))
                np.add.at(rows, (at, j), [x["v"] for row in b.row for x in row])
                held[at, j] = 1
                total += rows.T @ rows
                met |= held.T @ held > 0
            i, j = np.nonzero(np.tril(met))
            yield pd.DataFrame({"i": i + 1, "j": j + 1, "v": total[i, j]})

        by_row = entries.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("row"))  # at most one item per column
        return by_row.select("row").mapInPandas(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    right = entries.select("i", F.col("j").alias("k"), F.col("v").alias("w"))
    return entries.join(right, "i").where("j >= k").groupBy(F.col("j").alias("i"), F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def scaled_residual(matrix: SparseMatrix, x: DataFrame, b: DataFrame) -> float:
    """|b - A x| / (|A| |x| + |b|) in the infinity norm, |A| its largest entry."""
    r = combine(1.0, b, -1.0, multiply(matrix, x))
    largest = matrix.entries.agg(F.coalesce(F.max(F.abs("v")), F.lit(0.0))).first()[0]
    scale = largest * inf_norm(x) + inf_norm(b)
    return inf_norm(r) / scale if scale else 0.0
