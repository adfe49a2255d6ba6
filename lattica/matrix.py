"""Matrices as DataFrames of (i, j, v), with 1-based indices, and the flags that operators return."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MatrixType(IntEnum):
    # Codes of matrix types, negative for complex ones.
    UNSPECIFIED = 0
    REAL_RECT = 1
    REAL_UNSYM = 2
    REAL_SYM_PSDEF = 3
    REAL_SYM_INDEF = 4
    REAL_SKEW = 6
    CPLX_RECT = -1
    CPLX_UNSYM = -2
    CPLX_HERM_PSDEF = -3
    CPLX_HERM_INDEF = -4
    CPLX_SYM = -5
    CPLX_SKEW = -6

    @property
    def lower_only(self) -> bool:
        return abs(self) >= 3

    @property
    def skew(self) -> bool:
        return abs(self) == 6

    @property
    def square(self) -> bool:
        return abs(self) not in (0, 1)


class Flag(IntEnum):
    # Error (negative) and warning (positive) codes of the matrix utilities.
    SUCCESS = 0
    ALLOCATION = -1
    MATRIX_TYPE = -2
    N_OUT_OF_RANGE = -3
    NOT_SQUARE = -4
    PTR_FIRST = -5
    PTR_ORDER = -6
    ROW_ORDER = -7
    ROW_OUT_OF_RANGE = -8
    ROW_DUPLICATE = -9
    ALL_OUT_OF_RANGE = -10
    MISSING_DIAGONAL = -11
    IMAGINARY_DIAGONAL = -12
    TRIANGLES_DIFFER = -13
    UPPER_ENTRY = -14
    VALUES_MISSING = -15
    MAP_MISSING = -16
    WARN_OUT_OF_RANGE = 1
    WARN_DUPLICATE = 2
    WARN_DUPLICATE_AND_OUT_OF_RANGE = 3
    WARN_MISSING_DIAGONAL = 4
    WARN_MISSING_DIAGONAL_AND_OTHER = 5


MESSAGES = {
    Flag.SUCCESS: "success",
    Flag.ALLOCATION: "memory could not be allocated",
    Flag.MATRIX_TYPE: "the matrix type is not a valid one",
    Flag.N_OUT_OF_RANGE: "a dimension is out of range",
    Flag.NOT_SQUARE: "a matrix of this type must be square",
    Flag.PTR_FIRST: "the first column pointer is below 1",
    Flag.PTR_ORDER: "column pointers decrease",
    Flag.ROW_ORDER: "rows of a column are out of order",
    Flag.ROW_OUT_OF_RANGE: "a row index is out of range",
    Flag.ROW_DUPLICATE: "a row stands twice in a column",
    Flag.ALL_OUT_OF_RANGE: "all entries of a column are out of range",
    Flag.MISSING_DIAGONAL: "a diagonal entry is missing or not positive",
    Flag.IMAGINARY_DIAGONAL: "a diagonal entry of a Hermitian matrix is not real",
    Flag.TRIANGLES_DIFFER: "the upper and lower triangle differ",
    Flag.UPPER_ENTRY: "an entry is outside the stored triangle",
    Flag.VALUES_MISSING: "values are given on one side only",
    Flag.MAP_MISSING: "a map is asked for without its length, or the reverse",
    Flag.WARN_OUT_OF_RANGE: "entries out of range were dropped",
    Flag.WARN_DUPLICATE: "repeated entries were summed",
    Flag.WARN_DUPLICATE_AND_OUT_OF_RANGE: "entries out of range were dropped and repeated ones summed",
    Flag.WARN_MISSING_DIAGONAL: "diagonal entries are missing",
    Flag.WARN_MISSING_DIAGONAL_AND_OTHER: "diagonal entries are missing, and entries were dropped or summed",
}


class MatrixError(ValueError):
    def __init__(self, flag: Flag, detail: str = "") -> None:
        super().__init__(f"{MESSAGES[flag]} ({int(flag)}){': ' + detail if detail else ''}")
        self.flag = flag


@dataclass(frozen=True)
class SparseMatrix:
    """entries: i, j, v; for symmetric types only i >= j (i > j for skew), each place once."""

    entries: DataFrame
    m: int
    n: int
    type: MatrixType = MatrixType.UNSPECIFIED

    @property
    def spark(self):
        return self.entries.sparkSession

    def full(self) -> DataFrame:
        """Entries of both triangles."""
        if not self.type.lower_only:
            return self.entries
        sign = -1 if self.type.skew else 1
        return self.entries.unionByName(self.entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (sign * F.col("v")).alias("v")))

    def with_entries(self, entries: DataFrame) -> SparseMatrix:
        return replace(self, entries=entries)


def matrix_from_entries(spark, entries, m: int, n: int, type: MatrixType = MatrixType.UNSPECIFIED, base: int = 1) -> SparseMatrix:
    """A small matrix from (i, j, v) tuples, whose indices start at base."""
    rows = [(int(i) + 1 - base, int(j) + 1 - base, float(v)) for i, j, v in entries]
    return SparseMatrix(spark.createDataFrame(rows, "i long, j long, v double"), m, n, type)


def vector_from_values(spark, values) -> DataFrame:
    return spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(values)], "i long, x double")
