"""Canonical form: cleaning, conversion, verification, triangles, column pointers, maps and printing.

All sums are grouped aggregations with partial sums in each task. Positions in column order come from counts of blocks, so
neither a long column nor the whole matrix is numbered by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..matrix import Flag, MatrixError, MatrixType, SparseMatrix

BLOCK = 1 << 16


def check_shape(type: MatrixType, m: int, n: int) -> None:
    if m < 0 or n < 0:
        raise MatrixError(Flag.N_OUT_OF_RANGE)
    if type.square and m != n:
        raise MatrixError(Flag.NOT_SQUARE)


def in_range(m: int, n: int) -> Column:
    return F.col("i").between(1, m) & F.col("j").between(1, n)


def placed(type: MatrixType, mirror: bool) -> tuple[Column, Column, Column, Column]:
    """i, j and v where the type stores an entry, and whether it stores it: mirror moves upper entries to the lower triangle."""
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    if not type.lower_only:
        return i, j, v, F.lit(True)
    keep = i != j if type.skew else F.lit(True)
    if not mirror:
        return i, j, v, keep & (i >= j)
    return F.greatest(i, j), F.least(i, j), F.when(i < j, -v).otherwise(v) if type.skew else v, keep


@dataclass(frozen=True)
class Converted:
    matrix: SparseMatrix
    flag: Flag
    out_of_range: int
    duplicates: int
    missing_diagonal: int


def canonical(df: DataFrame, m: int, n: int, type: MatrixType, mirror: bool = True) -> DataFrame:
    """Entries of (i, j, v) in range, moved to the stored triangle, repeated ones summed. Lazy."""
    i, j, v, keep = placed(type, mirror)
    kept = df.where(in_range(m, n) & keep).select(i.alias("i"), j.alias("j"), v.alias("v"))
    return kept.groupBy("i", "j").agg(F.sum("v").alias("v"))


def counters(df: DataFrame, m: int, n: int, type: MatrixType, mirror: bool = True) -> DataFrame:
    """One row: n_in, out_of_range, duplicates, entries, diagonals."""
    i, j, v, keep = placed(type, mirror)
    good = F.coalesce(in_range(m, n) & keep, F.lit(False))
    per_place = df.select(F.when(good, i).alias("i"), F.when(good, j).alias("j"), good.alias("good")).groupBy("i", "j", "good").count()
    good_count = F.when(F.col("good"), F.col("count")).otherwise(0)
    one = F.when(F.col("good"), 1).otherwise(0)
    return per_place.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n_in"),
        F.coalesce(F.sum(F.col("count") - good_count), F.lit(0)).alias("out_of_range"),
        F.coalesce(F.sum(good_count - one), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(one), F.lit(0)).cast("long").alias("entries"),
        F.coalesce(F.sum(F.when(F.col("good") & (F.col("i") == F.col("j")), 1).otherwise(0)), F.lit(0)).cast("long").alias("diagonals"),
    )


def _flag(out_of_range: int, duplicates: int, missing: int) -> Flag:
    if missing:
        return Flag.WARN_MISSING_DIAGONAL_AND_OTHER if out_of_range or duplicates else Flag.WARN_MISSING_DIAGONAL
    return Flag((1 if out_of_range else 0) + (2 if duplicates else 0))


def _converted(df: DataFrame, m: int, n: int, type: MatrixType, mirror: bool) -> Converted:
    check_shape(type, m, n)
    c = counters(df, m, n, type, mirror).first()
    indefinite = type in (MatrixType.REAL_SYM_INDEF, MatrixType.CPLX_HERM_INDEF, MatrixType.CPLX_SYM)
    definite = type in (MatrixType.REAL_SYM_PSDEF, MatrixType.CPLX_HERM_PSDEF)
    missing = n - c["diagonals"] if indefinite or definite else 0
    if definite and missing:
        raise MatrixError(Flag.MISSING_DIAGONAL)
    return Converted(SparseMatrix(canonical(df, m, n, type, mirror), m, n, type), _flag(c["out_of_range"], c["duplicates"], missing), c["out_of_range"], c["duplicates"], missing)


def from_coordinates(df: DataFrame, m: int, n: int, type: MatrixType = MatrixType.UNSPECIFIED) -> Converted:
    """Coordinate triples to canonical form. It is an error if there are entries and all of them are out of range."""
    got = _converted(df, m, n, type, mirror=True)
    if got.out_of_range and not got.matrix.entries.limit(1).count():
        raise MatrixError(Flag.ALL_OUT_OF_RANGE)
    return got


def clean(df: DataFrame, m: int, n: int, type: MatrixType = MatrixType.UNSPECIFIED) -> Converted:
    """Column-wise entries to canonical form. Upper entries of symmetric types are dropped; a column must not lose all its entries."""
    got = _converted(df, m, n, type, mirror=False)
    if got.out_of_range and df.select("j").distinct().join(got.matrix.entries.select("j").distinct(), "j", "left_anti").limit(1).count():
        raise MatrixError(Flag.ALL_OUT_OF_RANGE)
    return got


def column_pointers(entries: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """j, ptr for j = 1 .. n + 1: where each column starts in column order."""
    counts = entries.sparkSession.range(1, n + 2).select(F.col("id").alias("j")).join(entries.groupBy("j").count(), "j", "left").select("j", F.coalesce("count", F.lit(0)).alias("c"), F.floor((F.col("j") - 1) / block).alias("b"))
    before = counts.groupBy("b").agg(F.sum("c").alias("c")).select("b", F.coalesce(F.sum("c").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("c").over(W.partitionBy("b").orderBy("j").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("inside", inside).join(before, "b").select("j", (F.col("base") + F.col("inside") + 1).alias("ptr"))


def positions(entries: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """entries with pos, the 1-based place in column order (j, then i)."""
    rows = entries.withColumn("ib", F.floor((F.col("i") - 1) / block))
    per_block = rows.groupBy("j", "ib").count().withColumn("above", F.coalesce(F.sum("count").over(W.partitionBy("j").orderBy("ib").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(W.partitionBy("j", "ib").orderBy("i")) - 1
    placed_rows = rows.withColumn("within", within).join(per_block, ["j", "ib"]).join(column_pointers(entries, n), "j")
    return placed_rows.select(*entries.columns, (F.col("ptr") + F.col("above") + F.col("within")).alias("pos"))


def conversion_map(df: DataFrame, m: int, n: int, type: MatrixType, mirror: bool = True) -> DataFrame:
    """out_pos, in_pos, sign for df (i, j, pos): how new values of the same pattern reach their places."""
    i, j, v, keep = placed(type, mirror)
    sign = F.when(F.col("i") < F.col("j"), -1).otherwise(1) if type.skew and mirror else F.lit(1)
    kept = df.where(in_range(m, n) & keep).select(i.alias("i"), j.alias("j"), F.col("pos").alias("in_pos"), sign.alias("sign"))
    places = positions(kept.select("i", "j").distinct(), n)
    return kept.join(places, ["i", "j"]).select(F.col("pos").alias("out_pos"), "in_pos", "sign")


def apply_conversion_map(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """pos, v of the canonical matrix from values (pos, v) of the input."""
    moved = mapping.join(values.select(F.col("pos").alias("in_pos"), "v"), "in_pos")
    return moved.groupBy(F.col("out_pos").alias("pos")).agg(F.sum(F.col("sign") * F.col("v")).alias("v"))


def verify(df: DataFrame, ptr: DataFrame | list[int] | None, m: int, n: int, type: MatrixType, values: bool = False) -> tuple[Flag, int]:
    """The first violation of the column-wise form by df (j, pos, i and, with values, v), and where it is.

    pos: places in the order of storage, one after another. ptr: column pointers, as column_pointers() gives them (j, ptr) or as a list.
    """
    if m < 0 or n < 0:
        return Flag.N_OUT_OF_RANGE, 0
    if type.square and type != MatrixType.UNSPECIFIED and m != n:
        return Flag.NOT_SQUARE, 0
    if not m or not n:
        return Flag.SUCCESS, 0
    if ptr is not None:
        pointers = ptr if isinstance(ptr, DataFrame) else df.sparkSession.createDataFrame(list(enumerate(ptr, 1)), "j long, ptr long")
        following = pointers.select((F.col("j") - 1).alias("j"), F.col("ptr").alias("following"))
        ends = pointers.join(following, "j", "left").where(F.col("j") <= n + 1).agg(F.min(F.when(F.col("j") == 1, F.col("ptr"))).alias("first"), F.min(F.when(F.col("following") < F.col("ptr"), F.col("j") + 1)).alias("falls")).first()
        if ends["first"] < 1:
            return Flag.PTR_FIRST, ends["first"]
        if ends["falls"] is not None:
            return Flag.PTR_ORDER, ends["falls"]
    bad = violations(df, m, n, type)
    first = bad.orderBy("j", "pos").limit(1).first()
    if first:
        return Flag(first["flag"]), first["more"]
    if values and type == MatrixType.REAL_SYM_PSDEF:
        low = df.groupBy("j").agg(F.min_by("v", "pos").alias("v")).where("v <= 0").agg(F.min("j")).first()[0]
        if low is not None:
            return Flag.MISSING_DIAGONAL, low
    return Flag.SUCCESS, 0


def violations(df: DataFrame, m: int, n: int, type: MatrixType) -> DataFrame:
    """j, pos, flag, more: the violation that each offending entry, or column without its diagonal, makes.

    Entries meet the one before them by place, so that a full column is no single task.
    """
    before = df.select("j", (F.col("pos") + 1).alias("pos"), F.col("i").alias("last"))
    i, j, pos = F.col("i"), F.col("j"), F.col("pos")
    ladder = F.when((i < 1) | (i > m), F.lit(int(Flag.ROW_OUT_OF_RANGE)))
    if type.lower_only:
        ladder = ladder.when(i < j, int(Flag.UPPER_ENTRY))
    if type.skew:
        ladder = ladder.when(i == j, int(Flag.UPPER_ENTRY))
    ladder = ladder.when(i == F.col("last"), int(Flag.ROW_DUPLICATE)).when(i < F.col("last"), int(Flag.ROW_ORDER))
    found = df.join(before, ["j", "pos"], "left").withColumn("flag", ladder).where("flag is not null")
    found = found.select("j", "pos", "flag", F.when(F.col("flag") == int(Flag.ROW_DUPLICATE), pos - 1).otherwise(pos).alias("more"))
    if abs(type) == MatrixType.REAL_SYM_PSDEF:
        columns = df.sparkSession.range(1, n + 1).select(F.col("id").alias("j"))
        lost = columns.join(df.where("i = j").select("j").distinct(), "j", "left_anti")
        found = found.union(lost.select("j", F.lit(2**62), F.lit(int(Flag.MISSING_DIAGONAL)), "j"))
    return found


def half_to_full(entries: DataFrame, skew: bool = False) -> DataFrame:
    v = -F.col("v") if skew else F.col("v")
    return entries.unionByName(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), v.alias("v")))


def flip_triangle(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def symmetric_to_skew(entries: DataFrame) -> DataFrame:
    return entries.withColumn("v", F.when(F.col("i") < F.col("j"), -F.col("v")).otherwise(F.col("v")))


def add_missing_diagonal(entries: DataFrame, m: int, n: int) -> DataFrame:
    places = entries.sparkSession.range(1, min(m, n) + 1).select(F.col("id").alias("i"), F.col("id").alias("j"))
    lost = places.join(entries.where("i = j").select("i"), "i", "left_anti")
    return entries.unionByName(lost.select("i", "j", F.lit(0.0).alias("v")))


def make_diagonally_dominant(matrix: SparseMatrix) -> SparseMatrix:
    """A positive-definite matrix: each diagonal is 1 plus its own modulus plus those of the other entries of its row."""
    off = matrix.full().where("i <> j").groupBy("i").agg(F.sum(F.abs("v")).alias("s"))
    diagonal = add_missing_diagonal(matrix.entries.where("i = j"), matrix.n, matrix.n).join(off, "i", "left")
    diagonal = diagonal.select("i", "j", (1 + F.abs("v") + F.coalesce("s", F.lit(0.0))).alias("v"))
    return SparseMatrix(matrix.entries.where("i <> j").unionByName(diagonal), matrix.m, matrix.n, MatrixType.REAL_SYM_PSDEF)


# Headings of printed matrices.
TYPE_NAMES = {0: "Matrix of undefined type", 1: "Real rectangular matrix", 2: "Real unsymmetric matrix", 3: "Real symmetric positive definite matrix", 4: "Real symmetric indefinite matrix", 6: "Real skew symmetric matrix", -1: "Complex rectangular matrix", -2: "Complex unsymmetric matrix", -3: "Complex Hermitian positive definite matrix", -4: "Complex Hermitian indefinite matrix", -5: "Complex symmetric matrix", -6: "Complex skew symmetric matrix"}


def print_matrix(matrix: SparseMatrix, lines: int = 20, values: bool = True) -> list[str]:
    """A heading and the first rows, both triangles, with a fixed-width field for each column up to the last entry of a row."""
    total = matrix.entries.count()
    out = [f"{TYPE_NAMES[int(matrix.type)]}, dimension {matrix.m}x{matrix.n} with {total} entries."]
    shown = max(min(lines - 1, matrix.m), 0)
    rows = matrix.full().where(F.col("i") <= shown).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    width = len(str(matrix.m))
    found = {r["i"]: r["e"] for r in rows.collect()}  # `lines` bounds the rows
    for i in range(1, shown + 1):
        field = {e["j"]: f"{e['v']:13.4E}" if values else f"{'x':>13}" for e in found.get(i, [])}
        last = max(field, default=0)
        compact = matrix.n > 6
        cells = [f" ({j}){t}" for j, t in sorted(field.items())] if compact else [field.get(j, " " * 13) for j in range(1, last + 1)]
        out.append(f"{i:>{width}}:" + "".join(cells))
    return out
