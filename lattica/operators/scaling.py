"""Scalings: equilibration in the infinity norm, and by exact or auction matching.

Equilibration is iterated grouped maxima. Matchings are exact per connected component of the bipartite graph, so that a matrix
of many blocks runs in parallel, with many small blocks in a task; one component is as sequential as the algorithm is. An
auction is one task with its bids in order ("auction"), or rounds in which all bid at once, for matrices of any size
("parallel auction").
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from .auction import parallel_auction
from .cutting import cut
from .matching import AuctionOptions, assign, auction
from .vectors import small


class ScalingFlag(IntEnum):
    # Codes of the scaling routines.
    SUCCESS = 0
    ALLOCATION = -1
    SINGULAR = -2
    WARN_SINGULAR = 1


class ScalingError(ValueError):
    def __init__(self, flag: ScalingFlag) -> None:
        super().__init__(flag.name)
        self.flag = flag


@dataclass(frozen=True)
class Scaled:
    rows: DataFrame  # i, s
    columns: DataFrame  # j, s
    match: DataFrame | None = None  # i, j
    core: DataFrame | None = None  # i, j: of a singular symmetric matrix, the matching of its largest matched submatrix alone
    iterations: int = 0
    matched: int = 0
    flag: ScalingFlag = ScalingFlag.SUCCESS


def _index(matrix: SparseMatrix, n: int, name: str) -> DataFrame:
    return matrix.spark.range(1, n + 1).select(F.col("id").alias(name))


def equilibrate_symmetric(matrix: SparseMatrix, max_iterations: int = 10, tol: float = 1e-8) -> Scaled:
    """s such that every row of s A s has its largest modulus near 1: s <- s / sqrt(largest), until all are within tol of it."""
    full = cut(matrix.full().groupBy("i", "j").agg(F.max(F.abs("v")).alias("v")).where("v <> 0"))
    s, done = _index(matrix, matrix.n, "i").select("i", F.lit(1.0).alias("s")), 0
    for _ in range(max_iterations):
        by_column = small(s.select(F.col("i").alias("j"), F.col("s").alias("sj")), matrix.n)
        largest = full.join(by_column, "j").groupBy("i").agg(F.max(F.col("v") * F.col("sj")).alias("m"))
        step = s.join(largest, "i", "left").select("i", "s", F.coalesce(F.col("m") * F.col("s"), F.lit(0.0)).alias("m"))
        s = cut(step.select("i", F.when(F.col("m") > 0, F.col("s") / F.sqrt("m")).otherwise(F.col("s")).alias("s"), F.abs(1 - F.col("m")).alias("off")))
        done += 1
        worst = s.agg(F.max("off")).first()[0]
        s = s.select("i", "s")
        if worst is None or worst < tol:
            break
    return Scaled(s, s.select(F.col("i").alias("j"), "s"), iterations=done)


def equilibrate(matrix: SparseMatrix, max_iterations: int = 10, tol: float = 1e-8) -> Scaled:
    """Row and column scalings of a general matrix, both updated from the old values of both."""
    entries = cut(matrix.full().groupBy("i", "j").agg(F.max(F.abs("v")).alias("v")).where("v <> 0"))
    r = _index(matrix, matrix.m, "i").select("i", F.lit(1.0).alias("r"))
    c = _index(matrix, matrix.n, "j").select("j", F.lit(1.0).alias("c"))
    done = 0
    for _ in range(max_iterations):
        scaled = entries.join(small(r, matrix.m), "i").join(small(c, matrix.n), "j").select("i", "j", (F.col("v") * F.col("r") * F.col("c")).alias("w"))
        both = scaled.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("k")), F.struct(F.lit(1).alias("side"), F.col("j").alias("k")))).alias("p"), "w").groupBy("p.side", "p.k").agg(F.max("w").alias("m"))
        both = cut(both)  # one pass gives the maxima of rows and columns
        update = lambda x, key, side: x.join(both.where(F.col("side") == side).select(F.col("k").alias(key), "m"), key, "left")
        r = cut(update(r, "i", 0).select("i", F.when(F.col("m") > 0, F.col("r") / F.sqrt("m")).otherwise(F.col("r")).alias("r")))
        c = cut(update(c, "j", 1).select("j", F.when(F.col("m") > 0, F.col("c") / F.sqrt("m")).otherwise(F.col("c")).alias("c")))
        done += 1
        stat = both.agg(F.max(F.abs(1 - F.col("m"))).alias("off"), F.count("*").alias("n")).first()
        if stat["n"] == matrix.m + matrix.n and stat["off"] < tol:
            break
    return Scaled(r.select("i", F.col("r").alias("s")), c.select("j", F.col("c").alias("s")), iterations=done)


def blocks(entries: DataFrame) -> DataFrame:
    """entries with block: the number of its connected component in the bipartite graph of rows and columns.

    In a round each row hears the least block of the rows that it shares a column with, and a block becomes the least that any
    of its rows hears: blocks join whole, so the rounds are few however long the paths are.
    """
    edges = cut(entries.select("i", "j").distinct())
    label = edges.groupBy("i").agg(F.min("j").alias("block"))
    while True:
        columns = edges.join(label, "i").groupBy("j").agg(F.min("block").alias("low"))
        heard = cut(edges.join(columns, "j").groupBy("i").agg(F.min("low").alias("low")).join(label, "i"))
        joined = cut(heard.groupBy("block").agg(F.min("low").alias("new")))
        label = heard.join(joined, "block").select("i", F.col("new").alias("block"))
        if joined.where("new < block").isEmpty():
            return entries.join(label, "i")


def _by_column(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    pdf = pdf.sort_values(["j", "i"])
    rows, ri = np.unique(pdf.i.to_numpy(), return_inverse=True)
    columns, start = np.unique(pdf.j.to_numpy(), return_index=True)
    cuts = np.append(start, len(pdf))
    split = lambda a: [a[cuts[k] : cuts[k + 1]] for k in range(len(columns))]
    return rows, columns, split(ri), split(pdf.w.to_numpy())


MATCH_SCHEMA = "side int, k long, mate long, dual double, rounds long"


def _matched(rows, columns, row_of, u, v, rounds=0) -> pd.DataFrame:
    mate = np.where(row_of >= 0, rows[np.maximum(row_of, 0)], 0)
    col_of = np.zeros(len(rows), dtype=np.int64)
    hit = row_of >= 0
    col_of[row_of[hit]] = columns[hit]
    return pd.DataFrame({"side": np.repeat([0, 1], [len(rows), len(columns)]), "k": np.append(rows, columns), "mate": np.append(col_of, mate), "dual": np.append(u, v), "rounds": rounds})


def _exact(pdf: pd.DataFrame) -> pd.DataFrame:
    """w is log |a|; duals are logs of scalings."""
    rows, columns, ri, logs = _by_column(pdf)
    top = np.array([x.max() for x in logs])
    got = assign(len(rows), len(columns), ri, [t - x for t, x in zip(top, logs, strict=True)])
    return _matched(rows, columns, got.row_of, got.u, got.v - top)


def _auction(pdf: pd.DataFrame, options: AuctionOptions) -> pd.DataFrame:
    rows, columns, ri, logs = _by_column(pdf)
    top = np.array([x.max() for x in logs])
    spread = max(float((t - x).max()) for t, x in zip(top, logs, strict=True))
    shift = 2 * spread + 1  # any match is worth more than a better one
    got = auction(len(rows), len(columns), ri, [x - t + shift for t, x in zip(top, logs, strict=True)], options)
    return _matched(rows, columns, got.row_of, shift / 2 - got.u, shift / 2 - got.v - top, got.iterations)


#: Entries that a task of the exact matching is dealt, of whole blocks.
DEAL_ENTRIES = 50_000


def _dealt(logs: DataFrame) -> DataFrame:
    """logs with share: whole blocks dealt by hash. Paths of the matching stay within their block, so it is the same whatever others are with it."""
    found = cut(blocks(logs))
    shares = max(1, -(-found.count() // DEAL_ENTRIES))
    return found.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares))).repartition(shares, "share")


def match(matrix: SparseMatrix, method: str = "hungarian", options: AuctionOptions = AuctionOptions()) -> DataFrame:
    """side (0 row, 1 column), k, mate (0: none), dual (log scaling), over all rows and columns with a nonzero entry."""
    logs = matrix.full().where("v <> 0").select("i", "j", F.log(F.abs("v")).alias("w"))
    if method == "hungarian":
        return cut(_dealt(logs).groupBy("share").applyInPandas(lambda pdf: _exact(pdf), MATCH_SCHEMA))
    if method == "parallel auction":
        return parallel_auction(logs.groupBy("i", "j").agg(F.max("w").alias("w")), matrix.m, matrix.n, options)
    # the steps of the auction in order depend on the whole matrix: one task
    return cut(logs.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(lambda pdf: _auction(pdf, options), MATCH_SCHEMA))


def match_scaling(matrix: SparseMatrix, method: str = "hungarian", scale_if_singular: bool = False, options: AuctionOptions = AuctionOptions()) -> Scaled:
    """Scalings from the duals of a matching: matched entries become 1 (about 1 for the auction), others at most 1."""
    found = match(matrix, method, options)
    pairs = found.where("side = 0 and mate > 0").select(F.col("k").alias("i"), F.col("mate").alias("j"))
    matched, flag = pairs.count(), ScalingFlag.SUCCESS
    if method == "hungarian" and matched < min(matrix.m, matrix.n):
        if not scale_if_singular:
            raise ScalingError(ScalingFlag.SINGULAR)
        flag = ScalingFlag.WARN_SINGULAR
    rounds = found.agg(F.coalesce(F.max("rounds"), F.lit(0))).first()[0]
    side = lambda k, name: found.where(F.col("side") == k).select(F.col("k").alias(name), F.col("dual").alias("d"), (F.col("mate") > 0).alias("hit"))
    if matrix.type.lower_only:
        s, core = _symmetric(matrix, side(0, "i"), side(1, "j"), pairs, matched, method)
        return Scaled(s, s.select(F.col("i").alias("j"), "s"), pairs, core, rounds, matched, flag)
    r, c = _balanced(matrix, side(0, "i"), side(1, "j"), matched)
    return Scaled(r, c, pairs, None, rounds, matched, flag)


def _symmetric(matrix: SparseMatrix, r: DataFrame, c: DataFrame, pairs: DataFrame, matched: int, method: str) -> tuple[DataFrame, DataFrame | None]:
    """The scaling, and the matching of the matched submatrix where the matrix is singular."""
    index = _index(matrix, matrix.n, "i")
    mean = r.join(c.select(F.col("j").alias("i"), F.col("d").alias("e"), F.col("hit").alias("hit2")), "i").select("i", F.exp((F.col("d") + F.col("e")) / 2).alias("s"), (F.col("hit") & F.col("hit2")).alias("ok"))
    if matched == matrix.n or method != "hungarian":
        return index.join(mean, "i", "left").select("i", F.coalesce("s", F.lit(1.0)).alias("s")), None
    # Rank deficient: the matched rows make a nonsingular submatrix, which is matched anew; each other row is then scaled so
    # that its largest entry beside them becomes 1.
    inside = cut(pairs.select("i"))
    entries = matrix.entries.join(inside, "i", "left_semi").join(inside.select(F.col("i").alias("j")), "j", "left_semi")
    again = match(matrix.with_entries(entries), method)
    duals = again.where("side = 0").select(F.col("k").alias("i"), "dual").join(again.where("side = 1").select(F.col("k").alias("i"), F.col("dual").alias("e")), "i")
    core = cut(duals.join(inside, "i", "left_semi").select("i", F.exp((F.col("dual") + F.col("e")) / 2).alias("s")))
    beside = matrix.full().where("v <> 0").join(core.select(F.col("i").alias("j"), "s"), "j").groupBy("i").agg(F.max(F.abs("v") * F.col("s")).alias("m"))
    s = index.join(core, "i", "left").join(beside, "i", "left").select("i", F.coalesce("s", 1 / F.col("m"), F.lit(1.0)).alias("s"))
    return s, again.where("side = 0 and mate > 0").select(F.col("k").alias("i"), F.col("mate").alias("j"))


def _balanced(matrix: SparseMatrix, r: DataFrame, c: DataFrame, matched: int) -> tuple[DataFrame, DataFrame]:
    """Log scalings moved so that rows and columns have the same mean; a side's unmatched ones get a largest entry of 1."""
    rows = _index(matrix, matrix.m, "i").join(r, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("hit", F.lit(False)).alias("hit"))
    columns = _index(matrix, matrix.n, "j").join(c, "j", "left").select("j", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("hit", F.lit(False)).alias("hit"))
    if matrix.m != matrix.n:
        mean = lambda x: x.where("hit").agg(F.avg("d")).first()[0] or 0.0
    else:
        mean = lambda x: x.agg(F.avg("d")).first()[0] or 0.0
    shift = (mean(rows) - mean(columns)) / 2
    rows, columns = rows.withColumn("d", F.col("d") - shift), columns.withColumn("d", F.col("d") + shift)
    if matrix.m < matrix.n:
        top = matrix.entries.where("v <> 0").join(rows.select("i", "d"), "i").groupBy("j").agg(F.max(F.log(F.abs("v")) + F.col("d")).alias("top"))
        columns = columns.join(top, "j", "left").select("j", F.when(F.col("hit"), F.col("d")).otherwise(F.coalesce(-F.col("top"), F.lit(0.0))).alias("d"))
    elif matrix.m > matrix.n:
        top = matrix.entries.where("v <> 0").join(columns.select("j", "d"), "j").groupBy("i").agg(F.max(F.log(F.abs("v")) + F.col("d")).alias("top"))
        rows = rows.join(top, "i", "left").select("i", F.when(F.col("hit"), F.col("d")).otherwise(F.coalesce(-F.col("top"), F.lit(0.0))).alias("d"))
    return rows.select("i", F.exp("d").alias("s")), columns.select("j", F.exp("d").alias("s"))


def apply_scaling(matrix: SparseMatrix, scaled: Scaled) -> DataFrame:
    """Entries r v c of both triangles."""
    r, c = scaled.rows.select("i", F.col("s").alias("r")), scaled.columns.select("j", F.col("s").alias("c"))
    return matrix.full().join(small(r, matrix.m), "i").join(small(c, matrix.n), "j").select("i", "j", (F.col("v") * F.col("r") * F.col("c")).alias("v"))
