"""python -m lattica.solve_file matrix.rb: reads a symmetric matrix, makes a right-hand side with solution 1, solves, reports."""

from __future__ import annotations

import argparse
import time

import numpy as np
from pyspark.sql import SparkSession

from .matrix import MatrixType, SparseMatrix
from .operators import direct
from .operators.cutting import cut
from .operators.vectors import multiply
from .sources import rutherford_boeing


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lattica.solve_file", description=__doc__)
    p.add_argument("file", nargs="?", default="matrix.rb")
    p.add_argument("--posdef", action="store_true", help="factorize as positive definite")
    p.add_argument("--force-posdef", action="store_true", help="replace the values by diagonally dominant ones")
    p.add_argument("--scale", choices=("none", "mc64", "auction", "mc77"), default="none", help="none, exact matching, auction, equilibration")
    p.add_argument("--ordering", choices=("dissection", "matching"), default="dissection")
    p.add_argument("--nemin", type=int, default=32)
    p.add_argument("--u", type=float, default=0.01, help="pivot threshold")
    p.add_argument("--nrhs", type=int, default=1)
    p.add_argument("--nfact", type=int, default=1, help="how often to factorize")
    p.add_argument("--nsolve", type=int, default=1, help="how often to solve")
    return p.parse_args(args)


SCALES = {"none": 0, "mc64": 1, "auction": 2, "mc77": 4}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = arguments(args)
    spark = spark or SparkSession.builder.appName("solve_file").getOrCreate()
    values = rutherford_boeing.ReadOptions(values=-3 if a.force_posdef else 2)
    matrix, header, _ = rutherford_boeing.read(spark, a.file, values)
    positive = a.posdef or a.force_posdef
    matrix = SparseMatrix(cut(matrix.entries.where("v is not null")), matrix.m, matrix.n, MatrixType.REAL_SYM_PSDEF if positive else MatrixType.REAL_SYM_INDEF)
    ones = spark.range(1, matrix.n + 1).selectExpr("id AS i", "1.0D AS x")
    b = np.zeros(matrix.n)
    got = multiply(matrix, ones).toPandas()
    b[got.i.to_numpy() - 1] = got.x.to_numpy()
    b = np.repeat(b[:, None], a.nrhs, axis=1)
    out: dict = {"title": header.title, "n": matrix.n, "entries": matrix.entries.count()}
    start = time.time()
    analysis = direct.analyse(matrix, direct.Options(ordering=2 if a.ordering == "matching" else 1, nemin=a.nemin, scaling=SCALES[a.scale], u=a.u))
    out |= {"analyse_seconds": time.time() - start, "factor_entries": analysis.plan.factor_entries, "flops": analysis.plan.flops}
    start = time.time()
    for _ in range(max(a.nfact, 1)):
        factors = direct.factor(analysis, positive)
    out["factor_seconds"] = time.time() - start
    start = time.time()
    for _ in range(max(a.nsolve, 1)):
        x = direct.solve(factors, b)
    out |= {"solve_seconds": time.time() - start, "forward_error": float(np.abs(x - 1).max()), "backward_error": direct.backward_error(matrix, x, b)}
    out |= {"delayed": factors.num_delayed, "two_by_two": factors.num_two, "max_front": factors.max_front, "inertia": factors.inertia}
    for k, v in out.items():
        print(f"{k:>16}: {v}")
    return out


if __name__ == "__main__":
    main()
