"""Runs on matrices of few hubs: inverses row by row, and tables of packed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import lcg
from lattica.matrix import MatrixType, SparseMatrix
from lattica.operators import direct, eigs


def hub_matrix(spark, seed, n, hubs, low, high):
    rng = np.random.default_rng(seed)
    dense = np.diag(rng.uniform(low, high, n))
    for h in hubs:
        for i in rng.permutation(n)[: n // 2]:
            if i != h:
                dense[i, h] = dense[h, i] = rng.normal()
    e = [(int(i) + 1, int(j) + 1, float(dense[i, j])) for i, j in zip(*np.nonzero(np.tril(dense)), strict=True)]
    return dense, SparseMatrix(spark.createDataFrame(e, "i long, j long, v double"), n, n, MatrixType.REAL_SYM_INDEF)


def test_inverses_by_row_of_few_hubs(spark, monkeypatch):
    """With a row whose diagonal can't be a pivot, alone and after a matrix: products and inertia as by the dense form; a shifted run plans and factors nothing."""
    monkeypatch.setattr(eigs, "HUB_ENTRIES", 20)
    n, rng = 90, np.random.default_rng(1)
    a, sa = hub_matrix(spark, 3, n, (3, 40), -5, 9)
    a[7, 7] = 1e-9
    a[7, 3] = a[3, 7] = 2.0
    sa = sa.with_entries(spark.createDataFrame([(int(i) + 1, int(j) + 1, float(a[i, j])) for i, j in zip(*np.nonzero(np.tril(a)), strict=True)], "i long, j long, v double"))
    b, sb = hub_matrix(spark, 4, n, (40,), 30, 40)
    w = rng.normal(size=(n, 2))
    block = eigs._sized(spark.createDataFrame([(k + 1, w[k].tolist()) for k in range(n)], "i long, w array<double>"), 2)
    for after, want in ((None, np.linalg.solve(a, w)), (eigs.times(sb), np.linalg.solve(a, b @ w))):
        found = eigs.by_rows(sa, after)
        assert 8 in found.found.hubs and found.found.negative == (np.linalg.eigvalsh(a) < 0).sum()
        got = {r.i: r.w for r in found(block).collect()}
        assert np.allclose([got[k] for k in range(1, n + 1)], want)
    monkeypatch.setattr(direct, "analyse", lambda *x: pytest.fail("a plan was made"))
    values = np.sort(np.linalg.eigvals(np.linalg.solve(b, a)).real)
    at = float(values[30:32].mean())
    got = eigs.shift_invert(sa, at, 1, 1, sb, eigs.Options(rel_tol_residual=1e-7))
    assert np.allclose(got.values, values[30:32], atol=1e-6)
    with pytest.raises(eigs.EigenError):
        eigs.shift_invert(sa, at, 40, 1, sb)
    zero = sa.with_entries(sa.entries.where("i <> 9 and j <> 9"))  # a row of no entries
    assert eigs.by_rows(zero) is None


def test_a_step_on_few_hubs_moves_chunks(spark, monkeypatch):
    """A table of a step holds rows by the chunk, not a value for each of their numbers, and a step writes one table."""
    monkeypatch.setattr(eigs, "HUB_ENTRIES", 20)
    monkeypatch.setattr(eigs, "CHUNK", 16)
    dense, a = hub_matrix(spark, 6, 100, (10, 50), 1, 9)
    kept, keep = [], eigs.Workspace.keep

    def see(self, df, **options):
        kept.append(df.columns)
        return keep(self, df, **options)

    monkeypatch.setattr(eigs.Workspace, "keep", see)
    got = eigs.standard(a, 2, 1, eigs.jacobi(a), eigs.Options(rel_tol_residual=1e-6))
    exact = np.linalg.eigvalsh(dense)
    assert np.allclose(got.values, [*exact[:2], exact[-1]], atol=1e-4)
    assert kept == [["chunk", "k", "rows", "s"]] * (got.iterations + 1) + [["i", "w"]]
    x = np.array([r.w for r in sorted(got.vectors.collect())])
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6)


def test_random_rows_as_by_columns(spark):
    """The block that a task makes is the stream's, row by row."""
    bits = (50 * 3).bit_length()
    want = spark.range(1, 51).select("id", F.array(*(lcg.as_real(lcg.state((F.col("id") - 1) * 3 + (k + 1), 77, bits)) for k in range(3))).alias("w")).orderBy("id").collect()
    assert np.array_equal(lcg.reals(np.arange(1, 51), 3, 77, 50), [r.w for r in want])
