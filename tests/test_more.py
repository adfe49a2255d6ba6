import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import solve_file
from lattica.functions import lcg
from lattica.matrix import MatrixType, SparseMatrix, matrix_from_entries, vector_from_values
from lattica.operators import direct, eigs, vectors
from lattica.operators.lsmr import LsmrOptions, Operator, Stop, lsmr
from lattica.plans import symbolic
from lattica.sources import plot, rutherford_boeing
from lattica.streaming.assembly import assembled


def values(x, n):
    out = np.zeros(n)
    for r in x.collect():
        out[r.i - 1] = r.x
    return out


@pytest.fixture(scope="module")
def tall(spark):
    rng = np.random.default_rng(4)
    dense = np.round(rng.standard_normal((14, 5)), 3)
    a = matrix_from_entries(spark, [(i + 1, j + 1, float(dense[i, j])) for i in range(14) for j in range(5)], 14, 5, MatrixType.REAL_RECT)
    return a, dense, np.round(rng.standard_normal(14), 3)


@pytest.mark.parametrize("damp", [0.0, 0.7])
def test_least_squares_estimates(spark, tall, damp):
    """x, and the norms that the recurrences give, against dense algebra."""
    a, dense, b = tall
    x, state = lsmr(a, vector_from_values(spark, b.tolist()), damp, LsmrOptions(atol=1e-12, btol=1e-12))
    whole, right = np.vstack([dense, damp * np.eye(5)]), np.append(b, np.zeros(5))
    best = np.linalg.lstsq(whole, right, rcond=None)[0]
    assert np.allclose(values(x, 5), best, atol=1e-8)
    assert abs(state.norm_r - np.linalg.norm(right - whole @ best)) < 1e-8
    assert abs(state.norm_x - np.linalg.norm(best)) < 1e-8
    assert state.norm_ar < 1e-8 and state.iteration <= 8


def test_least_squares_with_own_operator_test_and_local_vectors(spark, tall):
    a, dense, b = tall
    calls = []

    def done(x, state):
        calls.append(state.iteration)
        return state.norm_ar < 1e-9

    of = Operator(14, 5, lambda x: vectors.multiply(a, x), lambda x: vectors.multiply_transposed(a, x))
    x, state = lsmr(of, vector_from_values(spark, b.tolist()), options=LsmrOptions(local_size=3, test=done, test_every=2))
    assert np.allclose(values(x, 5), np.linalg.lstsq(dense, b, rcond=None)[0], atol=1e-8)
    assert state.stop == Stop.LEAST_SQUARES and all(k % 2 == 0 or k == state.iteration for k in calls)
    _, state = lsmr(of, vector_from_values(spark, b.tolist()), options=LsmrOptions(iteration_limit=1))
    assert state.stop == Stop.ITERATION_LIMIT


def test_analysis_of_coordinates(spark):
    rows = [(1, 1, 4.0), (2, 1, -1.0), (1, 2, -1.0), (2, 2, 4.0), (3, 3, 2.0), (9, 9, 1.0)]
    got = direct.analyse_coordinates(spark.createDataFrame(rows, "i long, j long, v double"), 3)
    x = direct.solve(direct.factor(got), np.array([2.0, 6.0, 4.0]))
    assert np.allclose(np.array([[4, -2, 0], [-2, 4, 0], [0, 0, 2]]) @ x, [2, 6, 4])
    assert got.flag > 0  # something was out of range


def test_d_is_read_and_set_without_l(spark):
    n = 30
    a = matrix_from_entries(spark, [(k, k, 3.0 if k % 3 else -2.0) for k in range(1, n + 1)] + [(k + 1, k, 1.0) for k in range(1, n)], n, n, MatrixType.REAL_SYM_INDEF)
    f = direct.factor(direct.analyse(a, direct.Options(task_flops=20, nemin=2)))
    order, d = direct.enquire_indefinite(f)
    assert sorted(np.abs(order)) == list(range(1, n + 1)) and d.shape == (2, n)
    b = np.arange(1.0, n + 1)
    assert np.allclose(direct.solve(direct.alter(f, 3 * d), b), 3 * direct.solve(f, b))
    p = direct.factor(direct.analyse(matrix_from_entries(spark, [(k, k, float(k * k)) for k in range(1, 6)], 5, 5, MatrixType.REAL_SYM_PSDEF)), positive=True)
    assert sorted(direct.enquire_positive(p)) == [1, 2, 3, 4, 5]


def test_chains_of_large_nodes_are_one_task():
    n = 60
    p = symbolic.plan(n, np.arange(1, n), np.arange(n - 1), order=range(n), nemin=1, task_flops=0)
    assert len({x.task for x in p.nodes}) == 1 and p.depth == 1


def test_gram_of_few_and_of_many_columns(spark, tall):
    a, dense, _ = tall
    want = {(i + 1, j + 1): v for (i, j), v in np.ndenumerate(dense.T @ dense) if i >= j}
    for most in (512, 0):
        got = {(r.i, r.j): r.v for r in vectors.gram(a.entries, 5, most).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_chi_square(spark):
    d = spark.createDataFrame([(1,), (1,), (2,), (4,)], "bin int")
    assert tuple(lcg.chi_square(d, "bin", 4).first()) == (4, 2.0)


def test_pictures(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0)], "i long, j long, v double")
    order = spark.createDataFrame([(1, 2), (2, 1)], "i long, pos long")
    moved = plot.permuted(e, order, order)
    assert sorted((r.i, r.j) for r in moved.collect()) == [(1, 2), (2, 2)]
    plot.write_pattern(e, 2, 2, str(tmp_path / "p.pgm"))
    assert (tmp_path / "p.pgm").read_text() == "P2\n2 2\n1\n0 1\n0 1\n"
    assert plot.ppm_text(np.array([[0, 1]]), [(1, 2, 3), (4, 5, 6)]) == "P3\n2 1\n255\n1 2 3 4 5 6\n"


def test_a_stream_of_triples(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "i long, j long, v double"
    spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0)], schema).write.parquet(source)
    spark.createDataFrame([(2, 1, 3.0), (7, 7, 1.0)], schema).write.mode("append").parquet(source)
    stream = assembled(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 3, 3, MatrixType.REAL_RECT)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("triples").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("triples").collect())) == [(1, 1, 1.0), (2, 1, 5.0)]


def test_the_file_solver(spark, tmp_path, capsys):
    a = matrix_from_entries(spark, [(k, k, 4.0) for k in range(1, 13)] + [(k + 1, k, -1.0) for k in range(1, 12)], 12, 12, MatrixType.REAL_SYM_INDEF)
    rutherford_boeing.write(a, str(tmp_path / "a.rb"))
    for more in ([], ["--posdef"], ["--scale", "mc77", "--nrhs", "2", "--nsolve", "2"]):
        got = solve_file.main([str(tmp_path / "a.rb"), *more], spark)
        assert got["forward_error"] < 1e-10 and got["n"] == 12
    assert "inertia" in capsys.readouterr().out


def test_eigen_messages():
    assert all(eigs.message(f) for f in eigs.EigenFlag)
    assert "right" in str(eigs.EigenError(eigs.EigenFlag.RIGHT))


def test_preconditioner_and_both_ends(spark):
    n = 20
    a = matrix_from_entries(spark, [(k, k, float(k)) for k in range(1, n + 1)] + [(k + 1, k, 0.1) for k in range(1, n)], n, n, MatrixType.REAL_SYM_INDEF)
    scaled = lambda block: block.withColumn("w", F.transform("w", lambda v: v / F.col("i")))
    dense = np.diag(np.arange(1.0, n + 1)) + 0.1 * (np.eye(n, k=1) + np.eye(n, k=-1))
    exact = np.linalg.eigvalsh(dense)
    got = eigs.standard(a, 2, 1, scaled, eigs.Options(rel_tol_residual=1e-5))
    assert np.allclose(got.values, [exact[0], exact[1], exact[-1]], atol=1e-4)


def test_products_by_row_of_few_hubs(spark, monkeypatch):
    """A matrix of hubs and a diagonal, with repeated entries and a row of none: products as by its dense form, and no step of a run joins its table with entries."""
    monkeypatch.setattr(eigs, "HUB_ENTRIES", 20)
    rng, n = np.random.default_rng(5), 120
    dense = np.diag(rng.uniform(1, 9, n))
    dense[70, 70] = 0
    for hub in (3, 4, 90):
        for i in rng.permutation(n)[:60]:
            if i not in (hub, 70):
                dense[i, hub] = dense[hub, i] = rng.normal()
    low = [(int(i) + 1, int(j) + 1, float(dense[i, j]) / 2) for i, j in zip(*np.nonzero(np.tril(dense)), strict=True)]
    a = SparseMatrix(spark.createDataFrame(low + low, "i long, j long, v double"), n, n, MatrixType.REAL_SYM_INDEF)
    local = eigs.times(a).local("a")
    assert local.hubs.tolist() == [4, 5, 91]
    w = rng.normal(size=(n, 2))
    block = spark.createDataFrame([(k + 1, w[k].tolist()) for k in range(n)], "i long, w array<double>")
    empty = F.array()
    frame = block.join(local.rows, "i", "left").withColumns({"ad": F.coalesce("ad", F.lit(0.0)), "ah": F.coalesce("ah", empty.cast("array<int>")), "av": F.coalesce("av", empty.cast("array<double>"))})
    derived = eigs.Derived({"a": local.hubs}, eigs.hub_sums(frame, "w", 2, [local]))
    got = eigs.gram_matrices(frame, ["w", "aw"], [("w", "aw"), ("aw", "aw")], derived)
    assert np.allclose(got["w", "aw"], w.T @ dense @ w) and np.allclose(got["aw", "aw"], w.T @ dense @ dense @ w)
    joined = []
    monkeypatch.setattr(eigs.Times, "__call__", lambda *x: joined.append(x))
    top = eigs.standard(a, 0, 2, options=eigs.Options(rel_tol_residual=1e-3))
    assert np.allclose(top.values, np.linalg.eigvalsh(dense)[-2:], atol=1e-3) and not joined
    other = a.entries.unionByName(spark.createDataFrame([(9, 8, 1.0)], "i long, j long, v double"))
    assert eigs.times(SparseMatrix(other, n, n, a.type)).local("a") is None
