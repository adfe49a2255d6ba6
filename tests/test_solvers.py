import numpy as np
import pytest

from lattica.matrix import MatrixType, matrix_from_entries, vector_from_values
from lattica.operators import direct, eigs, scaling
from lattica.operators.frontal import inertia, ldlt_front
from lattica.operators.lsmr import Stop, lsmr
from lattica.plans import symbolic

SYM5 = [(1, 1, 2), (2, 1, 1), (2, 2, 4), (3, 2, 1), (5, 2, 8), (3, 3, 3), (4, 3, 2), (5, 5, 2)]


def values(df):
    return [round(r[1], 3) for r in sorted(df.collect())]


def test_equilibration_golden(spark):
    a = matrix_from_entries(spark, SYM5, 5, 5, MatrixType.REAL_SYM_INDEF)
    assert values(scaling.equilibrate_symmetric(a).rows) == [0.707, 0.354, 0.577, 0.866, 0.354]
    assert values(scaling.match_scaling(a, "auction").rows) == [0.707, 0.162, 0.278, 1.798, 0.772]


def test_hungarian_golden(spark):
    a = matrix_from_entries(spark, [(1, 1, 2), (2, 1, 1), (1, 2, 5), (2, 2, 4), (3, 2, 1), (5, 2, 8), (4, 3, 3), (3, 4, 2), (2, 5, 7), (5, 5, 2)], 5, 5, MatrixType.REAL_UNSYM)
    got = scaling.match_scaling(a)
    assert values(got.rows) == [0.522] * 5
    assert values(got.columns) == [0.959, 0.24, 0.639, 0.959, 0.274]
    assert sorted(map(tuple, got.match.collect())) == [(1, 1), (2, 5), (3, 4), (4, 3), (5, 2)]


def test_singular_scaling(spark):
    a = matrix_from_entries(spark, [(1, 1, 2), (2, 2, 1)], 3, 3, MatrixType.REAL_SYM_INDEF)
    with pytest.raises(scaling.ScalingError):
        scaling.match_scaling(a)
    got = scaling.match_scaling(a, scale_if_singular=True)
    assert (got.flag, got.matched, values(got.rows)) == (1, 2, [0.707, 1.0, 1.0])


def test_rectangular_matching(spark):
    rng = np.random.default_rng(3)
    dense = rng.standard_normal((6, 9)) * (rng.random((6, 9)) < 0.6)
    a = matrix_from_entries(spark, [(i + 1, j + 1, dense[i, j]) for i in range(6) for j in range(9) if dense[i, j]], 6, 9, MatrixType.REAL_RECT)
    got = scaling.match_scaling(a, scale_if_singular=True)
    r, c = np.array([x[1] for x in sorted(got.rows.collect())]), np.array([x[1] for x in sorted(got.columns.collect())])
    scaled = np.abs(dense) * r[:, None] * c
    assert scaled.max() <= 1 + 1e-12
    assert all(abs(scaled[m.i - 1, m.j - 1] - 1) < 1e-12 for m in got.match.collect())


def test_least_squares_golden(spark):
    a = matrix_from_entries(spark, [(1, 1, 1), (3, 1, 2), (4, 1, 5), (2, 2, 2), (4, 2, 3), (1, 3, -1), (3, 3, 2), (4, 3, -2), (5, 3, 6)], 5, 3, MatrixType.REAL_RECT)
    x, state = lsmr(a, vector_from_values(spark, [1] * 5))
    assert [round(r.x, 2) for r in sorted(x.collect())] == [0.18, 0.26, 0.17]
    assert (state.stop, state.iteration) == (Stop.LEAST_SQUARES, 3)
    assert lsmr(a, vector_from_values(spark, [0] * 5))[1].stop == Stop.ZERO


def dense_of(entries, n):
    a = np.zeros((n, n))
    for i, j, v in entries:
        a[i - 1, j - 1] = a[j - 1, i - 1] = v
    return a


def grid(side):
    at = lambda r, c: r * side + c + 1
    out = []
    for r in range(side):
        for c in range(side):
            out.append((at(r, c), at(r, c), 4.0))
            out += [(at(r, c), at(r, c - 1), -1.0)] if c else []
            out += [(at(r, c), at(r - 1, c), -1.0)] if r else []
    return out


def test_small_indefinite(spark):
    a = matrix_from_entries(spark, [(1, 1, 2), (2, 1, 1), (2, 2, 4), (3, 2, 1), (5, 2, 1), (3, 3, 3), (4, 3, 2), (4, 4, -1), (5, 5, 2)], 5, 5, MatrixType.REAL_SYM_INDEF)
    f = direct.factor(direct.analyse(a))
    assert np.allclose(direct.solve(f, np.array([4, 17, 19, 2, 12.0])), [1, 2, 3, 4, 5])
    assert f.inertia == (1, 0, 4)
    with pytest.raises(direct.SolverError) as e:
        direct.factor(direct.analyse(a), positive=True)
    assert e.value.flag == direct.SolverFlag.NOT_POSITIVE_DEFINITE
    with pytest.raises(direct.SolverError):
        direct.solve(f, np.zeros(5), job=9)
    with pytest.raises(direct.SolverError):
        direct.analyse(a, direct.Options(ordering=0), order=[1, 1, 2, 3, 4])


def test_grid_over_levels(spark):
    a = matrix_from_entries(spark, grid(10), 100, 100, MatrixType.REAL_SYM_PSDEF)
    b = np.random.default_rng(0).standard_normal((100, 2))
    plan = direct.analyse(a, direct.Options(task_flops=2000, nemin=4))
    assert plan.plan.depth > 2
    f = direct.factor(plan, positive=True)
    x = direct.solve(f, b)
    assert direct.backward_error(a, x, b) < 5e-14
    assert np.abs(x - direct.solve(f, direct.solve(f, b, 1), 3)).max() < 1e-12
    assert len(direct.enquire_positive(f)) == 100


@pytest.mark.parametrize("options", [direct.Options(nemin=2, task_flops=500), direct.Options(ordering=2, scaling=3, nemin=2)])
def test_zero_diagonal_with_delays(spark, options):
    rng, n = np.random.default_rng(1), 40
    entries = {(i + 1, i): rng.standard_normal() for i in range(1, n)}
    for _ in range(80):
        i, j = sorted(rng.integers(1, n + 1, 2))[::-1]
        if i != j:
            entries[int(i), int(j)] = rng.standard_normal()
    triples = [(i, j, v) for (i, j), v in entries.items()]
    a = matrix_from_entries(spark, triples, n, n, MatrixType.REAL_SYM_INDEF)
    f, b = direct.factor(direct.analyse(a, options)), rng.standard_normal(n)
    assert direct.backward_error(a, direct.solve(f, b), b) < 5e-11
    negative = int((np.linalg.eigvalsh(dense_of(triples, n)) < 0).sum())
    assert f.inertia == (negative, 0, n - negative)


def test_structurally_singular(spark):
    a = matrix_from_entries(spark, [(1, 1, -1), (2, 1, 2), (2, 2, 1)], 3, 3, MatrixType.REAL_SYM_INDEF)
    assert direct.analyse(a).flag == direct.SolverFlag.WARN_ANALYSIS_SINGULAR
    assert direct.factor(direct.analyse(a)).rank == 2
    with pytest.raises(direct.SolverError):
        direct.analyse(a, direct.Options(action=False))


def test_fronts_keep_their_bounds():
    rng = np.random.default_rng(0)
    for t in range(150):
        m = int(rng.integers(1, 12))
        n = int(rng.integers(1, m + 1))
        a = rng.standard_normal((m, m))
        a = a + a.T
        if t % 3 == 0:
            np.fill_diagonal(a, 0)
        f = ldlt_front(a, n, list(range(m)))
        k, d, i = f.eliminated, np.zeros((f.eliminated, f.eliminated)), 0
        while i < k:
            if f.d[i][2] == 2:
                d[i : i + 2, i : i + 2] = np.linalg.inv([[f.d[i][0], f.d[i][1]], [f.d[i][1], f.d[i + 1][0]]])
                i += 2
            else:
                d[i, i] = 1 / f.d[i][0] if f.d[i][0] else 0
                i += 1
        back = f.l @ d @ f.l.T
        back[k:, k:] += f.rest
        assert np.abs(back - a[np.ix_(f.rows, f.rows)]).max() < 1e-10
        assert k == 0 or np.abs(f.l).max() <= 100.01
        if n == m:
            assert k == n
            assert inertia(f.d)[0] == (np.linalg.eigvalsh(a) < -1e-12).sum()


def test_plan_of_a_chain():
    p = symbolic.plan(6, np.arange(1, 6), np.arange(5), order=range(6), nemin=1)
    assert (p.factor_entries, p.flops, p.structural_rank) == (11, 21, 6)
    for k, x in enumerate(p.nodes):
        if x.parent >= 0:
            above = p.nodes[x.parent]
            assert x.parent > k
            assert set(x.rows) <= set(above.pivots) | set(above.rows)


def test_eigenvalues(spark):
    a = matrix_from_entries(spark, grid(6), 36, 36, MatrixType.REAL_SYM_PSDEF)
    exact = np.sort([4 - 2 * np.cos(p * np.pi / 7) - 2 * np.cos(q * np.pi / 7) for p in range(1, 7) for q in range(1, 7)])
    got = eigs.shift_invert(a, 1.0, 1, 2, options=eigs.Options(rel_tol_residual=1e-7))
    assert np.allclose(got.values, [exact[exact < 1][-1], *exact[exact > 1][:2]], atol=1e-6)
    with pytest.raises(eigs.EigenError):
        eigs.standard(a, 30)
    with pytest.raises(eigs.EigenError):  # the grid has no ten values below 1
        eigs.shift_invert(a, 1.0, 10, 1)


def complex_of(pairs, n):
    rows = dict((r.i, r.w) for r in pairs.vectors.collect())
    return np.array([rows[k] for k in range(1, n + 1)]) + 1j * np.array([rows[n + k] for k in range(1, n + 1)])


def hermitian_entries(spark, m):
    n = len(m)
    return spark.createDataFrame([(i + 1, j + 1, float(m[i, j].real), float(m[i, j].imag)) for i in range(n) for j in range(i + 1) if m[i, j]], "i long, j long, re double, im double")


def ring(n):
    """i d/dx by central differences on a ring: double values but for the ends."""
    m = np.zeros((n, n), dtype=complex)
    for k in range(n):
        m[(k + 1) % n, k], m[k, (k + 1) % n] = 1j, -1j
    return m


def held(pairs, a, b, n, metric=None):
    x, metric = complex_of(pairs, n), b if metric is None else metric
    assert np.abs(x.conj().T @ metric @ x - np.eye(x.shape[1])).max() < 1e-6
    assert np.abs(a @ x - b @ x * pairs.values).max() < 1e-4


def test_hermitian_double_values_have_orthonormal_vectors(spark):
    n = 16
    a = ring(n)
    exact = np.linalg.eigvalsh(a)
    got = eigs.hermitian(hermitian_entries(spark, a), n, 3, eigs.Options(rel_tol_residual=1e-7), right=2)
    assert np.allclose(got.values, np.concatenate([exact[:3], exact[-2:]]), atol=1e-6)
    held(got, a, np.eye(n), n)


def test_hermitian_forms(spark):
    rng, n = np.random.default_rng(2), 12
    a, c = (x + x.conj().T for x in (rng.standard_normal((n, n)) + 1j * rng.standard_normal((n, n)) for _ in range(2)))
    b = c @ c.conj().T / n + np.eye(n)
    options = eigs.Options(rel_tol_residual=1e-7)
    ea, eb = hermitian_entries(spark, a), hermitian_entries(spark, b)
    exact = np.sort(np.linalg.eigvals(np.linalg.solve(b, a)).real)
    got = eigs.hermitian(ea, n, 2, options, b=eb)
    assert np.allclose(got.values, exact[:2], atol=1e-5)
    held(got, a, b, n)
    got = eigs.hermitian_shift_invert(ea, n, 0.1, 1, 2, eb, options)
    assert np.allclose(got.values, [*exact[exact < 0.1][-1:], *exact[exact > 0.1][:2]], atol=1e-5)
    held(got, a, b, n)
    with pytest.raises(eigs.EigenError):
        eigs.hermitian_shift_invert(ea, n, exact[0] - 1, 1, 0, eb, options)
    got = eigs.hermitian_buckling(eb, n, ea, 1.0, 1, 1, options)
    every = np.sort(1 / np.linalg.eigvals(np.linalg.solve(b, a)).real)
    assert np.allclose(got.values, [every[(every > 0) & (every < 1)][-1], every[every > 1][0]] if (every > 1).any() else got.values, atol=1e-5)
    held(got, b, a, n, metric=b)


def test_real_generalized_largest_and_buckling(spark):
    rng, n = np.random.default_rng(3), 16
    a = rng.standard_normal((n, n))
    a, b = a + a.T, a @ a.T / n + np.eye(n)
    of = lambda m, kind: matrix_from_entries(spark, [(i + 1, j + 1, float(m[i, j])) for i in range(n) for j in range(i + 1)], n, n, kind)
    sa, sb, options = of(a, MatrixType.REAL_SYM_INDEF), of(b, MatrixType.REAL_SYM_PSDEF), eigs.Options(rel_tol_residual=1e-7)
    exact = np.sort(np.linalg.eigvals(np.linalg.solve(b, a)).real)
    assert np.allclose(eigs.generalized(sa, sb, 2, 1, options=options).values, [*exact[:2], exact[-1]], atol=1e-5)
    size = exact[np.argsort(-np.abs(exact))]
    assert np.allclose(np.sort(eigs.largest(sa, 2, sb, options).values), np.sort(size[:2]), atol=1e-5)
    got = eigs.buckling(sb, sa, 1.0, 1, 0, options)
    every = 1 / exact
    assert np.allclose(got.values, [every[(every > 0) & (every < 1)].max()], atol=1e-5)


def grid_matrix(spark, side):
    return matrix_from_entries(spark, grid(side), side * side, side * side, MatrixType.REAL_SYM_PSDEF)


def dense_grid(side):
    return dense_of(grid(side), side * side)


def columns(pairs):
    return np.array([r.w for r in sorted(pairs.vectors.collect())])


def test_deflation_with_a_block_smaller_than_a_multiplicity(spark):
    """Values 1 (three times), 3, 3, then 10 and more, in blocks of two: the vectors are orthonormal and belong to their values."""
    d = [1.0] * 3 + [3.0] * 2 + [float(k) for k in range(10, 22)]
    a = matrix_from_entries(spark, [(k + 1, k + 1, v) for k, v in enumerate(d)], len(d), len(d), MatrixType.REAL_SYM_INDEF)
    got = eigs.standard(a, 4, options=eigs.Options(rel_tol_residual=1e-6, block=2))
    assert got.flag == 0 and np.allclose(got.values, d[:4], atol=1e-8)
    x = columns(got)
    assert np.abs(x.T @ x - np.eye(4)).max() < 1e-5 and np.abs(np.diag(d) @ x - x * got.values).max() < 1e-4
    got.free()
    with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND"):
        got.vectors.collect()


def test_both_ends_and_the_largest_in_one_run(spark):
    side, (w, _) = 5, np.linalg.eigh(dense_grid(5))
    a = grid_matrix(spark, side)
    got = eigs.standard(a, 2, 3, options=eigs.Options(rel_tol_residual=1e-7, extra=2))
    assert np.allclose(got.values, [*w[:2], *w[-3:]], atol=1e-9)
    shifted = a.with_entries(a.entries.selectExpr("i", "j", "case when i = j then v - 4.2 else v end as v"))
    size = (w - 4.2)[np.argsort(-np.abs(w - 4.2))][:3]
    assert np.allclose(np.sort(eigs.largest(shifted, 3, options=eigs.Options(rel_tol_residual=1e-7, extra=3)).values), np.sort(size), atol=1e-9)


def test_estimated_errors_are_above_the_true_ones(spark):
    side, (w, v) = 5, np.linalg.eigh(dense_grid(5))
    got = eigs.standard(grid_matrix(spark, side), 3, options=eigs.Options(rel_tol_residual=0.0, tol_vector=1e-3, extra=3))
    assert got.flag == 0 and (got.vector_errors <= 1e-3).all()
    x = columns(got)
    for k in range(3):  # the part of each vector outside of its value's space
        space = v[:, np.abs(w - w[k]) < 1e-9]
        assert np.linalg.norm(x[:, k] - space @ (space.T @ x[:, k])) <= got.vector_errors[k] + 1e-12
        assert abs(got.values[k] - w[k]) <= got.value_errors[k] + 1e-12


def test_restart_with_constraints_and_a_given_start(spark):
    side, (w, v) = 5, np.linalg.eigh(dense_grid(5))
    a, options = grid_matrix(spark, side), eigs.Options(rel_tol_residual=1e-7, extra=3)
    first = eigs.standard(a, 1, options=options)
    more = eigs.standard(a, 2, options=options, constraints=first.vectors)
    assert np.allclose(np.append(first.values, more.values), w[:3], atol=1e-9)
    again = eigs.standard(a, 1, options=options, start=first.vectors)
    assert again.iterations <= 2 and np.allclose(again.values, w[:1], atol=1e-9)
    few = eigs.standard(a, 3, options=eigs.Options(rel_tol_residual=1e-12, max_iterations=2))
    assert few.flag == eigs.EigenFlag.WARN_MAX_ITERATIONS and len(few.values) == 3


@pytest.mark.parametrize("pivoting", ["a posteriori", "threshold", "none"])
def test_several_right_sides_over_levels(spark, pivoting):
    n, rng = 100, np.random.default_rng(8)
    a = grid_matrix(spark, 10)
    f = direct.factor(direct.analyse(a, direct.Options(task_flops=2000, nemin=4, pivoting=pivoting)))
    assert f.inertia == (0, 0, n)
    x = rng.standard_normal((n, 3))
    b = dense_grid(10) @ x
    block = spark.createDataFrame([(k + 1, b[k].tolist()) for k in range(n)], "i long, w array<double>")
    rows = {r.i: r.w for r in direct.solve_block(f, block).collect()}
    assert np.abs(np.array([rows[k + 1] for k in range(n)]) - x).max() < 1e-11
    alone = direct.solve(f, spark.createDataFrame([(1, 1.0)], "i long, x double"))  # rows that b lacks are zero
    assert np.allclose(dense_grid(10) @ [r.x for r in sorted(alone.collect())], np.eye(n)[0])
    f.free()


def test_parallel_auction(spark):
    """At least nine tenths matched, feasible duals, matched entries within the last eps; either side may be the smaller one."""
    rng = np.random.default_rng(4)
    for m, n in ((12, 12), (8, 14), (14, 8)):
        dense = np.exp(rng.standard_normal((m, n))) * (rng.random((m, n)) < 0.5)
        dense[np.arange(min(m, n)), np.arange(min(m, n))] += 0.1
        a = matrix_from_entries(spark, [(i + 1, j + 1, float(dense[i, j])) for i, j in np.argwhere(dense)], m, n, MatrixType.REAL_UNSYM)
        got = scaling.match_scaling(a, "parallel auction")
        r, c = np.array([x[1] for x in sorted(got.rows.collect())]), np.array([x[1] for x in sorted(got.columns.collect())])
        pairs = [tuple(x) for x in got.match.collect()]
        scaled = dense * r[:, None] * c
        assert min(m, n) >= got.matched == len({i for i, _ in pairs}) == len({j for _, j in pairs}) >= 0.9 * min(m, n)
        assert scaled.max() <= 1 + 1e-9 and all(dense[i - 1, j - 1] and scaled[i - 1, j - 1] > 0.6 for i, j in pairs)


@pytest.mark.parametrize("seed", range(2))
def test_singular_ordered_by_what_can_be_matched(spark, seed):
    """A bordered matrix of structural rank 2 * 6: zero diagonal, so that no pivot but a matched pair is there."""
    rng, hubs, n = np.random.default_rng(seed), 6, 30
    triples = [(i, j, float(rng.standard_normal())) for i in range(hubs + 1, n + 1) for j in range(1, hubs + 1) if rng.random() < 0.5]
    a = matrix_from_entries(spark, triples, n, n, MatrixType.REAL_SYM_INDEF)
    f = direct.factor(direct.analyse(a, direct.Options(ordering=2, scaling=3, nemin=2)))
    whole = dense_of(triples, n)
    values = np.linalg.eigvalsh(whole)
    assert f.rank == np.linalg.matrix_rank(whole) == 12
    assert f.inertia[0] == int((values < -1e-9).sum())
    b = whole @ rng.standard_normal(n)
    assert np.abs(whole @ direct.solve(f, b) - b).max() < 1e-9
    got = scaling.match_scaling(a, scale_if_singular=True)
    core = got.core.toPandas()
    assert got.matched == 12 and sorted(core.i) == sorted(core.j)


def test_components_of_long_paths(spark):
    """Paths in a random numbering: their rows and columns have one block each."""
    rng, n = np.random.default_rng(0), 60
    name = rng.permutation(2 * n) + 1
    pairs = [(int(name[k]), int(name[k]) + 1000 if d == 0 else int(name[k + 1]) + 1000) for k in range(2 * n) for d in (0, 1) if d == 0 or (k + 1) % n]
    e = spark.createDataFrame(pairs + pairs[:3], "i long, j long")
    got = scaling.blocks(e).distinct().toPandas()
    side = {int(name[k]): k // n for k in range(2 * n)}
    found = {(side[i], b) for i, b in zip(got.i, got.block, strict=True)}
    assert len(found) == 2 and len({b for _, b in found}) == 2
