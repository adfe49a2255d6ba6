"""Plans that are made in tasks, of whole components."""

import numpy as np
import pytest

from lattica.matrix import MatrixType, SparseMatrix
from lattica.operators import direct


def test_components_are_planned_in_tasks(spark, monkeypatch):
    """Stars without a diagonal, small dense blocks and rows of nothing: the driver gets no index, and rank, inertia and solution are right."""
    monkeypatch.setattr(direct, "BY_PARTS", 10)
    monkeypatch.setattr(direct, "PART_ROWS", 12)
    rng, n = np.random.default_rng(8), 62
    dense = np.zeros((n, n))
    for at in range(0, 30, 6):
        dense[at, at + 1 : at + 6] = rng.uniform(1, 2, 5)
    for at in range(30, 58, 4):
        dense[at : at + 4, at : at + 4] = rng.normal(size=(4, 4))
    dense = np.triu(dense) + np.triu(dense, 1).T
    e = [(int(i) + 1, int(j) + 1, float(dense[i, j])) for i, j in zip(*np.nonzero(np.tril(dense)), strict=True)]
    a = SparseMatrix(spark.createDataFrame(e, "i long, j long, v double"), n, n, MatrixType.REAL_SYM_INDEF)
    monkeypatch.setattr(direct, "indices", lambda m: pytest.fail("the pattern came to the driver"))
    found = direct.analyse(a, direct.Options(ordering=2, scaling=3, nemin=2))
    assert isinstance(found.plan, direct.Parts) and found.plan.count > 2 and found.flag == direct.SolverFlag.WARN_ANALYSIS_SINGULAR
    assert sorted(found.plan.order) == list(range(n)) and found.plan.structural_rank == 58
    f = direct.factor(found)
    values = np.linalg.eigvalsh(dense)
    assert f.inertia == ((values < -1e-9).sum(), (abs(values) < 1e-9).sum(), (values > 1e-9).sum()) and f.num_delayed == 0
    b = dense @ rng.normal(size=n)
    assert np.allclose(dense @ direct.solve(f, b), b)
    monkeypatch.undo()
    monkeypatch.setattr(direct, "BY_PARTS", 10)
    monkeypatch.setattr(direct.dissection, "PIECE", 5)  # the stars are larger
    assert not isinstance(direct.analyse(a, direct.Options(ordering=2, scaling=3)).plan, direct.Parts)
