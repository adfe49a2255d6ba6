"""Plans and tasks of matrices with very many small supernodes."""

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

from lattica.matrix import MatrixType, SparseMatrix
from lattica.operators import auction, direct, frontal, scaling
from lattica.plans import dissection, symbolic
from lattica.sources import rutherford_boeing


def test_many_nodes_are_dealt_to_several_tasks():
    n = 3 * symbolic.TASK_NODES
    own = np.arange(n)
    p = symbolic.plan(n, own, own)
    sizes = np.bincount([x.task for x in p.nodes])
    assert (sizes > 0).sum() == 3 and sizes.max() <= 1.2 * symbolic.TASK_NODES


def test_a_task_of_many_nodes_visits_each_entry_once():
    n = 4000
    nodes = [direct.TaskNode(k, [k], [], -1) for k in range(n)]

    before = np.isin
    looks = []
    try:
        np.isin = lambda *a, **b: looks.append(1) or before(*a, **b)
        pdf = pd.DataFrame({"kind": [1] + [0] * n, "r": [0, *range(n)], "c": [0, *range(n)], "v": [0.0, *(k - 5.5 for k in range(n))], "payload": [pickle.dumps(nodes)] + [None] * n})
        got = direct._factor_task(0, pdf, np.zeros(n, dtype=int), np.zeros(n, dtype=int), (False, 0.01, 1e-20, True, "a posteriori"))
    finally:
        np.isin = before
    assert not looks
    assert got.stats[0][2] == 6 and [d[0][0] for _, _, _, d in pickle.loads(got.payload[0])] == [1 / (k - 5.5) for k in range(n)]


def test_a_single_pivot_is_as_by_blocks():
    for a, delayed in (([[2.0, 1, -3], [1, 5, 0], [-3, 0, 4]], 0), ([[1e-4, 1.0], [1.0, 3.0]], 1), ([[0.0, 0.0], [0.0, 3.0]], 0)):
        a = np.array(a)
        f, g = frontal.ldlt_app_front(a, 1, [*range(len(a))]), frontal.ldlt_front(a, 1, [*range(len(a))])
        assert (f.eliminated, f.delayed, f.zero, f.rows) == (g.eliminated, g.delayed, g.zero, g.rows) and f.delayed == delayed
        assert np.allclose(f.l, g.l) and np.allclose(f.rest, g.rest) and np.allclose(f.d or 0, g.d or 0)


def test_parts_of_a_dissection_may_be_ordered_elsewhere():
    side = 40
    k = np.arange(side * side)
    g = dissection.adjacency(side * side, np.concatenate([k[k % side > 0], k[k >= side]]), np.concatenate([k[k % side > 0] - 1, k[k >= side] - side]))
    sizes = []

    def deal(parts):
        sizes.extend(map(len, parts))
        return [np.array(dissection.nested_dissection(dissection.Graph.unpacked(x.packed()))) for x in parts]

    assert dissection.nested_dissection(g, deal=deal, piece=500) == dissection.nested_dissection(g)
    assert len(sizes) >= 4 and max(sizes) <= 500


def test_large_parts_are_separated_in_tasks(monkeypatch):
    side = 64
    k = np.arange(side * side)
    g = dissection.adjacency(side * side, np.concatenate([k[k % side > 0], k[k >= side]]), np.concatenate([k[k % side > 0] - 1, k[k >= side] - side]))
    want, separate, here, rounds = dissection.nested_dissection(g), dissection.separate, [], []
    monkeypatch.setattr(dissection, "separate", lambda x: here.append(len(x)) or separate(x))
    deal = lambda parts: [np.array(dissection.nested_dissection(dissection.Graph.unpacked(x.packed()))) for x in parts]

    def halve(parts):
        rounds.append([len(x) for x in parts])
        return [separate(dissection.Graph.unpacked(x.packed())) for x in parts]

    before = len(here)
    assert dissection.nested_dissection(g, deal=deal, piece=500, halve=halve) == want
    assert here[before] == len(g) and max(here[before + 1 :]) <= 500  # of what is above 500 nodes, only the whole is separated here
    assert len(rounds) <= 4 and len(rounds[0]) == 2 and min(min(x) for x in rounds) > 500  # all parts known at a time go together


def test_vectors_of_a_task_are_arrow_tables():
    """What several tasks send to one position is summed; columns of several right-hand sides stay apart."""
    l = np.array([[1.0], [0.5]])  # noqa: E741
    front = pa.table({"level": pa.array([0], pa.int32()), "task": [3], "payload": [pickle.dumps([([0, 1], 1, l, [(0.25, 0.0, 1)])])], "below": [pickle.dumps(np.array([[1, 7, 1]]))], "asked": pa.array([None], pa.binary())})
    rows = pa.table({"src": [-1, 5], "p": [0, 0], "w": pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float64()))})
    got = direct._up(2, True, True)(front, rows).to_pylist()
    assert got == [{"kind": direct.MIDDLE, "level": 0, "task": 3, "src": 3, "p": 0, "w": [1.0, 1.5]}, {"kind": direct.ADDED, "level": 1, "task": 7, "src": 3, "p": 1, "w": [-2.0, -3.0]}]


def test_indices_make_no_object_for_each_entry(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from lattica.matrix import matrix_from_entries

    a = matrix_from_entries(spark, [(3, 1, 1.0), (2, 2, 2.0)], 3, 3)
    monkeypatch.delattr(DataFrame, "toPandas", raising=False)
    i, j = direct.indices(a)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(1, 1), (2, 0)]


def test_small_blocks_are_matched_together(spark, monkeypatch):
    """Whole blocks of the exact matching share a task, and are matched as each by itself."""
    rows = [(2 * k + a, 2 * k + b, 1.0 + (3 * a + 5 * b + k) % 7) for k in range(60) for a in (1, 2) for b in (1, 2)]
    a = SparseMatrix(spark.createDataFrame(rows, "i long, j long, v double"), 120, 120, MatrixType.REAL_UNSYM)
    logs = a.entries.select("i", "j", F.log("v").alias("w"))
    monkeypatch.setattr(scaling, "DEAL_ENTRIES", 40)
    dealt = scaling._dealt(logs)
    assert dealt.select("block").distinct().count() == 60
    assert 1 < dealt.select("share").distinct().count() <= 6
    assert dealt.groupBy("block").agg(F.countDistinct("share").alias("n")).where("n > 1").isEmpty()
    together = sorted(map(tuple, scaling.match(a).collect()))
    alone = sorted(map(tuple, scaling.blocks(logs).groupBy("block").applyInPandas(lambda pdf: scaling._exact(pdf), scaling.MATCH_SCHEMA).collect()))
    assert together == alone


def test_fronts_are_in_memory_task_by_task_and_spread_over_cores(spark):
    """What reads fronts, or makes them, sees one task at a time, and small tasks don't meet in one partition."""
    n = 240
    e = [(k, k, 4.0) for k in range(1, n + 1)] + [(k, k - 1, -1.0) for k in range(2, n + 1)]
    a = SparseMatrix(spark.createDataFrame(e, "i long, j long, v double"), n, n, MatrixType.REAL_SYM_INDEF)
    f = direct.factor(direct.analyse(a, direct.Options(nemin=4, task_flops=500)))
    tasks = f.fronts.select("task").distinct().count()
    assert sum(f.tasks) == tasks and f.tasks[0] > 3
    sizes = direct._each(f.fronts.select("task", "payload"), tasks, lambda pdf: pd.DataFrame({"rows": [len(pdf)]}), "rows long").collect()
    assert [x.rows for x in sizes] == [1] * tasks
    assert direct._dealt(f.fronts.where("level = 0"), f.tasks[0]).groupBy("task").count().rdd.getNumPartitions() == min(f.tasks[0], 16)
    x = direct.solve(f, np.ones(n))
    assert direct.backward_error(a, x, np.ones(n)) < 1e-14
    f.free()


def test_a_round_of_the_auction_broadcasts_few_rows(spark):
    """What a round sends through the driver doesn't grow with the matrix."""
    t = spark.range(100).withColumnRenamed("id", "t")
    plan = lambda rows: t.join(auction._round(t, rows), "t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(auction.ROUND_ROWS) and "Broadcast" not in plan(auction.ROUND_ROWS + 1)


def test_a_written_matrix_is_made_once(spark, tmp_path):
    n, made = 700, spark.sparkContext.accumulator(0)

    def run(batches):
        for x in batches:
            made.add(len(x))
            yield x

    rows = spark.createDataFrame(pd.DataFrame({"i": np.tile(np.arange(1, n + 1), 2), "j": np.repeat([1, 3], n), "v": np.arange(2.0 * n) - 5}), "i long, j long, v double").repartition(7)
    a = SparseMatrix(rows.mapInPandas(run, "i long, j long, v double"), n, n, MatrixType.REAL_UNSYM)
    rutherford_boeing.write(a, f"{tmp_path}/m", least_parts=5)
    assert made.value == 2 * n
    got = rutherford_boeing.read(spark, f"{tmp_path}/m")[0].entries
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_lines_go_on_from_batch_to_batch():
    at, fields = [3, 3, 3, 4, 4, 6, 7], ["a", "bc", "ü", "", "d", "", "e"]
    want = ["abcü", "d", "", "e"]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pydict({"at": at[k : k + size], "k": [0] * len(at[k : k + size]), "field": fields[k : k + size]}) for k in range(0, 7, size)]
        assert [x for b in rutherford_boeing.joined_lines(iter(batches)) for x in b.column(0).to_pylist()] == want
