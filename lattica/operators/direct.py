"""Direct solution of sparse symmetric systems: analyse, factor, solve, enquire, alter.

The plan needs the pattern's index arrays in one place; values, fronts and factors are distributed. Factorization walks the
levels of tasks: each task is a subtree of fronts, gets its entries of A and the contribution blocks of its children, and
hands on one block per child of another task. A solve walks the same levels up and down: the vectors are rows (task,
position, values) that meet the fronts task by task, and what a task has to tell another one is a row addressed to it. Once
the pivots are known, every task learns which tasks hold the positions below its fronts, and which ask for its own.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace
from enum import IntEnum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import MatrixType, SparseMatrix
from ..plans import dissection, symbolic
from . import scaling as scalings
from .cutting import Workspace, cut
from .frontal import Front, NotPositiveDefinite, SingularMatrix, apply_inverse_d, cholesky_front, inertia, ldlt_app_front, ldlt_front, ldlt_plain_front, solve_lower, solve_lower_transposed


class SolverFlag(IntEnum):
    # Codes of the direct solver that this engine can raise.
    SUCCESS = 0
    CALL_SEQUENCE = -1
    A_N_OUT_OF_RANGE = -2
    A_ALL_OUT_OF_RANGE = -4
    SINGULAR = -5
    NOT_POSITIVE_DEFINITE = -6
    ORDER = -8
    VALUES = -9
    X_SIZE = -10
    JOB_OUT_OF_RANGE = -11
    NOT_LLT = -13
    NOT_LDLT = -14
    WARN_OUT_OF_RANGE = 1
    WARN_DUPLICATE = 2
    WARN_DUPLICATE_AND_OUT_OF_RANGE = 3
    WARN_MISSING_DIAGONAL = 4
    WARN_MISSING_DIAGONAL_AND_OTHER = 5
    WARN_ANALYSIS_SINGULAR = 6
    WARN_FACTOR_SINGULAR = 7


class SolverError(ValueError):
    def __init__(self, flag: SolverFlag, detail: str = "") -> None:
        super().__init__(f"{flag.name}: {detail}" if detail else flag.name)
        self.flag = flag


@dataclass(frozen=True)
class Options:
    ordering: int = 1  # 0 the caller's, 1 nested dissection, 2 by matching
    nemin: int = 32
    scaling: int = 0  # 0 none or the caller's, 1 exact matching, 2 auction, 3 that of ordering 2, 4 equilibration
    u: float = 0.01
    small: float = 1e-20
    action: bool = True  # go on when the matrix is singular
    task_flops: int = 32_000_000  # of whole subtrees, a task; more where there would be more than `workers` tasks
    workers: int = 256
    pivoting: str = "a posteriori"  # or "threshold", "none"


#: Matrices of more rows, ordered by a matching, are planned in tasks of whole components, which have about so many rows each.
BY_PARTS, PART_ROWS = 1 << 18, 1 << 14


@dataclass(frozen=True)
class Parts:
    """A plan that was made in tasks, each of whole components of the matrix, and is held as tables: nothing leads from task to task."""

    n: int
    places: DataFrame  # i, p (position), task
    structure: DataFrame  # task, level, nodes: the pickled supernodes of a task, numbered within it
    count: int
    structural_rank: int
    factor_entries: int
    flops: int
    depth: int = 1

    @property
    def order(self) -> list[int]:
        got = self.places.select("i", "p").toArrow()
        order = np.empty(self.n, dtype=np.int64)
        order[got.column("p").to_numpy()] = got.column("i").to_numpy() - 1
        return order.tolist()


@dataclass(frozen=True)
class Analysis:
    matrix: SparseMatrix
    plan: symbolic.Plan | Parts
    options: Options
    flag: SolverFlag = SolverFlag.SUCCESS
    scaling: DataFrame | None = None  # i, s


@dataclass(frozen=True)
class Factors:
    analysis: Analysis
    positive: bool
    fronts: DataFrame  # level, task, payload: the pickled fronts of a task, in order; below, asked: see _linked()
    places: DataFrame  # i, p (position), s (scaling)
    owners: DataFrame  # p, task, level: where each position is eliminated
    space: Workspace
    num_delayed: int = 0
    num_two: int = 0
    num_negative: int = 0
    num_zero: int = 0
    num_entries: int = 0
    max_front: int = 0
    flag: SolverFlag = SolverFlag.SUCCESS
    tasks: tuple[int, ...] = ()  # of each level

    @property
    def rank(self) -> int:
        return self.analysis.plan.n - self.num_zero

    @property
    def inertia(self) -> tuple[int, int, int]:
        n = self.analysis.plan.n
        return self.num_negative, self.num_zero, n - self.num_negative - self.num_zero

    def free(self) -> None:
        """Gives back what fronts and solutions take in the shared folder; neither can be read any more."""
        self.space.free()


def analyse(matrix: SparseMatrix, options: Options = Options(), order: list[int] | None = None, flag: SolverFlag = SolverFlag.SUCCESS) -> Analysis:
    """matrix: symmetric, lower triangle. order[k]: the (1-based) variable to eliminate k-th, for ordering 0."""
    n = matrix.n
    if matrix.m != n or n < 0:
        raise SolverError(SolverFlag.A_N_OUT_OF_RANGE)
    got = scalings.match_scaling(matrix, scale_if_singular=True) if options.ordering == 2 else None
    if got and n > BY_PARTS and (parts := _by_parts(matrix, options, got.core or got.match)):
        return Analysis(matrix, parts, options, _checked(parts, options, flag), got.rows)
    i, j = indices(matrix)
    own, scale = None, None
    deal, halve = (_dealer(matrix.spark, found) for found in (symbolic.nested_dissection, symbolic.separate))
    if order is not None and options.ordering == 0:
        own = [k - 1 for k in order]
        if not symbolic.check_order(n, own):
            raise SolverError(SolverFlag.ORDER, "not a permutation")
    elif options.ordering == 0:
        raise SolverError(SolverFlag.ORDER, "no order is given")
    elif options.ordering == 2:
        mate = np.full(n, -1)
        pairs = (got.core or got.match).select("i", "j").toPandas()
        mate[pairs.j.to_numpy() - 1] = pairs.i.to_numpy() - 1
        own, scale = symbolic.matching_order(symbolic.adjacency(n, i, j), mate, deal, halve), got.rows
    plan = symbolic.plan(n, i, j, own, options.nemin, options.task_flops, options.workers, deal, halve)
    return Analysis(matrix, plan, options, _checked(plan, options, flag), scale)


def _checked(plan: symbolic.Plan | Parts, options: Options, flag: SolverFlag) -> SolverFlag:
    if plan.structural_rank < plan.n and flag == SolverFlag.SUCCESS:
        if not options.action:
            raise SolverError(SolverFlag.SINGULAR, "structurally singular")
        return SolverFlag.WARN_ANALYSIS_SINGULAR
    return flag


def _by_parts(matrix: SparseMatrix, options: Options, pairs: DataFrame) -> Parts | None:
    """The plan by a matching (i, j), whole components a task, dealt by hash; None if a component is too large for that."""
    spark, n = matrix.spark, matrix.n
    links = matrix.entries.select("i", "j")
    off = links.where("i <> j")
    edges = off.unionByName(off.select(F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j")))
    label = cut(scalings.blocks(edges).where("i = j").select("i", "block"))
    if label.groupBy("block").count().agg(F.max("count")).first()[0] > dissection.PIECE:
        return None
    count = -(-n // PART_ROWS)
    members = cut(label.select("i", F.pmod(F.xxhash64("block"), F.lit(count)).alias("task")))
    sizes = sorted((r["task"], r["count"]) for r in members.groupBy("task").count().collect())
    ends = np.cumsum([c for _, c in sizes])
    base = {t: int(e) - c for (t, c), e in zip(sizes, ends, strict=True)}  # the first position of each task

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        task = int(key[0])
        kind, a, b = pdf.kind.to_numpy(), pdf.a.to_numpy(), pdf.b.to_numpy()
        names = np.sort(a[kind == 0])
        at = lambda x, k: np.searchsorted(names, x[kind == k])
        i, j, mate = at(a, 1), at(b, 1), np.full(len(names), -1)
        mate[at(b, 2)] = at(a, 2)
        own = symbolic.matching_order(symbolic.adjacency(len(names), i, j), mate)
        p = symbolic.plan(len(names), i, j, own, options.nemin, workers=1)
        nodes = [TaskNode(k, [base[task] + q for q in x.pivots], (x.below.astype(np.int64) + base[task]).tolist(), x.parent) for k, x in enumerate(p.nodes)]
        return pd.DataFrame([(task, 0, names[np.array(p.order, dtype=np.int64)].tobytes(), pickle.dumps(nodes), p.structural_rank, p.factor_entries, p.flops)], columns=["task", "level", "variables", "nodes", "rank", "entries", "flops"])

    def placed(batches):
        for b in batches:
            for task, variables in zip(b.column("task").to_pylist(), b.column("variables").to_pylist(), strict=True):
                i = np.frombuffer(variables, dtype=np.int64)
                yield pa.record_batch({"i": i, "p": np.arange(base[task], base[task] + len(i)), "task": np.full(len(i), task)})

    met = lambda kind, x: x.join(members, "i").select("task", F.lit(kind).alias("kind"), F.col("i").alias("a"), F.col("j").alias("b"))
    rows = members.select("task", F.lit(0).alias("kind"), F.col("i").alias("a"), F.col("i").alias("b")).unionByName(met(1, links)).unionByName(met(2, pairs.select("i", "j")))
    made = cut(_dealt(rows, len(sizes)).groupBy("task").applyInPandas(run, "task long, level int, variables binary, nodes binary, rank long, entries long, flops long"))
    t = made.agg(F.sum("rank"), F.sum("entries"), F.sum("flops")).first()
    places = cut(made.select("task", "variables").mapInArrow(placed, "i long, p long, task long"))
    return Parts(n, places, made.select("task", "level", "nodes"), len(sizes), int(t[0]), int(t[1]), int(t[2]))


def indices(matrix: SparseMatrix) -> tuple[np.ndarray, np.ndarray]:
    """0-based rows and columns of the entries, as arrays: no Python object for each entry."""
    got = matrix.entries.select(F.col("i") - 1, F.col("j") - 1).toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def _dealer(spark, found) -> symbolic.Dealer:
    """found() of the parts of a dissection, one row each, in as many tasks."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf.k, "found": [np.asarray(found(symbolic.Graph.unpacked(g)), dtype=np.int32).tobytes() for g in pdf.graph]})

    def deal(parts: list[symbolic.Graph]) -> list[np.ndarray]:
        rows = spark.createDataFrame([(k, g.packed()) for k, g in enumerate(parts)], "k int, graph binary").repartitionById(len(parts), "k")
        got = rows.mapInPandas(run, "k int, found binary").toPandas().sort_values("k")
        return [np.frombuffer(x, dtype=np.int32) for x in got.found]

    return deal


def analyse_coordinates(df: DataFrame, n: int, options: Options = Options(), order: list[int] | None = None) -> Analysis:
    """From (i, j, v) in any order and either triangle: cleaned first, with its warnings."""
    from .convert import from_coordinates

    got = from_coordinates(df, n, n, MatrixType.REAL_SYM_INDEF)
    return analyse(replace(got.matrix, entries=cut(got.matrix.entries)), options, order, SolverFlag(int(got.flag)))


def _scaled(analysis: Analysis, matrix: SparseMatrix, scale: DataFrame | None) -> DataFrame | None:
    kind = analysis.options.scaling
    if scale is not None or kind == 0:
        return scale
    if kind == 3:
        if analysis.scaling is None:
            raise SolverError(SolverFlag.CALL_SEQUENCE, "scaling 3 needs ordering 2")
        return analysis.scaling
    if kind == 4:
        return scalings.equilibrate_symmetric(matrix).rows
    return scalings.match_scaling(matrix, "hungarian" if kind == 1 else "auction", scale_if_singular=True).rows


@dataclass
class TaskNode:
    """What a task knows of one supernode: positions of pivots and rows, and the number of its parent."""

    number: int
    pivots: list[int]
    rows: list[int]
    parent: int


def _task_nodes(plan: symbolic.Plan) -> dict[int, list[TaskNode]]:
    out: dict[int, list[TaskNode]] = {}
    for k, x in enumerate(plan.nodes):
        out.setdefault(x.task, []).append(TaskNode(k, x.pivots, x.rows, x.parent))
    return out


def _sent(spark, plan: symbolic.Plan) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray, tuple[int, ...]]:
    """A plan of the driver's as tables, as Parts has them; the task and level of each supernode; and the tasks of each level."""
    n = plan.n
    position = np.empty(n, dtype=np.int64)
    position[plan.order] = np.arange(n)
    node_task, node_level = (np.array([getattr(x, k) for x in plan.nodes], dtype=np.int64) for k in ("task", "level"))
    task_at = np.empty(n, dtype=np.int64)
    for k, x in enumerate(plan.nodes):
        task_at[x.pivots] = node_task[k]
    planned = spark.createDataFrame(pa.table({"i": np.arange(1, n + 1), "p": position, "task": task_at[position]})) if n else spark.createDataFrame([], "i long, p long, task long")
    tasks = _task_nodes(plan)
    level_of = {t: int(node_level[t_nodes[-1].number]) for t, t_nodes in tasks.items()}
    at_level = tuple(np.bincount(list(level_of.values()), minlength=plan.depth).tolist())
    structure = spark.createDataFrame([(t, level_of[t], pickle.dumps(x)) for t, x in tasks.items()], "task long, level int, nodes binary")
    return planned, structure, node_task, node_level, at_level


def factor(analysis: Analysis, positive: bool = False, entries: DataFrame | None = None, scale: DataFrame | None = None) -> Factors:
    """entries: new values of the same pattern. scale: the caller's scaling (i, s)."""
    plan, options = analysis.plan, analysis.options
    matrix = analysis.matrix.with_entries(entries) if entries is not None else analysis.matrix
    spark, n = matrix.spark, plan.n
    s_df = _scaled(analysis, matrix, scale)
    space = Workspace(spark)
    if isinstance(plan, Parts):
        planned, structure, node_task, node_level, at_level = plan.places, plan.structure, None, None, (plan.count,)
    else:
        planned, structure, node_task, node_level, at_level = _sent(spark, plan)
    if s_df is not None:
        named = s_df.toDF("i", "s")
        planned = planned.join(named, "i", "left").select("i", "p", "task", F.coalesce("s", F.lit(1.0)).alias("s"))
    else:
        planned = planned.withColumn("s", F.lit(1.0))
    planned = space.keep(planned)
    a = planned.select("i", F.col("p").alias("pi"), F.col("task").alias("ti"), F.col("s").alias("si"))
    b = planned.select(F.col("i").alias("j"), F.col("p").alias("pj"), F.col("task").alias("tj"), F.col("s").alias("sj"))
    moved = matrix.entries.join(a, "i").join(b, "j").select(F.when(F.col("pi") < F.col("pj"), F.col("ti")).otherwise(F.col("tj")).alias("task"), F.greatest("pi", "pj").alias("r"), F.least("pi", "pj").alias("c"), (F.col("v") * F.col("si") * F.col("sj")).alias("v"))
    structure = space.keep(structure)
    moved = space.keep(moved.join(F.broadcast(structure.select("task", "level")), "task"))  # some hundred tasks
    opts = (positive, options.u, options.small, options.action, options.pivoting)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _factor_task(int(key[0]), pdf, node_task, node_level, opts)

    schema = "task long, level int, kind int, payload binary, stats array<long>"
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    done = _Addressed(space, schema, ["kind", "level"])
    for level in range(plan.depth):
        now = structure.where(F.col("level") == level)
        heads = now.select("task", F.lit(1).alias("kind"), F.col("level").cast("long").alias("r"), none("long", "c"), none("double", "v"), F.col("nodes").alias("payload"))
        own = moved.where(F.col("level") == level).select("task", F.lit(0).alias("kind"), "r", "c", "v", none("binary", "payload"))
        work = heads.unionByName(own)
        if level:  # what earlier levels have handed to this one
            work = work.unionByName(done.rows(kind=1, level=level).select("task", F.lit(2).alias("kind"), none("long", "r"), none("long", "c"), none("double", "v"), "payload"))
        try:
            done.add(_dealt(work, at_level[level]).groupBy("task").applyInPandas(run, schema))
        except Exception as e:  # the kernels' errors come back as text
            space.free()
            raise _translated(e) from e
    space.drop(moved, structure)
    if not plan.depth:
        empty = spark.createDataFrame([], "level int, task long, payload binary, below binary, asked binary")
        return Factors(analysis, positive, empty, planned.select("i", "p", "s"), spark.createDataFrame([], "p long, task long, level int"), space)
    every = done.rows(kind=0)
    t = every.agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(5)), F.max(F.col("stats")[5]).alias("s5")).first()
    flag = SolverFlag.WARN_FACTOR_SINGULAR if t["s3"] and analysis.flag == SolverFlag.SUCCESS else analysis.flag
    fronts, owners = _linked(every.select("level", "task", "payload"), space, sum(at_level))
    done.free()
    return Factors(analysis, positive, fronts, planned.select("i", "p", "s"), owners, space, t["s0"], t["s1"], t["s2"], t["s3"], t["s4"], t["s5"], flag, at_level)


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows spread by task over the cores. Spark would take them together by their bytes, which say little of the work on them."""
    return rows.repartition(max(1, min(tasks, 4 * rows.sparkSession.sparkContext.defaultParallelism)), "task")


def _each(fronts: DataFrame, tasks: int, run, schema: str) -> DataFrame:
    """run(fronts of a task) for each task: one at a time in memory, where a batch would hold those of a whole file."""
    return _dealt(fronts, tasks).groupBy("task").applyInPandas(run, schema)


class _Addressed:
    """Rows written in a folder by what they are and where they go, so that each level reads what is for it, and only that."""

    def __init__(self, space: Workspace, schema: str, by: list[str]) -> None:
        self.space, self.schema, self.by, self.path, self.empty = space, schema, by, space.path(), True

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy(*self.by).parquet(self.path)
        self.empty = False

    def rows(self, **where: int) -> DataFrame:
        found = self.space.spark.read.schema(self.schema).parquet(self.path)
        for k, v in where.items():
            found = found.where(F.col(k) == v)
        return found

    def free(self) -> None:
        self.space.remove(self.path)


def _linked(fronts: DataFrame, space: Workspace, tasks: int) -> tuple[DataFrame, DataFrame]:
    """fronts with below (positions below a task's fronts, and the tasks and levels that hold them) and asked (its positions that others' fronts have below, and those tasks and levels), pickled arrays; and who holds what.

    Pivots may have been delayed into other tasks than the plan's, so this is found from the fronts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.iloc[0]
        fronts = pickle.loads(x.payload)
        own = {p for rows, k, _, _ in fronts for p in rows[:k]}
        out = {p for rows, k, _, _ in fronts for p in rows[k:]} - own
        return pd.DataFrame({"p": [*own, *out], "task": x.task, "level": x.level, "own": [True] * len(own) + [False] * len(out)})

    held = space.keep(_each(fronts, tasks, run, "p long, task long, level int, own boolean"))
    owners = space.keep(held.where("own").select("p", "task", "level"))
    need = held.where("not own").select("p", F.col("task").alias("at"), F.col("level").alias("at_level"))
    links = space.keep(need.join(owners, "p"))
    triple = lambda *c: F.sort_array(F.collect_list(F.struct(*c))).alias("links")  # noqa: E731  as many as a task's fronts have rows below, or neighbours
    below = links.groupBy(F.col("at").alias("task")).agg(triple("p", F.col("task").alias("t"), F.col("level").alias("l")))
    asked = links.groupBy("task").agg(triple("p", F.col("at").alias("t"), F.col("at_level").alias("l")))
    packed = lambda df, name: df.mapInPandas(_packer(name), f"task long, {name} binary")
    linked = space.keep(fronts.join(packed(below, "below"), "task", "left").join(packed(asked, "asked"), "task", "left").select("level", "task", "payload", "below", "asked"))
    space.drop(held, links)
    return linked, owners


def _packer(name: str):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"task": pdf.task, name: [pickle.dumps(np.array([(x["p"], x["t"], x["l"]) for x in links], dtype=np.int64).reshape(-1, 3)) for links in pdf.links]})

    return run


def _translated(e: Exception) -> Exception:
    text = str(e)
    if NotPositiveDefinite.__name__ in text:
        return SolverError(SolverFlag.NOT_POSITIVE_DEFINITE)
    if SingularMatrix.__name__ in text:
        return SolverError(SolverFlag.SINGULAR)
    return e


KERNELS = {"a posteriori": ldlt_app_front, "threshold": ldlt_front}


def _eliminated(front: np.ndarray, n: int, rows: list[int], opts: tuple) -> Front:
    positive, u, small, action, pivoting = opts
    if positive:
        return cholesky_front(front, n, rows)
    if pivoting == "none":
        return ldlt_plain_front(front, n, rows, small, action)
    return KERNELS[pivoting](front, n, rows, u, small, action)


Gift = tuple[list[int], int, np.ndarray]  # of a front to its parent's: rows, how many of them are delayed pivots, block


def _factor_task(task: int, pdf: pd.DataFrame, node_task: np.ndarray | None, node_level: np.ndarray | None, opts: tuple) -> pd.DataFrame:
    """node_task, node_level: of each supernode; None if all parents are in this task."""
    head = pdf[pdf.kind == 1].iloc[0]
    nodes: list[TaskNode] = pickle.loads(head.payload)
    a = pdf[pdf.kind == 0].sort_values(["c", "r"])
    r, c, v = a.r.tolist(), a.c.to_numpy(), a.v.tolist()
    pivots = np.array([p for x in nodes for p in x.pivots], dtype=np.int64)
    begin, end = np.searchsorted(c, pivots).tolist(), np.searchsorted(c, pivots, side="right").tolist()  # where the entries of each pivot's column stand
    pending: dict[int, list[Gift]] = {}
    for p in sorted(pdf[pdf.kind == 2].payload):
        number, gifts = pickle.loads(p)
        pending.setdefault(number, []).extend(gifts)
    done, away, stats, column = [], {}, np.zeros(6, dtype=np.int64), 0
    for x in nodes:
        gifts = pending.pop(x.number, [])
        late = [p for rows, delayed, _ in gifts for p in rows[:delayed]]
        rows = late + x.pivots + x.rows
        at = {p: k for k, p in enumerate(rows)}
        front = np.zeros((len(rows), len(rows)))
        for q in x.pivots:
            k = at[q]
            for e in range(begin[column], end[column]):
                front[at[r[e]], k] += v[e]
                if r[e] != q:
                    front[k, at[r[e]]] += v[e]
            column += 1
        for names, _, block in gifts:
            k = [at[p] for p in names]
            front[np.ix_(k, k)] += block
        n = len(late) + len(x.pivots)
        f = _eliminated(front, n, rows, opts)
        if x.parent < 0 and f.eliminated < n:
            raise SingularMatrix("a root could not be eliminated")
        done.append((f.rows, f.eliminated, f.l, f.d))
        k = f.eliminated
        stats[:2] += (f.delayed, f.two_by_two)
        stats[4] += k * (k + 1) // 2 + k * (len(rows) - k)
        stats[5] = max(stats[5], len(rows))
        if f.d is not None:
            neg, zero, _ = inertia(f.d)
            stats[2] += neg
            stats[3] += zero
        if x.parent >= 0 and len(rows) > k:
            (pending if node_task is None or node_task[x.parent] == task else away).setdefault(x.parent, []).append((f.rows[k:], f.delayed, f.rest.copy()))
    out = [(int(node_task[k]), int(node_level[k]), 1, pickle.dumps((k, gifts)), None) for k, gifts in away.items()]
    made = [(task, int(head.r), 0, pickle.dumps(done), stats.tolist()), *out]
    return pd.DataFrame(made, columns=["task", "level", "kind", "payload", "stats"])


VECTOR_SCHEMA = "kind int, level int, task long, src long, p long, w array<double>"
STARTED, ADDED, MIDDLE, TOLD, ENDED = range(5)  # kinds of rows: b, what is added to it from below, after L, what is told from above, after L'


def solve_block(factors: Factors, b: DataFrame, job: int = 0) -> DataFrame:
    """(i, w) of A x = b for a block (i, w ARRAY<DOUBLE>) of right-hand sides; rows that b lacks are zero. For job, see solve()."""
    if job not in (0, 1, 2, 3, 4):
        raise SolverError(SolverFlag.JOB_OUT_OF_RANGE)
    if factors.positive and job in (2, 4):
        raise SolverError(SolverFlag.JOB_OUT_OF_RANGE, "there is no D")
    depth, spark = factors.analysis.plan.depth, factors.space.spark
    if not depth:
        return b.limit(0).select("i", "w")
    times = lambda keep: F.transform("w", lambda x: x * F.col("s")) if keep else F.col("w")
    vectors = _Addressed(factors.space, VECTOR_SCHEMA, ["kind", "level"])
    at = b.select("i", "w").join(factors.places, "i").select("p", times(job in (0, 1)).alias("w")).join(factors.owners, "p")
    first = STARTED if job in (0, 1) else MIDDLE
    vectors.add(at.select(F.lit(first).alias("kind"), "level", "task", F.lit(-1).cast("long").alias("src"), "p", "w"))
    width = vectors.rows(kind=first).select(F.size("w").alias("n")).first()
    width = width["n"] if width else 1
    unit = not factors.positive
    end = ENDED
    if job in (0, 1):
        for level in range(depth):
            rows = vectors.rows(level=level).where(F.col("kind").isin(STARTED, ADDED))
            vectors.add(_met(factors, rows, level, _up(width, unit, divide=job == 0 and unit)))
        end = MIDDLE
    if job in (2, 4):
        vectors.add(_met(factors, vectors.rows(kind=MIDDLE), None, _across(width)))
        end = ENDED
    if job in (0, 3, 4):
        source = ENDED if job == 4 else MIDDLE
        target = vectors if job != 4 else _Addressed(factors.space, VECTOR_SCHEMA, ["kind", "level"])
        for level in reversed(range(depth)):
            rows = vectors.rows(kind=source, level=level)
            told = rows if target.empty else rows.unionByName(target.rows(kind=TOLD, level=level))
            target.add(_met(factors, told, level, _down(width, unit)))
        end, vectors = ENDED, target
    return vectors.rows(kind=end).join(factors.places, "p").select("i", times(job in (0, 3, 4)).alias("w"))


def _met(factors: Factors, rows: DataFrame, level: int | None, run) -> DataFrame:
    """run(fronts of a task, vector rows of it) for each task of the level, or of all levels."""
    fronts = factors.fronts if level is None else factors.fronts.where(F.col("level") == level)
    tasks = sum(factors.tasks) if level is None else factors.tasks[level]
    return _dealt(fronts, tasks).groupBy("task").cogroup(_dealt(rows, tasks).groupBy("task")).applyInArrow(lambda front, rows: run(front, rows), VECTOR_SCHEMA)


class _Part:
    """What a task holds of the vectors: its own positions and those below its fronts."""

    def __init__(self, front: pa.Table, rows: pa.Table, width: int) -> None:
        head = front.slice(0, 1).to_pylist()[0]
        self.task, self.level = head["task"], head["level"]
        self.fronts = pickle.loads(head["payload"])
        links = lambda x: np.zeros((0, 3), dtype=np.int64) if x is None else pickle.loads(x)
        self.below, self.asked = links(head["below"]), links(head["asked"])
        self.own = np.array(sorted(p for names, k, _, _ in self.fronts for p in names[:k]), dtype=np.int64)
        self.names = np.union1d(self.own, self.below[:, 0])
        self.x = np.zeros((len(self.names), width))
        if rows.num_rows:
            p, w = rows.column("p").to_numpy(), pa.concat_arrays([c.flatten() for c in rows.column("w").chunks]).to_numpy(zero_copy_only=False)
            order = np.lexsort((rows.column("src").to_numpy(), p))  # sums don't depend on the order of arrival
            first = np.flatnonzero(np.diff(p[order], prepend=-1))
            self.x[self.at(p[order[first]])] = np.add.reduceat(w.reshape(-1, width)[order], first, axis=0)

    def at(self, positions) -> np.ndarray:
        return np.searchsorted(self.names, positions)

    def message(self, kind: int, level, task, positions: np.ndarray) -> pa.Table:
        x, every = self.x[self.at(positions)], np.ones(len(positions), dtype=np.int64)
        w = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.table([pa.array((kind * every).astype(np.int32)), pa.array((level * every).astype(np.int32)), pa.array(task * every), pa.array(self.task * every), pa.array(positions.astype(np.int64)), w], names=VECTOR_NAMES)

    def kept(self, kind: int) -> pa.Table:
        return self.message(kind, self.level, self.task, self.own)


VECTOR_NAMES = ["kind", "level", "task", "src", "p", "w"]
NOTHING = pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))], names=VECTOR_NAMES)


def _up(width: int, unit: bool, divide: bool):
    """Solves with L; what is below goes to the tasks that hold it. divide: and with D."""

    def run(front: pa.Table, rows: pa.Table) -> pa.Table:
        if not front.num_rows:
            return NOTHING
        part = _Part(front, rows, width)
        for names, k, l, _ in part.fronts:  # noqa: E741
            at = part.at(names)
            z = solve_lower(l[:k], part.x[at[:k]], unit)
            part.x[at[:k]] = z
            if len(at) > k:
                part.x[at[k:]] -= l[k:] @ z
        if divide:
            _divide(part)
        return pa.concat_tables([part.kept(MIDDLE), part.message(ADDED, part.below[:, 2], part.below[:, 1], part.below[:, 0])])

    return run


def _divide(part: _Part) -> None:
    for names, k, _, d in part.fronts:
        at = part.at(names[:k])
        part.x[at] = apply_inverse_d(d, part.x[at])


def _across(width: int):
    """Solves with D."""

    def run(front: pa.Table, rows: pa.Table) -> pa.Table:
        if not front.num_rows:
            return NOTHING
        part = _Part(front, rows, width)
        _divide(part)
        return part.kept(ENDED)

    return run


def _down(width: int, unit: bool):
    """Solves with L'; what other tasks ask for is told to them."""

    def run(front: pa.Table, rows: pa.Table) -> pa.Table:
        if not front.num_rows:
            return NOTHING
        part = _Part(front, rows, width)
        for names, k, l, _ in reversed(part.fronts):  # noqa: E741
            at = part.at(names)
            part.x[at[:k]] = solve_lower_transposed(l[:k], part.x[at[:k]] - l[k:].T @ part.x[at[k:]], unit)
        return pa.concat_tables([part.kept(ENDED), part.message(TOLD, part.asked[:, 2], part.asked[:, 1], part.asked[:, 0])])

    return run


def solve(factors: Factors, b: DataFrame | np.ndarray, job: int = 0) -> np.ndarray | DataFrame:
    """x of A x = b; job 1 solves with the (permuted, scaled) L alone, 2 with D, 3 with L', 4 with D and L'.

    b: a DataFrame (i, x), answered by one, or for small problems an array (n,) or (n, right-hand sides). Blocks of several
    right-hand sides that stay where they are: solve_block().
    """
    if isinstance(b, DataFrame):
        return solve_block(factors, b.select("i", F.array("x").alias("w")), job).select("i", F.col("w")[0].alias("x"))
    n, spark = factors.analysis.plan.n, factors.analysis.matrix.spark
    x = np.asarray(b, dtype=float).reshape(len(b), -1)
    if len(x) != n:
        raise SolverError(SolverFlag.X_SIZE)
    block = spark.createDataFrame(pd.DataFrame({"i": np.arange(1, n + 1), "w": x.tolist()}), "i long, w array<double>")
    got = solve_block(factors, block, job).toPandas()
    out = np.empty_like(x)
    out[got.i.to_numpy() - 1] = np.array(got.w.tolist())
    return out[:, 0] if np.ndim(b) == 1 else out


def enquire_positive(factors: Factors) -> np.ndarray:
    """The diagonal of L, in elimination order. Only the diagonal comes to the driver."""
    if not factors.positive:
        raise SolverError(SolverFlag.NOT_LLT)
    return _pivots(factors).d.to_numpy()


def enquire_indefinite(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """The (1-based) variables in pivot order, negative in 2 x 2 pivots, and D^-1 as 2 x n: diagonal, and what is below it."""
    if factors.positive:
        raise SolverError(SolverFlag.NOT_LDLT)
    got = _pivots(factors)
    variable = np.array(factors.analysis.plan.order, dtype=np.int64)[got.p.to_numpy()] + 1
    return np.where(got.two, -variable, variable), got[["d", "e"]].to_numpy().T


def _pivots(factors: Factors) -> pd.DataFrame:
    """task, at (place within the task), p (position), two, d, e of every pivot, in order, taken out of the fronts where they are."""
    positive = factors.positive

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        task, rows, at = pdf.task.iloc[0], [], 0
        for names, k, l, d in pickle.loads(pdf.payload.iloc[0]):  # noqa: E741
            for q in range(k):
                rows.append((task, at, int(names[q]), False, float(l[q, q]), 0.0) if positive else (task, at, int(names[q]), bool(d[q][2] != 1), float(d[q][0]), float(d[q][1])))
                at += 1
        return pd.DataFrame(rows, columns=["task", "at", "p", "two", "d", "e"])

    got = _each(factors.fronts.select("task", "payload"), sum(factors.tasks), run, "task long, at long, p long, two boolean, d double, e double").toArrow().to_pandas()
    return got.sort_values(["task", "at"])


def alter(factors: Factors, d: np.ndarray) -> Factors:
    """The same pivots with other D^-1, as enquire_indefinite gives it. The fronts stay on the executors."""
    if factors.positive:
        raise SolverError(SolverFlag.NOT_LDLT)
    sizes = _pivots(factors).groupby("task").size()
    starts = dict(zip(sizes.index.tolist(), (sizes.cumsum() - sizes).tolist(), strict=True))
    shared = factors.fronts.sparkSession.sparkContext.broadcast((starts, np.asarray(d, dtype=float)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, new = shared.value
        at, fronts = starts.get(pdf.task.iloc[0], 0), []
        for rows, k, l, old in pickle.loads(pdf.payload.iloc[0]):  # noqa: E741
            fronts.append((rows, k, l, [(float(new[0, at + q]), float(new[1, at + q]), old[q][2]) for q in range(k)]))
            at += k
        return pdf.assign(payload=[pickle.dumps(fronts)])

    return replace(factors, fronts=factors.space.keep(_each(factors.fronts, sum(factors.tasks), run, "level int, task long, payload binary, below binary, asked binary")))


def backward_error(matrix: SparseMatrix, x: np.ndarray, b: np.ndarray) -> float:
    """Largest scaled residual over the right-hand sides. Vectors are on the driver, the matrix is summed where it is."""
    x, b = np.asarray(x, dtype=float).reshape(matrix.n, -1), np.asarray(b, dtype=float).reshape(matrix.n, -1)
    width = x.shape[1]
    columns = ", ".join(["j long", *(f"x{k} double" for k in range(width))])
    block = matrix.spark.createDataFrame(pd.DataFrame({"j": np.arange(1, matrix.n + 1)} | {f"x{k}": x[:, k] for k in range(width)}), columns)
    sums = matrix.full().join(block, "j").groupBy("i").agg(F.sum(F.abs("v")).alias("size"), *(F.sum(F.col("v") * F.col(f"x{k}")).alias(f"y{k}") for k in range(width))).toPandas()
    r = b.copy()
    r[sums.i.to_numpy() - 1] -= sums[[f"y{k}" for k in range(width)]].to_numpy()
    norm = float(sums["size"].max()) if len(sums) else 0.0
    scale = norm * np.abs(x).max(axis=0) + np.abs(b).max(axis=0)
    return float((np.abs(r).max(axis=0) / np.where(scale > 0, scale, 1)).max())
