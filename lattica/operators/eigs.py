"""Extreme and interior eigenpairs of A x = lambda B x by a block conjugate-gradient method that works at both ends at once.

A block of vectors is a DataFrame (i, w ARRAY<DOUBLE>). Each step takes Ritz pairs, at one or both ends of the spectrum, from
the span of the block, its preconditioned residuals and its last directions: one job applies the operators, one sums the
small Gram matrices, and a dense problem of three block sizes is solved on the driver. A pair that has converged leaves the
block: its vector moves to the locked columns of the same table, which stay co-located with the block, and the span is made
orthogonal to them in the metric, in the coefficients of the same Gram matrices. What it leaves in the block is filled with
the next Ritz vectors and a fresh random direction, so that blocks may be smaller than the number of pairs and multiplicities
larger than the block. Interior pairs come from solves with a factorization of A - sigma B.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from enum import IntEnum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lcg
from ..matrix import MatrixType, SparseMatrix
from . import direct
from .cutting import Workspace, cut
from .vectors import small

Block = Callable[[DataFrame], DataFrame]


class EigenFlag(IntEnum):
    # Codes of the eigensolver that this engine can give.
    SUCCESS = 0
    PROBLEM_SIZE = -9
    STORAGE = -10
    LEFT = -11
    RIGHT = -12
    B_NOT_POSITIVE = -200
    WARN_NO_DIRECTIONS = 1
    WARN_MAX_ITERATIONS = 2
    WARN_STORAGE = 3


#: What a flag means, for reports.
MESSAGES = {
    EigenFlag.SUCCESS: "all pairs asked for have converged",
    EigenFlag.PROBLEM_SIZE: "the order of the problem must be at least 1",
    EigenFlag.STORAGE: "there is no room for as many pairs",
    EigenFlag.LEFT: "more pairs are asked for on the left than there are",
    EigenFlag.RIGHT: "more pairs are asked for on the right than there are",
    EigenFlag.B_NOT_POSITIVE: "the metric isn't positive definite",
    EigenFlag.WARN_NO_DIRECTIONS: "no search directions are left; the pairs found so far are returned",
    EigenFlag.WARN_MAX_ITERATIONS: "the iteration limit was reached before all pairs converged",
    EigenFlag.WARN_STORAGE: "there was no room for all converged pairs",
}


def message(flag: EigenFlag) -> str:
    return MESSAGES[flag]


class EigenError(ValueError):
    def __init__(self, flag: EigenFlag) -> None:
        super().__init__(f"{flag.name}: {message(flag)}")
        self.flag = flag


@dataclass(frozen=True)
class Options:
    max_iterations: int = 100
    abs_tol_residual: float = 0.0
    rel_tol_residual: float = 1e-8
    abs_tol_lambda: float = 0.0
    rel_tol_lambda: float = 0.0
    tol_vector: float = 0.0  # of the estimated error of a vector, in the metric; 0: not tested
    extra: int = 0  # vectors beyond those asked for; 0: max(a tenth, 10)
    block: int = 0  # vectors iterated at once; 0: those asked for and the extra ones
    settle: int = 5  # steps that a fresh direction gets before values beyond the locked ones are locked
    seed: int = lcg.SEED


@dataclass(frozen=True)
class Eigenpairs:
    values: np.ndarray
    vectors: DataFrame  # i, w: one slot per value
    residuals: np.ndarray
    iterations: int
    flag: EigenFlag = EigenFlag.SUCCESS
    vector_errors: np.ndarray = field(default_factory=lambda: np.zeros(0))  # estimates, in the metric
    value_errors: np.ndarray = field(default_factory=lambda: np.zeros(0))
    space: Workspace | None = None

    def free(self) -> None:
        """Gives back what the vectors take in the shared folder; they can't be read any more."""
        if self.space:
            self.space.free()


@dataclass(frozen=True)
class Times:
    """The operator of a matrix on blocks; rows without entries give zeros."""

    matrix: SparseMatrix
    entries: DataFrame | None = None

    def full(self) -> DataFrame:
        return self.entries if self.entries is not None else self.matrix.full()

    def __call__(self, block: DataFrame) -> DataFrame:
        width = _width(block)
        joined = self.full().join(small(block.select(F.col("i").alias("j"), "w"), self.matrix.n * width), "j").select("i", "v", "w")
        every = joined.unionByName(block.select("i", F.lit(0.0).alias("v"), "w"))  # so that each row is there
        sums = every.groupBy("i").agg(*(F.sum(F.col("v") * F.col("w")[k]).alias(f"s{k}") for k in range(width)))
        return sums.select("i", F.array(*(F.col(f"s{k}") for k in range(width))).alias("w"))

    def hubs(self) -> np.ndarray:
        off = self.full().where("i <> j").groupBy("i").agg(F.count("*").alias("entries")).where(F.col("entries") > HUB_ENTRIES)
        return np.array(sorted(int(r["i"]) for r in off.orderBy(F.col("entries").desc(), "i").limit(MOST_HUBS).collect()), dtype=np.int64)

    def local(self, form: str, hubs: np.ndarray | None = None) -> Local | None:
        """The operator row by row, if all entries of the symmetric matrix are on the diagonal or in rows or columns of few hubs."""
        full, hubs = self.full(), self.hubs() if hubs is None else hubs
        named = [int(k) for k in hubs]
        hub_row, hub_column = F.col("i").isin(named), F.col("j").isin(named)
        if full.where((F.col("i") != F.col("j")) & ~hub_row & ~hub_column).limit(1).count():
            return None
        core = np.zeros((len(hubs), len(hubs)))
        for r in full.where(hub_row & hub_column).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            core[np.searchsorted(hubs, r["i"]), np.searchsorted(hubs, r["j"])] = r["v"]
        at = F.create_map(*(F.lit(x) for pair in zip(named, range(len(named)), strict=True) for x in pair)) if named else F.create_map().cast("map<bigint,int>")
        own = full.where((F.col("i") == F.col("j")) | ~hub_row).withColumn("e", F.when(F.col("i") != F.col("j"), F.struct(F.element_at(at, F.col("j")).alias("h"), "v")))
        rows = own.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0)).alias(f"{form}d"), F.collect_list("e").alias("e"))  # at most one item a hub, but for repeated entries
        return Local(form, hubs, core, rows.select("i", f"{form}d", F.col("e.h").cast("array<int>").alias(f"{form}h"), F.col("e.v").alias(f"{form}v")))


def times(matrix: SparseMatrix, entries: DataFrame | None = None) -> Times:
    return Times(matrix, entries)


#: A row of more entries than this may be a hub; so many hubs at most, the largest first.
HUB_ENTRIES, MOST_HUBS = 512, 256
#: A row is eliminated by its diagonal if this is at least so large, and at least this share of its largest entry; otherwise it counts as a hub.
PIVOT_SIZE, PIVOT_SHARE = 1e-20, 0.01


@dataclass(frozen=True)
class Local:
    """A symmetric matrix as an operator row by row: a row needs its own diagonal and entries, and what the block is at the hubs.

    rows: i, diagonal, places of hubs and values, which the table of the iteration carries. core: the matrix of the hubs alone.
    """

    form: str
    hubs: np.ndarray
    core: np.ndarray
    rows: DataFrame

    def columns(self) -> dict[str, str]:
        return {f"{self.form}d": "double", f"{self.form}h": "array<int>", f"{self.form}v": "array<double>"}

    def at_hubs(self, block: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the rows' entries multiply, and the product at the hubs. sums: over the rows, each times its entries h, v."""
        return block, self.core @ block + sums

    def full_rows(self, frame: DataFrame) -> DataFrame:
        """frame with the columns of the rows; rows without entries have none."""
        empty = {c: F.array().cast(t) if t.startswith("array") else F.lit(0.0) for c, t in self.columns().items()}
        return frame.join(self.rows, "i", "left").withColumns({c: F.coalesce(c, e) for c, e in empty.items()})


@dataclass(frozen=True)
class LocalInverse(Local):
    """(A - sigma B)^-1, or that times a matrix C, row by row, where all of A - sigma B is on the diagonal or in rows or columns of few hubs.

    Other rows are eliminated first, by their diagonals, which leaves the small matrix `left` at the hubs; the solution there makes that of
    every other row. What a row adds to the sums (h, v) isn't what it takes from the hubs (g, e): places from len(hubs) on are of the solution.
    """

    left: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    negative: int = 0

    def columns(self) -> dict[str, str]:
        return {**super().columns(), f"{self.form}g": "array<int>", f"{self.form}e": "array<double>"}

    def at_hubs(self, block: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        solved = np.linalg.solve(self.left, self.core @ block + sums) if len(self.hubs) else block
        return np.concatenate([block, solved]), solved


@dataclass(frozen=True)
class ByRows:
    """A local operator as one on any block."""

    found: LocalInverse

    def local(self, form: str) -> LocalInverse:
        rows = self.found.rows
        return replace(self.found, form=form, rows=rows.toDF("i", *(f"{form}{c[1:]}" for c in rows.columns[1:])))

    def __call__(self, block: DataFrame) -> DataFrame:
        own, width = self.local("a"), _width(block)
        frame = own.full_rows(block)
        derived = Derived({"a": own.hubs}, hub_sums(frame, "w", width, [own]))
        return _sized(mixed(frame, {"w": (["aw"], np.eye(width))}, derived), width)


def by_rows(shifted: SparseMatrix, after: Times | None = None) -> ByRows | None:
    """The inverse of a symmetric matrix, or that times another one, if all entries of both are on the diagonal or in rows or columns of few hubs."""
    m = Times(shifted)
    hubs = m.hubs()
    own = m.local("m", hubs)
    if own is None:
        return None
    largest = F.coalesce(F.array_max(F.transform("mv", F.abs)), F.lit(0.0))
    others = own.rows.where(~F.col("i").isin([int(k) for k in hubs]))
    weak = others.where((F.abs("md") < PIVOT_SIZE) | (F.abs("md") < PIVOT_SHARE * largest)).select("i").limit(MOST_HUBS + 1).collect()
    if len(hubs) + len(weak) > MOST_HUBS:
        return None
    if weak:
        hubs = np.union1d(hubs, [int(r["i"]) for r in weak])
        own = m.local("m", hubs)
    next_ = after.local("c", hubs) if after is not None else None
    if after is not None and next_ is None:
        return None
    n, many = shifted.n, len(hubs)
    rows = own.full_rows(m.matrix.spark.range(1, n + 1).select(F.col("id").alias("i")))
    if next_ is not None:
        rows = next_.full_rows(rows)
    else:
        rows = rows.withColumns({"cd": F.lit(1.0), "ch": F.array().cast("array<int>"), "cv": F.array().cast("array<double>")})
    rows = cut(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros((1, 2)), 1: np.zeros((many, many)), 2: np.zeros((many, many))}
        for b in batches:
            i, d = b.column("i").to_numpy(), b.column("md").to_numpy()
            free = np.ones(len(i), dtype=bool)
            free[_at_hubs(hubs, i)[0]] = False
            sums[0] += (d[free] < 0).sum(), (d[free] == 0).sum()
            dense = {}
            for form in "mc":
                row, hub, v = _own_entries(b, form)
                dense[form] = np.zeros((len(i), many))
                np.add.at(dense[form], (row, hub), v)
                dense[form] = dense[form][free]
            with np.errstate(divide="ignore", invalid="ignore"):
                low = dense["m"] / d[free, None]
            sums[1] += low.T @ dense["m"]
            sums[2] += low.T @ dense["c"]
        yield _parts(sums)

    got = _summed(rows.mapInArrow(run, PARTS))
    negative, none = (int(x) for x in got[0][0])
    if none:  # a row of no entries, which no pivot can eliminate
        return None
    left, core = own.core - got.get(1, own.core), (next_.core if next_ is not None else np.eye(many)) - got.get(2, own.core)
    values = np.linalg.eigvalsh((left + left.T) / 2) if many else np.zeros(0)
    if many and np.abs(values).min() <= 1e-14 * np.abs(values).max():
        return None
    at_hub = F.col("i").isin([int(k) for k in hubs])
    d = F.when(at_hub, F.lit(1.0)).otherwise(F.col("md"))
    over = rows.withColumn("d", d).select(
        "i",
        (F.col("cd") / F.col("d")).alias("md"),
        F.concat("ch", "mh").alias("mh"),
        F.concat("cv", F.transform("mv", lambda v: -v * F.col("cd") / F.col("d"))).alias("mv"),
        F.concat("ch", F.transform("mh", lambda h: h + many)).alias("mg"),
        F.concat(F.transform("cv", lambda v: v / F.col("d")), F.transform("mv", lambda v: -v / F.col("d"))).alias("me"),
    )
    return ByRows(LocalInverse("m", hubs, core, over, left, negative + int((values < 0).sum())))


def _at_hubs(hubs: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are hubs, and their places."""
    at = np.minimum(np.searchsorted(hubs, i), max(len(hubs) - 1, 0))
    own = np.flatnonzero(hubs[at] == i) if len(hubs) else np.zeros(0, dtype=np.int64)
    return own, at[own]


def _own_entries(b: pa.RecordBatch, form: str, names: str = "hv") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a batch's rows in columns of hubs: row, hub, value."""
    h = b.column(f"{form}{names[0]}")
    return np.repeat(np.arange(b.num_rows), np.diff(h.offsets.to_numpy())), h.flatten().to_numpy(), b.column(f"{form}{names[1]}").flatten().to_numpy()


@dataclass(frozen=True)
class Derived:
    """Columns that a task makes from those that are stored: products by local matrices, and residuals.

    known: for (form, kind) the block of that kind at the hubs, and its product there.
    """

    hubs: dict[str, np.ndarray] = field(default_factory=dict)
    known: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    metric: str = "x"

    def source(self, name: str, stored: list[str]) -> list[str]:
        """The stored columns that a column needs."""
        if name in stored:
            return [name]
        if name == "r":
            return [*self.source("ax", stored), *self.source(self.metric, stored)]
        return [name[1:], *(c for c in (f"{name[0]}{c}" for c in "dhvge") if c in stored)]

    def __call__(self, b: pa.RecordBatch, name: str) -> np.ndarray:
        return self.made(b, [name])[name]

    def made(self, b: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
        """The named columns; products by one matrix are made together."""
        stored = b.schema.names
        out = {c: _array(b, c) for c in names if c in stored}
        missing = [c for c in names if c not in stored and c != "r"] + [c for c in ("ax", self.metric) if "r" in names and "r" not in stored and c not in out and c not in names]
        for form in {c[0] for c in missing if c not in stored}:
            kinds = [c[1:] for c in missing if c[0] == form and c not in stored]
            blocks = [out[k] if k in out else _array(b, k) for k in kinds]
            ends = np.cumsum([x.shape[1] for x in blocks])[:-1]
            both = [np.concatenate([self.known[form, k][h] for k in kinds], axis=1) for h in (0, 1)]
            product = self.product(b, form, np.concatenate(blocks, axis=1), *both)
            out |= {f"{form}{k}": x for k, x in zip(kinds, np.split(product, ends, axis=1), strict=True)}
        if "r" in names and "r" not in stored:
            out["r"] = out["ax"] - (out[self.metric] if self.metric in out else _array(b, self.metric)) * self.values
        return out

    def product(self, b: pa.RecordBatch, form: str, w: np.ndarray, at_hubs: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = b.column(f"{form}d").to_numpy()[:, None] * w
        row, hub, v = _own_entries(b, form, "ge" if f"{form}g" in b.schema.names else "hv")
        part = v[:, None] * at_hubs[hub]
        if not (np.diff(row) > 0).all():
            np.add.at(out, row, part)
        elif len(row) == len(out):
            out += part
        else:
            out[row] += part
        own, at = _at_hubs(self.hubs[form], b.column("i").to_numpy())
        out[own] = there[at]
        return out


@dataclass(frozen=True)
class Jacobi:
    """Division by the diagonal; rows without one stay."""

    matrix: SparseMatrix
    diagonal: DataFrame

    def __call__(self, block: DataFrame) -> DataFrame:
        return block.join(small(self.diagonal, self.matrix.n), "i", "left").select("i", F.transform("w", lambda x: x / F.coalesce("d", F.lit(1.0))).alias("w"))


def jacobi(matrix: SparseMatrix) -> Jacobi:
    return Jacobi(matrix, cut(matrix.entries.where("i = j and v <> 0").groupBy("i").agg(F.sum("v").alias("d"))))


def _width(block: DataFrame) -> int:
    return int(block.schema["w"].metadata["width"])


def _sized(block: DataFrame, width: int) -> DataFrame:
    return block.withColumn("w", F.col("w").alias("w", metadata={"width": width}))


def random_block(spark, n: int, width: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch({"i": b.column(0), "w": _lists(lcg.reals(b.column(0).to_numpy(), width, seed, n))})

    return _sized(spark.range(1, n + 1).mapInArrow(run, "i long, w array<double>"), width)


def _array(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))


#: So many tasks add up the small matrices of all others, and the driver what is theirs.
ADDERS = 8


def _added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, rows, s in zip(b.column("k").to_pylist(), b.column("rows").to_pylist(), b.column("s"), strict=True):
            if rows:
                sums[k] = sums.get(k, 0) + s.values.to_numpy().reshape(rows, -1)
    return sums


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Matrices (k, rows, s) of tasks, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _parts(_added(batches))

    return _added(parts.repartition(ADDERS).mapInArrow(run, PARTS).toArrow().to_batches())


#: Rows of a matrix that the table of a local run holds as one value: their columns as an Arrow stream. So Spark moves bytes, not numbers.
CHUNK = 2048
#: Bytes of block, directions and search vectors that a part of that table may hold.
PART_BYTES = 1 << 26
PACKED = "chunk binary, k long, rows long, s array<double>"
#: A reader holds a row group of such values whole: it is to be of 16 MB, and cut by size from so few values on.
LARGE_VALUES = {"parquet.block.size": str(1 << 24), "parquet.page.size.row.check.min": "8", "parquet.block.size.row.check.min": "8", "parquet.enable.dictionary": "false"}


def _packed(columns: dict) -> pa.RecordBatch:
    b, sink = pa.record_batch(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as stream:
        stream.write_batch(b)
    data = sink.getvalue()
    chunk = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.size], dtype=np.int32)), data])
    return pa.record_batch([chunk, *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["chunk", "k", "rows", "s"])


def _packed_sums(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    b = _parts(sums)
    return pa.record_batch([pa.nulls(b.num_rows, pa.binary()), *b.columns], names=["chunk", "k", "rows", "s"])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a table, or those that are its chunks."""
    for b in batches:
        if b.schema.names != ["chunk"]:
            yield b
            continue
        for x in b.column("chunk"):
            if x.is_valid:
                with pa.ipc.open_stream(x.as_buffer()) as stream:
                    yield from stream


def _parts(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({"k": pa.array(sums, pa.int64()), "rows": pa.array([len(s) for s in sums.values()], pa.int64()), "s": pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))})


PARTS = "k long, rows long, s array<double>"


def _needed(frame: DataFrame, names: list[str], derived: Derived) -> list[str]:
    if "chunk" in frame.columns:
        return ["chunk"]
    return sorted({"i", *(c for name in names for c in derived.source(name, frame.columns))})


def gram_matrices(frame: DataFrame, names: list[str], pairs: list[tuple[str, str]], derived: Derived = Derived()) -> dict[tuple[str, str], np.ndarray]:
    """U'V for pairs of array columns: each task sums its rows, and few tasks what these have."""
    first: dict[str, list[int]] = {}  # pairs by their first column, which meets the others at once
    for k, (p, _) in enumerate(pairs):
        first.setdefault(p, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in _batches(batches):
            if b.num_rows:
                a = derived.made(b, names)
                for p, own in first.items():
                    right = np.concatenate([a[pairs[k][1]] for k in own], axis=1)
                    for k, x in zip(own, np.split(a[p].T @ right, np.cumsum([a[pairs[k][1]].shape[1] for k in own])[:-1], axis=1), strict=True):
                        sums[k] = sums.get(k, 0) + x
        yield _parts(sums)

    return {pairs[k]: g for k, g in _summed(frame.select(*_needed(frame, names, derived)).mapInArrow(run, PARTS)).items()}


class HubSums:
    """For each of some local matrices the block at its hubs, and the sums over the rows' own entries there, by symmetry."""

    def __init__(self, hubs: dict[str, np.ndarray], width: int) -> None:
        self.hubs = hubs
        self.sums = {k: np.zeros((len(h), width)) for f, h in enumerate(hubs.values()) if len(h) for k in (2 * f, 2 * f + 1)}

    def add(self, b: pa.RecordBatch, w: np.ndarray) -> None:
        for f, (form, h) in enumerate(self.hubs.items()):
            if len(h):
                own, at = _at_hubs(h, b.column("i").to_numpy())
                self.sums[2 * f][at] += w[own]
                row, hub, v = _own_entries(b, form)
                part = v[:, None] * w[row]
                self.sums[2 * f + 1] += np.stack([np.bincount(hub, part[:, k], minlength=len(h)) for k in range(w.shape[1])], axis=1)


def _known(got: dict[int, np.ndarray], kind: str, width: int, forms: list[Local]) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    none = np.zeros((0, width))
    return {(x.form, kind): x.at_hubs(got[2 * f], got[2 * f + 1]) if len(x.hubs) else (none, none) for f, x in enumerate(forms)}


def hub_sums(frame: DataFrame, kind: str, width: int, forms: list[Local]) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """For each matrix what its rows take from its hubs for the block of a kind, and the product there."""
    hubs = {x.form: x.hubs for x in forms}
    if not any(map(len, hubs.values())):
        return _known({}, kind, width, forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = HubSums(hubs, width)
        for b in _batches(batches):
            if b.num_rows:
                sums.add(b, _array(b, kind))
        yield _parts(sums.sums)

    columns = ["chunk"] if "chunk" in frame.columns else ["i", kind, *(c for x in forms for c in x.columns())]
    return _known(_summed(frame.select(*columns).mapInArrow(run, PARTS)), kind, width, forms)


def started(frame: DataFrame, random: int, width: int, given: bool, seed: int, n: int) -> DataFrame:
    """The packed table of rows with their entries and given vectors: the block is made here, random vectors after those that are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                x = lcg.reals(b.column("i").to_numpy(), random, seed, n)
                if given:
                    x = np.concatenate([_array(b, "g"), x], axis=1)[:, :width]
                yield _packed({c: b.column(c) for c in b.schema.names if c != "g"} | {"x": _lists(x)})

    cores = min(frame.sparkSession.sparkContext.defaultParallelism, -(-n // CHUNK))
    rounds = -(-n * width * 24 // (PART_BYTES * cores))
    return frame.repartition(rounds * cores, "i").mapInArrow(run, PACKED)


@dataclass(frozen=True)
class Search:
    """How the rows of a packed table make their search vectors from residuals: divided by the diagonal where asked, then fresh random ones."""

    divided: np.ndarray
    fresh: int
    seed: int
    n: int

    def __call__(self, b: pa.RecordBatch, r: np.ndarray) -> np.ndarray:
        if self.divided.any():
            d = b.column("ad").to_numpy()
            r = np.where(self.divided, r / np.where(d != 0, d, 1.0)[:, None], r)
        return np.concatenate([r, lcg.reals(b.column("i").to_numpy(), self.fresh, self.seed, self.n)], axis=1) if self.fresh else r


def advanced(frame: DataFrame, kinds: list[str], made: dict[str, np.ndarray], derived: Derived, carried: list[str], search: Search) -> DataFrame:
    """The next packed table: combinations of the columns of all kinds by stacked coefficients, and the search block w from residuals of the new block.

    derived: of the new block. Each task adds a row for each of the sums of w at the hubs.
    """
    width = made["x"].shape[1] + search.fresh
    ends = np.cumsum([m.shape[1] for m in made.values()])[:-1]
    every = np.concatenate(list(made.values()), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = HubSums(derived.hubs, width)
        for b in _batches(batches):
            own = {"i": b.column("i")} | {c: b.column(c) for c in carried}
            mixed_ = np.split(np.concatenate([_array(b, k) for k in kinds], axis=1) @ every, ends, axis=1)
            new = pa.record_batch(own | {k: _lists(x) for k, x in zip(made, mixed_, strict=True)})
            w = search(new, derived(new, "r"))
            sums.add(new, w)
            yield _packed(dict(zip(new.schema.names, new.columns, strict=True)) | {"w": _lists(w)})
        yield _packed_sums(sums.sums)

    return frame.select("chunk").mapInArrow(run, PACKED)


def mixed(frame: DataFrame, made: dict[str, tuple[list[str], np.ndarray]], derived: Derived = Derived()) -> DataFrame:
    """i and, for each name, the combination of the named array columns by stacked coefficients: products of row batches."""
    names = sorted({c for columns, _ in made.values() for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            if b.num_rows:
                a = derived.made(b, names)
                yield pa.record_batch({"i": b.column("i")} | {k: _lists(np.concatenate([a[c] for c in columns], axis=1) @ m) for k, (columns, m) in made.items()})

    schema = ", ".join(["i long", *(f"{k} array<double>" for k in made)])
    return frame.select(*_needed(frame, names, derived)).mapInArrow(run, schema)


def reduced(a: np.ndarray, b: np.ndarray, floor: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a c = t b c on the part of the space where b is well above zero."""
    scale = 1 / np.sqrt(np.maximum(np.diag(b), 1e-300))
    w, q = np.linalg.eigh((b * scale).T * scale)
    keep = w > floor * w[-1]
    base = (q[:, keep] / np.sqrt(w[keep])) * scale[:, None]
    t, y = np.linalg.eigh(base.T @ a @ base)
    return t, base @ y


@dataclass
class Wanted:
    """How many pairs are wanted at each end, or of the largest modulus, and how a block is divided between the ends."""

    left: int = 0
    right: int = 0
    largest: int = 0

    @property
    def count(self) -> int:
        return self.left + self.right + self.largest

    def split(self, values: np.ndarray, width: int, locked: dict[int, list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ascending Ritz values make up the block, and the side of each (0 left, 1 right), the outermost of a side first."""
        n, width = len(values), min(width, len(values))
        if self.largest:
            order = np.argsort(-np.abs(values), kind="stable")[:width]
            low, high = np.sort(order[values[order] < 0]), np.sort(order[values[order] >= 0])[::-1]
            return np.concatenate([low, high]), np.repeat([0, 1], [len(low), len(high)])
        open_ = [max(self.left - len(locked[0]), 0), max(self.right - len(locked[1]), 0)]
        if not sum(open_):
            open_ = [self.left, self.right]
        low = 0 if not open_[0] else width if not open_[1] else min(max(1, round(width * open_[0] / sum(open_))), max(width - 1, 1))
        return np.concatenate([np.arange(low), n - 1 - np.arange(width - low)]).astype(int), np.repeat([0, 1], [low, width - low])

    def reached(self, locked: dict[int, list[float]], outer: dict[int, float]) -> bool:
        """Whether the locked pairs are enough. outer: the outermost value of each side that is not locked."""
        if not self.largest:
            return len(locked[0]) >= self.left and len(locked[1]) >= self.right
        sizes = sorted((abs(v) for x in locked.values() for v in x), reverse=True)
        return len(sizes) >= self.largest and all(abs(v) <= sizes[self.largest - 1] * (1 + 1e-10) for v in outer.values())

    def chosen(self, values: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Indices, in ascending order of value, of the pairs that are wanted among those found."""
        if self.largest:
            own = np.argsort(-np.abs(values), kind="stable")[: self.largest]
        else:
            low, high = (np.flatnonzero(sides == s) for s in (0, 1))
            own = np.concatenate([low[np.argsort(values[low], kind="stable")][: self.left], high[np.argsort(-values[high], kind="stable")][: self.right]])
        return own[np.argsort(values[own], kind="stable")].astype(int)


class Errors:
    """Estimates of the errors of the block's values and vectors, from the sizes of past steps, the residuals and the gaps.

    The change of a vector in a step, and the rate at which such changes shrink, bound what is still to come as a geometric
    series. In the plain metric the residual over the gap to other values bounds the error too; the larger counts.
    """

    def __init__(self, plain: bool) -> None:
        self.plain = plain
        self.steps: dict[int, list[np.ndarray]] = {0: [], 1: []}

    def moved(self, sides: np.ndarray, sizes: np.ndarray, locked: dict[int, int]) -> None:
        """sizes: of the last step of each of the new block's vectors; locked: how many of each side have left since."""
        for s in (0, 1):
            old = [x[locked[s] :] for x in self.steps[s]]
            self.steps[s] = [*old[-3:], sizes[sides == s]]

    def kinematic(self, sides: np.ndarray) -> np.ndarray:
        out = np.full(len(sides), np.inf)
        for s in (0, 1):
            own, past = np.flatnonzero(sides == s), self.steps[s]
            for k, at in enumerate(own):
                seen = [x[k] for x in past if k < len(x)]
                if len(seen) >= 3 and seen[-1] > 0:
                    rate = max(b / a if a > 0 else 1.0 for a, b in zip(seen[-3:-1], seen[-2:], strict=True))
                    out[at] = seen[-1] * rate / (1 - rate) if rate < 1 else np.inf
        return out

    @staticmethod
    def gaps(values: np.ndarray, others: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Distance of each value from the closest of all others that is further away than its own cluster reaches."""
        out = np.empty(len(values))
        for k, v in enumerate(values):
            far = np.abs(np.concatenate([values, others]) - v)
            far = far[far > near[k]]
            out[k] = far.min() if len(far) else max(abs(v), 1e-300)
        return out

    def estimates(self, values: np.ndarray, others: np.ndarray, sides: np.ndarray, residuals: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
        """Of vectors and of values."""
        gap = self.gaps(values, others, np.maximum(10 * residuals, 1e-7 * scale))
        vectors = self.kinematic(sides)
        if self.plain:
            bound = residuals / gap
            vectors = np.where(np.isfinite(vectors), np.maximum(vectors, bound), bound)
        return vectors, np.minimum(residuals, residuals**2 / gap)


class Engine:
    """The iteration. Its table has i and array columns: block x, directions p, locked y, each with its products by A (and B)."""

    def __init__(self, spark, n: int, wanted: Wanted, apply_a: Block, apply_b: Block | None, precondition: Block | None, options: Options, inner: bool = False) -> None:
        self.inner = inner and apply_b is not None  # A is given as B^-1 A, which is symmetric in the metric of B
        self.spark, self.n, self.wanted, self.options = spark, n, wanted, options
        self.apply_a, self.apply_b, self.precondition = apply_a, apply_b, precondition
        self.forms = ("", "a", "b") if apply_b else ("", "a")
        own_diagonal = isinstance(precondition, Jacobi) and isinstance(apply_a, Times) and precondition.matrix is apply_a.matrix
        able = precondition is None or own_diagonal  # a row can make its search vectors itself
        found = [x.local(o) for o, x in (("a", apply_a), ("b", apply_b)) if able and isinstance(x, (Times, ByRows))]
        self.local = found if all(found) and len(found) == len(self.forms) - 1 else []  # products by these are made in tasks and not stored
        self.stored = [o for o in self.forms if o not in [x.form for x in self.local]]
        self.derived = Derived({x.form: x.hubs for x in self.local}, metric="x" if self.inner else self.metric("x"))
        self.space = Workspace(spark)
        self.locked: dict[int, list[float]] = {0: [], 1: []}
        self.found: list[tuple[float, int, float, float, float]] = []  # value, side, residual, errors of vector and value, in the order of columns of y
        self.constraints, self.fresh, self.last_lock = 0, 0, {0: -(10**9), 1: -(10**9)}
        self.errors = Errors(apply_b is None)

    def metric(self, k: str) -> str:
        return f"b{k}" if self.apply_b else k

    def products(self, block: DataFrame, kind: str) -> DataFrame:
        """The block and its products that are stored."""
        out = block.select("i", F.col("w").alias(kind))
        for o in self.stored[1:]:
            out = out.join((self.apply_a if o == "a" else self.apply_b)(block).select("i", F.col("w").alias(f"{o}{kind}")), "i")
        return out

    def start(self, width: int, given: DataFrame | None, constraints: DataFrame | None) -> None:
        kinds, widest = ["x"], max(width, _width(given) if given is not None else 0)
        if constraints is not None:
            self.constraints = _width(constraints)
            kinds.append("y")
        if self.local:
            table = self.spark.range(1, self.n + 1).select(F.col("id").alias("i"))
            for x in self.local:
                table = x.full_rows(table)
            for name, block in (("g", given), ("y", constraints)):
                if block is not None:
                    table = table.join(block.select("i", F.col("w").alias(name)), "i")
            work = self.space.keep(started(table, width, widest, given is not None, self.options.seed, self.n), **LARGE_VALUES)
            for kind, many in zip(kinds, (widest, self.constraints), strict=False):
                self.derived.known.update(hub_sums(work, kind, many, self.local))
        else:
            x = random_block(self.spark, self.n, width, self.options.seed)
            if given is not None:
                both = x.join(given.select("i", F.col("w").alias("g")), "i").select("i", F.slice(F.concat("g", "w"), 1, widest).alias("w"))
                x = _sized(both, widest)
            table = self.products(x, "x")
            if constraints is not None:
                table = table.join(self.products(constraints, "y"), "i")
            work = self.space.keep(table)
        ga, gb = self.grams(work, kinds)
        keep = np.eye(len(ga))
        if self.constraints:  # given vectors needn't be orthonormal
            y = slice(len(ga) - self.constraints, None)
            w, q = np.linalg.eigh(gb[y, y])
            q = q[:, w > 1e-12 * w[-1]] / np.sqrt(w[w > 1e-12 * w[-1]])
            base = np.zeros((len(ga), q.shape[1]))
            base[y] = q
            self.constraints = q.shape[1]
            keep = keep[:, : len(ga) - len(gb[y])]
        else:
            base = np.zeros((len(ga), 0))
        self.rayleigh_ritz(work, kinds, ga, gb, keep, base, width, 0)
        self.read = work  # until the table of the first step is written

    def grams(self, frame: DataFrame, kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A and the metric on the span of the columns of all kinds."""
        columns = [f"{o}{k}" for k in kinds for o in self.forms]
        upper = [(p, q) for a, p in enumerate(kinds) for q in kinds[a:]]
        side = self.metric if self.inner else lambda p: p
        pairs = [(side(p), f"a{q}") for p, q in upper] + [(p, self.metric(q)) for p, q in upper]
        extra = ["r"] if "w" in kinds else []
        g = gram_matrices(frame, [*columns, *extra], pairs + [(r, r) for r in extra], self.derived)
        whole = lambda e, f: np.block([[g[e(p), f(q)] if a <= b else g[e(q), f(p)].T for b, q in enumerate(kinds)] for a, p in enumerate(kinds)])
        ga, gb = whole(side, lambda q: f"a{q}"), whole(lambda p: p, self.metric)
        self.residuals = np.sqrt(np.maximum(np.diag(g["r", "r"]), 0)) if extra else None
        return (ga + ga.T) / 2, (gb + gb.T) / 2

    def rayleigh_ritz(self, work: DataFrame, kinds: list[str], ga: np.ndarray, gb: np.ndarray, span: np.ndarray, base: np.ndarray, width: int, old: int) -> bool:
        """The next block from the span, made orthogonal to base, whose columns become y. old: columns of the span that are of the block."""
        span = span - base @ (base.T @ gb @ span)
        t, c = reduced(span.T @ ga @ span, span.T @ gb @ span)
        at, sides = self.wanted.split(t, width, self.locked)
        if len(at) < min(width, self.wanted.count - len(self.found)):
            return False
        coefficients, directions = c[:, at], c[:, at].copy()
        directions[:old] = 0  # the new directions leave out the old block
        p = span @ directions
        self.values, self.sides, self.others = t[at], sides, np.delete(t, at)
        self.sizes = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", p, gb, p), 0))
        x = span @ coefficients
        new = {"x": x} | ({"p": p} if old else {}) | ({"y": base} if base.shape[1] else {})
        self.has_p = bool(old)
        if not self.local:
            made = {f"{o}{k}": ([f"{o}{q}" for q in kinds], m) for o in self.stored for k, m in new.items()}
            made["r"] = [f"a{k}" for k in kinds] + [k if self.inner else self.metric(k) for k in kinds], np.concatenate([x, -x * self.values])
            self.state = mixed(work, made)
            return True
        known = {(f, k): tuple(np.concatenate([self.derived.known[f, q][h] for q in kinds], axis=1) @ m for h in (0, 1)) for f in self.derived.hubs for k, m in new.items()}
        self.derived = replace(self.derived, known=known, values=self.values)
        self.state = work, kinds, new, self.derived
        return True

    def step(self, number: int) -> tuple[DataFrame, list[str]]:
        """The table, written, with residuals and search block w, and what it holds."""
        state, width, seed = self.state, len(self.values), self.options.seed + 7919 * number
        kinds = ["x", "w", *(["p"] if self.has_p else []), *(["y"] if self.constraints + len(self.found) else [])]
        self.direction = None
        if self.local:
            search = Search(self.sides == 0 if self.precondition else np.zeros(width, dtype=bool), self.fresh, seed, self.n)
            work = self.space.keep(advanced(*state, [c for x in self.local for c in x.columns()], search), **LARGE_VALUES)
            self.derived.known.update(_known(_summed(work.where("k is not null").select("k", "rows", "s")), "w", width + self.fresh, self.local))
            return work, kinds
        w = _sized(state.select("i", F.col("r").alias("w")), width)
        if self.precondition:  # of what belongs to the left end
            both = self.precondition(w).select("i", F.col("w").alias("t")).join(w, "i")
            w = _sized(self.space.keep(both.select("i", F.array(*(F.col("w" if s else "t")[k] for k, s in enumerate(self.sides.tolist()))).alias("w"))), width)
        if self.fresh:
            bits = max(1, (self.n * self.fresh).bit_length())
            cells = [lcg.as_real(lcg.state((F.col("i") - 1) * self.fresh + (k + 1), seed, bits)) for k in range(self.fresh)]
            w = _sized(w.select("i", F.concat("w", F.array(*cells)).alias("w")), width + self.fresh)
        self.direction = w
        return self.space.keep(state.join(self.products(w, "w"), "i")), kinds

    def converged(self, last: dict[int, np.ndarray]) -> np.ndarray:
        o, size = self.options, max([float(np.abs(self.values).max()), *(abs(f[0]) for f in self.found)])
        self.scale = max(self.scale, size) if self.scale else max(size, 1e-300)
        self.vector_errors, self.value_errors = self.errors.estimates(self.values, np.concatenate([self.others, [f[0] for f in self.found]]), self.sides, self.residuals, self.scale)
        enough = np.ones(len(self.values), dtype=bool)
        if o.abs_tol_residual or o.rel_tol_residual:
            enough &= self.residuals <= max(o.abs_tol_residual, o.rel_tol_residual * self.scale)
        if o.abs_tol_lambda or o.rel_tol_lambda:
            moved = np.full(len(self.values), np.inf)
            for s in (0, 1):
                own = np.flatnonzero(self.sides == s)
                k = min(len(own), len(last[s]))
                moved[own[:k]] = np.abs(self.values[own[:k]] - last[s][:k])
            enough &= moved <= np.maximum(o.abs_tol_lambda, o.rel_tol_lambda * np.abs(self.values))
        if o.tol_vector:
            enough &= self.vector_errors <= o.tol_vector
        return enough

    def lockable(self, enough: np.ndarray, number: int) -> list[int]:
        """Columns that leave the block: on each side the outermost ones, as long as they have converged."""
        out = []
        for s in (0, 1):
            for k in np.flatnonzero(self.sides == s):
                beyond = not self.locked[s] or (self.values[k] > max(self.locked[0]) if s == 0 else self.values[k] < min(self.locked[1])) and abs(self.values[k] - self.locked[s][-1]) > 1e-6 * self.scale
                waits = self.short and beyond and number - self.last_lock[s] < self.options.settle
                if not enough[k] or waits:
                    break
                out.append(int(k))
        return out

    def run(self, width: int, given: DataFrame | None, constraints: DataFrame | None) -> Eigenpairs:
        self.scale, self.short = 0.0, width < self.wanted.count
        self.start(width, given, constraints)
        last: dict[int, np.ndarray] = {0: np.zeros(0), 1: np.zeros(0)}
        for number in range(1, self.options.max_iterations + 1):
            work, kinds = self.step(number)
            self.space.drop(self.read, self.direction)
            self.read = work
            ga, gb = self.grams(work, kinds)
            m, f = len(self.values), self.fresh
            leave = self.lockable(self.converged(last), number)
            counts = {s: sum(self.sides[k] == s for k in leave) for s in (0, 1)}
            for k in leave:
                s = int(self.sides[k])
                self.locked[s].append(float(self.values[k]))
                self.found.append((float(self.values[k]), s, float(self.residuals[k]), float(self.vector_errors[k]), float(self.value_errors[k])))
            for s in (0, 1):
                if counts[s]:
                    self.last_lock[s] = number
            stay = [k for k in range(m) if k not in leave]
            outer = {int(self.sides[k]): float(self.values[k]) for k in reversed(stay)}
            every = np.eye(len(ga))
            y = len(ga) - (self.constraints + len(self.found) - len(leave))
            base = np.concatenate([every[:, y:], every[:, leave]], axis=1)
            if self.wanted.reached(self.locked, outer):
                return self.result(work, kinds, base, number, EigenFlag.SUCCESS)
            if number == self.options.max_iterations:
                break
            span = every[:, [*stay, *(m + k for k in stay), *range(2 * m, 2 * m + f), *range(2 * m + f, y)]]
            last = {s: self.values[self.sides == s][counts[s] :] for s in (0, 1)}
            if not self.rayleigh_ritz(work, kinds, ga, gb, span, base, width, len(stay)):
                return self.result(work, kinds, self.filled(base, every, stay), number, EigenFlag.WARN_NO_DIRECTIONS)
            self.errors.moved(self.sides, self.sizes, counts)
            self.fresh = len(leave)
        return self.result(work, kinds, self.filled(base, every, stay), self.options.max_iterations, EigenFlag.WARN_MAX_ITERATIONS)

    def filled(self, base: np.ndarray, every: np.ndarray, stay: list[int]) -> np.ndarray:
        """base and what the block has so far."""
        for k in stay:
            self.found.append((float(self.values[k]), int(self.sides[k]), float(self.residuals[k]), float(self.vector_errors[k]), float(self.value_errors[k])))
        return np.concatenate([base, every[:, stay]], axis=1)

    def result(self, work: DataFrame, kinds: list[str], base: np.ndarray, number: int, flag: EigenFlag) -> Eigenpairs:
        table = np.array(self.found)
        own = self.wanted.chosen(table[:, 0], table[:, 1])
        vectors = self.space.keep(mixed(work, {"w": (list(kinds), base[:, self.constraints :][:, own])}))
        self.space.drop(work)
        return Eigenpairs(table[own, 0], _sized(vectors, len(own)), table[own, 2], number, flag, table[own, 3], table[own, 4], self.space)


def extreme(spark, n: int, wanted: Wanted, apply_a: Block, apply_b: Block | None = None, precondition: Block | None = None, options: Options = Options(), start: DataFrame | None = None, constraints: DataFrame | None = None, inner: bool = False) -> Eigenpairs:
    """The wanted pairs of A x = lambda B x, B positive definite (none: identity), in one run. inner: apply_a is B^-1 A.

    start: a block to begin with. constraints: a block of vectors that all pairs are to be orthogonal to in the metric, such as
    the vectors of an earlier run that is to be carried on with further pairs.
    """
    if n < 1:
        raise EigenError(EigenFlag.PROBLEM_SIZE)
    fixed = _width(constraints) if constraints is not None else 0
    for count, flag in ((wanted.left, EigenFlag.LEFT), (wanted.right, EigenFlag.RIGHT), (wanted.largest, EigenFlag.LEFT)):
        if count < 0 or 2 * count > n - fixed:
            raise EigenError(flag)
    if wanted.count > n - fixed:
        raise EigenError(EigenFlag.RIGHT)
    if not wanted.count:
        return Eigenpairs(np.zeros(0), _sized(spark.createDataFrame([], "i long, w array<double>"), 0), np.zeros(0), 0)
    ends = 1 if wanted.largest or not (wanted.left and wanted.right) else 2
    width = options.block or min(wanted.count + ends * (options.extra or max(wanted.count // 10, 10)), max(n // 2 - 1, wanted.count, 1))
    return Engine(spark, n, wanted, apply_a, apply_b, precondition, options, inner).run(max(min(width, n - fixed), 1), start, constraints)


def smallest(spark, n: int, count: int, apply_a: Block, apply_b: Block | None = None, precondition: Block | None = None, options: Options = Options(), start: DataFrame | None = None, constraints: DataFrame | None = None) -> Eigenpairs:
    """The `count` leftmost pairs."""
    return extreme(spark, n, Wanted(left=count), apply_a, apply_b, precondition, options, start, constraints)


def standard(a: SparseMatrix, left: int, right: int = 0, precondition: Block | None = None, options: Options = Options(), start: DataFrame | None = None, constraints: DataFrame | None = None) -> Eigenpairs:
    """The left leftmost and right rightmost pairs of A, in one run."""
    return generalized(a, None, left, right, precondition, options, start, constraints)


def generalized(a: SparseMatrix, b: SparseMatrix | None, left: int, right: int = 0, precondition: Block | None = None, options: Options = Options(), start: DataFrame | None = None, constraints: DataFrame | None = None) -> Eigenpairs:
    return extreme(a.spark, a.n, Wanted(left, right), times(a), times(b) if b is not None else None, precondition, options, start, constraints)


def largest(a: SparseMatrix, count: int, b: SparseMatrix | None = None, options: Options = Options()) -> Eigenpairs:
    """The pairs of largest modulus. The block is divided between the ends anew at each step, by where the larger values are."""
    return extreme(a.spark, a.n, Wanted(largest=count), times(a), times(b) if b is not None else None, None, options)


def _shifted(a: SparseMatrix, b: SparseMatrix | None, sigma: float) -> SparseMatrix:
    other = b.entries if b is not None else a.spark.range(1, a.n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    both = a.entries.select("i", "j", "v").unionByName(other.select("i", "j", (-sigma * F.col("v")).alias("v")))
    return SparseMatrix(cut(both.groupBy("i", "j").agg(F.sum("v").alias("v"))), a.n, a.n, MatrixType.REAL_SYM_INDEF)


def inverse(factors: direct.Factors) -> Block:
    """Solves with factors, on blocks, which stay where the fronts are."""

    def apply(block: DataFrame) -> DataFrame:
        return _sized(direct.solve_block(factors, block), _width(block))

    return apply


def _inverse(a: SparseMatrix, b: SparseMatrix | None, sigma: float, left: int, right: int, after: Times | None) -> Block:
    """(A - sigma B)^-1, after a matrix: by rows if few hubs hold all that isn't diagonal, otherwise by solves with a factorization.

    The inertia of A - sigma B tells how many pairs are below sigma: asking for more of a side is an error.
    """
    shifted = _shifted(a, b, sigma)
    if found := by_rows(shifted, after):
        below, above = found.found.negative, shifted.n - found.found.negative
    else:
        factors = direct.factor(direct.analyse(shifted))
        below, _, above = factors.inertia
    if left > below:
        raise EigenError(EigenFlag.LEFT)
    if right > above:
        raise EigenError(EigenFlag.RIGHT)
    return found or _after(inverse(factors), after)


def _after(solve: Block, first: Times | None) -> Block:
    return (lambda x: solve(_sized(first(x), _width(x)))) if first else solve


def shift_invert(a: SparseMatrix, sigma: float, left: int, right: int, b: SparseMatrix | None = None, options: Options = Options(), solver: Block | None = None) -> Eigenpairs:
    """The left pairs next below sigma and the right pairs next above: mu = 1 / (lambda - sigma) of (A - sigma B)^-1 B in the metric of B.

    A caller's solver, which has no inertia to ask, is trusted to have that many pairs on each side.
    """
    apply_b = times(b) if b is not None else None
    operator = _after(solver, apply_b) if solver else _inverse(a, b, sigma, left, right, apply_b)
    return _mapped(a, operator, apply_b, left, right, options, lambda mu: sigma + 1 / mu)


def buckling(a: SparseMatrix, b: SparseMatrix, sigma: float, left: int, right: int, options: Options = Options(), solver: Block | None = None) -> Eigenpairs:
    """A x = lambda B x with A positive definite, B any: mu = lambda / (lambda - sigma) of (A - sigma B)^-1 A in the metric of A.

    For a positive sigma, as many pairs are in (0, sigma) as A - sigma B has negative eigenvalues.
    """
    apply_a = times(a)
    operator = _after(solver, apply_a) if solver else _inverse(a, b, sigma, left if sigma > 0 else 0, right if sigma < 0 else 0, apply_a)
    return _mapped(a, operator, apply_a, left, right, options, lambda mu: sigma * mu / (mu - 1))


def _mapped(a: SparseMatrix, operator: Block, metric: Block | None, left: int, right: int, options: Options, back) -> Eigenpairs:
    """Pairs of the operator at both ends, in one run, as pairs of the problem, in ascending order."""
    got = extreme(a.spark, a.n, Wanted(left, right), operator, metric, None, options, inner=True)
    if not left + right:
        return got
    values = back(got.values)
    order = np.argsort(values, kind="stable")
    vectors = _sized(got.vectors.select("i", F.array(*(F.col("w")[int(k)] for k in order)).alias("w")), len(order))
    return replace(got, values=values[order], residuals=got.residuals[order], vectors=vectors, vector_errors=got.vector_errors[order], value_errors=got.value_errors[order])


# Hermitian problems. A complex matrix acts on real and imaginary parts as a real symmetric one of twice the order, whose
# eigenvalues are those of A, each twice. So twice as many real pairs are found; the complex vectors that they stand for span
# each eigenspace, and an orthonormal basis of it, in the complex inner product of the problem's metric, is taken.


def real_form(entries: DataFrame, n: int) -> SparseMatrix:
    """The symmetric matrix of order 2 n, real parts first, of a Hermitian one: its lower triangle (i, j, re, im)."""
    low = entries.select("i", "j", "re", "im")
    full = low.unionByName(low.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "re", (-F.col("im")).alias("im")))
    part = lambda di, dj, v: full.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), v.alias("v"))
    big = part(0, 0, F.col("re")).unionByName(part(n, n, F.col("re"))).unionByName(part(n, 0, F.col("im")))
    return SparseMatrix(cut(big.where("v <> 0 and i >= j")), 2 * n, 2 * n, MatrixType.REAL_SYM_INDEF)


def _turned(block: DataFrame, n: int) -> DataFrame:
    """The block times the imaginary unit: (x, y) becomes (-y, x)."""
    sign = F.when(F.col("i") > n, F.lit(-1.0)).otherwise(F.lit(1.0))
    return block.select(F.when(F.col("i") > n, F.col("i") - n).otherwise(F.col("i") + n).alias("i"), F.transform("w", lambda v: v * sign).alias("w"))


def bases(values: np.ndarray, gram: np.ndarray, count: int, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Which values stay, and the coefficients of orthonormal vectors: gram is Z^H B Z of 2 count vectors, two for each value.

    Values within tol of their neighbours are one eigenspace. Of a space of 2 m real vectors, m complex ones are taken:
    those of the largest eigenvalues of its Gram matrix.
    """
    scale = max(float(np.abs(values).max()), 1e-300) if len(values) else 1.0
    order = np.argsort(values, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(values[order]) > tol * scale) + 1)
    stay, columns = [], []
    for g in groups:
        w, q = np.linalg.eigh(gram[np.ix_(g, g)])
        for k in range(len(g) - 1, len(g) - 1 - (len(g) + 1) // 2, -1):
            column = np.zeros(len(values), dtype=complex)
            column[g] = q[:, k] / np.sqrt(max(w[k], 1e-300))
            columns.append(column)
            stay.append(g[len(g) - 1 - k])
    return np.array(stay[:count], dtype=int), np.array(columns[:count]).T.reshape(len(values), -1)


def _complex_pairs(got: Eigenpairs, n: int, left: int, right: int, metric: Block | None) -> Eigenpairs:
    """The complex pairs of twice as many real ones: vectors has 2 n rows, real parts first."""
    if not left + right:
        return got
    k = len(got.values)
    own = got.vectors
    block, turned = _sized(own, k), _sized(_turned(own, n), k)
    if metric:
        both = own.select("i", F.col("w").alias("u"))
        for name, b in (("bu", block), ("bt", turned)):
            both = both.join(metric(b).select("i", F.col("w").alias(name)), "i")
    else:
        both = own.select("i", F.col("w").alias("u"), F.col("w").alias("bu")).join(turned.select("i", F.col("w").alias("bt")), "i")
    g = gram_matrices(both, ["u", "bu", "bt"], [("u", "bu"), ("u", "bt")])
    gram = g["u", "bu"] - 1j * g["u", "bt"]
    stay, c = [], []
    for part, many in ((slice(0, 2 * left), left), (slice(2 * left, k), right)):
        rows = np.arange(k)[part]
        if many:
            s, m = bases(got.values[part], gram[part, part], many)
            full = np.zeros((k, m.shape[1]), dtype=complex)
            full[rows] = m
            stay.append(rows[s])
            c.append(full)
    stay, c = np.concatenate(stay), np.concatenate(c, axis=1)
    made = mixed(both.select("i", "u").join(turned.select("i", F.col("w").alias("t")), "i"), {"w": (["u", "t"], np.concatenate([c.real, c.imag]))})
    return replace(got, values=got.values[stay], residuals=got.residuals[stay], vectors=_sized(made, len(stay)))


def hermitian(entries: DataFrame, n: int, left: int, options: Options = Options(), right: int = 0, b: DataFrame | None = None) -> Eigenpairs:
    """The left leftmost and right rightmost pairs of a Hermitian matrix, lower triangle (i, j, re, im), or of A x = lambda B x with such a B, positive definite.

    vectors has 2 n rows, real parts first, orthonormal in the complex inner product.
    """
    big_b = real_form(b, n) if b is not None else None
    got = generalized(real_form(entries, n), big_b, 2 * left, 2 * right, None, options)
    return _complex_pairs(got, n, left, right, times(big_b) if big_b is not None else None)


def hermitian_shift_invert(entries: DataFrame, n: int, sigma: float, left: int, right: int, b: DataFrame | None = None, options: Options = Options()) -> Eigenpairs:
    """The left pairs next below sigma and the right pairs next above, of A x = lambda x or A x = lambda B x."""
    big_b = real_form(b, n) if b is not None else None
    got = shift_invert(real_form(entries, n), sigma, 2 * left, 2 * right, big_b, options)
    return _complex_pairs(got, n, left, right, times(big_b) if big_b is not None else None)


def hermitian_buckling(entries: DataFrame, n: int, b: DataFrame, sigma: float, left: int, right: int, options: Options = Options()) -> Eigenpairs:
    """buckling() of Hermitian A and B; vectors are orthonormal in the metric of A."""
    big_a = real_form(entries, n)
    return _complex_pairs(buckling(big_a, real_form(b, n), sigma, 2 * left, 2 * right, options), n, left, right, times(big_a))
