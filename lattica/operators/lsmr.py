"""Least squares: min |A x - b|, damped or not, by LSMR (Fong and Saunders, 2011): the Golub-Kahan process with two chains of rotations.

The caller gives the operator as two functions on vectors (i, x), or a matrix. Two tables stay from one iteration to the
next: the left vector of the process, and the right one with the three that follow from it, which are updated together
in one sum by index. The directions of an iteration are expressions on that table until the next one writes it again.
Scalars alone are on the driver: each table gives its sums of squares and products in one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from .cutting import cut
from .vectors import combine, multiply, multiply_transposed, norm

EPS = 2.0**-52


class Stop(IntEnum):
    # Reasons to stop.
    ZERO = 0
    COMPATIBLE = 1
    LEAST_SQUARES = 2
    ILL_CONDITIONED = 3
    COMPATIBLE_TO_PRECISION = 4
    LEAST_SQUARES_TO_PRECISION = 5
    ILL_CONDITIONED_TO_PRECISION = 6
    ITERATION_LIMIT = 7
    ARGUMENT = 10


@dataclass(frozen=True)
class Operator:
    """apply: (i, x) of length n to A x; apply_transposed: of length m to A' x."""

    m: int
    n: int
    apply: Callable[[DataFrame], DataFrame]
    apply_transposed: Callable[[DataFrame], DataFrame]

    @staticmethod
    def of(matrix: SparseMatrix) -> Operator:
        return Operator(matrix.m, matrix.n, lambda x: multiply(matrix, x), lambda x: multiply_transposed(matrix, x))


@dataclass(frozen=True)
class LsmrOptions:
    atol: float = math.sqrt(EPS)
    btol: float = math.sqrt(EPS)
    conlim: float = 1 / (10 * math.sqrt(EPS))
    iteration_limit: int | None = None  # 4 n if None
    local_size: int = 0  # how many earlier v are kept to reorthogonalize against
    test: Callable[[DataFrame, LsmrState], bool] | None = None  # replaces the built-in stop rules if given
    test_every: int | None = None  # min(n, 10) if None


@dataclass
class LsmrState:
    iteration: int = 0
    norm_b: float = 0.0
    norm_a: float = 0.0
    cond_a: float = 1.0
    norm_r: float = 0.0
    norm_ar: float = 0.0
    norm_x: float = 0.0
    stop: Stop = Stop.ZERO


@dataclass(frozen=True)
class Turn:
    """A plane rotation that takes (x, y) to (length, 0)."""

    cos: float
    sin: float
    length: float

    @staticmethod
    def of(x: float, y: float) -> Turn:
        length = math.hypot(x, y)
        return Turn(x / length, y / length, length) if length else Turn(1.0, 0.0, 0.0)


@dataclass(frozen=True)
class Step:
    """What one iteration does: its rotations, and how far x moves along the direction."""

    damping: Turn
    lower: Turn  # makes the bidiagonal matrix upper triangular
    upper: Turn  # makes that triangle's transpose so
    theta_bar: float  # entry above the diagonal of the second triangle, before its rotation
    zeta: float
    move: float  # of x along the direction
    keep_direction: float  # of the last direction in the new one
    keep_trail: float  # of the trail in the next one
    diagonal: float  # of the second triangle, before its rotation


class Rotations:
    """Both chains, of which each iteration adds one rotation, or two with damping."""

    def __init__(self, alpha: float, beta: float, damp: float) -> None:
        self.damp, self.tail, self.right = damp, alpha, alpha * beta
        self.lower, self.upper = Turn(1.0, 0.0, 1.0), Turn(1.0, 0.0, 1.0)

    def add(self, alpha: float, beta: float) -> Step:
        damping = Turn.of(self.tail, self.damp)
        lower = Turn.of(damping.length, beta)
        above, theta_bar, diagonal = lower.sin * alpha, self.upper.sin * lower.length, self.upper.cos * lower.length
        upper = Turn.of(diagonal, above)
        keep = theta_bar * lower.length / (self.lower.length * self.upper.length)
        zeta = upper.cos * self.right
        step = Step(damping, lower, upper, theta_bar, zeta, zeta / (lower.length * upper.length), -keep, -above / lower.length, diagonal)
        self.tail, self.right = lower.cos * alpha, -upper.sin * self.right
        self.lower, self.upper = lower, upper
        return step


class ResidualNorm:
    """|b - A x| (with the damped rows): what the chains of rotations leave of the right side, and what x takes of it."""

    def __init__(self, beta: float) -> None:
        self.front, self.held, self.damped = beta, 0.0, 0.0
        self.pivot, self.above, self.taken, self.zeta = 1.0, 0.0, 0.0, 0.0

    def after(self, step: Step) -> float:
        self.damped = math.hypot(self.damped, step.damping.sin * self.front)
        undamped = step.damping.cos * self.front
        self.front = -step.lower.sin * undamped
        third = Turn.of(self.pivot, step.theta_bar)
        self.taken = (self.zeta - self.above * self.taken) / third.length
        self.held = third.cos * step.lower.cos * undamped - third.sin * self.held
        self.pivot, self.above, self.zeta = third.cos * step.upper.length, third.sin * step.upper.length, step.zeta
        open_ = self.held - (self.zeta - self.above * self.taken) / self.pivot
        return math.hypot(self.damped, open_, self.front)


class Conditioning:
    """Frobenius norm and condition number of A, as far as the process has seen it."""

    def __init__(self, alpha: float) -> None:
        self.square, self.low, self.high, self.pivots = alpha * alpha, math.inf, 0.0, 0

    def after(self, step: Step, alpha: float, beta: float, last_pivot: float) -> tuple[float, float]:
        norm = math.sqrt(self.square + beta * beta)
        self.square += beta * beta + alpha * alpha
        self.high = max(self.high, last_pivot)
        if self.pivots:  # the first pivot is the neutral one that the chain starts with
            self.low = min(self.low, last_pivot)
        self.pivots += 1
        return norm, max(self.high, step.diagonal) / min(self.low, step.diagonal)


class Iterates:
    """The right vectors as one table (i, w, trail, direction, x): w over its norm alpha is the process's current right vector."""

    SUMS = ("w", "trail", "direction", "x")

    def __init__(self, w: DataFrame, local_size: int) -> None:
        zero = F.lit(0.0)
        self.local_size, self.recent = local_size, []
        self._hold(cut(w.select("i", F.col("x").alias("w"), zero.alias("trail"), zero.alias("direction"), zero.alias("x"))))

    def _hold(self, table: DataFrame) -> None:
        """Takes the sums of all products of two of its columns."""
        self.table = table
        pairs = [(a, b) for k, a in enumerate(self.SUMS) for b in self.SUMS[k:]]
        got = table.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{a}_{b}") for a, b in pairs)).first()
        self.products = {p: got[f"{p[0]}_{p[1]}"] for p in pairs}
        self.alpha = math.sqrt(self.products["w", "w"])
        self.trail, self.direction, self.x = F.col("trail"), F.col("direction"), F.col("x")

    def unit(self) -> Column:
        return F.col("w") / self.alpha

    def vector(self) -> DataFrame:
        return self.table.select("i", self.unit().alias("x"))

    def solution(self) -> DataFrame:
        return self.table.select("i", self.x.alias("x"))

    def start(self) -> None:
        self.trail = self.unit()

    def advance(self, step: Step, alpha: float) -> None:
        """The vectors after a step, as expressions; the trail takes in the vector w / alpha."""
        self.direction = self.trail + step.keep_direction * self.direction
        self.x = self.x + step.move * self.direction
        self.trail = (F.col("w") / alpha if alpha else F.lit(0.0)) + step.keep_trail * self.trail

    def norm_x(self) -> float:
        return self.solution().agg(F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)))).first()[0]

    def next(self, fresh: DataFrame, beta: float) -> None:
        """w becomes fresh - beta times the current right vector, against the last ones made orthogonal if they are kept."""
        old = self.table.select("i", (-beta * self.unit()).alias("w"), self.trail.alias("trail"), self.direction.alias("direction"), self.x.alias("x"))
        zero = F.lit(0.0)
        new = fresh.select("i", F.col("x").alias("w"), zero.alias("trail"), zero.alias("direction"), zero.alias("x"))
        if self.local_size:
            self.recent = [*self.recent, cut(self.vector())][-self.local_size :]
        table = cut(old.unionByName(new).groupBy("i").agg(*(F.sum(c).alias(c) for c in self.SUMS)))
        for v in self.recent:
            along = table.join(v.withColumnRenamed("x", "v"), "i").agg(F.coalesce(F.sum(F.col("w") * F.col("v")), F.lit(0.0))).first()[0]
            other = v.select("i", (-along * F.col("x")).alias("w"), *(zero.alias(c) for c in self.SUMS[1:]))
            table = cut(table.unionByName(other).groupBy("i").agg(*(F.sum(c).alias(c) for c in self.SUMS)))
        self._hold(table)


def lsmr(operator: Operator | SparseMatrix, b: DataFrame, damp: float = 0.0, options: LsmrOptions = LsmrOptions()) -> tuple[DataFrame, LsmrState]:
    """x (i, x; rows of zeros may be missing) and how it ended."""
    a = Operator.of(operator) if isinstance(operator, SparseMatrix) else operator
    state, nothing = LsmrState(), b.limit(0)
    if min(a.m, a.n) < 1:
        state.stop = Stop.ARGUMENT
        return nothing, state
    limit = 4 * a.n if options.iteration_limit is None else options.iteration_limit
    every = options.test_every or min(a.n, 10)
    left, state.norm_b = b, norm(b)  # left / beta is the process's left vector
    beta = state.norm_r = state.norm_b
    if not beta:
        return nothing, state
    right = Iterates(a.apply_transposed(combine(1 / beta, left, 0.0, nothing)), options.local_size)
    state.norm_ar = right.alpha * beta
    if not state.norm_ar:
        return nothing, state
    chain, residual, seen = Rotations(right.alpha, beta, damp), ResidualNorm(beta), Conditioning(right.alpha)
    right.start()
    while True:
        state.iteration += 1
        last_pivot = chain.upper.length
        left = cut(combine(1.0, a.apply(right.vector()), -right.alpha / beta, left))
        beta = norm(left)
        if beta:
            right.next(a.apply_transposed(left.select("i", (F.col("x") / beta).alias("x"))), beta)
        alpha = right.alpha if beta else 0.0
        step = chain.add(alpha, beta)
        right.advance(step, alpha)
        state.norm_r = residual.after(step)
        state.norm_a, state.cond_a = seen.after(step, alpha, beta, last_pivot)
        state.norm_ar, state.norm_x = abs(chain.right), right.norm_x()
        if options.test is None:
            found = stop_rule(state, options, limit)
        elif state.iteration >= limit:
            found = Stop.ITERATION_LIMIT
        else:
            asked = state.iteration % every == 0 or not alpha
            found = Stop.LEAST_SQUARES if asked and options.test(right.solution(), state) else None
        if found is not None:
            state.stop = found
            return right.solution(), state


def stop_rule(state: LsmrState, options: LsmrOptions, limit: int) -> Stop | None:
    """The user's tolerances count before the limits of precision, those before the iteration limit."""
    scale = state.norm_a * state.norm_x / state.norm_b
    compatible = state.norm_r / state.norm_b
    product = state.norm_a * state.norm_r
    optimal = state.norm_ar / product if product else 0.0
    inverse = 1 / state.cond_a if state.cond_a else 0.0
    vanishes = lambda x: 1 + x == 1
    if compatible <= options.btol + options.atol * scale:
        return Stop.COMPATIBLE
    if optimal <= options.atol:
        return Stop.LEAST_SQUARES
    if inverse * options.conlim <= 1:
        return Stop.ILL_CONDITIONED
    if vanishes(compatible / (1 + scale)):
        return Stop.COMPATIBLE_TO_PRECISION
    if vanishes(optimal):
        return Stop.LEAST_SQUARES_TO_PRECISION
    if vanishes(inverse):
        return Stop.ILL_CONDITIONED_TO_PRECISION
    return Stop.ITERATION_LIMIT if state.iteration >= limit else None
