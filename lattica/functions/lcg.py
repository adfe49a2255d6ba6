"""The reproducible stream of random numbers: x <- (1103515245 x + 12345) mod 2^31.

As a column, the k-th state is found by doubling jumps, so a stream is computed in parallel from row numbers alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The generator's multiplier, increment, modulus and default seed.
MULTIPLIER, INCREMENT, MODULUS, SEED = 1103515245, 12345, 2**31, 486502


class RandomState:
    """The stream drawn one number at a time."""

    def __init__(self, seed: int = SEED) -> None:
        self.seed = seed % MODULUS

    def step(self) -> int:
        self.seed = (MULTIPLIER * self.seed + INCREMENT) % MODULUS
        return self.seed

    def real(self, positive: bool = False) -> float:
        """In (-1, 1), or in (0, 1) if positive."""
        x = self.step() / MODULUS
        return x if positive else 1.0 - 2.0 * x

    def integer(self, n: int) -> int:
        """In 1 .. n; n itself, without a draw, if it is below 1."""
        return int(self.step() * (n / MODULUS)) + 1 if n > 0 else n

    def logical(self) -> bool:
        return self.integer(2) == 1

    def between(self, low: int, high: int) -> int:
        return low - 1 + self.integer(high - low + 1)

    def permutation(self, n: int) -> list[int]:
        """A permutation of 1 .. n by swaps from the front."""
        p = list(range(1, n + 1))
        for k in range(n - 1):
            j = self.between(k + 1, n) - 1
            p[k], p[j] = p[j], p[k]
        return p

    def jump(self, steps: int) -> None:
        """The same as so many steps."""
        a, c = MULTIPLIER, INCREMENT
        while steps:
            if steps & 1:
                self.seed = (a * self.seed + c) % MODULUS
            a, c, steps = a * a % MODULUS, (a * c + c) % MODULUS, steps >> 1


def jumps(bits: int = 40) -> list[tuple[int, int]]:
    """Multiplier and increment of 2^k steps."""
    a, c, out = MULTIPLIER, INCREMENT, []
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a % MODULUS, (a * c + c) % MODULUS
    return out


def state(k: Column, seed: int = SEED, bits: int = 40) -> Column:
    """The state after k steps, for 0 <= k < 2^bits. All products stay below 2^62."""
    x = F.lit(seed % MODULUS).cast("long")
    steps = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for b, (a, c) in enumerate(jumps(bits))))
    return F.aggregate(steps, x, lambda acc, s: F.when(k.bitwiseAND(s["bit"]) != 0, (acc * s["a"] + s["c"]) % MODULUS).otherwise(acc))


def states(k: np.ndarray, seed: int = SEED, bits: int = 40) -> np.ndarray:
    """The states after k steps, of an array, as state() gives them."""
    x = np.full(k.shape, seed % MODULUS, dtype=np.int64)
    for b, (a, c) in enumerate(jumps(bits)):
        x = np.where(k >> b & 1, (x * a + c) % MODULUS, x)
    return x


def reals(i: np.ndarray, width: int, seed: int, n: int) -> np.ndarray:
    """Rows i (from 1, at most n) of the n by width numbers in (-1, 1) that follow each other row by row."""
    k = (i[:, None] - 1) * width + np.arange(1, width + 1)
    return 1.0 - 2.0 * (states(k, seed, max(1, (n * width).bit_length())) / float(MODULUS))


def as_real(x: Column, positive: bool = False) -> Column:
    return x / F.lit(float(MODULUS)) if positive else 1.0 - 2.0 * (x / F.lit(float(MODULUS)))


def as_integer(x: Column, n: int) -> Column:
    return (F.floor(x * F.lit(n / MODULUS)) + 1).cast("long") if n > 0 else F.lit(n).cast("long")


def as_logical(x: Column) -> Column:
    return as_integer(x, 2) == 1


def stream(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """k, state for k = 1 .. n."""
    bits = max(1, n.bit_length())
    return spark.range(1, n + 1).select(F.col("id").alias("k"), state(F.col("id"), seed, bits).alias("state"))


def chi_square(values: DataFrame, bin_col: str, bins: int) -> DataFrame:
    """rows, statistic: the chi-square statistic of bins 1 .. bins against equal shares; bins without rows count."""
    counts = values.groupBy(F.col(bin_col).alias("bin")).agg(F.count("*").cast("double").alias("n")).where(F.col("bin").between(1, bins))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)).alias("squares"))
    return sums.select(F.col("rows").cast("long").alias("rows"), F.when(F.col("rows") > 0, F.col("squares") * bins / F.col("rows") - F.col("rows")).alias("statistic"))
