"""Pictures of a sparsity pattern: entries are counted per pixel where they are, and the bounded picture is written by the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = 600


def pattern_bins(entries: DataFrame, m: int, n: int, pixels: int = PIXELS) -> DataFrame:
    """px, py (0-based column and row of a pixel), entries: at most pixels x pixels rows."""
    size = max(1, min(pixels, max(m, n)))
    px = F.floor((F.col("j") - 1) * size / F.lit(max(m, n))).cast("long")
    py = F.floor((F.col("i") - 1) * size / F.lit(max(m, n))).cast("long")
    return entries.select(px.alias("px"), py.alias("py")).groupBy("px", "py").agg(F.count("*").alias("entries"))


def picture(entries: DataFrame, m: int, n: int, pixels: int = PIXELS) -> np.ndarray:
    """0 where a pixel holds an entry, 1 elsewhere; rows are rows of the matrix."""
    size = max(1, min(pixels, max(m, n)))
    out = np.ones((size, size), dtype=np.int64)
    got = pattern_bins(entries, m, n, pixels).toPandas()
    out[got.py.to_numpy(), got.px.to_numpy()] = 0
    return out


def permuted(entries: DataFrame, row_order: DataFrame | None = None, column_order: DataFrame | None = None) -> DataFrame:
    """entries with indices moved to positions (i, pos)."""
    if row_order is not None:
        entries = entries.join(row_order.select("i", F.col("pos").alias("p")), "i").drop("i").withColumnRenamed("p", "i")
    if column_order is not None:
        entries = entries.join(column_order.select(F.col("i").alias("j"), F.col("pos").alias("p")), "j").drop("j").withColumnRenamed("p", "j")
    return entries


def pgm_text(bits: np.ndarray, most: int = 1) -> str:
    return f"P2\n{bits.shape[1]} {bits.shape[0]}\n{most}\n" + "\n".join(" ".join(map(str, r)) for r in bits.tolist()) + "\n"


def ppm_text(colour: np.ndarray, colours: list[tuple[int, int, int]], most: int = 255) -> str:
    """colour: an index into colours (red, green, blue) per pixel."""
    rows = (" ".join(f"{r} {g} {b}" for r, g, b in (colours[k] for k in row)) for row in colour.tolist())
    return f"P3\n{colour.shape[1]} {colour.shape[0]}\n{most}\n" + "\n".join(rows) + "\n"


def write_pattern(entries: DataFrame, m: int, n: int, path: str, pixels: int = PIXELS) -> None:
    with open(path, "w") as f:
        f.write(pgm_text(picture(entries, m, n, pixels)))
