"""A matrix that grows: triples arrive as a stream, and repeated places are summed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import MatrixType
from ..operators.convert import in_range, placed


def assembled(stream: DataFrame, m: int, n: int, type: MatrixType = MatrixType.UNSPECIFIED) -> DataFrame:
    """i, j, v of all triples (i, j, v) so far; write it in complete or update mode. The state has a row per place."""
    i, j, v, keep = placed(type, mirror=True)
    kept = stream.where(in_range(m, n) & keep).select(i.alias("i"), j.alias("j"), v.alias("v"))
    return kept.groupBy("i", "j").agg(F.sum("v").alias("v"))
