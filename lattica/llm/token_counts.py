"""Operator 4: token counts. Batch encoding in an Arrow function that returns lengths only.

Texts of an Arrow batch are encoded in groups balanced by bytes. A text over the group size is cut at ASCII white space,
where no pre-token can span the cut, so its count is the sum over its pieces. No text is truncated.

Defined results: null or empty text has 0 bytes and 0 tokens; a text of white space only has 0 tokens; special strings
inside texts are handled as the library does by default; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .common import map_arrow, table
from .words import SPACE, row_groups, text_bytes

GROUP_BYTES = 1 << 20
OVER_LIMIT = 2048
def count_texts(column: pa.Array, path: str, group_bytes: int = GROUP_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text. Groups hold about group_bytes; of a longer text, pieces that end before white space."""
    enc = encoder(path)
    data, offsets = text_bytes(column)
    counts = np.zeros(len(column), dtype=np.int64)
    for lo, hi in row_groups(offsets, group_bytes):
        for a, b in safe_pieces(data, int(offsets[lo]), int(offsets[hi]), group_bytes):
            inner = offsets[lo + 1 : hi]
            n, _ = enc.encode(data[a:b], np.concatenate([[a], inner, [b]]) - a, with_ids=False)
            counts[lo:hi] += n
    return np.diff(offsets), counts


def safe_pieces(data: np.ndarray, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of at least `size` bytes from start to end, each followed by ASCII white space; a run without any is never cut."""
    while end - start > size:
        stop, probe = start + size, 4096
        while stop < end:
            found = np.flatnonzero(SPACE[data[stop : min(stop + probe, end)]])
            if len(found):
                stop += int(found[0])
                break
            stop, probe = min(stop + probe, end), 2 * probe
        if stop == end:
            break
        yield start, stop
        start = stop
    yield start, end


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, over_limit: int = OVER_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of df."""
    path = path or tokenizer_path()

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        size, n = count_texts(b.column(1), path)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > over_limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col), F.col(text_col)), count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
