"""Operator 13: benchmark passages in training texts, found and removed.

Words are lower-cased (A to Z only) runs of digits, letters and characters outside ASCII. A window is `n` consecutive words
of a benchmark item; an item of fewer words, but not none, is one window. The 64-bit hashes of all windows are broadcast as a
set; each task hashes every window of its texts by array operations, looks them up, and compares the words of every hit with
those of the window, so that a text is marked by equal words only. Texts aren't shuffled.

The broadcast is bounded: windows are collected MAX_WINDOWS at a time, by a hash of window and item, and beyond that many
the texts are scanned once for each part and the parts' finds of a text, which are few, are put together.

Defined results: null text and null items have no words; a null item id is the id "null"; items that share an id are one;
rows are independent, so repeated rows have equal results; without a benchmark nothing is found; an empty table gives no
rows. One text must fit a task; spans count in characters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Shared, in_arrow, table
from .words import U, hash_ranges, mix, row_groups, runs, text_bytes

WINDOW = 10
MAX_WINDOWS = 500_000  # broadcast at once, with their words: about 100 bytes each
BATCH_BYTES = 4 << 20
FILTER_BITS = 22
_STEP = U(0x9FB21C651E98DF25)

INSIDE = np.zeros(256, dtype=bool)  # bytes of words, in lower case
INSIDE[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of some texts: bytes in lower case, where each word starts and ends, its hash, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = TO_LOWER[data]
        self.starts, self.ends, per_row = runs(INSIDE[self.data], offsets)
        self.first = np.concatenate([[0], np.cumsum(per_row)])
        self.hashes = hash_ranges(self.data, self.starts, self.ends)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words from each place on, and which of them lie in one text."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=bool)
        out = np.zeros(count, dtype=U)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = out * _STEP + self.hashes[k : k + count]
            out = mix(out + U(n))
        inside = np.ones(count, dtype=bool)
        for back in range(1, n):  # a text's last n - 1 words start no window
            at = self.first[1:-1] - back
            inside[at[(at >= 0) & (at < count)]] = False
        return out, inside

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))


class WindowSet:
    """Windows by length: the items of each, by hash and words."""

    def __init__(self, state: list[tuple[int, bytes, str]]) -> None:
        by_length: dict[int, dict[bytes, set[str]]] = {}
        for n, text, item in state:
            by_length.setdefault(n, {}).setdefault(text, set()).add(item)
        self.by_length = {}
        for n, found in by_length.items():
            own = Words(*text_bytes(pa.array(list(found), pa.binary()).view(pa.string())))
            hashes = own.windows(n)[0][own.first[:-1]]
            near = np.zeros(1 << FILTER_BITS, dtype=bool)
            near[hashes >> U(64 - FILTER_BITS)] = True
            self.by_length[n] = near, np.unique(hashes), found

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """Place, length and items of every window in the words."""
        for n, (near, sorted_hashes, items) in self.by_length.items():
            h, inside = words.windows(n)
            maybe = np.flatnonzero(near[h >> U(64 - FILTER_BITS)] & inside)
            at = np.minimum(np.searchsorted(sorted_hashes, h[maybe]), len(sorted_hashes) - 1)
            for place in maybe[sorted_hashes[at] == h[maybe]].tolist():
                if (found := items.get(words.text(place, n))) is not None:
                    yield place, n, found


def _benchmark_windows(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b["text"])
            ids = b["item"].to_pylist()
            for lo, hi in row_groups(offsets, BATCH_BYTES):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out: dict[str, list] = {"n": [], "window": [], "item": []}
                for k in range(hi - lo):
                    first, last = words.first[k : k + 2].tolist()
                    size = min(n, last - first)
                    for at in range(first, last - size + 1 if size else first):
                        out["n"].append(size)
                        out["window"].append(words.text(at, size))
                        out["item"].append(ids[lo + k])
                yield pa.record_batch({"n": pa.array(out["n"], pa.int32()), "window": pa.array(out["window"], pa.binary()), "item": pa.array(out["item"], pa.string())})

    return run


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """n, window (its words, a blank between them) and item of every distinct window of each item."""
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(own, _benchmark_windows(n), "n int, window binary, item string").distinct()


FOUND = "n_words long, items array<string>, spans array<struct<first: long, last: long, start: long, stop: long>>"
FOUND_TYPES = {"n_words": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "stop")]))}


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges first .. last of places, without overlaps; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find(data: np.ndarray, offsets: np.ndarray, windows: WindowSet) -> dict[str, list]:
    """n_words, items and spans (first and last word, start and stop in characters) of each text."""
    words = Words(data, offsets)
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for place, n, found in windows.hits(words):
        row = int(np.searchsorted(words.first, place, side="right")) - 1
        hits.setdefault(row, []).append((place, place + n - 1))
        items.setdefault(row, set()).update(found)
    spans: list[list[dict[str, int]]] = [[] for _ in range(len(offsets) - 1)]
    for row, own in hits.items():
        lo, hi = offsets[row : row + 2].tolist()
        chars = np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)])  # characters before each byte
        for a, b in _merged(own):
            spans[row].append({"first": a - int(words.first[row]), "last": b - int(words.first[row]), "start": int(chars[words.starts[a] - lo]), "stop": int(chars[words.ends[b] - lo])})
    return {"n_words": np.diff(words.first).tolist(), "items": [sorted(items.get(k, ())) for k in range(len(spans))], "spans": spans}


def _scanned(df: DataFrame, windows: list[tuple[int, bytes, str]], keep: list[str]) -> DataFrame:
    shared = Shared(df.sparkSession, windows, WindowSet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.get()
        for b in batches:
            data, offsets = text_bytes(b["_text"])
            for lo, hi in row_groups(offsets, BATCH_BYTES):
                got = find(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], found)
                rows = b.slice(lo, hi - lo)
                yield pa.record_batch({c: rows[c] for c in keep} | {c: pa.array(got[c], t) for c, t in FOUND_TYPES.items()})

    return in_arrow(df, run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), FOUND]))


def _joined(spans: Column) -> Column:
    """The spans of all parts as one part would give them."""
    kind = FOUND.partition("spans ")[2]
    last = lambda out: F.element_at(out, -1)
    longer = lambda out, x: F.struct(last(out)["first"].alias("first"), F.greatest(last(out)["last"], x["last"]).alias("last"), last(out)["start"].alias("start"), F.greatest(last(out)["stop"], x["stop"]).alias("stop"))
    touches = lambda out, x: (F.size(out) > 0) & (x["first"] <= F.try_element_at(out, F.lit(-1))["last"] + 1)
    step = lambda out, x: F.when(touches(out, x), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer(out, x)))).otherwise(F.concat(out, F.array(x)))
    return F.reduce(F.array_sort(spans), F.array().cast(kind), lambda out, x: step(out, x).cast(kind))


def overlaps(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", n: int = WINDOW, max_windows: int = MAX_WINDOWS, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns `keep` of every row of docs, and what it shares with the benchmark: n_words, items and spans."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.keep(benchmark_windows(items, item_id, item_text, n))
    parts = max(1, math.ceil(windows.count() / max_windows))
    own = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    part = lambda k: [(r["n"], bytes(r["window"]), r["item"]) for r in windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k).collect()]  # noqa: E731  about max_windows rows
    if parts == 1:
        return _scanned(own, part(0), keep)
    keyed = own.withColumn("_key", F.sha2(F.coalesce("_text", F.lit("")), 256))  # rows of equal text have equal finds
    finds = []
    for k in range(parts):
        got = _scanned(keyed, part(k), ["_key"]).where(F.size("spans") > 0)
        finds.append(scratch.keep(got.groupBy("_key").agg(F.first("items").alias("items"), F.first("spans").alias("spans"))))
    whole = reduce(DataFrame.unionByName, finds).groupBy("_key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("items", "spans")))  # a row for each part at most
    none = lambda c: F.array().cast("array<string>" if c == "items" else FOUND.partition("spans ")[2])
    rows = _scanned(keyed, [], [*keep, "_key"]).drop("items", "spans").join(whole, "_key", "left")
    return rows.select(*keep, "n_words", F.coalesce(F.array_sort(F.array_distinct("items")), none("items")).alias("items"), F.coalesce(_joined(F.col("spans")), none("spans")).alias("spans"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its spans; what stands around them stays."""
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    stops = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.zip_with(stops, starts, lambda a, b: F.substring(text, a + 1, b - a)), ""))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", text_col: str = "text", **options) -> DataFrame:
    """docs without the benchmark's windows in their texts, or (remove="documents") without the rows that hold any."""
    rows = overlaps(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_own")), items, ["_row", "_own"], "_own", **options)
    if remove == "documents":
        return rows.where(F.size("spans") == 0).select("_row.*")
    if remove != "spans":
        raise ValueError("remove must be spans or documents")
    clean = without_spans(F.col("_own"), F.col("spans"))
    return rows.select(*(clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.reduce("spans", F.lit(0).cast("long"), lambda t, s: t + s["last"] - s["first"] + 1)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
s AS (SELECT item, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
z AS (SELECT DISTINCT n FROM g),
o AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, z)),
h AS (SELECT o.r, o.k, o.n, g.item FROM o JOIN g ON o.n = g.n AND o.t = g.t),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS k FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r)
"""
