"""Operator 10: best-fit packing with a swap-based local search.

Documents become pieces of at most `limit` tokens. Which piece goes where depends on lengths alone, and there are at most
`limit` distinct ones, so the search works on the histogram of lengths: its size has a fixed bound, whatever the corpus.
A bin is a pattern of lengths with a multiplicity. Best fit, longest first, gives the first patterns. Then underfull
patterns exchange one document for one or two, or give one away, whenever that raises the sum of squared fills, until
bins empty or no such step is left. Last, the pieces of a length are numbered over all partitions, and each takes the
place that its number has in the list of patterns.

Defined results: null text is the empty text, whose only token is the end id; every input row is packed, repeated ones
too; equal lengths are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .common import cut, map_arrow, table
from .words import row_groups, text_bytes

LIMIT = 4096
END_ID = 1
GROUP_BYTES = 1 << 20
Bins = Counter  # pattern (lengths, longest first) -> multiplicity


def best_fit(histogram: dict[int, int], limit: int) -> Bins:
    """Longest first, each into the fullest bin that takes it; equal bins are handled together."""
    by_room: dict[int, Bins] = defaultdict(Counter)
    rooms: list[int] = []  # a heap of the rooms of by_room, some of them stale
    done: Bins = Counter()

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if room < smallest:
            done[pattern] += n
            return
        if not by_room[room]:
            heapq.heappush(rooms, room)
        by_room[room][pattern] += n

    lengths = sorted(histogram, reverse=True)
    smallest = lengths[-1] if lengths else 0
    for x in lengths:
        left = histogram[x]
        for room in sorted(r for r in by_room if r >= x and by_room[r]):
            group = by_room.pop(room)
            for pattern, n in list(group.items()):
                if not left:
                    put(pattern, n, room)
                    continue
                each = min(room // x, max(1, left))
                full, rest = (left // each, left % each) if n * each > left else (n, 0)
                full = min(full, n)
                rest = rest if full < n else 0
                if full:
                    put(pattern + (x,) * each, full, room - each * x)
                if rest:
                    put(pattern + (x,) * rest, 1, room - rest * x)
                if n - full - bool(rest):
                    put(pattern, n - full - bool(rest), room)
                left -= full * each + rest
        if left:
            each = max(1, limit // x)
            if left // each:
                put((x,) * each, left // each, limit - each * x)
            if left % each:
                put((x,) * (left % each), 1, limit - x * (left % each))
    for group in by_room.values():
        done.update(group)
    return done


def _without(pattern: tuple[int, ...], *lengths: int) -> tuple[int, ...]:
    rest = list(pattern)
    for x in lengths:
        rest.remove(x)
    return tuple(rest)


def _with(pattern: tuple[int, ...], *lengths: int) -> tuple[int, ...]:
    return tuple(sorted(pattern + lengths, reverse=True))


class Givers:
    """Which underfull patterns can give a document of length s, or two of them of length s together; of these the emptiest."""

    def __init__(self, limit: int) -> None:
        self.limit, self.none = limit, 4 * limit
        self.live: dict[int, tuple[int, ...]] = {}
        self.number: dict[tuple[int, ...], int] = {}
        self.heaps: tuple[dict[int, list], dict[int, list]] = (defaultdict(list), defaultdict(list))  # of one, of two: s -> (fill, number), some stale
        self.least = np.full((2, limit + 1), self.none, dtype=np.int64)  # the least fill of a giver of s
        self.made = 0

    def sums(self, pattern: tuple[int, ...]) -> tuple[set[int], set[int]]:
        counts = Counter(pattern)
        own = np.array(sorted(counts), dtype=np.int64)
        i, j = np.triu_indices(len(own), 1)
        two = set((own[i] + own[j]).tolist()) | {2 * x for x, n in counts.items() if n > 1}
        return set(counts), two

    def add(self, pattern: tuple[int, ...]) -> None:
        self.made += 1
        self.live[self.made], self.number[pattern] = pattern, self.made
        fill = sum(pattern)
        for heaps, least, sums in zip(self.heaps, self.least, self.sums(pattern), strict=True):
            for s in sums:
                heapq.heappush(heaps[s], (fill, self.made))
                least[s] = min(least[s], fill)

    def drop(self, pattern: tuple[int, ...]) -> None:
        del self.live[self.number.pop(pattern)]
        for heaps, least, sums in zip(self.heaps, self.least, self.sums(pattern), strict=True):
            for s in sums:
                heap = heaps[s]
                while heap and heap[0][1] not in self.live:
                    heapq.heappop(heap)
                least[s] = heap[0][0] if heap else self.none

    def giver(self, two: int, s: int, but: int) -> tuple[int, ...] | None:
        """The emptiest giver of s that isn't number `but`."""
        heap = self.heaps[two][s]
        if heap[0][1] != but:
            return self.live[heap[0][1]]
        others = [x for x in heap if x[1] in self.live and x[1] != but]
        return self.live[min(others)[1]] if others else None

    def step(self, a: tuple[int, ...], alone: bool) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]] | None:
        """The step that fills a most and raises the sum of squared fills: the giver, and both patterns after it.

        The step gives a one document, or exchanges one of a for one or two. With a gain of d it raises the sum where
        d is more than the giver is fuller than a. alone: there is one bin of a, so a can't give to itself.
        """
        fill = sum(a)
        room = self.limit - fill
        gains = np.arange(1, room + 1)
        offers = []  # (gain, of two, length given back)
        for x in (0, *sorted(set(a))):
            for two in (0, 1) if x else (0,):
                fine = np.flatnonzero(self.least[two, x + 1 : x + room + 1] - fill < gains)
                if len(fine):
                    offers.append((int(fine[-1]) + 1, two, x, fine))
        best = None
        own = self.number[a] if alone else 0
        for _, two, x, fine in sorted(offers, key=lambda o: (-o[0], o[1], o[2])):
            for d in (fine[::-1] + 1).tolist():
                if best and d <= best[0]:
                    break
                s = x + d
                b = self.giver(two, s, own)
                if b is not None and sum(b) - fill < d:
                    best = d, two, x, s, b
                    break
        if not best:
            return None
        _, two, x, s, b = best
        given = (s,) if not two else next((y, s - y) for y in sorted(set(b)) if s - y in b and (2 * y != s or b.count(y) > 1))
        back = (x,) if x else ()
        return b, _with(_without(a, *back), *given), _with(_without(b, *given), *back)


def local_search(bins: Bins, limit: int, steps: int | None = None) -> Bins:
    """Raises the sum of squared fills of underfull patterns until the lower bound of bins is met or no step helps.

    All underfull patterns give and take. `steps` bounds the exchanges if it is set; every document stays packed.
    """
    bins = Counter({p: n for p, n in bins.items() if n and p})
    total, used = sum(sum(p) * n for p, n in bins.items()), sum(bins.values())
    least = -(-total // limit)
    index = Givers(limit)

    def change(pattern: tuple[int, ...], n: int) -> None:
        nonlocal used
        if not pattern:  # emptied bins
            return
        used += n
        bins[pattern] += n
        if sum(pattern) < limit:
            if bins[pattern] == n:
                index.add(pattern)
            elif not bins[pattern]:
                index.drop(pattern)
        if not bins[pattern]:
            del bins[pattern]

    for p in sorted(p for p in bins if sum(p) < limit):
        index.add(p)
    while used > least and steps != 0:
        moved = False
        for a in sorted(index.number, key=lambda p: (-sum(p), p)):  # the fullest takes, the emptiest gives
            while a in index.number and used > least and steps != 0 and (found := index.step(a, bins[a] < 2)):
                b, more, less = found
                n = min(bins[a], bins[b]) if a != b else bins[a] // 2
                for p, d in ((a, -n), (b, -n), (more, n), (less, n)):
                    change(p, d)
                moved = True
                if steps is not None:
                    steps -= 1
        if not moved:
            break
    return bins


def pack_lengths(histogram: dict[int, int], limit: int = LIMIT) -> Bins:
    return local_search(best_fit(histogram, limit), limit)


def places(bins: Bins) -> dict[str, np.ndarray]:
    """Rows (length, first number, count, first sequence, offset): the numbered pieces of a length, in runs."""
    rows, used, sequence = [], Counter(), 0
    for pattern in sorted(bins, reverse=True):
        n, offset = bins[pattern], 0
        for x in pattern:
            rows.append((x, used[x], n, sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    rows.sort()
    names = ("length", "first", "count", "sequence", "offset")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    path = path or tokenizer_path()

    def cut_up(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        data, offsets = text_bytes(b.column(1))
        rows: tuple[list, ...] = ([], [], [], [], [])  # row, piece, start, length, crc
        for lo, hi in row_groups(offsets, GROUP_BYTES):
            counts, ids = enc.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            stops = np.cumsum(counts)
            whole = memoryview(np.insert(ids, stops, end_id).view(np.uint8))  # each text's ids and the end id
            stops += np.arange(1, len(stops) + 1)
            first = 0
            for row, stop in enumerate(stops.tolist(), lo):
                for k, at in enumerate(range(first, stop, limit)):
                    to = min(at + limit, stop)
                    for out, v in zip(rows, (row, k, at - first, to - at, zlib.crc32(whole[4 * at : 4 * to])), strict=True):
                        out.append(v)
                first = stop
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col), F.col(text_col)), cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, limit: int = LIMIT, rows_per_group: int = 20_000) -> DataFrame:
    """found (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces of one length are dealt into groups of about rows_per_group by a hash and numbered within, so a length that
    many pieces share is no single task; the groups' first numbers come from their counts.
    """
    spark = found.sparkSession
    found = cut(found)
    n = found.count()
    groups = max(1, -(-n // rows_per_group))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(groups)).cast("int")
    dealt = cut(found.withColumn("group", salt))
    counts = dealt.groupBy("length", "group").count()
    histogram = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = places(pack_lengths(histogram, limit))  # of bounded size: see the module's text
    from pyspark.sql import Window as W

    firsts = counts.withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("group").rowsBetween(W.unboundedPreceding, -1))).select("length", "group", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = dealt.withColumn("within", within).join(firsts, ["length", "group"]).withColumn("number", F.col("before") + F.col("within"))
    key = at["length"] * (1 << 44) + at["first"]
    shared = spark.sparkContext.broadcast((key, at))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        key, at = shared.value
        length, number = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
        k = np.searchsorted(key, length * (1 << 44) + number, side="right") - 1
        own = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.RecordBatch.from_arrays([*own, pa.array(at["sequence"][k] + number - at["first"][k]), pa.array(at["offset"][k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_arrow(numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number"), place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    return pack(pieces(df, id_col, text_col, path, limit), limit)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
