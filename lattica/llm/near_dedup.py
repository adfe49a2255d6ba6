"""Operator 2: near-duplicate classes by DartMinHash signatures and banded joining.

A document is a weighted set of word shingles. DartMinHash throws hashed darts at each element's region of the plane of
weight and rank: along each unit of weight they fall as a Poisson process, rank after rank, and a dart counts if its
weight coordinate is below the element's weight. Every dart names one of k coordinates at random; the dart of lowest rank
keeps its coordinate. The darts do not depend on which other elements a document has, so two documents agree in a
coordinate with probability equal to their weighted Jaccard similarity, at a cost of about elements + k log k in place of
elements * k. The sets of a whole Arrow batch are thrown at together.

Signatures are cut into bands; documents that share a band are candidates. Equal shingle sets are one node from the start.
No bucket lists its pairs wholesale. First, each bucket's least node is held against the others; then, for some rounds, the
node with most links against those that are not in its class yet. So groups of copies collapse at a cost linear in their
size. What is left are members of different classes: those pairs whose signatures' low bits don't rule out the
threshold (by four standard deviations) meet once each, in the first band that they share, huge buckets in blocks.
All candidates are then checked exactly, on whole sets of 64-bit hashes.

Defined results: similarity is the Jaccard index of sets of `shingle` words (lower case, split at white space; a shorter,
non-empty text is one shingle). Null texts and texts without words are near-duplicates of nothing, and of each other neither.
Repeated rows (same id, same text) share a class; so do equal texts under other ids. class_id is the smallest id in the
class; a null id never becomes one while the class has another. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, in_arrow, table
from .words import SPLIT, U, hash_ranges, lowered, mix, row_groups, word_bounds

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 50, 9
HUB_ROUNDS = 2
PLANES = 3  # low bits of each coordinate that are compared before whole sets are
DEVIATIONS = 4.0
BLOCK = 2048
BROADCAST_ROWS = 1_000_000
GROUP_BYTES = 1 << 20
CELLS = 1 << 19
_ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class DartMinHash:
    """Signatures of k coordinates for sets of elements of positive weight (weights far below 1 cost more: scale them up)."""

    #: Arrivals drawn at once for each unit of weight.
    STEPS = np.array(sorted({round(1.3**e) for e in range(36)}))

    def __init__(self, k: int, seed: int = 1) -> None:
        self.k, self.seed = k, U(seed)

    def signature(self, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The identity of the earliest dart of each coordinate; all zero for no elements."""
        return self.signatures(np.array([len(elements)]), elements, weights)[0]

    def signatures(self, sizes: np.ndarray, elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """One signature per set; the sets' elements stand one set after another. No weights: all weigh 1."""
        out = np.zeros((len(sizes), self.k), dtype=U)
        with np.errstate(over="ignore"):
            base = mix(elements + self.seed * U(0xD1342543DE82EF95))
            if weights is None:
                room, cells, mass = None, sizes, sizes.astype(float)
            else:  # a cell per begun unit of weight
                units = np.ceil(weights).astype(np.int64)
                step = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
                room = np.repeat(weights, units) - step
                base = mix(np.repeat(base, units) + step.astype(U) * U(0x8EBC6AF09C88C6E3))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                cells, mass = (np.bincount(owner, w, len(sizes)) for w in (units, weights))
                cells = cells.astype(np.int64)
            first = np.cumsum(cells) - cells
            todo, needed = np.flatnonzero(cells), self.k * (np.log(self.k) + 2.0)
            while len(todo):  # each set's darts up to a rank by which its coordinates are likely to be full; where they aren't, up to a higher one
                steps = self.STEPS[np.minimum(np.searchsorted(self.STEPS, needed / mass[todo]), len(self.STEPS) - 1)]
                open_ = []
                for n in np.unique(steps):
                    sets = todo[steps == n]
                    border = np.cumsum(cells[sets] * n) // CELLS
                    for part in np.split(sets, np.flatnonzero(np.diff(border)) + 1):
                        own = cells[part]
                        at = np.arange(own.sum()) + np.repeat(first[part] - np.cumsum(own) + own, own)
                        dart, full = self._throw(base[at], None if room is None else room[at], np.repeat(np.arange(len(part)), own), needed / mass[part], int(n))
                        out[part[full]] = dart[full]
                        open_.append(part[~full])
                todo, needed = np.concatenate(open_), 1.6 * needed
        return out

    def _throw(self, base: np.ndarray, room: np.ndarray | None, owner: np.ndarray, top: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The earliest darts of each owner among all up to its top rank, and whether all its coordinates have one."""
        best = np.full(len(top) * self.k, np.inf)
        last, number, found = np.zeros(len(base)), 0, []
        while len(base):
            h = mix(base[:, None] + np.arange(number + 1, number + n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
            rank = ((h >> U(12)).astype(np.float64) + 0.5) * 2.0**-52
            np.log(rank, out=rank)
            np.negative(rank, out=rank)
            rank[:, 0] += last
            np.cumsum(rank, axis=1, out=rank)
            early = rank <= top[owner][:, None]
            alive = np.flatnonzero(early[:, -1])
            number += n
            last = rank[alive, -1]
            if room is not None:
                early &= ((mix(h ^ U(0xA0761D6478BD642F)) >> U(11)).astype(np.float64) * 2.0**-53) < room[:, None]
                room = room[alive]
            times = early.sum(axis=1)
            h, rank = h[early], rank[early]
            key = np.repeat(owner, times) * self.k + (((mix(h) >> U(32)) * U(self.k)) >> U(32)).astype(np.int64)
            np.minimum.at(best, key, rank)
            found.append((h, rank, key))
            base, owner, n = base[alive], owner[alive], max(1, n // 4)
        h, rank, key = (np.concatenate(x) for x in zip(*found, strict=True))
        first = rank == best[key]
        dart = np.zeros(len(best), dtype=U)
        dart[key[first]] = h[first]
        return dart.reshape(len(top), self.k), np.isfinite(best).reshape(len(top), self.k).all(axis=1)


def weighted_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each whole text, as 64-bit hashes in order, text after text: how many, the hashes, and how often each occurs."""
    starts, ends, words = word_bounds(data, offsets, SPLIT)
    own = hash_ranges(data, starts, ends)
    total, stop = len(own), np.cumsum(words)
    padded, h = np.concatenate([own, np.zeros(size, dtype=U)]), np.zeros(total, dtype=U)
    left = np.repeat(stop, words) - np.arange(total)  # words of the text from here on
    with np.errstate(over="ignore"):
        odd = [_ODD[k % len(_ODD)] * U(2 * (k // len(_ODD)) + 1) for k in range(size)]
        for k in range(size):
            h += padded[k : k + total] * odd[k]
        for t in np.flatnonzero((words > 0) & (words < size)):  # a short text is one shingle
            a = int(stop[t] - words[t])
            h[a] = (own[a : a + int(words[t])] * np.array(odd[: int(words[t])], dtype=U)).sum() + U(int(words[t]))
        h = mix(h)
    for b, n in zip(stop.tolist(), words.tolist(), strict=True):
        if n:
            h[b - n : b - n + max(n - size + 1, 1)].sort()
    begins = left == np.repeat(words, words)
    fine = (left >= size) | begins
    new = fine.copy()
    new[1:] &= (h[1:] != h[:-1]) | begins[1:]
    owner = np.repeat(np.arange(len(words)), words)
    at = np.flatnonzero(new)
    counts = np.diff(np.append(np.cumsum(fine)[at], fine.sum() + 1)) if len(at) else at
    return np.bincount(owner[at], minlength=len(words)), h[at], counts


def node_hashes(sizes: np.ndarray, elements: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """A hash of each weighted set."""
    with np.errstate(over="ignore"):
        x = elements ^ U(0x2545F4914F6CDD1D) if weights is None else elements + weights.astype(U) * U(0xD6E8FEB86659FD93)
        sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(mix(x))])
        stop = np.cumsum(sizes)
        return mix(sums[stop] - sums[stop - sizes] + sizes.astype(U)).view(np.int64)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(signatures), bands))
        parts = signatures.reshape(len(signatures), bands, rows)
        for k in range(rows):
            out = mix(out * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def low_bits(signatures: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """`planes` low bits of each coordinate: all first bits as 64-bit words, then all second bits, and so on."""
    n, k = signatures.shape
    out = np.zeros((n, planes, -(-k // 64) * 8), dtype=np.uint8)
    for p in range(planes):
        bits = np.packbits(((signatures >> U(p)) & U(1)).astype(np.uint8), axis=1)
        out[:, p, : bits.shape[1]] = bits
    return out.reshape(n, out.shape[1] * out.shape[2]).view(np.int64)


def _lists(values: np.ndarray, row_of: np.ndarray) -> pa.Array:
    """values' rows as lists; a row_of of -1 is null."""
    some = row_of >= 0
    ends = np.concatenate([[0], np.cumsum(some * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[row_of[some]].reshape(-1)), mask=pa.array(~some))


def signed(df: DataFrame, bands: int, rows: int, shingle: int, weighted: bool, seed: int) -> DataFrame:
    """id, node (hash of the weighted set, null without words) and, where the node is new to its task, size, planes, bands of df (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        throw, seen = DartMinHash(bands * rows, seed), set()
        for b in batches:
            data, offsets = lowered(b.column(1))
            for lo, hi in row_groups(offsets, GROUP_BYTES):
                sizes, elements, times = weighted_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
                weights = times.astype(float) if weighted else None
                node = node_hashes(sizes, elements, weights)
                row_of = np.full(hi - lo, -1)
                for k, (n, s) in enumerate(zip(node.tolist(), sizes.tolist(), strict=True)):
                    if s and n not in seen:
                        seen.add(n)
                        row_of[k] = k
                if len(seen) > 1_000_000:  # a node may then come more than once
                    seen.clear()
                new = row_of >= 0
                pick = np.repeat(new, sizes)
                found = throw.signatures(sizes[new], elements[pick], None if weights is None else weights[pick])
                row_of[new] = np.arange(len(found))
                columns = [b.column(0).slice(lo, hi - lo), pa.array(node, mask=sizes == 0), pa.array(sizes, pa.int32(), mask=~new), _lists(low_bits(found), row_of), _lists(band_hashes(found, bands, rows), row_of)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "size", "planes", "bands"])

    return in_arrow(df, run, f"id {df.schema['id'].dataType.simpleString()}, node long, size int, planes array<long>, bands array<long>")


def sets_of(df: DataFrame, needed: DataFrame, shingle: int, weighted: bool, broadcast_rows: int) -> DataFrame:
    """node, set (64-bit shingle hashes) of the nodes of needed (node, id): id names a row that has the node's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            data, offsets = lowered(b.column(0))
            for lo, hi in row_groups(offsets, GROUP_BYTES):
                sizes, elements, times = weighted_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
                node = node_hashes(sizes, elements, times.astype(float) if weighted else None)
                new = np.zeros(len(node), dtype=bool)
                for k, (n, s) in enumerate(zip(node.tolist(), sizes.tolist(), strict=True)):
                    if s and n not in seen:
                        seen.add(n)
                        new[k] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                ends = np.concatenate([[0], np.cumsum(sizes[new])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.ListArray.from_arrays(pa.array(ends), pa.array(elements[np.repeat(new, sizes)].view(np.int64)))], names=["node", "set"])

    ids = needed.select(F.col("id").alias("_id")).distinct()
    ids = F.broadcast(ids) if needed.count() <= broadcast_rows else ids
    made = in_arrow(df.join(ids, df["id"].eqNullSafe(ids["_id"]), "left_semi").select("text"), run, "node long, set array<long>")
    return made.join(needed.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def likely(k: int, planes: int, at_least: float) -> Callable[[Column, Column], Column]:
    """A condition on two arrays of low_bits: no more coordinates differ than DEVIATIONS above what pairs at the threshold have."""
    same = at_least + (1 - at_least) / 2**planes
    most, words = k * (1 - same) + DEVIATIONS * (k * same * (1 - same)) ** 0.5, -(-k // 64)

    def condition(a: Column, b: Column) -> Column:
        total = F.lit(0)
        for w in range(words):
            differ = a[w].bitwiseXOR(b[w])
            for p in range(1, planes):
                differ = differ.bitwiseOR(a[p * words + w].bitwiseXOR(b[p * words + w]))
            total = total + F.bit_count(differ)
        return total <= most

    return condition


def with_labels(rows: DataFrame, by: str, labels: DataFrame, count: int, broadcast_rows: int) -> DataFrame:
    """rows joined with labels (node, ...) on rows' column `by`, which may hold one value in a third of all rows.

    Few labels are broadcast; many are joined by (node, salt), so that no node's rows meet in one task.
    """
    if count <= broadcast_rows:
        return rows.join(F.broadcast(labels.withColumnRenamed("node", by)), by, "left")
    salted = labels.withColumnRenamed("node", by).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(16)).cast("int")).join(salted, [by, "salt"], "left").drop("salt")


def components(box: Scratch, edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """node, label (smallest node that it is linked with) of every node of edges (a, b), by min labels with pointer jumping."""
    both = box.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = box.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    count = labels.count()
    while True:
        near = with_labels(both, "b", labels, count, broadcast_rows).groupBy("a").agg(F.min("label").alias("label"))
        lower = labels.withColumnRenamed("label", "old").join(near.withColumnRenamed("a", "node"), "node").select("node", "old", F.least("old", "label").alias("at"))
        jumped = with_labels(lower, "at", labels, count, broadcast_rows)
        new = box.keep(jumped.select("node", "old", F.least("at", F.coalesce("label", "at")).alias("label")))
        done = new.where(F.col("label") != F.col("old")).isEmpty()
        if done:
            box.drop(both, new)
            return labels
        box.drop(labels)
        labels = box.keep(new.select("node", "label"))
        box.drop(new)


class Linker:
    """Candidates and verified links of the nodes of one corpus."""

    def __init__(self, box: Scratch, texts: DataFrame, read: DataFrame, at_least: float, shingle: int, k: int, weighted: bool, broadcast_rows: int) -> None:
        self.box, self.texts, self.at_least, self.shingle, self.weighted, self.broadcast_rows = box, texts, at_least, shingle, weighted, broadcast_rows
        # the low bits tell the similarity of weighted sets; links are between plain ones
        self.likely = (lambda a, b: F.lit(True)) if weighted else likely(k, PLANES, at_least)
        member = read.where("bands is not null").select("node", F.explode("bands").alias("bucket"))
        before = W.partitionBy("bucket").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
        #: the members of each bucket but its least node, `hub`
        self.live = box.keep(member.withColumn("hub", F.first("node").over(before)).where("node <> hub").distinct())
        nodes = self.live.select("node").union(self.live.select("hub")).distinct()
        ids = read.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
        seen = read.where("bands is not null").join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", "size", "planes", "bands")
        self.nodes = box.keep(seen.join(ids, "node"))
        self.edges: list[DataFrame] = []

    def _fits(self, size_a: Column, size_b: Column) -> Column:
        return F.least(size_a, size_b) >= self.at_least * F.greatest(size_a, size_b)

    def check(self, pairs: DataFrame) -> None:
        """Verifies distinct pairs (a, b) on whole sets and keeps the links."""
        pairs = self.box.keep(pairs)
        if pairs.isEmpty():
            self.edges.append(self.box.keep(pairs))
            return
        used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        needed = self.box.keep(self.nodes.select("node", "id").join(used, "node", "left_semi"))
        sets = sets_of(self.texts, needed, self.shingle, self.weighted, self.broadcast_rows)
        of_a, of_b = sets.select(F.col("node").alias("a"), F.col("set").alias("own")), sets.select(F.col("node").alias("b"), F.col("set").alias("other"))
        found = pairs.join(of_a, "a").join(of_b, "b").where(jaccard(F.col("own"), F.col("other")) >= self.at_least)
        self.edges.append(self.box.keep(found.select("a", "b")))
        self.box.drop(pairs, needed)

    def against_hubs(self, star: DataFrame) -> None:
        """Holds the hub of each row (node, hub) against its node."""
        pairs = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        one, two = (self.nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("planes").alias(f"planes_{x}")) for x in "ab")
        fine = pairs.join(one, "a").join(two, "b").where(self._fits(F.col("size_a"), F.col("size_b")) & self.likely(F.col("planes_a"), F.col("planes_b")))
        self.check(fine.select("a", "b"))

    def all_edges(self) -> DataFrame:
        out = self.edges[0]
        for e in self.edges[1:]:
            out = out.union(e)
        return out

    def labelled(self) -> DataFrame:
        """live, of open buckets, with each node's label and number of links."""
        edges = self.all_edges()
        label = components(self.box, edges)
        degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        own = self.box.keep(label.join(degree, "node"))
        rows = with_labels(self.live.select("bucket", "node"), "node", own, own.count(), self.broadcast_rows)
        rows = rows.select("bucket", "node", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
        top = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("degree", F.xxhash64("node").alias("h"), "node", "label")).alias("top"))
        open_ = self.box.keep(top.where("lo < hi").select(F.col("bucket").alias("node"), "n", F.col("top.node").alias("hub"), F.col("top.label").alias("hub_label")))
        out = self.box.keep(with_labels(rows, "bucket", open_, open_.count(), self.broadcast_rows).where("hub is not null"))
        self.box.drop(label, own, open_)
        return out

    def labels(self, hub_rounds: int) -> DataFrame | None:
        """node, label of the components of all links; None without any."""
        self.against_hubs(self.live)
        for number in range(hub_rounds + 1):
            rows = self.labelled()
            if rows.isEmpty():  # every bucket is of one class
                break
            if number == hub_rounds:
                self.check(self._pairs_left(rows.select("bucket", "node", "label", "n")))
                break
            self.against_hubs(rows.where("label <> hub_label"))
            self.box.drop(self.live)
            self.live = self.box.keep(rows.where("node <> hub").select("bucket", "node"))
            self.box.drop(rows)
        self.box.drop(rows, self.live)
        edges = self.all_edges()
        return None if edges.isEmpty() else components(self.box, edges)

    def _pairs_left(self, rows: DataFrame) -> DataFrame:
        """All pairs of different labels in a bucket, each in the first band that both share. A bucket of many is cut into blocks."""
        rows = rows.join(self.nodes.select("node", "size", "planes", "bands"), "node").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
        left = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x, y = left.alias("x"), right.alias("y")
        same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.part") == F.col("y.part"))
        open_ = (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & self._fits(F.col("x.size"), F.col("y.size"))
        first = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.bucket")
        return x.join(y, same & open_ & self.likely(F.col("x.planes"), F.col("y.planes")) & first).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, seed: int = 1, hub_rounds: int = HUB_ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row (doc_id, class_id, class_size) per row of df.

    weighted: candidates come from shingles weighted by their repeats, else every shingle weighs 1. Links are checked on sets.
    hub_rounds: how often the node with most links of each bucket is held against it before what is left is paired.
    """
    box = Scratch(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    read = box.keep(signed(texts, bands, rows, shingle, weighted, seed))
    of = box.keep(read.select("id", "node"))
    linker = Linker(box, texts, read, at_least, shingle, bands * rows, weighted, broadcast_rows)
    box.drop(read)
    label = linker.labels(hub_rounds)
    if label is not None:
        with_label = with_labels(of.where("node is not null"), "node", label, label.count(), broadcast_rows).select("id", F.coalesce("label", "node").alias("label"))
    else:
        with_label = of.where("node is not null").select("id", F.col("node").alias("label"))
    classes = with_label.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    big = box.keep(classes.where("class_size > 1"))
    out = with_labels(with_label, "label", big.withColumnRenamed("label", "node"), big.count(), broadcast_rows)
    out = out.select(F.col("id").alias("doc_id"), F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
    return out.union(of.where("node is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of df without near-duplicates: of each class the row of smallest id stays, of equal ids one.

    The rows are numbered once and written with their numbers, so that every later read, on whatever executors, means the
    same row by a number; repeated rows and ids lose no more than they should. The numbers of rows that go are broadcast if
    there are at most broadcast_rows of them; else the join shuffles.
    """
    box = Scratch(df.sparkSession)
    names = [f"_c{k}" for k in range(len(df.columns))]  # so that no column of df clashes with the row's number
    rows = box.keep(df.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
    own, text = (names[df.columns.index(c)] for c in (id_col, text_col))
    classes = near_duplicates(rows, "_row", text, broadcast_rows=broadcast_rows, **options).where("class_size > 1").select(F.col("doc_id").alias("_row"), "class_id")
    members = box.keep(classes.join(rows.select("_row", F.col(own).alias("id")), "_row"))
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("f")).select(F.col("f._row").alias("_row"))
    gone = box.keep(members.select("_row").join(first, "_row", "left_anti"))
    small = gone.count() <= broadcast_rows
    return rows.join(F.broadcast(gone) if small else gone, "_row", "left_anti").select(*names).toDF(*df.columns)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
