"""Operator 6: quality rules as gradient-boosted trees over document statistics.

Statistics of every whole text are computed in an Arrow function. Trees are boosted on the logistic loss from binned
statistics, with monotonic constraints on chosen features, then flattened into numpy node arrays, so that a batch is
scored by a fixed number of vectorised steps. The fit uses at most `sample_rows` labelled documents (those of smallest
hash); scoring covers all rows.

Defined results: null or empty text has no words and fails the base rule; a null, repeated or contradictory label counts
by its mean, nulls not at all; without labels of both kinds the verdict is that of the base rule alone; rows are judged
each for itself, so repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, table, utf8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: name -> monotonic direction of the keep score: -1 falling, 0 free
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "exclaim_per_word": -1,
    "bar_per_word": -1,
    "digit_share": 0,
    "distinct_word_share": 0,
    "mean_line_words": 0,
}
SAMPLE_ROWS = 6000
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))


def text_statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the features of one whole text."""
    words = text.split()  # bytes.split cuts at exactly 0x20 and 0x09 to 0x0D
    n = len(words)
    count = lambda drop: len(text) - len(text.translate(None, drop))
    points = len(text.decode()) if not text.isascii() else len(text)
    word_chars = points - count(SPACES)
    symbols = count(SYMBOLS)
    lines = [x for x in text.split(b"\n") if x and x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    distinct = 0
    if n:
        h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
        distinct = len(np.unique(h))
        if n >= 4:
            with np.errstate(over="ignore"):
                w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) ^ (h[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(2))
                w = (w ^ (w >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) ^ (h[:-2] + (h[2:] << np.uint64(1)))
            _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeat = int(covered.sum())
    m = max(n, 1)
    features = (float(np.log1p(n)), word_chars / m, symbols / m, dup / max(len(lines), 1), repeat / m, count(UPPER) / max(word_chars, 1), text.count(b"!") / m, text.count(b"|") / m, count(DIGITS) / max(word_chars, 1), distinct / m, n / max(len(lines), 1))
    return (n, word_chars, symbols, dup, repeat), features


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass(frozen=True)
class Trees:
    """Flat nodes of all trees: feature (-1 at a leaf), threshold, children, value; roots[t] is where tree t starts."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row, by `depth` vectorised steps over rows and trees at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)
        z = self.bias + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, min_rows: int = 10, ridge: float = 2.0) -> Trees | None:
    """Histogram boosting. A split on a constrained feature must keep the order of its children's values, and bounds what
    stands below them by their middle, so every tree, and so the sum, is monotonic in that feature. None if y has one value only.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    z = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        for a, b in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, v)):
            a.append(b)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        weigh = lambda gs, hs: np.clip(-gs / (hs + ridge), low, high)
        gt, ht = g[rows].sum(), h[rows].sum()
        own = float(weigh(gt, ht))
        at = leaf(rate * own)
        if level == depth or len(rows) < 2 * min_rows:
            return at
        gain_of = lambda gs, hs, w: -(gs * w + 0.5 * (hs + ridge) * w * w)
        best, found = 1e-6, None
        for f in range(x.shape[1]):
            k = len(cuts[f]) + 1
            if k < 2:
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=k))[:-1] for w in (g[rows], h[rows], None))
            wl, wr = weigh(gs, hs), weigh(gt - gs, ht - hs)
            gain = gain_of(gs, hs, wl) + gain_of(gt - gs, ht - hs, wr) - gain_of(gt, ht, own)
            ok = (ns >= min_rows) & (len(rows) - ns >= min_rows)
            if monotone[f]:
                ok &= (wr - wl) * monotone[f] >= 0
            gain = np.where(ok, gain, -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = gain[i], (f, i, float(wl[i]), float(wr[i]))
        if found is None:
            return at
        f, i, wl, wr = found
        middle = (wl + wr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[f])]
        goes = binned[rows, f] <= i
        feature[at], threshold[at] = f, float(cuts[f][i])
        left[at] = grow(rows[goes], g, h, level + 1, *bounds[0])
        right[at] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        start = len(feature)
        roots.append(start)
        grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0)
        z += tree_values(x, feature, threshold, left, right, value, start, depth)
    return Trees(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), depth=depth, bias=bias)


def tree_values(x, feature, threshold, left, right, value, root, depth) -> np.ndarray:
    fe, th, le, ri, va = (np.array(a[root:]) for a in (feature, threshold, left, right, value))
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(depth):
        f = fe[node]
        down = np.where(x[rows, np.maximum(f, 0)] <= th[node], le[node], ri[node]) - root
        node = np.where(f >= 0, down, node)
    return va[node]


def labelled(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """At most sample_rows labelled ids (id, y): y is the mean label, 0 to 1."""
    means = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    return hash_sample(means, F.col("id"), sample_rows)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Trees | None:
    """Trees from the labelled rows; the sample, of bounded size, is broadcast, its statistics come to the driver."""
    chosen = labelled(df, labels, id_col, label_col, sample_rows)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.min_by(F.struct("y", "text"), F.xxhash64("text")).alias("r")).select("r.y", "r.text")  # an id of several texts gives one of them

    def stats(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [list(text_statistics(t)[1]) for t in utf8(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = map_arrow(rows, stats, "y double, x array<double>").toPandas()
    if not len(got):
        return None
    got["key"] = [tuple(v) for v in got.x]
    got = got.sort_values(["key", "y"])  # the order of rows doesn't change the fit
    return fit_trees(np.array(got.x.tolist()), (got.y.to_numpy() >= 0.5).astype(float), np.array(list(FEATURES.values())), **options)


def judge(texts: list[bytes], model: Trees | None, threshold: float) -> dict[str, np.ndarray]:
    found = [text_statistics(t) for t in texts]
    base = np.array([b for b, _ in found], dtype=np.int64).reshape(-1, len(BASE))
    score = model.score(np.array([f for _, f in found])) if model is not None else np.ones(len(texts))
    failed = base_failed(base[:, 0], base[:, 4])
    return dict(zip(BASE, base.T, strict=True)) | {"base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the trees' score of every row of df."""
    model = fit(df, labels, id_col, text_col, **options)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = judge(utf8(b.column(1)), model, threshold)
        names = [*BASE, "base_failed", "kept", "score"]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[n]) for n in names)], names=["doc_id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col), F.col(text_col)), run, f"doc_id {kind}, {', '.join(f'{n} long' for n in BASE)}, base_failed boolean, kept boolean, score double")


def keep_by_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of df, all columns, that the rules keep."""
    model, at = fit(df, labels, id_col, text_col, **options), df.columns.index(text_col)
    return map_arrow(df, lambda b: b.filter(pa.array(judge(utf8(b.column(at)), model, threshold)["kept"])), df.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
