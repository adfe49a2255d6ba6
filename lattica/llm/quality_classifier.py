"""Operator 5: quality classifier by co-training.

Two views of a document: its text (hashed byte trigrams of the whole text, its size and line layout) and its page metadata
(language, source and the size that the page states). A logistic classifier is fitted to each view. Over some rounds
each labels those unlabelled documents of which it is most sure, out of all of them, and these pseudo-labels join the
other view's training rows. Each view is then calibrated on labelled rows that were kept apart, the calibrated views are
combined, and all documents are scored.

The fit uses at most `sample_rows` labelled documents (those of smallest hash). Every round scores all other documents
and exchanges at most `exchange` of them per view; equal documents count as one. Only feature vectors of labelled rows and
of exchanged ones come to the driver.

Defined results: null text is the empty text; null metadata is a category or zero of its own; null labels are ignored,
contradictory ones count by their mean; without labels of both kinds every score is 1 and every row is kept; rows are
judged each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hash_sample, in_arrow, map_arrow, table, utf8

TEXT_DIM = 1024
SOURCE_DIM = 64
LANG_DIM = 16
LAYOUT_DIM = 4
TEXT_VIEW_DIM = TEXT_DIM + LAYOUT_DIM
META_DIM = SOURCE_DIM + LANG_DIM + 2
SAMPLE_ROWS = 4000
EXCHANGE = 200
ROUNDS = 3
SURE = 0.95
INPUTS = ("text", "lang", "source", "n_chars")


def text_view(text: bytes) -> np.ndarray:
    """Roots of counts of hashed byte trigrams at unit length, counted over the whole text, part by part; then sizes of text and lines."""
    total = np.zeros(TEXT_DIM)
    for at in range(0, max(len(text) - 2, 0), 1 << 20):
        a = np.frombuffer(text[at : at + (1 << 20) + 2], dtype=np.uint8).astype(np.uint32)
        code = (a[:-2] * np.uint32(40503) + a[1:-1] * np.uint32(7919) + a[2:] * np.uint32(131)) >> np.uint32(3)
        total += np.bincount(code % np.uint32(TEXT_DIM), minlength=TEXT_DIM)
    x = np.sqrt(total)
    lines = text.count(b"\n") + 1
    longest = max(map(len, text.split(b"\n")))
    layout = (np.log1p(len(text)) / 8, np.log1p(lines) / 4, np.log1p(len(text) / lines) / 6, np.log1p(longest) / 6)
    return np.append(x / max(np.linalg.norm(x), 1e-9), layout).astype(np.float32)


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    x = np.zeros(META_DIM, dtype=np.float32)
    x[zlib.crc32((source or "").encode()) % SOURCE_DIM] = 1
    x[SOURCE_DIM + zlib.crc32((lang or "").encode()) % LANG_DIM] = 1
    x[-2:] = (np.log1p(max(n_chars or 0, 0)) / 8, float(n_chars is None))
    return x


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 300, rate: float = 0.05, start: Linear | None = None) -> Linear:
    """Logistic regression by Adam over all rows, from `start` if there is one; both classes weigh the same in total."""
    x = np.asarray(x, dtype=np.float32)
    share = np.clip(y.mean(), 0.02, 0.98)
    s = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) * (1 if weight is None else weight)
    w, b = (np.zeros(x.shape[1]), 0.0) if start is None else (start.weights, start.bias)
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        r = s * (sigmoid(x @ w + b) - y) / len(y)
        g = np.append(x.T @ r + ridge * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    return Linear(w, float(b))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: probability = sigmoid(a z + b), by Newton steps; smoothed targets keep it finite."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    c = np.array([1.0, 0.0])
    a = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(50):
        p = sigmoid(a @ c)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - target) + 1e-3 * (c - np.array([1.0, 0.0])))
        c = c - np.clip(step, -2, 2)
    return float(max(c[0], 0.0)), float(c[1])


@dataclass(frozen=True)
class CoTrained:
    text: Linear
    meta: Linear
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    mix: Linear
    rounds: int

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view and of both together."""
        zt = self.text.logit(xt) * self.text_scale[0] + self.text_scale[1]
        zm = self.meta.logit(xm) * self.meta_scale[0] + self.meta_scale[1]
        return sigmoid(zt), sigmoid(zm), sigmoid(self.mix.logit(np.stack([zt, zm], axis=1)))


#: What a round exchanges: for each view the features of what it is taught (text view, metadata view) and the labels.
Taught = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pool: Callable[[dict[str, Linear], dict[tuple[str, int], int]], Taught] | None, rounds: int = ROUNDS, exchange: int = EXCHANGE) -> CoTrained | None:
    """None unless there are at least two rows of each label. A fifth of the labelled rows is kept for calibration.

    pool gives, by both views' models, what each view is surest of: it is asked for so many rows of each (view, label).
    """
    if min((y > 0.5).sum(), (y <= 0.5).sum()) < 2:
        return None
    apart = np.zeros(len(y), dtype=bool)
    for kind in (y > 0.5, y <= 0.5):
        apart[np.flatnonzero(kind)[::5]] = True
    if min((y[~apart] > 0.5).sum(), (y[~apart] <= 0.5).sum()) < 1:
        apart[:] = False
    own = ~apart
    hold = apart if apart.any() else own
    told: Taught = {v: (xt[:0], xm[:0], np.zeros(0)) for v in "tm"}

    def fitted(view: str, start: Linear | None = None) -> Linear:
        t, m, label = told[view]
        x = np.concatenate([xt[own], t] if view == "t" else [xm[own], m])
        return fit_linear(x, np.concatenate([y[own], label]), np.concatenate([np.ones(own.sum()), np.full(len(label), 0.5)]), steps=300 if start is None else 100, start=start)

    models = {v: fitted(v) for v in "tm"}
    good = min(max(round(exchange * float((y[own] > 0.5).mean())), 1), max(exchange - 1, 1))
    for _ in range(rounds if pool else 0):
        given = pool(models, {(v, k): good if k else max(exchange - good, 1) for v in "tm" for k in (0, 1)})
        for view, new in given.items():
            told[view] = tuple(np.concatenate(x) for x in zip(told[view], new, strict=True))  # type: ignore[assignment]
        models = {v: fitted(v, models[v]) for v in "tm"}
    zt, zm, yh = models["t"].logit(xt[hold]), models["m"].logit(xm[hold]), (y[hold] > 0.5).astype(float)
    ts, ms = calibrate(zt, yh), calibrate(zm, yh)
    both = np.stack([zt * ts[0] + ts[1], zm * ms[0] + ms[1]], axis=1)
    # both views speak in log odds of the same prior: their weights are fitted, none below zero
    prior_z = np.log((yh.sum() + 1) / (len(yh) - yh.sum() + 1))
    weight = np.array([1.0, 1.0])
    for _ in range(200):
        p = sigmoid(prior_z + (both - prior_z) @ weight)
        weight = np.maximum(weight - 0.5 * (both - prior_z).T @ (p - yh) / len(yh), 0.0)
    return CoTrained(models["t"], models["m"], ts, ms, Linear(weight, float(prior_z * (1 - weight.sum()))), rounds)


class Pool:
    """All rows of df (h, text, lang, source, n_chars); h is a hash of the row's inputs. What a view was taught once isn't taught again."""

    def __init__(self, df: DataFrame, sure: float = SURE) -> None:
        self.df, self.sure, self.seen = df, sure, {"t": set(), "m": set()}

    def surest(self, models: dict[str, Linear], most: dict[tuple[str, int], int]) -> list[tuple[str, int, int]]:
        """(view, label, h): the documents that each view is surest of, at least `sure`, ties by hash. Tasks hand on no more than `most` each."""
        sure, seen = self.sure, {"t": self.seen["m"], "m": self.seen["t"]}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[str, int], dict[int, float]] = {k: {} for k in most}
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    own = part.column(0).to_numpy()
                    for view, x in zip("tm", _views(part, [1, 2, 3, 4]), strict=True):
                        p = np.round(sigmoid(models[view].logit(x)), 6)
                        for label, q in ((1, p), (0, np.round(1 - p, 6))):
                            kept = best[view, label]
                            for k in np.flatnonzero(q >= sure).tolist():
                                if int(own[k]) not in seen[view]:
                                    kept[int(own[k])] = float(q[k])
                            if len(kept) > 4 * most[view, label]:
                                best[view, label] = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[: most[view, label]])
            rows = [(v, label, h, q) for (v, label), kept in best.items() for h, q in sorted(kept.items(), key=lambda x: (-x[1], x[0]))[: most[v, label]]]
            yield pa.RecordBatch.from_pylist([dict(zip(("view", "label", "h", "q"), r, strict=True)) for r in rows], schema=pa.schema([("view", pa.string()), ("label", pa.int32()), ("h", pa.int64()), ("q", pa.float64())]))

        found = in_arrow(self.df.select("h", *INPUTS), run, "view string, label int, h long, q double").groupBy("view", "label", "h").agg(F.max("q").alias("q"))
        limit = F.element_at(F.create_map(*(F.lit(x) for (v, k), n in most.items() for x in (f"{v}{k}", n))), F.concat("view", "label"))
        place = F.row_number().over(W.partitionBy("view", "label").orderBy(F.col("q").desc(), "h"))
        return [(r["view"], r["label"], r["h"]) for r in found.withColumn("place", place).where(F.col("place") <= limit).select("view", "label", "h").collect()]

    def __call__(self, models: dict[str, Linear], most: dict[tuple[str, int], int]) -> Taught:
        chosen = self.surest(models, most)
        other = {"t": "m", "m": "t"}
        for view, _, h in chosen:
            self.seen[other[view]].add(h)
        spark = self.df.sparkSession
        named = spark.createDataFrame([(h,) for h in sorted({h for _, _, h in chosen})], "h long")
        rows = self.df.join(F.broadcast(named), "h").dropDuplicates(["h"]).select("h", *INPUTS)
        got = {r.h: (r.t, r.m) for r in _features(rows, "h long").toPandas().itertuples()} if chosen else {}
        out = {}
        for view in "tm":
            mine = [(h, label) for v, label, h in sorted(chosen) if v == other[view]]
            t, m = (np.frombuffer(b"".join(got[h][k] for h, _ in mine), dtype=np.float32).reshape(-1, dim) for k, dim in ((0, TEXT_VIEW_DIM), (1, META_DIM)))
            out[view] = t, m, np.array([float(label) for _, label in mine])
        return out


def _inputs(df: DataFrame, id_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), *(F.col(c) for c in INPUTS)]


def _views(b: pa.RecordBatch, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    texts = utf8(b.column(at[0]))
    meta = [b.column(i).to_pylist() for i in at[1:]]
    return np.array([text_view(t) for t in texts]).reshape(-1, TEXT_VIEW_DIM), np.array([meta_view(*m) for m in zip(*meta, strict=True)]).reshape(-1, META_DIM)


def _features(df: DataFrame, key: str) -> DataFrame:
    """The key and both views of df (key, inputs), as bytes."""

    def views(b: pa.RecordBatch) -> pa.RecordBatch:
        t, m = _views(b, [1, 2, 3, 4])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in t], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], names=[key.split()[0], "t", "m"])

    return map_arrow(df, views, f"{key}, t binary, m binary")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, exchange: int = EXCHANGE) -> CoTrained | None:
    """The two views and their combination from a bounded sample of labelled rows, and all other rows of df."""
    means = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    chosen = cut(hash_sample(means, F.col("id"), sample_rows))
    rows = df.select(*_inputs(df, id_col))
    # rows of one id and equal inputs are one; an id of several texts gives the first of them by hash
    known = rows.withColumn("h", F.xxhash64(*INPUTS)).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by(F.struct("y", *INPUTS), "h").alias("r")).select("r.*").select("y", *INPUTS)
    got = _features(known, "y double").toPandas().sort_values(["t", "m", "y"])
    if not len(got):
        return None
    to = lambda column, dim: np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, dim)
    rest = rows.join(F.broadcast(chosen.select("id")), "id", "left_anti").select(F.xxhash64(*INPUTS).alias("h"), *INPUTS)
    return co_train(to(got.t, TEXT_VIEW_DIM), to(got.m, META_DIM), (got.y.to_numpy() >= 0.5).astype(float), Pool(rest), rounds, exchange)


def judge(b: pa.RecordBatch, at: list[int], model: CoTrained | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        return (np.ones(b.num_rows),) * 3
    found = [model.score(*_views(b.slice(k, 512), at)) for k in range(0, b.num_rows, 512)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def quality_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, fit_on: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, prob_text, prob_meta, score and kept of every row of df. fit_on: the table to learn from, df itself if none is given."""
    model = fit(df if fit_on is None else fit_on, labels, id_col, **options)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t, m, s = judge(b, [1, 2, 3, 4], model)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(t), pa.array(m), pa.array(s), pa.array(s >= threshold)], names=["doc_id", "prob_text", "prob_meta", "score", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(*_inputs(df, id_col)), run, f"doc_id {kind}, prob_text double, prob_meta double, score double, kept boolean")


def keep_by_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, fit_on: DataFrame | None = None, **options) -> DataFrame:
    """The rows of df, all columns, that score at least threshold. fit_on: as for quality_classifier()."""
    model, at = fit(df if fit_on is None else fit_on, labels, id_col, **options), [df.columns.index(c) for c in INPUTS]
    return map_arrow(df, lambda b: b.filter(pa.array(judge(b, at, model)[2] >= threshold)), df.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
