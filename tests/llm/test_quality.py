import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality_classifier as qc
from lattica.llm import quality_rules as qr


def plain(text):
    """The base counts, said plainly."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_plain_ones(docs, odd):
    texts = [r.text for r in docs.select("text").limit(60).collect()] + ["a b c a b c", "x\ny\nx\n\n \nx ", "a\x0bb\x1cc d", "b b b b", "", None, "ß é 😀 | # <>"]
    for t in texts:
        assert qr.text_statistics((t or "").encode())[0] == plain(t)


def test_rules_on_odd_rows(odd, labels):
    got = qr.quality_rules(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed for r in got if r.n_words < 50)
    assert not any(r.kept for r in got if r.base_failed)
    assert qr.quality_rules(odd.limit(0), labels).count() == 0
    assert qr.quality_rules(odd, labels.limit(0)).count() == odd.count()
    assert qr.keep_by_rules(odd, labels).columns == odd.columns


@pytest.fixture(scope="module")
def bigger(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").where("quality is not null")


def held_out(verdict, labels):
    got = verdict.join(labels.where("doc_id % 3 = 0"), "doc_id").select("kept", "quality").toPandas()
    return (got.kept == (got.quality == 1)).mean(), got[got.quality == 1].kept.mean()


def test_rules_on_held_out_labels(bigger):
    docs, labels = bigger
    right, clean = held_out(qr.quality_rules(docs, labels.where("doc_id % 3 <> 0")).withColumn("kept", F.col("kept") | F.col("base_failed") & (F.col("score") >= 0.5)), labels)
    assert right > 0.9
    assert clean > 0.95


def test_classifier_on_held_out_labels(bigger):
    docs, labels = bigger
    right, clean = held_out(qc.quality_classifier(docs, labels.where("doc_id % 3 <> 0")), labels)
    assert right > 0.9
    assert clean > 0.95


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(800) > 0).astype(float)
    t = qr.fit_trees(x, y, np.array([1, -1, 0]), trees=30)
    assert ((t.score(x) > 0.5) == y).mean() > 0.8
    for f, sign in ((0, 1), (1, -1)):
        at = np.repeat(rng.random((40, 3)), 50, axis=0)
        at[:, f] = np.tile(np.linspace(0, 1, 50), 40)
        steps = np.diff(t.score(at).reshape(40, 50), axis=1) * sign
        assert steps.min() >= -1e-12
    assert qr.fit_trees(x, np.ones(800), np.zeros(3)) is None


def test_flat_scoring_equals_walking():
    rng = np.random.default_rng(1)
    x = rng.random((200, 2))
    t = qr.fit_trees(x, (x.sum(axis=1) > 1).astype(float), np.zeros(2), trees=5)
    for row, s in zip(x[:30], t.score(x[:30]), strict=True):
        z = t.bias
        for k in t.roots:
            while t.feature[k] >= 0:
                k = t.left[k] if row[t.feature[k]] <= t.threshold[k] else t.right[k]
            z += t.value[k]
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-12


class PlainPool:
    """The exchange said plainly, over arrays."""

    def __init__(self, xt, xm, names=None):
        self.x, self.names, self.seen = {"t": xt, "m": xm}, list(range(len(xt))) if names is None else names, {"t": set(), "m": set()}

    def surest(self, models, most):
        out = []
        for view, other in (("t", "m"), ("m", "t")):
            p = np.round(qc.sigmoid(models[view].logit(self.x[view])), 6)
            for label in (0, 1):
                q = np.round(p if label else 1 - p, 6)
                rows = sorted((-q[k], self.names[k], k) for k in range(len(p)) if q[k] >= 0.95 and self.names[k] not in self.seen[other])
                out += [(view, label, name, k) for _, name, k in rows[: most[view, label]]]
        return out

    def __call__(self, models, most):
        chosen, out = self.surest(models, most), {}
        for view, other in (("t", "m"), ("m", "t")):
            mine = sorted((name, label, k) for v, label, name, k in chosen if v == other)
            self.seen[view] |= {name for name, _, _ in mine}
            at = [k for _, _, k in mine]
            out[view] = self.x["t"][at], self.x["m"][at], np.array([float(label) for _, label, _ in mine])
        return out


def test_co_training_uses_the_pool():
    """One view separates the classes, the other only where the first has taught it by the pool."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000).astype(float)
    a = np.stack([y * 2 - 1 + 0.3 * rng.standard_normal(2000), rng.standard_normal(2000)], axis=1)
    b = np.stack([y * 2 - 1 + rng.standard_normal(2000), rng.standard_normal(2000)], axis=1)
    alone = qc.co_train(a[:40], b[:40], y[:40], None)
    got = qc.co_train(a[:40], b[:40], y[:40], PlainPool(a[40:], b[40:]))
    right = lambda m, k: ((m.score(a, b)[k] > 0.5) == y).mean()
    assert right(got, 2) > 0.95
    assert right(got, 1) >= right(alone, 1) - 0.01
    assert qc.co_train(a[:5], b[:5], np.ones(5), None) is None


def test_co_training_equals_plain_exchange(bigger, spark):
    """The whole fit against the same with the pool in one place; the pool is all other documents, however they are dealt."""
    docs, labels = bigger
    got = [qc.fit(docs.repartition(n), labels, sample_rows=150, exchange=30) for n in (3, 11)]
    assert np.allclose(got[0].text.weights, got[1].text.weights, atol=1e-3)
    means = labels.groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").alias("y"))
    chosen = {r.id: r.y for r in qc.hash_sample(means, F.col("id"), 150).collect()}
    rows = docs.select(F.xxhash64(*qc.INPUTS).alias("h"), "doc_id", *qc.INPUTS).toPandas()
    t = np.array([qc.text_view((x or "").encode()) for x in rows.text])
    m = np.array([qc.meta_view(a, b, c) for a, b, c in zip(rows["lang"], rows["source"], rows["n_chars"], strict=True)])
    known = rows.doc_id.isin(list(chosen)).to_numpy()
    pool = rows[~known].drop_duplicates("h").index.to_numpy()
    order = sorted(np.flatnonzero(known), key=lambda k: (t[k].tobytes(), m[k].tobytes()))
    plain = qc.co_train(t[order], m[order], np.array([float(chosen[rows.doc_id[k]] >= 0.5) for k in order]), PlainPool(t[pool], m[pool], rows.h[pool].tolist()), exchange=30)
    for a, b in ((plain.text, got[0].text), (plain.meta, got[0].meta), (plain.mix, got[0].mix)):
        assert np.allclose(a.weights, b.weights, atol=1e-2) and abs(a.bias - b.bias) < 1e-2


def test_classifier_on_odd_rows(odd, labels):
    got = qc.quality_classifier(odd, labels)
    assert got.count() == odd.count()
    assert qc.quality_classifier(odd.limit(0), labels).count() == 0
    assert [r.kept for r in qc.quality_classifier(odd, labels.limit(0)).collect()] == [True] * odd.count()
    assert qc.keep_by_classifier(odd, labels).columns == odd.columns
