import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lattica.llm.near_dedup import DartMinHash, U, keep_one_per_class, near_duplicates, weighted_sets
from lattica.llm.words import lowered


def brute(rows):
    """Classes by plain Jaccard similarity of five-word sets."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    out = {}
    for k in range(len(rows)):
        out.setdefault(top(k), []).append(rows[k][0])
    return sorted(sorted(str(x) for x in v) for v in out.values())


def classes(df):
    out = {}
    for k, r in enumerate(df.collect()):
        out.setdefault((r.class_id, k if r.class_size == 1 else -1), []).append(str(r.doc_id))
    return sorted(sorted(v) for v in out.values())


def test_signatures_estimate_weighted_similarity():
    throw, rng = DartMinHash(1024), np.random.default_rng(0)
    for n in (3, 200, 3000):
        e = rng.integers(0, 2**63, n).astype(U)
        v = rng.random(n) * 3 + 0.2
        w = v * rng.choice([0.5, 1.0, 2.0], n)
        true = np.minimum(v, w).sum() / np.maximum(v, w).sum()
        assert abs((throw.signature(e, v) == throw.signature(e, w)).mean() - true) < 0.08
        assert (throw.signature(e, v) == throw.signature(e[::-1], v[::-1])).all()
    assert not throw.signature(e[:0], v[:0]).any()


def test_signatures_of_many_sets_at_once():
    throw, rng = DartMinHash(450), np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(U) for n in (1, 0, 7, 900, 40000)]
    both = throw.signatures(np.array([len(s) for s in sets]), np.concatenate(sets))
    for s, got in zip(sets, both, strict=True):
        assert (throw.signature(s, np.ones(len(s))) != 0).all() == bool(len(s))
        assert (throw.signatures(np.array([len(s)]), s)[0] == got).all()


def test_sets_equal_plain_ones():
    rng = np.random.default_rng(2)
    texts = [None, "", " \n", "One", "a b c d", "a b c d e", "a b c d e " * 9, "x\u00a0y\u3000z  Q\x1cR É", *(" ".join(rng.choice(["a", "B", "é", "日本", "x,"], 200)) for _ in range(20))]
    sizes, elements, times = weighted_sets(*lowered(pa.array(texts)))
    names, at = {}, 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        w = (t or "").lower().split()
        plain = {}
        for k in range(max(len(w) - 4, 1) if w else 0):
            plain[tuple(w[k : k + 5])] = plain.get(tuple(w[k : k + 5]), 0) + 1
        assert n == len(plain)
        assert sorted(times[at : at + n].tolist()) == sorted(plain.values())
        for s in plain:
            names.setdefault(s, len(names))
        at += n
    assert len(np.unique(elements)) == len(names)


def test_classes_equal_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert classes(near_duplicates(docs)) == brute(rows)


def test_a_star_of_variants_is_one_class(spark):
    """Each variant is near the base only: pairs of variants are below the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        words = list(base)
        for at in rng.choice(80, 7, replace=False) * 5:
            words[at] = f"x{k}_{at}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"z{k}_{i}" for i in range(50))) for k in range(30)]
    want = brute(rows)
    assert classes(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert max(map(len, want)) == 60


def test_blocks_shuffled_joins_and_weights(spark, docs, monkeypatch):
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr("lattica.llm.near_dedup.BLOCK", 2)
    assert classes(near_duplicates(docs, broadcast_rows=0, hub_rounds=0)) == want
    assert classes(near_duplicates(docs, weighted=True)) == want


def test_odd_rows(odd):
    got = near_duplicates(odd)
    assert got.count() == odd.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.class_id, r.class_size))
    assert by[4] == [(4, 3)] * 2
    assert by[5] == [(4, 3)]
    assert by[1] == [(1, 1)]
    assert by[None] == [(None, 1)]
    assert near_duplicates(odd.limit(0)).count() == 0


def test_one_row_of_each_class_stays(odd, docs, tmp_path, spark):
    odd.write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    kept = keep_one_per_class(d)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in [1, 2, 3, 4, 6, None, 7])
    n = near_duplicates(docs).select("class_id").distinct().count()
    assert keep_one_per_class(docs).count() == n
    assert keep_one_per_class(docs.where(F.lit(False))).count() == 0
