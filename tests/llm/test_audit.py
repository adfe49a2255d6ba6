"""The Merkle manifest, the source divergence audit and decontamination, each against a plain version of itself."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontamination, divergence, merkle

DATA = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def equals_sql(spark, got, sql):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    a, b = got.toPandas(), c.execute(sql).df()
    k = sorted(a.columns)
    assert k == sorted(b.columns)
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    return a.equals(b)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The top and, for each leaf, its run's other members (before, after) at each level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, x in enumerate(at):
            run = x // 8 * 8
            paths[k].append((level[run:x], level[x + 1 : run + 8]))
        at = [x // 8 for x in at]
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), h(*(field(r[c]) for c in COLUMNS))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x for _, x in sorted(groups[g])]) for g in order]
    root, above = tree([t for t, _ in trees])
    out = []
    for g, (subroot, paths), up in zip(order, trees, above, strict=True):
        for ((there, doc_id), leaf), path in zip(sorted(groups[g]), paths, strict=True):
            beside = [x for a, b in path + up for x in a + b]
            out.append((doc_id if there else None, leaf, subroot, root, h(*beside), ["".join(a) for a, _ in path + up]))
    return out


def checked(rows, got):
    key = lambda x: tuple(map(str, x))
    shown = [(r["id"], r["leaf"], r["subroot"], r["root"], h(*(a + b for a, b in zip(r["before"], r["after"], strict=True))), list(r["before"])) for r in got.collect()]
    return sorted(shown, key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_odd_rows(spark, odd):
    rows = [r.asDict() for r in odd.select(COLUMNS).collect()]
    assert checked(rows, merkle.manifest(odd, COLUMNS, "doc_id", "lang"))
    assert merkle.manifest(odd.limit(0), COLUMNS, "doc_id", "lang").count() == 0


def test_manifest_over_several_rounds(spark):
    """One group of more leaves than a block, with repeated rows, groups of one row and more groups than a run."""
    d = spark.range(700).select((F.col("id") - F.col("id") % 3).alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") < 640, "en").otherwise(F.concat(F.lit("l"), (F.col("id") % 11).cast("string"))).alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("Text "), (F.col("id") % 5).cast("string")).alias("text"))
    d = d.unionByName(d.where("doc_id = 3")).unionByName(d.limit(1).withColumn("lang", F.lit("é")))
    rows = [r.asDict() for r in d.collect()]
    got = merkle.manifest(d, COLUMNS, "doc_id", "lang")
    assert checked(rows, got)
    good = got.select((merkle.folded(F.col("leaf"), F.col("before"), F.col("after")) == F.col("root")).alias("ok"), (merkle.folded(F.sha2(F.lit("x"), 256), F.col("before"), F.col("after")) == F.col("root")).alias("bad"))
    assert good.agg(F.min("ok"), F.max("bad")).first() == (True, False)


def test_manifest_query_equals_sql(spark):
    assert equals_sql(spark, merkle.op11_merkle_manifest(spark, DATA), merkle.ORACLE)


@pytest.mark.parametrize(("n", "levels"), [(0, 0), (1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3)])
def test_height(n, levels):
    assert merkle.height(n) == levels


def plain_divergence(rows, min_docs, top):
    texts = [((r["lang"] or ""), (r["source"] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {t[0] for t in texts}:
        own = [t for t in texts if t[0] == lang]
        docs = Counter(w for _, _, ws in own for w in set(ws))
        kept = {w for w, n in docs.items() if n >= min_docs}
        counts = {s: Counter(w for _, x, ws in own if x == s for w in ws if w in kept) for _, s, _ in own}
        whole = sum(counts.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = [(-sum(abs(shares[s][w] - shares[t][w]) for w in kept), t.encode()) for t in counts if t != s]
            terms = [(q[w] - shares[s][w], w.encode()) for w in kept if counts[s][w] and shares[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, x.decode(), -v, k + 1) for k, (v, x) in enumerate(sorted(found)[:most])]
    return sorted(out)


def test_divergence_of_odd_rows_in_small_blocks(spark, odd, docs):
    """Blocks of three sources and chunks of about eight terms, so that a task reads many chunks and a language has several tasks."""
    many = docs.where("doc_id < 90").select("lang", "source", F.concat("text", F.lit(" Ünï CASE case")).alias("text"))
    both = odd.select("lang", "source", "text").unionByName(many)
    rows = [r.asDict() for r in both.collect()]
    for min_docs, top in ((3, 50), (10**6, 50), (1, 4)):
        got = sorted(tuple(r) for r in divergence.divergence(both, min_docs, top, block=3, chunk_terms=8).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == plain_divergence(rows, min_docs, top)
    assert divergence.divergence(odd.limit(0)).count() == 0


def test_divergence_query_equals_sql(spark):
    assert equals_sql(spark, divergence.op12_source_divergence(spark, DATA), divergence.ORACLE)


def test_shares_of_large_counts():
    n, whole = np.array([[0, 7, 10**12, 9 * 10**14]]), np.array([9 * 10**14 + 5])
    assert divergence.shares(n, whole).tolist() == [[1 + 10**9 * (int(x) + 5) // int(whole[0]) for x in n[0]]]


def test_counts_of_a_long_text_and_of_split_batches():
    text = "Aé b B 7x " * 300_000
    t = pa.table({"lang": ["l"] * 3, "source": ["s", "s", "t"], "text": [text, None, "b"]})
    out = pa.Table.from_batches(divergence._counted(iter(t.to_batches()))).to_pandas().groupby(["source", "term"])[["n", "df"]].sum()
    assert out.to_dict("index") == {("s", "aé"): {"n": 300_000, "df": 1}, ("s", "b"): {"n": 600_000, "df": 1}, ("s", "x"): {"n": 300_000, "df": 1}, ("t", "b"): {"n": 1, "df": 1}}


def plain_overlap(docs, items, n=10):
    cut = lambda t: [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))]
    windows = {}
    for item, text in items:
        w = [x for x, _, _ in cut(text)]
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item) if item is not None else "null")
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := windows.get(tuple(y for y, _, _ in w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= x
        spans, clean, at = [], "", 0
        for k in sorted(hit):
            if spans and spans[-1][1] == k - 1:
                spans[-1] = (spans[-1][0], k, spans[-1][2], w[k][2])
            else:
                spans.append((k, k, w[k][1], w[k][2]))
        for _, _, a, b in spans:
            clean, at = clean + text[at:a], b
        out.append((doc_id, len(w), len(hit), sorted(found), spans, clean + text[at:] if text is not None else None))
    return sorted(out, key=lambda r: (str(r[0]), str(r[5])))


@pytest.fixture(scope="session")
def passages(spark, odd, docs):
    """Documents with passages at the start, at the end, one after another, doubled, in upper case and across odd signs; and the items."""
    a, b = "Αλφα one TWO three four five six seven eight nine ten eleven twelve", "uno dos tres cuatro cinco seis siete ocho nueve diez"
    more = [(100, a), (101, f"x {a.upper().replace('ΑΛΦΑ', 'Αλφα')} y"), (102, f"{a} {b}"), (103, f"é{a}"), (104, a.replace(" ", "--")), (105, f"{b} {b}"), (106, " ".join(a.split()[:9])), (107, f"zz short item, {b}"), (107, f"zz short item, {b}"), (108, " ".join(a.split()[1:11]) + "x")]
    d = odd.unionByName(spark.createDataFrame([(k, t, "en", "s", 1) for k, t in more], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    items = spark.createDataFrame([(1, a), (2, b), (2, "Short ITEM"), (3, None), (4, ""), (None, b + " once"), (5, "some quite long text with words some quite long text with words"), (6, "!!"), (12, a)], "item_id long, text string")
    return d.unionByName(docs.where("doc_id < 60"), allowMissingColumns=True), items


@pytest.mark.parametrize("most", [10**6, 7])
def test_overlaps_are_those_of_plain_search(passages, most):
    """At once, and in parts of about seven windows."""
    d, items = passages
    want = plain_overlap([(r.doc_id, r.text) for r in d.collect()], [tuple(r) for r in items.collect()])
    rows = decontamination.overlaps(d, items, ["doc_id", "text"], max_windows=most).withColumn("clean", decontamination.without_spans(F.col("text"), F.col("spans"))).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), list(r["items"]), [tuple(s) for s in r.spans], r.clean) for r in rows), key=lambda r: (str(r[0]), str(r[5])))
    assert got == want and sum(r[2] > 0 for r in want) >= 8


def test_decontaminated_rows(passages):
    d, items = passages
    want = plain_overlap([(r.doc_id, r.text) for r in d.collect()], [tuple(r) for r in items.collect()])
    clean = decontamination.decontaminate(d, items)
    assert clean.columns == d.columns and sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(str((r[0], r[5])) for r in want)
    left = decontamination.decontaminate(d, items, "documents")
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in want if not r[2])
    assert decontamination.decontaminate(d.limit(0), items).count() == 0
    assert decontamination.overlaps(d, items.limit(0), ["doc_id"]).where("size(spans) > 0 or size(items) > 0").count() == 0


def test_decontamination_query_equals_sql(spark):
    assert equals_sql(spark, decontamination.op13_benchmark_decontamination(spark, DATA), decontamination.ORACLE)
