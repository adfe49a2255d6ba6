import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from lattica.llm.words import text_bytes
from lattica.llm import ann, html_extraction, language_id, sentencepiece_sampling, sharding

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sampled(lat, texts, keys, k):
    return sentencepiece_sampling.sample_batch(lat, *text_bytes(sentencepiece_sampling.blank_first(pa.array(texts))), keys, k)


def test_samples_are_those_of_the_enumerated_lattice():
    """All segmentations of short texts, found by plain recursion over the model's pieces, with their probabilities."""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    n, theta = model.get_piece_size(), 0.5
    pieces = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    byte = {i: model.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
    weigh = lambda i: -theta * np.log(3 + min(-model.get_score(i), n))

    def ways(word):
        if not word:
            yield (), 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in pieces:
                for ids, w in ways(word[k:]):
                    yield (pieces[word[:k]], *ids), w + weigh(pieces[word[:k]])
        if word and word[0] not in pieces:
            own = word[0].encode()
            for ids, w in ways(word[1:]):
                yield (*(byte[x] for x in own), *ids), w - theta * np.log(3 + n) * len(own)

    for text in ("at", "so on", "é\n\U0001F980a", "the cat", "  x"):
        lat = sentencepiece_sampling.Lattices(PIECES, theta)
        plain = dict(ways("▁" + text.replace(" ", "▁")))
        total = np.logaddexp.reduce(list(plain.values()))
        got = sentencepiece_sampling.encode_batch(lat, pa.array([text]), [3], len(plain) + 5)
        ends = np.cumsum(got["n_pieces"])
        rows = {tuple(got["ids"][e - m : e].tolist()): f for e, m, f in zip(ends, got["n_pieces"], got["log_prob"], strict=True)}
        assert set(rows) == set(plain) and len(rows) == len(ends)
        assert all(abs(rows[x] - (plain[x] - total)) < 1e-9 for x in plain)
        assert got["round_trip"].all() and (got["log_inclusion"] == 0).all()


def test_samples_are_distinct_and_decode(docs, odd):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for d in (docs.limit(40), odd):
        texts = {str(r.doc_id): r.text or "" for r in d.collect()}
        rows = sentencepiece_sampling.sampled_encodings(d).collect()
        assert all(r.round_trip and model.decode(list(r.ids)) == texts[str(r.doc_id)] for r in rows)
        for r in rows:
            assert r.log_inclusion <= 0
        by = {}
        for r in rows:
            by.setdefault(str(r.doc_id), []).append((r.sample, -r.perturbed, tuple(r.ids)))
        for v in by.values():
            own = sorted(set(v))
            assert [x[1] for x in own] == sorted(x[1] for x in own)
            assert len({x[2] for x in own}) == len(own)
    got = sentencepiece_sampling.decoded(sentencepiece_sampling.sampled_encodings(docs.limit(5)).where("sample = 1"))
    want = {r.doc_id: r.text for r in docs.collect()}
    assert all(want[r.doc_id] == r.text for r in got.collect())
    assert sentencepiece_sampling.sampled_encodings(docs.limit(0)).count() == 0


def test_samples_follow_the_lattice():
    """First and second draws have the probabilities of sampling without replacement; weights undo inclusion."""
    lat = sentencepiece_sampling.Lattices(PIECES, theta=0.3)
    keys = np.random.default_rng(0).integers(0, 2**63, 6000).tolist()
    got = sampled(lat, ["at the"] * len(keys), keys, 2)
    p = {tuple(q.edges): np.exp(q.logp) for paths, _ in got for q in paths}
    best = sorted(p, key=lambda k: -p[k])[:3]
    first = [tuple(paths[0].edges) for paths, _ in got]
    both = [tuple(tuple(q.edges) for q in paths) for paths, _ in got]
    for a in best:
        assert abs(first.count(a) / len(keys) - p[a]) < 0.03
        for b in best:
            if a != b:
                assert abs(both.count((a, b)) / len(keys) - p[a] * p[b] / (1 - p[a])) < 0.03
    weight = sum(np.exp(q.logp - sentencepiece_sampling.log_inclusion(q.logp, kappa)) for paths, kappa in got for q in paths) / len(keys)
    assert abs(weight - 1) < 0.05


def test_all_segmentations_of_a_short_text():
    lat = sentencepiece_sampling.Lattices(PIECES)
    (paths, kappa), (none, _) = sampled(lat, ["x", ""], [1, 2], 50)
    assert kappa == -np.inf
    assert abs(sum(np.exp(p.logp) for p in paths) - 1) < 1e-6
    assert len(none) == 1 and none[0].logp == 0


def test_query_returns_the_segmentations(spark):
    got = sentencepiece_sampling.op1_sentencepiece_gumbel(spark, "/root/testdata/sf0.001").where("length(cast(doc_id as string)) < 2").collect()
    assert got and all(len(r.ids) == r.n_pieces for r in got)


def test_unlikely_segmentations_are_found():
    flat, steep = (sampled(sentencepiece_sampling.Lattices(PIECES, theta), ["hello"] * 20, list(range(20)), 200) for theta in (0.1, 8.0))
    assert len({len(paths) for paths, _ in flat}) == 1
    for (a, _), (b, kappa) in zip(flat, steep, strict=True):
        assert len({tuple(p.edges) for p in b}) == len(b) == len(a) < 200
        assert kappa == -np.inf


def plain_site(pages, layout=0):
    """Pages without article or telling names: a menu, a title, a byline, paragraphs, a notice and a footer, some with a varying word."""
    rng, out = np.random.default_rng(layout), []
    for k in range(pages):
        title = " ".join(f"t{x}" for x in rng.integers(0, 10**6, 5))
        body = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(30, 60))) for _ in range(rng.integers(2, 6))]
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        around = [f"<div><a href=/>Home</a> <a href=/n>News</a></div>", f"<div><h2>{title}</h2><div>Posted by author{k} in our section</div><div>{paragraphs}</div></div>", f"<div>We use cookies on page {k} of this site</div>", f"<div>Copyright by us all rights page {k}</div>"]
        if layout:
            around = [f"<table><tr><td>{around[0]}</td><td>{around[2]}</td></tr></table>", f"<section>{around[1]}</section>", around[3]]
        out.append((f"<html><body>{''.join(around)}</body></html>", "\n".join([title, *body])))
    return out


def test_template_decides_where_roles_do_not(spark):
    site = plain_site(40) + plain_site(25, layout=1)  # two layouts on one host
    small = plain_site(4)
    rows = [(k, f"http://big.example/{k}", h) for k, (h, _) in enumerate(site)] + [(100 + k, f"http://small.example/{k}", h) for k, (h, _) in enumerate(small)]
    want = dict(enumerate(t for _, t in site)) | {100 + k: t for k, (_, t) in enumerate(small)}
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert {r.page_id: r.text for r in html_extraction.extract_pages(d).collect()} == want
    for h, t in site[:3] + site[-3:]:
        bare = html_extraction.extract(h, {})
        assert bare != t and "Copyright" in bare and "cookies" in bare


def test_classes_equal_plain_deduction(spark):
    """Occurrence vectors gathered and compared outright."""
    site = [h for h, _ in plain_site(30) + plain_site(12, layout=1)]
    vectors = {}
    for k, h in enumerate(site):
        for ts in html_extraction.page_tokens(list(html_extraction.nodes(h))):
            for t in ts:
                vectors.setdefault(t, [0] * len(site))[k] += 1
    plain = {}
    for t, v in vectors.items():
        if sum(x > 0 for x in v) >= max(3, 0.1 * len(site)):
            plain.setdefault(tuple(v), set()).add(t)
    want = sorted(sorted(c) for v, c in plain.items() if len(c) > 1 and (any(t % 2 == 0 for t in c) or sum(x > 0 for x in v) >= 0.8 * len(site)))
    d = spark.createDataFrame([(k, "http://a.example/", h) for k, h in enumerate(site)], "key long, url string, html string")
    got = {}
    both = [html_extraction.template_classes(d, broadcast_rows=n).collect() for n in (html_extraction.BROADCAST_HOSTS, 0)]
    assert sorted(both[0]) == sorted(both[1])
    for r in both[0]:
        got.setdefault(getattr(r, "class"), []).append(r.token)
    assert sorted(sorted(c) for c in got.values()) == want and len(want) > 3


def test_classes_nest():
    outer, inner = [(1, 10), (1, 11), (1, 12)], [(2, 20), (2, 21)]
    tree = html_extraction.Slots([outer[0], *inner, *inner, outer[1], outer[2]])
    assert set(tree.good) == {1, 2}
    assert [tree.rule[s] for s in tree.after] == [(1, 1), (2, 1), (1, 1), (2, 1), (1, 1), (1, 2), (0, 0)]
    assert tree.within(tree.after[1], tree.after[0]) and not tree.within(tree.after[5], tree.after[0])
    crossing = html_extraction.Slots([outer[0], inner[0], outer[1], inner[1], outer[2]])
    assert set(crossing.good) == {1}
    assert not html_extraction.Slots([(1, 10), (1, 11), (1, 11), (1, 10)]).good


def test_roles_of_inline_and_hidden_elements():
    page = '<article><p>Main <a class="share">Share this</a> text <span class="ad">Buy</span></p><p style="display:none">no</p><div hidden>no</div><p aria-hidden="true">no</p><div class="search-engine-history">Main body</div><div class="comment-list">no</div><div id="ad-slot-3">no</div><p>end</p></article>'
    assert html_extraction.extract(page, {}) == "Main text\nMain body\nend"


def test_inline_elements_of_one_name_within_each_other():
    page = '<article><p>Read <span class="ad">Buy <span>now</span> cheap</span>on <span class="ad">x <b>y <i class="share">z</span> end</p><p>next <span>a<span>b</span></span></p></article>'
    assert html_extraction.extract(page, {}) == "Read on end\nnext ab"


def test_what_ends_no_block():
    page = '<article><p>one <script>var x = "</p>"</script>two <svg><text>no</text></svg>three <math/>four <img src="a">five <button>no</button> six<hr>seven</p></article>'
    assert html_extraction.extract(page, {}) == "one two three four five six\nseven"


def test_template_decides_among_marked_articles():
    """An article element whose words are all the template's fills no slot and goes; the longest one stays even so."""
    notice, words = "<article><p>Our shop is open on all days</p></article>", "one two three four five six seven eight nine"
    pages = [f"<div>{notice}<article><h1>T{k}</h1><p>{words} x{k}</p></article></div>" for k in range(4)]
    counts = [Counter(t for ts in html_extraction.page_tokens(list(html_extraction.nodes(p))) for t in ts) for p in pages]
    classes = {}
    for t in set().union(*counts):
        if all(c[t] for c in counts):
            classes.setdefault(tuple(c[t] for c in counts), []).append(t)
    template = {t: min(ts) for ts in classes.values() for t in ts}
    assert html_extraction.extract(pages[0], template) == f"T0\n{words} x0"
    assert html_extraction.extract(pages[0], {}) == f"Our shop is open on all days\nT0\n{words} x0"
    copy = pages[0].replace(f"{words} x0", words).replace("T0", "")
    assert html_extraction.extract(copy, template) == words


def test_articles_beside_the_article():
    teaser = '<article><h2>Another one</h2><p>Read <a href="/x">this long, long teaser of another article, which is a link</a></p></article>'
    page = f'<main><h1>Title</h1><p>Related reading</p><article><p>The text of this page, which is long enough.</p><p>More of it.</p><article class="comment"><p>nice, nice, nice</p></article></article>{teaser}</main>'
    text = "The text of this page, which is long enough.\nMore of it."
    assert html_extraction.extract(page, {}) == "Title\n" + text
    assert html_extraction.extract(page.replace("<p>The", "<h1>Own</h1><p>The"), {}) == "Own\n" + text
    assert html_extraction.extract("<main><h1>Title</h1><p>one</p><p>two</p></main>", {}) == "Title\none\ntwo"
    both = "<article><p>one two three</p></article><article><p>four five six</p></article>"
    assert html_extraction.extract(both, {}) == "one two three\nfour five six"
    assert html_extraction.extract('<article class="post-12 post tag-politics has-sidebar"><p>one</p></article>', {}) == "one"


def test_names_of_comments():
    for name in ("post-comments-area", "reader_feedback", "comments-area", "comment-list-item", "article-replies"):
        assert html_extraction.extract(f'<article><p>text</p><div class="{name}"><p>nice</p></div></article>', {}) == "text", name
    for name in ("with-comments", "content has-sidebar", "commentary", "search-engine-history"):
        assert html_extraction.extract(f'<article><p>text</p><div class="{name}"><p>more</p></div></article>', {}) == "text\nmore", name


def test_long_broken_pages_take_linear_time():
    page = "<div>" * 20_000 + "x" + "</p></section>" * 20_000 + "</div>" * 20_000 + "word " * 200_000
    assert html_extraction.extract(page, {}).startswith("x\nword word")


def article(page):
    inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    import html

    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_articles_are_extracted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_extraction.extract_pages(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    by_join = html_extraction.extract_pages(pages, broadcast_bytes=0).collect()
    assert {r.page_id: r.text for r in by_join} == want


def test_boilerplate_roles_and_labels_of_the_site(spark):
    page = '<body><header>Site</header><div class="cookie-notice">We use</div><div id="main-content"><h1>T{k} &lt;x&gt;</h1><p>a <b>b</b>c{k}<p>d &amp; e{k}<ul><li>one{k}<li>two{k}</ul><p>Read more here</p><form><p>mail</form><section class="comments"><p>nice!</section></div><aside>x</aside><footer>f</footer>'
    rows = [(k, "http://a.example/1", page.replace("{k}", str(k))) for k in range(12)] + [(90, None, None), (91, "::odd::", ""), (92, "http://[", "<p>one < two<p>three"), (93, "http://b.example", "<script>var a='<p>x</p>'</script><p>y&nbsp;z</p><!-- <p>no</p> -->")]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[3] == "T3 <x>\na bc3\nd & e3\none3\ntwo3"
    assert (got[90], got[91], got[92], got[93]) == ("", "", "one < two\nthree", "y z")
    copies = spark.createDataFrame([(k, "http://a.example/1", page) for k in range(12)], "page_id long, url string, html string")
    assert all("Read more here" in r.text and "nice" not in r.text for r in html_extraction.extract_pages(copies).collect())
    assert html_extraction.extract_pages(copies.limit(0)).count() == 0


def test_recall_and_exact_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.select("vec_id", "embedding").toPandas()
    x, ids = np.array(rows.embedding.tolist(), dtype=float), rows.vec_id.to_numpy()
    got = ann.additive_search(e, lambda v: v % 20 == 0, code_block=1500).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, x[np.searchsorted(ids, own.vec_id)] @ x[q], atol=1e-12)
        hit, total = hit + len(set(best) & set(own.vec_id)), total + 20
    assert hit / total >= 0.9


def test_recall_in_a_full_cell(spark):
    x = np.random.default_rng(1).normal(size=(ann.CODE_BLOCK, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, len(x), 160)
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = ann.additive_search(rows, lambda v: v % 160 == 0).toPandas().groupby("query_id").vec_id.agg(set)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[q] & set(b)) / 20 for q, b in zip(asked, best.tolist(), strict=True)]) >= 0.97


def test_odd_vectors_and_ties(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.additive_search(d, lambda v: v % 20 == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 9, 0.5)]
    assert ann.additive_search(d.limit(0), lambda v: v % 20 == 0).count() == 0
    assert ann.additive_search(d.where("vec_id = 20"), lambda v: v % 20 == 0).count() == 0


def test_copies_at_size_are_told_apart_by_id(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 64))[r.integers(0, 60, 3000)]  # about 50 copies of each vector
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.additive_search(rows, lambda v: v % 20 == 0).toPandas()
    assert len(got) == 150 * 20
    for q, found in got.groupby("query_id"):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:20]
        found = found.sort_values("rank")
        assert found.vec_id.tolist() == want.tolist() and found.score.tolist() == score[want].tolist()


def test_shards_fit_and_split_only_when_needed(docs, odd):
    got = sharding.extendible_shards(docs, limit=20_000).toPandas()
    sums = got.groupby(["depth", "prefix", "page"]).n_bytes.agg(["sum", "count"])
    assert ((sums["sum"] <= 20_000) | (sums["count"] == 1)).all()
    assert len(got) == docs.count()
    for (depth, prefix, _), _ in sums.iterrows():
        if depth:
            near = got[(got.depth >= depth) & (got.prefix.to_numpy() >> (got.depth.to_numpy() - depth + 1).clip(0) == prefix >> 1) | (got.depth == depth) & (got.prefix == prefix ^ 1)]
            assert near.n_bytes.sum() > 20_000
    same = odd.where("doc_id = 4")
    many = same
    for _ in range(4):
        many = many.union(many)
    paged = sharding.extendible_shards(many, limit=100).toPandas()
    assert len(paged) == many.count()
    assert paged.groupby("page").n_bytes.sum().max() <= 100
    assert sharding.extendible_shards(odd, limit=200).count() == odd.count()
    assert sharding.extendible_shards(odd.limit(0)).count() == 0


def test_shards_equal_sql(spark, docs, monkeypatch):
    c = duckdb.connect()
    c.execute("create view documents as from '/root/testdata/sf0.001/documents.parquet'")
    k = ["doc_id", "n_bytes", "depth", "prefix", "page", "shard_bytes"]
    want = c.execute(sharding.ORACLE.replace(str(sharding.LIMIT_BYTES), "30000")).df()[k].sort_values(k).reset_index(drop=True)
    for rows in (sharding.BROADCAST_ROWS, 0):
        got = sharding.extendible_shards(docs, limit=30_000, broadcast_rows=rows).toPandas()[k].sort_values(k).reset_index(drop=True)
        assert got.equals(want)


def test_shards_are_written(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), limit=50_000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_languages_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = language_id.language_id(docs, language_id.learn(docs.where(~out)), extra={"held_out": out}).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    model = language_id.learn(docs)
    rows = {str(r.doc_id): (r.lang_pred, r.score) for r in language_id.language_id(odd, model).collect()}
    assert rows["1"] == rows["2"] == rows["3"] == ("und", 0.0)
    assert language_id.language_id(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.language_id(odd, language_id.learn(docs.limit(0))).collect()} == {"und"}


def test_backoff_goes_from_words_to_characters():
    m = language_id.WordBackoff.fit({"a": Counter({"abc": 5, "abd": 5}), "b": Counter({"xyz": 5, "xyw": 5})})
    texts = ["abc", "abq", "qqx", "123 ...", None, "²", "½ ⅓ Ⅷ ①", "x²", "日本"]  # abq by its n-grams, qqx by a character
    assert m.predict(pa.array(texts))[0] == ["a", "a", "b", "und", "und", "und", "und", "b", "a"]


def test_words_are_learned_in_the_case_in_which_they_are_judged(spark):
    rows = spark.createDataFrame([("ΛΌΓΟΣ ΛΌΓΟΣ", "el"), ("ПРИВЕТ İSTANBUL", "ru")], "text string, lang string")
    model = language_id.learn(rows)
    for text, lang in (("ΛΌΓΟΣ", "el"), ("ΛΌΓΟσ", "el"), ("привет", "ru"), ("İSTANBUL", "ru")):
        languages, scores = model.predict(pa.array([text]))
        assert languages[0] == lang and scores[0] > 0.5
    assert "λόγοσ" in list(model.state[1]) and "λόγος" not in list(model.state[1])


def test_the_sample_is_that_of_the_smallest_hashes(spark):
    rows = [(f"text {k % 700} of many {'long ' * (k % 7)}", "en" if k % 5 else "fr") for k in range(2000)] + [("x", None), (None, "en")]
    d = spark.createDataFrame(rows, "text string, lang string")
    hashed = {(r.lang, r.text): r.h for r in d.dropna().withColumn("h", F.xxhash64("text")).collect()}
    for most, limit in ((1, 10**9), (100, 10**9), (10**6, 10**9), (100, 800)):
        want = set()
        for lang in ("en", "fr"):
            held = 0
            for h, text in sorted((h, t) for (x, t), h in hashed.items() if x == lang)[:most]:
                if held >= limit:
                    break
                held += len(text)
                want.add((text, lang))
        got = [tuple(r) for r in language_id.sample(d, "text", "lang", most, limit).collect()]
        assert len(got) == len(want) and set(got) == want
    assert language_id.sample(d.where("lang is null"), "text", "lang", 10, 10).count() == 0


def test_scores_equal_plain_rescoring(spark):
    """Counts, backoff and sums said plainly, over texts of all lengths; long texts are learned from too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect() if r.text and r.lang]
    long = ("zaubern " * 30_000, "de")
    d = spark.createDataFrame([*rows[:60], long], "text string, lang string")
    counts = {}
    for t, x in set(d.toPandas().itertuples(index=False, name=None)):
        counts.setdefault(x, Counter()).update("".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split())
    assert counts["de"]["zaubern"] >= 30_000
    langs = sorted(counts)
    pieces = [{x: Counter() for x in langs} for _ in range(6)]
    for x in langs:
        pieces[0][x] = counts[x]
        for w, n in counts[x].items():
            for k in range(1, 6):
                for i in range(len(w) + 3 - k):
                    pieces[k][x][f"^{w}$"[i : i + k]] += n
    known = [set().union(*p.values()) for p in pieces]
    total = [{x: sum(p[x].values()) + 0.5 * len(known[k]) for x in langs} for k, p in enumerate(pieces)]

    def log(k, item):
        return np.array([np.log((pieces[k][x][item] + 0.5) / total[k][x]) for x in langs])

    def word(w):
        if w in known[0]:
            return log(0, w)
        s, i, out = f"^{w}$", 0, np.zeros(len(langs))
        while i < len(s):
            k = next((k for k in range(5, 0, -1) if i + k <= len(s) and s[i : i + k] in known[k]), 0)
            out = out + log(k, s[i : i + k]) if k else out
            i += max(k, 1)
        return out

    model = language_id.learn(d)
    texts = [t for t, _ in rows[60:160]] + ["Ünïcode ’quotes’ ½ naïve×naïve", "", "日本語 zaubern", "Ⅷ"]
    sums, n = model.sums(pa.array(texts))
    for t, got, m in zip(texts, sums, n, strict=True):
        words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower()).split()
        assert m == len(words)
        assert np.allclose(got, sum((word(w) for w in words), np.zeros(len(langs))))
