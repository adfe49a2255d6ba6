"""Operator 12: how sources of a language differ in the terms that they use.

Whole texts are cut into terms by array operations and counted, per batch, by source and term; Spark sums the counts. A
language keeps the terms of at least MIN_DOCS of its documents. A source's share of a term is 1 + floor(10^9 (count + 5) /
(N + 5 V)), and two sources differ by the sum of the differences of their shares over all kept terms of the language.

That sum is a submatrix of pairs at a time: sources are numbered and cut into blocks of BLOCK_SOURCES, and a task is a pair
of blocks. A source's counts are packed into one vector per chunk of the vocabulary (a chunk is the terms of equal hash
modulo the number of chunks, about CHUNK_TERMS of them), each vector is copied to every task of its block, and a task reads
chunk after chunk, in order, adding to its submatrix; it holds the vectors of one chunk at most. Terms that none of a task's
sources has in a chunk are added in closed form at the end. Terms are 64-bit hashes in vectors; the seed of the hash is the
first under which no two kept terms of a language meet, so that every sum is exact.

Defined results: a null text, language or source is ''; a source without a kept term, and one of a language that keeps none,
has pairs too; an empty table gives no rows. A text must fit a task, as must the terms of CHUNK_BYTES of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, table
from .words import hash_ranges, runs, text_bytes

MIN_DOCS = 30
PRIOR = 5
SCALE_ROOT = 1000  # shares are in units of its third power
TOP_TERMS = 50
BLOCK_SOURCES = 16
CHUNK_TERMS = 4096
CHUNK_BYTES = 4 << 20
BROADCAST_ROWS = 200_000  # of sources or languages

INSIDE = np.zeros(256, dtype=bool)  # bytes of terms
INSIDE[np.r_[0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 0x20


def count_batch(groups: pa.Table) -> pa.Table:
    """lang, source, term, n (occurrences), df (texts) of the texts of a table (lang, source, text)."""
    data, offsets = text_bytes(groups["text"].combine_chunks())
    data = TO_LOWER[data]
    starts, ends, per_row = runs(INSIDE[data], offsets)
    _, first, term = np.unique(hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
    many = max(len(first), 1)
    in_text, times = np.unique(np.repeat(np.arange(len(groups)), per_row) * many + term, return_counts=True)
    langs, sources = (groups[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    kinds = max(len(sources.dictionary), 1)
    group = langs.indices.to_numpy().astype(np.int64) * kinds + sources.indices.to_numpy()
    cells, at = np.unique(group[in_text // many] * many + in_text % many, return_inverse=True)
    n = np.bincount(at, weights=times, minlength=len(cells)).astype(np.int64)  # whole numbers far below 2 ** 53
    group, term = cells // many, cells % many
    names = pa.array([data[s:e].tobytes() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary()).view(pa.string())
    return pa.table({"lang": langs.dictionary.take(pa.array(group // kinds)), "source": sources.dictionary.take(pa.array(group % kinds)), "term": names.take(pa.array(term)), "n": n, "df": np.bincount(at, minlength=len(cells))})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES - size, side="right")))
            held.append(b.slice(at, upto - at))
            size += int(lengths[at:upto].sum())
            at = upto
            if size >= CHUNK_BYTES or at < b.num_rows:
                yield from count_batch(pa.Table.from_batches(held)).to_batches()
                held, size = [], 0
    if held:
        yield from count_batch(pa.Table.from_batches(held)).to_batches()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), three decimal digits at a time: no product leaves 64 bits."""
    whole = F.greatest(total + PRIOR * terms, F.lit(1).cast("long"))
    left, out = n + PRIOR, F.lit(0).cast("long")
    for _ in range(3):
        left = left * SCALE_ROOT
        out = out * SCALE_ROOT + F.call_function("div", left, whole)
        left = left % whole
    return out + 1


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """share() of counts, row by row: whole has each row's total + 5 terms."""
    left, out = n + PRIOR, np.zeros(n.shape, dtype=np.int64)
    for _ in range(3):
        digit, left = np.divmod(left * SCALE_ROOT, whole[:, None])
        out = out * SCALE_ROOT + digit
    return out + 1


class Tile:
    """The submatrix of the pairs of two blocks of sources, over chunk after chunk of the vocabulary."""

    def __init__(self, lang: str, one_block: bool) -> None:
        self.lang, self.one_block = lang, one_block
        self.names: list[str] = []
        self.side: list[int] = []
        self.total: list[int] = []
        self.at: dict[int, int] = {}
        self.terms, self.seen = 0, 0
        self.chunk: int | None = None
        self.vectors: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.sums: np.ndarray | None = None

    def source(self, number: int, name: str, side: int, total: int, terms: int) -> None:
        self.at[number] = len(self.names)
        self.names.append(name)
        self.side.append(side)
        self.total.append(total)
        self.terms = terms

    def ready(self) -> None:
        """Called once all sources are known."""
        side = np.array(self.side)
        self.rows = np.flatnonzero(side == 0)
        self.columns = self.rows if self.one_block else np.flatnonzero(side == 1)
        self.whole = np.maximum(np.array(self.total, dtype=np.int64) + PRIOR * self.terms, 1)
        self.sums = np.zeros((len(self.rows), len(self.columns)), dtype=np.int64)

    def vector(self, chunk: int, number: int, terms: np.ndarray, counts: np.ndarray) -> None:
        if chunk != self.chunk:
            self.close()
            self.chunk = chunk
        self.vectors.append((self.at[number], terms, counts))

    def close(self) -> None:
        """Adds the chunk that is at hand to the submatrix."""
        if self.sums is None:
            self.ready()
        if self.vectors:
            axis, place = np.unique(np.concatenate([t for _, t, _ in self.vectors]), return_inverse=True)
            n = np.zeros((len(self.names), len(axis)), dtype=np.int64)
            n[np.repeat([k for k, _, _ in self.vectors], [len(t) for _, t, _ in self.vectors]), place] = np.concatenate([c for _, _, c in self.vectors])
            self._add(shares(n, self.whole), 1)
            self.seen += len(axis)
        self.vectors = []

    def _add(self, p: np.ndarray, times: int) -> None:
        for k, row in enumerate(self.rows):
            self.sums[k] += times * np.abs(p[self.columns] - p[row]).sum(axis=1)

    def result(self) -> pa.RecordBatch:
        """lang, source, item, value of every pair of different sources, both ways."""
        self.close()
        self._add(shares(np.zeros((len(self.names), 1), dtype=np.int64), self.whole), self.terms - self.seen)
        name = np.array(self.names, dtype=object)
        a, b = (x.ravel() for x in np.meshgrid(self.rows, self.columns, indexing="ij"))
        v = self.sums.ravel()
        if self.one_block:
            a, b, v = a[keep := a != b], b[keep], v[keep]
        else:
            a, b, v = np.append(a, b), np.append(b, a), np.append(v, v)
        return pa.record_batch({"lang": pa.array([self.lang] * len(a), pa.string()), "source": pa.array(name[a], pa.string()), "item": pa.array(name[b], pa.string()), "value": pa.array(v, pa.int64())})


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by tile; in each, the sources first (chunk -1), then vectors by chunk."""
    tile, key = None, None
    for b in batches:
        c = {name: b.column(name) for name in b.schema.names}
        for r in range(b.num_rows):
            lang, bi, bj, chunk = (c[k][r].as_py() for k in ("lang", "bi", "bj", "chunk"))
            if (lang, bi, bj) != key:
                if tile:
                    yield tile.result()
                key, tile = (lang, bi, bj), Tile(lang, bi == bj)
            if chunk < 0:
                tile.source(c["number"][r].as_py(), c["source"][r].as_py(), c["side"][r].as_py(), c["total"][r].as_py(), c["terms"][r].as_py())
                continue
            tile.vector(chunk, c["number"][r].as_py(), c["at"][r].values.to_numpy(), c["n"][r].values.to_numpy())
    if tile:
        yield tile.result()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def kept_counts(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """lang, source, term, n, n_lang (in the whole language), lead (one row a term) of kept terms; and lang, source, number, total, lang_total, terms of all sources."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(blank("lang"), blank("source"), F.col("text").cast("string").alias("text"))
    counts = in_arrow(texts, _counted, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = W.partitionBy("lang", "term")  # a row for each source at most
    marked = counts.select("*", F.sum("df").over(term).alias("docs"), F.sum("n").over(term).alias("n_lang"), (F.row_number().over(term.orderBy("source")) == 1).alias("lead"))
    kept = scratch.keep(marked.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", "lead"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("lead"), 1)).alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    sources = texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    return kept, scratch.keep(sources.select("lang", "source", number.cast("long").alias("number"), zero("total"), zero("lang_total"), zero("terms")))


def hash_seed(kept: DataFrame) -> int:
    """The first seed under which no two terms of a language share a hash."""
    terms, seed = kept.where("lead").select("lang", "term"), 0
    while not terms.groupBy("lang", F.xxhash64("term", F.lit(seed)).alias("h")).count().where("count > 1").isEmpty():
        seed += 1
    return seed


def pair_sums(kept: DataFrame, sources: DataFrame, block: int = BLOCK_SOURCES, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a language."""
    seed = hash_seed(kept)
    chunks = F.greatest(F.ceil(F.col("terms") / chunk_terms), F.lit(1))
    blocks = F.ceil(F.count("*").over(W.partitionBy("lang")) / block).cast("long")
    placed = sources.select("*", F.expr(f"number div {block}").alias("own"), blocks.alias("blocks"))
    h = F.xxhash64("term", F.lit(seed))
    numbered = kept.join(_small(placed.select("lang", "source", "number", "own", "blocks", "terms")), ["lang", "source"])
    packed = numbered.groupBy("lang", "number", "own", "blocks", F.pmod(h, chunks).cast("long").alias("chunk")).agg(F.collect_list(F.struct(h.alias("h"), "n")).alias("v"))  # about chunk_terms items at most
    none = F.lit(None)
    vectors = packed.select("lang", "number", "own", "blocks", "chunk", F.col("v.h").alias("at"), F.col("v.n").alias("n"), none.cast("string").alias("source"), none.cast("long").alias("total"), none.cast("long").alias("terms"))
    heads = placed.select("lang", "number", "own", "blocks", F.lit(-1).cast("long").alias("chunk"), none.cast("array<long>").alias("at"), none.cast("array<long>").alias("n"), "source", "total", "terms")
    copies = vectors.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiled = copies.select("lang", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "chunk", (F.col("own") > F.col("other")).cast("int").alias("side"), "number", "source", "total", "terms", "at", "n")
    return in_arrow(tiled.repartition("lang", "bi", "bj").sortWithinPartitions("lang", "bi", "bj", "chunk", "number"), _tiles, "lang string, source string, item string, value long")


def over_used(kept: DataFrame, sources: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source uses most beyond its language."""
    met = kept.join(_small(sources.drop("number")), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    over = met.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.withColumn("rank", rank).where(F.col("rank") <= top)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK_SOURCES, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept, sources = kept_counts(docs, Scratch(docs.sparkSession), min_docs)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_sums(kept, sources, block, chunk_terms).withColumn("rank", rank)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(over_used(kept, sources, top), "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def oracle(min_docs: int = MIN_DOCS) -> str:
    p = lambda n, total: f"(1 + (1000000000::HUGEINT * ({n} + {PRIOR})) // ({total} + {PRIOR} * terms))::BIGINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {min_docs}),
l AS (SELECT lang, count(*) AS terms, sum(n_lang) AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(l.terms, 0) AS terms, coalesce(l.lang_total, 0) AS lang_total, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p('coalesce(c.n, 0)', 'g.total')} AS p, {p('k.n_lang', 'g.lang_total')} AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, (SELECT coalesce(sum(abs(x.p - y.p)), 0)::BIGINT FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""


ORACLE = oracle()
