"""Operator 7: approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of codewords, one of each full-dimensional codebook. Codebooks start as residual k-means and are
refined by least squares against beam-search codes, on a sample of at most `sample_rows` vectors (those of smallest hash).
Every vector is encoded by beam search, and the squared norm of its sum is stored, so that inner products and distances
come from a table of query-codeword products. The index stays where it is: blocks of queries, of bounded size, are broadcast
one after another, and each task reads its part of the index in cells of at most `code_block` rows. A cell scores its codes by table,
takes per query the best `rerank`, or the best `rerank_share` of the cell where that is more, and ranks these exactly by the
original vectors. A task hands on one list of `top` per query, and the tasks' lists are merged.

Defined results: null vectors, zero vectors, those with null or non-finite components, or without id take no part; vectors of
different lengths have no inner product, so each length is searched for itself; rows that share a vec_id count as one row,
with the least of their vectors; equal scores are ordered by vec_id; fewer than `top` candidates give a shorter list; a
single vector or an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, hash_sample, map_arrow, table

CODEBOOKS, CODEWORDS, BEAM = 8, 256, 4
SAMPLE_ROWS = 10_000
RERANK, RERANK_SHARE = 300, 0.1
QUERY_BLOCK, CODE_BLOCK = 16_384, 16_384


def nearest_codewords(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest_codewords(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) of least squared error found by a beam search, and the squared norms of the sums they stand for."""
    m, k, d = books.shape
    codes, norms = np.zeros((len(x), m), dtype=np.uint8), np.zeros(len(x))
    sizes = (books * books).sum(axis=2)
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        n = len(part)
        left = part[:, None, :]  # what is still to be coded, per beam
        error = (part * part).sum(axis=1)[:, None]
        path = np.zeros((n, 1, 0), dtype=np.uint8)
        for j in range(m):
            e = error[:, :, None] + sizes[j] - 2 * (left @ books[j].T)
            flat = e.reshape(n, -1)
            width = min(beam if j < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            source, word = best // k, best % k
            error = np.take_along_axis(flat, best, axis=1)
            left = np.take_along_axis(left, source[:, :, None], axis=1) - books[j][word]
            path = np.concatenate([np.take_along_axis(path, source[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        codes[a : a + n] = path[:, 0]
        whole = part - left[:, 0]
        norms[a : a + n] = (whole * whole).sum(axis=1)
    return codes, norms


def fit_books(x: np.ndarray, m: int = CODEBOOKS, k: int = CODEWORDS, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """Codebooks (m, k, d): residual k-means, then alternating beam-search codes and least-squares codewords."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    books, left = [], x.copy()
    for _ in range(m):
        c = k_means(left, k, 8, rng)
        books.append(c)
        left = left - c[nearest_codewords(left, c)]
    out = np.stack(books)
    for _ in range(rounds):
        codes, _ = encode(x, out)
        for j in range(m):  # each book against what the others leave
            rest = x - sum(out[i][codes[:, i]] for i in range(m) if i != j)
            n = np.bincount(codes[:, j], minlength=k)
            total = np.zeros_like(out[j])
            np.add.at(total, codes[:, j], rest)
            out[j][n > 0] = total[n > 0] / n[n > 0, None]
    return out


def search_cell(queries: np.ndarray, query_ids: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top: int, rerank: int, metric: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the ids and exact scores of its best in this cell. Rows are in the order of ids, so ties go to the smaller."""
    code = codes.astype(np.intp)
    for a in range(0, len(queries), 256):
        tables = np.einsum("qd,mkd->qmk", queries[a : a + 256], books)
        for q, own, lut in zip(queries[a : a + 256], query_ids[a : a + 256], tables, strict=True):
            guess = lut[0][code[:, 0]]
            for j in range(1, len(lut)):
                guess += lut[j][code[:, j]]
            if metric == "l2":
                guess = 2 * guess - norms
            n = min(rerank + 1, len(ids))
            if n < len(ids):
                edge = np.partition(guess, len(ids) - n)[len(ids) - n]
                above, level = np.flatnonzero(guess > edge), np.flatnonzero(guess == edge)
                take = np.sort(np.concatenate([above, level[: n - len(above)]]))
            else:
                take = np.arange(len(ids))
            take = take[ids[take] != own]
            v = vectors[take]
            # sums by row: a matrix product may give equal vectors different last bits, by where they stand
            exact = (v * q).sum(axis=1) if metric == "ip" else -((v - q) ** 2).sum(axis=1)
            order = np.argsort(-exact, kind="stable")[:top]
            yield int(own), ids[take[order]], exact[order]


class Lists:
    """The best found so far of each query: ids and scores, best first, ties to the smaller id; empty places have a score of minus infinity."""

    def __init__(self, queries: int, top: int) -> None:
        self.ids, self.scores = np.zeros((queries, top), dtype=np.int64), np.full((queries, top), -np.inf)

    def add(self, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> None:
        n, top = self.scores.shape
        ids, scores = np.zeros((n, top), dtype=np.int64), np.full((n, top), -np.inf)
        for k, (_, i, s) in enumerate(found):
            ids[k, : len(i)], scores[k, : len(i)] = i, s
        ids, scores = np.concatenate([self.ids, ids], axis=1), np.concatenate([self.scores, scores], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, :top]
        self.ids, self.scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part. Only ids are shuffled, but for rows that share one."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    repeated = cut(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, "vec_id", "left_anti").union(rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def _floats(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def additive_search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, metric: str = "ip", codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rerank: int = RERANK, rerank_share: float = RERANK_SHARE, sample_rows: int = SAMPLE_ROWS, query_block: int = QUERY_BLOCK, code_block: int = CODE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` nearest found for each row where is_query (a column of vec_id) holds.

    metric "ip": largest inner product; "l2": least Euclidean distance, score is minus its square.
    """
    spark = df.sparkSession
    rows = cut(usable(df, id_col, vec_col))
    folder = f"{checkpoint_dir(spark)}/ann-{uuid.uuid4().hex}"
    schema = "query_id long, vec_id long, score double"
    spark.createDataFrame([], schema).write.parquet(folder)
    for (length,) in sorted(rows.select(F.size("v")).distinct().collect()):
        _search_length(rows.where(F.size("v") == length), is_query, folder, schema, top, metric, codebooks, codewords, rerank, rerank_share, sample_rows, query_block, code_block)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return spark.read.schema(schema).parquet(folder).withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _search_length(rows: DataFrame, is_query, folder: str, schema: str, top: int, metric: str, codebooks: int, codewords: int, rerank: int, rerank_share: float, sample_rows: int, query_block: int, code_block: int) -> None:
    """Adds the lists of vectors of one length to the folder."""
    spark = rows.sparkSession
    sample = hash_sample(rows, F.col("vec_id"), sample_rows).toPandas().sort_values("vec_id")
    books = spark.sparkContext.broadcast(fit_books(np.array(sample.v.tolist()), codebooks, codewords))

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(b.column(1).to_pylist(), dtype=np.float64)
        c, n = encode(x, books.value)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in c], pa.binary()), pa.array(n), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "code", "norm", "vector"])

    index = cut(map_arrow(rows, code, "vec_id long, code binary, norm double, vector binary"))
    asked = index.where(is_query(F.col("vec_id"))).select("vec_id", "vector")
    blocks = max(1, -(-asked.count() // query_block))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    for k in range(blocks):  # a block is of bounded size; the index is read anew for each and never moved
        own = asked.where(block == k).toPandas().sort_values("vec_id")
        if not len(own):
            continue
        queries = spark.sparkContext.broadcast((own.vec_id.to_numpy(), np.frombuffer(b"".join(own.vector), dtype=np.float64).reshape(len(own), -1)))

        def search(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            query_ids, vectors = queries.value
            lists, held = Lists(len(query_ids), top), []

            def cell() -> None:
                got = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                ids = got.column("vec_id").to_numpy()
                by = np.argsort(ids)
                codes, own = (_floats(got.column(c).combine_chunks(), kind)[by] for c, kind in (("code", np.uint8), ("vector", np.float64)))
                best = max(rerank, math.ceil(rerank_share * len(ids)))
                lists.add(search_cell(vectors, query_ids, books.value, codes, got.column("norm").to_numpy()[by], own, ids[by], top, best, metric))

            for b in batches:
                for at in range(0, b.num_rows, code_block):
                    part = b.slice(at, code_block)
                    if held and sum(x.num_rows for x in held) + part.num_rows > code_block:
                        cell()
                    held.append(part)
            if held:
                cell()
            q, place = np.nonzero(lists.scores > -np.inf)
            for at in range(0, len(q), 100_000):
                i, j = q[at : at + 100_000], place[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i]), pa.array(lists.ids[i, j]), pa.array(lists.scores[i, j])], names=["query_id", "vec_id", "score"])

        index.mapInArrow(search, schema).write.mode("append").parquet(folder)
        queries.unpersist()


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
