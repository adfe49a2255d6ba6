"""Operator 8: sharding by extendible hashing.

A document's key is a 60-bit hash: 40 bits of its id, then 20 bits of its text, which only matter where rows share an id.
The directory is indexed by leading bits of the key. A bucket over the byte limit splits on the next bit, and only such a
bucket, until every shard fits. Splits are found from sums of bytes by key prefix, some bits at a time; documents move
only as (id, key, bytes). The directory is a table, with a row per shard.

Defined results: null text has 0 bytes; a null id is the id "null"; a document over the limit has a shard of its own;
rows that are equal in id and text and together over the limit are dealt to pages of one bucket, each within the limit;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

BITS = 60
LIMIT_BYTES = 1 << 20
BROADCAST_ROWS = 500_000  # of 32 bytes each
SALTS = 16


def hash_bits(text: Column, hex_digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("long")


def shard_key(id_col: Column, text: Column) -> Column:
    return F.shiftleft(hash_bits(F.coalesce(id_col.cast("string"), F.lit("null")), 10), 20) + hash_bits(F.coalesce(text, F.lit("")), 5)


def prefix(key: Column, depth: Column | int) -> Column:
    return F.expr("0L") if isinstance(depth, int) and depth == 0 else F.call_function("shiftright", key, (F.lit(BITS) - depth).cast("int"))


def split_step(open_rows: DataFrame, depth: int, to: int, limit: int) -> DataFrame:
    """For each prefix of `to` bits: depth, bytes and rows of the first bucket above it that fits; null where none does."""
    low = cut(open_rows.groupBy(prefix(F.col("key"), to).alias("at")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
    levels = low.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(to)))).withColumn("prefix", F.call_function("shiftright", F.col("at"), (F.lit(to) - F.col("depth")).cast("int")))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    first = levels.select("at", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("at").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s"))
    return first.select("at", "s.depth", "s.prefix", "s.shard_bytes")


def _met(rows: DataFrame, leaf: DataFrame, count: int, broadcast_rows: int) -> DataFrame:
    """rows with the bucket of their prefix. Few buckets are broadcast; else a prefix that many rows share is dealt to SALTS tasks."""
    if count <= broadcast_rows:
        return rows.join(F.broadcast(leaf), "at", "left")
    salted = leaf.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int")).join(salted, ["at", "salt"], "left").drop("salt")


def extendible_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_bytes, depth, prefix, page, shard_bytes of every row of df; (depth, prefix, page) names a shard."""
    text = F.col(text_col).cast("string")
    rows = cut(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), shard_key(F.col(id_col), text).alias("key")))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth, done = 0, []
    step = max(1, min(24, math.ceil(math.log2(max(total / limit, 1))) + 3))
    open_rows = rows
    while True:
        to = min(depth + step, BITS)
        leaf = cut(split_step(open_rows, depth, to, limit))
        met = cut(_met(open_rows.withColumn("at", prefix(F.col("key"), to)), leaf, leaf.count(), broadcast_rows).drop("at"))
        done.append(met.where("depth is not null").select("doc_id", "n_bytes", "depth", "prefix", F.lit(0).alias("page"), "shard_bytes"))
        open_rows = met.where("depth is null").select("doc_id", "n_bytes", "key")
        depth, step = to, 6
        if not open_rows.limit(1).count():
            break
        if depth == BITS:
            done.append(_pages(open_rows, limit))
            break
    return reduce(DataFrame.union, done)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that share all bits, dealt to pages within the limit: numbered per group of rows, over all groups, by size."""
    dealt = cut(rows.withColumn("group", F.spark_partition_id()))
    by = ["key", "n_bytes"]
    counts = dealt.groupBy(*by, "group").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy(*by).orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("k", F.row_number().over(W.partitionBy(*by, "group").orderBy("doc_id")) - 1).join(counts.select(*by, "group", before.alias("before")), [*by, "group"])
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    paged = numbered.withColumn("k", F.floor((F.col("k") + F.col("before")) / each))
    # rows of different sizes under one key never share a page: the pages of a size follow those of the sizes before
    sizes = paged.groupBy(*by).agg((F.max("k") + 1).alias("pages"))
    offset = F.coalesce(F.sum("pages").over(W.partitionBy("key").orderBy("n_bytes").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    paged = paged.join(sizes.select(*by, offset.alias("offset")), by).withColumn("page", (F.col("k") + F.col("offset")).cast("int"))
    total = paged.groupBy("key", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return paged.join(total, ["key", "page"]).select("doc_id", "n_bytes", F.lit(BITS).alias("depth"), F.col("key").alias("prefix"), "page", "shard_bytes")


def directory(shards: DataFrame) -> DataFrame:
    """One row per shard of extendible_shards()'s result: depth, prefix, page, shard_bytes, shard_rows."""
    return shards.groupBy("depth", "prefix", "page", "shard_bytes").agg(F.count("*").alias("shard_rows"))


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> None:
    """The rows of df as Parquet, one folder per shard. Ids must name rows: rows that share an id go to each of its shards once."""
    of = extendible_shards(df, id_col, text_col, limit).select(F.col("doc_id").alias("_id"), F.format_string("%02d-%015x-%d", "depth", "prefix", "page").alias("shard")).distinct()
    df.join(of, F.col(id_col) == F.col("_id")).drop("_id").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 10))::BIGINT << 20) + ('0x' || substr(md5(coalesce(text, '')), 1, 5))::BIGINT AS key,
    row_number() OVER () AS r
  FROM documents),
l AS (SELECT d.*, g.depth, CASE WHEN g.depth = 0 THEN 0 ELSE key >> ({BITS} - g.depth)::BIGINT END AS prefix FROM d, (SELECT unnest(range({BITS + 1})) AS depth) g),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS b, count(*) OVER (PARTITION BY depth, prefix) AS n FROM l)
SELECT doc_id, n_bytes, depth::INTEGER AS depth, prefix::BIGINT AS prefix, 0::INTEGER AS page, b::BIGINT AS shard_bytes
FROM s WHERE b <= {LIMIT_BYTES} OR n = 1 QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1
"""
