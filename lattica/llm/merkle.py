"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

A row is a leaf, leaves of a group are ordered by id, and runs of FANOUT nodes become their digest until one is left, the
group's subroot; subroots, ordered by group, become the root likewise. Each leaf gets its proof: at every level, what stands
before and after it in its run.

Rows are numbered within their groups by a range shuffle and the sizes of its parts. Aligned blocks of FANOUT ** BLOCK_LEVELS
nodes are then walked in postorder, each in one task: the walk returns the digest of a subtree and, as it unwinds, appends
the siblings to the leaves that the subtree holds. The roots of blocks are the nodes of the next, much smaller walk, until
one is left. On the way back each block is walked again, meets the one path from its root to the top, and gives its leaves
whole proofs. So only digests are shuffled, and a group of any size, a third of all rows or more, is many blocks.

Defined results: any null column is `-`; a null group is a group of its own, the first; a null id comes first in its group;
rows that share an id are ordered by their digests, and equal rows have equal leaves and a place each; a lone leaf is its
group's subroot, a lone subroot the root, and a proof without siblings is empty; an empty table gives no rows. A row is
hashed whole, so it must fit a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

FANOUT = 8
BLOCK_LEVELS = 3
BROADCAST_ROWS = 200_000  # of three numbers and a group name
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*columns: Column) -> Column:
    """Of the columns, each `-` if null, else its UTF-8 length, `:` and itself."""
    own = [c.cast("string") for c in columns]
    return digest(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in own))


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while FANOUT**h < n:
        h += 1
    return h


def walk(leaves: Sequence[str], levels: int, paths: Sequence[list[tuple[str, str]]] | None = None) -> str:
    """The digest of the subtree of so many levels over the leaves; each leaf's path gets (before, after) of every level, lowest first."""

    def visit(lo: int, level: int) -> str:
        if not level:
            return leaves[lo]
        step = FANOUT ** (level - 1)
        starts = range(lo, min(lo + FANOUT * step, len(leaves)), step)
        below = [visit(x, level - 1) for x in starts]
        if paths is not None:
            for k, x in enumerate(starts):
                beside = "".join(below[:k]), "".join(below[k + 1 :])
                for leaf in range(x, min(x + step, len(leaves))):
                    paths[leaf].append(beside)
        return hashlib.sha256("".join(below).encode()).hexdigest()

    return visit(0, levels)


def numbered(df: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """df, which has the group g (never null), with n, the size of its group, and pos, its place there from 0 by `order`, nulls first."""
    spark = df.sparkSession
    by = [F.col("g"), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())  # so that equal rows are dealt to several tasks
    ranged = tied.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).drop("_tie")
    placed = scratch.keep(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    runs = placed.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = W.partitionBy("g")
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = scratch.keep(runs.select("g", "_part", (F.col("_first") - F.coalesce(before, F.lit(0))).alias("_base"), F.sum("_n").over(group).alias("n")))  # a row for each task and group at most
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs
    return placed.join(runs, ["g", "_part"]).withColumn("pos", F.col("_at") - F.col("_base")).drop("_part", "_at", "_base")


def block() -> Column:
    return F.expr(f"pos div {FANOUT**BLOCK_LEVELS}").alias("block")


def climb(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (g, pos 0, n 1, digest) of nodes (g, pos, n, digest), and the tables of nodes that each round walked."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t["n"][0].as_py()
        levels = min(BLOCK_LEVELS, height(n))
        made = walk(t["digest"].to_pylist(), levels)
        return pa.table({"g": [key[0].as_py()], "pos": [key[1].as_py()], "n": [math.ceil(n / FANOUT**levels)], "digest": [made]})

    rounds = []
    while True:
        rounds.append(nodes)
        nodes = scratch.keep(nodes.select("g", "pos", "n", "digest").groupBy("g", block()).applyInArrow(run, "g string, pos long, n long, digest string"))
        if nodes.where("n > 1").isEmpty():
            return nodes, rounds


def _with_paths(names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, top: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        paths: list[list[tuple[str, str]]] = [[] for _ in range(len(t))]
        walk(t["digest"].to_pylist(), min(BLOCK_LEVELS, height(t["n"][0].as_py())), paths)
        out = t.select(names).append_column("subroot", pa.array([top["subroot"][0].as_py()] * len(t), pa.string()))
        for side, c in enumerate(("before", "after")):
            rest = top[c][0].as_py()
            out = out.append_column(c, pa.array([[p[side] for p in path] + rest for path in paths], pa.list_(pa.string())))
        return out

    return run


def descend(rounds: list[DataFrame], tops: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the first round with their paths: tops has g, pos 0, subroot and the path from there, before and after."""
    upper = tops
    for k in range(len(rounds) - 1, -1, -1):
        carried = [f for f in rounds[k].schema.fields if f.name != "n"]
        names = [f.name for f in carried]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried) + ", subroot string, before array<string>, after array<string>"

        own = rounds[k].groupBy("g", block())
        above = upper.select("g", F.col("pos").alias("block"), "subroot", "before", "after").groupBy("g", "block")
        upper = own.cogroup(above).applyInArrow(_with_paths(names), schema)
        if k:
            upper = scratch.keep(upper)
    return upper


def manifest(df: DataFrame, columns: Sequence[str], id_col: str, group_col: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """group, id, pos, leaf, subroot, root and proof (before, after: arrays of joined siblings, lowest level first) of every row.

    columns: what a leaf covers, in order. carry: further columns, by name, to go along.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    carry = carry or {}
    own = df.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"), F.col(id_col).alias("id"), leaf_digest(*(F.col(c) for c in columns)).alias("digest"), *(v.alias(k) for k, v in carry.items()))
    leaves = numbered(scratch.keep(own), ["id", "digest"], scratch)
    subroots, rounds = climb(leaves, scratch)
    groups = numbered(scratch.keep(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")), ["of"], scratch)
    roots, group_rounds = climb(groups, scratch)
    top = roots.select("digest").first()
    none = F.array().cast("array<string>")
    group_paths = descend(group_rounds, roots.select("g", "pos", F.col("digest").alias("subroot"), none.alias("before"), none.alias("after")), scratch)
    tops = scratch.keep(group_paths.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "before", "after"))
    got = descend(rounds, tops, scratch)
    group = F.when(F.col("g") != "", F.substring("g", 2, 2**31 - 1))
    return got.select(group.alias("group"), "id", "pos", F.col("digest").alias("leaf"), "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"), "before", "after", *carry)


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.reduce(F.arrays_zip(before.alias("b"), after.alias("a")), leaf, lambda x, run: digest(run["b"], x, run["a"]))


def siblings(before: Column, after: Column) -> Column:
    """All siblings of a proof in one text."""
    return F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the crc32 of the id, a leaf with text in lower case is held against the proof; a null id is never such."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), ascii_lower(F.col("text"))))
    got = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"tampered": tampered})
    again = folded(F.coalesce("tampered", "leaf"), F.col("before"), F.col("after"))
    rows = got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("before"), F.col("after")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, source: str, key: str, count: int) -> str:
    """CTEs name0 .. nameK of (key, pos, digest, n): level by level, groups of one node unchanged."""
    out = [f"{name}0 AS ({source})"]
    for t in range(count):
        out.append(
            f"{name}{t + 1} AS (SELECT {key}, CASE WHEN n = 1 THEN 0 ELSE pos // {FANOUT} END AS pos, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{t} GROUP BY {key}, n, CASE WHEN n = 1 THEN 0 ELSE pos // {FANOUT} END)"
        )
        out.append(f"{name}s{t} AS (SELECT {key}, pos, n, digest, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY {key}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS before, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY {key}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS after FROM {name}{t})")
    return ", ".join(out)


DOC_LEVELS, LANG_LEVELS = 7, 3  # as deep as 2 million documents a language and 512 languages need


def _oracle() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"
    ctes = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS used FROM documents)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d)",
        _levels("l", "SELECT g, pos, leaf AS digest, n FROM o", "g", DOC_LEVELS),
        _levels("r", f"SELECT 0 AS z, row_number() OVER (ORDER BY g) - 1 AS pos, digest, count(*) OVER () AS n FROM l{DOC_LEVELS}", "z", LANG_LEVELS),
        f"u AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS gpos FROM l{DOC_LEVELS})",
    ]
    folded_sql, proof, joins = "o.used", [], []
    for name, depth, key, pos in (("l", DOC_LEVELS, "g", "o.pos"), ("r", LANG_LEVELS, "z", "u.gpos")):
        for t in range(depth):
            a = f"{name}a{t}"
            joins.append(f"LEFT JOIN {name}s{t} {a} ON {'o.g = ' + a + '.g AND ' if key == 'g' else ''}{a}.pos = {pos} // {FANOUT**t}")
            proof.append(f"coalesce({a}.before || {a}.after, '')")
    steps, last = [], "o.used"
    for name, depth in (("l", DOC_LEVELS), ("r", LANG_LEVELS)):
        for t in range(depth):
            steps.append((f"{name}a{t}", f"f{name}{t}"))
    inner = f"SELECT o.doc_id, o.leaf, u.subroot, (SELECT digest FROM r{LANG_LEVELS}) AS root, sha256({' || '.join(proof)}) AS proof_sha256, {last} AS f0, " + ", ".join(f"{a}.before AS b{k}, {a}.after AS c{k}" for k, (a, _) in enumerate(steps)) + f" FROM o JOIN u ON o.g = u.g {' '.join(joins)}"
    ctes.append(f"p0 AS ({inner})")
    for k in range(len(steps)):
        ctes.append(f"p{k + 1} AS (SELECT *, CASE WHEN b{k} IS NULL THEN f{k} ELSE sha256(b{k} || f{k} || c{k}) END AS f{k + 1} FROM p{k})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = root AS verified FROM p{len(steps)}"


ORACLE = _oracle()
