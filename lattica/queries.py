"""Queries over the test tables, one or more per operator, and the SQL that gives the same rows.

Matrices are derived from the tables: customer x part by quantity, nation x nation trade, and chains over customers. Keys
start at 0 in the tables, indices at 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lcg
from .matrix import MatrixType, SparseMatrix
from .operators import convert, direct, eigs, scaling, vectors
from .operators.cutting import cut
from .operators.lsmr import LsmrOptions, lsmr
from .plans import symbolic
from .sources import plot, random_matrix, rutherford_boeing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer, part and quantity of every line item."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") + 1).cast("long").alias("i"), (F.col("l_partkey") + 1).cast("long").alias("j"), F.col("l_quantity").cast("double").alias("v"))


TRIPLES = "SELECT (o_custkey + 1)::BIGINT AS i, (l_partkey + 1)::BIGINT AS j, l_quantity::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
MATRIX = f"SELECT i, j, sum(v) AS v FROM ({TRIPLES}) GROUP BY i, j"


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    m = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return int(m) + 1, int(n) + 1


def customer_part(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    m, n = shape(spark, sf_dir)
    return SparseMatrix(convert.canonical(triples(spark, sf_dir), m, n, MatrixType.REAL_RECT), m, n, MatrixType.REAL_RECT)


def trade(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Quantity by nation of the customer and of the supplier, 25 x 25."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    rows = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    t = rows.groupBy((F.col("c_nationkey") + 1).cast("long").alias("i"), (F.col("s_nationkey") + 1).cast("long").alias("j")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))
    return SparseMatrix(cut(t), 25, 25, MatrixType.REAL_UNSYM)


TRADE = "SELECT (c_nationkey + 1)::BIGINT AS i, (s_nationkey + 1)::BIGINT AS j, sum(l_quantity::DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
FOLDED = f"SELECT greatest(i, j) AS i, least(i, j) AS j, sum(v) AS v FROM ({TRADE}) GROUP BY 1, 2"


def folded(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Trade in both directions as one symmetric matrix."""
    t = trade(spark, sf_dir)
    return SparseMatrix(cut(convert.canonical(t.entries, 25, 25, MatrixType.REAL_SYM_INDEF)), 25, 25, MatrixType.REAL_SYM_INDEF)


def chain(spark: SparkSession, sf_dir: str, diagonal: int) -> SparseMatrix:
    """Tridiagonal over customers: -1 beside a diagonal of `diagonal` plus the customer's nation."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("long").alias("i"), F.col("c_nationkey").alias("k"))
    n = int(c.agg(F.max("i")).first()[0])
    entries = c.select("i", F.col("i").alias("j"), (diagonal + F.col("k")).cast("double").alias("v")).unionByName(c.where("i > 1").select("i", (F.col("i") - 1).alias("j"), F.lit(-1.0).alias("v")))
    return SparseMatrix(cut(entries), n, n, MatrixType.REAL_SYM_PSDEF)


def tidy(x, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


@query("coo_to_csc", MATRIX)
def coo_to_csc(spark, sf_dir):
    return customer_part(spark, sf_dir).entries


@query("csc_ptr", f"WITH c AS (SELECT j, count(*) AS n FROM ({MATRIX}) GROUP BY j), k AS (SELECT (p_partkey + 1)::BIGINT AS j FROM part UNION ALL SELECT max(p_partkey) + 2 FROM part) SELECT k.j, (1 + coalesce(sum(coalesce(n, 0)) OVER (ORDER BY k.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ptr FROM k LEFT JOIN c ON k.j = c.j")
def csc_ptr(spark, sf_dir):
    a = customer_part(spark, sf_dir)
    return convert.column_pointers(a.entries, a.n)


@query("csc_positions", f"SELECT i, j, v, row_number() OVER (ORDER BY j, i)::BIGINT AS pos FROM ({MATRIX})")
def csc_positions(spark, sf_dir):
    a = customer_part(spark, sf_dir)
    return convert.positions(a.entries, a.n).withColumn("pos", F.col("pos").cast("long"))


@query("clean_counts", f"WITH t AS ({TRIPLES}), s AS (SELECT *, i <= 1000 AND j <= 1000 AND i >= j AS good FROM t) SELECT count(*)::BIGINT AS n_in, (count(*) FILTER (NOT good))::BIGINT AS out_of_range, ((count(*) FILTER (good)) - (SELECT count(*) FROM (SELECT DISTINCT i, j FROM s WHERE good)))::BIGINT AS duplicates, (SELECT count(*) FROM (SELECT DISTINCT i, j FROM s WHERE good))::BIGINT AS entries, (SELECT count(*) FROM (SELECT DISTINCT i, j FROM s WHERE good AND i = j))::BIGINT AS diagonals FROM s")
def clean_counts(spark, sf_dir):
    return convert.counters(triples(spark, sf_dir), 1000, 1000, MatrixType.REAL_SYM_INDEF, mirror=False)


@query("half_to_full", f"WITH f AS ({FOLDED}) SELECT i, j, v FROM f UNION ALL SELECT j, i, v FROM f WHERE i <> j")
def half_to_full(spark, sf_dir):
    return convert.half_to_full(folded(spark, sf_dir).entries)


@query("skew_conversion", f"SELECT greatest(i, j) AS i, least(i, j) AS j, sum(CASE WHEN i < j THEN -v ELSE v END) + 0.0 AS v FROM ({TRADE}) WHERE i <> j GROUP BY 1, 2")
def skew_conversion(spark, sf_dir):
    return convert.canonical(trade(spark, sf_dir).entries, 25, 25, MatrixType.REAL_SKEW).withColumn("v", F.col("v") + 0.0)


@query("missing_diagonal", f"WITH m AS ({MATRIX}), n AS (SELECT least((SELECT max(c_custkey) + 1 FROM customer), (SELECT max(p_partkey) + 1 FROM part)) AS k) SELECT i, j, v FROM m UNION ALL SELECT g AS i, g AS j, 0.0::DOUBLE AS v FROM (SELECT unnest(range(1, (SELECT k + 1 FROM n)::BIGINT)) AS g) WHERE g NOT IN (SELECT i FROM m WHERE i = j)")
def missing_diagonal(spark, sf_dir):
    a = customer_part(spark, sf_dir)
    return convert.add_missing_diagonal(a.entries, a.m, a.n)


@query("apply_map", f"SELECT pos, v FROM (SELECT row_number() OVER (ORDER BY j, i)::BIGINT AS pos, sum(v) AS v FROM ({TRIPLES}) GROUP BY i, j)")
def apply_map(spark, sf_dir):
    m, n = shape(spark, sf_dir)
    rows = cut(triples(spark, sf_dir).withColumn("pos", F.monotonically_increasing_id()))
    mapping = convert.conversion_map(rows, m, n, MatrixType.REAL_RECT)
    return convert.apply_conversion_map(rows.select("pos", "v"), mapping).withColumn("pos", F.col("pos").cast("long"))


@query("verify_flags", f"WITH t AS (SELECT i, j, row_number() OVER (PARTITION BY j ORDER BY i) AS pos FROM ({TRIPLES})) SELECT -14 AS flag, (count(*) FILTER (i < j))::BIGINT AS n FROM t UNION ALL SELECT -9, (count(*) FILTER (i >= j AND i = l))::BIGINT FROM (SELECT *, lag(i) OVER (PARTITION BY j ORDER BY pos) AS l FROM t)")
def verify_flags(spark, sf_dir):
    from pyspark.sql import Window as W

    m, n = shape(spark, sf_dir)
    rows = triples(spark, sf_dir).withColumn("pos", F.row_number().over(W.partitionBy("j").orderBy("i")).cast("long"))
    return convert.violations(rows, m, n, MatrixType.REAL_SYM_INDEF).groupBy("flag").agg(F.count("*").alias("n"))


STATES = f"WITH RECURSIVE r(k, state) AS (SELECT 1::BIGINT, ({lcg.MULTIPLIER}::BIGINT * {lcg.SEED} + {lcg.INCREMENT}) % {lcg.MODULUS} UNION ALL SELECT k + 1, ({lcg.MULTIPLIER}::BIGINT * state + {lcg.INCREMENT}) % {lcg.MODULUS} FROM r WHERE k < 2000)"


@query("random_stream", f"{STATES} SELECT k, state, 1 - 2 * (state / {float(lcg.MODULUS)}) AS real, state / {float(lcg.MODULUS)} AS positive, (floor(state * (100 / {float(lcg.MODULUS)})) + 1)::BIGINT AS integer, floor(state * (2 / {float(lcg.MODULUS)})) = 0 AS logical FROM r")
def random_stream(spark, sf_dir):
    s = F.col("state")
    return lcg.stream(spark, 2000).select("k", "state", lcg.as_real(s).alias("real"), lcg.as_real(s, True).alias("positive"), lcg.as_integer(s, 100).alias("integer"), lcg.as_logical(s).alias("logical"))


@query("random_chi_square", f"{STATES}, b AS (SELECT count(*) AS n FROM r GROUP BY floor(state * (20 / {float(lcg.MODULUS)}))) SELECT sum(n)::BIGINT AS rows, round(sum((n - 100) * (n - 100) / 100), 6) AS statistic FROM b")
def random_chi_square(spark, sf_dir):
    bins = lcg.stream(spark, 2000).select(lcg.as_integer(F.col("state"), 20).alias("bin"))
    return lcg.chi_square(bins, "bin", 20).withColumn("statistic", F.round("statistic", 6))


@query("random_matrix", "SELECT 500::BIGINT AS n, 3000::BIGINT AS entries, 500::BIGINT AS diagonals, 0::BIGINT AS upper, 0::BIGINT AS repeated, 0::BIGINT AS out_of_range")
def random_matrix_counts(spark, sf_dir):
    a = random_matrix.random_matrix(spark, lcg.RandomState(), MatrixType.REAL_SYM_INDEF, 500, 500, 3000, nonsingular=True, sort=True)
    count = lambda c: F.count(F.when(c, 1))
    return a.entries.agg(F.lit(500).cast("long").alias("n"), F.count("*").alias("entries"), count(F.col("i") == F.col("j")).alias("diagonals"), count(F.col("i") < F.col("j")).alias("upper"), (F.count("*") - F.countDistinct("i", "j")).alias("repeated"), count(~convert.in_range(500, 500)).alias("out_of_range"))


@query("spmv", f"SELECT i, sum(v * (j % 5)) AS x FROM ({MATRIX}) GROUP BY i")
def spmv(spark, sf_dir):
    a = customer_part(spark, sf_dir)
    return vectors.multiply(a, spark.range(1, a.n + 1).select(F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("x")))


@query("spmv_transpose", f"SELECT j AS i, sum(v * (i % 5)) AS x FROM ({MATRIX}) GROUP BY j")
def spmv_transpose(spark, sf_dir):
    a = customer_part(spark, sf_dir)
    return vectors.multiply_transposed(a, spark.range(1, a.m + 1).select(F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("x")))


@query("spmv_symmetric", f"WITH f AS ({FOLDED}), g AS (SELECT i, j, v FROM f UNION ALL SELECT j, i, v FROM f WHERE i <> j) SELECT i, sum(v * (j % 5)) AS x FROM g GROUP BY i")
def spmv_symmetric(spark, sf_dir):
    return vectors.multiply(folded(spark, sf_dir), spark.range(1, 26).select(F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("x")))


@query("row_norms", f"SELECT i, max(abs(v)) AS max_abs, sum(abs(v)) AS sum_abs, round(sqrt(sum(v * v)), 6) AS norm2 FROM ({MATRIX}) GROUP BY i")
def row_norms(spark, sf_dir):
    return vectors.row_norms(customer_part(spark, sf_dir).entries).withColumn("norm2", F.round("norm2", 6))


@query("gram", f"WITH m AS ({TRADE}) SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i WHERE a.j >= b.j GROUP BY 1, 2")
def gram(spark, sf_dir):
    return vectors.gram(trade(spark, sf_dir).entries, 25)


def _equilibrated(k: int) -> str:
    steps = [f"f AS (SELECT i, j, abs(v) AS v FROM ({FOLDED}) WHERE v <> 0), g AS (SELECT i, j, v FROM f UNION ALL SELECT j, i, v FROM f WHERE i <> j), s0 AS (SELECT (n_nationkey + 1)::BIGINT AS i, 1.0::DOUBLE AS s FROM nation)"]
    for t in range(k):
        steps.append(f"s{t + 1} AS (SELECT a.i, CASE WHEN max(g.v * a.s * b.s) > 0 THEN a.s / sqrt(max(g.v * a.s * b.s)) ELSE a.s END AS s FROM s{t} a LEFT JOIN g ON a.i = g.i LEFT JOIN s{t} b ON b.i = g.j GROUP BY a.i, a.s)")
    return f"WITH {', '.join(steps)} SELECT i, round(s, 8) AS s FROM s{k}"


@query("equilibrate_symmetric", _equilibrated(3))
def equilibrate_symmetric(spark, sf_dir):
    return scaling.equilibrate_symmetric(folded(spark, sf_dir), max_iterations=3, tol=0.0).rows.select("i", F.round("s", 8).alias("s"))


def _equilibrated_general(k: int) -> str:
    steps = [f"m AS ({TRADE}), r0 AS (SELECT (n_nationkey + 1)::BIGINT AS k, 1.0::DOUBLE AS s FROM nation), c0 AS (SELECT * FROM r0)"]
    for t in range(k):
        steps.append(f"w{t} AS (SELECT m.i, m.j, abs(v) * r.s * c.s AS w FROM m JOIN r{t} r ON m.i = r.k JOIN c{t} c ON m.j = c.k WHERE v <> 0)")
        for x, key in (("r", "i"), ("c", "j")):
            steps.append(f"{x}{t + 1} AS (SELECT a.k, CASE WHEN max(w) > 0 THEN a.s / sqrt(max(w)) ELSE a.s END AS s FROM {x}{t} a LEFT JOIN w{t} ON a.k = w{t}.{key} GROUP BY a.k, a.s)")
    return f"WITH {', '.join(steps)} SELECT r.k, round(r.s, 8) AS r, round(c.s, 8) AS c FROM r{k} r JOIN c{k} c ON r.k = c.k"


@query("equilibrate_general", _equilibrated_general(3))
def equilibrate_general(spark, sf_dir):
    got = scaling.equilibrate(trade(spark, sf_dir), max_iterations=3, tol=0.0)
    return got.rows.select(F.col("i").alias("k"), F.round("s", 8).alias("r")).join(got.columns.select(F.col("j").alias("k"), F.round("s", 8).alias("c")), "k")


def _held(matrix: SparseMatrix, got: scaling.Scaled, most: float) -> DataFrame:
    """How many are matched, at most once, on stored entries, with scaled entries of 1; and how many scaled entries are above `most`."""
    scaled = scaling.apply_scaling(matrix, got)
    hit = scaled.join(got.match, ["i", "j"])
    over = scaled.where(F.abs("v") > most).agg(F.count("*").alias("over"))
    return hit.agg(F.count("*").alias("matched"), F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("columns"), F.count(F.when(F.abs(F.abs("v") - 1) < 1e-6, 1)).alias("ones")).crossJoin(F.broadcast(over))  # one row each


@query("match_hungarian", f"SELECT n::BIGINT AS matched, n::BIGINT AS rows, n::BIGINT AS columns, n::BIGINT AS ones, 0::BIGINT AS over FROM (SELECT least(count(DISTINCT i), count(DISTINCT j)) AS n FROM ({TRADE}))")
def match_hungarian(spark, sf_dir):
    a = trade(spark, sf_dir)
    return _held(a, scaling.match_scaling(a, scale_if_singular=True), 1 + 1e-9)


@query("match_auction", f"SELECT n::BIGINT AS matched, n::BIGINT AS rows, n::BIGINT AS columns, n::BIGINT AS near, 0::BIGINT AS over FROM (SELECT least(count(DISTINCT i), count(DISTINCT j)) AS n FROM ({MATRIX}))")
def match_auction(spark, sf_dir):
    """Customers bid for parts, all at once: how many are matched, at most once, on stored entries, within the last eps of 1 when scaled; and how many scaled entries are above 1."""
    a = customer_part(spark, sf_dir)
    a = a.with_entries(cut(a.entries))
    got = scaling.match_scaling(a, "parallel auction")
    scaled = scaling.apply_scaling(a, got)
    over = scaled.where(F.abs("v") > 1 + 1e-9).agg(F.count("*").alias("over"))
    hit = scaled.join(got.match, ["i", "j"])
    return hit.agg(F.count("*").alias("matched"), F.countDistinct("i").alias("rows"), F.countDistinct("j").alias("columns"), F.count(F.when(F.abs("v") > 0.6, 1)).alias("near")).crossJoin(F.broadcast(over))  # one row each


@query("pattern_bins", f"WITH n AS (SELECT greatest((SELECT max(c_custkey) + 1 FROM customer), (SELECT max(p_partkey) + 1 FROM part)) AS k) SELECT floor((j - 1) * least(600, k) / k)::BIGINT AS px, floor((i - 1) * least(600, k) / k)::BIGINT AS py, count(*)::BIGINT AS entries FROM ({MATRIX}), n GROUP BY 1, 2")
def pattern_bins(spark, sf_dir):
    a = customer_part(spark, sf_dir)
    return plot.pattern_bins(a.entries, a.m, a.n)


@query("file_round_trip", MATRIX)
def file_round_trip(spark, sf_dir):
    import uuid

    a = customer_part(spark, sf_dir)
    cut(spark.range(1))  # sets the shared folder where none is named
    path = f"{spark.sparkContext.getCheckpointDir()}/matrix-{uuid.uuid4().hex}"
    rutherford_boeing.write(a, path, least_parts=8)
    return rutherford_boeing.read(spark, path)[0].entries


@query("print_rows", f"WITH f AS ({FOLDED}), g AS (SELECT i, j, v FROM f UNION ALL SELECT j, i, v FROM f WHERE i <> j) SELECT i, count(*)::BIGINT AS fields FROM g GROUP BY i")
def print_rows(spark, sf_dir):
    lines = convert.print_matrix(folded(spark, sf_dir), lines=26)[1:]
    return spark.createDataFrame([(int(x.split(":")[0]), x.count("(")) for x in lines], "i long, fields long")


def regression(spark, sf_dir) -> tuple[SparseMatrix, DataFrame]:
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("y"))
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("double")).alias("q"))
    rows = cut(items.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_orderkey") + 1).alias("i"), "q", (F.col("y") / 1000).alias("y")))
    m = int(rows.agg(F.max("i")).first()[0])
    entries = rows.select("i", F.lit(1).cast("long").alias("j"), (F.col("q") / 100).alias("v")).unionByName(rows.select("i", F.lit(2).cast("long").alias("j"), F.lit(1.0).alias("v")))
    return SparseMatrix(entries, m, 2, MatrixType.REAL_RECT), rows.select("i", F.col("y").alias("x"))


REGRESSION = "SELECT sum(l_quantity::DOUBLE) / 100 AS q, any_value(o_totalprice::DOUBLE) / 1000 AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"


@query("lsmr_regression", f"WITH d AS ({REGRESSION}) SELECT 1::BIGINT AS i, round(regr_slope(y, q), 5) AS x FROM d UNION ALL SELECT 2, round(regr_intercept(y, q), 5) FROM d")
def lsmr_regression(spark, sf_dir):
    a, b = regression(spark, sf_dir)
    return lsmr(a, b, options=LsmrOptions(atol=1e-13, btol=1e-13))[0].select("i", tidy("x", 5).alias("x"))


@query("lsmr_damped", f"WITH d AS ({REGRESSION}), s AS (SELECT sum(q * q) + 4 AS a, sum(q) AS b, count(*) + 4 AS c, sum(q * y) AS p, sum(y) AS r FROM d) SELECT 1::BIGINT AS i, round((p * c - b * r) / (a * c - b * b), 5) AS x FROM s UNION ALL SELECT 2, round((a * r - b * p) / (a * c - b * b), 5) FROM s")
def lsmr_damped(spark, sf_dir):
    a, b = regression(spark, sf_dir)
    return lsmr(a, b, damp=2.0, options=LsmrOptions(atol=1e-13, btol=1e-13))[0].select("i", tidy("x", 5).alias("x"))


@query("symbolic_chain", "WITH n AS (SELECT max(c_custkey) + 1 AS n FROM customer) SELECT n::BIGINT AS n, (2 * n - 1)::BIGINT AS entries, (4 * n - 3)::BIGINT AS flops, n::BIGINT AS structural_rank FROM n")
def symbolic_chain(spark, sf_dir):
    a = chain(spark, sf_dir, 4)
    e = a.entries.select("i", "j").toPandas()
    p = symbolic.plan(a.n, e.i.to_numpy() - 1, e.j.to_numpy() - 1, order=range(a.n), nemin=1)
    return spark.createDataFrame([(a.n, p.factor_entries, p.flops, p.structural_rank)], "n long, entries long, flops long, structural_rank long")


@query("elimination_tree", "SELECT (c_custkey + 1)::BIGINT AS i, (c_custkey + 2)::BIGINT AS parent FROM customer")
def elimination_tree(spark, sf_dir):
    a = chain(spark, sf_dir, 4)
    e = a.entries.select("i", "j").toPandas()
    parent = symbolic.elimination_tree(symbolic.adjacency(a.n, e.i.to_numpy() - 1, e.j.to_numpy() - 1), range(a.n))
    return spark.createDataFrame(pd.DataFrame({"i": np.arange(1, a.n + 1), "parent": parent + 1}), "i long, parent long")


@query("dissection_fill", "WITH s AS (SELECT floor(sqrt(count(*)))::BIGINT AS side FROM customer) SELECT (side * side)::BIGINT AS n, true AS ordered, true AS counted, true AS within FROM s")
def dissection_fill(spark, sf_dir):
    """A grid of customers in nested dissection order: counts of its columns, and fill under 1.3 of 31/4 n log2 of the side, the known bound."""
    a = customer_grid(spark, sf_dir, 4.0)
    p = direct.analyse(a, direct.Options(nemin=1)).plan
    graph = symbolic.adjacency(a.n, *direct.indices(a))
    entries = int(symbolic.column_counts(graph, p.order, symbolic.elimination_tree(graph, p.order)).sum())
    within = entries <= 1.3 * 7.75 * a.n * np.log2(max(a.n**0.5, 2.0))
    return spark.createDataFrame([(a.n, symbolic.check_order(a.n, p.order), entries == p.factor_entries, bool(within))], "n long, ordered boolean, counted boolean, within boolean")


@query("balanced_parts", "SELECT (n_nationkey + 1)::BIGINT AS nation, (4 * count(c_custkey) + 1)::BIGINT AS flops, true AS balanced FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def balanced_parts(spark, sf_dir):
    """Work of the trees of customers below nations, and whether the four tasks that they are dealt to are within the imbalance allowed."""
    a = stars(spark, sf_dir)
    order = [*range(26, a.n + 1), *range(1, 26)]
    p = direct.analyse(a, direct.Options(ordering=0, nemin=1), order).plan
    task, load = symbolic.subtree_partition(p.nodes, max(1, p.flops // 16), 4)
    rows = [(k, x.parent, p.order[x.pivots[-1]] + 1, symbolic.node_flops(x)) for k, x in enumerate(p.nodes)]
    nodes = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "parent", "last", "flops"]), "k long, parent long, last long, flops long")
    above = nodes.where("last <= 25").select(F.col("k").alias("above"), F.col("last").alias("nation"))
    trees = nodes.join(above, F.when(F.col("last") <= 25, F.col("k")).otherwise(F.col("parent")) == F.col("above")).groupBy("nation").agg(F.sum("flops").alias("flops"))
    return trees.select("nation", "flops", F.lit(bool(max(load) < symbolic.IMBALANCE * sum(load) / len(load))).alias("balanced"))


def known(spark, a: SparseMatrix) -> DataFrame:
    return spark.range(1, a.n + 1).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("x"))


KNOWN = "SELECT (c_custkey + 1)::BIGINT AS i, ((c_custkey + 1) % 7)::DOUBLE AS x FROM customer"


@query("solve_positive", KNOWN)
def solve_positive(spark, sf_dir):
    a = chain(spark, sf_dir, 4)
    f = direct.factor(direct.analyse(a), positive=True)
    return direct.solve(f, vectors.multiply(a, known(spark, a))).select("i", tidy("x").alias("x"))


@query("solve_indefinite", KNOWN)
def solve_indefinite(spark, sf_dir):
    a = replace(chain(spark, sf_dir, -12), type=MatrixType.REAL_SYM_INDEF)
    f = direct.factor(direct.analyse(a, direct.Options(scaling=4)))
    return direct.solve(f, vectors.multiply(a, known(spark, a))).select("i", tidy("x").alias("x"))


@query("solve_by_jobs", KNOWN)
def solve_by_jobs(spark, sf_dir):
    a = replace(chain(spark, sf_dir, 4), type=MatrixType.REAL_SYM_INDEF)
    f = direct.factor(direct.analyse(a))
    x = vectors.multiply(a, known(spark, a))
    for job in (1, 2, 3):
        x = direct.solve(f, x, job)
    return x.select("i", tidy("x").alias("x"))


def customer_grid(spark, sf_dir, diagonal: float) -> SparseMatrix:
    """Five-point stencil on the largest square grid of customers: -1 to neighbours, `diagonal` plus a tenth of the customer's nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), "c_nationkey")
    side = int(c.count() ** 0.5)
    c = c.where(F.col("k") < side * side)
    entry = lambda d, keep: c.where(keep).select((F.col("k") + 1).alias("i"), (F.col("k") + 1 - d).alias("j"), F.lit(-1.0).alias("v"))
    own = c.select((F.col("k") + 1).alias("i"), (F.col("k") + 1).alias("j"), (F.lit(diagonal) + F.col("c_nationkey") / 10).alias("v"))
    e = own.unionByName(entry(1, F.col("k") % side > 0)).unionByName(entry(side, F.col("k") >= side))
    return SparseMatrix(cut(e), side * side, side * side, MatrixType.REAL_SYM_INDEF)


GRID_KNOWN = "SELECT (c_custkey + 1)::BIGINT AS i, ((c_custkey + 1) % 7)::DOUBLE AS x FROM customer WHERE c_custkey < pow(floor(sqrt((SELECT count(*) FROM customer))), 2)"


@query("solve_grid", GRID_KNOWN)
def solve_grid(spark, sf_dir):
    """An indefinite grid, factored in several tasks over several levels; the solve is cut at D."""
    a = customer_grid(spark, sf_dir, 0.5)
    f = direct.factor(direct.analyse(a, direct.Options(task_flops=60_000, scaling=4)))
    x = direct.solve(f, direct.solve(f, vectors.multiply(a, known(spark, a)), 1), 4)
    return x.select("i", tidy("x", 5).alias("x"))


@query("solve_several", GRID_KNOWN.replace(" AS x FROM", " AS x, (c_custkey + 1)::DOUBLE AS y, true AS delayed FROM"))
def solve_several(spark, sf_dir):
    """Two right-hand sides at once, with a threshold that makes pivots fail and be delayed into other tasks."""
    a = customer_grid(spark, sf_dir, 0.0)
    f = direct.factor(direct.analyse(a, direct.Options(task_flops=60_000, u=0.45)))
    ids = spark.range(1, a.n + 1).select(F.col("id").alias("i"))
    both = [vectors.multiply(a, ids.select("i", x.cast("double").alias("x"))).withColumnRenamed("x", name) for x, name in ((F.col("i") % 7, "x"), (F.col("i"), "y"))]
    got = direct.solve_block(f, both[0].join(both[1], "i").select("i", F.array("x", "y").alias("w")))
    return got.select("i", tidy(F.col("w")[0], 4).alias("x"), tidy(F.col("w")[1], 4).alias("y"), F.lit(f.num_delayed > 0).alias("delayed"))


@query("inertia", "SELECT (count(*) FILTER (c_nationkey < 12))::BIGINT AS negative, 0::BIGINT AS zero, (count(*) FILTER (c_nationkey >= 12))::BIGINT AS positive FROM customer")
def inertia(spark, sf_dir):
    """Of the diagonal of nation - 11.5, which has no coupling."""
    a = chain(spark, sf_dir, 0)
    e = a.entries.where("i = j").select("i", "j", (F.col("v") - 11.5).alias("v"))
    f = direct.factor(direct.analyse(SparseMatrix(e, a.n, a.n, MatrixType.REAL_SYM_INDEF)))
    return spark.createDataFrame([tuple(int(k) for k in f.inertia)], "negative long, zero long, positive long")


SINGULAR = "SELECT count(*)::BIGINT AS n, (2 * count(DISTINCT c_custkey // 8) FILTER (c_custkey % 8 > 0 AND c_acctbal <> 0))::BIGINT AS rank, count(DISTINCT c_custkey // 8) FILTER (c_custkey % 8 > 0 AND c_acctbal <> 0) AS negative, true AS undelayed, true AS solved FROM customer"


@query("solve_singular", SINGULAR)
def solve_singular(spark, sf_dir):
    """Stars of eight customers each, tied to their first by their balance, without a diagonal: one pair of each star can be matched.

    Ordered and scaled by the matching of what can be matched; the other customers of a star stand behind it and are the zero pivots. A
    right-hand side of the matrix's range is solved for.
    """
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey").cast("long") + 1).alias("i"), F.col("c_acctbal").cast("double").alias("v"))
    hub = F.col("i") - (F.col("i") - 1) % 8
    n = c.count()
    a = SparseMatrix(cut(c.where((F.col("i") != hub) & (F.col("v") != 0)).select("i", hub.alias("j"), "v")), n, n, MatrixType.REAL_SYM_INDEF)
    f = direct.factor(direct.analyse(a, direct.Options(ordering=2, scaling=3)))
    b = vectors.multiply(a, known(spark, a))
    off = vectors.inf_norm(vectors.combine(1.0, vectors.multiply(a, direct.solve(f, b)), -1.0, b))
    return spark.createDataFrame([(n, f.rank, f.num_negative, f.num_delayed == 0, bool(off < 1e-8 * (vectors.inf_norm(b) + 1)))], "n long, rank long, negative long, undelayed boolean, solved boolean")


@query("enquire_alter", "SELECT (c_custkey + 1)::BIGINT AS i, 2.0::DOUBLE AS x FROM customer")
def enquire_alter(spark, sf_dir):
    """With D^-1 doubled, a solve gives twice the solution."""
    a = replace(chain(spark, sf_dir, 4), type=MatrixType.REAL_SYM_INDEF)
    f = direct.factor(direct.analyse(a))
    _, d = direct.enquire_indefinite(f)
    ones = spark.range(1, a.n + 1).select(F.col("id").alias("i"), F.lit(1.0).alias("x"))
    return direct.solve(direct.alter(f, 2 * d), vectors.multiply(a, ones)).select("i", tidy("x").alias("x"))


def grid(spark, side: int) -> SparseMatrix:
    """The five-point Laplacian of a square grid."""
    cells = spark.range(side * side).select(F.col("id"), (F.col("id") % side).alias("c"), (F.col("id") / side).cast("long").alias("r"))
    entry = lambda d, v, keep: cells.where(keep).select((F.col("id") + 1).alias("i"), (F.col("id") + 1 - d).alias("j"), F.lit(v).alias("v"))
    e = entry(0, 4.0, F.lit(True)).unionByName(entry(1, -1.0, F.col("c") > 0)).unionByName(entry(side, -1.0, F.col("r") > 0))
    return SparseMatrix(cut(e), side * side, side * side, MatrixType.REAL_SYM_PSDEF)


def _closed(side: int, where: str, order: str, k: int, scale: str = "v") -> str:
    return f"SELECT row_number() OVER (ORDER BY v)::BIGINT AS k, round({scale}, 6) AS value FROM (SELECT v FROM (SELECT 4 - 2 * cos(a * pi() / {side + 1}) - 2 * cos(b * pi() / {side + 1}) AS v FROM range(1, {side + 1}) x(a), range(1, {side + 1}) y(b)) WHERE {where} ORDER BY v {order} LIMIT {k})"


def _values(spark, values) -> DataFrame:
    return spark.createDataFrame([(k + 1, round(float(v), 6) + 0.0) for k, v in enumerate(values)], "k long, value double")


@query("eigs_shift_invert", _closed(8, "v > 1", "", 3))
def eigs_shift_invert(spark, sf_dir):
    return _values(spark, eigs.shift_invert(grid(spark, 8), 1.0, 0, 3, options=eigs.Options(rel_tol_residual=1e-7)).values)


@query("eigs_leftmost", _closed(6, "true", "", 2))
def eigs_leftmost(spark, sf_dir):
    return _values(spark, eigs.standard(grid(spark, 6), 2, options=eigs.Options(rel_tol_residual=2e-5)).values)


@query("eigs_generalized", _closed(6, "true", "", 2, "v / (v + 1)"))
def eigs_generalized(spark, sf_dir):
    """A x = lambda (A + I) x."""
    a = grid(spark, 6)
    b = a.with_entries(cut(a.entries.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))))
    return _values(spark, eigs.generalized(a, b, 2, options=eigs.Options(rel_tol_residual=1e-6)).values)


NEAR_HALF = "WITH w AS (SELECT 2 - cos(a * pi() / 7) - cos(b * pi() / 7) AS v FROM range(1, 7) x(a), range(1, 7) y(b)) SELECT max(v) AS v FROM w WHERE v < 0.5 UNION ALL SELECT min(v) FROM w WHERE v > 0.5"


@query("eigs_buckling", f"SELECT row_number() OVER (ORDER BY v)::BIGINT AS k, round(v, 6) AS value FROM ({NEAR_HALF})")
def eigs_buckling(spark, sf_dir):
    """A x = lambda 2 I x, the values on both sides of 0.5."""
    a = grid(spark, 6)
    b = a.with_entries(cut(spark.range(1, a.n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))))
    return _values(spark, eigs.buckling(a, b, 0.5, 1, 1, options=eigs.Options(rel_tol_residual=1e-6)).values)


@query("eigs_hermitian", "SELECT k, round(2 * cos((21 - k) * pi() / 21), 6) AS value FROM range(1, 3) x(k)")
def eigs_hermitian(spark, sf_dir):
    """An open chain of 20 with i below the diagonal and -i above."""
    e = spark.range(1, 20).select((F.col("id") + 1).alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("re"), F.lit(1.0).alias("im"))
    return _values(spark, eigs.hermitian(e, 20, 2, eigs.Options(rel_tol_residual=1e-5)).values)


# Stars: every customer is tied to its nation, and each nation's star is shifted by three times its region. The spectrum of a
# star of n leaves is its shift s, s + 1 (n - 1 times) and s + n + 1, so it can be said from the tables.

STARS = "SELECT n_nationkey AS k, 3 * any_value(n_regionkey) AS s, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey"
SPECTRUM = f"SELECT k, s::DOUBLE AS v FROM ({STARS}) UNION ALL SELECT k, (s + 1)::DOUBLE FROM ({STARS}), range(1, n) UNION ALL SELECT k, (s + n + 1)::DOUBLE FROM ({STARS}) WHERE n > 0"


def star_parts(spark, sf_dir) -> tuple[int, DataFrame, DataFrame]:
    """The order; (i, j, k) of the ties, customer and nation; and (i, k, degree, shift) of all vertices, nations first. k: the nation."""
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 26).cast("long").alias("i"), F.col("c_nationkey").cast("long").alias("k"))
    ties = cut(customers.select("i", (F.col("k") + 1).alias("j"), "k"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (3.0 * F.col("n_regionkey")).alias("shift"))
    degrees = ties.groupBy("j").agg(F.count("*").cast("double").alias("degree"))
    centres = nations.join(degrees, F.col("j") == F.col("k") + 1, "left").select((F.col("k") + 1).alias("i"), "k", F.coalesce("degree", F.lit(0.0)).alias("degree"), "shift")
    leaves = ties.join(F.broadcast(nations), "k").select("i", "k", F.lit(1.0).alias("degree"), "shift")  # 25 nations
    vertices = cut(centres.unionByName(leaves))
    return int(vertices.agg(F.max("i")).first()[0]), ties, vertices


def stars(spark, sf_dir, factor: F.Column | None = None, more: float = 0.0) -> SparseMatrix:
    """The matrix of the stars, each times its factor (of k), with `more` added to the diagonal first."""
    n, ties, vertices = star_parts(spark, sf_dir)
    own = F.lit(1.0) if factor is None else factor
    e = vertices.select("i", F.col("i").alias("j"), ((F.col("degree") + F.col("shift") + more) * own).alias("v")).unionByName(ties.select("i", "j", (-1.0 * own).alias("v")))
    return SparseMatrix(cut(e), n, n, MatrixType.REAL_SYM_INDEF)


def star_metric(spark, sf_dir, weight: F.Column) -> SparseMatrix:
    """Diagonal: the weight (of k) of each vertex's nation."""
    n, _, vertices = star_parts(spark, sf_dir)
    return SparseMatrix(cut(vertices.select("i", F.col("i").alias("j"), weight.cast("double").alias("v"))), n, n, MatrixType.REAL_SYM_PSDEF)


def turned_stars(spark, sf_dir) -> tuple[DataFrame, int]:
    """The stars with a unit on each tie, 1, i, -1 or -i by customer, in place of a sign: Hermitian, of the same spectrum."""
    n, ties, vertices = star_parts(spark, sf_dir)
    turn = F.col("i") % 4
    re, im = F.when(turn == 0, -1.0).when(turn == 2, 1.0).otherwise(0.0), F.when(turn == 1, -1.0).when(turn == 3, 1.0).otherwise(0.0)
    e = vertices.select("i", F.col("i").alias("j"), (F.col("degree") + F.col("shift")).alias("re"), F.lit(0.0).alias("im")).unionByName(ties.select("i", "j", re.alias("re"), im.alias("im")))
    return cut(e), n


def _ranked(*parts: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY v)::BIGINT AS k, round(v, 5) AS value FROM ({' UNION ALL '.join(f'SELECT v FROM ({x})' for x in parts)})"


def _near(spectrum: str, at: float, left: int, right: int) -> list[str]:
    return [f"SELECT v FROM ({spectrum}) WHERE v {op} {at} ORDER BY v {way} LIMIT {k}" for op, way, k in (("<", "DESC", left), (">", "ASC", right)) if k]


def _end(spectrum: str, way: str, k: int) -> str:
    return f"SELECT v FROM ({spectrum}) ORDER BY v {way} LIMIT {k}"


def _found(got: eigs.Eigenpairs) -> DataFrame:
    values = [(k + 1, round(float(v), 5) + 0.0) for k, v in enumerate(got.values)]  # as many as were asked for
    spark = got.vectors.sparkSession
    got.free()
    return spark.createDataFrame(values, "k long, value double")


CLOSE = eigs.Options(rel_tol_residual=1e-6)


@query("eigs_deflated", _ranked(_end(SPECTRUM, "ASC", 8)))
def eigs_deflated(spark, sf_dir):
    """Eight leftmost pairs, of which many are multiple, in blocks of three: converged ones are locked and fresh directions come in."""
    a = stars(spark, sf_dir)
    return _found(eigs.standard(a, 8, precondition=eigs.jacobi(a), options=replace(CLOSE, block=3)))


@query("eigs_two_ended", _ranked(_end(SPECTRUM, "ASC", 2), _end(SPECTRUM, "DESC", 3)))
def eigs_two_ended(spark, sf_dir):
    """Both ends in one run."""
    a = stars(spark, sf_dir)
    return _found(eigs.standard(a, 2, 3, eigs.jacobi(a), CLOSE))


SIGNED = f"SELECT CASE WHEN k % 2 = 0 THEN v ELSE -v END AS v FROM ({SPECTRUM})"


@query("eigs_largest", _ranked(f"SELECT v FROM ({SIGNED}) ORDER BY abs(v) DESC, v LIMIT 5"))
def eigs_largest(spark, sf_dir):
    """The five values of largest modulus where every other star is negative."""
    sign = F.when(F.col("k") % 2 == 0, 1.0).otherwise(-1.0)
    return _found(eigs.largest(stars(spark, sf_dir, sign), 5, options=CLOSE))


@query("eigs_by_vector_error", _ranked(_end(SPECTRUM, "DESC", 3)))
def eigs_by_vector_error(spark, sf_dir):
    """Stops by the estimated errors of the vectors alone."""
    return _found(eigs.standard(stars(spark, sf_dir), 0, 3, options=eigs.Options(rel_tol_residual=0.0, tol_vector=1e-4)))


@query("eigs_restarted", _ranked(_end(SPECTRUM, "DESC", 4)))
def eigs_restarted(spark, sf_dir):
    """Two rightmost pairs, then two more, orthogonal to the first."""
    a = stars(spark, sf_dir)
    first = eigs.standard(a, 0, 2, options=CLOSE)
    more = eigs.standard(a, 0, 2, options=CLOSE, constraints=first.vectors)
    both = replace(more, values=np.sort(np.append(first.values, more.values)))
    first.free()
    return _found(both)


WEIGHT = "(1 + k % 3)"
WEIGHTED = f"SELECT v / {WEIGHT} AS v FROM ({SPECTRUM})"
HALVES = f"SELECT k, v + 1 AS v FROM ({SPECTRUM})"  # of the positive definite stars


def _weight() -> F.Column:
    return 1 + F.col("k") % 3


@query("eigs_generalized_stars", _ranked(_end(WEIGHTED, "DESC", 3)))
def eigs_generalized_stars(spark, sf_dir):
    return _found(eigs.generalized(stars(spark, sf_dir), star_metric(spark, sf_dir, _weight()), 0, 3, options=CLOSE))


@query("eigs_shift_stars", _ranked(*_near(SPECTRUM, 0.5, 2, 2)))
def eigs_shift_stars(spark, sf_dir):
    return _found(eigs.shift_invert(stars(spark, sf_dir), 0.5, 2, 2, options=CLOSE))


@query("eigs_generalized_shift_stars", _ranked(*_near(WEIGHTED, 2.25, 1, 1)))
def eigs_generalized_shift_stars(spark, sf_dir):
    return _found(eigs.shift_invert(stars(spark, sf_dir), 2.25, 1, 1, star_metric(spark, sf_dir, _weight()), CLOSE))


@query("eigs_buckling_stars", _ranked(*_near(f"SELECT v / {WEIGHT} AS v FROM ({HALVES})", 1.2, 1, 1)))
def eigs_buckling_stars(spark, sf_dir):
    return _found(eigs.buckling(stars(spark, sf_dir, more=1.0), star_metric(spark, sf_dir, _weight()), 1.2, 1, 1, CLOSE))


@query("eigs_hermitian_stars", _ranked(_end(SPECTRUM, "DESC", 2)))
def eigs_hermitian_stars(spark, sf_dir):
    e, n = turned_stars(spark, sf_dir)
    return _found(eigs.hermitian(e, n, 0, CLOSE, right=2))


@query("eigs_hermitian_shift_stars", _ranked(*_near(SPECTRUM, 0.5, 1, 1)))
def eigs_hermitian_shift_stars(spark, sf_dir):
    e, n = turned_stars(spark, sf_dir)
    return _found(eigs.hermitian_shift_invert(e, n, 0.5, 1, 1, options=CLOSE))
