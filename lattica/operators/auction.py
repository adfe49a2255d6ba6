"""The auction as Spark rounds: all open bidders bid at once, every lot takes its best bid.

The smaller side of the matrix bids for the larger one, so that all bidders can win. A bidder gains by a lot what its entry
is worth less the lot's price; it offers for its best lot what would make the second best as good, and eps more. Whoever held
the lot is open again. Bidders, bids and prices are tables, a round is a join, two grouped maxima and an update, and no task
sees more than its share of the entries. eps rises from round to round, which ends wars over few lots.

At the end a bidder's worth is the most that it gains at the last prices, so that the duals are feasible exactly, and a
matched entry is within eps of the best one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cutting import Workspace
from .matching import AuctionOptions, Patience

#: A table of at most so many rows is broadcast in a round; as rounds are many, what goes through the driver in all stays small.
ROUND_ROWS = 50_000


def _round(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= ROUND_ROWS else table.hint("merge")


@dataclass(frozen=True)
class Rising:
    """eps by round."""

    first: float = 0.01
    factor: float = 1.25
    last: float = 0.5

    def at(self, number: int) -> float:
        return min(self.last, self.first * self.factor**number)


def parallel_auction(logs: DataFrame, m: int, n: int, options: AuctionOptions = AuctionOptions(), eps: Rising = Rising()) -> DataFrame:
    """side (0 row, 1 column), k, mate (0: none), dual, rounds, of entries (i, j, w = log |a|), of which none is repeated."""
    space = Workspace(logs.sparkSession)
    bidder, lot = ("i", "j") if m <= n else ("j", "i")
    named = logs.select(F.col(bidder).alias("b"), F.col(lot).alias("t"), "w")
    top = space.keep(named.groupBy("b").agg(F.max("w").alias("top"), F.min("w").alias("low")))
    stat = top.agg(F.max(F.col("top") - F.col("low")).alias("spread"), F.count("*").alias("bidders")).first()
    empty = logs.sparkSession.createDataFrame([], "side int, k long, mate long, dual double, rounds long")
    if not stat["bidders"]:
        return empty
    shift = 2 * stat["spread"] + 1  # any match is worth more than a better one
    gains = space.keep(named.join(_round(top.select("b", "top"), stat["bidders"]), "b").select("b", "t", (F.col("w") - F.col("top") + shift).alias("g")))
    prices = space.keep(gains.select("t").distinct().select("t", F.lit(0.0).alias("price"), F.lit(None).cast("long").alias("holder")))
    lots = prices.count()
    out = space.keep(gains.select("b").limit(0))  # bidders without a positive gain left
    patience, number, dropped = Patience(max(min(stat["bidders"], lots), 1), options), 0, 0
    while number < options.max_iterations:
        held = prices.where("holder is not null").select(F.col("holder").alias("b"))
        holders = held.count()
        open_ = min(stat["bidders"], lots) - holders - dropped
        if open_ <= 0 or stat["bidders"] - holders - dropped <= 0 or patience.ended(open_):
            break
        active = top.select("b").join(_round(held, holders), "b", "left_anti").join(_round(out, dropped), "b", "left_anti")
        offer = gains.join(_round(active, stat["bidders"] - holders - dropped), "b").join(_round(prices.select("t", "price"), lots), "t").select("b", "t", "price", (F.col("g") - F.col("price")).alias("net"))
        best = offer.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("net"), "t"))).where("r <= 2")
        first = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
        second = F.coalesce(F.max(F.when(F.col("r") == 2, F.col("net"))), F.lit(0.0))
        bids = space.keep(best.groupBy("b").agg(first("t").alias("t"), first("net").alias("net"), (first("price") + first("net") - second + eps.at(number)).alias("bid")))
        won = bids.where("net > 0").groupBy("t").agg(F.max(F.struct("bid", (-F.col("b")).alias("b"))).alias("x")).select("t", F.col("x.bid").alias("bid"), (-F.col("x.b")).alias("winner"))
        after = space.keep(prices.join(_round(won, stat["bidders"] - holders - dropped), "t", "left").select("t", F.coalesce("bid", "price").alias("price"), F.coalesce("winner", "holder").alias("holder")))
        if (gone := bids.where("net <= 0").count()) > 0:
            dropped += gone
            more = space.keep(out.unionByName(bids.where("net <= 0").select("b")))
            space.drop(out)
            out = more
        space.drop(bids, prices)
        prices, number = after, number + 1
    worth = gains.join(_round(prices, lots), "t").groupBy("b").agg(F.max(F.col("g") - F.col("price")).alias("worth"), F.max(F.when(F.col("holder") == F.col("b"), F.col("t"))).alias("mate"))
    of = {"i": 0, "j": 1}
    mate = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias("mate")
    bidders = worth.join(_round(top, stat["bidders"]), "b").select(F.lit(of[bidder]).alias("side"), F.col("b").alias("k"), mate("mate"), (shift / 2 - F.col("worth") - F.col("top")).alias("dual"))
    taken = prices.select(F.lit(of[lot]).alias("side"), F.col("t").alias("k"), mate("holder"), (shift / 2 - F.col("price")).alias("dual"))
    found = space.keep(bidders.unionByName(taken).withColumn("rounds", F.lit(number).cast("long")))
    space.drop(gains, prices, top, out)
    return found
