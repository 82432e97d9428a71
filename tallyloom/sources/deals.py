"""Statements of deals, one row for each opening or closing deal, as ledgers of closed trades.

Deals of a strategy, symbol and side match first in, first out. Running volumes lay the opening deals end to end, and
the closing deals as well; a trade is a stretch that lies in one deal of each kind. The stretches come of one scan
over the places where deals begin: at each the latest opening and the latest closing deal are carried on, so deals meet
no other deals, and a partial close is split where the next opening deal begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Volumes count in this share of a lot, as whole numbers, so that running volumes are exact.
STEPS = 100_000_000
SIDE = ["strategy_id", "symbol", "side"]
_KEPT = ("deal_id", "time", "price", "commission", "swap", "profit", "units")


def laid_out(deals: DataFrame) -> DataFrame:
    """(strategy_id, symbol, side, opens, start, deal): each deal with the running volume before it, among those of its kind.

    deals: (strategy_id, symbol, deal_id, time, direction in|out, type buy|sell, volume, price, commission, swap, profit, row_idx); a
    selling `out` closes a long position. Deals come by time, then row_idx. Rows without a volume above 0, a time or a
    price, or of another type or direction (deposits), are no deals.
    """
    opens = F.lower("direction") == "in"
    long = opens == (F.lower("type") == "buy")
    units = F.round(F.col("volume") * STEPS).cast("long")
    known = F.lower("direction").isin("in", "out") & F.lower("type").isin("buy", "sell") & (units > 0) & F.col("time").isNotNull() & F.col("price").isNotNull()
    rows = deals.filter(F.coalesce(known, F.lit(False))).select("strategy_id", F.coalesce("symbol", F.lit("UNKNOWN")).alias("symbol"), F.when(long, "long").otherwise("short").alias("side"), opens.alias("opens"), "row_idx", *_KEPT[:-1], units.alias("units"))
    before = Window.partitionBy(*SIDE, "opens").orderBy("time", "row_idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*SIDE, "opens", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("start"), F.struct(*_KEPT).alias("deal"))


def matched(deals: DataFrame) -> DataFrame:
    """(strategy_id, symbol, side, start, units, opened, closed): the stretches, with both deals whole."""
    rows = laid_out(deals)
    end = F.col("start") + F.col("deal.units")
    # what is open beyond all closing deals, or closed beyond all opening ones, has no counterpart
    limits = Window.partitionBy(*SIDE)
    edge = lambda kind: F.max(F.when(F.col("opens") == kind, end)).over(limits)
    rows = rows.withColumn("limit", F.least(edge(True), edge(False))).withColumn("both", edge(True).isNotNull() & edge(False).isNotNull()).filter("both")
    # an opening and a closing deal that begin at one place are one place
    order = Window.partitionBy(*SIDE).orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    pick = lambda kind: F.max_by("deal", F.when(F.col("opens") == kind, 1))
    places = rows.groupBy(*SIDE, "start").agg(F.first("limit").alias("limit"), pick(True).alias("in"), pick(False).alias("out"))
    stretch = places.select(*SIDE, "start", (F.least(F.coalesce(F.lead("start").over(order), F.col("limit")), "limit") - F.col("start")).alias("units"), F.last("in", True).over(upto).alias("opened"), F.last("out", True).over(upto).alias("closed"))
    return stretch.filter("units > 0")


def unmatched(deals: DataFrame) -> DataFrame:
    """(strategy_id, symbol, side, opens, volume): what stays open at the end (opens), or was closed without having been open."""
    totals = laid_out(deals).groupBy(*SIDE).agg(*(F.sum(F.when(F.col("opens") == kind, F.col("deal.units")).otherwise(0)).alias(n) for kind, n in ((True, "_in"), (False, "_out"))))
    over = F.col("_in") - F.col("_out")
    return totals.filter(over != 0).select(*SIDE, (over > 0).alias("opens"), (F.abs(over) / STEPS).alias("volume"))


def ledger(deals: DataFrame) -> DataFrame:
    """A bronze ledger: a trade for each stretch, closed at the closing deal's time; commission, swap and profit by its share of both deals' volume."""
    part = lambda deal, c: F.coalesce(F.col(f"{deal}.{c}"), F.lit(0.0)) * F.col("units") / F.col(f"{deal}.units")
    shared = lambda c: part("opened", c) + part("closed", c)
    none: Column = F.lit(None)
    gross = F.when(F.col("closed.profit").isNotNull(), F.col("closed.profit") * F.col("units") / F.col("closed.units"))
    return matched(deals).select(
        "strategy_id",
        F.row_number().over(Window.partitionBy("strategy_id").orderBy("closed.time", "symbol", "side", "start")).cast("long").alias("row_idx"),
        F.col("opened.deal_id").alias("position_id"),
        F.concat_ws("-", "opened.deal_id", "closed.deal_id").alias("deal_id"),
        "symbol",
        F.col("closed.time").alias("timestamp"),
        F.when(F.col("side") == "long", "buy").otherwise("sell").alias("side"),
        (F.col("units") / STEPS).alias("quantity"),
        F.col("opened.price").alias("entry_price"),
        F.col("closed.price").alias("exit_price"),
        gross.alias("gross_pnl"),
        shared("commission").alias("commission"),
        shared("swap").alias("swap"),
        none.cast("double").alias("pnl"),
        none.cast("double").alias("balance"),
    )
