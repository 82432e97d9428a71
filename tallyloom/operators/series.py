"""Series of a strategy: balances and returns of its trades, equity and drawdown curves, monthly returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import EPS, EvalConfig
from . import scans
from .cleaning import KEY


def with_returns(trades: DataFrame, config: EvalConfig) -> DataFrame:
    """Adds balance_before and R, a trade's return.

    Numerators are capped pnl, denominators the reported or rebuilt balance before the trade; one unusable
    balance sends the whole strategy to the trade's notional instead.
    """
    rows = scans.lagged(scans.running_sums(trades, {"_sum": F.col("capped_pnl")}), {"_last": F.col("balance_after"), "_built": F.col("_sum")})
    rows = scans.of_strategy(rows, {"_reported": F.bool_and(F.col("balance_after").isNotNull())})
    lagged = F.coalesce("_last", F.col("balance_after") - F.col("capped_pnl"))
    built = F.lit(config.start_balance) + F.coalesce("_built", F.lit(0.0))
    rows = rows.withColumn("balance_before", F.when(F.col("_reported"), lagged).otherwise(built))
    rows = scans.of_strategy(rows, {"_usable": F.bool_and(F.coalesce(F.abs("balance_before") > EPS, F.lit(False)))})
    notional = F.when(F.abs("entry_notional") > EPS, F.col("entry_notional")).otherwise(1.0)
    rows = rows.withColumn("R", F.when(F.col("_usable"), F.col("capped_pnl") / F.col("balance_before")).otherwise(F.col("capped_pnl") / notional))
    return rows.drop("_sum", "_last", "_built", "_reported", "_usable")


def fall(balance: Column, peak: Column) -> Column:
    return (balance - peak) / F.when(peak > 0, peak).otherwise(1.0)


def with_equity(trades: DataFrame, config: EvalConfig) -> DataFrame:
    """Adds balance (start plus running capped pnl), peak and dd of the closed-trade curve to each trade."""
    rows = scans.running_sums(trades, {"balance": F.col("capped_pnl")}).withColumn("balance", F.lit(config.start_balance) + F.col("balance"))
    rows = scans.running_max(rows, "peak", F.col("balance")).withColumn("peak", F.greatest(F.lit(config.start_balance), "peak"))
    return rows.withColumn("dd", fall(F.col("balance"), F.col("peak")))


def equity_curve(trades: DataFrame, config: EvalConfig) -> DataFrame:
    """(strategy_id, seq, t, balance, peak, dd): the start, a second before the first trade, and a point after each trade."""
    return curve_points(with_equity(trades, config), config)


def curve_points(facts: DataFrame, config: EvalConfig) -> DataFrame:
    """The equity curve of trades that have balance, peak and dd already."""
    points = facts.select(*KEY, "seq", F.col("timestamp").alias("t"), "balance", "peak", "dd")
    start = F.lit(config.start_balance)
    first = facts.filter("seq = 1").select(*KEY, F.lit(0).alias("seq"), (F.col("timestamp") - F.expr("INTERVAL 1 SECOND")).alias("t"), start.alias("balance"), start.alias("peak"), F.lit(0.0).alias("dd"))
    return points.unionByName(first)


def marked_equity(trades: DataFrame, config: EvalConfig) -> DataFrame:
    """(strategy_id, t, balance, peak, dd) at every entry and exit, open trades counted by the elapsed share of their pnl.

    A sweep: an entry adds a line's slope and intercept, the exit takes them back and adds the pnl, and running
    sums give the balance, where a join of times with open trades would compare them all.
    """
    span = F.col("duration_seconds")
    at = F.unix_micros("timestamp") / 1e6
    rows = trades.select(*KEY, "capped_pnl", span.alias("span"), (at - span).alias("entry"), at.alias("exit"))
    first = Window.partitionBy("strategy_id")
    rows = rows.withColumn("zero", F.min("entry").over(first))
    rows = rows.withColumns({"e": F.round((F.col("entry") - F.col("zero")) * 1e6).cast("long"), "x": F.round((F.col("exit") - F.col("zero")) * 1e6).cast("long")})
    rate = F.when(F.col("span") > EPS, F.col("capped_pnl") / F.col("span")).otherwise(0.0)
    into = F.struct(F.col("e").alias("m"), rate.alias("slope"), (-rate * F.col("e") / 1e6).alias("cut"), F.lit(0.0).alias("done"))
    out = F.struct(F.col("x").alias("m"), (-rate).alias("slope"), (rate * F.col("e") / 1e6).alias("cut"), F.col("capped_pnl").alias("done"))
    events = rows.select(*KEY, "zero", F.explode(F.array(into, out)).alias("p")).groupBy(*KEY, "p.m").agg(F.first("zero").alias("zero"), *(F.sum(f"p.{c}").alias(c) for c in ("slope", "cut", "done")))
    upto = Window.partitionBy("strategy_id").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    s = events.select(*KEY, "m", "zero", *(F.sum(c).over(upto).alias(c) for c in ("slope", "cut", "done")))
    s = s.withColumn("balance", F.lit(config.start_balance) + F.col("done") + F.col("slope") * F.col("m") / 1e6 + F.col("cut"))
    s = s.withColumn("peak", F.max("balance").over(upto))
    return s.select(*KEY, F.timestamp_micros((F.round(F.col("zero") * 1e6) + F.col("m")).cast("long")).alias("t"), "balance", "peak", fall(F.col("balance"), F.col("peak")).alias("dd"))


def monthly_returns(equity: DataFrame) -> DataFrame:
    """(strategy_id, month, ret): change between the last balances of months that have any; the first month has none."""
    ends = equity.groupBy(*KEY, F.date_format("t", "yyyy-MM").alias("month")).agg(F.max_by("balance", "seq").alias("last"))
    before = F.lag("last").over(Window.partitionBy("strategy_id").orderBy("month"))
    return ends.withColumn("before", before).filter("before IS NOT NULL").select(*KEY, "month", ((F.col("last") - F.col("before")) / F.col("before")).alias("ret"))


def islands(rows: DataFrame, inside: Column, name: str) -> DataFrame:
    """Adds `name`, a number for each run of consecutive rows; rows outside of runs begin a new number."""
    return scans.running_sums(rows, {name: (~inside).cast("int")})
