"""Tables that hold something like trades, as bronze ledgers (13 canonical columns, strategy_id, row_idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = ("position_id", "deal_id", "symbol", "timestamp", "side", "quantity", "entry_price", "exit_price", "gross_pnl", "commission", "swap", "pnl", "balance")
TEXT_FIELDS = ("position_id", "deal_id", "symbol", "timestamp", "side")


def _empty(kind: str, name: str):
    return F.lit(None).cast(kind).alias(name)


def events_ledger(events: DataFrame, losing: tuple[str, ...] = ("error", "view")) -> DataFrame:
    """A trade of one unit at 1000 for each event, by user; events of the losing types are shorts that lose their value."""
    lost = F.col("event_type").isin(*losing)
    return events.select(
        F.col("user_id").alias("strategy_id"),
        F.col("event_id").alias("row_idx"),
        _empty("string", "position_id"),
        F.col("event_id").cast("string").alias("deal_id"),
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(lost, "sell").otherwise("buy").alias("side"),
        F.lit(1.0).alias("quantity"),
        F.lit(1000.0).alias("entry_price"),
        (F.lit(1000.0) + F.col("value")).alias("exit_price"),
        _empty("double", "gross_pnl"),
        _empty("double", "commission"),
        _empty("double", "swap"),
        F.when(lost, -F.col("value")).otherwise(F.col("value")).alias("pnl"),
        _empty("double", "balance"),
    )


def lineitem_ledger(lineitem: DataFrame) -> DataFrame:
    """A trade for each line, by supplier, without pnl, which cleaning derives; days hold ties."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    entry = F.col("l_extendedprice") / F.col("l_quantity")
    return lineitem.select(
        F.col("l_suppkey").alias("strategy_id"),
        F.row_number().over(order).cast("long").alias("row_idx"),
        _empty("string", "position_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("deal_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        entry.alias("entry_price"),
        (entry * (1.055 - F.col("l_discount"))).alias("exit_price"),
        _empty("double", "gross_pnl"),
        (-0.001 * F.col("l_extendedprice")).alias("commission"),
        (-F.col("l_tax")).alias("swap"),
        _empty("double", "pnl"),
        _empty("double", "balance"),
    )
