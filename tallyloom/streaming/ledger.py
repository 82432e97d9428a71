"""Ledgers as streams: trades arrive in order of time, equity and its peak follow as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

POINTS = "strategy_id long, timestamp timestamp, balance double, peak double, dd double"
STATE = "balance double, peak double"


def windowed_pnl(trades: DataFrame, late: str | None = "1 day", width: str = "1 day") -> DataFrame:
    """(strategy_id, begin, trades, pnl) of each window of time; trades later than `late` are left out.

    late: None where the stream has its watermark already.
    """
    marked = trades if late is None else trades.withWatermark("timestamp", late)
    return marked.groupBy("strategy_id", F.window("timestamp", width).alias("w")).agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl")).select("strategy_id", F.col("w.start").alias("begin"), "trades", "pnl")


def first_seen(trades: DataFrame, late: str = "1 day") -> DataFrame:
    """Trades without repeats of a deal within the watermark."""
    return trades.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["strategy_id", "deal_id"])


def running_equity(trades: DataFrame, start_balance: float = 10_000.0) -> DataFrame:
    """Equity points of a strategy's trades as they arrive; balance and peak are kept between batches."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        balance, peak = state.get if state.exists else (start_balance, start_balance)
        rows = pd.concat(list(batches)).sort_values(["timestamp", "deal_id"])
        equity = balance + rows["pnl"].cumsum()
        peaks = equity.cummax().clip(lower=peak)
        state.update((float(equity.iloc[-1]), float(peaks.iloc[-1])))
        yield pd.DataFrame({"strategy_id": key[0], "timestamp": rows["timestamp"], "balance": equity, "peak": peaks, "dd": (equity - peaks) / peaks.where(peaks > 0, 1.0)})

    return trades.select("strategy_id", "timestamp", "deal_id", "pnl").groupBy("strategy_id").applyInPandasWithState(advance, POINTS, STATE, "append", GroupStateTimeout.NoTimeout)
