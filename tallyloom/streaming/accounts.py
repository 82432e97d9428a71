"""Accounts as typed state of a stream: equity, drawdown and an online CUSUM of each strategy as its trades arrive.

State is a row of named fields by strategy in the state store, so it survives restarts and is read by name. A timer
ends a session that has been idle for a while and writes its totals; trades older than the last one applied can no longer change
the curve and are counted instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.config import EPS, EvalConfig

STATE = "balance double, peak double, up double, down double, hits long, trades long, late long, last_time long, last_deal string, session_trades long, session_pnl double, session_end long"
OUTPUT = "strategy_id {key}, kind string, timestamp timestamp, deal_id string, balance double, peak double, dd double, s_plus double, s_minus double, hits long, trades long, late long, session_pnl double"


class Account(StatefulProcessor):
    """mean, deviation: of returns, against which the CUSUM stands; idle_seconds: a session's end."""

    def __init__(self, config: EvalConfig, mean: float, deviation: float, idle_seconds: float):
        self.start, self.k, self.h = config.start_balance, config.cusum_k, config.cusum_h
        self.mean, self.deviation, self.idle = mean, deviation, int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", STATE)

    def _held(self) -> dict[str, Any]:
        if self.account.exists():
            return dict(zip((f.split()[0] for f in STATE.split(", ")), self.account.get()))
        return {"balance": self.start, "peak": self.start, "up": 0.0, "down": 0.0, "hits": 0, "trades": 0, "late": 0, "last_time": None, "last_deal": None, "session_trades": 0, "session_pnl": 0.0, "session_end": None}

    def _keep(self, a: dict[str, Any]) -> None:
        self.account.update(tuple(a.values()))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        a = self._held()
        for r in sorted(rows, key=lambda r: (r["timestamp"], r["deal_id"])):  # one strategy's rows of one micro-batch
            at = (int(r["timestamp"].timestamp() * 1_000_000), r["deal_id"])
            if a["last_time"] is not None and at <= (a["last_time"], a["last_deal"]):
                a["late"] += 1
                continue
            before, pnl = a["balance"], r["pnl"]
            balance = before + pnl
            z = ((pnl / before if abs(before) > EPS else pnl) - self.mean) / self.deviation if self.deviation > EPS else 0.0
            up, down = max(0.0, a["up"] + z - self.k), min(0.0, a["down"] + z + self.k)
            hits = a["hits"] + (up > self.h) + (down < -self.h)
            peak = max(a["peak"], balance)
            a |= {"balance": balance, "peak": peak, "up": 0.0 if up > self.h else up, "down": 0.0 if down < -self.h else down, "hits": hits, "trades": a["trades"] + 1, "last_time": at[0], "last_deal": at[1], "session_trades": a["session_trades"] + 1, "session_pnl": a["session_pnl"] + pnl}
            yield Row(strategy_id=key[0], kind="trade", timestamp=r["timestamp"], deal_id=r["deal_id"], balance=balance, peak=peak, dd=(balance - peak) / (peak if peak > 0 else 1.0), s_plus=up, s_minus=down, hits=hits, trades=a["trades"], late=a["late"], session_pnl=a["session_pnl"])
        if a["last_time"] is not None:
            if a["session_end"] is not None:
                self.handle.deleteTimer(a["session_end"])
            a["session_end"] = a["last_time"] // 1000 + self.idle
            self.handle.registerTimer(a["session_end"])
        self._keep(a)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        a = self._held()
        if a["session_end"] is None or expiredTimerInfo.getExpiryTimeInMs() < a["session_end"]:
            return
        yield Row(strategy_id=key[0], kind="session", timestamp=None, deal_id=a["last_deal"], balance=a["balance"], peak=a["peak"], dd=None, s_plus=None, s_minus=None, hits=a["hits"], trades=a["session_trades"], late=a["late"], session_pnl=a["session_pnl"])
        self._keep(a | {"session_trades": 0, "session_pnl": 0.0, "session_end": None})

    def close(self) -> None:
        pass


def accounts(trades: DataFrame, config: EvalConfig, mean: float = 0.0, deviation: float = 1.0, idle_seconds: float = 3600.0, late: str = "0 seconds") -> DataFrame:
    """A row for each trade (kind `trade`) and for each session that has ended (kind `session`).

    trades: a stream of (strategy_id, timestamp, deal_id, pnl). Within a micro-batch trades are taken by time and deal; across
    batches a trade not after the last one of its strategy is late: it changes nothing, and `late` says how many were. A session ends
    when the watermark, `late` behind the newest trade of any strategy, is `idle_seconds` past a strategy's last trade.
    Trades behind the watermark are left out before they get here; rows without a strategy, time or pnl are, too. The session needs the RocksDB state store provider.
    """
    key = trades.schema["strategy_id"].dataType.simpleString()
    rows = trades.select("strategy_id", "timestamp", "deal_id", "pnl").na.drop(subset=["strategy_id", "timestamp", "pnl"]).na.fill("", ["deal_id"]).withWatermark("timestamp", late)
    return rows.groupBy("strategy_id").transformWithState(statefulProcessor=Account(config, mean, deviation, idle_seconds), outputStructType=OUTPUT.format(key=key), outputMode="Append", timeMode="EventTime")
