"""Deals matched first in, first out, against a queue."""

import datetime as dt
import random
from collections import deque

import pytest

from tallyloom.operators import cleaning
from tallyloom.plans.config import EvalConfig
from tallyloom.sources import deals

SCHEMA = "strategy_id long, symbol string, deal_id string, time timestamp, direction string, type string, volume double, price double, commission double, swap double, profit double, row_idx long"


def queue(rows):
    """(strategy, symbol, side, opening deal, closing deal, volume in hundredths), one deal after the other."""
    out, left = [], {}
    opens = {}
    ordered = sorted((r for r in rows if r[4] in ("in", "OUT", "out") and r[5] in ("buy", "sell") and (r[6] or 0) > 0 and r[3] and r[7] is not None), key=lambda r: (r[3], r[11]))
    for r in ordered:
        side = "long" if (r[4] == "in") == (r[5] == "buy") else "short"
        key = (r[0], r[1] or "UNKNOWN", side)
        if r[4] == "in":
            opens.setdefault(key, deque()).append([r[2], round(r[6] * 100)])
    for r in ordered:
        side = "long" if (r[4] == "in") == (r[5] == "buy") else "short"
        key, volume = (r[0], r[1] or "UNKNOWN", side), round(r[6] * 100)
        if r[4] == "in":
            continue
        while volume and opens.get(key):
            head = opens[key][0]
            taken = min(volume, head[1])
            out.append((*key, head[0], r[2], taken))
            volume, head[1] = volume - taken, head[1] - taken
            if not head[1]:
                opens[key].popleft()
        if volume:
            left[key] = left.get(key, 0) - volume
    for key, held in opens.items():
        if sum(v for _, v in held):
            left[key] = left.get(key, 0) + sum(v for _, v in held)
    return sorted(out), left


def statement(seed, n=160):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(r.choice([1, 1, 2]), r.choice(["EURUSD", "GOLD", None]), f"d{i}", start + dt.timedelta(hours=r.randint(0, 50)), r.choice(["in", "out"]), r.choice(["buy", "sell"]), r.choice([0.01, 0.1, 0.25, 1.0]), 1.0 + i / 1000, -0.5, r.choice([None, -0.1]), r.choice([None, 3.0]), i) for i in range(n)]
    return rows + [(1, "GOLD", "x", start, "balance", "deposit", 1.0, 1.0, None, None, None, 900), (1, "GOLD", "y", start, "in", "buy", 0.0, 1.0, None, None, None, 901), (1, "GOLD", "z", None, "in", "buy", 1.0, 1.0, None, None, None, 902), (3, "GOLD", "only", start, "in", "buy", 1.0, 1.0, None, None, None, 903), (4, "GOLD", "gone", start, "out", "sell", 1.0, 1.0, None, None, None, 904)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_is_a_queue(spark, seed):
    rows = statement(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want, left = queue(rows)
    got = sorted((r["strategy_id"], r["symbol"], r["side"], r["opened"]["deal_id"], r["closed"]["deal_id"], round(r["units"] / 1e6)) for r in deals.matched(frame).collect())
    assert got == want and len(got) > 60
    assert {(r["strategy_id"], r["symbol"], r["side"]): round(r["volume"] * 100) * (1 if r["opens"] else -1) for r in deals.unmatched(frame).collect()} == left
    plan = deals.matched(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_partial_closes_become_trades(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(5)]
    rows = [(1, "GOLD", "a", t[0], "in", "buy", 1.0, 100.0, -2.0, None, None, 1), (1, "GOLD", "b", t[1], "in", "buy", 0.5, 110.0, -1.0, 0.0, None, 2), (1, "GOLD", "c", t[2], "out", "sell", 1.25, 120.0, -2.5, -0.5, 25.0, 3), (1, "GOLD", "d", t[3], "in", "sell", 1.0, 90.0, 0.0, 0.0, None, 4), (1, "GOLD", "e", t[4], "Out", "Buy", 0.4, 80.0, 0.0, 0.0, None, 5)]
    made = deals.ledger(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r["deal_id"], r["side"], r["quantity"], r["entry_price"], r["exit_price"], r["commission"], r["swap"], r["gross_pnl"]) for r in made.collect())
    assert got == [("a-c", "buy", 1.0, 100.0, 120.0, -4.0, -0.4, 20.0), ("b-c", "buy", 0.25, 110.0, 120.0, -1.0, -0.1, 5.0), ("d-e", "sell", 0.4, 90.0, 80.0, 0.0, 0.0, None)]
    trades = {r["deal_id"]: r for r in cleaning.clean(made, EvalConfig(seed="1")).trades.collect()}
    assert trades["a-c"]["pnl"] == pytest.approx(20.0 - 4.4) and trades["d-e"]["pnl"] == pytest.approx(4.0) and trades["d-e"]["side"] == "short"
    assert deals.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
