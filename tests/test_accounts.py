"""Accounts as a stream: micro-batches of any cut, with a restart between them, give the rows of one pass."""

import datetime as dt
import random

import pytest

from tallyloom.plans.config import EvalConfig
from tallyloom.streaming.accounts import accounts

CONFIG = EvalConfig(seed="1", start_balance=1000.0)
SCHEMA = "strategy_id long, timestamp timestamp, deal_id string, pnl double"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def one_pass(rows, mean, deviation):
    out, state = {}, {}
    for s, t, d, p in sorted(rows, key=lambda r: (r[1], r[2])):
        balance, peak, up, down, hits = state.get(s, (1000.0, 1000.0, 0.0, 0.0, 0))
        z = (p / balance - mean) / deviation
        up, down = max(0.0, up + z - 0.5), min(0.0, down + z + 0.5)
        balance += p
        peak, hits = max(peak, balance), hits + (up > 4) + (down < -4)
        out[s, d] = (balance, peak, (balance - peak) / peak, up, down, hits)
        state[s] = (balance, peak, 0.0 if up > 4 else up, 0.0 if down < -4 else down, hits)
    return out


def run(spark, folder, name, parts, restarts, **options):
    """The rows of all batches; each of `parts` is a file, the query stops after each of `restarts`."""
    held = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        if i in restarts or i == len(parts) - 1:
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
            out = accounts(source, CONFIG, **options)
            q = out.writeStream.foreachBatch(lambda df, _: held.extend(df.collect())).option("checkpointLocation", f"{folder}/{name}-state").start()
            q.processAllAvailable()
            q.stop()
    return held


def test_any_cut_gives_the_same_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 2]), START + dt.timedelta(minutes=i // 2), f"d{i:02d}", round(r.gauss(5 if i < 30 else -40, 20), 2)) for i in range(50)]
    want = one_pass(rows, 0.01, 0.02)
    assert max(w[5] for w in want.values()) > 0
    cuts = {"whole": [rows], "halves": [rows[:23], rows[23:]], "many": [rows[i : i + 13] for i in range(0, 50, 13)]}
    for name, parts in cuts.items():
        got = run(spark, tmp_path, name, parts, {1}, mean=0.01, deviation=0.02)
        trades = {(g["strategy_id"], g["deal_id"]): tuple(g[c] for c in ("balance", "peak", "dd", "s_plus", "s_minus", "hits")) for g in got if g["kind"] == "trade"}
        assert len([g for g in got if g["kind"] == "trade"]) == 50
        assert trades == {k: tuple(pytest.approx(x) for x in v) for k, v in want.items()}


def test_late_trades_and_idle_sessions(spark, tmp_path):
    hour = lambda h: START + dt.timedelta(hours=h)
    parts = [
        [(1, hour(1), "a", 10.0), (1, hour(2), "b", -5.0), (None, hour(2), "x", 1.0), (1, None, "y", 1.0), (1, hour(2), "z", None)],
        [(1, hour(2), "a", 99.0), (2, hour(9), "c", 1.0)],  # the first comes after b of its time: late; the second ends 1's session
        [(2, hour(10), "d", 1.0)],
        [(1, hour(11), "e", 7.0), (2, hour(11), "f", 1.0)],
    ]
    got = run(spark, tmp_path, "late", parts, {0}, idle_seconds=3 * 3600.0, late="0 seconds")
    first = [g for g in got if g["strategy_id"] == 1]
    assert [(g["deal_id"], g["balance"]) for g in first if g["kind"] == "trade"] == [("a", 1010.0), ("b", 1005.0), ("e", 1012.0)]
    ended = [g for g in first if g["kind"] == "session"]
    assert [(g["trades"], g["session_pnl"], g["deal_id"]) for g in ended] == [(2, 5.0, "b")]
    again = [g for g in first if g["deal_id"] == "e"]
    assert again[0]["session_pnl"] == 7.0 and again[0]["trades"] == 3
