"""Scans, quantiles and CUSUM of strategies cut into chunks: equal to those by windows, to numpy and to a plain loop."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cleaning, cusum, metrics, quantiles, regime, scans, series
from tallyloom.plans import evaluate
from tallyloom.plans.config import EvalConfig
from tallyloom.plans.lineage import settle
from tallyloom.sources import adapters

WHOLE = EvalConfig(seed="7")
CHUNKS = replace(WHOLE, chunk_rows=40)


@pytest.fixture(scope="module")
def bronze(spark):
    """One strategy has two thirds of the trades; many have equal times, some no profit."""
    r = random.Random(4)
    rows = [(7 if i % 3 else i % 11, i, f"2024-01-{1 + i // 40:02d} {i % 40 // 2:02d}:00:00", "buy" if i % 2 else "sell", r.choice([0.0, 1.0, -1.0, 5.0, r.gauss(0.3 if i < 300 else -2, 3)])) for i in range(600)]
    frame = spark.createDataFrame(rows, "strategy_id long, row_idx long, timestamp string, side string, pnl double")
    filled = {c: F.lit(None).cast("string") for c in ("position_id", "deal_id")} | {"symbol": F.lit("X")} | {c: F.lit(None).cast("double") for c in ("gross_pnl", "commission", "swap", "balance")} | {c: F.lit(1.0) for c in ("quantity", "entry_price")} | {"exit_price": F.lit(1.0)}
    return frame.withColumns(filled).select("strategy_id", "row_idx", *adapters.CANONICAL).repartition(5).cache()


@pytest.fixture(scope="module")
def facts(spark, bronze):
    """Trades with their series, by windows and by chunks, worked out once; rows this few would be broadcast or put into one partition otherwise."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in own.items():
        spark.conf.set(k, v)
    out = [(settle(metrics.trade_facts(cleaning.clean(bronze, c).trades, c)), c) for c in (WHOLE, CHUNKS)]
    yield out
    for k in own:
        spark.conf.unset(k)


def same(facts, make):
    got = []
    for frame, config in facts:
        made = make(frame, config)
        columns = sorted(c for c in made.columns if c != scans.CHUNK)
        got.append(sorted(repr(tuple(round(x, 8) + 0.0 if isinstance(x, float) else x for x in row)) for row in made.select(*columns).collect()))
    assert got[0] == got[1] and got[0]
    return got[0]


def test_a_large_strategy_is_several_tasks_work(facts):
    (whole, _), (rows, _) = facts
    assert scans.CHUNK not in whole.columns
    sizes = rows.groupBy("strategy_id", "chunk").count().collect()
    assert sum(s["strategy_id"] == 7 for s in sizes) >= 5 and max(s["count"] for s in sizes) < 120
    held = rows.filter("strategy_id = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 1 and max(h["count"] for h in held) < 0.7 * sum(h["count"] for h in held)


def test_trades_and_series(facts):
    same(facts, lambda f, c: f)


def test_growth_and_tails(facts):
    same(facts, lambda f, c: metrics.growth(f, c))
    same(facts, lambda f, c: metrics.tails(f))


def test_durations_and_rates(facts):
    same(facts, lambda f, c: metrics.drawdown_duration(f))
    same(facts, lambda f, c: metrics.with_rates(f, c))
    same(facts, lambda f, c: series.monthly_returns(series.curve_points(f, c)))


def test_streaks_and_runs(facts):
    same(facts, lambda f, c: metrics.streaks(f))
    same(facts, lambda f, c: metrics.runs_test(f))


def test_regime(facts):
    rows = same(facts, lambda f, c: regime.cusums(f, c).select("strategy_id", "whole.*", *(F.col(f"{h}.{x}").alias(f"{h}_{x}") for h in ("first", "second") for x in ("s_plus_peak", "s_minus_peak", "hits"))))
    assert len(rows) > 3
    same(facts, lambda f, c: regime.regime_check(f, c).drop("cusum_first_half", "cusum_second_half"))


def test_a_whole_evaluation(bronze):
    got = []
    for config in (WHOLE, CHUNKS):
        rows = evaluate.evaluate(bronze, replace(config, mc_iterations=10)).scored
        rows = rows.select("strategy_id", "total_trades", "status", "final_score", "sharpe_ratio", "max_drawdown", "mtm_max_drawdown", "tail_ratio", "median_return_per_trade", "runs_z", "regime_unstable", "robustness_rate", "max_loss_streak")
        got.append(sorted(repr(tuple(round(x, 8) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows.collect()))
    assert got[0] == got[1] and len(got[0]) > 3


def plain_cusum(values, k=0.5, h=4.0):
    x = np.array(values)
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    up = down = top = low = 0.0
    hits = 0
    for z in ((x - x.mean()) / sd if sd >= 1e-9 else []):
        up, down = max(0.0, up + z - k), min(0.0, down + z + k)
        top, low = max(top, up), min(low, down)
        hits += (up > h) + (down < -h)
        up, down = 0.0 if up > h else up, 0.0 if down < -h else down
    return top, low, hits


def test_cusum_of_halves_is_a_plain_loop(spark):
    r = np.random.default_rng(3)
    histories = {1: r.normal(size=200), 2: np.r_[r.normal(size=60), r.normal(3, 1, 61)], 3: np.zeros(40), 4: r.normal(size=3), 5: r.normal(size=1), 6: np.r_[np.zeros(30), 5.0], 7: r.standard_t(1.2, 301)}
    rows = [(s, i, float(x)) for s, v in histories.items() for i, x in enumerate(v, 1)]
    frame = spark.createDataFrame(rows, "strategy_id long, seq int, R double").repartition(3)
    cut = frame.withColumn(scans.CHUNK, F.floor(F.col("seq") / 17).cast("int"))
    for facts in (frame, cut):
        for row in regime.cusums(facts, WHOLE).collect():
            v = histories[row["strategy_id"]]
            assert (row["whole"]["s_plus_peak"], row["whole"]["s_minus_peak"], row["whole"]["hits"]) == pytest.approx(plain_cusum(v))
            for name, half in (("first", v[: len(v) // 2]), ("second", v[len(v) // 2 :])):
                got = row[name]
                assert got is None if len(v) < 4 else (got["s_plus_peak"], got["s_minus_peak"], got["hits"]) == pytest.approx(plain_cusum(half))
        plan = regime.cusums(facts, WHOLE)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(struct(seq" not in plan


def test_folds_follow_any_start():
    r = np.random.default_rng(0)
    for _ in range(600):
        x = np.round(r.normal(r.choice([-0.5, 0, 0.5, 2]), r.choice([0.05, 0.5, 2, 6]), int(r.integers(1, 60))) * 8) / 8
        pieces = cusum.fold(x, 4.0)
        for s in np.arange(0, 4.01, 0.125):
            p = next(p for p in pieces if p[0] >= s)
            now, hits, peak = s, 0, 0.0
            for v in x:
                now = max(0.0, now + v)
                peak = max(peak, now)
                if now > 4.0:
                    hits, now = hits + 1, 0.0
            assert (p[2] + p[3] * s, p[4], max(0.0, s + p[1], p[5])) == (pytest.approx(now), hits, pytest.approx(peak))


def test_quantiles_are_numpy_s(spark):
    r = np.random.default_rng(5)
    groups = {1: r.normal(size=501), 2: 10.0 ** r.uniform(-300, 300, 200) * r.choice([-1, 1], 200), 3: np.array([1.0]), 4: np.repeat([2.0, 3.0], 50), 5: np.array([-1.7e308, 1.7e308, 0.0, -0.0]), 6: np.array([5e-324, 0.0, 1.0, 1.0 + 2.0**-52])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [(1, None), (1, float("nan")), (9, None)]
    frame = spark.createDataFrame(rows, "strategy_id long, v double").repartition(4)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    for bins in (16, 1024):
        got = {x["strategy_id"]: x["q"] for x in quantiles.quantiles(frame, shares, bins).collect()}
        assert set(got) == set(groups)
        for g, v in groups.items():
            ordered, n = np.sort(v), len(v) - 1
            want = []
            for p in shares:
                a, b = int(np.floor(p * n)), int(np.ceil(p * n))
                want.append(ordered[a] if a == b or ordered[a] == ordered[b] else (b - p * n) * ordered[a] + (p * n - a) * ordered[b])
            assert got[g] == pytest.approx(want, rel=1e-12, abs=5e-324)
    assert quantiles.quantiles(frame.limit(0), shares).count() == 0


def test_scans_skip_nulls_across_chunks(spark):
    rows = [(1, i, None if i % 5 else i, i // 3) for i in range(30)] + [(2, 0, None, 0)]
    frame = spark.createDataFrame(rows, "strategy_id long, seq long, x long, chunk int")
    got = {(r["strategy_id"], r["seq"]): (r["b"], r["s"], r["m"]) for r in scans.running_max(scans.running_sums(scans.lagged(frame, {"b": F.col("x")}, skip_nulls=True), {"s": F.col("x")}), "m", F.col("x")).collect()}
    seen = lambda i: [j for j in range(i) if j % 5 == 0]
    assert got == {(1, i): (max(seen(i), default=None), sum(seen(i + 1)), max(seen(i + 1))) for i in range(30)} | {(2, 0): (None, 0, None)}
