"""Work that grows no faster than the tables."""

import datetime as dt

import numpy as np

from tallyloom.operators import metrics, resample, validation
from tallyloom.plans import evaluate
from tallyloom.plans.config import EvalConfig

from .test_core import bronze

CONFIG = EvalConfig(seed="7", mc_iterations=30)


def ledger(spark):
    return bronze(spark, [{"pnl": (i * 37 % 23) - 8.0, "strategy_id": 1 + i % 2} for i in range(70)])


def test_no_row_is_shuffled_for_a_path(spark, monkeypatch):
    rows = spark.createDataFrame([(1 + i % 2, 1 + i // 2, float(i * 37 % 23) - 9, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(90)], "strategy_id long, seq int, capped_pnl double, timestamp timestamp")
    fallen = spark.createDataFrame([(1, -0.001), (2, -0.002)], "strategy_id long, max_drawdown double")
    found = resample.run_tests(rows, CONFIG, drawdowns=fallen)
    assert "iteration#" not in found._jdf.queryExecution().executedPlan().toString()
    plain = lambda d: sorted((r.strategy_id, r.test, r.iterations, *(np.round(x, 9).tolist() if x is not None else None for x in r[3:])) for r in d.collect())
    per_year = resample.inferred_rate(rows)
    joined = resample.summaries(resample.path_metrics(resample.sums_by_joins(rows, CONFIG, resample.TESTS), per_year, CONFIG), fallen)
    assert plain(found) == plain(joined) and len(plain(found)) == 8
    monkeypatch.setattr(resample, "DRAWS_OF_TASK", 300)  # ranges of iterations, each with its own rows
    assert plain(resample.run_tests(rows, CONFIG, drawdowns=fallen)) == plain(joined)


def test_score_and_estimate_need_three_tests(spark):
    three, four = evaluate.evaluate(ledger(spark), CONFIG, evaluate.SCORED_TESTS), evaluate.evaluate(ledger(spark), CONFIG)
    assert {r.test for r in three.resampled.collect()} == {"a", "c", "mb"}
    for name in ("scored", "overfitting"):
        assert sorted(map(str, getattr(three, name).collect())) == sorted(map(str, getattr(four, name).collect()))


def test_groups_of_metrics_are_settled_apart(spark, monkeypatch):
    settled, plain = [], metrics.settle
    monkeypatch.setattr(metrics, "settle", lambda df: settled.append(df.columns) or plain(df))
    evaluate.evaluate(ledger(spark), CONFIG, ("a", "c", "mb"))
    assert [c[0] for c in settled] == ["strategy_id"] * 7 and sum("median_return_per_trade" in c for c in settled) == 1


def test_purged_folds_deal_no_copy_of_a_trade(spark):
    """Long trades touch many stretches of time, but what is shuffled are sums by strategy and fold."""
    day = 86_400_000_000
    rows = spark.range(4000).selectExpr("id % 2 as strategy_id", "cast(id div 2 + 1 as int) as seq", f"id * {day} as entry", f"(id + id % 900) * {day} as exit", "cast(id % 7 - 3 as double) as R").localCheckpoint()
    plan = validation.purged_folds(rows, folds=5, embargo=0.02)
    assert "_bucket" not in plan._jdf.queryExecution().analyzed().toString()
    found = {(r.strategy_id, r.fold): r for r in plan.collect()}
    trades = [(x.seq, min(x.entry, x.exit), max(x.entry, x.exit)) for x in rows.filter("strategy_id = 1").collect()]
    gap = int(0.02 * (max(e for _, _, e in trades) - min(s for _, s, _ in trades)))
    for fold in range(5):
        own = [t for t in trades if (t[0] - 1) * 5 // len(trades) == fold]
        begin, last = min(t[1] for t in own), max(t[2] for t in own)
        others = [t for t in trades if t not in own]
        purged = sum(s <= last and e >= begin for _, s, e in others)
        assert (found[1, fold].n_purged, found[1, fold].n_embargoed) == (purged, sum(last < s <= last + gap for _, s, _ in others))
