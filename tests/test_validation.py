"""Cross-validation, walk-forward windows and interval joins against brute force."""

import datetime as dt
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import intervals, validation

START = dt.datetime(2024, 1, 1)
RETURNS = "strategy_id long, timestamp timestamp, R double"


def at(hours):
    return START + dt.timedelta(hours=hours)


def ratio(r):
    if len(r) < 2:
        return 0.0
    sd = np.std(r, ddof=1)
    return round(float(np.mean(r) / sd), 9) if sd > 1e-9 else 0.0


def brute_cscv(rows, blocks):
    micros = lambda t: round((t - START).total_seconds() * 1e6)
    low, high = min(micros(t) for _, t, _ in rows), max(micros(t) for _, t, _ in rows)
    by = {}
    for s, t, r in rows:
        by.setdefault(s, []).append(((micros(t) - low) * blocks // (high - low + 1), r))
    out = {}
    for chosen in combinations(range(blocks), blocks // 2):
        within = {s: ratio([r for b, r in v if b in chosen]) for s, v in by.items()}
        outside = {s: ratio([r for b, r in v if b not in chosen]) for s, v in by.items()}
        best = min(within, key=lambda s: (-within[s], s))
        below, equal = sum(o < outside[best] for o in outside.values()), sum(o == outside[best] for o in outside.values())
        out[sum(1 << b for b in chosen)] = (best, within[best], outside[best], (below + (equal + 1) / 2) / (len(by) + 1))
    return out


def noise(seed, strategies=24, trades=60, skilled=None):
    r = random.Random(seed)
    rows = [(s, at(r.uniform(0, 5000)), r.gauss(1.5 if s == skilled else 0, 1)) for s in range(strategies) for _ in range(trades)]
    return rows + [(99, at(3.0), 0.5), (98, at(10.0), 1.0), (98, at(4000.0), 1.0)]  # a single trade; equal returns


def test_cscv_is_brute_force(spark):
    rows = noise(1)
    got = validation.cscv(spark.createDataFrame(rows, RETURNS).repartition(5), 6).collect()
    want = brute_cscv(rows, 6)
    assert len(got) == len(want) == math.comb(6, 3)
    for g in got:
        best, inside, out, rank = want[g["in_sample"]]
        assert (g["best_strategy"], g["in_sharpe"], g["out_sharpe"]) == (best, pytest.approx(inside, abs=2e-9), pytest.approx(out, abs=2e-9))
        assert g["relative_rank"] == pytest.approx(rank) and g["logit"] == pytest.approx(math.log(rank / (1 - rank)))


def test_noise_overfits_and_skill_does_not(spark):
    # over all choices of a null each strategy is as good as any other outside; one table gives some number, many their mean
    pbo = lambda rows: validation.overfitting_probability(validation.cscv(spark.createDataFrame(rows, RETURNS), 8)).first()["pbo"]
    assert 0.3 < np.mean([pbo(noise(s)) for s in range(3, 9)]) < 0.75
    assert pbo(noise(2, skilled=7)) < 0.05


def test_cscv_edges(spark):
    none = spark.createDataFrame([], RETURNS)
    assert validation.cscv(none, 4).count() == 0
    one = validation.cscv(spark.createDataFrame([(1, START, 0.1), (1, at(1), None), (None, at(2), 0.3)], RETURNS), 2).collect()
    assert [(r["best_strategy"], r["relative_rank"]) for r in one] == [(1, 0.5)] * 2
    for blocks in (3, 18, 0):
        with pytest.raises(ValueError):
            validation.cscv(none, blocks)
    words = spark.createDataFrame([("b", START, 0.1), ("a", at(9), 0.1)], "strategy_id string, timestamp timestamp, R double")
    assert {r["best_strategy"] for r in validation.cscv(words, 2).collect()} == {"a"}


def test_cscv_in_slices(spark, monkeypatch):
    rows = noise(4, strategies=9)
    frame = spark.createDataFrame(rows, RETURNS)
    whole = sorted(map(tuple, validation.cscv(frame, 6).collect()))
    monkeypatch.setattr(validation, "CELLS", 40)
    assert sorted(map(tuple, validation.cscv(frame, 6).collect())) == whole


def test_overlaps(spark):
    r = random.Random(3)
    span = lambda: (lambda a: (a, a + r.choice([0, 0, 3, 40, -2])))(r.randint(-200, 200))
    left = [(r.choice("ab"), i, *span()) for i in range(150)] + [("a", 900, None, 5)]
    right = [(r.choice("ab"), i, *span()) for i in range(60)] + [("b", 901, 1, None)]
    want = {(x[1], y[1]) for x in left for y in right if None not in (*x, *y) and x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]}
    a, b = spark.createDataFrame(left, "k string, l long, start long, end long"), spark.createDataFrame(right, "k string, r long, begin long, finish long")
    for width in (1, 7, 1000):
        got = intervals.overlaps(a, b, ["k"], width).select("l", "r").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    plan = intervals.overlaps(a, b, ["k"], 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_folds(rows, folds, embargo):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted((r[1], min(r[2], r[3]), max(r[2], r[3]), r[4]) for r in rows if r[0] == s)
        n = len(own)
        gap = math.floor(embargo * (max(x[2] for x in own) - min(x[1] for x in own)))
        of = [(x[0] - 1) * folds // n for x in own]
        for f in set(of):
            test = [x for x, k in zip(own, of) if k == f]
            a, z = min(x[1] for x in test), max(x[2] for x in test)
            rest = [x for x, k in zip(own, of) if k != f]
            purged = [x for x in rest if x[1] <= z and x[2] >= a]
            late = [x for x in rest if z < x[1] <= z + gap]
            train = [x[3] for x in rest if x not in purged and x not in late]
            out[s, f] = (len(test), len(purged), len(late), len(train), np.mean(train) if train else None, np.mean([x[3] for x in test]), ratio(train), ratio([x[3] for x in test]))
    return out


def test_purged_folds_are_brute_force(spark):
    r = random.Random(8)
    rows = []
    for s, n in ((1, 90), (2, 3), (3, 1), (4, 40)):
        exits = sorted(r.randint(0, 60) * 10 for _ in range(n))  # many ties
        rows += [(s, i, z - r.choice([0, 5, 30, 200]) * (-1 if i % 17 == 0 else 1), z, r.gauss(0, 1)) for i, z in enumerate(exits, 1)]
    frame = spark.createDataFrame(rows, "strategy_id long, seq int, entry long, exit long, R double").repartition(4)
    got = {(x["strategy_id"], x["fold"]): tuple(x)[2:] for x in validation.purged_folds(frame, 5, 0.05).collect()}
    want = brute_folds(rows, 5, 0.05)
    assert set(got) == set(want) and sum(w[1] for w in want.values()) > 50 and sum(w[2] for w in want.values()) > 5
    for k, w in want.items():
        assert got[k][:4] == w[:4] and got[k][4:] == tuple(None if x is None else pytest.approx(x, abs=1e-8) for x in w[4:])
    assert validation.purged_folds(frame.limit(0)).count() == 0


def test_walk_forward(spark):
    # months 0, 1, 2, 5 and 6 have trades: 3 and 4 are empty, month 5 has a single trade
    trades = [(1, dt.datetime(2023, 11, 3), 0.1), (1, dt.datetime(2023, 12, 5), 0.2), (1, dt.datetime(2023, 12, 31, 23), -0.1), (1, dt.datetime(2024, 1, 9), 0.3), (1, dt.datetime(2024, 4, 2), 0.4), (1, dt.datetime(2024, 5, 2), -0.2), (1, dt.datetime(2024, 5, 9), 0.1)]
    trades += [(2, dt.datetime(2024, 1, 9), 0.3), (2, dt.datetime(2024, 2, 9), 0.3)]  # too short for a window
    windows = validation.walk_forward(spark.createDataFrame(trades, RETURNS), inside=2, outside=1)
    got = {(x["strategy_id"], x["month"]): (x["n_inside"], x["n_outside"], round(x["year_inside"], 9), round(x["year_outside"], 9)) for x in windows.collect()}
    assert got == {
        (1, "2024-01"): (3, 1, 1.2, 3.6),
        (1, "2024-02"): (3, 0, 2.4, 0.0),
        (1, "2024-03"): (1, 0, 1.8, 0.0),
        (1, "2024-04"): (0, 1, 0.0, 4.8),
        (1, "2024-05"): (1, 2, 2.4, -1.2),
    }
    row = validation.walk_forward_efficiency(windows).collect()
    assert len(row) == 1 and row[0]["windows"] == 4 and row[0]["efficiency"] == pytest.approx((3.6 - 1.2) / (1.2 + 2.4 + 1.8 + 2.4))


def test_walk_forward_without_return_inside(spark):
    trades = [(1, dt.datetime(2024, m, 5), r) for m, r in ((1, 0.1), (2, -0.1), (3, 0.2))]
    row = validation.walk_forward_efficiency(validation.walk_forward(spark.createDataFrame(trades, RETURNS), 2, 1)).first()
    assert row["efficiency"] is None and row["mean_outside"] == pytest.approx(2.4)


def test_design_gates(spark):
    rows = [(1, 100, 0.5, 2.0, 1.0, 0.2, 0.0, 0.0), (2, 99, 0.5, 2.0, 1.0, 0.2, -1.0, 6.0), (3, 500, 0.81, 1.0, 3.1, 0.1, 0.0, 0.0), (4, 500, 0.80, 1.0, 9.0, 0.1, 0.0, 0.0), (5, 500, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "strategy_id long, total_trades long, win_rate double, average_win double, average_loss double, sharpe_per_trade double, skew_returns double, excess_kurtosis_returns double")
    got = {r["strategy_id"]: tuple(r)[1:] for r in validation.design_gates(frame, F.lit(0.5)).collect()}
    assert got[1] == (0.2, False, False, False, True) and got[2] == (pytest.approx(0.2 * (1 - 0.2 / 6 - 6 * 0.04 / 24)), True, False, False, False)
    assert [got[i][2] for i in (3, 4, 5)] == [True, False, False]
    assert not any(r["passed"] for r in validation.design_gates(frame, F.lit(0.51)).collect()) and validation.design_gates(frame, F.lit(None).cast("double")).filter("passed").count() == 3
