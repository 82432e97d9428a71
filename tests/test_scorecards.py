"""Whole scorecards: every part is there, saved ones load, schemas describe them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cards, presentation, scorecards
from tallyloom.plans import catalogue, evaluate
from tallyloom.plans.config import EvalConfig
from tallyloom.sources import adapters

CONFIG = EvalConfig(seed="11", mc_iterations=20)


@pytest.fixture(scope="module")
def found(spark):
    r = random.Random(2)
    rows = [(s, i, f"2024-0{1 + i // 10}-{1 + i % 10:02d} 10:00:00", "buy", round(r.gauss(8, 30), 2)) for s, n in ((1, 45), (2, 3)) for i in range(n)]
    frame = spark.createDataFrame(rows, "strategy_id long, row_idx long, timestamp string, side string, pnl double")
    filled = {c: F.lit(None).cast("string") for c in ("position_id", "deal_id")} | {"symbol": F.lit("X")} | {c: F.lit(None).cast("double") for c in ("gross_pnl", "commission", "swap", "balance")} | {c: F.lit(1.0) for c in ("quantity", "entry_price", "exit_price")}
    bronze = frame.withColumns(filled).select("strategy_id", "row_idx", *adapters.CANONICAL)
    files = spark.createDataFrame([(1, "a.csv", "00ff", "csv")], "strategy_id long, name string, sha256 string, format string")
    done = evaluate.evaluate(bronze, CONFIG)
    made = scorecards.whole_cards(done, F.lit("My Test"), F.lit("2025-01-02").cast("timestamp"), CONFIG, files, most_points=40)
    return made.cache()


def test_every_part(found):
    got = {r["input_file"]["name"]: r for r in found.collect()}
    long, short = got["a.csv"], got["2"]
    assert long["input_file"].asDict() == {"name": "a.csv", "sha256": "00ff", "rows": 45, "format": "csv"} and short["input_file"]["format"] == "unknown"
    assert long["id"].startswith("my-test-20250102-") and long["seed"] == "11" and long["version"] == "1.2" and long["disclaimer"].startswith("Notice")
    assert long["equity_curve"] is None and len(short["equity_curve"]) == 4  # 45 trades make more points than were asked for
    assert short["equity_curve"][0]["balance"] == 10_000.0 and sorted(long["monthly_returns"]) == ["2024-02", "2024-03", "2024-04", "2024-05"]
    for t in ("test_a", "test_b", "test_c"):
        assert long["monte_carlo"][t]["iterations"] == 20 and len(long["monte_carlo"][t]["percentiles"]["max_drawdown"]) == 7
    assert long["monte_carlo"]["test_b"]["mdd_2x_probability"] is not None and long["monte_carlo"]["test_c"]["flagged_worse_than_a"] == long["correlation_flag"]
    assert long["moving_block"]["block_length"] == 7 and long["moving_block"]["iid_robustness_rate"] == long["monte_carlo"]["test_a"]["robustness_rate"]
    check = long["metrics"]["behav"]["regime_check"]
    assert check["cusum_full"]["threshold_used"] == 4.0 and check["cusum_first_half"] is not None and short["metrics"]["behav"]["regime_check"]["cusum_first_half"] is None
    assert short["scoring"]["status"] == "KNOCKED_OUT" and short["scoring"]["category_scores"] is None and short["scoring"]["penalties"]["penalty_product"] == 1.0
    assert long["cleaning_report"]["rows_received"] == 45 and long["overfitting"]["n_obs"] == 45 and long["overfitting"]["dsr_n_trials"] == 2


def test_a_saved_card_loads(spark, found):
    card = {
        "id": "old-20240101-abcd",
        "name": "old",
        "created_at": "2024-01-01T10:00:00",
        "seed": "5",
        "input_file": {"name": "x.html", "sha256": "aa", "rows": 3, "format": "ctrader_html"},
        "metrics": {"basic": {"total_trades": 3, "expectancy_per_trade": 1.5, "expectancy_per_unit_risk": 0.5}, "risk_adj": {"avg_trades_per_year": 12.0}, "behav": {"runs_z_score": -1.0, "regime_check": {"cusum_full": {"cumsum_pos_peak": 2.0, "threshold_hit": False}}}},
        "monte_carlo": {"test_a": {"iterations": 1000, "percentiles": {"total_return": [0.0] * 7}}, "effective_mc_source": "test_a"},
        "equity_curve": [{"t": "2024-01-01T09:00:00", "balance": 10000.0, "peak": 10000.0, "dd": 0.0}],
        "monthly_returns": {"2024-01": 0.01},
        "scoring": {"status": "SCORED", "final_score": 61, "label": "Solid"},
    }
    row = cards.from_json(spark.createDataFrame([("x", json.dumps(card))], "id string, document string"), found.schema).first().asDict(recursive=True)

    def held(part, whole):
        if isinstance(part, dict):
            return all(held(v, whole[k]) for k, v in part.items())
        return str(whole).replace(" ", "T")[: len(part)] == part if isinstance(part, str) and not isinstance(whole, str) else part == whole

    assert all(held(v, row[k]) for k, v in card.items() if k != "equity_curve") and row["equity_curve"][0]["balance"] == 10_000.0


def test_cards_come_back_from_json(found):
    back = cards.from_json(cards.as_json(found), found.schema)
    flat = lambda f: sorted(r["d"] for r in cards.as_json(f).select(F.col("document").alias("d")).collect())
    assert flat(back) == flat(found)


def test_schemas(found):
    made = json.loads(scorecards.schemas_json(found))
    assert set(made) == {"Metrics", "Scorecard", "ScoringResult", "MonteCarloResult", "OverfittingEstimate", "ScoringConfig"}
    card = made["Scorecard"]["properties"]
    assert card["created_at"]["format"] == "date-time" and card["monthly_returns"]["additionalProperties"]["type"] == ["number", "null"]
    assert card["metrics"]["properties"]["basic"]["properties"]["total_trades"]["type"] == ["integer", "null"]
    assert made["ScoringConfig"]["properties"]["n_trials"]["type"] == "integer" and card["equity_curve"]["items"]["type"] == "object"


def test_overfit_table(found):
    rows = {}
    for r in presentation.overfit_table(found).collect():
        rows.setdefault(r["id"], {})[r["signal"]] = r["value"]
    card = {r["id"]: r for r in found.collect()}
    for i, table in rows.items():
        o = card[i]["overfitting"]
        assert len(table) == 13 and table["N_obs (PSR sample size)"] == str(o["n_obs"]) and table["Regime unstable (CUSUM)"] == ("yes" if o["regime_unstable"] else "no")
        psr = o["probabilistic_sharpe_ratio"]
        assert table["Probabilistic Sharpe (PSR)"] == ("—" if psr is None else f"{psr:.4f}") and table["i.i.d. RR (Test A)"] == f"{o['iid_robustness_rate'] * 100:.1f}%"
        assert table["Moving-block L"] == str(card[i]["moving_block"]["block_length"])


def test_radar_and_overlay(found):
    card = {r["id"]: r for r in found.collect()}
    radar = {}
    for r in presentation.radar_chart(found).collect():
        radar.setdefault(r["id"], {})[r["category"]] = r["value"]
    for i, values in radar.items():
        held = card[i]["scoring"]["category_scores"]
        assert list(values) == ["Profit", "RiskAdj", "DD", "Robust", "Sanity", "Suff"] and values["DD"] == (held["drawdown"] if held else 0.0)
    short = next(c for c in card.values() if c["equity_curve"])
    lines = [tuple(r) for r in presentation.equity_overlay(found).orderBy("place").collect()]
    assert [(x[0], x[1], x[4]) for x in lines] == [(short["id"], f"{short['name']} ({short['scoring']['final_score']})", p["balance"]) for p in short["equity_curve"]]


def test_long_curves_come_in_parts(spark, tmp_path, monkeypatch):
    """Curves too long for a card's row are whole in the query, and in order in the chart."""
    r = random.Random(5)
    rows = [(i, u, f"2024-01-0{1 + i // 20} 10:{i % 60:02d}:00", "view", round(r.uniform(1, 9), 2)) for u, n in ((1, 95), (2, 12)) for i in range(n)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(f"{tmp_path}/events.parquet")
    few = EvalConfig(seed="7", mc_iterations=5)
    monkeypatch.setattr(catalogue, "CONFIG", few)
    query = lambda: {x["name"]: x for x in catalogue.QUERIES["scorecards_whole"](spark, str(tmp_path)).collect()}
    whole = query()
    monkeypatch.setattr(scorecards, "MOST_POINTS", 40)
    assert query() == whole and {n: x["points"] for n, x in whole.items()} == {"User 1": 96, "User 2": 13}
    done = evaluate.evaluate(catalogue.ledger(spark, str(tmp_path)), few)
    made = (done, F.lit("My Test"), F.lit("2025-01-02").cast("timestamp"), few)
    parts = scorecards.curve_parts(*made, most_points=40)
    assert [(x["first"], len(x["equity_curve"])) for x in parts.orderBy("first").collect()] == [(0, 40), (40, 40), (80, 16)]
    drawn = lambda most: presentation.equity_overlay(scorecards.whole_cards(*made, most_points=most), scorecards.curve_parts(*made, most_points=most)).orderBy("id", "place").collect()
    assert drawn(40) == drawn(100) and len(drawn(40)) == 109
