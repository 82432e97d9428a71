"""The gated, weighted score of 0 to 100, as projections over a strategy's metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import falling_sigmoid, label, piecewise, sigmoid
from ..plans.config import EPS
from .cleaning import KEY

# Weights of the categories and anchors of the piecewise scales.
WEIGHTS = {"profitability": 0.175, "risk_adj": 0.175, "drawdown": 0.15, "robustness": 0.35, "sanity": 0.075, "sufficiency": 0.075}
SHARE_ANCHORS = [(0.0, 0.0), (0.5, 4.0), (0.8, 7.0), (0.95, 10.0)]
STREAK_ANCHORS = [(3.0, 10.0), (6.0, 6.0), (10.0, 2.0), (15.0, 0.0)]
COUNT_ANCHORS = [(10.0, 2.0), (30.0, 5.0), (100.0, 8.0), (500.0, 10.0)]
OUTLIER_ANCHORS = [(0.01, 10.0), (0.05, 6.0), (0.15, 2.0), (0.25, 0.0)]
# Wording of the reasons.
KNOCKOUTS = {
    "trades": "Insufficient sample size: N=%d < 30 trades required for any statistical confidence.",
    "profit_factor": "Profit Factor %.3f < 1.0 — strategy is unprofitable before costs; no further scoring warranted.",
    "drawdown": "Maximum Drawdown magnitude %.1f%% exceeds 35%% — catastrophic capital loss inadmissible per risk mandate.",
    "dsr": "Corrected DSR %.3f < 0.05 — automatic evaluation FAIL (insufficient deflated significance).",
    "mtm": "Continuous MTM max drawdown %.1f%% exceeds 25%% — fail due to floating equity risk.",
}


def knockout_reason() -> Column:
    """All reasons that rule a strategy out, joined; null for none."""
    n, pf, mdd = F.col("total_trades"), F.col("profit_factor"), F.abs("max_drawdown")
    dsr, mtm = F.col("deflated_sharpe_ratio"), F.abs("mtm_max_drawdown")
    reasons = F.concat_ws(
        " | ",
        F.when(n < 30, F.format_string(KNOCKOUTS["trades"], n)),
        F.when(pf < 1.0, F.format_string(KNOCKOUTS["profit_factor"], pf)),
        F.when(mdd > 0.35, F.format_string(KNOCKOUTS["drawdown"], mdd * 100)),
        F.when(dsr < 0.05, F.format_string(KNOCKOUTS["dsr"], dsr)),
        F.when(mtm > 0.25, F.format_string(KNOCKOUTS["mtm"], mtm * 100)),
    )
    return F.when(reasons != "", reasons)


def _x(c: str) -> Column:
    return F.col(c).cast("double")


def categories() -> dict[str, Column]:
    """The six category scores, 0 to 10."""
    zero = F.lit(0.0)
    calmar, share = F.coalesce(_x("calmar_ratio"), zero), F.coalesce(_x("profitable_month_fraction"), zero)
    at_most = lambda x, top, when: F.when(when, F.least(F.lit(top), x)).otherwise(x)
    above = lambda c, middle, slope: F.when(c > 0, sigmoid(c, middle, slope)).otherwise(0.0)
    n = _x("total_trades")
    return {
        "profitability": 0.35 * sigmoid(_x("profit_factor"), 1.5, 2.5) + 0.20 * sigmoid(_x("win_rate"), 0.5, 6) + 0.20 * sigmoid(_x("payoff_ratio"), 1.5, 2) + 0.25 * above(_x("expectancy_per_risk"), 0.2, 4),
        "risk_adj": 0.40 * above(_x("sharpe_ratio"), 1, 2.2) + 0.30 * sigmoid(_x("sortino_ratio"), 1.5, 1.8) + 0.30 * above(calmar, 1, 2.5),
        "drawdown": 0.45 * falling_sigmoid(F.abs("max_drawdown"), 0.2, 15) + 0.25 * falling_sigmoid(_x("ulcer_index"), 0.08, 40) + 0.30 * at_most(sigmoid(_x("recovery_factor"), 2, 2), 1.0, _x("recovery_factor") <= 0.5),
        "robustness": 0.35 * piecewise(_x("robustness_rate"), SHARE_ANCHORS) + 0.25 * piecewise(_x("sharpe_stability"), SHARE_ANCHORS) + 0.20 * falling_sigmoid(F.abs("runs_z"), 1.96, 3) + 0.20 * sigmoid(share, 0.6, 6),
        "sanity": 0.35 * at_most(sigmoid(_x("skew_returns"), 0.5, 2.5), 2.0, _x("skew_returns") < -0.5) + 0.25 * falling_sigmoid(_x("excess_kurtosis_returns"), 3, 1.5) + 0.20 * at_most(sigmoid(_x("tail_ratio"), 1, 4), 2.0, _x("tail_ratio") <= 0.7) + 0.20 * piecewise(_x("max_loss_streak"), STREAK_ANCHORS),
        "sufficiency": 0.60 * F.when(n < 10, 0.0).otherwise(piecewise(n, COUNT_ANCHORS)) + 0.40 * piecewise(_x("outliers_tagged") / F.greatest(F.lit(1.0), _x("rows_received")), OUTLIER_ANCHORS),
    }


def penalties() -> dict[str, Column]:
    """Factors of up to 1 on the raw score."""
    one = F.lit(1.0)
    ratio = _x("average_loss") / F.greatest(F.lit(EPS), _x("average_win"))
    n = _x("total_trades")
    martingale = (_x("win_rate") > 0.75) & (ratio > 2)
    return {
        "mdd_40pct": F.when(F.abs("max_drawdown") > 0.4, F.greatest(F.lit(0.5), 1 - 2 * (F.abs("max_drawdown") - 0.4))).otherwise(one),
        "cvar_10pct": F.when(_x("cvar_95") > 0.1, F.greatest(F.lit(0.6), 1 - 4 * (_x("cvar_95") - 0.1))).otherwise(one),
        "mc_rr": F.when(_x("robustness_rate") < 0.5, F.greatest(F.lit(0.5), _x("robustness_rate") / 0.5)).otherwise(one),
        "n_50": F.when(n < 50, F.greatest(F.lit(0.85), n / 50)).otherwise(one),
        "martingale": F.when(martingale, F.greatest(F.lit(0.01), F.least(one, F.exp(-1.5 * ratio - 2)))).otherwise(one),
    }


def with_categories(metrics: DataFrame) -> DataFrame:
    return metrics.select("*", *(c.alias(f"cat_{k}") for k, c in categories().items()))


def with_penalties(metrics: DataFrame) -> DataFrame:
    out = metrics.select("*", *(c.alias(f"pen_{k}") for k, c in penalties().items()))
    product = F.lit(1.0)
    for k in penalties():
        product = product * F.col(f"pen_{k}")
    return out.withColumn("penalty_product", product)


def score(metrics: DataFrame) -> DataFrame:
    """Adds status, knockout_reason, categories, penalties, raw_score, final_score and label.

    A strategy that is knocked out scores 0, without categories and penalties.
    """
    out = with_penalties(with_categories(metrics)).withColumn("knockout_reason", knockout_reason())
    alive = F.col("knockout_reason").isNull()
    raw = F.lit(0.0)
    for k, w in WEIGHTS.items():
        raw = raw + w * F.col(f"cat_{k}")
    out = out.withColumn("raw_score", F.when(alive, F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw))))
    hidden = {f"cat_{k}": F.when(alive, F.col(f"cat_{k}")) for k in WEIGHTS} | {f"pen_{k}": F.when(alive, F.col(f"pen_{k}")).otherwise(1.0) for k in penalties()}
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 10 * F.col("raw_score") * F.col("penalty_product")))
    out = out.withColumn("final_score", F.when(alive, F.bround(total, 0).cast("int")).otherwise(0))
    return out.withColumns(hidden | {"penalty_product": F.when(alive, F.col("penalty_product")).otherwise(1.0), "status": F.when(alive, "SCORED").otherwise("KNOCKED_OUT"), "label": F.when(alive, label(F.col("final_score"))).otherwise("KNOCKED_OUT")})


def overfitting(metrics: DataFrame) -> DataFrame:
    """(strategy_id, n_obs, dsr_weak, regime_unstable, block_dependence, bounded_overfit_flag, summary)."""
    dsr, psr, gap = F.col("deflated_sharpe_ratio"), F.col("probabilistic_sharpe_ratio"), F.col("block_vs_iid_gap")
    weak, depends = F.coalesce(dsr < 0.95, F.lit(False)), F.coalesce(gap > 0.10, F.lit(False))
    flag = weak | F.col("regime_unstable") | depends
    # Wording of the summary.
    summary = F.concat_ws(
        "; ",
        F.when(dsr.isNotNull(), F.format_string("DSR=%.3f (N_trials=%d)", dsr, F.col("dsr_n_trials"))),
        F.when(psr.isNotNull(), F.format_string("PSR=%.3f (N_obs=%d)", psr, F.col("total_trades"))),
        F.when(F.col("regime_unstable"), "regime unstable (CUSUM/half-sample)"),
        F.when(gap.isNotNull(), F.format_string("block−iid RR gap=%+.3f", gap)),
        F.when(flag, "bounded overfit risk elevated").otherwise("no elevated bounded-overfit flag"),
    )
    return metrics.select(*KEY, F.col("total_trades").alias("n_obs"), weak.alias("dsr_weak"), "regime_unstable", depends.alias("block_dependence"), flag.alias("bounded_overfit_flag"), summary.alias("summary"))
