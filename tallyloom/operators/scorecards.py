"""Whole scorecards: everything an evaluation yields for a strategy in one nested row, with the field names that saved cards have.

A card holds its curve as an array up to `most_points` points, as one row is one task's work; a longer curve comes
whole as rows of its own, `curve_parts`, each a stretch of as many points, and the card says null.
"""

from __future__ import annotations

import json
from dataclasses import fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, NumericType, StructType, TimestampNTZType, TimestampType

from ..plans.config import EvalConfig
from . import resample
from .cards import CATEGORIES, card_id
from .cleaning import KEY

# The notice that every card carries.
DISCLAIMER = (
    "Notice: True Walk-Forward Validation and Purged Cross-Validation require strategy engine integration and underlying bar/tick data. "
    "The overfitting risk reported here is a bounded estimate derived exclusively from static trade-history analysis."
)
VERSION = "1.2"
#: Points of a curve that one row holds.
MOST_POINTS = 100_000

# Fields of saved cards; where a metric has another name here, that follows the sign.
METRICS = {
    "basic": "total_trades win_rate loss_rate win_count loss_count tie_count average_win average_loss profit_factor payoff_ratio expectancy_per_trade=expectancy expectancy_per_unit_risk=expectancy_per_risk long_count short_count long_win_rate short_win_rate",
    "growth": "net_pnl total_return cagr cagr_flagged_insufficient mean_return_per_trade median_return_per_trade skew_returns excess_kurtosis_returns",
    "drawdown": "max_drawdown average_drawdown max_drawdown_duration_days ulcer_index recovery_factor mtm_max_drawdown",
    "risk_adj": "sharpe_ratio sharpe_small_sample_corrected sortino_ratio calmar_ratio omega_ratio romad tail_ratio var_95 cvar_95 annualised avg_trades_per_year=trades_per_year probabilistic_sharpe_ratio deflated_sharpe_ratio psr_reference_sharpe dsr_n_trials",
    "behav": "max_win_streak max_loss_streak profit_streak_ratio=streak_ratio runs_z_score=runs_z best_trade worst_trade profitable_month_fraction monthly_return_volatility=monthly_volatility",
}
PENALTIES = ("mdd_40pct", "cvar_10pct", "mc_rr", "n_50", "martingale")
REPORT = "rows_received rows_rejected_schema=rows_rejected rows_deduped=duplicates_removed outliers_tagged adjustments_ignored"


def _named(spec: str) -> list[Column]:
    return [F.col((x.split("=") * 2)[1]).alias(x.split("=")[0]) for x in spec.split()]


def _cusum(prefix: str, config: EvalConfig) -> Column:
    at = lambda c: F.col(f"{prefix}.{c}") if prefix else F.col(c)
    held = F.struct(at("s_plus_peak").alias("cumsum_pos_peak"), at("s_minus_peak").alias("cumsum_neg_peak"), at("threshold_hit").alias("threshold_hit"), at("hits").alias("n_regime_shifts_detected"), F.lit(config.cusum_h).alias("threshold_used"))
    return F.when(at("hits").isNotNull(), held)


def metrics_struct(config: EvalConfig) -> Column:
    check = F.struct(
        _cusum("cusum_first_half", config).alias("cusum_first_half"),
        _cusum("cusum_second_half", config).alias("cusum_second_half"),
        _cusum("", config).alias("cusum_full"),
        "mean_return_gap",
        "sharpe_half_gap",
        F.col("regime_unstable").alias("regime_unstable_flag"),
    ).alias("regime_check")
    groups = [F.struct(*_named(spec), *((check,) if g == "behav" else ())).alias(g) for g, spec in METRICS.items()]
    return F.struct(*groups).alias("metrics")


def scoring_struct() -> Column:
    scored = F.col("status") == "SCORED"
    categories = F.when(scored, F.struct(*(F.col(f"cat_{c}").alias(c) for c in CATEGORIES))).alias("category_scores")
    penalties = F.struct(*(F.col(f"pen_{c}").alias(c) for c in PENALTIES), "penalty_product").alias("penalties")
    return F.struct("status", "knockout_reason", categories, penalties, "raw_score", "final_score", "label").alias("scoring")


def _percentiles(prefix: str) -> Column:
    return F.struct(*(F.col(f"{prefix}.{m}").alias(m) for m in resample.MEASURES)).alias("percentiles")


def resampling(resampled: DataFrame, trades: DataFrame, config: EvalConfig) -> DataFrame:
    """(strategy_id, monte_carlo, moving_block) of the tests' summaries; null where none was run."""
    told = resample.described(resampled, trades, config)
    row = F.struct(*(c for c in told.columns if c not in (*KEY, "test")))
    wide = told.groupBy(*KEY).agg(*(F.max(F.when(F.col("test") == t, row)).alias(t) for t in resample.TESTS))  # one row a test

    def test(t: str) -> Column:
        return F.struct(F.col(f"{t}.iterations").cast("int").alias("iterations"), _percentiles(t), *(F.col(f"{t}.{c}").alias(c) for c in ("robustness_rate", "sharpe_stability", "mdd_2x_probability", "flagged_worse_than_a"))).alias(f"test_{t}")

    flag = F.coalesce(F.col("c.flagged_worse_than_a"), F.lit(False))
    runs = F.struct(*(test(t) for t in ("a", "b", "c")), flag.alias("correlation_flag"), F.when(flag, "test_c").otherwise("test_a").alias("effective_mc_source"))
    block = F.struct(F.col("mb.iterations").cast("int").alias("iterations"), F.col("mb.block_length").cast("int").alias("block_length"), _percentiles("mb"), *(F.col(f"mb.{c}").alias(c) for c in ("robustness_rate", "sharpe_stability", "mean_sharpe", "iid_robustness_rate", "iid_sharpe_stability")), F.col("mb.block_vs_iid_gap").alias("block_vs_iid_rr_gap"))
    return wide.select(*KEY, runs.alias("monte_carlo"), F.when(F.col("mb").isNotNull(), block).alias("moving_block"))


def _long(equity: DataFrame, most_points: int) -> DataFrame:
    """Strategies whose curve has more points; few, as each has so many."""
    return F.broadcast(equity.groupBy(*KEY).agg(F.count("*").alias("_n")).filter(F.col("_n") > most_points).select(*KEY))


def _curve(points: DataFrame, *by: Column) -> DataFrame:
    """One row a strategy (and `by`), its points in order as an array `equity_curve`."""
    held = points.groupBy(*KEY, *by).agg(F.array_sort(F.collect_list(F.struct("seq", "t", "balance", "peak", "dd"))).alias("_curve"))
    return held.withColumn("equity_curve", F.transform("_curve", lambda p: F.struct(p["t"].alias("t"), p["balance"].alias("balance"), p["peak"].alias("peak"), p["dd"].alias("dd")))).drop("_curve")


def _id(name: Column, created: Column, config: EvalConfig) -> Column:
    return card_id(name, created, F.concat_ws(":", F.lit(config.seed), F.col("strategy_id").cast("string"))).alias("id")


def curve_parts(evaluation: Any, name: Column, created: Column, config: EvalConfig, most_points: int = MOST_POINTS) -> DataFrame:
    """(id, first, equity_curve): the curves that are too long for their cards, in stretches of `most_points` points; first: the place of a stretch's first point."""
    points = evaluation.equity.join(_long(evaluation.equity, most_points), KEY, "left_semi")
    first = (F.floor(F.col("seq") / most_points) * most_points).cast("long").alias("first")
    return _curve(points, first).select(_id(name, created, config), "first", "equity_curve")


def whole_cards(evaluation: Any, name: Column, created: Column, config: EvalConfig, files: DataFrame | None = None, most_points: int = MOST_POINTS) -> DataFrame:
    """A card for each strategy of a `plans.evaluate.Evaluation`; `curve_parts` has the curves of more than `most_points` points.

    name, created: expressions on strategy_id. files: (strategy_id, name, sha256, format) of the ledgers' reports, where they come of files.
    """
    # only rows with an opening time of their own could be flagged, and ledgers have none
    report = evaluation.report.select(*KEY, F.struct(*_named(REPORT), F.lit(0).cast("long").alias("rows_flagged_zero_duration"), F.lit(None).cast("string").alias("rejected_file")).alias("cleaning_report"))
    curve = _curve(evaluation.equity.join(_long(evaluation.equity, most_points), KEY, "left_anti"))
    months = evaluation.monthly.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "ret")))).alias("monthly_returns"))
    over = evaluation.overfitting.select(*KEY, "n_obs", "bounded_overfit_flag", "summary")
    rows = evaluation.scored.join(over, KEY).join(report, KEY).join(resampling(evaluation.resampled, evaluation.trades, config), KEY, "left").join(curve, KEY, "left").join(months, KEY, "left")
    given = files.select(*KEY, F.col("name").alias("_file"), "sha256", "format") if files is not None else None
    rows = rows.join(given, KEY, "left") if given is not None else rows.withColumns({c: F.lit(None).cast("string") for c in ("_file", "sha256", "format")})
    source = F.struct(F.coalesce("_file", F.col("strategy_id").cast("string")).alias("name"), "sha256", F.col("cleaning_report.rows_received").alias("rows"), F.coalesce("format", F.lit("unknown")).alias("format"))
    estimate = F.struct(
        F.lit(DISCLAIMER).alias("disclaimer"),
        "n_obs",
        "dsr_n_trials",
        "probabilistic_sharpe_ratio",
        "deflated_sharpe_ratio",
        "regime_unstable",
        F.col("block_robustness_rate").alias("moving_block_robustness_rate"),
        "iid_robustness_rate",
        F.col("block_vs_iid_gap").alias("block_dependence_gap"),
        "bounded_overfit_flag",
        "summary",
    )
    return rows.select(
        _id(name, created, config),
        name.alias("name"),
        created.alias("created_at"),
        F.lit(config.seed).alias("seed"),
        source.alias("input_file"),
        "cleaning_report",
        metrics_struct(config),
        "monte_carlo",
        "moving_block",
        estimate.alias("overfitting"),
        F.coalesce("monte_carlo.correlation_flag", F.lit(False)).alias("correlation_flag"),
        scoring_struct(),
        "equity_curve",
        F.coalesce("monthly_returns", F.create_map().cast("map<string,double>")).alias("monthly_returns"),
        F.lit(DISCLAIMER).alias("disclaimer"),
        F.lit(VERSION).alias("version"),
    )


# ---- schemas


def json_schema(kind: DataType, title: str | None = None) -> dict[str, Any]:
    """A Spark type as JSON Schema; every field may be null."""
    if isinstance(kind, StructType):
        made: dict[str, Any] = {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}}
        return {"title": title} | made if title else made
    if isinstance(kind, ArrayType):
        return {"type": ["array", "null"], "items": json_schema(kind.elementType)}
    if isinstance(kind, MapType):
        return {"type": ["object", "null"], "additionalProperties": json_schema(kind.valueType)}
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return {"type": ["string", "null"], "format": "date-time"}
    if isinstance(kind, BooleanType):
        return {"type": ["boolean", "null"]}
    if isinstance(kind, NumericType):
        return {"type": ["integer" if isinstance(kind, IntegralType) else "number", "null"]}
    return {"type": ["string", "null"]}


_PYTHON = {"float": "number", "int": "integer", "str": "string", "int | None": ["integer", "null"], "tuple[float, ...]": "array"}


def schemas(found: DataFrame) -> dict[str, dict[str, Any]]:
    """The six schemas of cards, by name: whole cards, their parts, and the settings of an evaluation."""
    of = lambda column: found.schema[column].dataType
    parts = {"Metrics": of("metrics"), "Scorecard": found.schema, "ScoringResult": of("scoring"), "MonteCarloResult": of("monte_carlo"), "OverfittingEstimate": of("overfitting")}
    settings = {f.name: {"type": _PYTHON[str(f.type)]} for f in fields(EvalConfig)}
    return {n: json_schema(k, n) for n, k in parts.items()} | {"ScoringConfig": {"title": "ScoringConfig", "type": "object", "properties": settings, "required": ["n_trials", "sr_trials"]}}


def schemas_json(found: DataFrame) -> str:
    return json.dumps(schemas(found), indent=1)
