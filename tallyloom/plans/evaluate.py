"""The evaluation of ledgers: one lazy plan from bronze rows to scorecards, many strategies at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cards, cleaning, metrics, resample, scans, scoring, series
from .config import EvalConfig
from .lineage import settle

#: Tests of which metrics, score and estimate take something.
SCORED_TESTS = ("a", "c", "mb")


@dataclass
class Evaluation:
    trades: DataFrame
    rejects: DataFrame
    report: DataFrame
    facts: DataFrame
    metrics: DataFrame
    resampled: DataFrame
    scored: DataFrame
    overfitting: DataFrame
    equity: DataFrame
    monthly: DataFrame


def shared(df: DataFrame) -> DataFrame:
    """The frame, kept on first use for the branches that start from it (on disk where memory is short)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def scalars(facts: DataFrame, report: DataFrame, config: EvalConfig, tests: tuple[str, ...] = resample.TESTS) -> tuple[DataFrame, DataFrame]:
    """All metrics with resampling outcomes and the report's counts, and the resampling summaries."""
    found = settle(metrics.all_metrics(facts, config))
    # a row for each strategy and test, from which score, estimate and cards all start
    resampled = settle(resample.run_tests(facts, config, found.select("strategy_id", "trades_per_year"), found.select("strategy_id", "max_drawdown"), tests))
    counts = report.select("strategy_id", "rows_received", "outliers_tagged")
    return found.join(resample.correlation(resampled.filter("test <> 'b'")), "strategy_id", "left").join(counts, "strategy_id"), resampled


def evaluate(bronze: DataFrame, config: EvalConfig, tests: tuple[str, ...] = resample.TESTS) -> Evaluation:
    """Everything an evaluation yields; cleaning, metrics and resampling run at once, the rest when it is used.

    tests: those whose summaries are wanted; metrics, score and estimate start from `SCORED_TESTS`, only whole cards show test B.

    Trades are settled, dealt by strategy once and kept with their series (on disk where memory is short): a
    dozen branches start from them, and none has to shuffle them again. `facts.unpersist()` frees them.
    """
    flags = cleaning.flagged(bronze)
    trades = settle(cleaning.trades_of(flags, config))
    # chunks of strategies stay as they are dealt
    facts = shared(metrics.trade_facts(trades if scans.CHUNK in trades.columns else trades.repartition("strategy_id"), config))
    report = settle(cleaning.report_of(flags, trades))
    joined, resampled = scalars(facts, report, config, tests)
    equity = series.curve_points(facts, config)
    return Evaluation(trades, cleaning.rejects_of(flags), report, facts, joined, resampled, scoring.score(joined), scoring.overfitting(joined), equity, series.monthly_returns(equity))


def scorecards(evaluation: Evaluation, name: Column, created: Column, config: EvalConfig) -> DataFrame:
    return cards.cards(evaluation.scored, name, created, config.seed)


def overview(bronze: DataFrame, config: EvalConfig) -> DataFrame:
    """(strategy_id, total_trades, win_rate, profit_factor, max_drawdown, total_return): the shortest useful answer."""
    facts = settle(series.with_equity(cleaning.clean(bronze, config).trades, config))
    fallen = metrics.drawdown(facts, config).select("strategy_id", "max_drawdown", "recovery_factor")
    net = facts.groupBy("strategy_id").agg((F.sum("capped_pnl") / config.start_balance).alias("total_return"))
    return metrics.basic(facts).select("strategy_id", "total_trades", "win_rate", "profit_factor").join(fallen, "strategy_id").join(net, "strategy_id")
