"""Measures of backtest overfitting: combinatorially symmetric and purged cross-validation, walk-forward efficiency.

All of them work on sums that add up: (n, sum, sum of squares) of returns by block, fold or month. No row is made for a
trade and a combination, fold or window.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import EPS
from ..plans.lineage import settle
from .cleaning import KEY

#: Digits of a Sharpe ratio by which strategies are ranked, so that ranks do not hang on the order of sums.
RANKED = 9
#: Ratios of strategies by combinations that a task holds at a time.
CELLS = 1 << 20


# ---- combinatorially symmetric cross-validation


def block_sums(returns: DataFrame, blocks: int) -> DataFrame:
    """(strategy_id, n, s, q): arrays with a strategy's count, sum and sum of squares of returns in each of `blocks` equal stretches of the time that all strategies span.

    returns: (strategy_id, timestamp, R).
    """
    at = F.unix_micros("timestamp")
    low, high = returns.agg(F.min(at), F.max(at)).first()
    if low is None:
        low = high = 0
    rows = returns.select(*KEY, "R", F.expr(f"cast((unix_micros(timestamp) - {low}) * {blocks} div {high - low + 1} as int)").alias("_b"))
    parts = [f(i) for f in (lambda i: F.count_if(F.col("_b") == i).alias(f"n{i}"), lambda i: F.sum(F.when(F.col("_b") == i, F.col("R")).otherwise(0.0)).alias(f"s{i}"), lambda i: F.sum(F.when(F.col("_b") == i, F.col("R") * F.col("R")).otherwise(0.0)).alias(f"q{i}")) for i in range(blocks)]
    sums = rows.groupBy(*KEY).agg(*parts)
    return sums.select(*KEY, *(F.array(*(F.col(f"{c}{i}").cast("double") for i in range(blocks))).alias(c) for c in "nsq"))


def _ratio(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sharpe ratios from counts, sums and sums of squares; 0 for fewer than two returns or equal ones."""
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = np.sqrt(np.maximum(0.0, (q - s * s / n) / (n - 1)))
        out = np.where((n >= 2) & (sd > EPS), s / n / sd, 0.0)
    return np.round(out, RANKED) + 0.0


def cscv(returns: DataFrame, blocks: int = 8) -> DataFrame:
    """A row for each choice of half the blocks: in_sample (a number with their bits set), the strategy best in them, its Sharpe
    ratio in and out of them, its relative rank among all strategies outside (1/(N+1) worst, N/(N+1) best) and that rank's logit.

    Two passes over one row a strategy: tasks hand on their best strategy for each choice, then how many strategies
    are below and level with the best one outside; both are bounded by the number of choices, at most 12,870
    (`blocks` is even, 16 at most). Of strategies equally good inside the one with the smallest id is chosen; level ones
    share their mean rank. Empty returns give no rows.
    """
    if blocks % 2 or not 2 <= blocks <= 16:
        raise ValueError("blocks must be an even number from 2 to 16")
    spark = returns.sparkSession
    chosen = list(combinations(range(blocks), blocks // 2))
    inside = np.zeros((len(chosen), blocks))
    for i, c in enumerate(chosen):
        inside[i, list(c)] = 1.0
    masks = np.array([sum(1 << b for b in c) for c in chosen], np.int64)
    sums = settle(block_sums(returns.filter("R IS NOT NULL AND timestamp IS NOT NULL AND strategy_id IS NOT NULL"), blocks))
    kind = sums.schema["strategy_id"].dataType.simpleString()

    def both(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        n_rows = max(1, CELLS // len(inside))
        for at in range(0, len(batch), n_rows):
            part = batch.slice(at, n_rows)
            sums_of = [part.column(x).flatten().to_numpy().reshape(len(part), blocks) for x in "nsq"]
            yield part, _ratio(*(x @ inside.T for x in sums_of)), _ratio(*(x @ (1 - inside).T for x in sums_of))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = pc.sort_indices(b.column("strategy_id"))
            for part, within, out in both(b.take(order)):
                top = within.argmax(axis=0)  # the first of equal ones, which has the smallest id
                cell = np.arange(len(masks))
                yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(within[top, cell]), part.column("strategy_id").take(pa.array(top)), pa.array(out[top, cell])], ["in_sample", "r", "strategy_id", "o"])

    tops = sums.mapInArrow(best, f"in_sample long, r double, strategy_id {kind}, o double")
    tops = tops.groupBy("in_sample").agg(F.min(F.struct((-F.col("r")).alias("r"), "strategy_id", "o")).alias("b")).select("in_sample", "b.strategy_id", (-F.col("b.r") + 0.0).alias("in_sharpe"), F.col("b.o").alias("out_sharpe"))
    tops = settle(tops)
    bar = dict(tops.select("in_sample", "out_sharpe").collect())  # a row for each choice of blocks
    level = spark.sparkContext.broadcast(np.array([bar.get(int(m), 0.0) for m in masks]))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, equal, n = np.zeros(len(masks), np.int64), np.zeros(len(masks), np.int64), 0
        for b in batches:
            for part, _, out in both(b):
                below += (out < level.value).sum(axis=0)
                equal += (out == level.value).sum(axis=0)
                n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(below), pa.array(equal), pa.array(np.full(len(masks), n))], ["in_sample", "below", "equal", "n"])

    counts = sums.mapInArrow(ranks, "in_sample long, below long, equal long, n long").groupBy("in_sample").agg(*(F.sum(c).alias(c) for c in ("below", "equal", "n")))
    rank = (F.col("below") + (F.col("equal") + 1) / 2) / (F.col("n") + 1)
    out = tops.join(counts, "in_sample").withColumn("relative_rank", rank)
    return out.select("in_sample", F.col("strategy_id").alias("best_strategy"), "in_sharpe", "out_sharpe", "relative_rank", F.log(F.col("relative_rank") / (1 - F.col("relative_rank"))).alias("logit"))


def overfitting_probability(choices: DataFrame) -> DataFrame:
    """One row of `cscv`'s: combinations, pbo (share of them whose best strategy ranks below the middle outside), probability of a
    loss outside, mean logit, and the slope of ratios outside against inside."""
    return choices.agg(
        F.count("*").alias("combinations"),
        F.avg((F.col("relative_rank") < 0.5).cast("double")).alias("pbo"),
        F.avg((F.col("out_sharpe") < 0).cast("double")).alias("loss_probability"),
        F.avg("logit").alias("mean_logit"),
        F.regr_slope("out_sharpe", "in_sharpe").alias("degradation"),
    )


# ---- purged and embargoed cross-validation


def _sharpe(n: Column, s: Column, q: Column) -> Column:
    sd = F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
    return F.when((n >= 2) & (sd > EPS), s / n / sd).otherwise(0.0)


def purged_folds(trades: DataFrame, folds: int = 5, embargo: float = 0.01) -> DataFrame:
    """A row for each strategy and test fold: n_test, n_purged, n_embargoed, n_train, and mean and Sharpe ratio of both sides.

    trades: (strategy_id, seq, entry, exit, R), seq from 1 in the order of time, entry and exit in microseconds. Folds are
    runs of consecutive trades, as even as they can be; a fold's span goes from its first entry to its last exit.
    Of the other trades those that were open at any time of the span are purged, and those entered after it within
    `embargo` of the strategy's whole time are embargoed. What training keeps is the strategy's sums less those of
    the fold and of what was removed. A strategy's spans, at most `folds`, are one small array that meets its trades where they
    are; the spans a trade meets are summed up there, so no copy of a trade is dealt. A strategy with fewer
    trades than folds has fewer folds; a trade with entry and exit swapped counts from the earlier to the later.
    """
    rows = trades.select(*KEY, "seq", F.least("entry", "exit").alias("start"), F.greatest("entry", "exit").alias("end"), "R")
    whole = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("R").alias("s"), F.sum(F.col("R") * F.col("R")).alias("q"), F.floor(F.lit(embargo) * (F.max("end") - F.min("start"))).alias("gap"))
    rows = rows.join(whole.select(*KEY, "n"), KEY)
    rows = rows.withColumn("fold", F.expr(f"cast((seq - 1) * {folds} div n as int)")).drop("n")
    tests = rows.groupBy(*KEY, "fold").agg(F.count("*").alias("n_test"), F.sum("R").alias("_s"), F.sum(F.col("R") * F.col("R")).alias("_q"), F.min("start").alias("begin"), F.max("end").alias("last"))
    tests = settle(tests.join(whole, KEY))
    span = F.struct(F.col("fold").alias("test"), "begin", "last", (F.col("last") + F.col("gap")).alias("finish"))
    spans = tests.groupBy(*KEY).agg(F.collect_list(span).alias("spans"))
    meets = lambda x: (x["test"] != F.col("fold")) & (F.col("start") <= x["finish"]) & (x["begin"] <= F.col("end"))
    met = rows.join(spans, KEY).select(*KEY, "start", "R", F.explode(F.filter("spans", meets)).alias("x"))
    held = F.col("start") <= F.col("x.last")
    gone = met.groupBy(*KEY, F.col("x.test").alias("fold")).agg(F.count_if(held).alias("n_purged"), F.count_if(~held).alias("n_embargoed"), F.sum("R").alias("_gs"), F.sum(F.col("R") * F.col("R")).alias("_gq"))
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    all_rows = tests.join(gone, [*KEY, "fold"], "left").withColumns({"n_purged": F.coalesce("n_purged", none), "n_embargoed": F.coalesce("n_embargoed", none)})
    all_rows = all_rows.withColumns({"n_train": F.col("n") - F.col("n_test") - F.col("n_purged") - F.col("n_embargoed"), "_ts": F.col("s") - F.col("_s") - F.coalesce("_gs", zero), "_tq": F.col("q") - F.col("_q") - F.coalesce("_gq", zero)})
    return all_rows.select(
        *KEY,
        "fold",
        "n_test",
        "n_purged",
        "n_embargoed",
        "n_train",
        F.when(F.col("n_train") > 0, F.col("_ts") / F.col("n_train")).alias("train_mean"),
        (F.col("_s") / F.col("n_test")).alias("test_mean"),
        _sharpe(F.col("n_train"), F.col("_ts"), F.col("_tq")).alias("train_sharpe"),
        _sharpe(F.col("n_test"), F.col("_s"), F.col("_q")).alias("test_sharpe"),
    )


# ---- walk-forward


def walk_forward(returns: DataFrame, inside: int = 6, outside: int = 2) -> DataFrame:
    """A row for each strategy and window: month (its first month outside), trades and return in a year inside and outside of it.

    returns: (strategy_id, timestamp, R). `inside` months are followed by `outside` months, and windows move on by `outside`; the
    first begins with the strategy's first month, the last one ends by its last month. Months are sums, combined by
    range frames over a strategy's months; months without trades count as such.
    """
    month = (F.year("timestamp") * 12 + F.month("timestamp") - 1).alias("m")
    sums = returns.groupBy(*KEY, month).agg(F.count("*").alias("n"), F.sum("R").alias("s"))
    ends = sums.groupBy(*KEY).agg(F.min("m").alias("a"), F.max("m").alias("z"))
    starts = ends.filter(F.col("z") - F.col("a") + 1 >= inside + outside).select(*KEY, F.explode(F.sequence(F.col("a") + inside, F.col("z") - outside + 1, F.lit(outside))).alias("m"))
    rows = sums.withColumn("_start", F.lit(0)).unionByName(starts.select(*KEY, "m", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(1).alias("_start")))
    by_month = Window.partitionBy(*KEY).orderBy("m")
    before, after = by_month.rangeBetween(-inside, -1), by_month.rangeBetween(0, outside - 1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = rows.select(*KEY, "m", "_start", total("n", before).alias("n_inside"), total("n", after).alias("n_outside"), (total("s", before) * 12 / inside).alias("year_inside"), (total("s", after) * 12 / outside).alias("year_outside"))
    return rows.filter("_start = 1").select(*KEY, F.format_string("%04d-%02d", F.expr("m div 12").cast("int"), (F.col("m") % 12 + 1).cast("int")).alias("month"), "n_inside", "n_outside", "year_inside", "year_outside")


def walk_forward_efficiency(windows: DataFrame) -> DataFrame:
    """(strategy_id, windows, mean_inside, mean_outside, efficiency) of `walk_forward`'s rows: mean return outside over mean return inside.

    Windows without a trade inside, from which nothing could be chosen, are left out; a mean of 0 inside gives no efficiency.
    """
    a = windows.filter("n_inside > 0").groupBy(*KEY).agg(F.count("*").alias("windows"), F.avg("year_inside").alias("mean_inside"), F.avg("year_outside").alias("mean_outside"))
    return a.withColumn("efficiency", F.when(F.abs("mean_inside") > EPS, F.col("mean_outside") / F.col("mean_inside")))


# ---- gates of the design that the score itself does not have


def adjusted_sharpe(sharpe: Column, skew: Column, excess_kurtosis: Column) -> Column:
    """A Sharpe ratio less what negative skewness and fat tails take from it."""
    return sharpe * (1 + skew / 6 * sharpe - excess_kurtosis / 24 * sharpe * sharpe)


def design_gates(metrics: DataFrame, pbo: Column, least_trades: int = 100, win_rate: float = 0.8, loss_ratio: float = 3.0, most_pbo: float = 0.5) -> DataFrame:
    """(strategy_id, adjusted_sharpe, too_few_trades, martingale, overfit, passed): stricter gates beside the knockouts of the score.

    metrics: total_trades, win_rate, average_win, average_loss, sharpe_per_trade, skew_returns and excess_kurtosis_returns by
    strategy; pbo: the probability of overfitting of the strategies' selection, null where unknown, which passes.
    """
    few = F.col("total_trades") < least_trades
    uneven = (F.col("win_rate") > win_rate) & (F.col("average_loss") / F.greatest(F.lit(EPS), F.col("average_win")) > loss_ratio)
    overfit = F.coalesce(pbo > most_pbo, F.lit(False))
    adjusted = adjusted_sharpe(F.col("sharpe_per_trade"), F.col("skew_returns"), F.col("excess_kurtosis_returns"))
    return metrics.select(*KEY, adjusted.alias("adjusted_sharpe"), few.alias("too_few_trades"), uneven.alias("martingale"), overfit.alias("overfit"), (~few & ~uneven & ~overfit).alias("passed"))
