"""Metric groups, a row for each strategy.

`trade_facts` computes every series that the groups need over one partitioning by strategy; each group is
then a grouped aggregate of it, or of it joined with a strategy's scalars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import expected_max_sharpe, normal_cdf
from ..plans.config import DAYS_A_YEAR, EPS, MOST_PROFIT_FACTOR, EvalConfig
from ..plans.lineage import settle
from . import scans
from .cleaning import KEY
from .quantiles import quantiles
from .resample import residue
from .series import curve_points, islands, marked_equity, monthly_returns, with_equity, with_returns

DAY = 86_400.0


def trade_facts(trades: DataFrame, config: EvalConfig) -> DataFrame:
    """Trades with returns and the closed-trade equity curve."""
    return with_equity(with_returns(trades, config), config)


def _guard(x: Column) -> Column:
    return F.greatest(F.lit(EPS), x)


def basic(trades: DataFrame) -> DataFrame:
    """Counts, win and loss rates, averages, profit factor, payoff and expectancy, also by side."""
    p = F.col("capped_pnl")
    won, lost, long, short = p > 0, p < 0, F.col("side") == "long", F.col("side") == "short"
    a = trades.groupBy(*KEY).agg(
        F.count("*").alias("total_trades"),
        F.count_if(won).alias("win_count"),
        F.count_if(lost).alias("loss_count"),
        F.count_if(p == 0).alias("tie_count"),
        F.coalesce(F.sum(F.when(won, p)), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(lost, -p)), F.lit(0.0)).alias("_lost"),
        F.coalesce(F.avg(F.when(won, p)), F.lit(0.0)).alias("average_win"),
        F.coalesce(F.avg(F.when(lost, -p)), F.lit(0.0)).alias("average_loss"),
        F.count_if(long).alias("long_count"),
        F.count_if(short).alias("short_count"),
        F.count_if(long & won).alias("_long_won"),
        F.count_if(short & won).alias("_short_won"),
    )
    rate = F.col("win_count") / F.col("total_trades")
    a = a.withColumns({"win_rate": rate, "loss_rate": 1 - rate})
    expectancy = F.col("win_rate") * F.col("average_win") - F.col("loss_rate") * F.col("average_loss")
    return a.select(
        *KEY,
        "total_trades",
        "win_count",
        "loss_count",
        "tie_count",
        "win_rate",
        "loss_rate",
        "average_win",
        "average_loss",
        F.least(F.lit(MOST_PROFIT_FACTOR), F.col("_won") / _guard(F.col("_lost"))).alias("profit_factor"),
        (F.col("average_win") / _guard(F.col("average_loss"))).alias("payoff_ratio"),
        expectancy.alias("expectancy"),
        (expectancy / _guard(F.col("average_loss"))).alias("expectancy_per_risk"),
        "long_count",
        "short_count",
        F.coalesce(F.try_divide("_long_won", "long_count"), F.lit(0.0)).alias("long_win_rate"),
        F.coalesce(F.try_divide("_short_won", "short_count"), F.lit(0.0)).alias("short_win_rate"),
    )


def _moments(a: DataFrame) -> dict[str, Column]:
    """Sample skewness and excess kurtosis, 0 for too few or (nearly) equal returns, from n, _g1, _g2 and _sd."""
    n = F.col("n").cast("double")
    skew = F.when((n >= 3) & (F.col("_sd") >= EPS), F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when((n >= 4) & (F.col("_sd") >= EPS), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).otherwise(0.0)
    return {"skew_returns": skew, "excess_kurtosis_returns": kurt}


def growth(facts: DataFrame, config: EvalConfig) -> DataFrame:
    """Net pnl, total return, CAGR over whole days, mean and median return, skewness and kurtosis."""
    whole = scans.CHUNK not in facts.columns
    a = facts.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.sum("capped_pnl").alias("net_pnl"),
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
        F.avg("R").alias("mean_return_per_trade"),
        *((F.percentile("R", F.lit(0.5)).alias("median_return_per_trade"),) if whole else ()),
        F.stddev_samp("R").alias("_sd"),
        F.skewness("R").alias("_g1"),
        F.kurtosis("R").alias("_g2"),
    )
    if not whole:
        a = a.join(quantiles(facts.select(*KEY, F.col("R").alias("v")), [0.5]).select(*KEY, F.col("q")[0].alias("median_return_per_trade")), KEY, "left")
    start = config.start_balance
    a = a.withColumns({"days": F.floor((F.unix_micros("_last") - F.unix_micros("_first")) / (DAY * 1e6)), "_end": F.lit(start) + F.col("net_pnl")})
    enough = (F.col("n") >= 2) & (F.col("days") >= 7)
    return a.select(
        *KEY,
        "n",
        "days",
        "net_pnl",
        ((F.col("_end") - start) / max(EPS, start)).alias("total_return"),
        F.when(enough & (F.col("_end") > 0), F.pow(F.col("_end") / start, DAYS_A_YEAR / F.col("days")) - 1).alias("cagr"),
        ((F.col("n") >= 2) & (F.col("days") < 7)).alias("cagr_flagged_insufficient"),
        "mean_return_per_trade",
        "median_return_per_trade",
        *(c.alias(k) for k, c in _moments(a).items()),
    )


def drawdown_duration(facts: DataFrame) -> DataFrame:
    """(strategy_id, max_drawdown_duration_days): the longest run under water, from its first to its last trade.

    A balance that is back at its peak ends a run, whatever rounding leaves of the fall.
    """
    rows = scans.running_sums(facts, {"_moved": F.abs("capped_pnl")})
    under = F.col("balance") - F.col("peak") < -residue(F.col("seq"), F.col("peak"), F.col("_moved"))
    at = F.when(under, F.unix_micros("timestamp"))
    runs = islands(rows, under, "_run").groupBy(*KEY, "_run").agg(((F.max(at) - F.min(at)) / (DAY * 1e6)).alias("_days"))
    return runs.groupBy(*KEY).agg(F.coalesce(F.max("_days"), F.lit(0.0)).alias("max_drawdown_duration_days"))


def drawdown(facts: DataFrame, config: EvalConfig) -> DataFrame:
    """Largest and mean drawdown, ulcer index and recovery factor; the start is a point of the curve."""
    a = facts.groupBy(*KEY).agg(
        F.count("*").alias("_n"),
        F.least(F.lit(0.0), F.min("dd")).alias("max_drawdown"),
        F.coalesce(F.avg(F.when(F.col("dd") < 0, F.col("dd"))), F.lit(0.0)).alias("average_drawdown"),
        F.sum(F.col("dd") * F.col("dd")).alias("_squares"),
        F.sum("capped_pnl").alias("_net"),
    )
    return a.select(
        *KEY,
        "max_drawdown",
        "average_drawdown",
        F.sqrt(F.col("_squares") / (F.col("_n") + 1)).alias("ulcer_index"),
        (F.col("_net") / _guard(F.abs("max_drawdown") * config.start_balance)).alias("recovery_factor"),
    )


def marked_drawdown(trades: DataFrame, config: EvalConfig) -> DataFrame:
    """(strategy_id, mtm_max_drawdown) of the mark-to-market curve."""
    return marked_equity(trades, config).groupBy(*KEY).agg(F.min("dd").alias("mtm_max_drawdown"))


def with_rates(facts: DataFrame, config: EvalConfig) -> DataFrame:
    """Adds n, trades_per_year, rf_per_trade and annualiser of the strategy to each trade."""
    at = F.unix_micros("timestamp")
    rows = scans.of_strategy(facts, {"n": F.count("*"), "_from": F.min(at), "_to": F.max(at)})
    rows = rows.withColumn("_days", F.floor((F.col("_to") - F.col("_from")) / (DAY * 1e6))).drop("_from", "_to")
    n = F.col("n").cast("double")
    per_year = F.when(n >= 2, n * DAYS_A_YEAR / F.greatest(F.lit(1.0), F.col("_days").cast("double"))).otherwise(n)
    rows = rows.withColumn("trades_per_year", per_year).drop("_days")
    yearly = (F.col("n") >= 10) & (F.col("trades_per_year") > EPS)
    free = F.when(yearly, F.pow(F.lit(1.0 + config.rf_annual), 1.0 / F.col("trades_per_year")) - 1.0).otherwise(0.0)
    return rows.withColumns({"rf_per_trade": free, "annualiser": F.when(F.col("n") >= 10, F.sqrt("trades_per_year")).otherwise(1.0)})


def tails(facts: DataFrame) -> DataFrame:
    """(strategy_id, p5, p95, tail_ratio, var_95, cvar_95): extremes instead of percentiles below ten trades."""
    values = {"_n": F.count("*"), "_lo": F.min("R"), "_hi": F.max("R")}
    if scans.CHUNK not in facts.columns:
        rows = scans.of_strategy(facts, {**values, "_p": F.percentile("R", F.array(F.lit(0.05), F.lit(0.95)))})
    else:
        sizes = facts.groupBy(*KEY).agg(*(c.alias(n) for n, c in values.items()))
        found = quantiles(facts.select(*KEY, F.col("R").alias("v")), [0.05, 0.95]).withColumnRenamed("q", "_p")
        rows = scans.join_hot(facts, sizes.join(found, KEY, "left"), "strategy_id", "_n")
    pick = lambda i, edge: F.when(F.col("_n") >= 10, F.col("_p")[i]).when(F.col("_n") >= 2, F.col(edge)).otherwise(0.0)
    rows = rows.select(*KEY, "R", pick(0, "_lo").alias("p5"), pick(1, "_hi").alias("p95"))
    a = rows.groupBy(*KEY, "p5", "p95").agg(F.avg(F.when(F.col("R") <= F.col("p5"), F.col("R"))).alias("_tail"))
    return a.select(*KEY, "p5", "p95", (F.abs("p95") / _guard(F.abs("p5"))).alias("tail_ratio"), (-F.col("p5")).alias("var_95"), F.coalesce(-F.col("_tail"), F.lit(0.0)).alias("cvar_95"))


def risk_adjusted(facts: DataFrame, grown: DataFrame, fallen: DataFrame, config: EvalConfig) -> DataFrame:
    """Sharpe (with the small-sample correction), Sortino, Calmar, Omega, RoMaD, tails, PSR and DSR."""
    over = F.col("R") - F.col("rf_per_trade")
    a = with_rates(facts, config).groupBy(*KEY, "n", "trades_per_year", "rf_per_trade", "annualiser").agg(
        F.avg(over).alias("_mu"),
        F.stddev_samp(over).alias("_sigma"),
        F.stddev_samp(F.least(over, F.lit(0.0))).alias("_down"),
        F.sum(F.greatest(over, F.lit(0.0))).alias("_up_sum"),
        F.sum(F.greatest(-over, F.lit(0.0))).alias("_down_sum"),
    )
    a = a.join(grown.drop("n"), KEY).join(fallen.select(*KEY, "max_drawdown"), KEY).join(tails(facts), KEY)
    n = F.col("n").cast("double")
    a = a.withColumn("sharpe_per_trade", F.when(F.coalesce("_sigma", F.lit(0.0)) > EPS, F.col("_mu") / F.col("_sigma")).otherwise(0.0))
    small = F.when(n < 30, F.sqrt(n / 30.0)).otherwise(1.0)
    mdd = F.col("max_drawdown")
    a = a.select(
        *KEY,
        "n",
        "trades_per_year",
        "rf_per_trade",
        "sharpe_per_trade",
        (F.col("sharpe_per_trade") * F.col("annualiser") * small).alias("sharpe_ratio"),
        F.when(F.coalesce("_down", F.lit(0.0)) > EPS, F.col("_mu") * F.col("annualiser") / F.col("_down")).otherwise(0.0).alias("sortino_ratio"),
        F.when((mdd < 0) & F.col("cagr").isNotNull(), F.col("cagr") / F.abs(mdd)).alias("calmar_ratio"),
        (F.col("_up_sum") / _guard(F.col("_down_sum"))).alias("omega_ratio"),
        F.when(mdd < 0, F.col("total_return") / F.abs(mdd)).otherwise(0.0).alias("romad"),
        "tail_ratio",
        "var_95",
        "cvar_95",
        "skew_returns",
        "excess_kurtosis_returns",
    )
    most = expected_max_sharpe(config.n_trials)
    return a.select("*", psr(F.lit(0.0)).alias("probabilistic_sharpe_ratio"), psr(F.lit(most)).alias("deflated_sharpe_ratio"), F.lit(config.n_trials).alias("dsr_n_trials"), (F.col("n") >= 10).alias("annualised"), (F.col("n") < 30).alias("sharpe_small_sample_corrected"), F.lit(float(most)).alias("psr_reference_sharpe"))


def psr(reference: Column) -> Column:
    """Probability that the true per-trade Sharpe ratio exceeds `reference`, from n, sharpe_per_trade and the moments."""
    sr, n = F.col("sharpe_per_trade"), F.col("n").cast("double")
    spread = 1 - F.col("skew_returns") * sr + (F.col("excess_kurtosis_returns") + 2) / 4 * sr * sr
    error = F.sqrt(F.greatest(spread, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0)))
    settled = F.when(sr > reference, 1.0).when(sr == reference, 0.5).otherwise(0.0)
    return F.when((n >= 2) & (spread > EPS), F.when(error > EPS, normal_cdf((sr - reference) / error)).otherwise(settled))


def streaks(trades: DataFrame) -> DataFrame:
    """(strategy_id, max_win_streak, max_loss_streak, streak_ratio); ties break both."""
    rows = scans.lagged(trades.withColumn("_s", F.signum("capped_pnl")), {"_before": F.col("_s")})
    rows = scans.running_sums(rows.withColumn("_new", F.coalesce(F.col("_s") != F.col("_before"), F.lit(True)).cast("int")), {"_run": F.col("_new")})
    runs = rows.groupBy(*KEY, "_run", "_s").agg(F.count("*").alias("_length"))
    longest = lambda s, name: F.coalesce(F.max(F.when(F.col("_s") == s, F.col("_length"))), F.lit(0).cast("long")).alias(name)
    out = runs.groupBy(*KEY).agg(longest(1, "max_win_streak"), longest(-1, "max_loss_streak"))
    return out.withColumn("streak_ratio", F.col("max_win_streak") / F.greatest(F.lit(1), F.col("max_loss_streak")))


def runs_test(trades: DataFrame) -> DataFrame:
    """(strategy_id, runs, runs_z): sign changes among wins and losses against their expected number."""
    rows = scans.lagged(trades.withColumn("_s", F.when(F.col("capped_pnl") != 0, F.signum("capped_pnl"))), {"_before": F.col("_s")}, skip_nulls=True)
    rows = rows.withColumn("_new", F.col("_s").isNotNull() & F.coalesce(F.col("_s") != F.col("_before"), F.lit(True)))
    a = rows.groupBy(*KEY).agg(F.count_if("_new").alias("runs"), F.count_if(F.col("_s") > 0).alias("_w"), F.count_if(F.col("_s") < 0).alias("_l"))
    w, lost = F.col("_w").cast("double"), F.col("_l").cast("double")
    mean = 1 + 2 * w * lost / F.greatest(w + lost, F.lit(1.0))
    variance = (mean - 1) * (mean - 2) / F.greatest(w + lost - 1, F.lit(1.0))
    z = F.when((w > 0) & (lost > 0) & (variance > EPS), (F.col("runs") - mean) / F.sqrt(F.greatest(variance, F.lit(EPS)))).otherwise(0.0)
    return a.select(*KEY, "runs", z.alias("runs_z"))


def behavioural(trades: DataFrame, monthly: DataFrame) -> DataFrame:
    """Streaks, runs test, best and worst trade, share of profitable months and monthly volatility."""
    edges = trades.groupBy(*KEY).agg(F.max("capped_pnl").alias("best_trade"), F.min("capped_pnl").alias("worst_trade"))
    months = monthly.groupBy(*KEY).agg(F.count("*").alias("months"), F.avg((F.col("ret") > 0).cast("double")).alias("profitable_month_fraction"), F.stddev_samp("ret").alias("monthly_volatility"))
    zero = F.lit(0).cast("long")
    return streaks(trades).join(runs_test(trades), KEY).join(edges, KEY).join(months, KEY, "left").withColumn("months", F.coalesce("months", zero))


def all_metrics(facts: DataFrame, config: EvalConfig) -> DataFrame:
    """Every scalar metric of a strategy in one row, the regime check included, from `trade_facts`."""
    from .regime import regime_check

    # each group is a job of its own and leaves a row a strategy: in one plan all groups' sorts share a task's memory, and
    # growth, from which the risk group starts as well, would be made twice
    grown, fallen = settle(growth(facts, config)), settle(drawdown(facts, config))
    risk = risk_adjusted(facts, grown, fallen, config).drop("n", "skew_returns", "excess_kurtosis_returns")
    points = curve_points(facts, config)
    made = [drawdown_duration(facts), marked_drawdown(facts, config), risk, behavioural(facts, monthly_returns(points)), regime_check(facts, config)]
    groups = [grown, fallen, *map(settle, made)]
    out = basic(facts)
    for g in groups:
        out = out.join(g, KEY)
    return out
