"""What charts and tables are drawn from: histogram of returns, monthly heat map, resampling percentiles, drawdown, signals of overfitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import resample, scans
from .cleaning import KEY

BINS = 30


def pnl_histogram(equity: DataFrame, bins: int = BINS) -> DataFrame:
    """(strategy_id, bin, n): returns in percent in equal bins between the least (-1 at most) and the largest (1 at least)."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    before = F.when(F.lag("peak").over(order) > 0, F.lag("balance").over(order)).otherwise(1.0)
    moves = equity.withColumn("r", (F.col("balance") - F.lag("balance").over(order)) / before * 100).filter("seq > 0")
    edges = moves.groupBy(*KEY).agg(F.least(F.min("r"), F.lit(-1.0)).alias("lo"), F.greatest(F.max("r"), F.lit(1.0)).alias("hi"))
    at = F.floor((F.col("r") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int")
    placed = moves.join(edges, KEY).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)))
    return placed.groupBy(*KEY, "bin").agg(F.count("*").alias("n"))


def monthly_heatmap(monthly: DataFrame) -> DataFrame:
    """(strategy_id, year, m01 ... m12): returns by month; null for none."""
    parts = monthly.select(*KEY, F.substring("month", 1, 4).alias("year"), F.concat(F.lit("m"), F.substring("month", 6, 2)).alias("m"), "ret")
    return parts.groupBy(*KEY, "year").pivot("m", [f"m{i:02d}" for i in range(1, 13)]).agg(F.first("ret"))


def percentile_chart(resampled: DataFrame, test: str = "a") -> DataFrame:
    """(strategy_id, series, point, place, value): a line through the percentiles of each measure of a test, returns and drawdowns in percent."""
    lines = {"total_return": ("TR %", 100.0), "max_drawdown": ("MDD %", 100.0), "sharpe_ratio": ("Sharpe", 1.0), "profit_factor": ("PF", 1.0)}
    times = lambda m, by: F.transform(m, lambda x: x * by)
    series = F.array(*(F.struct(F.lit(n).alias("series"), times(m, by).alias("values")) for m, (n, by) in lines.items()))
    rows = resampled.filter(F.col("test") == test).select(*KEY, F.explode(series).alias("s")).select(*KEY, "s.series", F.posexplode("s.values").alias("place", "value"))
    points = F.array(*(F.lit(f"p{round(p * 100)}") for p in resample.PERCENTILES))
    return rows.select(*KEY, "series", F.get(points, F.col("place")).alias("point"), "place", "value")


def drawdown_chart(equity: DataFrame) -> DataFrame:
    """(strategy_id, seq, day, balance, peak, dd_percent, mdd_percent): the equity curve and the drawdown with its lowest level."""
    rows = scans.of_strategy(equity, {"_low": F.min("dd")})
    return rows.select(*KEY, "seq", F.date_format("t", "yyyy-MM-dd").alias("day"), "balance", "peak", (F.col("dd") * 100).alias("dd_percent"), (F.col("_low") * 100).alias("mdd_percent"))


def radar_chart(cards: DataFrame) -> DataFrame:
    """(id, name, place, category, value): the six category scores of whole cards, 0 each for strategies that were knocked out."""
    names = {"Profit": "profitability", "RiskAdj": "risk_adj", "DD": "drawdown", "Robust": "robustness", "Sanity": "sanity", "Suff": "sufficiency"}
    scores = F.col("scoring.category_scores")
    points = F.array(*(F.struct(F.lit(n).alias("category"), F.coalesce(scores[c], F.lit(0.0)).alias("value")) for n, c in names.items()))
    return cards.select("id", "name", F.posexplode(points).alias("place", "p")).select("id", "name", "place", "p.*")


def equity_overlay(cards: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id, label, place, day, balance): the curves of whole cards, labelled with name and final score.

    parts: `scorecards.curve_parts`, the curves that cards leave to rows of their own; without it such cards have no rows.
    """
    label = F.format_string("%s (%d)", "name", F.col("scoring.final_score")).alias("label")
    rows = cards.select("id", label, F.posexplode("equity_curve").alias("place", "p"))
    if parts is not None:
        long = parts.join(F.broadcast(cards.filter("equity_curve IS NULL").select("id", label)), "id").select("id", "label", "first", F.posexplode("equity_curve").alias("place", "p"))
        rows = rows.unionByName(long.select("id", "label", (F.col("first") + F.col("place")).alias("place"), "p"))
    return rows.select("id", "label", "place", F.date_format("p.t", "yyyy-MM-dd").alias("day"), "p.balance")


def overfit_table(cards: DataFrame) -> DataFrame:
    """(id, place, signal, value): the signals of overfitting of whole cards as they are shown; a dash for none."""
    o, block, check = F.col("overfitting"), F.col("moving_block"), F.col("metrics.behav.regime_check")
    dash = lambda x: F.coalesce(x, F.lit("\u2014"))
    # decimals round a half up, as a shown number does
    digits = lambda x, n: dash(x.cast(f"decimal(38,{n})").cast("string"))
    percent = lambda x: dash(F.concat((x * 100).cast("decimal(38,1)").cast("string"), F.lit("%")))
    there: Column = F.lit(True)
    rows = [
        ("N_obs (PSR sample size)", o["n_obs"].cast("string"), there),
        ("N_trials (DSR deflation)", o["dsr_n_trials"].cast("string"), there),
        ("Probabilistic Sharpe (PSR)", digits(o["probabilistic_sharpe_ratio"], 4), there),
        ("Deflated Sharpe (DSR)", digits(o["deflated_sharpe_ratio"], 4), there),
        ("Regime unstable (CUSUM)", F.when(o["regime_unstable"], "yes").otherwise("no"), there),
        ("Moving-block RR", percent(o["moving_block_robustness_rate"]), there),
        ("i.i.d. RR (Test A)", percent(o["iid_robustness_rate"]), there),
        ("Block \u2212 iid RR gap", digits(o["block_dependence_gap"], 3), there),
        ("Moving-block L", block["block_length"].cast("string"), block.isNotNull()),
        ("Moving-block Sharpe stability", percent(block["sharpe_stability"]), block.isNotNull()),
        ("CUSUM threshold hits", check["cusum_full"]["n_regime_shifts_detected"].cast("string"), check["cusum_full"].isNotNull()),
        ("Mean return half-gap", digits(check["mean_return_gap"], 6), check["cusum_full"].isNotNull()),
        ("Sharpe half-gap", digits(check["sharpe_half_gap"], 3), check["cusum_full"].isNotNull()),
    ]
    shown = F.filter(F.array(*(F.when(where, F.struct(F.lit(i).alias("place"), F.lit(n).alias("signal"), v.alias("value"))) for i, (n, v, where) in enumerate(rows))), lambda x: x.isNotNull())
    return cards.filter(o.isNotNull()).select("id", F.explode(shown).alias("s")).select("id", "s.*")
