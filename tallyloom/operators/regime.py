"""Regime change: two-sided CUSUM with reset, and stability between the halves of a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import EPS, EvalConfig
from . import scans
from .cleaning import KEY
from .cusum import follow, maps_of


def in_halves(facts: DataFrame) -> DataFrame:
    """(strategy_id, seq, R, n, first): whether a return lies in the first half; the middle goes to the second."""
    kept = facts.select(*KEY, "seq", "R", *(c for c in (scans.CHUNK,) if c in facts.columns))
    return scans.of_strategy(kept, {"n": F.count("*")}).withColumn("first", F.col("seq") <= F.floor(F.col("n") / 2))


def cusums(facts: DataFrame, config: EvalConfig) -> DataFrame:
    """(strategy_id, whole, first, second): s_plus_peak, s_minus_peak, hits and threshold_hit of the returns R by seq, of the whole
    history and of its halves, each standardised by its own mean and deviation; halves of fewer than four returns are null.

    A history is folded in stretches, each in its task, see `cusum`.
    """
    k, h = config.cusum_k, config.cusum_h
    of = lambda f, where: f(F.when(where, F.col("R")))
    first = F.col("first")
    rows = scans.of_strategy(in_halves(facts), {"_m": F.avg("R"), "_s": F.stddev_samp("R"), "_m1": of(F.avg, first), "_s1": of(F.stddev_samp, first), "_m2": of(F.avg, ~first), "_s2": of(F.stddev_samp, ~first)})
    z = lambda m, s: F.when(F.coalesce(s, F.lit(0.0)) < EPS, 0.0).otherwise((F.col("R") - m) / s)
    own = lambda c: F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    chunk = F.col(scans.CHUNK) if scans.CHUNK in rows.columns else F.lit(0)
    rows = rows.select(*KEY, "seq", "n", F.when(first, 1).otherwise(2).alias("part"), chunk.alias("chunk"), z(F.col("_m"), F.col("_s")).alias("whole"), z(own("_m"), own("_s")).alias("half"))
    if scans.CHUNK in facts.columns:
        rows = rows.repartition("strategy_id", "chunk")
    maps = maps_of(rows.sortWithinPartitions("strategy_id", "chunk", "seq"), k, h, ["whole", "half"])
    maps = maps.groupBy(*KEY, "series").agg(F.array_sort(F.collect_list(F.struct("at", "up", "down"))).alias("maps"))  # a map for each batch of rows
    side = lambda s: follow(F.transform("maps", lambda m: m[s]), h)
    ends = maps.select(*KEY, "series", side("up").alias("up"), side("down").alias("down"))
    hits = F.col("up.hits") + F.col("down.hits")
    ends = ends.select(*KEY, "series", F.struct(F.col("up.peak").alias("s_plus_peak"), (-F.col("down.peak") + 0.0).alias("s_minus_peak"), hits.alias("hits"), ((hits > 0) | (F.col("up.peak") > h) | (F.col("down.peak") > h)).alias("threshold_hit")).alias("c"))
    pick = lambda series: F.max(F.when(F.col("series") == series, F.col("c")))
    found = ends.groupBy(*KEY).agg(pick("whole").alias("whole"), pick("half1").alias("first"), pick("half2").alias("second"))
    long = facts.groupBy(*KEY).agg((F.count("*") >= 4).alias("_long"))
    return found.join(long, KEY).select(*KEY, "whole", *(F.when(F.col("_long"), F.col(c)).alias(c) for c in ("first", "second")))


def cusum(facts: DataFrame, config: EvalConfig) -> DataFrame:
    """(strategy_id, s_plus_peak, s_minus_peak, hits, threshold_hit) of the whole history."""
    return cusums(facts, config).select(*KEY, "whole.*")


def halves(facts: DataFrame) -> DataFrame:
    """(strategy_id, n, mean and Sharpe gap between first and second half, standard error); the middle goes to the second."""
    rows = in_halves(facts).withColumnRenamed("first", "_first")
    part = lambda f, first: f(F.when(F.col("_first") == first, F.col("R")))
    a = rows.groupBy(*KEY, "n").agg(
        F.count_if("_first").alias("_n1"),
        F.count_if(~F.col("_first")).alias("_n2"),
        part(F.avg, True).alias("_m1"),
        part(F.avg, False).alias("_m2"),
        F.coalesce(part(F.stddev_samp, True), F.lit(0.0)).alias("_s1"),
        F.coalesce(part(F.stddev_samp, False), F.lit(0.0)).alias("_s2"),
    )
    pooled = ((F.col("_n1") - 1) * F.pow("_s1", 2) + (F.col("_n2") - 1) * F.pow("_s2", 2)) / F.greatest(F.lit(1), F.col("_n1") + F.col("_n2") - 2)
    sharpe = lambda i: F.when((F.col(f"_n{i}") >= 2) & (F.col(f"_s{i}") > EPS), F.col(f"_m{i}") / F.col(f"_s{i}")).otherwise(0.0)
    error = F.when((pooled > 0) & (F.col("_n1") > 0), F.sqrt(pooled * (1 / F.greatest(F.col("_n1"), F.lit(1)) + 1 / F.greatest(F.col("_n2"), F.lit(1))))).otherwise(0.0)
    long = F.col("n") >= 4
    return a.select(*KEY, "n", F.when(long, F.col("_m1") - F.col("_m2")).otherwise(0.0).alias("mean_return_gap"), F.when(long, sharpe(1) - sharpe(2)).otherwise(0.0).alias("sharpe_half_gap"), F.when(long, error).otherwise(0.0).alias("gap_error"))


def regime_check(facts: DataFrame, config: EvalConfig) -> DataFrame:
    """CUSUM of the whole history (its columns) and of its halves (cusum_first_half, cusum_second_half), gaps between the halves,
    and whether they call it unstable."""
    a = cusums(facts, config).join(halves(facts).drop("n"), KEY)
    gap = ((F.col("gap_error") > EPS) & (F.abs("mean_return_gap") > 2 * F.col("gap_error"))) | (F.abs("sharpe_half_gap") > 0.5)
    return a.select(*KEY, "whole.*", F.col("first").alias("cusum_first_half"), F.col("second").alias("cusum_second_half"), "mean_return_gap", "sharpe_half_gap", (F.col("whole.threshold_hit") | gap).alias("regime_unstable"))
