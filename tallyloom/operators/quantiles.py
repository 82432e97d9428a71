"""Exact quantiles of groups of any size by counting refinement.

For each wanted rank a range of values is kept that holds it. A round cuts each range into bins, counts its values
by bin in partial sums, and goes on with the bin that holds the rank, from that bin's smallest to its largest value;
a range of one value is the answer. No task holds a group's values, only counts by bin. Rounds with even bins
and with bins even in powers follow each other, so values of very different sizes take few rounds, too; a round with even
bins always parts a range's smallest value from its largest, so rounds come to an end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .scans import join_hot

BINS = 1024


def quantiles(values: DataFrame, shares: list[float], bins: int = BINS) -> DataFrame:
    """(strategy_id, q): q has each share's quantile, between two values by their distance as `percentile` has it.

    values: (strategy_id, v), v double; null and NaN do not count. A strategy without values has no row.
    """
    values = settle(values.select("strategy_id", (F.col("v") + F.lit(0.0)).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))  # -0 becomes 0
    ends = settle(values.groupBy("strategy_id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)).cast("long"), F.ceil(at(p)).cast("long")) for p in shares))))
    state = ends.select("strategy_id", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    settled = [state.filter("lo = hi")]
    state, round_number = settle(state.filter("lo < hi")), 0
    while not state.isEmpty():
        state = settle(_refined(values, ends, state, bins, round_number % 2 == 1))
        settled.append(state.filter("lo = hi"))
        state, round_number = state.filter("lo < hi"), round_number + 1
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    of_rank = F.map_from_entries(F.collect_list(F.struct("rank", "lo")))  # no more entries than twice the shares
    found = found.groupBy("strategy_id").agg(of_rank.alias("of")).join(ends.select("strategy_id", "n"), "strategy_id")

    def between(p: float) -> Column:
        position = at(p)
        low, high = F.floor(position).cast("long"), F.ceil(position).cast("long")
        a, b = F.element_at("of", low), F.element_at("of", high)
        return F.when((low == high) | (a == b), a).otherwise((high - position) * a + (position - low) * b)

    return found.select("strategy_id", F.array(*map(between, shares)).alias("q"))


def _powers(v: Column) -> Column:
    """Grows with v, by as much for each power of a value; no logarithm of a double is below -745."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746.0))


def _refined(values: DataFrame, ends: DataFrame, state: DataFrame, bins: int, widening: bool) -> DataFrame:
    """Each rank's range, cut once."""
    ranges = state.select("strategy_id", "lo", "hi").distinct().groupBy("strategy_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    sized = ranges.join(ends.select("strategy_id", F.col("n").alias("_n")), "strategy_id")
    rows = join_hot(values, sized, "strategy_id", "_n")
    v = F.col("v")
    met = rows.select("strategy_id", "v", F.explode(F.filter("ranges", lambda r: (v >= r["lo"]) & (v <= r["hi"]))).alias("r")).select("strategy_id", "v", "r.lo", "r.hi")
    # the difference of two doubles may be beyond the largest, half of one below the smallest
    wide = F.col("hi") / 2 - F.col("lo") / 2
    share = F.when(wide > 1e-300, F.try_divide(v / 2 - F.col("lo") / 2, wide)).otherwise(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")))
    if widening:
        share = F.coalesce(F.try_divide(_powers(v) - _powers(F.col("lo")), _powers(F.col("hi")) - _powers(F.col("lo"))), F.lit(0.0))
    number = F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))
    counts = met.groupBy("strategy_id", "lo", "hi", number.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
    before = Window.partitionBy("strategy_id", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("less", F.coalesce(F.sum("c").over(before), F.lit(0)))
    place = F.col("rank") - F.col("below")
    held = state.join(counts, ["strategy_id", "lo", "hi"]).filter((F.col("less") <= place) & (place < F.col("less") + F.col("c")))
    return held.select("strategy_id", "rank", F.col("a").alias("lo"), F.col("z").alias("hi"), (F.col("below") + F.col("less")).alias("below"))
