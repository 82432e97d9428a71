"""Joins of intervals that overlap, as equal joins on buckets of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, key: list[str], width: int) -> DataFrame:
    """left joined with right where keys are equal and the closed intervals [start, end] and [begin, finish] share a point.

    Both sides are dealt to the buckets of `width` that their intervals touch; a pair counts in one bucket only, the
    one in which the later interval starts, so no pair comes twice and none needs to be told apart afterwards.
    A wide `width` makes fewer copies of intervals, a narrow one fewer comparisons. Intervals that end before
    they start, or have no ends, overlap nothing.
    """
    # floor, not div, so that buckets before 1970 are as wide as the others
    at = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    held = lambda a, b: F.when(F.col(a) <= F.col(b), F.sequence(at(a), at(b))).otherwise(F.array().cast("array<long>"))
    lefts = left.withColumn("_bucket", F.explode(held("start", "end")))
    rights = right.withColumn("_bucket", F.explode(held("begin", "finish")))
    met = lefts.join(rights, [*key, "_bucket"])
    first = F.floor(F.greatest("start", "begin") / F.lit(float(width))).cast("long")
    return met.filter((F.col("start") <= F.col("finish")) & (F.col("begin") <= F.col("end")) & (F.col("_bucket") == first)).drop("_bucket")
