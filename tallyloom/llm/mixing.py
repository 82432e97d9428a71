"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets, in DataFrame operations.

Each document draws an exponential key, -ln(u) / w, with w its quality weight and u from a hash of its
doc_id, so that reruns agree. A source's target is met by complete epochs (every document once each) and
then by its documents in key order until the sizes summed so far reach the rest: a document is in when its
middle word is within the budget, which leaves the source at most half a document off.

The sums run in two steps, so that no source has to pass through one task: keys are cut into ranges of
about `rows_each` documents of a source, whole ranges are summed first, and a window orders only the
documents of a range.

Defined results: a null text has size 0 and is never taken; null is a source of its own, ordered last; rows
of equal doc_id and size are interchangeable; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
CYCLE = (3.0, 1.0, 2.0)


def uniform(seed: int) -> Column:
    """In (0, 1), from the doc_id: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n), a row for each source.

    Targets are min(most * size, level * weight). Sources leave the common level in the order of
    cap / weight, so running sums over that order give the level without iteration.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(place, F.lit(len(cycle))) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    full = Window.partitionBy(F.lit(1))
    level = capped.withColumn("level", (F.lit(share) * F.sum("source_size").over(full) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # a source is capped when the level that it would get exceeds its cap; the first that is not sets the level
    settled = level.withColumn("settled", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(full)["level"])
    target = F.least("cap", F.coalesce(F.col("settled") * F.col("weight"), F.col("cap")))
    return settled.select("source", "source_size", "n", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: int = 9, rows_each: int = 2_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document.

    quality: (doc_id, weight), weights above 0; documents it lacks weigh 1.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    slim = common.cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size")))  # texts are read once
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    wanted = targets(sums, share, most)
    if quality is not None:
        weights = quality.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("weight").cast("double").alias("weight"))
        low = min(1.0, weights.agg(F.percentile_approx("weight", 0.01)).first()[0] or 1.0)
        slim = slim.join(weights, "doc_id", "left")
    else:
        low = 1.0
        slim = slim.withColumn("weight", F.lit(1.0))
    wanted = wanted.withColumnRenamed("source", "of")
    keyed = slim.withColumn("key", -F.log(uniform(seed)) / F.coalesce("weight", F.lit(1.0))).join(wanted, F.col("source").eqNullSafe(F.col("of")))
    # ranges of the key: 1 - exp(-key * low) is even in (0, 1) for weight `low`, and nowhere denser than w / low for weight w above
    keyed = keyed.withColumn("range", F.floor((1 - F.exp(-F.col("key") * low)) * F.ceil(F.col("n") / F.lit(rows_each))))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("rs"), F.col("range").alias("rr"), F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("earlier"))
    keyed = keyed.join(ranges, F.col("source").eqNullSafe(F.col("rs")) & (F.col("range") == F.col("rr")))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("ahead", F.col("earlier") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("ahead") + F.col("size") / 2 <= rest)
    return keyed.select("doc_id", "size", "source_size", "target", (F.col("size") * (epochs + more.cast("long"))).alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weights from quality labels: 2 for good documents, 0.5 for bad ones."""
    return labels.filter(F.col("quality").isNotNull()).select("doc_id", F.when(F.col("quality") >= 1, F.lit(2.0)).otherwise(F.lit(0.5)).alias("weight"))


def take(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The documents that the mix takes, each once, with `size`, `source_size`, `target` and `taken` after their own columns.

    A column of `docs` by one of those names gives way. Rows of equal doc_id share the largest taken.
    """
    found = ("size", "source_size", "target", "taken")
    own = [c for c in docs.columns if c.lower() not in found]
    mark, *names = common.free(docs, "__id", *(f"__{c}" for c in found))
    plan = mix(docs, quality, **options).groupBy(F.col("doc_id").alias(mark)).agg(*(F.max(c).alias(n) for c, n in zip(found, names))).filter(F.col(names[3]) > 0)
    return docs.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(mark))).select(*own, *(F.col(n).alias(c) for c, n in zip(found, names)))
