"""Running values along a strategy, also where one strategy is too long for a task.

Rows without a column `chunk` are scanned by windows over their strategy. `in_chunks` cuts ordered rows into chunks of
bounded size, each a stretch of one strategy; then every scan has three steps, scan within each chunk, combine the
chunks' totals (a row a chunk) in order, add what comes before a chunk to its rows. The totals are monoids: a sum, a
maximum, the last row, a count. As rows meet totals of their own, a scan of chunks settles its rows first: plans of scans
after scans would double with each of them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.lineage import settle

CHUNK = "chunk"


def hot_strategies(rows: DataFrame, most: int) -> bool:
    """Whether any strategy has more than `most` rows; reads only the key, and that only where rows are as many."""
    if rows.count() <= most:
        return False
    return not rows.groupBy("strategy_id").count().filter(F.col("count") > most).isEmpty()


def in_chunks(rows: DataFrame, order: list[str], each: int) -> DataFrame:
    """The rows with `chunk`, ascending along each strategy's order; a chunk has about `each` rows.

    A strategy's rows of one chunk stand together, whatever its share of all rows is, as ranges are cut within
    strategies, too; `order` must tell rows of a strategy apart. Written to the shared folder, so that chunks stay as they are.
    """
    n = max(1, -(-rows.count() // each))
    return settle(rows.repartitionByRange(n, "strategy_id", *order).withColumn(CHUNK, F.spark_partition_id()))


def _settled(rows: DataFrame) -> DataFrame:
    return settle(rows) if CHUNK in rows.columns else rows


def _keys(rows: DataFrame) -> list[str]:
    return ["strategy_id", CHUNK] if CHUNK in rows.columns else ["strategy_id"]


def _order(rows: DataFrame, order: list[str]) -> WindowSpec:
    return Window.partitionBy(*_keys(rows)).orderBy(*order)


def _before() -> WindowSpec:
    return Window.partitionBy("strategy_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, totals: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """(strategy_id, chunk, carried columns): of each chunk, what comes before it."""
    return rows.groupBy("strategy_id", CHUNK).agg(*(c.alias(n) for n, c in totals.items())).select("strategy_id", CHUNK, *(c.alias(n) for n, c in carry.items()))


def running_sums(rows: DataFrame, sums: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """Adds running sums, each row's own value included; nulls count as 0."""
    order = order or ["seq"]
    upto = _order(rows, order).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = _settled(rows)
    local = rows.withColumns({n: F.sum(zero(c)).over(upto) for n, c in sums.items()})
    if CHUNK not in rows.columns:
        return local
    before = _carried(rows, {f"_{n}": F.sum(zero(c)) for n, c in sums.items()}, {f"_{n}": F.sum(f"_{n}").over(_before()) for n in sums})
    joined = local.join(before, ["strategy_id", CHUNK])
    return joined.withColumns({n: F.col(n) + zero(F.col(f"_{n}")) for n in sums}).drop(*(f"_{n}" for n in sums))


def running_max(rows: DataFrame, name: str, value: Column, order: list[str] | None = None) -> DataFrame:
    """Adds the running maximum, each row's own value included."""
    upto = _order(rows, order or ["seq"]).rowsBetween(Window.unboundedPreceding, 0)
    rows = _settled(rows)
    local = rows.withColumn(name, F.max(value).over(upto))
    if CHUNK not in rows.columns:
        return local
    before = _carried(rows, {"_m": F.max(value)}, {"_m": F.max("_m").over(_before())})
    return local.join(before, ["strategy_id", CHUNK]).withColumn(name, F.greatest(name, "_m")).drop("_m")


def lagged(rows: DataFrame, values: dict[str, Column], order: list[str] | None = None, skip_nulls: bool = False) -> DataFrame:
    """Adds the values of the row before (null for a strategy's first row); with skip_nulls, of the last row before that has one."""
    order = order or ["seq"]
    upto = _order(rows, order).rowsBetween(Window.unboundedPreceding, -1)
    rows = _settled(rows)
    local = rows.withColumns({n: F.last(c, True).over(upto) if skip_nulls else F.lag(c).over(_order(rows, order)) for n, c in values.items()})
    if CHUNK not in rows.columns:
        return local
    by = F.struct(*order)
    last = {f"_{n}": F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), by) if skip_nulls else by) for n, c in values.items()}
    before = _carried(rows, last, {f"_{n}": F.last(f"_{n}", True).over(_before())["v"] for n in values})
    first = F.row_number().over(_order(rows, order)) == 1
    joined = local.withColumn("_first", first).join(before, ["strategy_id", CHUNK])
    own = lambda n: F.coalesce(F.col(n), F.col(f"_{n}")) if skip_nulls else F.when(F.col("_first"), F.col(f"_{n}")).otherwise(F.col(n))
    return joined.withColumns({n: own(n) for n in values}).drop("_first", *(f"_{n}" for n in values))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `seq`, from 1 along the strategy."""
    rows = _settled(rows)
    local = rows.withColumn("seq", F.row_number().over(_order(rows, order)))
    if CHUNK not in rows.columns:
        return local
    before = _carried(rows, {"_n": F.count("*")}, {"_n": F.sum("_n").over(_before())})
    return local.join(before, ["strategy_id", CHUNK]).withColumn("seq", F.col("seq") + F.coalesce("_n", F.lit(0))).drop("_n")


def of_strategy(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds aggregates of all of a strategy's rows to each of them."""
    if CHUNK not in rows.columns:
        whole = Window.partitionBy("strategy_id")
        return rows.withColumns({n: c.over(whole) for n, c in values.items()})
    rows = _settled(rows)
    found = rows.groupBy("strategy_id").agg(F.count("*").alias("_rows"), *(c.alias(n) for n, c in values.items()))
    return join_hot(rows, found, "strategy_id", "_rows").drop("_rows")


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """left joined with right, which has one row a key and in column `n` how many rows of left have it.

    Keys of more than a thousandth of left's rows, a thousand at most, are broadcast, so none gathers in a task.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(right.filter(F.col(n) * 1000 > total).limit(1000))
    cold = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(n) * 1000 <= total), key)
    return cold.unionByName(left.join(hot, key))
