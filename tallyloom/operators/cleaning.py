"""Cleaning of bronze ledgers: nine steps from raw rows to trades, rejects and a report.

Text columns go through the parsers, typed columns are taken as they are. Duplicates are one grouped
aggregate; all later steps are projections and scans along a strategy, so rows are dealt by strategy once, or by
chunks of strategies where one has more than `chunk_rows` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..plans.config import EvalConfig
from ..plans.lineage import settle
from ..sources.adapters import CANONICAL
from . import scans
from .quantiles import quantiles

REQUIRED = ("timestamp", "side", "quantity", "entry_price", "exit_price")
NUMBERS = ("quantity", "entry_price", "exit_price", "gross_pnl", "commission", "swap", "pnl", "balance")
KEY = ["strategy_id"]


def by_strategy() -> Window:
    return Window.partitionBy("strategy_id")


def in_order() -> Window:
    return Window.partitionBy("strategy_id").orderBy("seq")


def running() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


@dataclass
class Cleaned:
    trades: DataFrame
    rejects: DataFrame
    report: DataFrame


def _kinds(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def is_adjustment(df: DataFrame) -> Column:
    """Rows of balance adjustments: no symbol but a pnl, or named so."""
    symbol = F.coalesce(F.col("symbol").cast("string"), F.lit(""))
    named = F.lower(symbol).startswith("adjustment")
    deal = F.coalesce(F.col("deal_id").cast("string"), F.lit(""))
    placed = F.lower(F.coalesce(F.col("position_id").cast("string"), F.lit(""))).startswith("adjust")
    return ((symbol == "") & F.col("pnl").isNotNull()) | named | ((deal == "") & placed)


def missing_field(df: DataFrame) -> Column:
    """The first required field without a value, as a reason; null for none."""
    kinds = _kinds(df)

    def absent(c: str) -> Column:
        gone = F.col(c).isNull()
        if kinds[c] == "string":
            return gone | (F.col(c) == "")
        return gone | F.isnan(c) if kinds[c] in ("double", "float") else gone

    return F.coalesce(*(F.when(absent(c), f"missing field: {c}") for c in REQUIRED))


def coerced(df: DataFrame) -> DataFrame:
    """Canonical columns as numbers, times and sides; NaN becomes null, missing commission and swap 0."""
    kinds = _kinds(df)

    def number(c: str) -> Column:
        value = parsing.number(F.col(c)) if kinds[c] == "string" else F.col(c).cast("double")
        value = F.nanvl(value, F.lit(None).cast("double"))
        absent = F.col(c).isNull() | (F.trim(c) == "") if kinds[c] == "string" else F.col(c).isNull()
        return F.when(absent, 0.0).otherwise(value) if c in ("commission", "swap") else value

    def when() -> Column:
        kind = kinds["timestamp"]
        if kind == "string":
            bare = F.trim("timestamp")
            return F.when(bare.rlike(r"^\d+(\.\d+)?$"), parsing.serial_time(bare.try_cast("double"))).otherwise(parsing.time(bare))
        return F.col("timestamp").cast("timestamp") if kind.startswith(("timestamp", "date")) else parsing.serial_time(F.col("timestamp").cast("double"))

    changed = {c: number(c) for c in NUMBERS} | {"timestamp": when(), "side": parsing.side(F.col("side").cast("string"))}
    return df.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in df.columns))


def flagged(bronze: DataFrame) -> DataFrame:
    """Coerced rows with `adjustment` and `reason`, why a row is rejected (null for none).

    Rows that break a constraint of trades, quantity 0 or a price not above 0, are rejected, too.
    """
    raw = bronze.select("*", is_adjustment(bronze).alias("adjustment"), missing_field(bronze).alias("_missing"))
    ready = coerced(raw)
    unread = F.greatest(*(F.col(c).isNull().cast("int") for c in REQUIRED)) == 1
    broken = (F.col("quantity") == 0) | (F.col("entry_price") <= 0) | (F.col("exit_price") <= 0)
    reason = F.coalesce(F.col("_missing"), F.when(unread, "type coercion failed on required field"), F.when(broken, "constraint failed on required field"))
    return ready.withColumn("reason", F.when(~F.col("adjustment"), reason)).drop("_missing")


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row of each set of equal rows, the first: everything but row_idx counts. Summed before the shuffle."""
    others = [c for c in rows.columns if c != "row_idx"]
    return rows.groupBy(*others).agg(F.min("row_idx").alias("row_idx"), F.count("*").alias("copies"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with `seq`, from 1 by time and place in the input."""
    return scans.numbered(rows, ["timestamp", "row_idx"])


def flipped(rows: DataFrame) -> DataFrame:
    """Negative quantities turned positive, with the side turned round."""
    turned = F.when(F.col("quantity") < 0, F.when(F.col("side") == "long", "short").otherwise("long")).otherwise(F.col("side"))
    return rows.withColumns({"side": turned, "quantity": F.abs("quantity"), "flipped": F.col("quantity") < 0})


def imputed(rows: DataFrame) -> DataFrame:
    """pnl where it is missing, or 0 against a price move: gross, else the move, plus commission and swap (costs are negative)."""
    fees = F.coalesce("commission", F.lit(0.0)) + F.coalesce("swap", F.lit(0.0))
    naive = F.when(F.col("side") == "long", 1.0).otherwise(-1.0) * F.col("quantity") * (F.col("exit_price") - F.col("entry_price"))
    empty = (F.abs("pnl") < 1e-12) & ((F.abs(naive) > 1e-9) | F.coalesce(F.abs("gross_pnl") > 1e-9, F.lit(False)))
    need = F.col("pnl").isNull() | empty
    return rows.withColumns({"pnl": F.when(need, F.coalesce("gross_pnl", naive) + fees).otherwise(F.col("pnl")), "imputed": need})


def with_median(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a strategy's median; of chunks, whose strategies may be large, by counting."""
    if scans.CHUNK not in rows.columns:
        return rows.withColumn(name, F.percentile(value, F.lit(0.5)).over(by_strategy()))
    rows = settle(rows)
    found = quantiles(rows.select(*KEY, value.cast("double").alias("v")), [0.5]).select(*KEY, F.col("q")[0].alias(name))
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("_rows"))
    return scans.join_hot(rows, sizes.join(found, KEY, "left"), "strategy_id", "_rows").drop("_rows")


def capped(rows: DataFrame, factor: float) -> DataFrame:
    """pnl clamped to the median by `factor` median absolute deviations: median, mad, capped_pnl, is_outlier."""
    off = F.abs(F.col("pnl") - F.col("median"))
    rows = with_median(with_median(rows, "median", F.col("pnl")), "mad", off)
    cap = F.when(F.col("mad") * factor > 0, F.col("mad") * factor).otherwise(1e-9)
    return rows.withColumns(
        {
            "capped_pnl": F.greatest(F.col("median") - cap, F.least(F.col("median") + cap, F.col("pnl"))),
            "is_outlier": F.abs(F.col("pnl") - F.col("median")) > cap,
        }
    )


def balanced(rows: DataFrame, start_balance: float) -> DataFrame:
    """balance_after: the reported balances if a strategy has all of them, else start plus running pnl."""
    rows = scans.of_strategy(scans.running_sums(rows, {"_sum": F.col("pnl")}), {"_whole": F.bool_and(F.col("balance").isNotNull())})
    return rows.withColumn("balance_after", F.when(F.col("_whole"), F.col("balance")).otherwise(F.lit(start_balance) + F.col("_sum"))).drop("_whole", "_sum")


def gapped(rows: DataFrame) -> DataFrame:
    """duration_seconds: since the trade before closed; 1 for the first and for ties."""
    gap = (F.unix_micros("timestamp") - F.unix_micros("_before")) / 1e6
    return scans.lagged(rows, {"_before": F.col("timestamp")}).withColumn("duration_seconds", F.when(gap > 0, gap).otherwise(1.0)).drop("_before")


TRADE = ["strategy_id", "seq", "position_id", "deal_id", "timestamp", "symbol", "side", "quantity", "entry_price", "exit_price", "gross_pnl", "commission", "swap", "pnl", "capped_pnl", "balance_after", "entry_notional", "is_outlier", "duration_seconds"]


def trades_of(flags: DataFrame, config: EvalConfig) -> DataFrame:
    """Steps 3 to 9 on flagged rows: the trades; with `chunk` if any strategy has more than `chunk_rows` rows."""
    kept = flags.filter(~F.col("adjustment") & F.col("reason").isNull()).drop("adjustment", "reason")
    rows = deduplicated(kept).drop("copies")
    if scans.hot_strategies(flags, config.chunk_rows):
        rows = scans.in_chunks(rows, ["timestamp", "row_idx"], config.chunk_rows)
    rows = imputed(flipped(numbered(rows)))
    rows = gapped(balanced(capped(rows, config.mad_cap_factor), config.start_balance))
    rows = rows.withColumns({"symbol": F.coalesce("symbol", F.lit("UNKNOWN")), "commission": F.coalesce("commission", F.lit(0.0)), "swap": F.coalesce("swap", F.lit(0.0)), "entry_notional": F.col("quantity") * F.col("entry_price")})
    return rows.select(*TRADE, *(c for c in (scans.CHUNK,) if c in rows.columns))


def report_of(flags: DataFrame, trades: DataFrame) -> DataFrame:
    """A row for each strategy: rows received, adjustments, rejects, duplicates, outliers, imputed pnl, trades."""
    counts = flags.groupBy(*KEY).agg(
        F.count("*").alias("rows_received"),
        F.count_if("adjustment").alias("adjustments_ignored"),
        F.count_if(F.col("reason").isNotNull()).alias("rows_rejected"),
        F.count_if(~F.col("adjustment") & F.col("reason").isNull()).alias("kept"),
    )
    made = trades.groupBy(*KEY).agg(F.count("*").alias("trades"), F.count_if("is_outlier").alias("outliers_tagged"))
    joined = counts.join(made, KEY, "left")
    zero = F.lit(0).cast("long")
    return joined.select(*KEY, "rows_received", "adjustments_ignored", "rows_rejected", (F.col("kept") - F.coalesce("trades", zero)).alias("duplicates_removed"), F.coalesce("outliers_tagged", zero).alias("outliers_tagged"), F.coalesce("trades", zero).alias("trades"))


def rejects_of(flags: DataFrame) -> DataFrame:
    """Rejected rows with their reason, and with `extras` where the ledger has them."""
    extras = [c for c in ("extras",) if c in flags.columns]
    return flags.filter(F.col("reason").isNotNull()).select(*KEY, "row_idx", *CANONICAL, *extras, F.col("reason").alias("rejection_reason"))


def clean(bronze: DataFrame, config: EvalConfig) -> Cleaned:
    """Trades, rejected rows with their reason, and the report, of a bronze ledger."""
    flags = flagged(bronze)
    trades = trades_of(flags, config)
    return Cleaned(trades, rejects_of(flags), report_of(flags, trades))


def with_extras(rows: DataFrame) -> DataFrame:
    """The column `extras`, JSON objects, as a column for each key that any row has, by name; keys of other columns' names get a `_`."""
    if "extras" not in rows.columns:
        return rows
    keys = sorted(r[0] for r in rows.select(F.explode(F.json_object_keys("extras"))).distinct().collect())  # column names
    others = [c for c in rows.columns if c != "extras"]
    taken, named = {c.lower() for c in others}, {}
    for key in keys:
        name = key
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        named[name] = F.try_element_at(F.from_json("extras", "map<string,string>"), F.lit(key))
    return rows.select(*others, *(c.alias(n) for n, c in named.items()))


def write_rejects(rejects: DataFrame, path: str) -> bool:
    """Rejected rows as CSV with a header, with all columns that any of them has; whether there were any, nothing is written for none.

    Quotes within values are doubled.
    """
    if rejects.isEmpty():
        return False
    with_extras(rejects).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True
