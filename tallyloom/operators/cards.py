"""Scorecards: one nested row for each run, their store, listing and comparison.

The store is an append-only folder of JSON rows: a card written again replaces the one of its id, a removal
is a row, too, so no writer has to change what another may be reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUPS = {
    "basic": ("total_trades", "win_count", "loss_count", "tie_count", "win_rate", "loss_rate", "average_win", "average_loss", "profit_factor", "payoff_ratio", "expectancy", "expectancy_per_risk", "long_count", "short_count", "long_win_rate", "short_win_rate"),
    "growth": ("net_pnl", "total_return", "cagr", "cagr_flagged_insufficient", "mean_return_per_trade", "median_return_per_trade", "skew_returns", "excess_kurtosis_returns"),
    "drawdown": ("max_drawdown", "average_drawdown", "max_drawdown_duration_days", "ulcer_index", "recovery_factor", "mtm_max_drawdown"),
    "risk_adj": ("trades_per_year", "rf_per_trade", "sharpe_per_trade", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "omega_ratio", "romad", "tail_ratio", "var_95", "cvar_95", "probabilistic_sharpe_ratio", "deflated_sharpe_ratio", "dsr_n_trials", "annualised", "sharpe_small_sample_corrected", "psr_reference_sharpe"),
    "behav": ("max_win_streak", "max_loss_streak", "streak_ratio", "runs", "runs_z", "best_trade", "worst_trade", "months", "profitable_month_fraction", "monthly_volatility"),
    "regime": ("s_plus_peak", "s_minus_peak", "hits", "threshold_hit", "mean_return_gap", "sharpe_half_gap", "regime_unstable"),
}
CATEGORIES = ("profitability", "risk_adj", "drawdown", "robustness", "sanity", "sufficiency")
SCORING = ("status", "knockout_reason", "raw_score", "final_score", "label", "penalty_product")


def slug(name: Column) -> Column:
    """Small letters and digits, joined by dashes; `strategy` if none is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "strategy").otherwise(s)


def card_id(name: Column, created: Column, salt: Column) -> Column:
    """slug-yyyymmdd-xxxx; the four hexadecimal digits come from `salt`."""
    return F.concat_ws("-", slug(name), F.date_format(created, "yyyyMMdd"), F.substring(F.md5(salt), 1, 4))


def cards(scored: DataFrame, name: Column, created: Column, seed: str) -> DataFrame:
    """One nested row for each strategy: id, name, created_at, seed, the metric groups, categories and scoring."""
    groups = [F.struct(*columns).alias(g) for g, columns in GROUPS.items()]
    categories = F.struct(*(F.col(f"cat_{c}").alias(c) for c in CATEGORIES)).alias("category_scores")
    salt = F.concat_ws(":", F.lit(seed), F.col("strategy_id").cast("string"))
    return scored.select(card_id(name, created, salt).alias("id"), F.col("strategy_id").cast("string").alias("strategy_id"), name.alias("strategy_name"), created.alias("created_at"), F.lit("1.2").alias("version"), F.lit(seed).alias("seed"), *groups, categories, F.struct(*SCORING).alias("scoring"))


def as_json(found: DataFrame) -> DataFrame:
    """(id, document)."""
    return found.select("id", F.to_json(F.struct(*found.columns)).alias("document"))


def from_json(documents: DataFrame, schema) -> DataFrame:
    """Cards from (id, document); documents that cannot be read are left out."""
    read = documents.select(F.from_json("document", schema, {"mode": "PERMISSIVE"}).alias("c")).filter("c.id IS NOT NULL")
    return read.select("c.*")


def schemas(found: DataFrame) -> str:
    """The cards' schema as JSON."""
    return found.schema.json()


def save_cards(found: DataFrame, path: str) -> None:
    found.withColumns({"_saved": F.current_timestamp(), "_removed": F.lit(False)}).write.mode("append").json(path)


def delete_cards(spark: SparkSession, path: str, ids: list[str] | DataFrame, schema) -> bool:
    """Removes the cards of these ids (a list, or a frame with a column `id`); whether there was any."""
    held = load_cards(spark, path, schema).select("id")
    held = held.filter(F.col("id").isin(ids)) if isinstance(ids, list) else held.join(ids.select("id").distinct(), "id", "left_semi")
    if held.isEmpty():
        return False
    held.withColumns({"_saved": F.current_timestamp(), "_removed": F.lit(True)}).write.mode("append").json(path)
    return True


def load_cards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The latest card of each id; lines that are no JSON are skipped."""
    from pyspark.sql.types import BooleanType, StructType, TimestampType

    whole = StructType(list(schema.fields)).add("_saved", TimestampType()).add("_removed", BooleanType())
    rows = spark.read.schema(whole).option("mode", "DROPMALFORMED").json(path)
    latest = Window.partitionBy("id").orderBy(F.col("_saved").desc())
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1 AND NOT _removed").drop("_n", "_saved", "_removed")


def load_card(spark: SparkSession, path: str, card: str, schema) -> DataFrame:
    """The card of an id; a KeyError where there is none."""
    held = load_cards(spark, path, schema).filter(F.col("id") == card)
    if held.isEmpty():
        raise KeyError(f"no card has the id {card}")
    return held


def listing(found: DataFrame) -> DataFrame:
    """Seven fields of each card, the newest first."""
    return found.select("id", "strategy_name", "created_at", F.col("basic.total_trades").alias("total_trades"), F.col("scoring.final_score").alias("final_score"), F.col("scoring.label").alias("label"), F.col("scoring.status").alias("status")).orderBy(F.desc("created_at"), "id")


def values(found: DataFrame, missing: bool = False) -> DataFrame:
    """(id, metric, value): scalars of the five metric groups and categories, truth values as 0 and 1; missing ones as null or left out."""
    pairs = [(f"{g}.{c}", F.col(f"{g}.{c}")) for g, columns in GROUPS.items() if g != "regime" for c in columns]
    pairs += [(f"cat.{c}", F.col(f"category_scores.{c}")) for c in CATEGORIES]
    pairs += [("final_score", F.col("scoring.final_score")), ("raw_score", F.coalesce("scoring.raw_score", F.lit(0.0)))]
    entries = F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in pairs))
    return found.select("id", F.explode(entries).alias("e")).select("id", "e.metric", "e.value").filter(F.lit(missing) | F.col("value").isNotNull())


def compare(found: DataFrame, ids: list[str] | DataFrame, baseline: str | None = None) -> DataFrame:
    """(metric, id, baseline, value, delta_pct) of the cards against the baseline, for the metrics that it has, by metric and id.

    ids: the cards to compare, as a list (the first is the baseline if none is named; a KeyError for ids that no
    card has) or as a frame with a column `id`, joined, for any number of cards.
    """
    if isinstance(ids, list):
        if not ids:
            return values(found.limit(0)).select("metric", "id", F.col("value").alias("baseline"), "value", F.col("value").alias("delta_pct"))
        held = {r["id"] for r in found.filter(F.col("id").isin(ids)).select("id").collect()}  # as many as asked for
        if set(ids) - held:
            raise KeyError(f"no card has the id {min(set(ids) - held)}")
        baseline = baseline or ids[0]
        ids = found.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    chosen = found.join(ids.select("id").distinct(), "id", "left_semi")
    base = F.broadcast(values(found.filter(F.col("id") == baseline)).select("metric", F.col("value").alias("baseline")))  # a few dozen rows
    change = F.when((F.col("id") != baseline) & (F.abs("baseline") > 1e-9), (F.col("value") - F.col("baseline")) / F.abs("baseline") * 100)
    return values(chosen, missing=True).join(base, "metric").select("metric", "id", "baseline", "value", change.alias("delta_pct")).orderBy("metric", "id")
