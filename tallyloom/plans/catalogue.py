"""The registered queries over the driver's tables, one for each operator; their SQL is in `ledger_sql`.

Doubles are rounded in both, as sums depend on the order of rows in their last digits. The resampling, score and
card queries make the default number of paths, 1000 a strategy and test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing, scalars
from ..operators import cards, cleaning, metrics, presentation, regime, resample, scans, scorecards, scoring, series, validation
from ..sources import adapters, deals, reports
from . import evaluate, ledger_sql
from .config import EvalConfig
from .lineage import settle, shared_folder

CONFIG = EvalConfig(seed="7")
SUPPLIERS = EvalConfig(seed="7", start_balance=1_000_000.0)
KEY = "strategy_id"
STRONG, BASE = ("error",), ("error", "view")
FLAGSHIP = "strategy_overview"
DIGITS = 9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = dict(ledger_sql.SQL)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to `digits` places; -0 becomes 0."""

    def cut(name: str, kind: str):
        if kind == "double":
            return (F.round(name, digits) + F.lit(0.0)).alias(name)
        if kind == "array<double>":
            return F.transform(name, lambda x: F.round(x, digits) + F.lit(0.0)).alias(name)
        return F.col(name)

    return df.select(*(cut(n, k) for n, k in df.dtypes))


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str, losing: tuple[str, ...] = STRONG) -> DataFrame:
    return adapters.events_ledger(table(spark, sf_dir, "events"), losing)


def trades(spark: SparkSession, sf_dir: str, losing: tuple[str, ...] = STRONG) -> DataFrame:
    return cleaning.clean(ledger(spark, sf_dir, losing), CONFIG).trades


def facts(spark: SparkSession, sf_dir: str, losing: tuple[str, ...] = STRONG) -> DataFrame:
    return metrics.trade_facts(trades(spark, sf_dir, losing), CONFIG)


def supplier_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(adapters.lineitem_ledger(table(spark, sf_dir, "lineitem")), SUPPLIERS).trades


def outcomes(rows: DataFrame) -> DataFrame:
    """Of trades, what curves, months, streaks and paths are made of, so that nothing else is shuffled and settled."""
    return rows.select(KEY, "seq", "timestamp", "capped_pnl", *(c for c in (scans.CHUNK,) if c in rows.columns))


def spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events ledger with every fault that cleaning knows, by the remainder of the event's number."""
    rows = ledger(spark, sf_dir)
    every = lambda n: F.col("row_idx") % n == 0
    rows = rows.select(
        KEY,
        "row_idx",
        "position_id",
        "deal_id",
        F.when(every(17), None).when(every(19), "Adjustment fee").otherwise(F.col("symbol")).alias("symbol"),
        "timestamp",
        F.when(every(23), "hold").otherwise(F.col("side")).alias("side"),
        F.when(every(29), None).when(every(31), -1.0).otherwise(F.col("quantity")).alias("quantity"),
        "entry_price",
        F.when(every(37), 0.0).otherwise(F.col("exit_price")).alias("exit_price"),
        F.when(every(22), F.lit(5.0)).alias("gross_pnl"),
        F.when(every(3), -0.5).alias("commission"),
        F.when(every(5), -0.25).alias("swap"),
        F.when(every(11), None).when(every(41), F.col("pnl") * 50).otherwise(F.col("pnl")).alias("pnl"),
        "balance",
    )
    return rows.unionByName(rows.filter(every(13)).withColumn("row_idx", F.col("row_idx") + 1_000_000_000))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.flagged(spoilt(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).filter(~F.col("adjustment") & F.col("reason").isNull()).drop("adjustment", "reason")


def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.deduplicated(kept(spark, sf_dir)).drop("copies")


# ---- sources and parsing


@query
def ingest_alias_resolve(spark, sf_dir):
    """Each order is a header: one of the known names, written in one of four ways, or its priority, which is none."""
    names = sorted({n for known in (reports.HTML_HEADERS, reports.TABLE_HEADERS) for held in known.values() for n in held})
    key = F.col("o_orderkey")
    plain = F.get(F.array(*map(F.lit, names)), (key % len(names)).cast("int"))
    name = F.when(key % 11 == 0, F.col("o_orderpriority")).when(key % 4 == 0, F.upper(plain)).when(key % 4 == 1, F.initcap(plain)).when(key % 4 == 2, F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  \u00a0")), F.lit("\t"))).otherwise(plain)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    return rows.select("o_orderkey", "name", reports.canonical_html_of(F.col("name")).alias("html"), reports.canonical_table_of(F.col("name")).alias("plain"))


@query
def ingest_number_parse_us(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", parsing.number(F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))).alias("value"))


@query
def ingest_number_parse_eu(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", parsing.number(F.concat(F.lit("-"), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), F.lit(" EUR"))).alias("value"))


@query
def ingest_timestamp_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd.MM.yyyy HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "d/M/yyyy HH:mm:ss"))
    return rows.select("event_id", parsing.time(text).cast("timestamp_ntz").alias("at"))


@query
def ingest_side_coerce(spark, sf_dir):
    words = F.element_at(F.create_map(*map(F.lit, ("view", " Buy", "click", "SHORT", "signup", "+1", "error", "-1", "purchase", "hold"))), F.col("event_type"))
    return table(spark, sf_dir, "events").select(parsing.side(words).alias("side")).groupBy("side").agg(F.count("*").alias("n"))


@query
def ingest_excel_serial(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    return rows.select("l_orderkey", "l_linenumber", parsing.serial_time(days + 0.25).cast("timestamp_ntz").alias("at"))


@query
def ingest_sha256(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return reports.file_info(found).select("path", "format", "sha256")


def _read_back(spark, sf_dir, kind: str, style: str = "us", separator: str = ","):
    bronze = ledger(spark, sf_dir, BASE)
    if kind == "xlsx":
        found = reports.render_xlsx(bronze)
    else:
        found = reports.render(reports.as_text(bronze, style), kind, separator)
    rows = cleaning.coerced(reports.read_reports(found, F.col("strategy_id")))
    return rows.select("strategy_id", "deal_id", "symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "side", "quantity", "entry_price", "exit_price", "pnl")


@query
def ingest_csv_roundtrip(spark, sf_dir):
    return _read_back(spark, sf_dir, "csv", "eu", ";")


@query
def ingest_html_roundtrip(spark, sf_dir):
    return _read_back(spark, sf_dir, "html")


@query
def ingest_xlsx_roundtrip(spark, sf_dir):
    return _read_back(spark, sf_dir, "xlsx")


@query
def deals_fifo(spark, sf_dir):
    """Lines as deals of suppliers: lines of odd numbers open, those of even numbers close; returned lines are of short positions."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    opens, short = F.col("l_linenumber") % 2 == 1, F.col("l_returnflag") == "R"
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(KEY),
        F.col("l_linestatus").alias("symbol"),
        F.row_number().over(order).alias("row_idx"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        F.when(opens, "in").otherwise("out").alias("direction"),
        F.when(opens == short, "sell").otherwise("buy").alias("type"),
        (F.col("l_quantity") / 100).alias("volume"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (-F.col("l_tax")).alias("commission"),
        F.lit(0.0).alias("swap"),
        F.lit(None).cast("double").alias("profit"),
    )
    found = deals.ledger(rows.withColumn("deal_id", F.col("row_idx").cast("string")))
    return found.select(KEY, "symbol", "side", "deal_id", "quantity", "entry_price", "exit_price", "commission", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


# ---- cleaning


@query
def clean_adjustments(spark, sf_dir):
    return flags(spark, sf_dir).groupBy(KEY).agg(F.count_if("adjustment").alias("adjustments"), F.count("*").alias("n"))


@query
def clean_required_rejects(spark, sf_dir):
    found = cleaning.clean(spoilt(spark, sf_dir), CONFIG).rejects
    return found.select(KEY, "row_idx", "rejection_reason")


@query
def clean_extras(spark, sf_dir):
    """Rows that differ only in a column of their own stay apart, and rejects keep that column."""
    rows = ledger(spark, sf_dir).withColumn("note", F.col("row_idx").cast("string"))
    rows = rows.withColumns({"extras": F.concat(F.lit('{"note": "'), "note", F.lit('"}')), "quantity": F.when(F.col("row_idx") % 7 != 0, F.col("quantity"))}).drop("note")
    same = {"deal_id": F.lit("d"), "timestamp": F.lit("2025-01-01").cast("timestamp"), "symbol": F.lit("X"), "side": F.lit("buy"), "exit_price": F.lit(1001.0), "pnl": F.lit(1.0)}
    got = cleaning.clean(rows.withColumns(same), CONFIG)
    kept = got.trades.groupBy(KEY).agg(F.count("*").alias("kept"))
    gone = got.rejects.groupBy(KEY).agg(F.count("*").alias("rejected"), F.max("extras").alias("last_note"))
    zero = F.lit(0).cast("long")
    return kept.join(gone, KEY, "full").select(KEY, F.coalesce("kept", zero).alias("kept"), F.coalesce("rejected", zero).alias("rejected"), F.coalesce("last_note", F.lit("")).alias("last_note"))


@query
def clean_rejects_csv(spark, sf_dir):
    """Rejects written as CSV and read again."""
    path = shared_folder(spark, "rejects")
    if not cleaning.write_rejects(cleaning.clean(spoilt(spark, sf_dir), CONFIG).rejects, path):
        return spark.createDataFrame([], "strategy_id long, row_idx long, rejection_reason string")
    return spark.read.option("header", True).option("escape", '"').csv(path).select(F.col(KEY).cast("long"), F.col("row_idx").cast("long"), "rejection_reason")


@query
def clean_dedup(spark, sf_dir):
    return cleaning.deduplicated(kept(spark, sf_dir)).select(KEY, "row_idx", "copies")


@query
def clean_sort_seq(spark, sf_dir):
    bronze = adapters.lineitem_ledger(table(spark, sf_dir, "lineitem"))
    return cleaning.numbered(bronze).groupBy(KEY).agg(F.max("seq").alias("n"), F.sum(F.col("seq") * F.col("row_idx")).alias("weighted"), F.max_by("deal_id", "seq").alias("last_deal"))


@query
def clean_negative_flip(spark, sf_dir):
    return cleaning.flipped(unique(spark, sf_dir)).select(KEY, "row_idx", "side", "quantity", "flipped")


@query
def clean_pnl_impute(spark, sf_dir):
    return cleaning.imputed(cleaning.flipped(unique(spark, sf_dir))).select(KEY, "row_idx", "pnl", "imputed")


@query
def clean_pnl_impute_lines(spark, sf_dir):
    rows = supplier_trades(spark, sf_dir)
    return rows.groupBy(KEY).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 5).alias("pnl"), F.round(F.sum("commission"), 5).alias("commission"), F.count_if(F.col("pnl") > 0).alias("won"))


@query
def clean_zero_duration(spark, sf_dir):
    rows = cleaning.numbered(adapters.lineitem_ledger(table(spark, sf_dir, "lineitem")))
    return cleaning.gapped(rows).groupBy(KEY).agg(F.count_if((F.col("duration_seconds") == 1.0) & (F.col("seq") > 1)).alias("tied"))


@query
def clean_mad_cap(spark, sf_dir):
    rows = cleaning.capped(cleaning.imputed(cleaning.flipped(unique(spark, sf_dir))), CONFIG.mad_cap_factor)
    return rows.select(KEY, "row_idx", "median", "mad", "capped_pnl", "is_outlier")


@query
def clean_balance(spark, sf_dir):
    return cleaning.balanced(cleaning.imputed(cleaning.flipped(cleaning.numbered(unique(spark, sf_dir)))), CONFIG.start_balance).select(KEY, "seq", "balance_after")


@query
def clean_gap_duration(spark, sf_dir):
    return cleaning.gapped(cleaning.numbered(unique(spark, sf_dir))).select(KEY, "seq", "duration_seconds")


@query
def clean_report(spark, sf_dir):
    return cleaning.clean(spoilt(spark, sf_dir), CONFIG).report


# ---- series


@query
def trade_returns(spark, sf_dir):
    return facts(spark, sf_dir).select(KEY, "seq", "balance_before", F.round("R", 9).cast("decimal(20,9)").cast("string").alias("ret"))


@query
def equity_curve(spark, sf_dir):
    return series.equity_curve(trades(spark, sf_dir), CONFIG).select(KEY, "seq", F.col("t").cast("timestamp_ntz").alias("t"), "balance", "peak", "dd")


@query
def equity_mtm(spark, sf_dir):
    return series.marked_equity(trades(spark, sf_dir), CONFIG).groupBy(KEY).agg(F.count("*").alias("points"), F.max("balance").alias("high"), F.min("dd").alias("mtm_max_drawdown"), F.sum("balance").alias("total")).select(KEY, "points", *(F.round(c, 6).alias(c) for c in ("high", "mtm_max_drawdown")), F.round("total", 4).alias("total"))


@query
def equity_mtm_ties(spark, sf_dir):
    """Suppliers' ledgers, whose trades of one day overlap."""
    return metrics.marked_drawdown(supplier_trades(spark, sf_dir), SUPPLIERS).withColumn("mtm_max_drawdown", F.round("mtm_max_drawdown", 6))


@query
def monthly_returns(spark, sf_dir):
    """Suppliers' ledgers, which span years."""
    return series.monthly_returns(series.equity_curve(supplier_trades(spark, sf_dir), SUPPLIERS))


# ---- metrics


@query
def strategy_overview(spark, sf_dir):
    return evaluate.overview(ledger(spark, sf_dir), CONFIG)


@query
def metrics_basic(spark, sf_dir):
    return metrics.basic(trades(spark, sf_dir))


@query
def metrics_growth(spark, sf_dir):
    return metrics.growth(facts(spark, sf_dir), CONFIG).select(KEY, "n", "days", "net_pnl", "total_return", "cagr", "cagr_flagged_insufficient", "mean_return_per_trade", "median_return_per_trade")


@query
def metrics_moments(spark, sf_dir):
    return metrics.growth(facts(spark, sf_dir), CONFIG).select(KEY, "skew_returns", "excess_kurtosis_returns")


@query
def metrics_drawdown(spark, sf_dir):
    return metrics.drawdown(facts(spark, sf_dir), CONFIG)


@query
def metrics_drawdown_lines(spark, sf_dir):
    rows = supplier_trades(spark, sf_dir)
    return metrics.drawdown(series.with_equity(rows, SUPPLIERS), SUPPLIERS)


@query
def metrics_dd_duration(spark, sf_dir):
    return metrics.drawdown_duration(facts(spark, sf_dir))


def _risk(spark, sf_dir, losing=STRONG):
    f = settle(facts(spark, sf_dir, losing))
    return metrics.risk_adjusted(f, metrics.growth(f, CONFIG), metrics.drawdown(f, CONFIG), CONFIG)


@query
def metrics_risk_adj(spark, sf_dir):
    return _risk(spark, sf_dir).select(KEY, "trades_per_year", "rf_per_trade", "sharpe_per_trade", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "omega_ratio", "romad", "annualised", "sharpe_small_sample_corrected", "psr_reference_sharpe")


@query
def metrics_tail(spark, sf_dir):
    return metrics.tails(facts(spark, sf_dir))


@query
def metrics_streaks(spark, sf_dir):
    return metrics.streaks(trades(spark, sf_dir))


@query
def metrics_runs_z(spark, sf_dir):
    return metrics.runs_test(trades(spark, sf_dir))


@query
def metrics_behavioural(spark, sf_dir):
    rows = settle(outcomes(supplier_trades(spark, sf_dir)))
    return metrics.behavioural(rows, series.monthly_returns(series.equity_curve(rows, SUPPLIERS))).select(KEY, "best_trade", "worst_trade", "months", "profitable_month_fraction", "monthly_volatility")


@query
def cusum_full(spark, sf_dir):
    return regime.cusum(facts(spark, sf_dir), CONFIG)


@query
def cusum_halves(spark, sf_dir):
    found = regime.cusums(facts(spark, sf_dir), CONFIG)
    return found.select(KEY, *(F.col(f"{h}.{c}").alias(f"{h}_{c}") for h in ("first", "second") for c in ("s_plus_peak", "s_minus_peak", "hits", "threshold_hit")))


@query
def regime_halves(spark, sf_dir):
    return regime.halves(facts(spark, sf_dir))


@query
def regime_flag(spark, sf_dir):
    return regime.regime_check(settle(facts(spark, sf_dir, BASE)), CONFIG).select(KEY, "threshold_hit", "regime_unstable")


@query
def psr(spark, sf_dir):
    return _risk(spark, sf_dir).select(KEY, "probabilistic_sharpe_ratio")


@query
def expected_max_sharpe(spark, sf_dir):
    """As if each of a user's events were a trial, and for all users together each user."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("trials_of")).agg(F.count("*").alias("n_trials"))
    rows = rows.unionByName(rows.agg(F.lit("all users").alias("trials_of"), F.count("*").alias("n_trials")))
    return rows.select("trials_of", "n_trials", F.round(scalars.expected_max_sharpe_of(F.col("n_trials")), 8).alias("reference"))


@query
def dsr(spark, sf_dir):
    return _risk(spark, sf_dir).select(KEY, "deflated_sharpe_ratio")


@query
def norm_cdf(spark, sf_dir):
    values = table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 50) / 25).alias("x"))
    return values.select("event_id", scalars.normal_cdf(F.col("x")).alias("p"))


@query
def norm_sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.sigmoid(F.col("value"), 50.0, 0.1).alias("up"), scalars.falling_sigmoid(F.col("value"), 50.0, 0.1).alias("down"))


@query
def norm_piecewise(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.piecewise(F.col("value"), scoring.COUNT_ANCHORS).alias("y"))


@query
def shown_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "win_rate").otherwise("expectancy").alias("metric"), "value")
    return rows.select("event_id", scalars.shown(F.col("metric"), F.col("value")).alias("text"))


# ---- resampling


def _mc(spark, sf_dir, test: str, config: EvalConfig = CONFIG):
    rows = settle(outcomes(trades(spark, sf_dir)))
    fallen = metrics.drawdown(series.with_equity(rows, config), config)
    out = resample.run_tests(rows, config, drawdowns=fallen, tests=(test,)).drop("test")
    points = [(m, i, round(p * 100)) for m in resample.MEASURES for i, p in enumerate(resample.PERCENTILES)]
    return out.select("*", *(F.round(F.col(m)[i], 9 if m == "total_return" else 8).alias(f"{m}_p{p}") for m, i, p in points)).drop(*resample.MEASURES)


@query
def mc_bootstrap(spark, sf_dir):
    return _mc(spark, sf_dir, "a")


@query
def mc_permutation(spark, sf_dir):
    return _mc(spark, sf_dir, "b")


@query
def mc_stationary(spark, sf_dir):
    return _mc(spark, sf_dir, "c")


@query
def mc_moving_block(spark, sf_dir):
    return _mc(spark, sf_dir, "mb")


@query
def mc_correlation_flag(spark, sf_dir):
    rows = settle(outcomes(trades(spark, sf_dir)))
    return resample.correlation(resample.run_tests(rows, CONFIG, tests=("a", "c", "mb")))


# ---- score


def _scalars(spark, sf_dir, losing=STRONG):
    return evaluate.evaluate(ledger(spark, sf_dir, losing), CONFIG, evaluate.SCORED_TESTS).metrics


@query
def score_knockouts(spark, sf_dir):
    return scoring.score(_scalars(spark, sf_dir, BASE)).select(KEY, "status", F.col("knockout_reason").alias("reason"), "final_score", "label")


@query
def score_categories(spark, sf_dir):
    return scoring.with_categories(_scalars(spark, sf_dir)).select(KEY, *(f"cat_{c}" for c in scoring.WEIGHTS))


@query
def score_penalties(spark, sf_dir):
    return scoring.with_penalties(_scalars(spark, sf_dir, BASE)).select(KEY, *(f"pen_{c}" for c in scoring.penalties()), "penalty_product")


@query
def score_final(spark, sf_dir):
    return scoring.score(_scalars(spark, sf_dir)).select(KEY, "status", "raw_score", "final_score", "label")


@query
def overfit_estimate(spark, sf_dir):
    return scoring.overfitting(_scalars(spark, sf_dir))


# ---- backtest overfitting


@query
def cscv_choices(spark, sf_dir):
    return validation.cscv(facts(spark, sf_dir), 8)


@query
def cscv_overfitting_probability(spark, sf_dir):
    return validation.overfitting_probability(validation.cscv(facts(spark, sf_dir), 12))


@query
def design_gates(spark, sf_dir):
    f = settle(facts(spark, sf_dir, BASE))
    pbo = validation.overfitting_probability(validation.cscv(f, 8)).first()["pbo"]  # one number
    found = metrics.basic(f).join(metrics.risk_adjusted(f, metrics.growth(f, CONFIG), metrics.drawdown(f, CONFIG), CONFIG).drop("n"), KEY)
    return validation.design_gates(found, F.lit(pbo).cast("double"))


@query
def purged_folds(spark, sf_dir):
    """Lines as trades of suppliers, open for as many days as their quantity, many at once."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias(KEY), F.row_number().over(order).alias("seq"), (out - F.round("l_quantity").cast("long") * 86_400_000_000).alias("entry"), out.alias("exit"), (0.055 - F.col("l_discount")).alias("R"))
    return validation.purged_folds(rows, folds=5, embargo=0.02)


def _windows(spark, sf_dir):
    rows = supplier_trades(spark, sf_dir).select(KEY, "timestamp", (F.col("capped_pnl") / SUPPLIERS.start_balance).alias("R"))
    return validation.walk_forward(rows, inside=12, outside=3)


@query
def walk_forward_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query
def walk_forward_efficiency(spark, sf_dir):
    found = validation.walk_forward_efficiency(_windows(spark, sf_dir))
    return found.withColumn("efficiency", F.round("efficiency", 6))


# ---- cards and presentation


def _cards(spark, sf_dir):
    created = F.timestamp_seconds(F.lit(1_735_689_600) + F.col("strategy_id") * 60)
    return cards.cards(scoring.score(_scalars(spark, sf_dir)), F.concat(F.lit(" User #"), F.col("strategy_id").cast("string")), created, CONFIG.seed)


@query
def card_json_roundtrip(spark, sf_dir):
    found = _cards(spark, sf_dir)
    return cards.from_json(cards.as_json(found), found.schema).select("id", "strategy_id", "strategy_name", "seed", F.col("basic.total_trades").alias("total_trades"), F.col("basic.profit_factor").alias("profit_factor"), F.col("scoring.status").alias("status"))


@query
def scorecards_whole(spark, sf_dir):
    """Whole cards and the curves too long for one row through JSON and back; some of every part."""
    done = evaluate.evaluate(ledger(spark, sf_dir), CONFIG)
    created = F.timestamp_seconds(F.lit(1_735_689_600) + F.col("strategy_id") * 60)
    made = (done, F.concat(F.lit("User "), F.col("strategy_id").cast("string")), created, CONFIG)
    through = lambda found: cards.from_json(cards.as_json(found), found.schema)
    back = through(scorecards.whole_cards(*made, most_points=scorecards.MOST_POINTS))
    parts = through(scorecards.curve_parts(*made, most_points=scorecards.MOST_POINTS))
    points, last = F.size("equity_curve").cast("long"), F.element_at("equity_curve", -1)["balance"]
    long = parts.groupBy("id").agg(F.sum(points).alias("_points"), F.max_by(last, "first").alias("_last"))
    there = F.col("equity_curve").isNotNull()
    m = F.col("metrics")
    return back.join(F.broadcast(long), "id", "left").select(
        "name",
        m["basic"]["total_trades"].alias("total_trades"),
        m["basic"]["expectancy_per_unit_risk"].alias("expectancy_per_unit_risk"),
        m["growth"]["net_pnl"].alias("net_pnl"),
        m["risk_adj"]["sharpe_ratio"].alias("sharpe_ratio"),
        m["behav"]["runs_z_score"].alias("runs_z_score"),
        m["behav"]["regime_check"]["regime_unstable_flag"].alias("regime_unstable"),
        "correlation_flag",
        F.col("monte_carlo.test_a.robustness_rate").alias("iid_robustness_rate"),
        F.col("moving_block.block_length").alias("block_length"),
        F.col("cleaning_report.rows_received").alias("rows_received"),
        F.col("overfitting.n_obs").alias("n_obs"),
        F.col("scoring.status").alias("status"),
        F.col("scoring.final_score").alias("final_score"),
        F.when(there, points).otherwise(F.col("_points")).alias("points"),
        F.round(F.when(there, last).otherwise(F.col("_last")), 6).alias("last_balance"),
        F.size("monthly_returns").cast("long").alias("months"),
    )


@query
def card_list(spark, sf_dir):
    return cards.listing(_cards(spark, sf_dir)).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def compare_cards(spark, sf_dir):
    found = settle(_cards(spark, sf_dir))
    first = found.filter("strategy_id = '0'").select("id").first()
    # many values lie halfway between two decimals; a trillionth more takes both sides past that alike
    return cards.compare(found, found.select("id"), first["id"] if first else None).withColumns({c: F.round(F.col(c) * (1 + 1e-12), 4 if c == "delta_pct" else 8) for c in ("baseline", "value", "delta_pct")})


@query
def card_store(spark, sf_dir):
    """Cards written twice and half of them removed again, as a folder of JSON rows holds them then."""
    counts = metrics.basic(trades(spark, sf_dir))
    found = counts.select(cards.card_id(F.concat(F.lit("User "), F.col("strategy_id").cast("string")), F.lit("2025-01-01").cast("timestamp"), F.concat_ws(":", F.lit(CONFIG.seed), F.col("strategy_id").cast("string"))).alias("id"), "strategy_id", "total_trades")
    path = shared_folder(spark, "cards")
    cards.save_cards(found.withColumn("total_trades", F.lit(0).cast("long")), path)
    cards.save_cards(found, path)
    cards.delete_cards(spark, path, found.filter("strategy_id % 2 = 0").select("id"), found.schema)
    return cards.load_cards(spark, path, found.schema).select("id", "total_trades")


@query
def pnl_histogram(spark, sf_dir):
    return presentation.pnl_histogram(series.equity_curve(trades(spark, sf_dir), CONFIG))


@query
def monthly_heatmap(spark, sf_dir):
    return presentation.monthly_heatmap(series.monthly_returns(series.equity_curve(supplier_trades(spark, sf_dir), SUPPLIERS)))


@query
def percentile_chart(spark, sf_dir):
    return presentation.percentile_chart(resample.run_tests(settle(outcomes(trades(spark, sf_dir))), CONFIG, tests=("a",))).withColumn("value", F.round("value", 7))


@query
def drawdown_chart(spark, sf_dir):
    return presentation.drawdown_chart(series.equity_curve(trades(spark, sf_dir), CONFIG))


@query
def portfolio_by_symbol_side(spark, sf_dir):
    return trades(spark, sf_dir).cube("symbol", "side").agg(F.count("*").alias("n"), F.sum("capped_pnl").alias("pnl"))
