"""DuckDB SQL of the registered queries, written from the definitions, over the same tables."""

from __future__ import annotations

from ..functions import scalars
from ..sources import reports

SQL: dict[str, str] = {}


def rounded(sql: str, columns: str, digits: int = 9) -> str:
    """The rows of `sql` with these double columns rounded."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0::DOUBLE AS {c}' for c in columns.split())}) FROM ({sql})"


def add(name: str, sql: str, columns: str = "", digits: int = 9) -> None:
    SQL[name] = rounded(sql, columns, digits) if columns else sql


def bronze(losing: str = "'error'") -> str:
    lost = f"event_type IN ({losing})"
    return f"""bronze AS (SELECT user_id AS strategy_id, event_id AS row_idx, event_id::VARCHAR AS deal_id, event_type AS symbol, ts AS timestamp,
  CASE WHEN {lost} THEN 'short' ELSE 'long' END AS side, 1.0::DOUBLE AS quantity, 1000.0::DOUBLE AS entry_price, 1000.0::DOUBLE + value AS exit_price,
  CASE WHEN {lost} THEN -value ELSE value END AS pnl FROM events)"""


def trades(losing: str = "'error'") -> str:
    return f"""{bronze(losing)},
med AS (SELECT strategy_id, quantile_cont(pnl, 0.5) AS median FROM bronze GROUP BY ALL),
dev AS (SELECT strategy_id, any_value(median) AS median, greatest(quantile_cont(abs(pnl - median), 0.5) * 10, 0) AS dist FROM bronze JOIN med USING (strategy_id) GROUP BY ALL),
cap AS (SELECT strategy_id, median, CASE WHEN dist > 0 THEN dist ELSE 1e-9::DOUBLE END AS cap FROM dev),
trades AS (SELECT b.*, row_number() OVER w AS seq, greatest(median - cap, least(median + cap, pnl)) AS capped_pnl, abs(pnl - median) > cap AS is_outlier,
    10000.0::DOUBLE + sum(pnl) OVER (w ROWS UNBOUNDED PRECEDING) AS balance_after,
    CASE WHEN epoch_us(timestamp) > lag(epoch_us(timestamp)) OVER w THEN (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1e6::DOUBLE ELSE 1.0::DOUBLE END AS duration_seconds
  FROM bronze b JOIN cap USING (strategy_id) WINDOW w AS (PARTITION BY strategy_id ORDER BY timestamp, row_idx))"""


def facts(losing: str = "'error'") -> str:
    return f"""{trades(losing)},
bb AS (SELECT *, coalesce(lag(balance_after) OVER w, balance_after - capped_pnl) AS balance_before, 10000.0::DOUBLE + sum(capped_pnl) OVER (w ROWS UNBOUNDED PRECEDING) AS balance
  FROM trades WINDOW w AS (PARTITION BY strategy_id ORDER BY seq)),
pk AS (SELECT *, greatest(10000.0::DOUBLE, max(balance) OVER (PARTITION BY strategy_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak,
  bool_and(abs(balance_before) > 1e-9) OVER (PARTITION BY strategy_id) AS usable FROM bb),
facts AS (SELECT *, capped_pnl / CASE WHEN usable THEN balance_before ELSE quantity * entry_price END AS R, (balance - peak) / CASE WHEN peak > 0 THEN peak ELSE 1 END AS dd FROM pk)"""


SPOILT = f"""{bronze()},
one AS (SELECT strategy_id, row_idx, deal_id, CASE WHEN row_idx % 17 = 0 THEN NULL WHEN row_idx % 19 = 0 THEN 'Adjustment fee' ELSE symbol END AS symbol, timestamp,
  CASE WHEN row_idx % 23 = 0 THEN 'hold' ELSE side END AS side, CASE WHEN row_idx % 29 = 0 THEN NULL WHEN row_idx % 31 = 0 THEN -1.0::DOUBLE ELSE quantity END AS quantity, entry_price,
  CASE WHEN row_idx % 37 = 0 THEN 0.0::DOUBLE ELSE exit_price END AS exit_price, CASE WHEN row_idx % 22 = 0 THEN 5.0::DOUBLE END AS gross_pnl,
  CASE WHEN row_idx % 3 = 0 THEN -0.5::DOUBLE ELSE 0 END AS commission, CASE WHEN row_idx % 5 = 0 THEN -0.25::DOUBLE ELSE 0 END AS swap,
  CASE WHEN row_idx % 11 = 0 THEN NULL WHEN row_idx % 41 = 0 THEN pnl * 50 ELSE pnl END AS pnl FROM bronze),
spoilt AS (SELECT * FROM one UNION ALL SELECT * REPLACE (row_idx + 1000000000 AS row_idx) FROM one WHERE row_idx % 13 = 0),
flags AS (SELECT *, (symbol IS NULL AND pnl IS NOT NULL) OR coalesce(symbol LIKE 'Adjustment%', false) AS adjustment,
  CASE WHEN quantity IS NULL THEN 'missing field: quantity' WHEN side = 'hold' THEN 'type coercion failed on required field' WHEN exit_price <= 0 THEN 'constraint failed on required field' END AS fault FROM spoilt),
judged AS (SELECT *, CASE WHEN NOT adjustment THEN fault END AS reason FROM flags),
uni AS (SELECT * EXCLUDE (row_idx, adjustment, fault, reason), min(row_idx) AS row_idx, count(*) AS copies FROM judged WHERE NOT adjustment AND reason IS NULL GROUP BY ALL),
flip AS (SELECT * REPLACE (CASE WHEN quantity < 0 THEN CASE side WHEN 'long' THEN 'short' ELSE 'long' END ELSE side END AS side, abs(quantity) AS quantity), quantity < 0 AS flipped FROM uni),
nav AS (SELECT *, CASE side WHEN 'long' THEN 1 ELSE -1 END * quantity * (exit_price - entry_price) AS naive FROM flip),
imp AS (SELECT * REPLACE (CASE WHEN need THEN coalesce(gross_pnl, naive) + commission + swap ELSE pnl END AS pnl)
  FROM (SELECT *, pnl IS NULL OR (abs(pnl) < 1e-12 AND (abs(naive) > 1e-9 OR coalesce(abs(gross_pnl) > 1e-9, false))) AS need FROM nav)),
md AS (SELECT strategy_id, quantile_cont(pnl, 0.5) AS median FROM imp GROUP BY ALL),
mad AS (SELECT strategy_id, any_value(median) AS median, quantile_cont(abs(pnl - median), 0.5) AS mad FROM imp JOIN md USING (strategy_id) GROUP BY ALL),
seqd AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY timestamp, row_idx) AS seq FROM imp),
capd AS (SELECT *, greatest(median - cap, least(median + cap, pnl)) AS capped_pnl, abs(pnl - median) > cap AS is_outlier
  FROM (SELECT *, CASE WHEN mad * 10 > 0 THEN mad * 10 ELSE 1e-9::DOUBLE END AS cap FROM seqd JOIN mad USING (strategy_id)))"""

LINES = """lines AS (SELECT l_suppkey AS strategy_id, l_shipdate AS timestamp, l_orderkey || '-' || l_linenumber AS deal_id, l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS side,
  l_extendedprice / l_quantity AS entry_price, l_extendedprice / l_quantity * (1.055::DOUBLE - l_discount) AS exit_price, -0.001::DOUBLE * l_extendedprice AS commission, -l_tax AS swap,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS row_idx FROM lineitem),
priced AS (SELECT *, CASE side WHEN 'long' THEN 1 ELSE -1 END * quantity * (exit_price - entry_price) + commission + swap AS pnl FROM (SELECT * FROM lines
  QUALIFY row_number() OVER (PARTITION BY strategy_id, timestamp, deal_id, quantity, side, entry_price, exit_price, commission, swap ORDER BY row_idx) = 1)),
lmed AS (SELECT strategy_id, quantile_cont(pnl, 0.5) AS median FROM priced GROUP BY ALL),
lcap AS (SELECT strategy_id, any_value(median) AS median, quantile_cont(abs(pnl - median), 0.5) * 10 AS cap FROM priced JOIN lmed USING (strategy_id) GROUP BY ALL),
ltrades AS (SELECT p.*, greatest(median - cap, least(median + cap, pnl)) AS capped_pnl, row_number() OVER (PARTITION BY strategy_id ORDER BY timestamp, row_idx) AS seq FROM priced p JOIN lcap USING (strategy_id))"""

LFACTS = f"""{LINES}, lb AS (SELECT *, 1000000.0::DOUBLE + sum(capped_pnl) OVER (PARTITION BY strategy_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS balance FROM ltrades),
lc AS (SELECT *, greatest(1000000.0::DOUBLE, max(balance) OVER (PARTITION BY strategy_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak FROM lb), facts AS (SELECT *, (balance - peak) / peak AS dd FROM lc)"""

# ---- sources and parsing

_HEADERS = {kind: "(VALUES " + ", ".join(f"('{n}', '{c}')" for c, names in known.items() for n in names) + ") AS {0}(name, known)" for kind, known in (("html", reports.HTML_HEADERS), ("plain", reports.TABLE_HEADERS))}
_NAMES = sorted({n for known in (reports.HTML_HEADERS, reports.TABLE_HEADERS) for held in known.values() for n in held})
add(
    "ingest_alias_resolve",
    f"""WITH p AS (SELECT *, [{', '.join(f"'{n}'" for n in _NAMES)}][o_orderkey % {len(_NAMES)} + 1] AS plain FROM orders),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 0 THEN upper(plain) WHEN o_orderkey % 4 = 1 THEN array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(plain, ' ')], ' ')
  WHEN o_orderkey % 4 = 2 THEN ' ' || replace(plain, ' ', '  ' || chr(160)) || chr(9) ELSE plain END AS name FROM p)
SELECT o_orderkey, n.name, h.known AS html, t.known AS plain FROM n LEFT JOIN {_HEADERS['html'].format('h')} ON h.name = trim(regexp_replace(lower(n.name), '[\\s\\x{{A0}}]+', ' ', 'g'))
LEFT JOIN {_HEADERS['plain'].format('t')} ON t.name = lower(regexp_replace(n.name, '^\\s+|\\s+$', '', 'g'))""",
)
add("ingest_number_parse_us", "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders", "value")
add("ingest_number_parse_eu", "SELECT o_orderkey, -round(o_totalprice, 2) AS value FROM orders", "value")
add("ingest_timestamp_parse", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
add("ingest_side_coerce", "SELECT CASE event_type WHEN 'view' THEN 'long' WHEN 'signup' THEN 'long' WHEN 'click' THEN 'short' WHEN 'error' THEN 'short' END AS side, count(*) AS n FROM events GROUP BY 1")
add("ingest_excel_serial", "SELECT l_orderkey, l_linenumber, l_shipdate + INTERVAL 6 HOUR AS at FROM lineitem")
add("ingest_sha256", "SELECT page_id || '.html' AS path, 'html' AS format, sha256(html) AS sha256 FROM pages")
for _kind in ("csv", "html", "xlsx"):
    add(f"ingest_{_kind}_roundtrip", f"WITH {bronze(chr(39) + 'error' + chr(39) + ', ' + chr(39) + 'view' + chr(39))} SELECT strategy_id, deal_id, symbol, date_trunc('second', timestamp) AS timestamp, side, quantity, entry_price, exit_price, pnl FROM bronze", "exit_price pnl")

# deals laid end to end by running volumes, every opening one against every closing one that it overlaps
add(
    "deals_fifo",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS id FROM lineitem),
d AS (SELECT l_suppkey AS strategy_id, l_linestatus AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_linenumber % 2 = 1 AS opens, id, l_shipdate AS t, l_extendedprice / l_quantity AS price, -l_tax AS fee,
  round(l_quantity / 100 * 100000000)::BIGINT AS u FROM n),
r AS (SELECT *, sum(u) OVER (PARTITION BY strategy_id, symbol, side, opens ORDER BY t, id) - u AS a, sum(u) OVER (PARTITION BY strategy_id, symbol, side, opens ORDER BY t, id) AS z FROM d)
SELECT strategy_id, symbol, side, i.id || '-' || o.id AS deal_id, (least(i.z, o.z) - greatest(i.a, o.a)) / 100000000 AS quantity, i.price AS entry_price, o.price AS exit_price,
  (i.fee / i.u + o.fee / o.u) * (least(i.z, o.z) - greatest(i.a, o.a)) AS commission, o.t AS timestamp
FROM (SELECT * FROM r WHERE opens) i JOIN (SELECT * FROM r WHERE NOT opens) o USING (strategy_id, symbol, side) WHERE i.a < o.z AND o.a < i.z""",
    "quantity entry_price exit_price commission",
)

# ---- cleaning

add("clean_adjustments", f"WITH {SPOILT} SELECT strategy_id, count(*) FILTER (WHERE adjustment) AS adjustments, count(*) AS n FROM flags GROUP BY 1")
add("clean_required_rejects", f"WITH {SPOILT} SELECT strategy_id, row_idx, reason AS rejection_reason FROM judged WHERE reason IS NOT NULL")
add("clean_dedup", f"WITH {SPOILT} SELECT strategy_id, row_idx, copies FROM uni")
add("clean_sort_seq", f"WITH {LINES}, s AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY timestamp, row_idx) AS seq FROM lines) SELECT strategy_id, max(seq)::INT AS n, sum(seq * row_idx)::BIGINT AS weighted, arg_max(deal_id, seq) AS last_deal FROM s GROUP BY 1")
add("clean_negative_flip", f"WITH {SPOILT} SELECT strategy_id, row_idx, side, quantity, flipped FROM flip")
add("clean_pnl_impute", f"WITH {SPOILT} SELECT strategy_id, row_idx, pnl, need AS imputed FROM imp", "pnl")
add("clean_pnl_impute_lines", f"WITH {LINES} SELECT strategy_id, count(*) AS n, sum(pnl) AS pnl, sum(commission) AS commission, count(*) FILTER (WHERE pnl > 0) AS won FROM priced GROUP BY 1", "pnl commission", 5)
add("clean_zero_duration", "SELECT l_suppkey AS strategy_id, count(*) - count(DISTINCT l_shipdate) AS tied FROM lineitem GROUP BY 1")
add("clean_mad_cap", f"WITH {SPOILT} SELECT strategy_id, row_idx, median, mad, capped_pnl, is_outlier FROM capd", "median mad capped_pnl")
add("clean_balance", f"WITH {SPOILT} SELECT strategy_id, seq::INT AS seq, 10000 + sum(pnl) OVER (PARTITION BY strategy_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS balance_after FROM seqd", "balance_after")
add("clean_gap_duration", f"WITH {SPOILT} SELECT strategy_id, seq::INT AS seq, CASE WHEN g > 0 THEN g ELSE 1.0 END AS duration_seconds FROM (SELECT strategy_id, seq, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY strategy_id ORDER BY seq)) / 1e6::DOUBLE AS g FROM seqd)", "duration_seconds")
add(
    "clean_report",
    f"""WITH {SPOILT}, a AS (SELECT strategy_id, count(*) AS rows_received, count(*) FILTER (WHERE adjustment) AS adjustments_ignored, count(*) FILTER (WHERE reason IS NOT NULL) AS rows_rejected FROM judged GROUP BY 1),
b AS (SELECT strategy_id, count(*) AS trades, sum(copies - 1)::BIGINT AS dup, count(*) FILTER (WHERE is_outlier) AS outliers FROM capd GROUP BY 1)
SELECT strategy_id, rows_received, adjustments_ignored, rows_rejected, coalesce(dup, 0) AS duplicates_removed, coalesce(outliers, 0) AS outliers_tagged, coalesce(trades, 0) AS trades FROM a LEFT JOIN b USING (strategy_id)""",
)

# ---- series

CURVE = "curve AS (SELECT strategy_id, seq::INT AS seq, timestamp AS t, balance, peak, dd FROM facts UNION ALL SELECT strategy_id, 0, timestamp - INTERVAL 1 SECOND, 10000, 10000, 0 FROM facts WHERE seq = 1)"
MONTHS = "ends AS (SELECT strategy_id, strftime(t, '%Y-%m') AS month, arg_max(balance, seq) AS b FROM curve GROUP BY ALL), monthly AS (SELECT strategy_id, month, b / lag(b) OVER (PARTITION BY strategy_id ORDER BY month) - 1 AS ret FROM ends QUALIFY ret IS NOT NULL)"
# the curve at every time by definition: closed trades in full, open ones by elapsed share
MARKED = """marked AS (SELECT p.strategy_id, p.t, START + sum(CASE WHEN x <= p.t THEN capped_pnl WHEN e <= p.t THEN capped_pnl * (p.t - e) / (x - e) ELSE 0 END) AS balance
  FROM (SELECT DISTINCT strategy_id, unnest([e, x]) AS t FROM span) p JOIN span s USING (strategy_id) GROUP BY ALL),
mpk AS (SELECT *, max(balance) OVER (PARTITION BY strategy_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM marked)"""
SPAN = "span AS (SELECT strategy_id, capped_pnl, epoch_us(timestamp)::DOUBLE AS x, epoch_us(timestamp)::DOUBLE - round(duration_seconds * 1e6::DOUBLE) AS e FROM trades)"
add("trade_returns", f"WITH {facts()} SELECT strategy_id, seq::INT AS seq, round(balance_before, 9) AS balance_before, round(R, 9)::DECIMAL(20,9)::VARCHAR AS ret FROM facts")
add("equity_curve", f"WITH {facts()}, {CURVE} SELECT * FROM curve", "balance peak dd")
add("equity_mtm", f"WITH {trades()}, {SPAN}, {MARKED.replace('START', '10000.0::DOUBLE')} SELECT strategy_id, count(*) AS points, round(max(balance), 6) AS high, round(min((balance - peak) / CASE WHEN peak > 0 THEN peak ELSE 1 END), 6) AS mtm_max_drawdown, round(sum(balance), 4) AS total FROM mpk GROUP BY 1", "high mtm_max_drawdown total")
add(
    "equity_mtm_ties",
    f"""WITH {LINES}, gap AS (SELECT *, epoch_us(timestamp)::DOUBLE AS x, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY strategy_id ORDER BY seq) AS g FROM ltrades),
span AS (SELECT strategy_id, capped_pnl, x, x - CASE WHEN g > 0 THEN g ELSE 1000000 END AS e FROM gap), {MARKED.replace('START', '1000000.0::DOUBLE')}
SELECT strategy_id, round(min((balance - peak) / CASE WHEN peak > 0 THEN peak ELSE 1 END), 6) AS mtm_max_drawdown FROM mpk GROUP BY 1""",
    "mtm_max_drawdown",
)
LCURVE = CURVE.replace("10000", "1000000")
add("monthly_returns", f"WITH {LFACTS}, {LCURVE}, {MONTHS} SELECT * FROM monthly", "ret")

# ---- metrics

BASIC = """basic AS (SELECT strategy_id, count(*) AS total_trades, count(*) FILTER (WHERE capped_pnl > 0) AS win_count, count(*) FILTER (WHERE capped_pnl < 0) AS loss_count, count(*) FILTER (WHERE capped_pnl = 0) AS tie_count,
  count(*) FILTER (WHERE capped_pnl > 0) / count(*) AS win_rate, 1 - count(*) FILTER (WHERE capped_pnl > 0) / count(*) AS loss_rate,
  coalesce(avg(capped_pnl) FILTER (WHERE capped_pnl > 0), 0) AS average_win, coalesce(-avg(capped_pnl) FILTER (WHERE capped_pnl < 0), 0) AS average_loss,
  least(50.0::DOUBLE, coalesce(sum(capped_pnl) FILTER (WHERE capped_pnl > 0), 0) / greatest(1e-9::DOUBLE, coalesce(-sum(capped_pnl) FILTER (WHERE capped_pnl < 0), 0))) AS profit_factor,
  count(*) FILTER (WHERE side = 'long') AS long_count, count(*) FILTER (WHERE side = 'short') AS short_count,
  CASE WHEN count(*) FILTER (WHERE side = 'long') > 0 THEN count(*) FILTER (WHERE side = 'long' AND capped_pnl > 0) / count(*) FILTER (WHERE side = 'long') ELSE 0.0::DOUBLE END AS long_win_rate,
  CASE WHEN count(*) FILTER (WHERE side = 'short') > 0 THEN count(*) FILTER (WHERE side = 'short' AND capped_pnl > 0) / count(*) FILTER (WHERE side = 'short') ELSE 0.0::DOUBLE END AS short_win_rate FROM trades GROUP BY 1),
basics AS (SELECT *, average_win / greatest(1e-9::DOUBLE, average_loss) AS payoff_ratio, win_rate * average_win - loss_rate * average_loss AS expectancy, (win_rate * average_win - loss_rate * average_loss) / greatest(1e-9::DOUBLE, average_loss) AS expectancy_per_risk FROM basic)"""
GROWTH = """g0 AS (SELECT strategy_id, count(*) AS n, floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6)::BIGINT AS days, sum(capped_pnl) AS net_pnl, avg(R) AS mean_return_per_trade, quantile_cont(R, 0.5) AS median_return_per_trade,
  CASE WHEN count(*) >= 3 AND stddev_samp(R) >= 1e-9 THEN skewness(R) ELSE 0.0::DOUBLE END AS skew_returns, CASE WHEN count(*) >= 4 AND stddev_samp(R) >= 1e-9 THEN kurtosis(R) ELSE 0.0::DOUBLE END AS excess_kurtosis_returns FROM facts GROUP BY 1),
growth AS (SELECT *, net_pnl / 10000.0::DOUBLE AS total_return, CASE WHEN n >= 2 AND days >= 7 AND 10000 + net_pnl > 0 THEN pow((10000 + net_pnl) / 10000.0::DOUBLE, 365.25::DOUBLE / days) - 1 END AS cagr, n >= 2 AND days < 7 AS cagr_flagged_insufficient FROM g0)"""
FALLEN = """fallen AS (SELECT strategy_id, least(0, min(dd)) AS max_drawdown, coalesce(avg(dd) FILTER (WHERE dd < 0), 0) AS average_drawdown, sqrt(sum(dd * dd) / (count(*) + 1)) AS ulcer_index,
  sum(capped_pnl) / greatest(1e-9::DOUBLE, abs(least(0, min(dd))) * 10000.0::DOUBLE) AS recovery_factor FROM facts GROUP BY 1)"""
TAILS = """tl0 AS (SELECT strategy_id, CASE WHEN count(*) >= 10 THEN quantile_cont(R, 0.05) WHEN count(*) >= 2 THEN min(R) ELSE 0 END AS p5, CASE WHEN count(*) >= 10 THEN quantile_cont(R, 0.95) WHEN count(*) >= 2 THEN max(R) ELSE 0 END AS p95 FROM facts GROUP BY 1),
tails AS (SELECT strategy_id, any_value(p5) AS p5, any_value(p95) AS p95, abs(any_value(p95)) / greatest(1e-9::DOUBLE, abs(any_value(p5))) AS tail_ratio, -any_value(p5) AS var_95, coalesce(-avg(R) FILTER (WHERE R <= p5), 0) AS cvar_95 FROM facts JOIN tl0 USING (strategy_id) GROUP BY 1)"""
RISK = """rates AS (SELECT strategy_id, n, CASE WHEN n >= 2 THEN n * 365.25::DOUBLE / greatest(1, days) ELSE n END AS trades_per_year FROM growth),
free AS (SELECT *, CASE WHEN n >= 10 THEN pow(1.04::DOUBLE, 1 / trades_per_year) - 1 ELSE 0 END AS rf_per_trade, CASE WHEN n >= 10 THEN sqrt(trades_per_year) ELSE 1 END AS ann FROM rates),
ex AS (SELECT strategy_id, avg(R - rf_per_trade) AS mu, coalesce(stddev_samp(R - rf_per_trade), 0) AS sd, coalesce(stddev_samp(least(R - rf_per_trade, 0)), 0) AS down, sum(greatest(R - rf_per_trade, 0)) AS up_sum, sum(greatest(rf_per_trade - R, 0)) AS down_sum
  FROM facts JOIN free USING (strategy_id) GROUP BY 1),
risk AS (SELECT strategy_id, f.n, trades_per_year, rf_per_trade, CASE WHEN sd > 1e-9 THEN mu / sd ELSE 0 END AS sharpe_per_trade,
  CASE WHEN sd > 1e-9 THEN mu / sd ELSE 0 END * ann * CASE WHEN f.n < 30 THEN sqrt(f.n / 30) ELSE 1 END AS sharpe_ratio, CASE WHEN down > 1e-9 THEN mu * ann / down ELSE 0 END AS sortino_ratio,
  CASE WHEN max_drawdown < 0 AND cagr IS NOT NULL THEN cagr / abs(max_drawdown) END AS calmar_ratio, up_sum / greatest(1e-9::DOUBLE, down_sum) AS omega_ratio, CASE WHEN max_drawdown < 0 THEN total_return / abs(max_drawdown) ELSE 0 END AS romad,
  skew_returns, excess_kurtosis_returns FROM free f JOIN ex USING (strategy_id) JOIN growth USING (strategy_id) JOIN fallen USING (strategy_id))"""


def cdf(x: str) -> str:
    """The normal distribution by its series; terms by logarithms of double factorials."""
    series = f"list_sum([exp((2 * i + 1) * ln(abs({x})) - (lgamma(2 * i + 2) - i * ln(2.0::DOUBLE) - lgamma(i + 1))) FOR i IN range(60)])"
    return f"CASE WHEN {x} > 7 THEN 1.0::DOUBLE WHEN {x} < -7 THEN 0.0::DOUBLE WHEN {x} = 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {series} END"


def psr(reference: str, name: str = "pv") -> str:
    """CTE `name` (strategy_id, p)."""
    return f"""{name}_s AS (SELECT strategy_id, n, 1 - skew_returns * sharpe_per_trade + (excess_kurtosis_returns + 2) / 4 * sharpe_per_trade * sharpe_per_trade AS d, sharpe_per_trade - ({reference}) AS gap FROM risk),
{name}_z AS (SELECT strategy_id, CASE WHEN n >= 2 AND d > 1e-9 THEN gap / sqrt(d / (n - 1)) END AS z FROM {name}_s), {name} AS (SELECT strategy_id, CASE WHEN z IS NOT NULL THEN {cdf('z')} END AS p FROM {name}_z)"""


#: Expected maximum of 2 trials, from the rational approximation.
MAX_OF_2 = "0.5197552898469945::DOUBLE"
ALL = f"{facts()}, {BASIC}, {GROWTH}, {FALLEN}, {TAILS}, {RISK}"
add("strategy_overview", f"WITH {facts()}, {BASIC}, {FALLEN} SELECT strategy_id, total_trades, win_rate, profit_factor, max_drawdown, recovery_factor, total_return FROM basics JOIN fallen USING (strategy_id) JOIN (SELECT strategy_id, sum(capped_pnl) / 10000.0::DOUBLE AS total_return FROM trades GROUP BY 1) USING (strategy_id)", "win_rate profit_factor max_drawdown recovery_factor total_return")
add("metrics_basic", f"WITH {trades()}, {BASIC} SELECT * FROM basics", "win_rate loss_rate average_win average_loss profit_factor payoff_ratio expectancy expectancy_per_risk long_win_rate short_win_rate")
add("metrics_growth", f"WITH {facts()}, {GROWTH} SELECT strategy_id, n, days, net_pnl, total_return, cagr, cagr_flagged_insufficient, mean_return_per_trade, median_return_per_trade FROM growth", "net_pnl total_return cagr mean_return_per_trade median_return_per_trade")
add("metrics_moments", f"WITH {facts()}, {GROWTH} SELECT strategy_id, skew_returns, excess_kurtosis_returns FROM growth", "skew_returns excess_kurtosis_returns")
add("metrics_drawdown", f"WITH {facts()}, {FALLEN} SELECT * FROM fallen", "max_drawdown average_drawdown ulcer_index recovery_factor")
add(
    "metrics_drawdown_lines",
    f"WITH {LFACTS}, {FALLEN.replace('10000.0', '1000000.0')} SELECT * FROM fallen",
    "max_drawdown average_drawdown ulcer_index recovery_factor",
)
add(
    "metrics_dd_duration",
    f"""WITH {facts()}, isl AS (SELECT *, sum((dd >= 0)::INT) OVER (PARTITION BY strategy_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM facts),
l AS (SELECT strategy_id, run, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6::DOUBLE AS d FROM isl WHERE dd < 0 GROUP BY ALL)
SELECT strategy_id, coalesce(max(d), 0) AS max_drawdown_duration_days FROM (SELECT DISTINCT strategy_id FROM facts) LEFT JOIN l USING (strategy_id) GROUP BY 1""",
    "max_drawdown_duration_days",
)
add("metrics_risk_adj", f"WITH {ALL} SELECT strategy_id, trades_per_year, rf_per_trade, sharpe_per_trade, sharpe_ratio, sortino_ratio, calmar_ratio, omega_ratio, romad, n >= 10 AS annualised, n < 30 AS sharpe_small_sample_corrected, {MAX_OF_2} AS psr_reference_sharpe FROM risk", "trades_per_year rf_per_trade sharpe_per_trade sharpe_ratio sortino_ratio calmar_ratio omega_ratio romad psr_reference_sharpe")
add("metrics_tail", f"WITH {facts()}, {TAILS} SELECT * FROM tails", "p5 p95 tail_ratio var_95 cvar_95")
STREAKS = """sa AS (SELECT *, seq - row_number() OVER (PARTITION BY strategy_id, sign(capped_pnl) ORDER BY seq) AS run FROM trades), sl AS (SELECT strategy_id, sign(capped_pnl) AS s, run, count(*) AS len FROM sa GROUP BY ALL),
streaks AS (SELECT strategy_id, coalesce(max(len) FILTER (WHERE s > 0), 0) AS max_win_streak, coalesce(max(len) FILTER (WHERE s < 0), 0) AS max_loss_streak FROM sl GROUP BY 1)"""
add("metrics_streaks", f"WITH {trades()}, {STREAKS} SELECT *, max_win_streak / greatest(1, max_loss_streak) AS streak_ratio FROM streaks", "streak_ratio")
RUNS = """ra AS (SELECT strategy_id, seq, sign(capped_pnl) AS s FROM trades WHERE capped_pnl <> 0), rb AS (SELECT *, s IS DISTINCT FROM lag(s) OVER (PARTITION BY strategy_id ORDER BY seq) AS fresh FROM ra),
rc AS (SELECT strategy_id, count(*) FILTER (WHERE fresh) AS runs, count(*) FILTER (WHERE s > 0) AS w, count(*) FILTER (WHERE s < 0) AS l FROM rb GROUP BY 1), rd AS (SELECT *, 1 + 2 * w * l / (w + l) AS mu FROM rc),
rz AS (SELECT strategy_id, runs, CASE WHEN w > 0 AND l > 0 AND (mu - 1) * (mu - 2) / greatest(w + l - 1, 1) > 1e-9 THEN (runs - mu) / sqrt((mu - 1) * (mu - 2) / (w + l - 1)) ELSE 0 END AS runs_z FROM rd)"""
add("metrics_runs_z", f"WITH {trades()}, {RUNS} SELECT strategy_id, coalesce(runs, 0) AS runs, coalesce(runs_z, 0) AS runs_z FROM (SELECT DISTINCT strategy_id FROM trades) LEFT JOIN rz USING (strategy_id)", "runs_z")
BEHAVIOUR = "behave AS (SELECT strategy_id, max(capped_pnl) AS best_trade, min(capped_pnl) AS worst_trade FROM trades GROUP BY 1), months AS (SELECT strategy_id, count(*) AS months, avg((ret > 0)::INT) AS profitable_month_fraction, stddev_samp(ret) AS monthly_volatility FROM monthly GROUP BY 1)"
add("metrics_behavioural", f"WITH {LFACTS}, {LCURVE}, {MONTHS}, {BEHAVIOUR.replace('FROM trades', 'FROM facts')} SELECT strategy_id, best_trade, worst_trade, coalesce(months, 0) AS months, profitable_month_fraction, monthly_volatility FROM behave LEFT JOIN months USING (strategy_id)", "best_trade worst_trade profitable_month_fraction monthly_volatility")

# a recursive walk over the standardised returns, one row a step
CUSUM = """zs AS (SELECT strategy_id, seq, count(*) OVER p AS n, coalesce(stddev_samp(R) OVER p, 0) AS sd, CASE WHEN coalesce(stddev_samp(R) OVER p, 0) < 1e-9 THEN 0 ELSE (R - avg(R) OVER p) / stddev_samp(R) OVER p END AS z FROM facts WINDOW p AS (PARTITION BY strategy_id)),
walk AS (SELECT strategy_id, 0::BIGINT AS seq, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0.0::DOUBLE AS top, 0.0::DOUBLE AS low, 0::BIGINT AS hits FROM (SELECT DISTINCT strategy_id FROM facts)
  UNION ALL SELECT strategy_id, z.seq, CASE WHEN u > 4 THEN 0 ELSE u END, CASE WHEN d < -4 THEN 0 ELSE d END, greatest(top, u), least(low, d), hits + (u > 4)::INT + (d < -4)::INT
  FROM (SELECT w.strategy_id, zs.seq, greatest(0, up + z - 0.5::DOUBLE) AS u, least(0, down + z + 0.5::DOUBLE) AS d, top, low, hits FROM walk w JOIN zs ON zs.strategy_id = w.strategy_id AND zs.seq = w.seq + 1) z),
cus AS (SELECT strategy_id, CASE WHEN sd < 1e-9 THEN 0 ELSE top END AS s_plus_peak, CASE WHEN sd < 1e-9 THEN 0 ELSE low END AS s_minus_peak, CASE WHEN sd < 1e-9 THEN 0 ELSE hits END AS hits FROM walk JOIN zs USING (strategy_id, seq) WHERE seq = n),
cusum AS (SELECT *, hits > 0 OR s_plus_peak > 4 OR s_minus_peak < -4 AS threshold_hit FROM cus)"""
HALVES = """ha AS (SELECT *, count(*) OVER (PARTITION BY strategy_id) AS n FROM facts),
hb AS (SELECT strategy_id, n, count(*) FILTER (WHERE seq <= n // 2) AS n1, count(*) FILTER (WHERE seq > n // 2) AS n2, avg(R) FILTER (WHERE seq <= n // 2) AS m1, avg(R) FILTER (WHERE seq > n // 2) AS m2,
  coalesce(stddev_samp(R) FILTER (WHERE seq <= n // 2), 0) AS s1, coalesce(stddev_samp(R) FILTER (WHERE seq > n // 2), 0) AS s2 FROM ha GROUP BY ALL),
hc AS (SELECT *, ((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / greatest(1, n1 + n2 - 2) AS pooled FROM hb),
halves AS (SELECT strategy_id, n, CASE WHEN n >= 4 THEN m1 - m2 ELSE 0 END AS mean_return_gap, CASE WHEN n >= 4 THEN CASE WHEN s1 > 1e-9 THEN m1 / s1 ELSE 0 END - CASE WHEN s2 > 1e-9 THEN m2 / s2 ELSE 0 END ELSE 0 END AS sharpe_half_gap,
  CASE WHEN n >= 4 AND pooled > 0 THEN sqrt(pooled * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) ELSE 0 END AS gap_error FROM hc)"""
add("cusum_full", f"WITH RECURSIVE {facts()}, {CUSUM} SELECT * FROM cusum", "s_plus_peak s_minus_peak")
# the same walk over halves as strategies of their own, numbers 2s and 2s + 1
_OWN = f"all_facts AS (SELECT *, count(*) OVER (PARTITION BY strategy_id) AS _n FROM whole), facts AS (SELECT * REPLACE (strategy_id * 2 + (seq > _n // 2)::INT AS strategy_id, CASE WHEN seq > _n // 2 THEN seq - _n // 2 ELSE seq END AS seq) FROM all_facts WHERE _n >= 4)"
_PARTS = ", ".join(f"max({c}) FILTER (strategy_id % 2 = {i}) AS {h}_{c}" for i, h in enumerate(("first", "second")) for c in ("s_plus_peak", "s_minus_peak", "hits", "threshold_hit"))
add("cusum_halves", f"WITH RECURSIVE {facts().replace('facts AS (', 'whole AS (')}, {_OWN}, {CUSUM}, two AS (SELECT strategy_id // 2 AS strategy_id, {_PARTS} FROM cusum GROUP BY strategy_id // 2) SELECT u.strategy_id, two.* EXCLUDE (strategy_id) FROM (SELECT DISTINCT strategy_id FROM whole) u LEFT JOIN two USING (strategy_id)", "first_s_plus_peak first_s_minus_peak second_s_plus_peak second_s_minus_peak")
add("regime_halves", f"WITH {facts()}, {HALVES} SELECT * FROM halves", "mean_return_gap sharpe_half_gap gap_error")
FLAG = "regime AS (SELECT strategy_id, threshold_hit, threshold_hit OR (gap_error > 1e-9 AND abs(mean_return_gap) > 2 * gap_error) OR abs(sharpe_half_gap) > 0.5 AS regime_unstable FROM cusum JOIN halves USING (strategy_id))"
BASE = "'error', 'view'"
add("regime_flag", f"WITH RECURSIVE {facts(BASE)}, {CUSUM}, {HALVES}, {FLAG} SELECT * FROM regime")
add("psr", f"WITH {ALL}, {psr('0')} SELECT strategy_id, p AS probabilistic_sharpe_ratio FROM pv", "probabilistic_sharpe_ratio")
add("dsr", f"WITH {ALL}, {psr(MAX_OF_2)} SELECT strategy_id, p AS deflated_sharpe_ratio FROM pv", "deflated_sharpe_ratio")
def _ratio(top: tuple[float, ...], bottom: tuple[float, ...], x: str) -> str:
    """A quotient of polynomials, powers written out."""
    terms = lambda c: " + ".join(f"({k!r}::DOUBLE) * pow({x}, {len(c) - 1 - i})" for i, k in enumerate(c))
    return f"(({terms(top)}) / ({terms((*bottom, 1.0))}))"


def _inverse(p: str) -> str:
    tail = lambda x: _ratio(scalars.ACKLAM_C, scalars.ACKLAM_D, f"sqrt(-2 * ln({x}))")
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 0.97575 THEN -{tail(f'(1 - {p})')} ELSE ({p} - 0.5) * {_ratio(scalars.ACKLAM_A, scalars.ACKLAM_B, f'({p} - 0.5)^2')} END"


add(
    "expected_max_sharpe",
    f"""WITH u AS (SELECT user_id::VARCHAR AS trials_of, count(*) AS n_trials FROM events GROUP BY 1), t AS (SELECT * FROM u UNION ALL SELECT 'all users', count(*) FROM u),
p AS (SELECT *, (1 - 1 / n_trials)::DOUBLE AS p, 1 - 1 / (n_trials * exp(1)) AS o FROM t)
SELECT trials_of, n_trials, CASE WHEN n_trials <= 1 THEN 0 ELSE (1 - 0.5772156649::DOUBLE) * ({_inverse('p')}) + 0.5772156649::DOUBLE * ({_inverse('o')}) END AS reference FROM p""",
    "reference",
    8,
)
add("norm_cdf", f"SELECT event_id, {cdf('x')} AS p FROM (SELECT event_id, (value - 50) / 25 AS x FROM events)", "p")
add("norm_sigmoid", "SELECT event_id, 10 / (1 + exp(-0.1::DOUBLE * (value - 50))) AS up, 10 - 10 / (1 + exp(-0.1::DOUBLE * (value - 50))) AS down FROM events", "up down")


def piecewise(x: str, anchors: list[tuple[float, float]]) -> str:
    parts = [f"WHEN {x} <= {anchors[0][0]} THEN {anchors[0][1]}::DOUBLE"]
    parts += [f"WHEN {x} <= {b[0]} THEN {a[1]}::DOUBLE + ({x} - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE + 1e-9::DOUBLE) * ({b[1]}::DOUBLE - {a[1]}::DOUBLE)" for a, b in zip(anchors[:-1], anchors[1:])]
    return f"CASE {' '.join(parts)} ELSE {anchors[-1][1]}::DOUBLE END"


COUNT = [(10.0, 2.0), (30.0, 5.0), (100.0, 8.0), (500.0, 10.0)]
SHARE = [(0.0, 0.0), (0.5, 4.0), (0.8, 7.0), (0.95, 10.0)]
STREAK = [(3.0, 10.0), (6.0, 6.0), (10.0, 2.0), (15.0, 0.0)]
OUTLIER = [(0.01, 10.0), (0.05, 6.0), (0.15, 2.0), (0.25, 0.0)]
add("norm_piecewise", f"SELECT event_id, {piecewise('value', COUNT)} AS y FROM events", "y")
add("shown_metrics", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(value * 100, 2)::DECIMAL(38,2)::VARCHAR || '%' ELSE round(value, 3)::DECIMAL(38,3)::VARCHAR END AS text FROM events")

# ---- resampling

CELLS = "cells AS (SELECT strategy_id, n, i AS iteration, k FROM (SELECT strategy_id, count(*) AS n FROM trades GROUP BY 1), range(1000) AS t(i), unnest(range(n)) AS u(k))"


def mixed(rows: str, x: str, name: str) -> str:
    """The rows with `name`, the 32-bit mix of the number x."""
    return f"""SELECT * EXCLUDE (_d), xor(_d, _d >> 15) AS {name} FROM (SELECT * EXCLUDE (_c), (_c * 1935289751::BIGINT) & 4294967295 AS _d FROM (SELECT * EXCLUDE (_b), xor(_b, _b >> 15) AS _c
  FROM (SELECT *, (xor({x}, {x} >> 16) * 569420461::BIGINT) & 4294967295 AS _b FROM ({rows}))))"""


def drawn(rows: str, test: str, name: str, counter: str = "k") -> str:
    """The rows with `name`, a number of 48 bits from the hash of seed, test, strategy, iteration and counter."""
    seeds = f"(SELECT strategy_id, ('0x' || substr(h, 1, 8))::BIGINT AS _0, ('0x' || substr(h, 9, 8))::BIGINT AS _1 FROM (SELECT DISTINCT strategy_id, md5('7:{test}:' || strategy_id) AS h FROM trades))"
    out = f"SELECT r.*, xor(_0, iteration) AS _x, xor(_1, iteration) AS _y FROM ({rows}) r JOIN {seeds} USING (strategy_id)"
    out = mixed(mixed(out, "_x", "_p"), "_y", "_q")
    out = mixed(mixed(out, f"xor(_p, {counter})", "_u"), f"xor(_q, {counter})", "_v")
    return f"SELECT * EXCLUDE (_x, _y, _p, _q, _u, _v), (_u << 16) | (_v >> 16) AS {name} FROM ({out})"


POSITIONS = {
    "a": f"SELECT strategy_id, iteration, k, d % n AS pos FROM ({drawn('SELECT * FROM cells', 'a', 'd')})",
    "b": f"SELECT strategy_id, iteration, row_number() OVER (PARTITION BY strategy_id, iteration ORDER BY d, k) - 1 AS k, k AS pos FROM ({drawn('SELECT * FROM cells', 'b', 'd')})",
    "c": f"""SELECT strategy_id, iteration, k, (last_value(begin IGNORE NULLS) OVER w + k - last_value(since IGNORE NULLS) OVER w) % n AS pos FROM (SELECT *, CASE WHEN fresh THEN d % n END AS begin, CASE WHEN fresh THEN k END AS since
      FROM (SELECT *, k = 0 OR l / 281474976710656::DOUBLE < 1 / sqrt(n) AS fresh FROM ({drawn(drawn('SELECT * FROM cells', 'c-len', 'l'), 'c', 'd')}))) WINDOW w AS (PARTITION BY strategy_id, iteration ORDER BY k ROWS UNBOUNDED PRECEDING)""",
    "mb": f"SELECT strategy_id, iteration, k, (d % n + k % len) % n AS pos FROM ({drawn('SELECT *, k // len AS blk FROM (SELECT *, greatest(1, least(round_even(sqrt(n), 0)::BIGINT, n)) AS len FROM cells)', 'mb', 'd', 'blk')})",
}


def resampled(test: str) -> str:
    """CTEs s_<test>: the summary of a test."""
    return f"""pos_{test} AS ({POSITIONS[test]}),
path_{test} AS (SELECT p.strategy_id, iteration, k, capped_pnl AS pnl, 10000.0::DOUBLE + sum(capped_pnl) OVER (PARTITION BY p.strategy_id, iteration ORDER BY k ROWS UNBOUNDED PRECEDING) AS balance FROM pos_{test} p JOIN trades t ON t.strategy_id = p.strategy_id AND t.seq - 1 = p.pos),
pp_{test} AS (SELECT *, greatest(10000.0::DOUBLE, max(balance) OVER (PARTITION BY strategy_id, iteration ORDER BY k ROWS UNBOUNDED PRECEDING)) AS peak, pnl / CASE WHEN abs(balance - pnl) > 1e-9 THEN balance - pnl ELSE 1 END AS R FROM path_{test}),
m0_{test} AS (SELECT strategy_id, iteration, count(*) AS n, sum(pnl) / 10000.0::DOUBLE AS total_return, least(0, min((balance - peak) / CASE WHEN peak > 0 THEN peak ELSE 1 END)) AS max_drawdown, avg(R) AS mu, coalesce(stddev_samp(R), 0) AS sd,
  least(50.0::DOUBLE, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / greatest(1e-9::DOUBLE, coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0))) AS profit_factor FROM pp_{test} GROUP BY ALL),
m_{test} AS (SELECT *, CASE WHEN sd > 1e-9 THEN (mu - CASE WHEN n >= 10 THEN pow(1.04::DOUBLE, 1 / y) - 1 ELSE 0 END) * CASE WHEN n >= 10 THEN sqrt(y) ELSE 1 END / sd ELSE 0 END * CASE WHEN n < 30 THEN sqrt(n / 30) ELSE 1 END AS sharpe_ratio FROM m0_{test} JOIN yr USING (strategy_id)),
s_{test} AS (SELECT strategy_id, count(*) AS iterations, {', '.join(f"[q + 0.0::DOUBLE FOR q IN quantile_cont({m}, [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1])] AS {m}" for m in ("total_return", "max_drawdown", "sharpe_ratio", "profit_factor"))},
  avg((total_return > 0)::INT) AS robustness_rate, avg((sharpe_ratio > 1)::INT) AS sharpe_stability, avg(sharpe_ratio) AS mean_sharpe FROM m_{test} GROUP BY 1)"""


INFERRED = "yr AS (SELECT strategy_id, count(*) * 365.25::DOUBLE / greatest(1, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6::DOUBLE) AS y FROM trades GROUP BY 1)"
WHOLE_DAYS = "yr AS (SELECT strategy_id, trades_per_year AS y FROM risk)"
_POINTS = ", ".join(f"round(s.{m}[{i + 1}], {9 if m == 'total_return' else 8}) AS {m}_p{p}" for m in ("total_return", "max_drawdown", "sharpe_ratio", "profit_factor") for i, p in enumerate((0, 5, 25, 50, 75, 95, 100)))
for _name, _t in (("mc_bootstrap", "a"), ("mc_permutation", "b"), ("mc_stationary", "c"), ("mc_moving_block", "mb")):
    _twice = "(SELECT avg((m.max_drawdown < 2 * f.max_drawdown)::INT) FROM m_b m JOIN fallen f USING (strategy_id) WHERE m.strategy_id = s.strategy_id)" if _t == "b" else "NULL::DOUBLE"
    add(_name, f"WITH {facts()}, {FALLEN}, {INFERRED}, {CELLS}, {resampled(_t)} SELECT s.* EXCLUDE (total_return, max_drawdown, sharpe_ratio, profit_factor), {_POINTS}, {_twice} AS mdd_2x_probability FROM s_{_t} s", "robustness_rate sharpe_stability mean_sharpe mdd_2x_probability")
CORRELATION = """corr AS (SELECT strategy_id, a.robustness_rate AS iid, c.robustness_rate AS crr, mb.robustness_rate AS brr, a.sharpe_stability AS ast, c.sharpe_stability AS cst,
  CASE WHEN abs(a.max_drawdown[2]) < 1e-9 THEN abs(c.max_drawdown[2]) > 0.005 ELSE abs(c.max_drawdown[2]) > 1.5 * abs(a.max_drawdown[2]) END AS flag FROM s_a a JOIN s_c c USING (strategy_id) JOIN s_mb mb USING (strategy_id)),
picked AS (SELECT strategy_id, flag AS correlation_flag, CASE WHEN flag THEN 'test_c' ELSE 'test_a' END AS effective_test, CASE WHEN flag THEN crr ELSE iid END AS robustness_rate, CASE WHEN flag THEN cst ELSE ast END AS sharpe_stability, iid AS iid_robustness_rate, brr AS block_robustness_rate, iid - brr AS block_vs_iid_gap FROM corr)"""
add("mc_correlation_flag", f"WITH {trades()}, {INFERRED}, {CELLS}, {resampled('a')}, {resampled('c')}, {resampled('mb')}, {CORRELATION} SELECT * FROM picked", "robustness_rate sharpe_stability iid_robustness_rate block_robustness_rate block_vs_iid_gap")

# ---- score


def everything(losing: str = "'error'") -> str:
    """CTE `card`: all scalars of a strategy in a row."""
    return f"""{facts(losing)}, {BASIC}, {GROWTH}, {FALLEN}, {TAILS}, {RISK}, {CURVE}, {MONTHS}, {BEHAVIOUR}, {STREAKS}, {RUNS}, {CUSUM}, {HALVES}, {FLAG}, {psr(MAX_OF_2)}, {WHOLE_DAYS}, {CELLS}, {resampled('a')}, {resampled('c')}, {resampled('mb')}, {CORRELATION},
outs AS (SELECT strategy_id, count(*) FILTER (WHERE is_outlier) AS outliers, count(*) AS received FROM trades GROUP BY 1),
card AS (SELECT * FROM basics JOIN fallen USING (strategy_id) JOIN (SELECT * EXCLUDE (n) FROM risk) USING (strategy_id) JOIN (SELECT strategy_id, tail_ratio, cvar_95 FROM tails) USING (strategy_id) LEFT JOIN months USING (strategy_id) JOIN streaks USING (strategy_id)
  LEFT JOIN rz USING (strategy_id) JOIN regime USING (strategy_id) JOIN (SELECT strategy_id, p AS dsr FROM pv) USING (strategy_id) JOIN picked USING (strategy_id) JOIN outs USING (strategy_id))"""


def sig(x: str, middle: float, slope: float) -> str:
    return f"(10 / (1 + exp(-greatest(-500, least(500, {slope}::DOUBLE * ({x} - {middle}::DOUBLE))))))"


CATEGORIES = f"""cats AS (SELECT *, 0.35::DOUBLE * {sig('profit_factor', 1.5, 2.5)} + 0.2::DOUBLE * {sig('win_rate', 0.5, 6)} + 0.2::DOUBLE * {sig('payoff_ratio', 1.5, 2)} + 0.25::DOUBLE * CASE WHEN expectancy_per_risk > 0 THEN {sig('expectancy_per_risk', 0.2, 4)} ELSE 0 END AS cat_profitability,
  0.4::DOUBLE * CASE WHEN sharpe_ratio > 0 THEN {sig('sharpe_ratio', 1, 2.2)} ELSE 0 END + 0.3::DOUBLE * {sig('sortino_ratio', 1.5, 1.8)} + 0.3::DOUBLE * CASE WHEN coalesce(calmar_ratio, 0) > 0 THEN {sig('calmar_ratio', 1, 2.5)} ELSE 0 END AS cat_risk_adj,
  0.45::DOUBLE * (10 - {sig('abs(max_drawdown)', 0.2, 15)}) + 0.25::DOUBLE * (10 - {sig('ulcer_index', 0.08, 40)}) + 0.3::DOUBLE * CASE WHEN recovery_factor <= 0.5 THEN least(1, {sig('recovery_factor', 2, 2)}) ELSE {sig('recovery_factor', 2, 2)} END AS cat_drawdown,
  0.35::DOUBLE * {piecewise('robustness_rate', SHARE)} + 0.25::DOUBLE * {piecewise('sharpe_stability', SHARE)} + 0.2::DOUBLE * (10 - {sig('abs(coalesce(runs_z, 0))', 1.96, 3)}) + 0.2::DOUBLE * {sig('coalesce(profitable_month_fraction, 0)', 0.6, 6)} AS cat_robustness,
  0.35::DOUBLE * CASE WHEN skew_returns < -0.5 THEN least(2, {sig('skew_returns', 0.5, 2.5)}) ELSE {sig('skew_returns', 0.5, 2.5)} END + 0.25::DOUBLE * (10 - {sig('excess_kurtosis_returns', 3, 1.5)}) + 0.2::DOUBLE * CASE WHEN tail_ratio <= 0.7 THEN least(2, {sig('tail_ratio', 1, 4)}) ELSE {sig('tail_ratio', 1, 4)} END + 0.2::DOUBLE * {piecewise('max_loss_streak', STREAK)} AS cat_sanity,
  0.6::DOUBLE * CASE WHEN total_trades < 10 THEN 0 ELSE {piecewise('total_trades', COUNT)} END + 0.4::DOUBLE * {piecewise('(outliers / greatest(1, received))', OUTLIER)} AS cat_sufficiency FROM card)"""
PENALTIES = """pens AS (SELECT *, CASE WHEN abs(max_drawdown) > 0.4 THEN greatest(0.5::DOUBLE, 1 - 2 * (abs(max_drawdown) - 0.4::DOUBLE)) ELSE 1.0::DOUBLE END AS pen_mdd_40pct, CASE WHEN cvar_95 > 0.1 THEN greatest(0.6::DOUBLE, 1 - 4 * (cvar_95 - 0.1::DOUBLE)) ELSE 1.0::DOUBLE END AS pen_cvar_10pct,
  CASE WHEN robustness_rate < 0.5 THEN greatest(0.5::DOUBLE, robustness_rate / 0.5::DOUBLE) ELSE 1.0::DOUBLE END AS pen_mc_rr, CASE WHEN total_trades < 50 THEN greatest(0.85::DOUBLE, total_trades / 50) ELSE 1.0::DOUBLE END AS pen_n_50,
  CASE WHEN win_rate > 0.75 AND average_loss / greatest(1e-9::DOUBLE, average_win) > 2 THEN greatest(0.01::DOUBLE, least(1, exp(-1.5::DOUBLE * average_loss / greatest(1e-9::DOUBLE, average_win) - 2))) ELSE 1.0::DOUBLE END AS pen_martingale FROM cats),
penned AS (SELECT *, pen_mdd_40pct * pen_cvar_10pct * pen_mc_rr * pen_n_50 * pen_martingale AS penalty_product FROM pens)"""
#: The mark-to-market curve has its largest fall at a trade's close where no trades overlap, as here.
SCORED = """ko AS (SELECT *, concat_ws(' | ', CASE WHEN total_trades < 30 THEN printf('Insufficient sample size: N=%d < 30 trades required for any statistical confidence.', total_trades) END,
  CASE WHEN profit_factor < 1 THEN printf('Profit Factor %.3f < 1.0 — strategy is unprofitable before costs; no further scoring warranted.', profit_factor) END,
  CASE WHEN abs(max_drawdown) > 0.35 THEN printf('Maximum Drawdown magnitude %.1f%% exceeds 35%% — catastrophic capital loss inadmissible per risk mandate.', abs(max_drawdown) * 100) END,
  CASE WHEN dsr < 0.05 THEN printf('Corrected DSR %.3f < 0.05 — automatic evaluation FAIL (insufficient deflated significance).', dsr) END,
  CASE WHEN abs(max_drawdown) > 0.25 THEN printf('Continuous MTM max drawdown %.1f%% exceeds 25%% — fail due to floating equity risk.', abs(max_drawdown) * 100) END) AS why FROM penned),
raws AS (SELECT *, CASE WHEN why = '' THEN greatest(0, least(10, 0.175::DOUBLE * cat_profitability + 0.175::DOUBLE * cat_risk_adj + 0.15::DOUBLE * cat_drawdown + 0.35::DOUBLE * cat_robustness + 0.075::DOUBLE * cat_sanity + 0.075::DOUBLE * cat_sufficiency)) END AS raw_score FROM ko),
fin AS (SELECT *, CASE WHEN why = '' THEN round_even(greatest(0, least(100, 10 * raw_score * penalty_product)), 0)::INT ELSE 0 END AS final_score, CASE WHEN why = '' THEN 'SCORED' ELSE 'KNOCKED_OUT' END AS status FROM raws),
scored AS (SELECT *, CASE WHEN status <> 'SCORED' THEN 'KNOCKED_OUT' WHEN final_score >= 90 THEN 'Exceptional' WHEN final_score >= 75 THEN 'Strong' WHEN final_score >= 60 THEN 'Solid' WHEN final_score >= 45 THEN 'Marginal' WHEN final_score >= 30 THEN 'Weak' ELSE 'Poor' END AS label FROM fin)"""
CATS = ("profitability", "risk_adj", "drawdown", "robustness", "sanity", "sufficiency")
PENS = ("mdd_40pct", "cvar_10pct", "mc_rr", "n_50", "martingale")
add("score_knockouts", f"WITH RECURSIVE {everything(BASE)}, {CATEGORIES}, {PENALTIES}, {SCORED} SELECT strategy_id, status, nullif(why, '') AS reason, final_score, label FROM scored")
add("score_categories", f"WITH RECURSIVE {everything()}, {CATEGORIES} SELECT strategy_id, {', '.join(f'cat_{c}' for c in CATS)} FROM cats", " ".join(f"cat_{c}" for c in CATS))
add("score_penalties", f"WITH RECURSIVE {everything(BASE)}, {CATEGORIES}, {PENALTIES} SELECT strategy_id, {', '.join(f'pen_{c}' for c in PENS)}, penalty_product FROM penned", " ".join(f"pen_{c}" for c in PENS) + " penalty_product")
add("score_final", f"WITH RECURSIVE {everything()}, {CATEGORIES}, {PENALTIES}, {SCORED} SELECT strategy_id, status, raw_score, final_score, label FROM scored", "raw_score")
add("overfit_estimate", f"""WITH RECURSIVE {everything()}, {psr('0', 'plain')} SELECT strategy_id, total_trades AS n_obs, coalesce(dsr < 0.95, false) AS dsr_weak, regime_unstable, coalesce(block_vs_iid_gap > 0.1, false) AS block_dependence, coalesce(dsr < 0.95, false) OR regime_unstable OR coalesce(block_vs_iid_gap > 0.1, false) AS bounded_overfit_flag,
  concat_ws('; ', 'DSR=' || printf('%.3f', dsr) || ' (N_trials=2)', 'PSR=' || printf('%.3f', p) || ' (N_obs=' || total_trades || ')', CASE WHEN regime_unstable THEN 'regime unstable (CUSUM/half-sample)' END, 'block−iid RR gap=' || printf('%+.3f', block_vs_iid_gap),
  CASE WHEN bounded_overfit_flag THEN 'bounded overfit risk elevated' ELSE 'no elevated bounded-overfit flag' END) AS summary FROM card JOIN plain USING (strategy_id)""")

# ---- backtest overfitting


def choices(blocks: int) -> str:
    """CTEs up to `ranked`, a row for each choice of half the blocks."""
    side = lambda name, inside: f"sum(n) FILTER ({inside}) AS n_{name}, sum(s) FILTER ({inside}) AS s_{name}, sum(q) FILTER ({inside}) AS q_{name}"
    ratio = lambda x: f"round(CASE WHEN coalesce(n_{x}, 0) >= 2 AND sqrt(greatest(0, (q_{x} - s_{x} * s_{x} / n_{x}) / (n_{x} - 1))) > 1e-9 THEN s_{x} / n_{x} / sqrt(greatest(0, (q_{x} - s_{x} * s_{x} / n_{x}) / (n_{x} - 1))) ELSE 0 END, 9) AS r_{x}"
    return f"""span AS (SELECT min(epoch_us(timestamp)) AS lo, max(epoch_us(timestamp)) AS hi FROM facts),
cells AS (SELECT strategy_id, (epoch_us(timestamp) - lo) * {blocks} // (hi - lo + 1) AS b, count(*) AS n, sum(R) AS s, sum(R * R) AS q FROM facts, span GROUP BY ALL),
masks AS (SELECT i AS mask FROM range({1 << blocks}) AS t(i) WHERE bit_count(i) = {blocks // 2}),
sides AS (SELECT mask, strategy_id, {side('i', '(mask >> b) & 1 = 1')}, {side('o', '(mask >> b) & 1 = 0')} FROM cells, masks GROUP BY ALL),
ratios AS (SELECT mask, strategy_id, {ratio('i')}, {ratio('o')} FROM sides),
tops AS (SELECT * FROM ratios QUALIFY row_number() OVER (PARTITION BY mask ORDER BY r_i DESC, strategy_id) = 1),
ranked AS (SELECT t.mask AS in_sample, t.strategy_id AS best_strategy, t.r_i AS in_sharpe, t.r_o AS out_sharpe, (count(*) FILTER (r.r_o < t.r_o) + (count(*) FILTER (r.r_o = t.r_o) + 1) / 2) / (count(*) + 1) AS relative_rank
  FROM tops t JOIN ratios r USING (mask) GROUP BY ALL)"""


add("cscv_choices", f"WITH {facts()}, {choices(8)} SELECT *, ln(relative_rank / (1 - relative_rank)) AS logit FROM ranked", "in_sharpe out_sharpe relative_rank logit")
add(
    "cscv_overfitting_probability",
    f"WITH {facts()}, {choices(12)} SELECT count(*) AS combinations, avg((relative_rank < 0.5)::INT) AS pbo, avg((out_sharpe < 0)::INT) AS loss_probability, avg(ln(relative_rank / (1 - relative_rank))) AS mean_logit, regr_slope(out_sharpe, in_sharpe) AS degradation FROM ranked",
    "pbo loss_probability mean_logit degradation",
)
add(
    "design_gates",
    f"""WITH {facts(BASE)}, {BASIC}, {GROWTH}, {FALLEN}, {TAILS}, {RISK}, {choices(8)}, pbo AS (SELECT avg((relative_rank < 0.5)::INT) > 0.5 AS overfit FROM ranked),
g AS (SELECT strategy_id, sharpe_per_trade * (1 + skew_returns / 6 * sharpe_per_trade - excess_kurtosis_returns / 24 * sharpe_per_trade * sharpe_per_trade) AS adjusted_sharpe, total_trades < 100 AS too_few_trades,
  win_rate > 0.8 AND average_loss / greatest(1e-9::DOUBLE, average_win) > 3 AS martingale, overfit FROM basics JOIN (SELECT * EXCLUDE (n) FROM risk) USING (strategy_id), pbo)
SELECT *, NOT too_few_trades AND NOT martingale AND NOT overfit AS passed FROM g""",
    "adjusted_sharpe",
)
_SHARPE = "CASE WHEN count(*) FILTER ({0}) >= 2 AND stddev_samp(t.R) FILTER ({0}) > 1e-9 THEN avg(t.R) FILTER ({0}) / stddev_samp(t.R) FILTER ({0}) ELSE 0 END"
_TRAIN, _TEST = "t.fold <> f.fold AND NOT (t.a <= f.z + f.gap AND t.z >= f.a)", "t.fold = f.fold"
add(
    "purged_folds",
    f"""WITH lines AS (SELECT l_suppkey AS strategy_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq,
  epoch_us(l_shipdate) AS z, epoch_us(l_shipdate) - round(l_quantity)::BIGINT * 86400000000 AS a, 0.055::DOUBLE - l_discount AS R, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
t AS (SELECT *, ((seq - 1) * 5) // n AS fold FROM lines),
gaps AS (SELECT strategy_id, floor(0.02::DOUBLE * (max(z) - min(a)))::BIGINT AS gap FROM t GROUP BY 1),
f AS (SELECT strategy_id, fold, min(a) AS a, max(z) AS z, any_value(gap) AS gap FROM t JOIN gaps USING (strategy_id) GROUP BY 1, 2)
SELECT f.strategy_id, f.fold::INT AS fold, count(*) FILTER ({_TEST}) AS n_test, count(*) FILTER (t.fold <> f.fold AND t.a <= f.z AND t.z >= f.a) AS n_purged, count(*) FILTER (t.fold <> f.fold AND t.a > f.z AND t.a <= f.z + f.gap) AS n_embargoed,
  count(*) FILTER ({_TRAIN}) AS n_train, avg(t.R) FILTER ({_TRAIN}) AS train_mean, avg(t.R) FILTER ({_TEST}) AS test_mean, {_SHARPE.format(_TRAIN)} AS train_sharpe, {_SHARPE.format(_TEST)} AS test_sharpe
FROM f JOIN t USING (strategy_id) GROUP BY f.strategy_id, f.fold""",
    "train_mean test_mean train_sharpe test_sharpe",
)
_WALK = f"""{LINES}, mths AS (SELECT strategy_id, year(timestamp) * 12 + month(timestamp) - 1 AS m, count(*) AS n, sum(capped_pnl / 1000000.0::DOUBLE) AS s FROM ltrades GROUP BY ALL),
starts AS (SELECT strategy_id, unnest(range(min(m) + 12, max(m) - 1, 3)) AS m FROM mths GROUP BY strategy_id),
walk AS (SELECT strategy_id, w.m, coalesce(sum(n) FILTER (x.m < w.m), 0)::BIGINT AS n_inside, coalesce(sum(n) FILTER (x.m >= w.m), 0)::BIGINT AS n_outside, coalesce(sum(s) FILTER (x.m < w.m), 0) AS year_inside, coalesce(sum(s) FILTER (x.m >= w.m), 0) * 4 AS year_outside
  FROM starts w JOIN mths x USING (strategy_id) WHERE x.m BETWEEN w.m - 12 AND w.m + 2 GROUP BY ALL)"""
add("walk_forward_windows", f"WITH {_WALK} SELECT strategy_id, printf('%04d-%02d', (m // 12)::INT, (m % 12 + 1)::INT) AS month, n_inside, n_outside, year_inside, year_outside FROM walk", "year_inside year_outside")
add(
    "walk_forward_efficiency",
    f"WITH {_WALK} SELECT strategy_id, count(*) AS windows, avg(year_inside) AS mean_inside, avg(year_outside) AS mean_outside, round(CASE WHEN abs(avg(year_inside)) > 1e-9 THEN avg(year_outside) / avg(year_inside) END, 6) AS efficiency FROM walk WHERE n_inside > 0 GROUP BY 1",
    "mean_inside mean_outside",
)

# ---- cards and presentation

CARD_ID = "'user-' || strategy_id || '-' || strftime(to_timestamp(1735689600 + strategy_id * 60) AT TIME ZONE 'UTC', '%Y%m%d') || '-' || substr(md5('7:' || strategy_id), 1, 4)"
add("card_json_roundtrip", f"WITH RECURSIVE {everything()}, {CATEGORIES}, {PENALTIES}, {SCORED} SELECT {CARD_ID} AS id, strategy_id::VARCHAR AS strategy_id, ' User #' || strategy_id AS strategy_name, '7' AS seed, total_trades, profit_factor, status FROM scored", "profit_factor")
add(
    "scorecards_whole",
    f"""WITH RECURSIVE {everything()}, {CATEGORIES}, {PENALTIES}, {SCORED}
SELECT 'User ' || strategy_id AS name, total_trades, expectancy_per_risk AS expectancy_per_unit_risk, (SELECT sum(capped_pnl) FROM trades t WHERE t.strategy_id = scored.strategy_id) AS net_pnl, sharpe_ratio, coalesce(runs_z, 0) AS runs_z_score, regime_unstable, correlation_flag, iid_robustness_rate,
  greatest(1, least(round_even(sqrt(total_trades), 0)::INT, total_trades))::INT AS block_length, received AS rows_received, total_trades AS n_obs, status, final_score, total_trades + 1 AS points,
  (SELECT round(max_by(balance, seq), 6) FROM facts f WHERE f.strategy_id = scored.strategy_id) AS last_balance, coalesce(months, 0) AS months FROM scored""",
    "expectancy_per_unit_risk net_pnl sharpe_ratio runs_z_score iid_robustness_rate",
)
add("card_list", f"WITH RECURSIVE {everything()}, {CATEGORIES}, {PENALTIES}, {SCORED} SELECT {CARD_ID} AS id, ' User #' || strategy_id AS strategy_name, (to_timestamp(1735689600 + strategy_id * 60) AT TIME ZONE 'UTC') AS created_at, total_trades, final_score, label, status FROM scored")
_BASICS = ("total_trades", "win_count", "loss_count", "tie_count", "win_rate", "loss_rate", "average_win", "average_loss", "profit_factor", "payoff_ratio", "expectancy", "expectancy_per_risk", "long_count", "short_count", "long_win_rate", "short_win_rate")
_CARD = {
    "basic": _BASICS,
    "growth": ("net_pnl", "total_return", "cagr", "cagr_flagged_insufficient", "mean_return_per_trade", "median_return_per_trade", "skew_returns", "excess_kurtosis_returns"),
    "drawdown": ("max_drawdown", "average_drawdown", "ulcer_index", "recovery_factor", "max_drawdown_duration_days", "mtm_max_drawdown"),
    "risk_adj": ("trades_per_year", "rf_per_trade", "sharpe_per_trade", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "omega_ratio", "romad", "tail_ratio", "var_95", "cvar_95", "probabilistic_sharpe_ratio", "deflated_sharpe_ratio", "dsr_n_trials", "annualised", "sharpe_small_sample_corrected", "psr_reference_sharpe"),
    "behav": ("max_win_streak", "max_loss_streak", "streak_ratio", "runs", "runs_z", "best_trade", "worst_trade", "months", "profitable_month_fraction", "monthly_volatility"),
}
_LONG = " UNION ALL ".join(
    [f"SELECT strategy_id, id, '{g}.{c}' AS metric, {c}::DOUBLE AS value FROM w" for g, cs in _CARD.items() for c in cs]
    + [f"SELECT strategy_id, id, 'cat.{c}', CASE WHEN status = 'SCORED' THEN cat_{c} END FROM w" for c in CATS]
    + ["SELECT strategy_id, id, 'final_score', final_score::DOUBLE FROM w", "SELECT strategy_id, id, 'raw_score', coalesce(raw_score, 0) FROM w"]
)
add(
    "compare_cards",
    f"""WITH RECURSIVE {everything()}, {CATEGORIES}, {PENALTIES}, {SCORED},
isl AS (SELECT *, sum((dd >= 0)::INT) OVER (PARTITION BY strategy_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM facts), du AS (SELECT strategy_id, run, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6::DOUBLE AS d FROM isl WHERE dd < 0 GROUP BY ALL),
{psr('0', 'plain')},
w AS (SELECT * REPLACE (coalesce(months, 0) AS months, coalesce(runs, 0) AS runs, coalesce(runs_z, 0) AS runs_z), {CARD_ID} AS id, coalesce((SELECT max(d) FROM du WHERE du.strategy_id = scored.strategy_id), 0) AS max_drawdown_duration_days, max_drawdown AS mtm_max_drawdown,
  max_win_streak / greatest(1, max_loss_streak) AS streak_ratio, p AS probabilistic_sharpe_ratio, dsr AS deflated_sharpe_ratio, 2 AS dsr_n_trials, total_trades >= 10 AS annualised, total_trades < 30 AS sharpe_small_sample_corrected, {MAX_OF_2} AS psr_reference_sharpe
  FROM scored JOIN (SELECT strategy_id, net_pnl, total_return, cagr, cagr_flagged_insufficient, mean_return_per_trade, median_return_per_trade FROM growth) USING (strategy_id) JOIN behave USING (strategy_id) JOIN (SELECT strategy_id, var_95 FROM tails) USING (strategy_id) JOIN plain USING (strategy_id)), l AS ({_LONG})
SELECT b.metric, l.id, b.value * 1.000000000001::DOUBLE AS baseline, l.value * 1.000000000001::DOUBLE AS value, round(CASE WHEN l.strategy_id <> 0 AND abs(b.value) > 1e-9 THEN (l.value - b.value) / abs(b.value) * 100 * 1.000000000001::DOUBLE END, 4) AS delta_pct FROM l JOIN l b ON b.metric = l.metric AND b.strategy_id = 0 WHERE b.value IS NOT NULL""",
    "baseline value delta_pct",
    8,
)
add(
    "pnl_histogram",
    f"""WITH {facts()}, {CURVE}, r AS (SELECT strategy_id, seq, (balance - lag(balance) OVER w) / CASE WHEN lag(peak) OVER w > 0 THEN lag(balance) OVER w ELSE 1 END * 100 AS r FROM curve WINDOW w AS (PARTITION BY strategy_id ORDER BY seq)),
e AS (SELECT strategy_id, least(min(r), -1) AS lo, greatest(max(r), 1) AS hi FROM r WHERE seq > 0 GROUP BY 1) SELECT strategy_id, greatest(0, least(29, floor((r - lo) / ((hi - lo) / 30))))::INT AS bin, count(*) AS n FROM r JOIN e USING (strategy_id) WHERE seq > 0 GROUP BY ALL""",
)
_LINES = (("TR %", "total_return", 100), ("MDD %", "max_drawdown", 100), ("Sharpe", "sharpe_ratio", 1), ("PF", "profit_factor", 1))
add(
    "percentile_chart",
    f"WITH {facts()}, {INFERRED}, {CELLS}, {resampled('a')} "
    + " UNION ALL ".join(f"SELECT strategy_id, '{n}' AS series, ['p0', 'p5', 'p25', 'p50', 'p75', 'p95', 'p100'][i] AS point, (i - 1)::INT AS place, round({m}[i] * {by}, 7) + 0.0::DOUBLE AS value FROM s_a, range(1, 8) AS t(i)" for n, m, by in _LINES),
)
add("drawdown_chart", f"WITH {facts()}, {CURVE} SELECT strategy_id, seq::INT AS seq, strftime(t, '%Y-%m-%d') AS day, balance, peak, dd * 100 AS dd_percent, min(dd) OVER (PARTITION BY strategy_id) * 100 AS mdd_percent FROM curve", "balance peak dd_percent mdd_percent")
_HEAT = ", ".join(f"max(ret) FILTER (WHERE month LIKE '%-{i:02d}') AS m{i:02d}" for i in range(1, 13))
add("monthly_heatmap", f"WITH {LFACTS}, {LCURVE}, {MONTHS} SELECT strategy_id, left(month, 4) AS year, {_HEAT} FROM monthly GROUP BY ALL", " ".join(f"m{i:02d}" for i in range(1, 13)))
add("portfolio_by_symbol_side", f"WITH {trades()} SELECT symbol, side, count(*) AS n, sum(capped_pnl) AS pnl FROM trades GROUP BY CUBE (symbol, side)", "pnl")

# ---- ledgers with columns of their own, the card store

add("clean_extras", f"WITH {bronze()} SELECT strategy_id, count(*) FILTER (WHERE NOT bad) AS kept, count(*) FILTER (WHERE bad) AS rejected, coalesce(max(CASE WHEN bad THEN '{{\"note\": \"' || event_id || '\"}}' END), '') AS last_note FROM (SELECT strategy_id, event_id, event_id % 7 = 0 AS bad FROM (SELECT strategy_id, row_idx AS event_id FROM bronze)) GROUP BY 1")
add("clean_rejects_csv", f"WITH {SPOILT} SELECT strategy_id, row_idx, reason AS rejection_reason FROM judged WHERE reason IS NOT NULL")
add("card_store", "SELECT id, total_trades FROM (SELECT 'user-' || user_id || '-20250101-' || substr(md5('7:' || user_id), 1, 4) AS id, user_id, count(*) AS total_trades FROM events GROUP BY user_id) WHERE user_id % 2 = 1")
