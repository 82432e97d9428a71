"""Monte-Carlo resampling of a strategy's trades: four tests, by a counter-based random number.

A draw is a hash of (seed, test, strategy, iteration, place), so it does not depend on partitions, and a path can be
made again anywhere. A strategy's pnl, in order, is one row of at most `MOST_TRADES` numbers; copies of it, each with
a range of iterations, are dealt evenly, and numpy makes the paths of a range and sums them up, so that no row
leaves a task for a path. Strategies of more trades go by an equi-join of places with trades and window sums.

With `rng="numpy"` the draws are those of one sequential generator for each strategy, seeded with the setting's seed, through
tests A, B, C and the moving block in this order, as a program that evaluates one strategy at a time makes them. Such
a stream cannot be entered in the middle, so each strategy is one row and one task's work, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import DAYS_A_YEAR, EPS, MOST_PROFIT_FACTOR, EvalConfig
from .cleaning import KEY

PERCENTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
MEASURES = ("total_return", "max_drawdown", "sharpe_ratio", "profit_factor")
PLACES = 4096
#: Trades of a strategy up to which its pnl is one row; beyond, places and trades are joined.
MOST_TRADES = 1_000_000
#: Draws of a test that are held at a time: so few that their arrays stay in a core's cache.
DRAWS = 1 << 15
#: Draws of a test for which a strategy's pnl is copied to a task of its own, and copies at most: what is shuffled grows with trades.
DRAWS_OF_TASK, COPIES = 1 << 22, 64
#: Ranges of iterations that a task sums up before it hands their rows on.
SUMMED = 256
#: Roundings of n additions go either way and add up to some sqrt(n) of them; a net below this many times as much is 0.
ROUNDINGS = 16
PATH = [*KEY, "test", "iteration"]
#: Multipliers of the 32-bit mixer.
FIRST, SECOND = 0x21F0AAAD, 0x735A2D97
#: What each test draws.
NAMES = {"a": ("a",), "b": ("b",), "c": ("c", "c-len"), "mb": ("mb",)}


# ---- draws: whole numbers of 48 bits


def seeds(seed: str, name: str, strategy: str) -> tuple[int, int]:
    """Two 32-bit numbers for what is drawn for a strategy."""
    digest = hashlib.md5(f"{seed}:{name}:{strategy}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 32-bit mix, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(15)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(15)
    return x


def _half(k: int, iterations: np.ndarray, counters: np.ndarray) -> np.ndarray:
    return mixed(mixed(np.uint32(k) ^ iterations.astype(np.uint32)) ^ counters.astype(np.uint32))


def draws(pair: tuple[int, int], iterations: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """A row for each iteration, a column for each counter; of arrays that fit each other otherwise, a draw for each pair."""
    if iterations.ndim == counters.ndim == 1:
        iterations, counters = iterations[:, None], counters[None, :]
    high, low = (_half(k, iterations, counters) for k in pair)
    out = high.astype(np.int64)
    out <<= 16
    out |= low >> np.uint32(16)
    return out


def below(pair: tuple[int, int], iterations: np.ndarray, counters: np.ndarray, limit: int) -> np.ndarray:
    """Where `draws` are below a limit; their lower bits are made only where the upper ones leave it open."""
    high = _half(pair[0], iterations[:, None], counters[None, :])
    out = high < limit >> 16
    row, column = np.nonzero(high == limit >> 16)
    out[row, column] = _half(pair[1], iterations[row], counters[column]) >> np.uint32(16) < limit & 0xFFFF
    return out


def _remainders(x: np.ndarray, n: int) -> np.ndarray:
    """x % n of numbers not below 0, in place; numpy divides by one number many at a time, but finds remainders one by one."""
    times = x // n
    times *= n
    x -= times
    return x


def _wrapped(x: np.ndarray, n: int) -> np.ndarray:
    """x % n of numbers from 0 to 2n - 1, in place."""
    x -= (x >= n) * np.int64(n)
    return x


def _mixed_column(x: Column) -> Column:
    def step(v: Column, shift: int, by: int) -> Column:
        return F.get(F.transform(F.array(v), lambda y: (y.bitwiseXOR(F.shiftright(y, shift)) * F.lit(by)).bitwiseAND(F.lit(0xFFFFFFFF))), 0)

    return F.get(F.transform(F.array(step(step(x, 16, FIRST), 15, SECOND)), lambda y: y.bitwiseXOR(F.shiftright(y, 15))), 0)


def _begun(seed: str, name: str) -> Column:
    """What a strategy's and iteration's draws share: two numbers, as an array."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), F.col("strategy_id").cast("string")))
    half = lambda at: _mixed_column(F.conv(F.substring(digest, at, 8), 16, 10).cast("long").bitwiseXOR(F.col("iteration").cast("long")))
    return F.array(half(1), half(9))


def draw(begun: Column, counter: Column) -> Column:
    high, low = (_mixed_column(begun[i].bitwiseXOR(counter.cast("long"))) for i in (0, 1))
    return F.shiftleft(high, 16).bitwiseOR(F.shiftright(low, 16))


# ---- paths in numpy


def block_of(n: int, config: EvalConfig) -> int:
    """The fixed length of blocks: as set, or sqrt(n) rounded half to even; 1 to n."""
    wanted = config.block_length if config.block_length is not None else int(np.rint(np.sqrt(n)))
    return max(1, min(wanted, n))


def positions(test: str, n: int, strategy: str, iterations: np.ndarray, config: EvalConfig) -> np.ndarray:
    """Which trade comes at each place of a path, a row for each iteration."""
    k = np.arange(n)
    own = lambda name, counters=k: draws(seeds(config.seed, name, strategy), iterations, counters)
    if test == "a":  # as many trades, drawn with replacement
        return _remainders(own("a"), n)
    if test == "b":  # the trades in another order
        return _order(own("b"))
    if test == "c":  # blocks of random length, sqrt(n) on average, from random starts, wrapping at the end
        fresh = below(seeds(config.seed, "c-len", strategy), iterations, k, int(np.ceil(float(1 << 48) * (1 / np.sqrt(n)))))
        fresh[:, 0] = True
        at = np.flatnonzero(fresh)
        row, since = np.divmod(at, n)
        pair = seeds(config.seed, "c", strategy)
        begin = draws(pair, iterations[row][:, None], since[:, None])[:, 0] % n
        places = np.repeat(begin - since, np.diff(at, append=fresh.size)).reshape(fresh.shape)
        places += k
        return _wrapped(places, n)
    length = block_of(n, config)  # blocks of fixed length from random starts, wrapping at the end
    places = np.repeat(own("mb", np.arange(-(-n // length))) % n, length, axis=1)[:, :n]
    return _wrapped(places + k % length, n)


def _order(keys: np.ndarray) -> np.ndarray:
    """The columns of each row by their keys of 48 bits, equal ones in their order."""
    n = keys.shape[1]
    if n <= 1 << 16:  # a column's number fits below its key; numbers sort faster than places of numbers
        whole = keys.view(np.uint64) << np.uint64(16)
        whole |= np.arange(n, dtype=np.uint64)
        whole.sort(axis=1)
        whole &= np.uint64(0xFFFF)
        return whole.view(np.int64)
    return np.argsort(keys, axis=1, kind="stable")


def replayed(rng: np.random.Generator, test: str, n: int, config: EvalConfig) -> np.ndarray:
    """The positions of a generator's next path; the calls and their order are what counts."""
    if test == "a":
        return rng.integers(0, n, size=n)
    if test == "b":
        return rng.permutation(n)
    k = np.arange(n)
    if test == "mb":
        length = block_of(n, config)
        starts = np.array([rng.integers(0, n) for _ in range(0, n, length)])
        return (starts[k // length] + k % length) % n
    share = 1 / max(1.0, np.sqrt(n))
    begins = {0: rng.integers(0, n)}
    for place in range(1, n):  # whether a block begins is drawn before where
        if rng.random() < share:
            begins[place] = rng.integers(0, n)
    since = np.fromiter(begins, np.int64)
    block = np.searchsorted(since, k, "right") - 1
    return (np.fromiter(begins.values(), np.int64)[block] + k - since[block]) % n


SUMS = "net double, max_drawdown double, mu double, sd double, won double, lost double"


def path_sums(pnl: np.ndarray, start: float) -> list[np.ndarray]:
    """The columns of `SUMS` for paths of pnl, a row each."""
    balance = np.cumsum(pnl, axis=1)
    balance += start
    before = balance - pnl
    # the start is above 0, so are peaks, and doubles above 0 are in the order of their bits, whose maximum numpy finds faster
    peak = np.maximum(balance, start).view(np.int64)
    peak = np.maximum.accumulate(peak, axis=1).view(np.float64)
    balance -= peak
    balance /= peak
    if not before.min() > EPS:
        before = np.where(np.abs(before) > EPS, before, 1.0)
    returns = np.divide(pnl, before, out=before)
    mean = returns.mean(axis=1)
    returns -= mean[:, None]
    spread = np.sqrt(np.einsum("ij,ij->i", returns, returns) / (pnl.shape[1] - 1)) if pnl.shape[1] > 1 else np.zeros(len(pnl))
    return [pnl.sum(axis=1), np.minimum(0.0, balance.min(axis=1)), mean, spread, np.maximum(pnl, 0.0).sum(axis=1), np.abs(np.minimum(pnl, 0.0).sum(axis=1))]


def residue(n, won, lost):
    """What rounding may leave of n gains and losses that sum to 0, of columns or arrays: such a path is no gain, whatever the order of its sum."""
    return ROUNDINGS * 2.0**-53 * n**0.5 * (won + lost)


def range_of(n: Column, iterations: int) -> Column:
    """How many iterations of a strategy with n trades a task makes."""
    copies = F.least(F.lit(COPIES), F.greatest(F.lit(1), F.ceil(F.lit(iterations) * n.cast("double") / DRAWS_OF_TASK)))
    return F.ceil(F.lit(iterations) / copies).cast("int")


def made_in_task(pnl: np.ndarray, strategy: str, first: int, end: int, config: EvalConfig, tests: tuple[str, ...]) -> Iterator[tuple[str, list[np.ndarray]]]:
    """Each test and the columns of `SUMS` of its paths from iteration `first` to `end`."""
    held = max(1, DRAWS // len(pnl))
    sequential = config.rng == "numpy"
    rng = np.random.default_rng(int(config.seed)) if sequential else None
    for test in TESTS if sequential else tests:
        found = []
        for at in range(first, end, held):
            iterations = np.arange(at, min(at + held, end))
            places = np.stack([replayed(rng, test, len(pnl), config) for _ in iterations]) if sequential else positions(test, len(pnl), strategy, iterations, config)
            if test in tests:  # others are drawn for those that follow
                found.append(path_sums(np.take(pnl, places), config.start_balance))
        if found:
            yield test, [np.concatenate(c) for c in zip(*found)]


def _rates(n: Column, per_year: Column, config: EvalConfig) -> tuple[Column, Column]:
    """What a Sharpe ratio of n trades is made with: the return free of risk by trade, and the factor that annualises."""
    yearly = (n >= 10) & (per_year > EPS)
    return F.when(yearly, F.pow(F.lit(1 + config.rf_annual), 1.0 / per_year) - 1).otherwise(0.0), F.when(yearly, F.sqrt(per_year)).otherwise(1.0)


def _measured(sums: list[np.ndarray], n: int, free: float, scale: float, start: float) -> list[np.ndarray]:
    """`MEASURES` of paths of n trades, as `path_metrics` has them; as in Spark, NaN is above all numbers."""
    net, fallen, mu, sd, won, lost = sums
    with np.errstate(all="ignore"):
        net = np.where(np.abs(net) < residue(n, won, lost), 0.0, net)
        sharpe = np.where(sd <= EPS, 0.0, (mu - free) * scale / sd) * (np.sqrt(n / 30) if n < 30 else 1.0)
        return [net / max(EPS, start), fallen, sharpe, np.fmin(MOST_PROFIT_FACTOR, won / np.maximum(EPS, lost))]


def _percentiles_of(values: np.ndarray) -> np.ndarray:
    """`_percentiles` of a sorted array."""
    place = np.array(PERCENTILES) * (len(values) - 1)
    low, high = values[np.floor(place).astype(int)], values[np.ceil(place).astype(int)]
    with np.errstate(all="ignore"):
        return low + (high - low) * (place - np.floor(place))


def summaries_in_tasks(trades: DataFrame, per_year: DataFrame, drawdowns: DataFrame | None, config: EvalConfig, tests: tuple[str, ...]) -> DataFrame:
    """The rows of `summaries`, for strategies of up to `MOST_TRADES` trades.

    A task sums up the paths it makes: of a strategy whose paths are all made in one task only the percentiles leave it, of
    others the measures of each range of iterations, one row a test, so that no row is shuffled for a path.
    """
    kind = trades.schema["strategy_id"].dataType.simpleString()
    rows = trades.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("seq", "capped_pnl"))).alias("t"))
    rows = rows.join(per_year.select(*KEY, F.col("trades_per_year").alias("y")), KEY)
    rows = rows.join(drawdowns.select(*KEY, F.col("max_drawdown").cast("double").alias("actual")), KEY) if drawdowns is not None else rows.withColumn("actual", F.lit(None).cast("double"))
    free, scale = _rates(F.size("t"), F.col("y"), config)
    rows = rows.select(*KEY, F.col("strategy_id").cast("string").alias("name"), F.transform("t", lambda x: x["capped_pnl"]).alias("pnl"), free.alias("free"), scale.alias("scale"), "actual")
    rows = rows.select("*", (F.lit(config.mc_iterations) if config.rng == "numpy" else range_of(F.size("pnl"), config.mc_iterations)).alias("step"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(config.mc_iterations - 1), F.col("step"))).alias("first"))
    rows = rows.repartition(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY, "first")
    counts = ("iterations", "robust", "stable", "sharpe", "fallen_twice")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), SUMMED):
                yield summed(b.slice(at, SUMMED))

    def summed(b: pa.RecordBatch) -> pa.RecordBatch:
        owner, names, whole, values, found = [], [], [], [[] for _ in MEASURES], [[] for _ in counts]
        for i in range(len(b)):
            of = lambda c: b.column(c)[i].as_py()
            pnl, first = b.column("pnl")[i].values.to_numpy(zero_copy_only=False), of("first")
            end, actual = min(first + of("step"), config.mc_iterations), of("actual")
            for test, sums in made_in_task(pnl, of("name") or "", first, end, config, tests):
                measures = _measured(sums, len(pnl), of("free"), of("scale"), config.start_balance)
                total, fallen, sharpe, _ = measures
                owner.append(i)
                names.append(test)
                whole.append(end - first == config.mc_iterations)
                for held, m in zip(values, measures):
                    held.append(_percentiles_of(np.sort(m)) if whole[-1] else m)
                twice = int(np.count_nonzero(fallen < 2 * actual)) if test == "b" and actual is not None else None
                for held, x in zip(found, (end - first, np.count_nonzero(~(total <= 0)), np.count_nonzero(~(sharpe <= 1)), float(sharpe.sum()), twice)):
                    held.append(x)
        lists = lambda held: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held) if held else np.empty(0)))
        columns = [b.column("strategy_id").take(pa.array(owner, pa.int64())), pa.array(names, pa.string()), pa.array(whole, pa.bool_()), *map(lists, values)]
        columns += [pa.array(held, pa.float64() if c == "sharpe" else pa.int64()) for c, held in zip(counts, found)]
        return pa.RecordBatch.from_arrays(columns, [*KEY, "test", "whole", *MEASURES, *counts])

    parts = rows.mapInArrow(look, f"strategy_id {kind}, test string, whole boolean, {', '.join(f'{m} array<double>' for m in MEASURES)}, {', '.join(f'{c} double' if c == 'sharpe' else f'{c} long' for c in counts)}")
    found = parts.groupBy(*KEY, "test").agg(F.max("whole").alias("whole"), *(F.flatten(F.collect_list(m)).alias(m) for m in MEASURES), *(F.sum(c).alias(c) for c in counts))
    found = found.withColumns({m: F.when(F.col("whole"), F.col(m)).otherwise(F.sort_array(m)) for m in MEASURES})
    share = lambda c, name: (F.col(c) / F.col("iterations")).alias(name)
    return found.select(*KEY, "test", "iterations", *(F.when(F.col("whole"), F.col(m)).otherwise(_percentiles(m)).alias(m) for m in MEASURES), share("robust", "robustness_rate"), share("stable", "sharpe_stability"), share("sharpe", "mean_sharpe"), share("fallen_twice", "mdd_2x_probability"))


# ---- paths as joins


def _grid(trades: DataFrame, config: EvalConfig, test: str) -> DataFrame:
    """(strategy_id, n, iteration, k) and what the test's draws begin with: k from 0 to n - 1 for each iteration."""
    n = trades.groupBy(*KEY).agg(F.count("*").alias("n"))
    cells = n.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(config.mc_iterations - 1))))
    # few bytes that become many rows: dealt by path in a set number of partitions, which are not coalesced
    cells = cells.repartition(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY, "iteration")
    cells = cells.withColumns({f"begun_{name}": _begun(config.seed, name) for name in NAMES[test]})
    # places come in two steps, so that no row holds an array as long as a history
    cells = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PLACES))))
    return cells.withColumn("k", F.explode(F.sequence(F.col("block") * PLACES, F.least(F.col("n"), (F.col("block") + 1) * PLACES) - 1))).drop("block")


def joined_paths(trades: DataFrame, config: EvalConfig, test: str) -> DataFrame:
    """(strategy_id, test, iteration, k, pnl): the paths of `positions`, place by place."""
    k, n = F.col("k"), F.col("n")
    cells = _grid(trades, config, test)
    path = Window.partitionBy(*KEY, "iteration")
    if test == "a":
        cells = cells.withColumn("pos", draw(F.col("begun_a"), k) % n)
    elif test == "b":
        cells = cells.withColumn("u", draw(F.col("begun_b"), k)).select(*KEY, "iteration", k.alias("pos"), (F.row_number().over(path.orderBy("u", "k")) - 1).cast("long").alias("k"))
    elif test == "c":
        new = (k == 0) | (draw(F.col("begun_c-len"), k) / float(1 << 48) < 1 / F.sqrt(n.cast("double")))
        cells = cells.withColumns({"begin": F.when(new, draw(F.col("begun_c"), k) % n), "since": F.when(new, k)})
        upto = path.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("pos", (F.last("begin", True).over(upto) + k - F.last("since", True).over(upto)) % n)
    else:
        wanted = F.lit(config.block_length).cast("long") if config.block_length is not None else F.bround(F.sqrt(n.cast("double")), 0).cast("long")
        cells = cells.withColumn("length", F.greatest(F.lit(1).cast("long"), F.least(wanted, n)))
        cells = cells.withColumn("pos", (draw(F.col("begun_mb"), F.floor(k / F.col("length"))) % n + k % F.col("length")) % n)
    pnl = trades.select(*KEY, (F.col("seq") - 1).cast("long").alias("pos"), F.col("capped_pnl").alias("pnl"))
    # left to itself, Spark takes the places, which come of few bytes, for the smaller side, and broadcasts them
    return cells.join(pnl.hint("shuffle_hash"), [*KEY, "pos"]).select(*KEY, F.lit(test).alias("test"), "iteration", "k", "pnl")


def sums_by_joins(trades: DataFrame, config: EvalConfig, tests: tuple[str, ...]) -> DataFrame:
    """(strategy_id, test, iteration, n, SUMS) of each path, for strategies of any size."""
    paths = joined_paths(trades, config, tests[0])
    for t in tests[1:]:
        paths = paths.unionByName(joined_paths(trades, config, t))
    start = config.start_balance
    upto = Window.partitionBy(*PATH).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("pnl")
    rows = paths.withColumn("balance", F.lit(start) + F.sum("pnl").over(upto))
    rows = rows.withColumn("peak", F.greatest(F.lit(start), F.max("balance").over(upto)))
    before = F.col("balance") - p
    rows = rows.withColumns({"dd": (F.col("balance") - F.col("peak")) / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0), "R": p / F.when(F.abs(before) > EPS, before).otherwise(1.0)})
    return rows.groupBy(*PATH).agg(
        F.count("*").alias("n"),
        F.sum(p).alias("net"),
        F.least(F.lit(0.0), F.min("dd")).alias("max_drawdown"),
        F.avg("R").alias("mu"),
        F.coalesce(F.stddev_samp("R"), F.lit(0.0)).alias("sd"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("won"),
        F.coalesce(F.sum(F.when(p < 0, -p)), F.lit(0.0)).alias("lost"),
    )


TESTS = tuple(NAMES)


def path_metrics(sums: DataFrame, per_year: DataFrame, config: EvalConfig) -> DataFrame:
    """(strategy_id, test, iteration, total_return, max_drawdown, sharpe_ratio, profit_factor) of each path.

    per_year: (strategy_id, trades_per_year).
    """
    n, y = F.col("n").cast("double"), F.col("trades_per_year")
    free, scale = _rates(n, y, config)
    sharpe = F.when(F.col("sd") > EPS, (F.col("mu") - free) * scale / F.col("sd")).otherwise(0.0)
    net = F.when(F.abs("net") < residue(n, F.col("won"), F.col("lost")), 0.0).otherwise(F.col("net"))
    return sums.join(per_year.select(*KEY, "trades_per_year"), KEY).select(
        *PATH,
        (net / max(EPS, config.start_balance)).alias("total_return"),
        "max_drawdown",
        (sharpe * F.when(n < 30, F.sqrt(n / 30)).otherwise(1.0)).alias("sharpe_ratio"),
        F.least(F.lit(MOST_PROFIT_FACTOR), F.col("won") / F.greatest(F.lit(EPS), F.col("lost"))).alias("profit_factor"),
    )


def inferred_rate(trades: DataFrame) -> DataFrame:
    """(strategy_id, trades_per_year) from the times of the trades, by fractions of days."""
    a = trades.groupBy(*KEY).agg(F.count("*").cast("double").alias("n"), ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / (86_400.0 * 1e6)).alias("days"))
    return a.select(*KEY, F.when(F.col("n") >= 2, F.col("n") * DAYS_A_YEAR / F.greatest(F.lit(1.0), F.col("days"))).otherwise(F.col("n")).alias("trades_per_year"))


def summaries(metrics: DataFrame, drawdowns: DataFrame | None = None) -> DataFrame:
    """A row for each strategy and test: seven percentiles of each measure, robustness, stability, mean Sharpe.

    drawdowns: (strategy_id, max_drawdown) of the histories, for the share of paths of test B that fall more
    than twice as far (null for the other tests).
    """
    if drawdowns is not None:
        metrics = metrics.join(drawdowns.select(*KEY, F.col("max_drawdown").alias("actual")), KEY)
    else:
        metrics = metrics.withColumn("actual", F.lit(None).cast("double"))
    twice = F.avg(F.when(F.col("test") == "b", (F.col("max_drawdown") < 2 * F.col("actual")).cast("double")))
    found = metrics.groupBy(*KEY, "test").agg(
        F.count("*").alias("iterations"),
        F.collect_list(F.struct(*MEASURES)).alias("paths"),  # mc_iterations at most
        F.avg((F.col("total_return") > 0).cast("double")).alias("robustness_rate"),
        F.avg((F.col("sharpe_ratio") > 1).cast("double")).alias("sharpe_stability"),
        F.avg("sharpe_ratio").alias("mean_sharpe"),
        twice.alias("mdd_2x_probability"),
    )
    found = found.withColumns({m: F.sort_array(F.transform("paths", lambda x: x[m])) for m in MEASURES})
    return found.select(*KEY, "test", "iterations", *(_percentiles(m).alias(m) for m in MEASURES), "robustness_rate", "sharpe_stability", "mean_sharpe", "mdd_2x_probability")


def _percentiles(name: str) -> Column:
    """`PERCENTILES` of a sorted array, linear between its elements."""

    def at(p: float) -> Column:
        place = F.lit(p) * (F.size(name) - 1)
        low, high = F.get(F.col(name), F.floor(place).cast("int")), F.get(F.col(name), F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return F.array(*map(at, PERCENTILES))


def run_tests(trades: DataFrame, config: EvalConfig, per_year: DataFrame | None = None, drawdowns: DataFrame | None = None, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """Summaries of the tests of all strategies; no row where mc_iterations is 0."""
    per_year = inferred_rate(trades) if per_year is None else per_year
    if config.mc_iterations == 0:
        return summaries_in_tasks(trades.limit(0), per_year, drawdowns, EvalConfig(seed=config.seed), tests)
    large = trades.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > MOST_TRADES).select(*KEY)
    if config.rng == "numpy" or large.isEmpty():
        return summaries_in_tasks(trades, per_year, drawdowns, config, tests)
    joined = summaries(path_metrics(sums_by_joins(trades.join(large, KEY, "left_semi"), config, tests), per_year, config), drawdowns)
    return summaries_in_tasks(trades.join(large, KEY, "left_anti"), per_year, drawdowns, config, tests).unionByName(joined)


def described(summary: DataFrame, trades: DataFrame, config: EvalConfig) -> DataFrame:
    """The summaries with what tests say of each other: flagged_worse_than_a (test C), block_length, iid_robustness_rate,
    iid_sharpe_stability and block_vs_iid_gap (moving block); null for the other tests."""
    counts = trades.groupBy(*KEY).agg(F.count("*").alias("_n"))
    wanted = F.lit(config.block_length).cast("long") if config.block_length is not None else F.bround(F.sqrt(F.col("_n").cast("double")), 0).cast("long")
    iid = summary.filter("test = 'a'").select(*KEY, F.col("robustness_rate").alias("_rr"), F.col("sharpe_stability").alias("_st"))
    flags = correlation(summary).select(*KEY, F.col("correlation_flag").alias("_flag"))
    rows = summary.join(counts, KEY).join(iid, KEY, "left").join(flags, KEY)
    of = lambda test, c: F.when(F.col("test") == test, c)
    added = {
        "flagged_worse_than_a": of("c", F.col("_flag")),
        "block_length": of("mb", F.greatest(F.lit(1), F.least(wanted, F.col("_n")))),
        "iid_robustness_rate": of("mb", F.col("_rr")),
        "iid_sharpe_stability": of("mb", F.col("_st")),
        "block_vs_iid_gap": of("mb", F.col("_rr") - F.col("robustness_rate")),
    }
    return rows.withColumns(added).drop("_n", "_rr", "_st", "_flag")


def correlation(summary: DataFrame) -> DataFrame:
    """(strategy_id, correlation_flag, effective_test, rr, stability, block_rr, block_vs_iid_gap) from the summaries.

    Trades depend on each other where test C's 5 % drawdown is over 1.5 times test A's (or over 0.5 % where A has none).
    """
    one = lambda t, c: F.max(F.when(F.col("test") == t, F.col(c)))
    a = summary.withColumn("p5", F.abs(F.col("max_drawdown")[1])).groupBy(*KEY).agg(
        *(one(t, "p5").alias(f"p5_{t}") for t in ("a", "c")),
        *(one(t, "robustness_rate").alias(f"rr_{t}") for t in ("a", "c", "mb")),
        *(one(t, "sharpe_stability").alias(f"st_{t}") for t in ("a", "c")),
    )
    flag = F.when(F.col("p5_a") < EPS, F.col("p5_c") > 0.005).otherwise(F.col("p5_c") > 1.5 * F.col("p5_a"))
    a = a.withColumn("correlation_flag", F.coalesce(flag, F.lit(False)))
    pick = lambda c: F.when(F.col("correlation_flag"), F.col(f"{c}_c")).otherwise(F.col(f"{c}_a"))
    return a.select(*KEY, "correlation_flag", F.when(F.col("correlation_flag"), "test_c").otherwise("test_a").alias("effective_test"), pick("rr").alias("robustness_rate"), pick("st").alias("sharpe_stability"), F.col("rr_a").alias("iid_robustness_rate"), F.col("rr_mb").alias("block_robustness_rate"), (F.col("rr_a") - F.col("rr_mb")).alias("block_vs_iid_gap"))
