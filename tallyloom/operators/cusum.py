"""Two-sided CUSUM with reset, in pieces of a history that are folded apart.

One side adds x to a sum s that never falls below 0; where s exceeds h, that is a hit and s starts from 0 again. A
stretch of values maps the s it begins with, anything from 0 to h, to the s it ends with, to the hits and to the peak.
Up to its first fall to 0 or first hit the sum is s plus what was added, so each value up to there cuts the range of
s that is still going; all s that fall or hit at one value go on alike from 0, and sums that are 0 at one
place are one from there. A map is therefore a short list of ranges of s, and the maps of a history's stretches,
in order, give the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = -1e300
#: upto: the range of s ends here, it included; lift: s plus this was reached; ends with out + slope * s; hits and peak of what follows.
PIECE = "array<struct<upto: double, lift: double, out: double, slope: double, hits: long, peak: double>>"


def _from_zero(x: np.ndarray, h: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """From s = 0: the last s, where s is 0 after a value, where it hits, and s at each value before a reset."""
    n, at, s, size = len(x), 0, 0.0, 64
    sums, hit = np.zeros(n), np.zeros(n, bool)
    while at < n:
        added = s + np.cumsum(x[at : at + size])
        path = added - np.minimum(np.minimum.accumulate(added), 0.0)
        over = np.flatnonzero(path > h)
        end = int(over[0]) + 1 if len(over) else len(path)
        sums[at : at + end] = path[:end]
        s = float(path[end - 1])
        if len(over):
            hit[at + end - 1] = True
            s, size = 0.0, 64
        else:
            size = min(2 * size, 8192)
        at += end
    return s, hit | (sums == 0.0), hit, sums


def fold(x: np.ndarray, h: float) -> list[tuple[float, float, float, float, int, float]]:
    """The map of a stretch of values: (upto, lift, out, slope, hits, peak), by range of s."""
    low, high = -1.0, h  # sums that start above low, up to high, have met neither 0 nor h
    total, top = 0.0, NEVER
    falls, overs = [], []  # (upto, lift, place), the former ascending, the latter descending
    place = 0
    for place, value in enumerate(x.tolist()):
        total += value
        if -total > low:
            reach = min(-total, high)
            falls.append((reach, top, place, 0))
            low = reach
            if low >= high:
                break
        if h - total < high:
            overs.append((high, max(top, total), place, 1))
            high = max(low, h - total)
            if low >= high:
                break
        top = max(top, total)
    pieces = [(high, top, total, 1.0, 0, 0.0)] if low < high else []
    met = sorted({p for _, _, p, _ in falls + overs})
    after: dict[int, tuple[float, int, float]] = {}
    if met:
        start = met[0] + 1
        out, zero, hit, sums = _from_zero(x[start:], h)
        hits_from = np.append(np.cumsum(hit[::-1])[::-1], 0)
        peak_from = np.append(np.maximum.accumulate(sums[::-1])[::-1], 0.0)
        after[met[0]] = (out, int(hits_from[0]), float(peak_from[0]))
        for p in met[1:]:
            s, hits, peak, i = 0.0, 0, 0.0, p + 1
            # goes on until both are at 0
            while not (s == 0.0 and zero[i - 1 - start]) and i < len(x):
                s = max(0.0, s + float(x[i]))
                peak = max(peak, s)
                if s > h:
                    hits, s = hits + 1, 0.0
                i += 1
            joined = s == 0.0 and zero[i - 1 - start]
            rest = i - start
            after[p] = (out, hits + int(hits_from[rest]), max(peak, float(peak_from[rest]))) if joined else (s, hits, peak)
    for upto, lift, p, own in falls + overs:
        out, hits, peak = after[p]
        pieces.append((upto, lift, out, 0.0, hits + own, peak))
    return sorted(pieces)


def follow(maps: Column, h: float) -> Column:
    """(s, hits, peak) after an array of maps in order, from s = 0."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("peak"))

    def step(a: Column, m: Column) -> Column:
        p = F.element_at(F.filter(m, lambda p: p["upto"] >= F.least(a["s"], F.lit(h))), 1)
        return F.struct((p["out"] + p["slope"] * a["s"]).alias("s"), (a["hits"] + p["hits"]).alias("hits"), F.greatest(a["peak"], a["s"] + p["lift"], p["peak"]).alias("peak"))

    return F.aggregate(maps, start, step)


def maps_of(rows: DataFrame, k: float, h: float, series: list[str]) -> DataFrame:
    """(strategy_id, series, at, up, down): a map a side for each stretch of rows that a task meets together.

    rows: (strategy_id, seq, part, chunk, one column of standardised values for each of `series`), sorted by strategy and seq within tasks;
    a stretch lies in one part and one chunk, and a task has all rows of a chunk. Series other than `whole` are told apart by part.
    """
    kind = rows.schema["strategy_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            key, part, chunk, seq = b.column("strategy_id"), b.column("part").to_numpy(), b.column("chunk").to_numpy(), b.column("seq").to_numpy()
            fresh = np.ones(len(b), bool)
            fresh[1:] = (part[1:] != part[:-1]) | (chunk[1:] != chunk[:-1])
            fresh[1:] |= np.asarray(pc.not_equal(key.slice(1), key.slice(0, len(b) - 1)))
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(b))
            places, names, at, up, down = [], [], [], [], []
            for name in series:
                z = b.column(name).to_numpy(zero_copy_only=False)
                for i, j in zip(starts.tolist(), ends.tolist()):
                    places.append(i)
                    names.append(name if name == "whole" else f"{name}{part[i]}")
                    at.append(seq[i])
                    up.append(fold(z[i:j] - k, h))
                    down.append(fold(-z[i:j] - k, h))
            fields = ("upto", "lift", "out", "slope", "hits", "peak")
            piece = pa.list_(pa.struct([(f, pa.int64() if f == "hits" else pa.float64()) for f in fields]))
            as_rows = lambda maps: pa.array([[dict(zip(fields, p)) for p in m] for m in maps], piece)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(places)), pa.array(names), pa.array(at, pa.int64()), as_rows(up), as_rows(down)], ["strategy_id", "series", "at", "up", "down"])

    return rows.select("strategy_id", F.col("seq").cast("long").alias("seq"), "part", "chunk", *series).mapInArrow(look, f"strategy_id {kind}, series string, at long, up {PIECE}, down {PIECE}")
