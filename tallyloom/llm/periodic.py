"""Periodic runs: stretches of a document in which a sequence of words repeats three times or more.

Method: harmonic grid with prefix hashes. A run with period p and at least `least` words holds at least
max(least, 3p) - p consecutive words that equal the word p places on, so it covers one of the grid points at the
multiples of that number; over all periods the points are a harmonic sum, n log n for n words. At all (period,
grid point) pairs whose two words are equal the longest common extensions, forwards and backwards, are found by
binary search over prefix hashes, for all pairs at once. Of the stretches found, those with the same ends are one
run, its smallest period the smallest found (a stretch of three periods or more with two periods has their common
divisor, too, and extends as far with it); word by word comparison then confirms each run.

Defined results: a null or empty text has no words and no runs; equal runs of repeated rows come with each row;
rows with a null doc_id are documents like others. One document is one row and its words one task's work, in
slices of the grid of bounded size; columns of other names are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, free

LEAST = 24
#: Pairs of period and grid point that are looked at together.
PAIRS = 1 << 19

RUN = "struct<start: long, length: long, period: long>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _grids(n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grid points, periods) of a text of n words, in slices."""
    periods = np.arange(1, n // 3 + 1)
    step = np.maximum(least, 3 * periods) - periods
    points = (n - periods - 1) // step + 1
    upto = np.cumsum(points)
    first = 0
    while first < len(periods):
        before = upto[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        here, count = periods[first:end], points[first:end]
        place = np.arange(upto[end - 1] - before) - np.repeat(upto[first:end] - count - before, count)
        yield place * np.repeat(step[first:end], count), np.repeat(here, count)
        first = end


def _extend(equal: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """The largest length up to `most` for which `equal`, true up to some length, holds: binary search of all at once."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = equal(middle)
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    return low


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row, the one of the smallest period, of each start and end; by start, then period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    if n < least:
        return found[0]
    hashed = RollingHash(symbols.astype(np.uint64))
    for point, period in _grids(n, least):
        met = np.flatnonzero(symbols[point] == symbols[point + period])
        i, p = point[met], period[met]
        j = i + p
        ahead = _extend(lambda m: hashed.spans(i, i + m) == hashed.spans(j, j + m), n - j)  # noqa: B023
        behind = _extend(lambda m: hashed.spans(i - m, i) == hashed.spans(j - m, j), i)  # noqa: B023
        start, end = i - behind, j + ahead
        long = end - start >= np.maximum(least, 3 * p)
        found.append(_smallest(start[long], end[long], p[long]))
    start, end, period = _smallest(*(np.concatenate(x) for x in zip(*found)))
    if not all(np.array_equal(symbols[a : b - p], symbols[a + p : b]) for a, b, p in zip(start, end, period)):
        # two unequal stretches had one hash: number the words anew, which gives other hashes
        return find(symbols * 2 + 1, least)
    return start, end, period


def keep_mask(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay when of each run only its first period does."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) == 0


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    for x in batch.column(name).cast(pa.large_binary()):
        yield x.as_py() or b""


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, length, period): a row for each run of each document; places are numbers of words."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for k, text in enumerate(_texts(b, "text")):
                start, end, period = find(numbered(text.split()), least)
                rows.append(np.full(len(start), k))
                parts.append(np.stack([start, end - start, period]))
            if rows:
                start, length, period = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(start), pa.array(length), pa.array(period)], ["doc_id", "start", "length", "period"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(look, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, period long")


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents, all columns as they are, with runs cut to their first period; texts without runs keep their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x in b.column("text").cast(pa.large_binary()):
                text = x.as_py()
                words = (text or b"").split()
                found = find(numbered(words), least)
                if len(found[0]):
                    keep = keep_mask(len(words), *found)
                    text = b" ".join([w for w, k in zip(words, keep) if k])
                texts.append(text)
            place = b.schema.get_field_index("text")
            yield b.set_column(place, "text", pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(b.schema.field(place).type))

    return docs.mapInArrow(cut, docs.schema)


def run_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, the run repeated most (start, length, period, exponent_milli) and hashes of all runs and of the collapsed text.

    Of runs repeated equally often the first counts, then the one with the smaller period.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in _texts(b, "text"):
                words = text.split()
                start, end, period = find(numbered(words), least)
                if len(start):
                    runs = list(zip(start.tolist(), (end - start).tolist(), period.tolist()))
                    a, n, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
                    best = (a, n, p, 1000 * n // p)
                    keep = keep_mask(len(words), start, end, period)
                    words = [w for w, k in zip(words, keep) if k]
                else:
                    runs, best = [], (None,) * 4
                listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
                rows.append((len(runs), *best, sha256(listed.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], NAMES)

    NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), *["long"] * 5, *["string"] * 2]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(report, ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by crc32 of the number, the words after some place repeat from there; null numbers stay."""
    h, n, g, a, p, w = free(docs, "h", "n", "g", "a", "p", "w")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias(h))
    rows = rows.withColumn(w, F.when(F.col(h) % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn(n, F.size(w)).withColumn(g, F.floor(F.col(h) / 10))
    rows = rows.withColumn(a, F.when(F.col(n) > 0, (F.col(g) % F.col(n)).cast("int"))).withColumn(p, (1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8))).cast("int"))
    place = F.sequence(F.lit(0), F.col(n) - 1)
    turned = F.transform(place, lambda i: F.get(F.col(w), F.when(i < F.col(a), i).otherwise(F.col(a) + (i - F.col(a)) % F.col(p)).cast("int")))
    return rows.select("doc_id", F.when(F.col(w).isNotNull() & (F.col(n) > 0), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
