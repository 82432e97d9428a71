"""Suffix-array dedup: repeated 200-byte strings by merging Burrows-Wheeler transforms of shards.

Pieces of text that share an anchor (see `repeats`) come together in a batch, which is cut into shards. A
shard's suffixes are sorted and its transform taken: for each suffix, in order, the symbol before it. Symbols
are blocks of `BLOCK` bytes, numbered within the batch and told apart by their bytes, so four of them make a
window. Two transforms are merged without sorting their suffixes again: the interleave, which shard each place
of the joint order comes from, starts as one shard after the other and is refined by rounds; a round sorts
places stably by the symbols that the interleave lays out, and is then right for one symbol more. A bound
between neighbours that first shows in round h stays where it is, and gives their common prefix, h - 1 symbols;
runs of places whose common prefixes reach a window's four symbols are the intervals of repeated windows.

Defined results: a null text is an empty one; rows are documents of their own, so equal texts repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, repeats

LENGTH = 200
BLOCK = 50
ROUNDS = LENGTH // BLOCK
SHARD_UNITS = 1 << 16

BYTES = repeats.Bytes(LENGTH, 32)


def block_numbers(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers of the blocks that begin at `places`: equal for blocks of equal bytes, and for those only."""
    if not len(places):
        return np.zeros(0, np.int64)
    hashes = common.RollingHash(data).grams(BLOCK)[places]
    order = np.argsort(hashes)
    blocks = np.lib.stride_tricks.sliding_window_view(data, BLOCK)
    sorted_blocks = np.ascontiguousarray(blocks[places[order]]).view(f"V{BLOCK}").ravel()
    differs = sorted_blocks[1:] != sorted_blocks[:-1]
    if np.any(differs & (hashes[order][1:] == hashes[order][:-1])):  # blocks of one hash may alternate
        order = np.lexsort(blocks[places].T[::-1])
        sorted_blocks = np.ascontiguousarray(blocks[places[order]]).view(f"V{BLOCK}").ravel()
        differs = sorted_blocks[1:] != sorted_blocks[:-1]
    number = np.empty(len(places), np.int64)
    number[order] = np.append(0, np.cumsum(differs))
    return number


def by_symbol(symbols: np.ndarray) -> np.ndarray:
    """The stable order of symbols below 2^32, by their halves, which numpy sorts in linear time."""
    if symbols.dtype == np.uint16:
        return np.argsort(symbols, kind="stable")
    low = np.argsort(symbols.astype(np.uint16), kind="stable")
    high = (symbols >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


class Transform:
    """Suffixes in order (`suffix`, places in the batch), the symbol before each (`symbol`, where `has`)."""

    def __init__(self, suffix: np.ndarray, symbol: np.ndarray, has: np.ndarray):
        self.suffix, self.symbol, self.has = suffix, symbol, has


def transform(suffix: np.ndarray, symbols: np.ndarray, ends_here: np.ndarray, begins: np.ndarray, rounds: int) -> Transform:
    """Of one shard. suffix: its places in text order; begins: for each place the first of its piece.

    `rounds` blocks reach beyond any piece's end, so the order is final.
    """
    last = suffix[ends_here[suffix]]
    order = suffix
    for _ in range(rounds):
        preceding = order - BLOCK
        preceding = preceding[preceding >= begins[order]]
        preceding = preceding[by_symbol(symbols[preceding])]
        order = np.concatenate([last, preceding])
    before = order - BLOCK
    has = before >= begins[order]
    return Transform(order, symbols[np.where(has, before, order)], has)


def merge(a: Transform, b: Transform, rounds: int) -> tuple[Transform, np.ndarray]:
    """The joint transform and, for each of its places, the symbols it has in common with the place before, `rounds` at most."""
    n = len(a.suffix) + len(b.suffix)
    ends = n - int(a.has.sum()) - int(b.has.sum())
    of_b = np.zeros(n, bool)
    of_b[len(a.suffix) :] = True
    # suffixes of no whole block come first: as many of each shard as it has symbols without a block before
    head = np.zeros(ends, bool)
    head[len(a.suffix) - int(a.has.sum()) :] = True
    interval = np.zeros(n, np.int64)
    symbol, has = np.empty(n, a.symbol.dtype), np.empty(n, bool)
    prefix = np.full(n, rounds, np.int16)
    prefix[:1] = 0
    for done in range(rounds):
        symbol[~of_b], symbol[of_b] = a.symbol, b.symbol
        has[~of_b], has[of_b] = a.has, b.has
        going = np.flatnonzero(has)
        going = going[by_symbol(symbol[going])]
        letter, old = symbol[going], interval[going]
        differs = np.ones(len(going), bool)
        differs[1:] = (letter[1:] != letter[:-1]) | (old[1:] != old[:-1])
        interval = np.concatenate([np.arange(ends), ends - 1 + np.cumsum(differs)])
        of_b = np.concatenate([head, of_b[going]])
        fresh = np.flatnonzero((interval[1:] != interval[:-1]) & (prefix[1:] == rounds)) + 1
        prefix[fresh] = done
    suffix = np.empty(n, np.int64)
    suffix[~of_b], suffix[of_b] = a.suffix, b.suffix
    symbol[~of_b], symbol[of_b] = a.symbol, b.symbol
    has[~of_b], has[of_b] = a.has, b.has
    return Transform(suffix, symbol.copy(), has.copy()), prefix


def repeated_windows(pieces: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    """For each piece, which of its windows start elsewhere too."""
    sizes = np.array([len(p) for p in pieces]) + 1  # each piece ends with a place that holds no byte
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    begins = np.repeat(first, sizes)
    left = np.repeat(first + sizes - 1, sizes) - np.arange(len(data))  # bytes to the piece's end
    ends_here = left < BLOCK  # too near the end of its piece to begin a block
    whole = np.flatnonzero(~ends_here)
    numbers = block_numbers(data, whole)
    symbols = np.zeros(len(data), np.uint16 if len(numbers) and numbers.max() < 1 << 16 else np.int64)
    symbols[whole] = numbers
    rounds = int(sizes.max()) // BLOCK + 1
    cuts = [0, *(np.flatnonzero(np.diff(first // SHARD_UNITS)) + 1), len(pieces)] if len(pieces) > 1 else [0, 1]
    if len(cuts) == 2 and len(pieces) > 1:
        cuts = [0, len(pieces) // 2, len(pieces)]
    ends = np.append(first, len(data))
    shards = [transform(np.arange(ends[x], ends[y]), symbols, ends_here, begins, rounds) for x, y in zip(cuts[:-1], cuts[1:])]
    # the order of a merged transform is final only if refined to the pieces' ends; the last merge needs a window's depth
    while len(shards) > 2:
        shards = [merge(*shards[i : i + 2], rounds)[0] if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
    joint, prefix = merge(*(shards if len(shards) == 2 else [Transform(*(x[:0] for x in (shards[0].suffix, shards[0].symbol, shards[0].has))), shards[0]]), ROUNDS)
    # a run of common prefixes of a window's length is an interval; only suffixes with a window's bytes left share one
    group = np.cumsum(prefix < ROUNDS) - 1
    windows = np.flatnonzero(left[joint.suffix] >= LENGTH)
    place, group = joint.suffix[windows], group[windows]
    weight = np.bincount(group, weights=np.repeat(weights, sizes)[place]) if len(place) else np.zeros(0)
    flags = np.zeros(len(data), bool)
    flags[place] = weight[group] >= 2
    return [flags[a : a + n - LENGTH] for a, n in zip(first, sizes)]


def removal_report(docs: DataFrame, batch_units: int = 60_000, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ranges in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("ranges").to_pylist()):
                runs, kept, last = repeats.merged(ranges), hashlib.sha256(), 0
                for start, end in runs:
                    kept.update(text[last:start])
                    last = end
                kept.update(text[last:])
                out.append((len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeats.with_ranges(docs, BYTES, repeated_windows, batch_units=batch_units, **options).mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
