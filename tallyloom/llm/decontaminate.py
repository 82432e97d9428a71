"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the word windows of benchmark items. Texts are streams of word hashes; m is the pattern length
in words and a block is the last B words of the window under the scan: two, or three where patterns are many, at
most m. A shift table over hashed blocks, with eight slots or more for each pattern, tells how far the scan may
jump: m - B + 1 words where no pattern holds the block. At a shift of zero the hash of the block selects a bucket
of windows, of which those with the hash of all m words are compared directly, byte by byte, so hash collisions
cannot make a hit. The scan of a batch moves many places of the texts at once, each place a lane of numpy arrays.

All windows of the usual length share a table; shorter items have tables of their own length. Equal item texts are
searched once. Items are taken in blocks of at most `block_bytes`, so each broadcast has that bound and the tables
of a block, some 30 times its bytes, are all that a worker holds. One block marks the rows as they pass. Of more
blocks, each makes one pass over the documents and writes the hits of the texts that have any, by the texts' hash;
the documents are joined with those in the end.

Long texts are read in segments that overlap by a window less a word.

Defined results: null texts have no words; an item without words has no window; items with a null item_id
mark words but are not listed; a repeated item_id counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Digits, small letters and bytes of characters outside ASCII; texts are lower-cased first.
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Patterns from which blocks have three words.
MANY = 50_000
#: Start places of a lane; short lanes keep the lanes of a batch level.
LANE = 256


class Words:
    """Words of texts: hashes, and their bytes laid end to end with one blank before each."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = LOWER[data]
        starts, ends, self.first = common.word_spans(data, off, IS_WORD)
        self.rolling = common.RollingHash(data)
        self.hashes = self.rolling.spans(starts, ends)
        lengths = ends - starts
        self.at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.at[1:])
        self.bytes = np.full(self.at[-1], 32, np.uint8)
        index = np.arange(self.at[-1]) - np.repeat(self.at[:-1] + 1 - starts, lengths + 1)
        letter = np.ones(self.at[-1], bool)
        letter[self.at[:-1]] = False
        self.bytes[letter] = data[index[letter]]
        self.sequence = common.RollingHash(self.hashes)

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the `n` words from each place."""
        return self.sequence.spans(at, at + n)


def same_bytes(a: Words, at_a: np.ndarray, b: Words, at_b: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from each place of `a` are those from the place of `b`, byte by byte."""
    begin_a, begin_b = a.at[at_a], b.at[at_b]
    length = a.at[at_a + m] - begin_a
    same = length == b.at[at_b + m] - begin_b
    for i in range(0, len(at_a), 4096):
        part = np.flatnonzero(same[i : i + 4096]) + i
        if len(part):
            k = np.arange(length[part].sum()) - np.repeat(np.cumsum(length[part]) - length[part], length[part])
            equal = a.bytes[np.repeat(begin_a[part], length[part]) + k] == b.bytes[np.repeat(begin_b[part], length[part]) + k]
            same[part] = np.logical_and.reduceat(equal, np.cumsum(length[part]) - length[part])
    return same


class WuManber:
    """Tables for the windows of m words that begin at the places `at` of `words`."""

    def __init__(self, m: int, words: Words, at: np.ndarray):
        self.m, self.B, self.words = m, min(3 if len(at) > MANY else 2, m), words
        self.bits = min(26, max(12, (8 * len(at)).bit_length()))
        self.shift = np.full(1 << self.bits, m - self.B + 1, np.uint8 if m < 255 else np.int64)
        for back in range(m - self.B, -1, -1):  # blocks that end `back` words before the window's end; the least comes last
            self.shift[self._slot(words.windows(at + m - self.B - back, self.B))] = back
        whole, suffix = words.windows(at, m), words.windows(at + m - self.B, self.B)
        order = np.lexsort((whole, suffix))
        self.whole, suffix, self.at = whole[order], suffix[order], at[order]
        # equal windows, next to each other unless hashes collide, are one pattern
        again = np.flatnonzero((self.whole[1:] == self.whole[:-1]) & (suffix[1:] == suffix[:-1]))
        equal = np.zeros(len(order), bool)
        equal[again[same_bytes(words, self.at[again], words, self.at[again + 1], m)] + 1] = True
        self.members = np.append(np.flatnonzero(~equal), len(order))  # places of a pattern's windows in `order`
        self.order = order
        self.whole, suffix, self.at = (x[~equal] for x in (self.whole, suffix, self.at))
        self.suffixes, self.bucket = np.unique(suffix, return_index=True)
        self.bucket = np.append(self.bucket, len(suffix))

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence within a text."""
        n = np.diff(words.first)
        long = np.flatnonzero(n >= self.m)
        if not len(long):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # lanes: places that a window's last word can take, LANE at a time
        lanes = -(-(n[long] - self.m + 1) // LANE)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        place = np.repeat(words.first[long] + self.m - 1, lanes) + number * LANE
        stop = np.minimum(place + LANE, np.repeat(words.first[long + 1], lanes))
        found_at, found = [], []
        while len(place):
            block = words.windows(place - self.B + 1, self.B)
            step = self.shift[self._slot(block)].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero):
                at, pattern = self._candidates(words, place[zero] - self.m + 1, block[zero])
                same = same_bytes(words, at, self.words, self.at[pattern], self.m)
                found_at.append(at[same])
                found.append(pattern[same])
            place = place + np.maximum(step, 1)
            going = place < stop
            place, stop = place[going], stop[going]
        return np.concatenate(found_at or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])

    def _candidates(self, words: Words, at: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) pairs of the blocks' buckets with the hash of the whole window."""
        k = np.minimum(np.searchsorted(self.suffixes, block), len(self.suffixes) - 1)
        here = self.suffixes[k] == block
        at, k = at[here], k[here]
        low, high, whole = self.bucket[k], self.bucket[k + 1], words.windows(at, self.m)
        end = high.copy()
        while np.any(low < high):  # bisection within each bucket
            middle = (low + high) // 2
            less = (low < high) & (self.whole[np.minimum(middle, len(self.whole) - 1)] < whole)
            low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
        out_at, out = [], []
        while len(at):  # one more of equal hashes at each turn
            hit = (low < end) & (self.whole[np.minimum(low, len(self.whole) - 1)] == whole)
            at, low, end, whole = at[hit], low[hit], end[hit], whole[hit]
            out_at.append(at)
            out.append(low)
            low = low + 1
        return np.concatenate(out_at or [at]), np.concatenate(out or [low])


class Patterns:
    """The windows of a block of items, a Wu-Manber table for each length."""

    def __init__(self, items: list[tuple[bytes, list[str]]], window: int):
        """items: (text, ids as text) with distinct texts."""
        self.names = [ids for _, ids in items]
        off = np.cumsum([0, *(len(t) for t, _ in items)], dtype=np.int64)
        words = Words(np.frombuffer(b"".join(t for t, _ in items), np.uint8), off)
        n = np.diff(words.first)
        self.tables = []
        for m in np.unique(np.minimum(n, window)[n > 0]).tolist():
            mine = np.flatnonzero((np.minimum(n, window) == m) & (n > 0))
            count = n[mine] - m + 1
            item = np.repeat(mine, count)
            at = np.repeat(words.first[mine], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            table = WuManber(m, words, at)
            self.tables.append((table, item[table.order].astype(np.int32)))

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items of each text."""
        change = np.zeros(len(words.hashes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
        for table, item in self.tables:
            at, pattern = table.search(words)
            np.add.at(change, at, 1)
            np.add.at(change, at + table.m, -1)
            text = np.searchsorted(words.first, at, "right") - 1
            for t, p in set(zip(text.tolist(), pattern.tolist())):
                for i in set(item[table.members[p] : table.members[p + 1]].tolist()):
                    items[t].update(self.names[i])
        return np.cumsum(change)[:-1] > 0, items


#: The tables a worker built last, by the items they are of; tasks that follow in the same worker use them again.
_built: list[tuple[list, int, Patterns]] = []


def patterns_of(items: list[tuple], window: int) -> Patterns:
    if not (_built and _built[0][0] is items and _built[0][1] == window):
        _built.clear()  # before the next are built, so that a worker holds one
        _built.append((items, window, Patterns(items, window)))
    return _built[0][2]


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """(text, ids) of distinct item texts, about `block_bytes` of text at a time."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    distinct = common.cut(items.groupBy(text.alias("text")).agg(F.collect_set(F.col("item_id").cast("string")).alias("ids")).filter("text <> ''"))
    held: list[tuple[bytes, list[str]]] = []
    size = 0
    for r in distinct.toLocalIterator():
        held.append((r["text"].encode(), sorted(r["ids"])))
        size += len(held[-1][0])
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held or not size:
        yield held


def _segments(text: bytes, window: int, limit: int = common.CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, bytes, offsets) of stretches of a text that overlap by a window less a word."""
    begin = first = 0
    while True:
        end = begin + limit
        while True:  # to the end of a word, and on until there is more than the overlap
            while end < len(text) and (IS_WORD[text[end]] or 65 <= text[end] <= 90):
                end += 1
            data = np.frombuffer(text[begin:end], np.uint8)
            off = np.array([0, len(data)])
            starts, _, _ = common.word_spans(LOWER[data], off, IS_WORD)
            if end >= len(text) or len(starts) >= window:
                break
            end += limit
        yield first, data, off
        if end >= len(text):
            return
        step = len(starts) - window + 1
        first += step
        begin += int(starts[step]) if window > 1 else len(data)


def _scan(column: pa.Array, patterns: Patterns, window: int) -> Iterator[tuple[int, bytes | None, list[str]]]:
    """(words, packed flags of hit words or None, items) of each text."""
    for _, _, data, off in common.chunks(column):
        if len(off) == 2 and len(data) > 2 * common.CHUNK_BYTES:
            n, flags, names = 0, [], set()
            for first, part, at in _segments(data.tobytes(), window):
                words = Words(part, at)
                hit, items = patterns.hits(words)
                again = n - first
                if again:
                    flags[-again:] = (np.array(flags[-again:], bool) | hit[:again]).tolist()
                flags += hit[again:].tolist()
                n = first + len(hit)
                names |= items[0]
            yield n, np.packbits(np.array(flags, bool)).tobytes() if any(flags) else None, sorted(names)
            continue
        words = Words(data, off)
        hit, items = patterns.hits(words)
        any_hit = np.add.reduceat(np.append(hit, False), words.first[:-1]) * (np.diff(words.first) > 0)
        for i, (x, y) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            yield y - x, np.packbits(hit[x:y]).tobytes() if any_hit[i] else None, sorted(items[i])


def _mark(docs: DataFrame, items: list[tuple], window: int, names: list[str]) -> DataFrame:
    """The documents with the hits of a block of items in the columns `names`."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    keep = docs.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = patterns_of(sent.value, window)
        for b in batches:
            found = list(zip(*_scan(b.column("text"), patterns, window))) or [()] * 3
            added = [pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.binary(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *added], [*keep, *names])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(search, f"{own}`{names[0]}` long, `{names[1]}` binary, `{names[2]}` array<string>")


def _or(flags) -> bytes | None:
    """Packed flags of one text, from several blocks of items."""
    out = None
    for x in flags:
        if x is not None:
            out = x if out is None else (np.frombuffer(out, np.uint8) | np.frombuffer(x, np.uint8)).tobytes()
    return out


def mark(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> tuple[DataFrame, list[str]]:
    """The documents with three more columns, and their names: words, packed flags of hit words (null for none), item ids (sorted)."""
    names = common.free(docs, "__n", "__hits", "__items")
    blocks = item_blocks(items, block_bytes)
    block, another = next(blocks), next(blocks, None)
    if another is None:
        return _mark(docs, block, window, names), names
    n, hits, ids = names
    digest, other = common.free(docs, "__digest", "__of")
    texts = docs.select(F.col("text").cast("string")).withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    passes = []
    while block is not None:  # each pass is written before the next block is sent
        found = _mark(texts, block, window, names).filter(F.col(hits).isNotNull()).select(digest, hits, ids)
        passes.append(common.cut(found.dropDuplicates([digest])))
        block, another = another, next(blocks, None)
    every = passes[0]
    for x in passes[1:]:
        every = every.unionByName(x)

    def join_blocks(key, rows):
        import pandas as pd

        return pd.DataFrame({other: [key[0]], hits: [_or(rows[hits])], ids: [sorted({i for x in rows[ids] for i in x})]})

    every = every.groupBy(digest).applyInPandas(join_blocks, f"`{other}` string, `{hits}` binary, `{ids}` array<string>")  # a row of a text for each block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [0] * len(b)
            for first, _, data, off in common.chunks(b.column("text")):
                for i, x in enumerate(np.diff(common.word_spans(LOWER[data], off, IS_WORD)[2]).tolist()):
                    sizes[first + i] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], [*b.schema.names, n])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    counted = docs.mapInArrow(count, f"{own}, `{n}` long").withColumn(digest, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    joined = counted.join(every, F.col(digest) == F.col(other), "left")
    return joined.select(*docs.columns, n, hits, F.coalesce(ids, F.array().cast("array<string>")).alias(ids)), names


def hit_report(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    marked, names = mark(docs.select("doc_id", F.col("text").cast("string")), items, window, block_bytes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [0 if h is None else int(np.bitwise_count(np.frombuffer(h, np.uint8)).sum()) for h in b.column(2).to_pylist()]
            ids = b.column(3).to_pylist()
            columns = [b.column("doc_id"), b.column(1), pa.array(hits, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]), pa.array([h > 0 for h in hits])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.select("doc_id", *names).mapInArrow(digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents without any hit word, all columns as they are."""
    marked, names = mark(docs, items, window, block_bytes)
    return marked.filter(F.col(names[1]).isNull()).select(*docs.columns)
