"""Finding repeated windows of a corpus: what the two substring operators share.

A window is `length` consecutive units (bytes or words) of one document. Windows that are equal have the
same least gram (`gram` units, by hash), so stretches of windows with one least gram, "pieces", are dealt by
that gram's hash, the anchor, and equal windows meet. Which windows of the pieces of an anchor start
elsewhere too is for the operator's own index to say; it gets the pieces' bytes, so no hash decides.

Steps, each a job over the documents or over something smaller:
1. anchors are counted by a grouped sum; those met twice or more set bits in a table sized by their number (64 MB
   at most), which is broadcast. A set bit may be shared, so the table passes all repeated anchors and some others.
2. pieces of passed anchors are sorted by anchor and content; equal pieces become one with a weight, and the
   index marks the windows that start elsewhere. A task holds a batch of anchors. Pieces of an anchor that has
   more than `most_units` distinct units are cut again by longer grams and dealt by those; at grams as long
   as a window all pieces of an anchor are equal, so every index stays bounded.
3. places of pieces are joined with the marks by content hash (128 bits), and gathered by document content, so copies
   of a document are looked up once.
4. documents are joined with their ranges by content.

Long texts are read in segments that overlap by a window less a unit, so memory does not grow with a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Windows in a piece at most; a longer stretch makes several pieces.
PIECE_WINDOWS = 200
BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECE_SCHEMA = "p1 long, p2 long, starts array<int>, ends array<int>, big binary, n long"


class Bytes:
    """Texts as bytes. segments: (first unit, bytes) of a text; lay: symbols of segments laid end to end, their offsets, and a function from a stretch of units to its bytes."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def segments(self, text: bytes, limit: int = common.CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
        step = max(limit, 2 * self.length) - self.length + 1
        for first in range(0, max(1, len(text) - self.length + 1), step):
            yield first, text[first : first + step + self.length - 1]

    def lay(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
        raw = b"".join(segments)
        return np.frombuffer(raw, np.uint8), _offsets(segments), lambda a, b: raw[a:b]

    @staticmethod
    def size(piece: bytes) -> int:
        return len(piece)


class Words(Bytes):
    """Texts as words between \\x20 and \\x09-\\x0D; a stretch's bytes are its words with one blank between them."""

    def segments(self, text: bytes, limit: int = common.CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
        first = 0
        for words, _ in word_runs(text, limit, self.length - 1):
            yield first, b" ".join(words)
            first += len(words) - self.length + 1

    def lay(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
        raw = b"".join(segments)
        data = np.frombuffer(raw, np.uint8)
        starts, ends, first = common.word_spans(data, _offsets(segments), common.BLANK_WORDS)
        return common.RollingHash(data).spans(starts, ends), first, lambda a, b: raw[starts[a] : ends[b - 1]]

    @staticmethod
    def size(piece: bytes) -> int:
        return piece.count(b" ") + 1


def _offsets(segments: list[bytes]) -> np.ndarray:
    return np.cumsum([0, *map(len, segments)], dtype=np.int64)


def word_runs(text: bytes, limit: int = common.CHUNK_BYTES, again: int = 0) -> Iterator[tuple[list[bytes], bool]]:
    """Runs of words of about `limit` bytes, and whether a run is the last; each after the first begins with the last `again` words of the one before."""
    begin, end = 0, limit
    while True:
        blank = BLANK.search(text, end)
        end = blank.start() if blank else len(text)
        part = text[begin:end]
        words = part.split()
        if end >= len(text):
            yield words, True
            return
        if len(words) <= again:  # words so long that the run says nothing new
            end += limit
            continue
        yield words, False
        begin = begin + len(part.rstrip().rsplit(None, again)[0]) if again else end
        end += limit


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by running minima within blocks."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def pieces_of(symbols: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows, whether the least gram is met twice) of each piece of texts laid end to end."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none.astype(bool)
    grams = common.RollingHash(symbols).grams(gram)
    least = sliding_min(grams, length - gram + 1)
    inside = np.zeros(n + 2, np.int8)
    long = np.diff(off) >= length
    inside[off[:-1][long]] = 1
    np.add.at(inside, off[1:][long] - length + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8)[: n - length + 1] > 0
    same = np.zeros(len(least) + 1, bool)  # same[i]: window i goes on from window i - 1
    same[1:-1] = inside[1:] & inside[:-1] & (least[1:] == least[:-1])
    first = np.flatnonzero(inside & ~same[:-1])
    end = np.flatnonzero(inside & ~same[1:]) + 1
    if not len(first):
        return none.astype(np.uint64), none, none, none.astype(bool)
    # a least gram that opens a window and is the least of the next one too is met again
    twice = np.logical_or.reduceat((grams[: len(least)] == least) & same[1:], first)
    parts = -(-(end - first) // PIECE_WINDOWS)
    which = np.repeat(np.arange(len(first)), parts)
    number = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[which] + number * PIECE_WINDOWS
    return common.mix(least[start]), start, np.minimum(PIECE_WINDOWS, end[which] - start), twice[which] | (parts > 1)[which]


def _chunks(batch: pa.RecordBatch, units: Bytes):
    """Segments of about `CHUNK_BYTES` in all, laid end to end: (row and first unit of each, offsets, bytes of a stretch, pieces)."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def laid():
        symbols, at, cut = units.lay([x for *_, x in held])
        return np.array([r for r, *_ in held]), np.array([f for _, f, _ in held]), at, cut, pieces_of(symbols, at, units.length, units.gram)

    for row, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
        for first, segment in units.segments(text or b""):
            held.append((row, first, segment))
            size += len(segment)
            if size >= common.CHUNK_BYTES:
                yield laid()
                held, size = [], 0
    if held:
        yield laid()


def anchor_table(docs: DataFrame, units: Bytes) -> tuple[np.ndarray, int]:
    """The bits of repeated anchors, and how many pieces have a repeated anchor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, (anchor, _, _, twice) in _chunks(b, units):
                found, which = np.unique(anchor, return_inverse=True)
                n = np.bincount(which, weights=1 + twice, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "n"])

    found = common.cut(docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"))
    repeated, met = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return common.bit_table(found, "anchor", repeated), int(met)


def _content(piece: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(piece)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _cut_out(at: np.ndarray, cut: Callable, pieces: tuple, length: int, ok=slice(None)) -> Iterator[tuple[int, int, int, bytes]]:
    """(segment, first window within it, anchor, bytes) of pieces."""
    anchor, start, windows, _ = (x[ok] for x in pieces)
    # an empty segment before the owner shares its offset; the last of them is the owner
    segment = np.searchsorted(at, start, "right") - 1
    yield from zip(segment.tolist(), (start - at[segment]).tolist(), anchor.view(np.int64).tolist(), (cut(a, b) for a, b in zip(start.tolist(), (start + windows + length - 1).tolist())))


def _passed(batch: pa.RecordBatch, units: Bytes, sent):
    """(row, first window within the text, anchor, bytes) of the pieces that the table passes."""
    table = np.frombuffer(sent.value, np.uint64)
    for rows, firsts, at, cut, pieces in _chunks(batch, units):
        for segment, first, anchor, piece in _cut_out(at, cut, pieces, units.length, common.passes(table, pieces[0])):
            yield rows[segment].item(), firsts[segment].item() + first, anchor, piece


def distinct_pieces(docs: DataFrame, units: Bytes, sent, kept: int = 100_000) -> DataFrame:
    """(anchor, p1, p2, piece, n): pieces met by a task, the bytes once, and later meetings as counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], list[int]] = {}

        def out(rows):
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["anchor", "p1", "p2", "piece", "n"])

        def counts():
            return out([(a, *p, None, n) for p, (a, n) in met.items() if n])

        for b in batches:
            rows = []
            for _, _, anchor, piece in _passed(b, units, sent):
                p = _content(piece)
                if p in met:
                    met[p][1] += 1
                    continue
                rows.append((anchor, *p, piece, 1))
                met[p] = [anchor, 0]
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
                if len(met) >= kept:
                    yield counts()
                    met = {}
            yield out(rows)
        yield counts()

    return docs.select("text").mapInArrow(emit, "anchor long, p1 long, p2 long, piece binary, n long")


def marked_pieces(pieces: DataFrame, units: Bytes, index: Callable, parts: int, batch_units: int, most_units: int | None, gram: int) -> DataFrame:
    """(p1, p2, starts, ends): of each distinct piece the runs of windows that start elsewhere too.

    index: (bytes of pieces, weights) -> for each piece a boolean for each of its windows. gram: by which the
    pieces are dealt. most_units: units of the distinct pieces of an anchor up to which the index takes them;
    None for no bound, where an anchor's pieces are all equal.
    """
    length, size = units.length, units.size

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush():
            out, rows[:] = list(rows), []
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["p1", "p2", "starts", "ends", "big", "n"])

        def work(batch: list[list]) -> None:
            if sum(x[3] for x in batch) < 2 and not any(size(x[2]) > length for x in batch):
                return
            for x, marks in zip(batch, index([x[2] for x in batch], np.array([x[3] for x in batch]))):
                if marks.any():
                    step = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
                    rows.append((x[0], x[1], np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), None, None))

        def pass_on(group: list[list]) -> None:
            rows.extend((x[0], x[1], None, None, x[2], x[3]) for x in group)

        ready: list[list] = []  # whole anchors
        group: list[list] = []  # the current anchor: [p1, p2, bytes, weight]
        current, ready_size, group_size, big = None, 0, 0, False
        for b in batches:
            for anchor, p1, p2, piece, n in zip(*(b.column(c).to_pylist() for c in ("anchor", "p1", "p2", "piece", "n"))):
                if anchor != current:
                    if big:
                        pass_on(group)
                    else:
                        ready, ready_size = ready + group, ready_size + group_size
                    current, group, group_size, big = anchor, [], 0, False
                    if ready_size >= batch_units:
                        work(ready)
                        ready, ready_size = [], 0
                    if len(rows) > 10_000:
                        yield flush()
                if group and group[-1][0] == p1 and group[-1][1] == p2:
                    group[-1][3] += n
                    group[-1][2] = group[-1][2] or piece
                    continue
                if big and group:  # pieces of a large anchor are passed on, one after the other
                    pass_on([group.pop()])
                    if len(rows) > 10_000:
                        yield flush()
                group.append([p1, p2, piece, n])
                group_size += size(piece) if piece else 0
                if most_units is not None and group_size > most_units and not big:
                    big = True
                    last = group.pop()
                    pass_on(group)
                    group = [last]
        if big:
            pass_on(group)
        else:
            ready += group
        if ready:
            work(ready)
        yield flush()

    finer = (gram + length + 1) // 2 if gram < length // 2 else length

    def cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        for b in batches:
            p1, p2, big, n = (b.column(c).to_pylist() for c in ("p1", "p2", "big", "n"))
            for i in range(0, len(big), 2000):
                _, at, cut = laid = units.lay(big[i : i + 2000])
                rows = [(p1[i + k], p2[i + k], first, anchor, *_content(piece), piece, n[i + k]) for k, first, anchor, piece in _cut_out(at, cut, pieces_of(laid[0], at, length, finer), length)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 8, kinds)], ["p1", "p2", "at", "anchor", "q1", "q2", "piece", "n"])

    dealt = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor", "p1", "p2", F.col("piece").isNull())
    marked = common.cut(dealt.mapInArrow(mark, PIECE_SCHEMA))
    found = marked.filter("big IS NULL").select("p1", "p2", "starts", "ends")
    large = marked.filter("big IS NOT NULL").select("p1", "p2", "big", "n")
    if most_units is None or large.isEmpty():
        return found
    again = large.mapInArrow(cut_again, "p1 long, p2 long, at int, anchor long, q1 long, q2 long, piece binary, n long")
    distinct = again.groupBy("anchor", F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.first("piece").alias("piece"), F.sum("n").alias("n"))
    inner = marked_pieces(distinct, units, index, parts, batch_units, None if finer == length else most_units, finer)
    inner = inner.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), "starts", "ends")
    moved = lambda c: F.transform(c, lambda x: x + F.col("at")).alias(c)
    return found.unionByName(again.select("p1", "p2", "at", "q1", "q2").join(inner, ["q1", "q2"]).select("p1", "p2", moved("starts"), moved("ends")))


def repeated_ranges(docs: DataFrame, units: Bytes, index: Callable, batch_units: int = 1 << 16, most_units: int = 1 << 20, kept: int = 200_000) -> DataFrame:
    """(digest, ranges): by MD5 of the text, ranges of units (start * 2^32 + end) covered by windows that start elsewhere too."""
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table, met = anchor_table(docs, units)
    sent = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    parts = common.partitions(docs.sparkSession, met * (units.length + PIECE_WINDOWS // 2) * (1 if units.size(b" ") == 1 else 8), 16 << 20)
    marks = marked_pieces(distinct_pieces(docs, units, sent), units, index, parts, batch_units, most_units, units.gram)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digests, rows = b.column("digest").to_pylist(), []
            fresh = [d not in seen and not seen.add(d) for d in digests]
            for row, start, _, piece in _passed(b, units, sent):
                if fresh[row]:
                    rows.append((digests[row], *_content(piece), start))
            if len(seen) > kept:
                seen.clear()
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["digest", "p1", "p2", "start"])

    at = docs.select("text", digest().alias("digest")).mapInArrow(places, "digest binary, p1 long, p2 long, start long")
    runs = at.join(marks, ["p1", "p2"]).select("digest", "start", F.explode(F.arrays_zip("starts", "ends")).alias("r"))
    coded = (F.col("start") + F.col("r.starts")) * F.lit(1 << 32) + F.col("start") + F.col("r.ends") + F.lit(units.length - 1)
    return runs.groupBy("digest").agg(F.collect_set(coded).alias("ranges"))


def digest():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def with_ranges(docs: DataFrame, units: Bytes, index: Callable, **options) -> DataFrame:
    """(doc_id, text, ranges): whole texts, null as empty, with their ranges (null for none)."""
    ranges = repeated_ranges(docs, units, index, **options)
    whole = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", digest())
    return whole.join(ranges, "digest", "left").select("doc_id", "text", "ranges")


def merged(ranges: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs, in order, of the units in a text's ranges."""
    if not ranges:
        return []
    coded = np.sort(np.array(ranges, np.int64))
    start, end = coded >> 32, np.maximum.accumulate(coded & 0xFFFFFFFF)
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist()))
