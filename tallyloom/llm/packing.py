"""Best-fit packing: documents as token pieces in as few sequences of `capacity` tokens as possible.

Method: a grouping genetic algorithm. A crossover injects whole well-filled sequences of one packing into another,
takes sequences there apart that hold one of the injected pieces, and places what these leave over by best fit; a
mutation takes sequences apart that have room. Pieces are dealt to batches of about `batch` pieces by a hash. A batch
starts from best fit decreasing; where that misses the lower bound, islands of packings evolve in tasks of their own, and
after each epoch the best packing of an island migrates to the next one. Batches hand their least filled sequences
on to a next round, in which fewer batches pack them anew, until one batch is left: so the room that each leaves
does not add up. A batch that reaches the lower bound (which counts pieces too long to share a sequence) is optimal and
evolves no further.

Token ids are those of `tokenizers`, see `Tokens`.

Defined results: a null text is an empty one, whose only token is the end; a text's pieces of `capacity` tokens are
whole sequences; repeated rows are packed each; doc_id may be null or repeated. A text is tokenized in stretches, its ids are held
by one task (4 bytes each). Columns of other names are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import groupby, islice
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END = 2
#: Pieces of a batch, islands of an unfinished one, epochs between migrations at most, generations of an epoch.
BATCH, ISLANDS, EPOCHS, GENERATIONS = 8192, 4, 2, 20
#: One in so many sequences of a batch, the least filled, goes to the next round.
HANDED = 8
POPULATION = 6
#: Cuts whose ids a worker keeps at most; characters tokenized together.
KEPT, STRETCH = 1 << 20, 1 << 20

#: Characters of which every Unicode version knows what they are, and how the byte-level pattern cuts text of them.
_KNOWN = re.compile("[\t-\r -~À-ÖØ-öø-ſ]*")
_CUTS = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ſ0-9]+|\\s+(?!\\S)|\\s+")
# a blank between visible characters belongs to the second, whatever they are
_SEAM = re.compile("(?<=[!-~¡-ᙿ]) (?=[!-~¡-ᙿ])")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte as its Latin-1 character where that is visible, the others as characters from 256 on.
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class _Seen(dict):
    """Ids of cuts, each asked of the model when it is first met."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, cut: str) -> bytes:
        if len(self) >= KEPT:
            for late in list(islice(self, KEPT // 2, None)):  # frequent cuts were met early
                del self[late]
        ids = [t.id for t in self.model.tokenize(cut.encode().decode("latin-1").translate(_BYTES))]
        self[cut] = found = pack_ids(f"<{len(ids)}I", *ids)
        return found


class Tokens:
    """Ids of texts, by a tokenizer's JSON.

    Byte-level tokenizers without a normalizer cut a text at places known beforehand and then treat each
    cut alike wherever it stands: ids of cuts seen before come from memory. Texts of other tokenizers, and stretches with
    characters beyond Latin or with added tokens, go through the tokenizer as they are.
    """

    def __init__(self, rules: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(rules)
        read = json.loads(rules)
        before = read.get("pre_tokenizer") or {}
        self.by_cuts = read.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and read["model"].get("type") == "BPE" and not read["model"].get("dropout")
        self.added = [t["content"] for t in read.get("added_tokens", [])]
        self.seen = _Seen(self.tokenizer.model)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, text: str) -> bytes:
        return b"".join(map(self.seen.__getitem__, _CUTS.findall(text)))

    def ids(self, text: str) -> bytes:
        """The ids, four bytes each, the lowest first."""
        if not self.by_cuts or any(a in text for a in self.added):
            return self._whole(text)
        out, at = [], 0
        while at < len(text):
            end = at + STRETCH
            seam = _SEAM.search(text, end) if end < len(text) else None
            end = seam.start() if seam else len(text)
            stretch = text[at:end]
            if _KNOWN.fullmatch(stretch):
                out.append(self._known(stretch))
            else:
                parts = _SEAM.split(stretch)
                parts[1:] = [" " + x for x in parts[1:]]
                # neighbours of one kind go together, so that the tokenizer is asked for few long stretches
                for known, group in groupby(parts, lambda x: _KNOWN.fullmatch(x) is not None):
                    out.append((self._known if known else self._whole)("".join(group)))
            at = end
        return b"".join(out)


_tokens: dict[int, Tokens] = {}


def _tokens_of(rules: str) -> Tokens:
    """One for each worker process, kept between its tasks."""
    key = zlib.crc32(rules.encode())
    if key not in _tokens:
        _tokens.clear()
        _tokens[key] = Tokens(rules)
    return _tokens[key]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and `end`, cut where longer than `capacity` so that the first piece is the short one.

    tokenizer: path of a JSON file of `tokenizers`, read on the driver; its rules go to the tasks.
    """
    with open(tokenizer, encoding="utf-8") as f:
        rules = docs.sparkSession.sparkContext.broadcast(f.read())
    last = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens_of(rules.value)
        for b in batches:
            rows = []
            for k, text in enumerate(b.column("text")):
                ids = tokens.ids(text.as_py() or "") + last
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(k, i, x, y - x, zlib.crc32(ids[4 * x : 4 * y])) for i, (x, y) in enumerate(zip(edges, edges[1:]))]
            if rows:
                k, piece, start, length, crc = zip(*rows)
                ids = b.column("doc_id").take(pa.array(k, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---- packings of one batch: an array with each piece's sequence


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: of pieces above a threshold, two long ones share none, and the middle ones need what room those leave."""
    count = np.bincount(lengths, minlength=capacity + 1)
    tokens = count * np.arange(capacity + 1)
    upto, upto_tokens = np.cumsum(count), np.cumsum(tokens)
    least = np.arange(capacity // 2 + 1)  # thresholds
    half = capacity // 2
    lone = upto[capacity] - upto[capacity - least]
    paired = upto[capacity - least] - upto[half]
    room = paired * capacity - (upto_tokens[capacity - least] - upto_tokens[half])
    middle = upto_tokens[half] - np.where(least > 0, upto_tokens[np.maximum(least, 1) - 1], 0)
    return int((lone + paired + np.maximum(0, -((room - middle) // capacity))).max())


def best_fit(lengths: np.ndarray, packing: np.ndarray, fill: list[int], which: np.ndarray, capacity: int) -> None:
    """Places the pieces `which`, the longest first, each in the sequence with the least room that holds it; else in a new one."""
    if not len(which):
        return
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for number in np.flatnonzero(capacity - np.array(fill, np.int64) >= lengths[which].min()).tolist():  # the others hold none of them
        rooms[capacity - fill[number]].append(number)
        open_rooms |= 1 << (capacity - fill[number])
    for i in which[np.argsort(-lengths[which], kind="stable")].tolist():
        need = int(lengths[i])
        fits = open_rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room, number = capacity, len(fill)
            fill.append(0)
        packing[i] = number
        fill[number] += need
        rooms[room - need].append(number)
        if room > need:
            open_rooms |= 1 << (room - need)


def _compact(lengths: np.ndarray, packing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences numbered from 0 without gaps (-1 stays), and their fill."""
    placed = packing >= 0
    used, numbers = np.unique(packing[placed], return_inverse=True)
    out = np.full(len(packing), -1, np.int64)
    out[placed] = numbers
    return out, np.bincount(numbers, lengths[placed], len(used)).astype(np.int64)


def _completed(lengths: np.ndarray, packing: np.ndarray, capacity: int) -> np.ndarray:
    """The packing with its unplaced pieces (-1) placed by best fit."""
    packing, fill = _compact(lengths, packing)
    best_fit(lengths, packing, fill.tolist(), np.flatnonzero(packing < 0), capacity)
    return packing


def fitness(lengths: np.ndarray, packing: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences are better, then unevenly filled ones, as their room is of more use in one place."""
    fill = np.bincount(packing, lengths)
    return -len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def crossover(lengths: np.ndarray, base: np.ndarray, donor: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """`base` with well-filled sequences of `donor` in the place of its own that share a piece with them."""
    fill = np.bincount(donor, lengths)
    order = np.argsort(-(fill + rng.random(len(fill)) * capacity / 16))
    chosen = order[: rng.integers(1, max(2, len(fill) // 2))]
    injected = np.isin(donor, chosen)
    broken = np.isin(base, np.unique(base[injected]))
    child = np.where(broken, -1, base)
    child[injected] = donor[injected] + len(base) + 1
    return _completed(lengths, child, capacity)


def mutated(lengths: np.ndarray, packing: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Takes the sequences with most room and some others apart, and places their pieces again."""
    fill = np.bincount(packing, lengths)
    n = len(fill)
    gone = np.concatenate([np.argsort(fill, kind="stable")[: 1 + rng.integers(3)], rng.integers(0, n, 1 + rng.integers(max(2, n // 20)))])
    return _completed(lengths, np.where(np.isin(packing, gone), -1, packing), capacity)


def first_packing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    return _completed(lengths, np.full(len(lengths), -1, np.int64), capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, capacity: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, the best first; ends early at the lower bound."""
    bound = lower_bound(lengths, capacity)
    while len(population) < POPULATION:
        population.append(mutated(lengths, population[0], rng, capacity))
    rated = sorted(((fitness(lengths, p, capacity), p) for p in population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if -rated[0][0][0] <= bound:
            break
        a, b = (min(rng.integers(0, len(rated), 2)) for _ in range(2))  # of two each the better
        child = crossover(lengths, rated[a][1], rated[b][1], rng, capacity) if a != b else rated[a][1]
        if a == b or rng.random() < 0.5:
            child = mutated(lengths, child, rng, capacity)
        worth = fitness(lengths, child, capacity)
        if worth > rated[-1][0] and all(worth != w for w, _ in rated):
            rated[-1] = (worth, child)
            rated.sort(key=lambda x: x[0], reverse=True)
    return [p for _, p in rated]


# ---- batches on Spark


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield x.values.to_numpy().astype(np.int64) if x.values is not None else np.zeros(0, np.int64)


def _packed_batches(batches: DataFrame, n: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(batch, packing) of `n` batches (batch, lengths)."""

    def start(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            _tokens.clear()  # a worker that has made ids before needs them no more
            out, done = [], []
            for lengths in _lists(b.column("lengths")):
                out.append(first_packing(lengths, capacity))
                done.append(int(out[-1].max(initial=-1)) + 1 <= lower_bound(lengths, capacity))
            yield pa.RecordBatch.from_arrays([b.column("batch"), pa.array(out, pa.list_(pa.int32())), pa.array(done)], ["batch", "packing", "done"])

    first = common.cut(batches.coalesce(n).mapInArrow(start, "batch long, packing array<int>, done boolean"))
    found = [first.filter("done").select("batch", "packing")]
    state = batches.join(first.filter("NOT done"), "batch").select("batch", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.array("packing").alias("packings"))
    schema = "batch long, island int, lengths array<int>, packings array<array<int>>, done boolean, sequences int, filled double"

    for epoch in range(epochs):

        def live(parts: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for b in parts:
                rows = []
                for batch, island, lengths, packings in zip(b.column("batch").to_pylist(), b.column("island").to_pylist(), _lists(b.column("lengths")), b.column("packings")):
                    rng = np.random.default_rng([batch & 0xFFFFFFFF, batch >> 32, island, epoch])
                    population = evolve(lengths, list(_lists(packings.values)), rng, capacity, generations)
                    worth = fitness(lengths, population[0], capacity)
                    rows.append((batch, island, lengths, population, -worth[0] <= lower_bound(lengths, capacity), -worth[0], worth[1]))
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.bool_(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["batch", "island", "lengths", "packings", "done", "sequences", "filled"])

        state = common.cut(state.repartition(n * islands).mapInArrow(live, schema))
        best = state.groupBy("batch").agg(F.min_by(F.col("packings")[0], F.struct("sequences", -F.col("filled"), "island")).alias("packing"), F.bool_or("done").alias("done"))
        last = epoch == epochs - 1
        found.append(best.filter(F.lit(last) | F.col("done")).select("batch", "packing"))
        if last or state.isEmpty():
            break
        open_ones = state.join(best.filter("NOT done").select("batch"), "batch", "left_semi")
        guests = open_ones.select("batch", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("packings", 1, 1).alias("guest"))
        state = open_ones.join(guests, ["batch", "island"]).select("batch", "island", "lengths", F.concat(F.slice("packings", 1, POPULATION - 1), "guest").alias("packings"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, batch: int = BATCH, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """(uid, sequence_id, offset) of items (uid long, unique, below 2^56; length long, 1 to capacity)."""
    done = items.filter(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, number = items.filter(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length")), 1
    left = rest.count()
    while left:
        n = max(1, round(left / batch))
        dealt = rest.groupBy(F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(n)).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("items"))
        dealt = common.cut(dealt.select("batch", "items.uid", "items.length").toDF("batch", "uids", "lengths"))
        packed = _packed_batches(dealt.select("batch", "lengths"), n, capacity, islands, epochs, generations)
        alone = n == 1

        def place(parts: Iterator[pa.RecordBatch], alone: bool = alone) -> Iterator[pa.RecordBatch]:
            for b in parts:
                for uids, lengths, packing, batch_number in zip(_lists(b.column("uids")), _lists(b.column("lengths")), _lists(b.column("packing")), b.column("batch").to_pylist()):
                    order = np.lexsort((uids, packing))
                    uids, lengths, packing = uids[order], lengths[order], packing[order]
                    fill = np.bincount(packing, lengths).astype(np.int64)
                    before = np.cumsum(lengths) - lengths
                    offset = before - (np.cumsum(fill) - fill)[packing]
                    again = np.zeros(len(fill), bool)
                    if not alone:
                        again[np.argsort(fill, kind="stable")[: -(-len(fill) // HANDED)]] = True
                    size = len(uids)
                    yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(lengths.astype(np.int32)), pa.array(np.full(size, batch_number)), pa.array(packing), pa.array(offset), pa.array(again[packing])], ["uid", "length", "batch", "sequence", "offset", "again"])

        placed = common.cut(dealt.join(packed, "batch").coalesce(n).mapInArrow(place, "uid long, length int, batch long, sequence long, offset long, again boolean"))
        numbered = F.lit(number << 56).bitwiseOR(F.shiftleft("batch", 20)).bitwiseOR(F.col("sequence"))
        done = done.unionByName(placed.filter("NOT again").select("uid", numbered.alias("sequence_id"), "offset"))
        rest, number = placed.filter("again").select("uid", "length"), number + 1
        left = 0 if alone else rest.count()
    return done


def pack_report(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece."""
    cut = common.cut(pieces(docs, tokenizer, capacity, end).withColumn("uid", F.monotonically_increasing_id()))
    return cut.join(pack(cut.select("uid", "length"), capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
