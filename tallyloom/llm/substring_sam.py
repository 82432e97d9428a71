"""Substring dedup: suffix automata of reference shards, and documents streamed through them.

Every text is reference to every other, so the reference grows with the corpus and cannot be broadcast
whole: it is sharded by anchor (see `repeats`), and a shard's automaton, built where its pieces are, serves
just the pieces that can match it. Each automaton counts, for each of its states, the places where the
state's strings end. Pieces stream through it; while a word is read, suffix links keep the state at the
match's last `LENGTH` words, and the state's count tells whether that window starts elsewhere too. Maximal
runs of words covered by such windows are removed. Words are numbered within a shard by their bytes.

`match_reference` is the same for a reference of its own: its shards' automata are broadcast, as many at a time
as a bound allows, and whole documents are streamed through each for their matching statistics.

Defined results: a null text has no words; rows are documents of their own, so equal texts repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

LENGTH = 35
#: Words of an automaton at most: some 400 bytes each.
MOST_WORDS = 1 << 18

WORDS = repeats.Words(LENGTH, 8)


class Automaton:
    """Suffix automaton of several word sequences; `count` has the (weighted) places of each state's strings."""

    def __init__(self, sequences: list[list[int]], weights: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for sequence, weight in zip(sequences, weights):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                self.count[last] += weight
        for state in np.argsort(-np.array(self.length), kind="stable")[:-1].tolist():
            self.count[self.link[state]] += self.count[state]

    def _add(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _clone(self, state: int, target: int, word: int) -> int:
        """Splits `target`, whose longest string does not end a step after `state`."""
        copy = self._add(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another sequence went this way
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, word)
        new = self._add({}, 0, self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._clone(state, target, word)
        return new

    def matches(self, sequence: list[int], most: int) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word the length of the longest match that ends there, `most` at most, and its state."""
        state = size = 0
        following, link, length = self.next, self.link, self.length
        for word in sequence:
            while word not in following[state]:
                if not state:
                    break
                state = link[state]
                size = length[state]
            if word in following[state]:
                state = following[state][word]
                size += 1
            while length[link[state]] >= most if state else False:
                state = link[state]
            if size > most:
                size = most
            yield size, state


def repeated_windows(pieces: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    """For each piece, which of its windows start elsewhere too."""
    number: dict[bytes, int] = {}
    sequences = [[number.setdefault(w, len(number)) for w in p.split(b" ")] for p in pieces]
    automaton = Automaton(sequences, weights.tolist())
    count = automaton.count
    return [np.array([size == LENGTH and count[state] >= 2 for size, state in automaton.matches(s, LENGTH)][LENGTH - 1 :], bool) for s in sequences]


def _without(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, str]:
    """The number of words, and the SHA-256 of those outside of `runs`, joined by blanks."""
    n, kept, first, k = 0, hashlib.sha256(), True, 0
    for words, _ in repeats.word_runs(text):
        begin, end, stay = n, n + len(words), []
        at = begin
        while k < len(runs) and runs[k][0] < end:
            stay += words[at - begin : max(at, runs[k][0]) - begin]
            at = max(at, min(runs[k][1], end))
            if runs[k][1] > end:
                break
            k += 1
        stay += words[at - begin :]
        if stay:
            kept.update(b" ".join(stay) if first else b" " + b" ".join(stay))
            first = False
        n = end
    return n, kept.hexdigest()


def removal_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ranges in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("ranges").to_pylist()):
                runs = repeats.merged(ranges)
                n, kept = _without(text, runs)
                out.append((n, sum(b - a for a, b in runs), kept))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    options = {"most_units": MOST_WORDS, **options}
    return repeats.with_ranges(docs, WORDS, repeated_windows, **options).mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def match_reference(docs: DataFrame, reference: DataFrame, length: int = LENGTH, shard_words: int = 100_000, sent_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, longest, covered): each document's longest match within a row of `reference`, in words, and its words in matches of `length` or more.

    A reference text is cut into shards of about `shard_words` words that overlap by `length` - 1; a match longer than
    that can be cut at a shard's end, so `longest` is exact up to `length` and otherwise a lower bound where a text
    is longer than a shard. Texts of about `sent_bytes` in all are broadcast at a time, so any reference will do: each
    such part is a pass over the documents, whose result is written before the next part is sent, so a task holds
    the automata of one part only.
    """
    state = docs.select("doc_id", F.col("text").cast("string"), F.lit(0).cast("long").alias("longest"), F.array().cast("array<long>").alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stream_through(state: DataFrame, part: list[bytes]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = []
            for shard in _shards(sent.value, shard_words, length):
                number: dict[bytes, int] = {}
                sequences = [[number.setdefault(w, len(number)) for w in x] for x in shard]
                automata.append((number, Automaton(sequences, [1] * len(sequences))))
            for b in batches:
                longest, ranges = b.column("longest").to_pylist(), b.column("ranges").to_pylist()
                for j, text in enumerate(b.column("text").cast(pa.large_binary()).to_pylist()):
                    words = (text or b"").split()
                    for number, automaton in automata:
                        for at, (n, _) in enumerate(automaton.matches([number.get(w, -1) for w in words], len(words) + 1)):
                            longest[j] = max(longest[j], n)
                            if n >= length:
                                ranges[j].append(((at - n + 1) << 32) + at + 1)
                    ranges[j] = [(a << 32) + e for a, e in repeats.merged(ranges[j])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(longest, pa.int64()), pa.array(ranges, pa.list_(pa.int64()))], ["doc_id", "text", "longest", "ranges"])

        return state.mapInArrow(stream, f"doc_id {kind}, text string, longest long, ranges array<long>")

    held: list[bytes] = []
    for (text,) in reference.select(F.coalesce(F.col("text").cast("string"), F.lit(""))).toLocalIterator():
        held.append(text.encode())
        if sum(map(len, held)) >= sent_bytes:
            state, held = common.cut(stream_through(state, held)), []
    state = stream_through(state, held) if held else state
    covered = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + F.pmod(r, F.lit(1 << 32)) - F.shiftright(r, 32))
    return state.select("doc_id", "longest", covered.alias("covered"))


def _shards(texts: list[bytes], shard_words: int, length: int) -> Iterator[list[list[bytes]]]:
    """Word sequences, about `shard_words` words at a time."""
    held: list[list[bytes]] = []
    size, step = 0, max(shard_words, length)
    for text in texts:
        words = text.split()
        for first in range(0, max(1, len(words) - length + 1), step):
            held.append(words[first : first + step + length - 1])
            size += len(held[-1])
            if size >= shard_words:
                yield held
                held, size = [], 0
    if held:
        yield held
