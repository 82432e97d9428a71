"""Line dedup: documents probe a sharded minimal perfect hash over the hashes of repeated lines.

The distinct line hashes are counted by a grouped aggregate (partial sums before the shuffle, so a line
that a third of all documents hold is one row a task). Of those found in two documents or more, each shard gets a
minimal perfect hash, built in its own task: level after level of bit arrays, a key's index being the rank
of its bit. The index leads to compact arrays: a 64-bit fingerprint (the half of the line's 128-bit hash
that tells members from others), the count, and the largest doc_id. Documents probe the arrays, so lines
are never joined; the count says whether a line is found often enough.

Up to `broadcast_bytes` the arrays of all shards are broadcast. Beyond, a table of bits (64 MB at most) is
broadcast, and hashes of lines that it passes are dealt by (shard, salt) and meet only their own shard's arrays
there; a shard gets a salt for each `probes_each` of its probes.

Defined results: a null or empty text is one empty line; rows are documents of their own even when doc_id
repeats (each counts, and all rows with the largest doc_id keep the line); a null doc_id is below all others.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STRIP = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
GAMMA = 1.5


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None below `min_chars` code points."""
    if len(line) < min_chars:
        return None
    key = line.strip(STRIP).lower()  # of bytes, lower() changes A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def hash_pair(key: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of the 128-bit hash."""
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def count_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n, last): keys found in two documents or more, in how many, and the largest doc_id that holds each."""

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for i, text in enumerate(b.column("text").cast(pa.large_binary()).to_pylist()):
                keys = {k for x in (text or b"").split(b"\n") if (k := line_key(x, min_chars))}
                rows += [(*hash_pair(k), NO_ID if ids[i] is None else ids[i]) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(zip(*rows)) or ([], [], []))], ["h1", "h2", "doc_id"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lines_of, "h1 long, h2 long, doc_id long")
    return found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter("n >= 2")


# ---- minimal perfect hash of one shard


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % (1 << 64))
    return common.mix(h1 ^ (h2 * seed)) % np.uint64(size)


def build_shard(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, last: np.ndarray) -> dict:
    """Levels of bit arrays with ranks; fingerprint, count and largest doc_id at each key's index.

    Keys that alone hold a slot of a level get its bit, the rest go to the next level.
    """
    h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
    levels, left, index, taken = [], np.arange(len(h1)), np.zeros(len(h1), np.int64), 0
    while len(left):
        words = int(len(left) * GAMMA) // 64 + 1
        slot = _slot(h1[left], h2[left], len(levels), words * 64)
        alone = np.bincount(slot.astype(np.int64), minlength=words * 64) == 1
        bits = np.packbits(alone, bitorder="little").view(np.uint64)
        ranks = (taken + np.cumsum(np.bitwise_count(bits)) - np.bitwise_count(bits)).astype(np.uint32)
        levels.append((bits, ranks))
        done = alone[slot.astype(np.int64)]
        index[left[done]] = _rank(bits, ranks, slot[done])
        taken += int(done.sum())
        left = left[~done]
    at = np.argsort(index)
    return {"levels": levels, "fingerprint": h2[at], "n": np.minimum(n[at], 0xFFFFFFFF).astype(np.uint32), "last": last[at].astype(np.int64)}


def _rank(bits: np.ndarray, ranks: np.ndarray, slot: np.ndarray) -> np.ndarray:
    word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
    below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return ranks[word].astype(np.int64) + np.bitwise_count(below)


def probe_shard(shard: dict, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The index of each key in the shard's arrays, -1 where it is no member."""
    out = np.full(len(h1), -1, np.int64)
    a, b = h1.view(np.uint64), h2.view(np.uint64)
    left = np.arange(len(a))
    for level, (bits, ranks) in enumerate(shard["levels"]):
        slot = _slot(a[left], b[left], level, len(bits) * 64)
        hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        found = left[hit]
        index = _rank(bits, ranks, slot[hit])
        same = shard["fingerprint"][index] == b[found]
        out[found[same]] = index[same]
        left = left[~hit]
    return out


def _often(shard: dict, h1: np.ndarray, h2: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that are members with a count of `min_docs` or more, and their indices."""
    index = probe_shard(shard, h1, h2)
    hit = np.flatnonzero(index >= 0)
    hit = hit[shard["n"][index[hit]] >= min_docs]
    return hit, index[hit]


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return h1 % shards  # as Spark's pmod


# ---- the operator


def _lines_to_drop(texts: list[bytes], ids: list, min_chars: int, min_docs: int, shards: int, load) -> list[set[int]]:
    """Of each text, the numbers of the lines to drop. load: the shard of a number, or None."""
    at, h1, h2 = [], [], []
    for i, text in enumerate(texts):
        for j, line in enumerate(text.split(b"\n")):
            if key := line_key(line, min_chars):
                a, b = hash_pair(key)
                at.append((i, j))
                h1.append(a)
                h2.append(b)
    drop: list[set[int]] = [set() for _ in texts]
    a, b = np.array(h1, np.int64), np.array(h2, np.int64)
    of = _shard_of(a, shards)
    for s in np.unique(of):
        shard = load(int(s))
        if shard is None:
            continue
        mine = np.flatnonzero(of == s)
        hit, index = _often(shard, a[mine], b[mine], min_docs)
        for k, x in zip(mine[hit], index):
            i, j = at[k]
            if (NO_ID if ids[i] is None else ids[i]) != shard["last"][x]:
                drop[i].add(j)
    return drop


def shard_tables(docs: DataFrame, min_chars: int, keys_each: int) -> tuple[DataFrame, int, int, DataFrame]:
    """(shard, arrays) for shards with any key, the number of shards, the number of keys, and the keys."""
    repeated = common.cut(count_lines(docs, min_chars))
    keys = repeated.count()
    shards = max(1, -(-keys // keys_each))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "arrays": [pickle.dumps(build_shard(*(rows[c].to_numpy() for c in ("h1", "h2", "n", "last"))), 5)]})

    dealt = repeated.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return common.cut(dealt.groupBy("shard").applyInPandas(build, "shard long, arrays binary")), shards, keys, repeated


def decide(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keys_each: int = 50_000, broadcast_bytes: int = 64 << 20):
    """A function (texts, ids) -> sets of line numbers to drop, for use in tasks; if the arrays exceed `broadcast_bytes`, None. And what `_routed_drops` needs."""
    tables, shards, keys, repeated = shard_tables(docs, min_chars, keys_each)
    if keys * 24 > broadcast_bytes:
        return None, (tables, shards, keys, repeated)
    sent = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in tables.select("shard", "arrays").collect()})
    opened: dict = {}

    def load(s: int):
        if s not in opened:
            arrays = sent.value.get(s)
            opened[s] = pickle.loads(arrays) if arrays else None
        return opened[s]

    return (lambda texts, ids: _lines_to_drop(texts, ids, min_chars, min_docs, shards, load)), None


def _digest(text: bytes | None) -> bytes:
    return hashlib.md5(text or b"").digest()


def _routed_drops(docs: DataFrame, built: tuple[DataFrame, int, int, DataFrame], min_chars: int, min_docs: int, probes_each: int) -> DataFrame:
    """(digest, doc_id, drop): line numbers to drop, found where (shard, salt) deals line hashes beside arrays.

    Used when the arrays are too large to broadcast.
    """
    tables, shards, keys, repeated = built
    sent = docs.sparkSession.sparkContext.broadcast(common.bit_table(repeated, "h1", keys).tobytes())

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint64)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist()):
                digest = _digest(text)
                rows += [(digest, i, j, *hash_pair(k)) for j, x in enumerate((text or b"").split(b"\n")) if (k := line_key(x, min_chars))]
            columns = list(zip(*rows)) or [()] * 5
            passed = common.passes(bits, np.array(columns[3], np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["digest", "doc_id", "line", "h1", "h2"]).filter(pa.array(passed, pa.bool_()))

    def look(key: tuple, lines: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(arrays):
            return pd.DataFrame({"digest": [], "doc_id": [], "line": []})
        shard = pickle.loads(arrays["arrays"].iloc[0])
        hit, index = _often(shard, lines["h1"].to_numpy(np.int64), lines["h2"].to_numpy(np.int64), min_docs)
        found = lines.iloc[hit]
        own = found["doc_id"].fillna(NO_ID).astype("int64").to_numpy()
        return found[own != shard["last"][index]][["digest", "doc_id", "line"]]

    lines = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(probes, "digest binary, doc_id long, line long, h1 long, h2 long")
    lines = common.cut(lines.withColumn("shard", F.pmod("h1", F.lit(shards))))
    salts = common.cut(lines.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(probes_each)).cast("long").alias("salts")))  # a row a shard
    salts = F.broadcast(salts) if shards <= 1_000_000 else salts
    lines = lines.join(salts, "shard").select("digest", "doc_id", "line", "h1", "h2", "shard", F.pmod(F.xxhash64("digest", "doc_id", "line"), "salts").alias("salt"))
    arrays = tables.join(salts, "shard").select("shard", "arrays", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    found = lines.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(look, "digest binary, doc_id long, line long")
    return found.groupBy("digest", "doc_id").agg(F.collect_set("line").alias("drop"))


def _with_drops(docs: DataFrame, routed: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """The documents with their lines to drop in a further column, and its name."""
    own, digest, doc_id, drop = common.free(docs, "__own", "__digest", "__id", "__drop")
    keyed = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    routed = routed.select(F.col("digest").alias(digest), F.col("doc_id").alias(doc_id), F.col("drop").alias(drop))
    return keyed.join(routed, (F.col(own) == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)), "left").select(*keep, drop), drop


def _digest_rows(b: pa.RecordBatch, drops) -> pa.RecordBatch:
    texts = [x or b"" for x in b.column("text").cast(pa.large_binary()).to_pylist()]
    out = []
    for text, drop in zip(texts, drops(texts, b)):
        lines = text.split(b"\n")
        kept = text if not drop else b"\n".join(x for j, x in enumerate(lines) if j not in drop)
        out.append((len(lines), len(drop), hashlib.sha256(kept).hexdigest()))
    cols = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keys_each: int = 50_000, broadcast_bytes: int = 64 << 20, probes_each: int = 200_000) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    drop, built = decide(docs, min_chars, min_docs, keys_each, broadcast_bytes)
    if drop is not None:
        return docs.mapInArrow(lambda batches: (_digest_rows(b, lambda texts, x: drop(texts, x.column("doc_id").to_pylist())) for b in batches), schema)
    joined, _ = _with_drops(docs, _routed_drops(docs, built, min_chars, min_docs, probes_each), ["doc_id", "text"])
    return joined.mapInArrow(lambda batches: (_digest_rows(b, lambda _, x: [set(d or ()) for d in x.column(2).to_pylist()]) for b in batches), schema)


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The documents, all columns as they are, without the lines that other documents keep; n_chars follows the text."""
    drop, built = decide(docs, min_chars, min_docs, broadcast_bytes=broadcast_bytes)
    names, schema = docs.columns, docs.schema

    def cleaned(b: pa.RecordBatch, drops) -> pa.RecordBatch:
        texts = b.column("text").cast(pa.large_binary()).to_pylist()
        out, chars = [], b.column("n_chars").to_pylist() if "n_chars" in names else None
        for i, (text, gone) in enumerate(zip(texts, drops([x or b"" for x in texts], b))):
            if gone:
                text = b"\n".join(x for j, x in enumerate(text.split(b"\n")) if j not in gone)
                if chars is not None:
                    chars[i] = len(text.decode())
            out.append(text)
        columns = {c: b.column(c) for c in names} | {"text": pa.array(out, pa.binary()).cast(pa.string())}
        if chars is not None:
            columns["n_chars"] = pa.array(chars, b.column("n_chars").type)
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    if drop is not None:
        return docs.mapInArrow(lambda batches: (cleaned(b, lambda texts, x: drop(texts, x.column("doc_id").to_pylist())) for b in batches), schema)
    joined, gone = _with_drops(docs, _routed_drops(docs, built, min_chars, min_docs, 200_000), names)
    return joined.mapInArrow(lambda batches: (cleaned(b, lambda _, x: [set(d or ()) for d in x.column(gone).to_pylist()]) for b in batches), schema)
