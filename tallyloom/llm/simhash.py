"""SimHash near-dedup: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Distinct fingerprints are dealt into buckets by bands: the 64 bits are cut into k bands, and two fingerprints
that differ in at most 4 bits agree on k - 4 of them at least, so each meets the other in the bucket of some
choice of k - 4 bands. More bands (up to 8) are taken as fingerprints grow in number, which keeps the
comparisons of each bounded while the result stays exact. A bucket is one tile, or, above `tile` members,
tiles by population count and salt; numpy compares the tiles of a bucket pair by pair and skips pairs whose
population counts differ beyond the radius. A comparison hands on a spanning forest of the links it finds,
never all pairs of a group; connected components join them.

Defined results: a text without words, null included, has fingerprint zero; rows with equal doc_id are one
document to the component ids; a component without any doc_id has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 4
SHINGLE = 4
BLOCK = 256


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, the highest bit first."""
    words = text.lower().split()  # of bytes: A-Z only, and at \x20\x09-\x0D
    if not words:
        return bytes(8)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_digest(line, 42)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a : b - 1], 42) for a, b in zip(starts, starts[SHINGLE:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each document, fp a signed long."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b"".join(fingerprint(x or b"") for x in b.column("text").cast(pa.large_binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(mark, "doc_id long, fp long")


def band_keys(bands: int, radius: int = RADIUS) -> list[Column]:
    """The key of each choice of `bands - radius` bands."""
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    keys = []
    for chosen in combinations(range(bands), bands - radius):
        key = F.lit(0).cast("long")
        for i in chosen:
            width = edges[i + 1] - edges[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return keys


def choose_bands(n: int, radius: int = RADIUS, compared: int = 4096) -> int:
    """The fewest bands by which even fingerprints would meet at most `compared` others."""
    for bands in range(radius + 1, 2 * radius):
        choices = len(list(combinations(range(bands), bands - radius)))
        if choices * n / 2 ** (64 * (bands - radius) // bands) <= compared:
            return bands
    return 2 * radius


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints: all of them where few, else enough to join what they join."""
    prints = np.unique(prints)
    counts = np.bitwise_count(prints)
    order = np.argsort(counts, kind="stable")
    prints, counts = prints[order], counts[order].astype(np.int64)
    us, vs, links = [], [], 0
    for i in range(0, len(prints), BLOCK):
        a = prints[i : i + BLOCK]
        top = counts[min(i + BLOCK, len(prints)) - 1]
        end = np.searchsorted(counts, top + radius, "right")  # beyond, the counts differ by more than the radius
        for j in range(i, end, BLOCK):
            b = prints[j : min(j + BLOCK, end)]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                us.append(a[x])
                vs.append(b[y])
                links += len(x)
        if links > 4 * len(prints):
            us, vs = _thin(np.concatenate(us), np.concatenate(vs))
            links = len(us)
            us, vs = [us], [vs]
    if not us:
        return prints[:0], prints[:0]
    return _thin(np.concatenate(us), np.concatenate(vs)) if links > len(prints) else (np.concatenate(us), np.concatenate(vs))


def _thin(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components: every node linked to the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def links(prints: DataFrame, n: int, tile: int = 4096) -> DataFrame:
    """(u, v): links that join all of the distinct fingerprints (column fp) within the radius of each other."""
    keys = band_keys(choose_bands(n))
    dealt = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), k.alias("key")) for i, k in enumerate(keys)))).alias("b")).select("fp", "b.choice", "b.key")
    sizes = dealt.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    salts = F.ceil(F.col("n") / F.lit(tile)).cast("long")
    part = F.when(salts > 1, F.bit_count("fp").cast("long") * (1 << 40) + F.pmod(F.xxhash64("fp"), salts)).otherwise(F.lit(-1).cast("long"))
    tiles = dealt.join(sizes, ["choice", "key"]).withColumn("part", part).groupBy("choice", "key", "part").agg(F.collect_list("fp").alias("a"), F.min(F.bit_count("fp")).alias("low"), F.max(F.bit_count("fp")).alias("high"))
    # pairs of tiles are named first, then dealt each by itself, so that a bucket of many tiles is no task's alone
    split = tiles.filter("part >= 0")
    left, right = split.select("choice", "key", "part", "low", "high"), split.select("choice", "key", F.col("part").alias("part2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = (F.col("part") < F.col("part2")) & (F.col("low2") - F.col("high") <= RADIUS) & (F.col("low") - F.col("high2") <= RADIUS)
    named = left.join(right, ["choice", "key"]).filter(near).select("choice", "key", "part", "part2")
    held = split.select("choice", "key", "part", "a")
    pairs = named.join(held, ["choice", "key", "part"]).join(held.withColumnsRenamed({"part": "part2", "a": "b"}), ["choice", "key", "part2"])
    pairs = pairs.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "choice", "key", "part", "part2").select("a", "b")
    work = tiles.select("a", F.array().cast("array<long>").alias("b")).unionByName(pairs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(batch.column("a"), batch.column("b")):
                both = np.concatenate([x.values.to_numpy(), y.values.to_numpy()]) if len(y) else x.values.to_numpy()
                u, v = forest(both.view(np.uint64))
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return work.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    marked = common.cut(fingerprints(docs))  # 16 bytes a document; all later steps start from it
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(prints.select("fp"), prints.count(), tile))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = common.cut(common.join_hot(rooted, ids, "root", "members").select("fp", "component_id", "n"))
    return common.join_hot(marked, named, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest doc_id, all columns as they are; rows without doc_id stay."""
    kept = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))
