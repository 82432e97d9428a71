"""Hard negatives: rows of another label that score high against an anchor, but below its positives.

Method: per-anchor full score sort. Anchors go out in broadcast blocks of bounded size; every task scores its rows
against the block as integer inner products and sorts them by score and id for each anchor. A first pass merges the
best rows of an anchor's own label from all tasks, its positives. In the second each positive's upper limit is
found in the sorted scores by binary search, and the first rows of other labels from there that are not below the
lower limit are read; the readings of all tasks merge to the first `k`. What a task hands on is bounded by anchors,
positives and `k`, never by rows, so no anchor's rows gather anywhere, and a frequent label is no key of a shuffle.

Scores are exact whole numbers: beyond those of a double they are added in 64 bits, beyond those as Python
integers; outside of 2^62 either way they count as that limit.

Defined results: rows with a null label, id or vector, or with a component that is null, NaN or infinite (also
times `scale`), take no part. A row is neither positive nor negative of anchors with its own id; rows that repeat
an id are rows of their own, and anchors each. Of vectors of different lengths the shorter counts as ended
by zeros. An anchor without positives, or a positive without negatives, has no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a broadcast block of anchors; rows that are sorted together; scores held at a time.
BLOCK_BYTES = 16 << 20
ROWS = 1 << 15
SCORES = 1 << 21
LIMIT = 1 << 62


def usable(rows: DataFrame, label: Column, scale: int) -> DataFrame:
    """(id, label, x) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    sound = F.forall("x", lambda c: F.coalesce(F.abs(c * scale) < float("inf"), F.lit(False)))  # NaN is above all
    return kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & sound)


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of the components, a row a vector, short ones ended by zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(column.flatten().to_numpy() * scale)
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of `a` with all rows of `b`, matrices of whole numbers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(width, 1)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    return np.array([[max(-LIMIT, min(LIMIT, v)) for v in r] for r in exact], np.int64).reshape(len(a), len(b))


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of up to ROWS rows, by id."""
    held, n = [], 0

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        ids, labels = t["id"].to_numpy(), t["label"].to_numpy()
        order = np.lexsort((labels, ids))
        return ids[order], labels[order], whole_numbers(t["x"].chunk(0), scale)[order]

    for b in batches:
        for at in range(0, len(b), ROWS):
            held.append(b.slice(at, ROWS))
            n += len(held[-1])
            if n >= ROWS:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def _best_first(scores: np.ndarray) -> np.ndarray:
    """Order of each row's scores, falling; equal ones as they stand, which is by id."""
    return np.argsort(-scores, axis=1, kind="stable")


class Anchors:
    """A block of anchors; `place` tells anchors of one id apart."""

    def __init__(self, table: pa.Table, scale: int):
        table = table.combine_chunks()
        self.place, self.ids, self.labels = (table[c].to_numpy() for c in ("place", "id", "label"))
        self.vectors = whole_numbers(table["x"].chunk(0), scale) if len(table) else np.zeros((0, 0))

    def own_label(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, id, score) of the best `k` rows of each anchor's label."""
        for label in np.intersect1d(self.labels, labels):
            mine, theirs = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
            each = max(1, SCORES // len(theirs))
            for at in range(0, len(mine), each):
                some = mine[at : at + each]
                s = inner(self.vectors[some], vectors[theirs])
                order = _best_first(s)
                fit = ids[theirs][order] != self.ids[some, None]
                a, c = np.nonzero(fit & (np.cumsum(fit, axis=1) <= k))
                yield self.place[some[a]], ids[theirs][order[a, c]], s[a, order[a, c]]

    def below(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, positives: list, k: int, low: int, high: int) -> Iterator[tuple]:
        """(place, positive's rank, id, score) of the first `k` rows of other labels between the limits of each positive."""
        each = max(1, SCORES // max(1, len(ids)))
        for at in range(0, len(self.ids), each):
            s = inner(self.vectors[at : at + each], vectors)
            order = _best_first(s)
            for i, ranks in enumerate(order):
                a = at + i
                other = ranks[(labels[ranks] != self.labels[a]) & (ids[ranks] != self.ids[a])]
                falling = -s[i, other]
                for rank, (_, score) in enumerate(positives[a], 1):
                    upper, lower = score * high // 100, -(-score * low // 100)
                    first = int(np.searchsorted(falling, -upper, "left"))
                    for c in other[first : first + k]:
                        if s[i, c] >= lower:
                            yield int(self.place[a]), rank, int(ids[c]), int(s[i, c])


def _first(rows: DataFrame, k: int, *key: str) -> DataFrame:
    """The best k rows of each key, numbered; Spark keeps the best of each task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def _mine_block(rows: DataFrame, table: pa.Table, positives: int, k: int, low: int, high: int, scale: int) -> DataFrame:
    spark = rows.sparkSession
    block = spark.sparkContext.broadcast(table)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(block.value, scale)
        for held in _blocks(batches, scale):
            for place, ids, score in anchors.own_label(*held, positives):
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids), pa.array(score)], ["place", "id", "score"])

    found = _first(rows.mapInArrow(best, "place long, id long, score long"), positives, "place").toArrow()  # no more rows than anchors x positives
    chosen = spark.sparkContext.broadcast(found.sort_by([("place", "ascending"), ("rank", "ascending")]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(block.value, scale)
        of: dict[int, list] = {}
        for place, row, score in zip(*(chosen.value[c].to_pylist() for c in ("place", "id", "score"))):
            of.setdefault(place, []).append((row, score))
        lists = [of.get(p, []) for p in anchors.place.tolist()]
        for held in _blocks(batches, scale):
            got = list(anchors.below(*held, lists, k, low, high))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["place", "positive_rank", "id", "score"])

    negatives = _first(rows.mapInArrow(read, "place long, positive_rank int, id long, score long"), k, "place", "positive_rank")
    owners = dict(zip(table["place"].to_pylist(), table["id"].to_pylist()))
    named = [(p, owners[p], r, i, s) for p, r, i, s in zip(*(found[c].to_pylist() for c in ("place", "rank", "id", "score")))]
    heads = spark.createDataFrame(named, "place long, anchor_id long, positive_rank int, positive_id long, positive_score long")
    return negatives.join(F.broadcast(heads), ["place", "positive_rank"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings (vec_id, embedding, label).

    anchor: which rows are anchors, a condition on `id` and `label`; label: an expression instead of the column.
    Limits are in percent of the positive's score.
    """
    rows = usable(embeddings, F.col("label") if label is None else label, scale)
    asked = common.cut(rows.filter(anchor).withColumn("place", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(8 * F.size("x") + 24)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = F.pmod(F.xxhash64("place"), F.lit(blocks))
    if blocks == 1:
        return _mine_block(rows, asked.toArrow(), positives, k, low, high, scale)
    path = f"{common.shared_folder(rows.sparkSession).rstrip('/')}/negatives-{uuid.uuid4()}"
    for number in range(blocks):
        _mine_block(rows, asked.filter(dealt == number).toArrow(), positives, k, low, high, scale).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)
