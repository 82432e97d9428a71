"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its character n-grams (`GRAMS` code points, A-Z lower-cased, blanks as one kind, a blank
before and after the text), hashed to `SLOTS` places; a feature's value is log2(1 + its count). The ratio of a
place is the log of its smoothed share among toxic texts over that among the others, summed over every labelled
text that may be learned from. Places whose values sum to less than `least` or whose ratio lies within `flat` of 0 tell little
and are left out; with both 0 none but those with a ratio of 0 is. Logistic regression on the values times their ratios gives the weights; both classes weigh alike
in the fit, and the intercept is then moved by half the log of the classes' odds, between equal classes and the
classes as frequent as in the labels.

The regression is fitted on the driver on a sample: `fit_each` texts of each class and `fit_features` features in
all, drawn by a hash of the doc_id with shares that keep to both bounds on average. Everything else is counted and
scored in tasks.

Defined results: null and empty texts have no n-gram that tells anything and score by the intercept; a doc_id with
several labels counts as toxic if any says so; with one class or none labelled, every text scores the share of
toxic labels (0.5 where there is no label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import held_out

BITS = 20
SLOTS = 1 << BITS
GRAMS = (4, 5, 6)
LEAST, FLAT = 3.0, 0.5
#: Small letters for A-Z, a blank for each of \x09-\x0D.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def values(counts: np.ndarray) -> np.ndarray:
    """log2(1 + count) in sixteenths: whole numbers, so that sums do not depend on their order."""
    return np.rint(16 * np.log2(1.0 + counts)).astype(np.int64)


def grams_of(text: bytes) -> np.ndarray:
    """The places of a text's n-grams, with repeats."""
    data = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # bytes that begin a code point
    rolling = common.RollingHash(data)
    found = [rolling.spans(first[:-n], first[n:]) ^ np.uint64(n) for n in GRAMS if len(first) > n]
    return (common.mix(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int32) if found else np.zeros(0, np.int32)


def features(column: pa.Array, used: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, counts) of each text, of the places in `used` only where given."""
    data, off = common.utf8(column)
    for a, b in zip(off[:-1], off[1:]):
        found = grams_of(data[a:b].tobytes())
        places, counts = np.unique(found if used is None else found[used[found]], return_counts=True)
        yield places, counts


def labelled(docs: DataFrame, labels: DataFrame, most_sent: int = 8_000_000) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents.

    Up to `most_sent` labels go to the tasks as sorted numbers, so that no text is shuffled; more are joined.
    """
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if marks.count() > most_sent:
        return docs.join(marks, "doc_id")
    table = marks.toArrow()
    ids = table["doc_id"].to_numpy()
    order = np.argsort(ids)
    sent = docs.sparkSession.sparkContext.broadcast((ids[order], table["toxic"].to_numpy()[order]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, toxic = sent.value
        for b in batches:
            own = b.column("doc_id").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1) if len(known) else np.zeros(0, np.int64)
            here = np.flatnonzero(known[at] == own) if len(known) else at
            kept = b.take(pa.array(here))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(toxic[at[here]])], ["doc_id", "text", "toxic"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(mark, "doc_id long, text string, toxic int")


def class_counts(rows: DataFrame) -> DataFrame:
    """(slot, toxic, clean): the sums of a place's values in the texts of each class; place -1 counts the texts, -2 their features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SLOTS + 2), np.int64)
        for b in batches:
            for (places, counts), toxic in zip(features(b.column("text")), b.column("toxic").to_pylist()):
                k = 0 if toxic >= 1 else 1
                sums[k, places] += values(counts)
                sums[k, SLOTS] += 1
                sums[k, SLOTS + 1] += len(places)
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at >= SLOTS, SLOTS - 1 - at, at).astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])], ["slot", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(count, "slot int, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def sample_features(rows: DataFrame, shares: tuple[float, float], used: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and classes of the texts drawn, with these shares of toxic and clean ones."""
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(used))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(sent.value, count=SLOTS).astype(bool)
        for b in batches:
            found = [(places.tobytes(), counts.astype(np.int32).tobytes()) for places, counts in features(b.column("text"), mask)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array([x[i] for x in found], pa.binary()) for i in (0, 1))], ["toxic", "slots", "counts"])

    share = F.when(F.col("toxic") >= 1, F.lit(shares[0])).otherwise(F.lit(shares[1]))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < share * (1 << 20)).select("text", "toxic")
    got = drawn.mapInArrow(pick, "toxic int, slots binary, counts binary").toArrow()
    rows = sorted(zip(got["slots"].to_pylist(), got["counts"].to_pylist(), got["toxic"].to_pylist()))  # the fit does not depend on the order of tasks
    return [(np.frombuffer(x, np.int32), np.frombuffer(n, np.int32)) for x, n, _ in rows], np.array([y >= 1 for *_, y in rows], np.float64)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, ratio: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights by place (ratio included) and intercept: accelerated gradient descent on the logistic loss, both classes alike."""
    row = np.repeat(np.arange(len(texts)), [len(f) for f, _ in texts])
    place, column = np.unique(np.concatenate([f for f, _ in texts]), return_inverse=True)
    x = values(np.concatenate([n for _, n in texts])) * ratio[place][column]
    x /= np.maximum(np.sqrt(np.bincount(row, weights=x * x, minlength=len(texts))), 1e-9)[row]  # rows of unit length
    weight, bias = np.zeros(len(place)), 0.0
    ahead, bias_ahead, t = weight, bias, 1.0
    step = 4.0 / 2  # the intercept adds one to a row's length
    balance = np.where(toxic == 1, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(row, weights=x * ahead[column], minlength=len(texts)) + bias_ahead
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * balance
        gradient = np.bincount(column, weights=error[row] * x, minlength=len(place))
        new, new_bias = ahead - step * (gradient + ridge / len(toxic) * ahead), bias_ahead - step * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / t_new * (new - weight), new_bias + (t - 1) / t_new * (new_bias - bias)
        weight, bias, t = new, new_bias, t_new
    out = np.zeros(SLOTS)
    out[place] = weight * ratio[place]
    return out, float(bias)


class Model:
    """Weights of places, their squared ratios, and the intercept; without weights every text scores by the intercept."""

    def __init__(self, weight: np.ndarray | None, ratio: np.ndarray | None, bias: float):
        self.used = None if ratio is None else np.flatnonzero(ratio).astype(np.int32)
        self.weight, self.square = (None, None) if ratio is None else (weight[self.used], ratio[self.used] ** 2)
        self.bias = bias

    def scorer(self):
        """A function from a column of texts to scores; the whole tables are laid out once."""
        if self.used is None:
            return lambda column: np.full(len(column), 1 / (1 + np.exp(-self.bias)))
        mask, weight, square = np.zeros(SLOTS, bool), np.zeros(SLOTS), np.zeros(SLOTS)
        mask[self.used], weight[self.used], square[self.used] = True, self.weight, self.square

        def scores(column: pa.Array) -> np.ndarray:
            z = [self.bias + (weight[f] * (v := values(n))).sum() / np.sqrt(max((square[f] * v * v).sum(), 1e-9)) for f, n in features(column, mask)]
            return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))

        return scores


def train(docs: DataFrame, labels: DataFrame, fit_each: int = 1500, fit_features: int = 8_000_000, least: float = LEAST, flat: float = FLAT) -> Model:
    rows = labelled(docs, labels)
    counts = class_counts(rows).toArrow().to_pandas()  # at most SLOTS + 2 rows
    totals = counts[counts["slot"] == -1]
    n_toxic, n_clean = (int(totals[c].sum()) for c in ("toxic", "clean"))
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Model(None, None, float(np.log(share / (1 - share))))
    wide = counts[counts["slot"] == -2]
    wide = [int(wide[c].sum()) for c in ("toxic", "clean")]
    counts = counts[counts["slot"] >= 0]
    p, q = np.zeros(SLOTS), np.zeros(SLOTS)
    p[counts["slot"]] = counts["toxic"] / 16
    q[counts["slot"]] = counts["clean"] / 16
    ratio = np.log(((p + 1) / (n_toxic + 2)) / ((q + 1) / (n_clean + 2)))
    ratio[(p + q == 0) | (p + q < least) | (np.abs(ratio) < flat)] = 0  # a place never met tells nothing
    shares = tuple(min(1.0, fit_each / n, fit_features / 2 / max(w, 1)) for n, w in zip((n_toxic, n_clean), wide))
    texts, toxic = sample_features(rows, shares, ratio != 0)
    if not ratio.any() or not len(texts):
        return Model(None, None, float(np.log(n_toxic / n_clean)))
    weight, bias = fit(texts, toxic, ratio)
    return Model(weight, ratio, bias + float(np.log(n_toxic / n_clean)) / 2)


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from labelled documents that are not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out(5, 0)), labels.filter(~held_out(5, 0)), **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for b in batches:
            scores = scorer(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(5, 0).alias("held_out"), F.col("text").cast("string")).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
