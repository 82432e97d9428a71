"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone. A trigram's vector binds its
letters: the product of their vectors, each permuted (rotated) by its place. A text is the bundle, the sum,
of its trigrams' vectors; a language's prototype is the bundle of its training texts. A text gets the
language whose prototype has the largest cosine with its bundle.

Bundles are sums of whole numbers, so prototypes do not depend on the order or number of tasks. Training
sends a vector a language from each task to a grouped sum; the prototypes, a few KB a language, are
broadcast, `LANGUAGES_SENT` at a time: each such block passes over the texts and keeps the better of its best
language and the one found before.

The pipeline's stage rejects texts without letters, and texts whose cosine with their language's prototype lies far
below what training texts of that language and length have: `DEVIATIONS` standard deviations below their mean.

Defined results: `und` with score 0 for a null text, one without letters, or where nothing was learned;
ties go to the first language by code point; training rows with a null lang or text teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1024
LANGUAGES_SENT = 4096
#: Of the stage: how far below the mean, the least spread taken, and the texts that a class needs to be judged by.
DEVIATIONS, LEAST_SPREAD, LEAST_TEXTS = 6.0, 0.02, 30
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its small letter's code point, 32 for all that are no letters."""
    if not _letters:
        _letters.append(np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000))
    return _letters[0]


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = common.mix(common.mix(points.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(1, dimensions // 64 + 1, dtype=np.uint64)[None, :])
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1)[:, :dimensions]


class Bundler:
    """Trigram vectors, kept as they are met, up to a bound."""

    def __init__(self, dimensions: int = DIMENSIONS, kept: int = 20_000):
        self.dimensions, self.kept = dimensions, kept
        self.codes, self.vectors = np.zeros(0, np.int64), np.zeros((0, dimensions), np.int8)

    def _trigram_vectors(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        new = codes[(at == len(self.codes)) | (np.append(self.codes, -1)[at] != codes)]
        if len(new):
            if len(self.codes) + len(new) > self.kept:
                self.codes, self.vectors, new = np.zeros(0, np.int64), np.zeros((0, self.dimensions), np.int8), codes
            bound = np.ones((len(new), self.dimensions), np.int8)
            for place in range(3):
                points, which = np.unique((new >> (21 * (2 - place))) & 0x1FFFFF, return_inverse=True)
                bound *= np.roll(letter_vectors(points, self.dimensions), 2 - place, axis=1)[which]
            every = np.concatenate([self.codes, new])
            order = np.argsort(every)
            self.codes, self.vectors = every[order], np.concatenate([self.vectors, bound])[order]
            at = np.searchsorted(self.codes, codes)
        return self.vectors[at]

    def bundles(self, texts: list[str], groups: np.ndarray | None = None, n_groups: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The bundle of each text, or of each group of texts; and whether each text has a letter."""
        rows = n_groups if groups is not None else len(texts)
        if not texts:
            return np.zeros((rows, self.dimensions)), np.zeros(0, bool)
        points = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), np.array([len(t) + 2 for t in texts]))
        letters = letter_table()[points]
        known = np.bincount(owner[letters != 32], minlength=len(texts)) > 0
        blank = letters == 32
        repeat = np.zeros(len(letters), bool)
        repeat[1:] = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
        letters, owner = letters[~repeat].astype(np.int64), owner[~repeat]
        whole = owner[2:] == owner[:-2]
        row = owner[2:][whole] if groups is None else groups[owner[2:][whole]]
        # letters are numbered within the batch, so that small alphabets need no sort
        alphabet, small = _number(letters)
        code = ((small[:-2] * len(alphabet) + small[1:-1]) * len(alphabet) + small[2:])[whole]
        trigrams, column = _number(code, len(alphabet) ** 3)
        k = len(alphabet)
        full = (alphabet[trigrams // (k * k)] << 42) | (alphabet[trigrams // k % k] << 21) | alphabet[trigrams % k]
        order = np.argsort(full)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # entries by trigram, then parts of the trigrams, so that counts and vectors held are bounded
        place = place[column]
        by_place = np.argsort(place.astype(np.uint16) if len(full) < 1 << 16 else place, kind="stable")
        place, row = place[by_place], row[by_place]
        out = np.zeros((rows, self.dimensions))
        width = max(64, min(4096, (1 << 21) // max(rows, 1)))
        for i in range(0, len(full), width):
            part = slice(*np.searchsorted(place, [i, i + width]))
            vectors = self._trigram_vectors(full[order[i : i + width]]).astype(np.float32)
            counts = np.bincount(row[part] * len(vectors) + place[part] - i, minlength=rows * len(vectors)).reshape(rows, len(vectors))
            out += counts.astype(np.float32) @ vectors
        return out, known


def _number(values: np.ndarray, below: int = 0x110000) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    if below > 1 << 23:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(below, bool)
    seen[values] = True
    place = np.cumsum(seen) - 1
    return np.flatnonzero(seen), place[values]


def text_groups(texts: list[str], limit: int = common.CHUNK_BYTES, most: int = 512) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t) > limit or i - first >= most):
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def train(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, vector): prototypes, from the text and lang of `docs`."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        bundler = Bundler(dimensions)
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for first, end in text_groups(texts):
                names = sorted(set(langs[first:end]))
                groups = np.array([names.index(x) for x in langs[first:end]])
                bundles, _ = bundler.bundles(texts[first:end], groups, len(names))
                for name, v in zip(names, bundles):
                    sums[name] = sums.get(name, 0) + v
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(np.rint(v).astype(np.int64))], ["lang", "place", "v"])

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string")).mapInArrow(bundle, "lang string, place int, v long")
    sums = rows.groupBy("lang", "place").agg(F.sum("v").alias("v"))
    return common.cut(sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("vector")))


def models(prototypes: DataFrame, sent: int = LANGUAGES_SENT) -> Iterator[Model]:
    """Prototypes in order of their language, `sent` at a time; one model without any where there is none."""
    held: dict[str, np.ndarray] = {}
    any_yet = False
    for r in prototypes.orderBy("lang").toLocalIterator():
        held[r["lang"]] = np.array(r["vector"], np.float64)
        if len(held) >= sent:
            yield Model(held)
            held, any_yet = {}, True
    if held or not any_yet:
        yield Model(held)


class Model:
    """Prototypes of unit length, and the prediction from them."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        usable = {k: v for k, v in sorted(prototypes.items()) if np.any(v)}
        self.names = list(usable)
        self.matrix = np.array([v / np.linalg.norm(v) for v in usable.values()]) if usable else None

    def predict(self, texts: list[str | None], bundler: Bundler) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        texts = [t or "" for t in texts]
        for first, end in text_groups(texts):
            bundles, known = bundler.bundles(texts[first:end])
            if self.matrix is None:
                names += [UNKNOWN] * (end - first)
                scores.append(np.zeros(end - first))
                continue
            norms = np.linalg.norm(bundles, axis=1)
            cosine = np.round(bundles @ self.matrix.T / np.maximum(norms, 1e-9)[:, None], 12)  # the last digits hang on how many are multiplied at once
            best = cosine.argmax(axis=1)
            score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            names += [self.names[i] if k else UNKNOWN for i, k in zip(best, known)]
            scores.append(score)
        return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out(mod: int, rest: int):
    """Whether crc32 of the doc_id as text leaves `rest`; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def predicted(docs: DataFrame, prototypes: DataFrame, sent: int = LANGUAGES_SENT) -> tuple[DataFrame, list[str]]:
    """The documents with two more columns, and their names: the language and its score."""
    names = common.free(docs, "__lang", "__score")
    state = docs.select("*", F.lit(None).cast("string").alias(names[0]), F.lit(0.0).alias(names[1]))
    every = models(prototypes, sent)
    model, following = next(every), next(every, None)
    while model is not None:
        state = _better(state, names, model)
        if following is not None:
            state = common.cut(state)  # written before the next block is sent
        model, following = following, next(every, None) if following is not None else None
    return state, names


def _better(state: DataFrame, names: list[str], model: Model) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler()
        for b in batches:
            langs, scores = sent.value.predict(b.column("text").to_pylist(), bundler)
            old = zip(b.column(names[0]).to_pylist(), b.column(names[1]).to_pylist())
            best = [(y, t) if x is None or (y != UNKNOWN and (x == UNKNOWN or t > s)) else (x, s) for (x, s), y, t in zip(old, langs, scores.tolist())]
            columns = {c: b.column(c) for c in b.schema.names} | {names[0]: pa.array([x for x, _ in best], pa.string()), names[1]: pa.array([s for _, s in best], pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return state.mapInArrow(predict, state.schema)


def language_report(docs: DataFrame, sent: int = LANGUAGES_SENT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from the documents that are not held out."""
    own = docs.select("doc_id", held_out(4, 2).alias("held_out"), F.col("text").cast("string"))
    state, names = predicted(own, train(docs.filter(~held_out(4, 2))), sent)
    return state.select("doc_id", "held_out", F.col(names[0]).alias("lang_pred"), F.col(names[1]).alias("score"))


def n_letters(text: Column) -> Column:
    """Code points that are letters."""
    return F.length(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\p{L}]+", ""))


def length_class(letters: Column) -> Column:
    """Texts of like length: a class for each doubling."""
    return F.floor(F.log2(F.greatest(letters, F.lit(1)).cast("double"))).cast("int")


def usual_scores(docs: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(lang, class, low): the least score a text of that language and length may have; null lang for all languages together."""
    state, (lang, score) = predicted(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("own")), prototypes)
    rows = state.filter(F.col(lang) == F.col("own")).select(F.col(lang).alias("lang"), length_class(n_letters(F.col("text"))).alias("class"), F.col(score).alias("score"))
    sums = common.cut(rows.groupBy("lang", "class").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss")))
    every = sums.groupBy("class").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).select(F.lit(None).cast("string").alias("lang"), "class", "n", "s", "ss")
    mean = F.col("s") / F.col("n")
    spread = F.greatest(F.lit(LEAST_SPREAD), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)))
    return sums.unionByName(every).filter(F.col("n") >= LEAST_TEXTS).select("lang", "class", (mean - DEVIATIONS * spread).alias("low"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, all columns as they are.

    Where a language has too few training texts of a length, all languages' texts of that length judge; where
    there are too few of those, too, only texts without letters go.
    """
    learned = docs.filter(~held_out(4, 2))
    prototypes = train(learned)
    low = common.cut(usual_scores(learned, prototypes))  # some 30 rows a language
    state, (lang, score) = predicted(docs, prototypes)
    letters, size, own, own_size, own_low, all_size, all_low = common.free(state, "__letters", "__class", "__of", "__of_class", "__low", "__all_class", "__all_low")
    state = state.withColumn(letters, n_letters(F.col("text"))).withColumn(size, length_class(F.col(letters)))
    mine = low.filter("lang IS NOT NULL").select(F.col("lang").alias(own), F.col("class").alias(own_size), F.col("low").alias(own_low))
    every = low.filter("lang IS NULL").select(F.col("class").alias(all_size), F.col("low").alias(all_low))
    mine = F.broadcast(mine) if mine.count() <= 1_000_000 else mine
    judged = state.join(mine, (F.col(lang) == F.col(own)) & (F.col(size) == F.col(own_size)), "left").join(F.broadcast(every), F.col(size) == F.col(all_size), "left")
    nothing_learned = prototypes.isEmpty()
    known = F.lit(True) if nothing_learned else F.col(lang) != UNKNOWN
    return judged.filter((F.col(letters) > 0) & known & (F.coalesce(own_low, all_low, F.lit(-1.0)) <= F.col(score))).select(*docs.columns)
