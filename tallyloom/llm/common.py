"""Helpers shared by the training-data operators.

Every operator reads only the columns it names, so extra columns of any name are ignored unless a
stage passes whole rows through. Null texts count as empty texts throughout.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised code handles at a time; bounds its temporary arrays.
CHUNK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where unset, a local session (tests) takes one of its own, and a cluster, whose machines share no local folder, is an error."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns, these or, where the frame has them in large or small letters, longer ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a table of hashes: 16 for each, within these powers of two (64 MB at most).
LEAST_BITS, MOST_BITS = 20, 29


def bit_table(hashes: DataFrame, column: str, n: int) -> np.ndarray:
    """A table in which the first bits of each of the `n` hashes (a long column) are set; `passes` asks it.

    Beyond its largest size it passes more and more hashes that are not among the `n`, and still all that are.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    slot = F.shiftrightunsigned(column, 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 63 as int))")
    words = hashes.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # no more rows than the table has words
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) have their bit set."""
    slot = hashes >> np.uint64(64 - (len(table) * 64).bit_length() + 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """left joined with right, which has one row a key and in column `n` how many rows of left have it.

    Keys of more than a thousandth of left's rows, a thousand at most, are broadcast, so none gathers in a task.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(right.filter(F.col(n) * 1000 > total).limit(1000))
    cold = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(n) * 1000 <= total), key)
    return cold.unionByName(left.join(hot, key))


def partitions(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Partitions of about `each` bytes, no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and len + 1 offsets into them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: first row, end row, bytes, offsets."""
    data, off = utf8(column)
    first = 0
    while first < len(off) - 1:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser's fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("_powers", _ODD), ("_inverses", pow(_ODD, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverses


class RollingHash:
    """64-bit polynomial hashes of any stretch of an array of symbols, equal for equal stretches."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _power_tables(len(symbols))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        spread = mix(symbols + np.uint64(1)) if symbols.dtype == np.uint64 else _BYTE_SYMBOLS[symbols]
        np.cumsum(spread * power[: len(symbols)], out=self.sums[1:])

    def grams(self, length: int) -> np.ndarray:
        """Of all stretches of `length` symbols."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        found = self.sums[length:] - self.sums[:n]
        found *= self.inverse[:n]
        found ^= found >> np.uint64(32)
        found *= np.uint64(0x9FB21C651E98DF25)
        found ^= found >> np.uint64(32)
        return found

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


_BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, and the number of words before each text.

    is_word: 256 booleans, whether a byte belongs to a word; words do not cross texts.
    """
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = is_word[data]
    before = np.zeros(len(data) + 1, np.int8)
    before[1:] = inside[:-1]
    cuts = off[(off > 0) & (off < len(data))]
    step = inside - before
    starts = step == 1
    ends = step == -1
    joined = cuts[(inside[cuts] == 1) & (before[cuts] == 1)]
    starts[joined] = True
    ends[joined] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, off)


def byte_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words [^\x20\x09-\x0D]+
BLANK_WORDS = byte_table(b" \t\n\x0b\x0c\r")
