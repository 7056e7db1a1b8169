"""What the operators share: seeded splits, stored intermediates, and word arrays over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import scratch_path

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once in a task; a longer text is handled on its own.
SLICE_BYTES = 4 << 20
#: Multiplier of the rolling word hash (odd, so it has an inverse modulo 2^64).
BASE = 0x9E3779B97F4A7C15


#: Most bytes of an Arrow batch between Spark and Python, unless one row alone has more.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to BATCH_BYTES, so that rows of long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared scratch folder and read back: they survive a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder of the scratch folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """Bytes between the words of WORD."""
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


def symbol_table() -> np.ndarray:
    """All ASCII bytes but letters and digits."""
    return np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the rows' bytes (from offsets[0] on), and each row's first word (one more entry at the end)."""
    b, o = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(o), np.int64)
    space = (space_table() if separators is None else separators)[b]
    edge = np.zeros(n + 1, bool)
    edge[o] = True
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, o)


class WordHash:
    """64-bit hashes of byte spans, by differences of a prefix sum of byte values times powers of BASE."""

    def __init__(self, seed: int = 42, lower: bool = True):
        values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.values = values[lower_table()] if lower else values
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 2**64))):
                row = np.full(n + 1, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))

    def __call__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.values[b] * self.power[: len(b)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (one-to-one)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive entries of `first`; rows without values give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
