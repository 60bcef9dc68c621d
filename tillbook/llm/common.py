"""Shared pieces: vectorised word scanning, scratch tables, size-checked joins.

Text columns reach Python as Arrow buffers.  ``scan_words`` finds the words of
a whole batch with numpy on the UTF-8 bytes, so no Python object is made per
word.  Batches are cut into blocks of about ``BLOCK_BYTES`` of text, so memory
does not grow with the partition (one text is never cut).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19
#: Rows of an Arrow batch that carries texts: keeps a batch to a few MB on both sides of the Python worker.
TEXT_ROWS = 1000
#: Largest table, in bytes, that is broadcast on purpose; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Delimiters of decontamination words: ASCII other than digits and lower-case letters (A-Z is lowered first).
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x80:] = False
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x41:0x5B] = False
NON_ALNUM[0x61:0x7B] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), element by element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_P = U(0xD6E8FEB86659FD93)
_PINV = U(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, p in enumerate((_P, _PINV)):
            steps = np.full(size, p, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a block of texts.

    ``buf`` holds the (lower-cased) bytes, ``starts``/``ends`` byte places in
    it, ``row`` the text of each word and ``first`` the first word of each
    text (one entry more than texts).
    """

    def __init__(self, buf, starts, ends, offsets):
        self.buf, self.starts, self.ends, self.offsets = buf, starts, ends, offsets
        self.first = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self):
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, of its bytes only."""
        p, inv = powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, U)
        np.cumsum(_BYTE[self.buf] * p[:-1], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inv[self.starts]
        return mix(h + (self.ends - self.starts).astype(U))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def scan_words(col: pa.Array, lower: bool = False, delimiter: np.ndarray = SPACE) -> Words:
    buf, offsets = text_buffer(col)
    if lower:
        buf = LOWER[buf]
    inside = ~delimiter[buf]
    left = np.empty(len(buf), bool)
    right = np.empty(len(buf), bool)
    if len(buf):
        left[0] = right[-1] = True
        left[1:] = ~inside[:-1]
        right[:-1] = ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(buf))]
        left[edge] = True
        right[edge - 1] = True
    return Words(buf, np.flatnonzero(inside & left), np.flatnonzero(inside & right) + 1, offsets)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text has a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def unsigned(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(U)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def text_batches(df: DataFrame) -> DataFrame:
    """The frame itself; from here on the session sends texts to Python in batches of at most TEXT_ROWS rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def crc_fold(column, modulus: int):
    """crc32 of a column's text form, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_key():
    """16 bytes that stand for a whole text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder named by ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the counted rows fit the limit; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
