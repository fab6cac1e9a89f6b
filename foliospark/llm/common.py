"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder; what was shuffled to make them is let go."""
    out = cut_lineage(df)
    release(df.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("cut-"):
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner drop shuffle files of finished steps now, not at its next periodic run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(*columns: str) -> Column:
    """Names a row by its content. Rows that are equal in these columns share the key, and so share every decision."""
    return F.xxhash64(*columns)


def learned_row(modulus: int, held: int) -> Column:
    """Whether labels of a row may be learned from; the rest is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus != held


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a string or binary column end to end, and where each row starts; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def binary_rows(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The other way round: rows of a binary column from bytes end to end."""
    buffers = [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, buffers)


def expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, the numbers starts[i], starts[i] + 1, ... (counts[i] of them), and the i that each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts), owner


class Fingerprints:
    """Fingerprints of substrings of a byte array, each one subtraction and two products of 64-bit numbers.

    A substring is read as a polynomial in an odd base, modulo 2^64. Odd numbers have an inverse, so a running sum of
    byte times base^-i, taken at both ends and scaled back, gives the value that the substring has anywhere.
    """

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, longest: int):
        self.powers = [(self._powers(base, longest), self._powers(pow(base, -1, 2**64), longest)) for base in self.BASES]

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def sums(self, raw: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[which][1][: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.scramble((sums[end] - sums[start]) * self.powers[which][0][start])

    @staticmethod
    def scramble(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def slices(starts: np.ndarray, limit: int, overlap: int):
    """Cut rows laid end to end into runs (first row, past-last row, from byte, to byte) of about ``limit`` bytes.

    A row longer than that is cut into pieces of its own that share ``overlap`` bytes; no other row is cut.
    """
    row, n = 0, len(starts) - 1
    while row < n:
        if starts[row + 1] - starts[row] > limit:
            at, end = int(starts[row]), int(starts[row + 1])
            while at + overlap < end:
                yield row, row + 1, at, min(at + limit + overlap, end)
                at += limit
            row += 1
            continue
        past = int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1
        past = max(past, row + 1)
        yield row, past, int(starts[row]), int(starts[past])
        row = past


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: within blocks of that width, running minima from both sides."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width + width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def row_groups(starts: np.ndarray, limit: int):
    """Runs of whole rows (first row, past-last row) of at most ``limit`` bytes; a longer row is a run of its own."""
    row, n = 0, len(starts) - 1
    while row < n:
        past = max(int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1, row + 1)
        yield row, past
        row = past


def word_spans(word: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, given which bytes belong to words and where rows begin; no word spans two rows."""
    head, last = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = begins[(begins > 0) & (begins < len(word))]
    head[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(head), np.flatnonzero(last) + 1


def encode_words(raw: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the different words by number; ``word`` says which bytes belong to words."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    buffers = [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw[word].tobytes())]
    coded = pa.Array.from_buffers(pa.large_string(), len(lengths), buffers).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
