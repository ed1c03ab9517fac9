"""Helpers shared by the operators: text chunks, hashes, sizes and shards."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions below go to the executors by value; no package has to be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20  # text handled at once inside a task
HASHED_BYTES = 1 << 17  # text whose words are hashed at once
SHARD_BYTES = 32 << 20  # input bytes behind one shard of an index


def by_value(name: str) -> None:
    """Send the functions of module ``name`` to the executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def input_bytes(df: DataFrame) -> int:
    """Size of a plan's input as the optimizer knows it. It only sets how many
    shards there are, never what they hold."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shard_count(df: DataFrame, factor: float = 1.0) -> int:
    """Number of shards that grows with the input."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(1_000_000, int(input_bytes(df) * factor / SHARD_BYTES)))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches, column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, a longer row alone."""
    for batch in batches:
        # Workers live on after a task; what it has freed goes back to the system.
        give_back()
        if not batch.num_rows:
            continue
        text = batch.column(column)
        ends = np.cumsum(np.asarray(_lengths(text), dtype=np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _lengths(text: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows; null counts as empty."""
    import pyarrow.compute as pc

    size = _lengths(text).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    if not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    filled = pc.fill_null(text.cast(pa.large_binary()), b"")
    filled = pa.concat_arrays([filled])
    where = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2], np.uint8)[where[0] : where[-1]]
    return data, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int = 1) -> np.ndarray:
    """An odd 64-bit code for each byte value."""
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word between ASCII white space, and words per row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~SPACES[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = word[begin]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])


def word_groups(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut words into groups of about ``HASHED_BYTES``: first word, end, the bytes from
    the first one on and where each word starts in them. Every byte takes several 64-bit
    numbers while it is hashed, so this bounds the memory of a long text."""
    ends = np.concatenate((starts[1:], [len(data)]))
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), HASHED_BYTES)))
    for a, b in zip(cuts, np.concatenate((cuts[1:], [len(starts)]))):
        if a < b:
            yield a, b, data[starts[a] : ends[b - 1]], starts[a:b] - starts[a]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, with A-Z lower-cased: 64-bit hash of each,
    its first byte, and how many words each row has."""
    starts, per_row = word_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, per_row
    codes = byte_codes()
    codes[SPACES] = 0
    out = np.empty(len(starts), np.uint64)
    for a, b, part, at in word_groups(data, starts):
        sizes = np.diff(np.concatenate((at, [len(part)])))
        place = np.arange(len(part)) - np.repeat(at, sizes)
        with np.errstate(over="ignore"):
            out[a:b] = mix(np.add.reduceat(codes[LOWER[part]] * powers(int(sizes.max()))[place], at))
    return out, starts, per_row


def shingles(word: np.ndarray, per_row: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words of a row and the row it is from; a row
    with fewer words gives all of them as one."""
    n, rows = len(word), len(per_row)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows), per_row)
    ends = np.cumsum(per_row)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        value = word * weights[0]
        for k in range(1, min(width, n)):
            value[:-k] += np.where(np.arange(n - k) + k < ends[row[: n - k]], word[k:], np.uint64(0)) * weights[k]
        left = ends[row] - np.arange(n)
        short = per_row[row] < width
        keep = np.where(short, left == per_row[row], left >= width)
        value += np.where(short, per_row[row].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019), np.uint64(0))
    return mix(value[keep]), row[keep]


def distinct_by_row(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, one after the other, and the row offsets."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(rows + 1))


def crc_mod(column: str, by: int):
    """crc32 of an id as text, modulo ``by``; -1 where the id is null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by)), F.lit(-1).cast("bigint"))
