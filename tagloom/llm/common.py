"""Shared pieces of the corpus operators: sizing, packed exchange, text as arrays.

The operators that hash every token window keep whole Arrow batches as NumPy
arrays: a batch of texts is one byte buffer, words are found and hashed with
vector operations, and what crosses the network is a packed, sorted and
compressed array for each (batch, bucket) in place of a row for each window.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import cut
from tagloom.session import forget as forget

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NULL_ID = np.iinfo(np.int64).max  #: a null id sorts after every other id


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, read only through Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(df: DataFrame) -> DataFrame:
    """Lets Python workers of a local session import this package, whatever the working folder is.

    Rows here are whole documents, so Arrow batches get fewer rows than usual: it
    is a batch that an executor and its worker each hold in memory.
    """
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    conf = df.sparkSession.conf
    if conf.get(_BATCH_ROWS, "10000") == "10000":  # the default is made for short rows; a caller's own setting stays
        conf.set(_BATCH_ROWS, "1000")
    return df


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of what a plan reads (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target_mb: float = 10.0) -> int:
    """Partitions for an exchange over all of ``df``: in proportion to its size, at least the session's setting."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    # plans over derived columns have no useful estimate (Spark then multiplies sizes without end)
    wanted = math.ceil(size / (target_mb * 1e6)) if size < 1e16 else 0
    return max(conf, min(wanted, 200_000))


#: cuts the lineage by a reliable checkpoint in the folder that all executors share; ``forget`` removes one that no plan needs any more
checkpoint = cut

def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def spread_join(left: DataFrame, right: DataFrame, key: str, salt: str, shares: int = 1000) -> DataFrame:
    """``left`` left-joined with ``right`` (one row a key) where a key may hold any part of left's rows.

    A key with more than one ``shares``-th of the rows (so there are fewer than
    ``shares`` such keys: a proven bound for the broadcast) is dealt by a hash of
    ``salt`` over several tasks, and right's row for it is repeated for each.
    """
    total = left.count()
    counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") * shares > total)
    hot = checkpoint(counts.select("_key", F.ceil(F.col("_n") * shares / F.lit(max(total, 1))).cast("int").alias("_shares")))
    if hot.isEmpty():
        return left.join(right, key, "left")
    n = F.coalesce("_shares", F.lit(1))
    one = left.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_salt", F.pmod(F.xxhash64(salt), n).cast("int")).drop("_key", "_shares")
    two = right.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_key", "_shares")
    return one.join(two, [key, "_salt"], "left").drop("_salt")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a worker yields; at its end the memory that allocators hold on to goes back, as workers outlive their tasks."""
    yield from batches
    release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_crc(column: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight lie together, so sorted numbers compress well."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T) if len(a) else a.view(np.uint8)
        head = f"{a.dtype.str}:{len(a)};".encode()
        parts.append(len(head).to_bytes(2, "little") + head + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    """Inverse of :func:`pack`."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 2], "little")
        kind, _, count = raw[at + 2 : at + 2 + n - 1].decode().partition(":")
        at, dtype, count = at + 2 + n, np.dtype(kind), int(count)
        size = dtype.itemsize * count
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, count)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1) if count else np.zeros(0, dtype))
        at += size
    return out


# ---------------------------------------------------------------- text as arrays

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTERS = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C13), np.uint64(0xC2B2AE3D27D4EB4B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).fill_null(NULL_ID).to_numpy()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word ``[^\\x20\\x09-\\x0D]+`` of each text starts and ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and the first word of each text (one more entry than texts)."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends, chunk), np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # words of about ``chunk`` bytes at a time, as the prefix sums take 8 bytes a byte
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + chunk, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LETTERS[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
        at = to
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` words, whatever the text they lie in."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= _STEP
        total += words[k : k + n]
    return mix(total)


def window_index(firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the word sequence at which a window lies inside one text, and the text of each."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + firsts[:-1][text]
    return at, text


def record_batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
