"""Best-fit packing of tokenised documents, by hierarchical residual packing.

One pass tokenises a partition and packs its pieces best-fit, largest first.
Bins that are nearly full are done.  The underfull ones go up a tree: at each
level the bins of ``fan_in`` neighbours meet, are packed best-fit as items, and
again all underfull ones rise.  What moves between tasks is (bin, fill) of
underfull bins, never texts or ids.  A node of the tree holds ``node_bins`` bins
at most: once all groups are that large the tree ends, so no task ever gathers
the bins of the whole corpus (and among so many bins best fit finds a partner as
well as among all).

Words repeat far more often than they are new, so a batch is split at ASCII
white space (where this tokenizer always splits), and each distinct word is
encoded once.

Nulls and odd rows: a null or empty text is the single id 0; repeated rows are
packed as separate documents; a null id stays null.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C

LENGTH = 2048
_BATCH = 4_000_000  #: characters that are tokenised at a time; no text is cut
_CACHE = 2_000_000  #: words whose ids a worker remembers, about 40 bytes each
_STATE: dict = {}


class Words:
    """Ids of words, encoded once each: sorted word hashes, and for each its ids' place in one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.starts, self.lengths, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, word) -> np.ndarray:
        """Indices of (sorted, distinct) words; ``word(k)`` is the text of the k-th, asked for only if it is new."""
        if len(self.keys) > _CACHE:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        ids: list[list[int]] = []
        for lo in range(0, len(new), 10_000):
            ids += [e.ids for e in self.tokenizer.encode_batch([word(k) for k in new[lo : lo + 10_000].tolist()], add_special_tokens=False)]
        if len(new):
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
            starts = len(self.flat) + np.cumsum(lengths, dtype=np.int64) - lengths
            where = np.searchsorted(self.keys, keys[new])
            self.flat = np.concatenate([self.flat, flat])
            self.keys, self.starts, self.lengths = (np.insert(x, where, y) for x, y in ((self.keys, keys[new]), (self.starts, starts), (self.lengths, lengths)))
            at = np.searchsorted(self.keys, keys)
        return at


def words_of(path: str) -> Words:
    """A worker's words; it keeps them from task to task."""
    if path not in _STATE:
        _STATE[path] = Words(path)
    return _STATE[path]


def encode_texts(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts (each text followed by id 0), and where each text starts (one more entry)."""
    data, offsets = C.string_buffers(texts)
    begins, ends = C.word_spans(data, offsets)
    if b"<|" not in data.tobytes():  # special tokens are the only strings whose case counts
        data = C.LOWER[data]
    # a comma or full stop behind an ASCII letter is encoded by itself anyhow
    last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
    k = np.flatnonzero((ends - begins > 1) & ((last == 44) | (last == 46)) & (before >= 97) & (before <= 122))
    stops = ends[k]
    ends[k] -= 1
    begins, ends = np.insert(begins, k + 1, stops - 1), np.insert(ends, k + 1, stops)
    keys, first, index = np.unique(C.span_hashes(data, begins, ends), return_index=True, return_inverse=True)
    raw, lo, hi = data.tobytes(), begins[first], ends[first]
    index = words.find(keys, lambda k: raw[lo[k] : hi[k]].decode())[index]
    # id 0 after each text: an item of one id behind each text's words
    at = np.searchsorted(begins, offsets[1:], "left")
    lengths, starts = np.insert(words.lengths[index].astype(np.int64), at, 1), np.insert(words.starts[index], at, len(words.flat))
    flat = np.append(words.flat, np.uint32(0)).astype("<u4")
    done = np.cumsum(lengths)
    where = np.arange(int(done[-1]) if len(done) else 0) - np.repeat(done - lengths - starts, lengths)
    bounds = np.concatenate([[0], done[at + np.arange(len(at))]]) if len(at) else np.zeros(1, np.int64)
    return flat[where], bounds


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill; items are taken from the largest down."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = mask >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask ^= 1 << left
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += size
        left -= size
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bin_of, offset, np.array(fills, np.int64)


def _local(path: str, length: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, words = TaskContext.get().partitionId(), [], words_of(path)
        for b in batches:
            data = b.column(1).fill_null("").cast(pa.large_string())
            size, lo = np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False)), 0
            while lo < len(data):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _BATCH, "right")))
                ids, bounds = encode_texts(words, data.slice(lo, hi - lo))
                n = np.diff(bounds)
                pieces = -(-n // length)
                doc = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                long = np.minimum(length, n[doc] - start)
                raw, at = memoryview(ids.tobytes()), (bounds[:-1][doc] + start) * 4
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + long * 4).tolist(), strict=True)]
                kept.append((b.column(0).slice(lo, hi - lo).take(pa.array(doc)), piece, start, long, np.array(crc, np.int64)))
                lo = hi
        C.release()
        if not kept:
            return
        ids = pa.concat_arrays([k[0] for k in kept])
        piece, start, long, crc = (np.concatenate([k[i] for k in kept]) for i in range(1, 5))
        bins, offset, fills = best_fit(long, length)
        arrays = [ids, pa.array(piece.astype(np.int32)), *(pa.array(x) for x in (start, long, crc, (np.int64(part) << 32) + bins, offset, fills[bins])), pa.array(np.full(len(bins), part, np.int32))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "part"]
        for lo in range(0, len(bins), 10_000):
            yield pa.RecordBatch.from_arrays([a.slice(lo, 10_000) for a in arrays], names)

    return pack


def _merge(length: int):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bins, fill = table["bin"].to_numpy(), table["fill"].to_numpy()
        order = np.lexsort((bins, -fill))
        bins, fill = bins[order], fill[order]
        into, offset, fills = best_fit(fill, length)
        # a merged bin bears the name of its first item
        first = np.zeros(len(fills), np.int64)
        first[into[::-1]] = bins[::-1]
        return pa.table({"bin": bins, "into": first[into], "shift": offset, "fill": fills[into], "part": pa.array([key[0].as_py()] * len(bins), pa.int32())})

    return merge


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, nearly_full: float = 0.99, fan_in: int = 8, node_bins: int = 200_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece. ``tokenizer`` is a file that all executors have."""
    C.importable(docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = C.checkpoint(source.mapInArrow(_local(tokenizer, length), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, part int"))
    enough = int(nearly_full * length)
    open_bins = pieces.where(F.col("fill") < enough).select("bin", "fill", "part").distinct()
    parts = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    moved = None  # where each bin of the first level has gone
    while (fewer := max(-(-parts // fan_in), -(-open_bins.count() // node_bins))) < parts:
        group = F.floor(F.col("part") * F.lit(fewer) / F.lit(parts)).cast("int")
        parts = fewer
        merged = open_bins.withColumn("part", group).repartition(min(parts, C.partitions_for(docs)), "part")
        merged = C.checkpoint(merged.groupBy("part").applyInArrow(_merge(length), "bin long, into long, shift long, fill long, part int"))
        step = merged.select(F.col("bin").alias("at"), "into", "shift")
        if moved is None:
            moved = step.select(F.col("at").alias("bin"), "into", "shift")
        else:
            moved = moved.join(step.withColumnRenamed("into", "next").withColumnRenamed("shift", "more"), F.col("into") == F.col("at"), "left")
            moved = moved.select("bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        open_bins = merged.where(F.col("fill") < enough).select(F.col("into").alias("bin"), "fill", "part").distinct()
    if moved is None:
        out = pieces.withColumnRenamed("bin", "sequence_id")
    else:
        out = pieces.join(moved, "bin", "left").withColumns({"sequence_id": F.coalesce("into", "bin"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLES: dict[str, str] = {}
