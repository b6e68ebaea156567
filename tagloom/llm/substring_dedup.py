"""Substring dedup: Rabin-Karp hashes of every fixed-length token window.

Every window of ``width`` consecutive words gets a rolling 64-bit hash.  Texts
are dealt once by a hash of their id; each such batch sends, for each bucket of
the hash space, its distinct window hashes with the smallest document id that
holds them (a packed array, not a row for each window).  A bucket finds the
smallest document of each hash over all batches and answers with one bit for
each hash that it got.  Batches meet their answers again by cogrouping, merge
covered windows into maximal removal intervals and drop those words.

A passage in a third of all documents costs one entry a batch, never a group.
Two different windows get one hash with a chance of 2**-64 a pair.

Nulls and odd rows: a null text has no words; texts shorter than a window lose
nothing; rows that repeat a doc_id are the same document for ordering, so they
never remove each other's words; a null id counts as larger than every other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C

WIDTH = 13
_SENT = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("payload", pa.binary())])
_ANSWER = pa.schema([("b", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:int,end:int>>, kept string"


class _Windows:
    """The windows of one batch of documents."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        table = table.combine_chunks()
        self.ids = C.ids_of(table["doc_id"])
        self.data, self.offsets = C.string_buffers(table["text"])
        words, self.firsts = C.word_hashes(self.data, self.offsets)
        self.at, text = C.window_index(self.firsts, width)
        hashes = C.window_hashes(words, width)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        del words
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.unique = ranked[new]
        group = np.cumsum(new) - 1
        self.group = np.empty(len(group), np.int64)  # of each window: its index among the distinct hashes
        self.group[order] = group
        owner = self.ids[text]
        self.least = np.full(len(self.unique), C.NULL_ID, np.int64)
        if len(order):
            self.least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
        self.later = owner > self.least[self.group]  # another document of this batch comes first
        self.cuts = np.searchsorted(self.unique, (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)) if buckets > 1 else np.zeros(0, np.int64)
        self.cuts = np.concatenate([[0], self.cuts, [len(self.unique)]])


def _send(width: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        w, rows = _Windows(table, width, buckets), []
        for k in range(buckets):
            lo, hi = int(w.cuts[k]), int(w.cuts[k + 1])
            if hi > lo:
                known, index = np.unique(w.least[lo:hi], return_inverse=True)
                rows.append((k, key[0].as_py(), C.pack(w.unique[lo:hi], known, index.astype(np.uint16 if len(known) <= 65536 else np.uint32))))
        return pa.Table.from_batches(list(C.record_batches(rows, _SENT)), _SENT)

    return send


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for x in batches for r in zip(*(x.column(k).to_pylist() for k in range(3)), strict=True)]
    if not rows:
        return
    parts = []
    for i, (_, _, payload) in enumerate(rows):
        h, known, index = C.unpack(payload)
        parts.append((h, known[index], len(h)))
        rows[i] = rows[i][:2]
    sizes = np.array([p[2] for p in parts])
    h, least = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    ranked = h[order]
    new[1:] = ranked[1:] != ranked[:-1]
    del h, ranked
    starts = np.flatnonzero(new)
    best = np.minimum.reduceat(least[order], starts)
    flag = np.empty(len(order), bool)
    flag[order] = least[order] > np.repeat(best, np.diff(np.append(starts, len(order))))
    ends = np.cumsum(sizes)
    out = [(b, k, np.packbits(flag[e - n : e]).tobytes()) for (k, b), n, e in zip(rows, sizes, ends, strict=True) if flag[e - n : e].any()]
    yield from C.record_batches(out, _ANSWER)


def _finish(width: int, buckets: int, with_text: bool):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        w = _Windows(left, width, buckets)
        flag = np.zeros(len(w.unique), bool)
        for k, bits in zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True):
            lo, hi = int(w.cuts[k]), int(w.cuts[k + 1])
            flag[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        hit = w.at[w.later | flag[w.group]]
        depth = np.zeros(int(w.firsts[-1]) + 1, np.int64)
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + width, -1)
        gone = np.cumsum(depth[:-1]) > 0
        out, data, null = [], w.data.tobytes(), left["doc_id"].combine_chunks().is_null().to_pylist()
        for i, doc in enumerate(w.ids.tolist()):
            lo, hi = int(w.firsts[i]), int(w.firsts[i + 1])
            words, spans = data[w.offsets[i] : w.offsets[i + 1]].split(), []
            dropped = int(gone[lo:hi].sum())
            if dropped:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[lo:hi].astype(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)]
                words = list(compress(words, (~gone[lo:hi]).tolist()))
            kept = b" ".join(words)
            out.append((None if null[i] else doc, hi - lo, dropped, hashlib.sha256(kept).hexdigest(), spans, kept.decode() if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals", "kept"]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names)

    return finish


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True, partition_mb: float = 10.0) -> DataFrame:
    """One row per document: words, removed words, the removal intervals (in words) and the kept text.

    A word goes if a window of ``width`` words that covers it also starts in a
    document with a smaller id.
    """
    C.importable(docs)
    n = C.partitions_for(docs, partition_mb)
    batches = 3 * n  # several to a partition, so that partitions even out
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).repartition(n, "b")
    sent = keyed.groupBy("b").applyInArrow(_send(width, n), "bucket int, b int, payload binary").repartition(n, "bucket")
    answers = sent.mapInArrow(lambda b: C.released(_answer(b)), "b int, bucket int, bits binary").repartition(n, "b")
    return keyed.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(_finish(width, n, with_text), _RESULT)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(C.read(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("intervals").alias("n_intervals"))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM hit),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (pos - 1 <> coalesce(p, -1)) AS k
         FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM gone) GROUP BY doc_id),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.pos) AS kept
         FROM (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM w) x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.pos = x.pos GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256, coalesce(r.k, 0)::INT AS n_intervals
FROM w LEFT JOIN runs r ON r.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id"""

QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES = {"op10_substring_dedup": ORACLE}
