"""Line dedup: repeated runs of lines, by distributed prefix doubling over line ids.

Each document is a sequence of line ids (hashes).  Prefix doubling ranks the
suffixes of all sequences: lines that occur once are discarded, the others are
ranked, and a round replaces the rank of a suffix by the rank of its first
2h lines from the pair (rank at i, rank at i + h).  Suffixes of equal rank are
an interval of the suffix array whose common prefix has at least h lines;
suffixes alone in theirs are discarded, so a round holds only what repeats.

A run counts when it has ``min_chars`` characters.  From each line the shortest
run that has them, forwards and backwards, has a length that its content alone
decides, so equal runs have equal keys: two ranks that overlap to that length.
Those with an earlier copy (by doc_id, then place) are removed; their union is
exactly the union of all maximal repeated runs of ``min_chars`` that have an
earlier copy.  Doubling stops at the longest such length, not the longest run.

Rows that travel are lines that repeat, aggregated map-side; a hot line is one
row a task in the aggregates, is split by adaptive joins, and its successors are
numbered by prefix sums in two levels.

Nulls and odd rows: a null text has no lines; empty lines count as lines of no
characters; rows with a null id are never removed from nor count as a copy.
Texts that share a doc_id are documents of their own, in the order of their
hashes; rows equal in id and text are one document and are cut alike.  Columns
of ``docs`` called like a result column (``_lines``, ``_removed``, ``_runs``, or
with another ``prefix``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm import common as C

MIN_CHARS = 1
_BUCKET_BITS = 12
_LINES = "doc long, th long, pos int, fwd int, bwd int, h long"


def _shortest(chars: np.ndarray, bounds: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run from (and up to) each line that has ``need`` characters; 0 if there is none in its document."""
    total = np.concatenate([[0], np.cumsum(chars)])
    n = len(chars)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n)
    to = np.searchsorted(total, total[:-1] + need, "left")
    forward = np.where(to <= bounds[1:][doc], to - at, 0)
    since = np.searchsorted(total, total[1:] - need, "right") - 1
    backward = np.where(since >= bounds[:-1][doc], at + 1 - since, 0)
    return forward, backward


def _lines(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lo = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + 2_000_000, "right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                data, offsets = C.string_buffers(part.column(2))
                valid = part.column(2).is_valid().to_numpy(zero_copy_only=False)
                breaks = np.flatnonzero(data == 10)
                inner = np.searchsorted(breaks, offsets)
                n = np.where(valid, np.diff(inner) + 1, 0)
                bounds = np.concatenate([[0], np.cumsum(n)])
                doc = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(doc)) - bounds[:-1][doc]
                k = inner[:-1][doc] + place  # a line starts behind its document's start or the break before it
                starts = np.where(place == 0, offsets[:-1][doc], np.append(breaks, 0)[k - 1] + 1)
                ends = np.where(place == n[doc] - 1, offsets[1:][doc], np.append(breaks, 0)[np.minimum(k, len(breaks))])
                h = C.span_hashes(data, starts, ends)
                points = np.zeros(len(data) + 1, np.int32)
                np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                forward, backward = _shortest((points[ends] - points[starts]).astype(np.int64), bounds, min_chars)
                keep = (forward > 0) | (backward > 0)
                keep |= _inside(forward, backward)
                i = np.flatnonzero(keep)
                arrays = [*(part.column(c).take(pa.array(doc[i])) for c in (0, 1)), *(pa.array(x[i].astype(np.int32)) for x in (place, forward, backward)), pa.array(h[i].view(np.int64))]
                for a in range(0, len(i), 20_000):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 20_000) for x in arrays], ["doc", "th", "pos", "fwd", "bwd", "h"])

    return lambda b: C.released(lines(b))


def _inside(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Lines that lie in some shortest run."""
    depth = np.zeros(len(forward) + 1, np.int64)
    i = np.flatnonzero(forward)
    np.add.at(depth, i, 1)
    np.add.at(depth, i + forward[i], -1)
    i = np.flatnonzero(backward)
    np.add.at(depth, i + 1 - backward[i], 1)
    np.add.at(depth, i + 1, -1)
    return np.cumsum(depth[:-1]) > 0


def _numbered(rows: DataFrame, group: list[str], bucket: Column, order: str) -> DataFrame:
    """``first``: within a group, the sum of ``n`` of the rows before, by prefix sums in two levels (``bucket`` grows with ``order``)."""
    rows = rows.withColumn("k", bucket)
    base = rows.groupBy(*group, "k").agg(F.sum("n").alias("s"))
    base = base.select(*group, "k", (F.sum("s").over(W.partitionBy(*group).orderBy("k")) - F.col("s")).alias("base"))
    inner = rows.withColumn("inner", F.sum("n").over(W.partitionBy(*group, "k").orderBy(order)) - F.col("n"))
    return inner.join(base, [*group, "k"]).withColumn("first", F.col("inner") + F.col("base")).drop("k", "inner", "base")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """``h, r`` of every line id that occurs twice or more: r is its first place in the suffix array of such lines."""
    seen = C.checkpoint(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    bucket = F.shiftright("h", 64 - _BUCKET_BITS)
    # 4096 rows at most in the window over buckets, whatever the input
    return _numbered(seen.withColumn("all", F.lit(0)), ["all"], bucket, "h").select("h", F.col("first").alias("r"))


_ROW = ["doc", "th"]  #: the name of a document


def _double(ranked: DataFrame, step: int, ranks: int) -> DataFrame:
    """Ranks by 2 * step lines from ranks by step lines, of suffixes that aren't alone."""
    ahead = ranked.select(*_ROW, (F.col("pos") - step).alias("pos"), F.col("r").alias("r2"))
    pairs = C.checkpoint(ranked.join(ahead, [*_ROW, "pos"]))
    groups = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
    # over distinct pairs, not over suffixes; a rank that many others follow is split by the followers' place
    groups = C.checkpoint(_numbered(groups, ["r"], F.floor(F.col("r2") * 256 / F.lit(ranks)), "r2"))
    return C.checkpoint(pairs.join(groups, ["r", "r2"]).select(*_ROW, "pos", (F.col("r") + F.col("first")).alias("r")))


def _later(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Of runs with equal keys all but the first; by place, so that a frequent run needs no join of its own."""
    first = keyed.groupBy(*keys).agg(F.min(F.struct(*_ROW, "pos")).alias("first"), F.first("len").alias("_len"))
    return keyed.select(*_ROW, "pos", "len").join(first.select("first.*", F.col("_len").alias("len")), [*_ROW, "pos", "len"], "left_anti")


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``doc, th, text`` of each distinct (id, text), and whether ids repeat: th tells apart the texts of one id; where no id repeats it is 0."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    if rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows.select("doc", F.lit(0).cast("long").alias("th"), "text"), False
    return rows.select("doc", F.xxhash64("text").alias("th"), "text").dropDuplicates(_ROW), True


def repeated_runs(named: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, th, pos, len`` of runs of lines (from 0) that have an earlier copy; their union is all that repeats."""
    C.importable(named)
    lines = C.checkpoint(named.mapInArrow(_lines(min_chars), _LINES))
    full = C.checkpoint(lines.join(C.checkpoint(_first_ranks(lines)), "h").select(*_ROW, "pos", "fwd", "bwd", "r"))
    C.forget(lines)
    ranked, ranks = full.select(*_ROW, "pos", "r"), max(full.count(), 1)
    runs = full.where("fwd > 0").select(*_ROW, "pos", F.col("fwd").alias("len")).union(full.where("bwd > 0").select(*_ROW, (F.col("pos") - F.col("bwd") + 1).alias("pos"), F.col("bwd").alias("len"))).distinct()
    found = [_later(runs.where("len = 1").join(ranked, [*_ROW, "pos"]), ["r"])]
    longer = C.checkpoint(runs.where("len > 1"))
    most = longer.agg(F.max("len")).first()[0] or 1
    step = 1
    while step * 2 <= most:
        ranked = _double(ranked, step, ranks)
        step *= 2
        if ranked.isEmpty():
            break
        now = longer.where((F.col("len") >= step) & (F.col("len") < 2 * step)).join(ranked, [*_ROW, "pos"])
        end = ranked.select(*_ROW, F.col("pos").alias("end"), F.col("r").alias("r2"))
        now = now.withColumn("end", F.col("pos") + F.col("len") - step).join(end, [*_ROW, "end"])
        found.append(_later(now.select(*_ROW, "pos", "len", "r", "r2"), ["len", "r", "r2"]))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def maximal_runs(runs: DataFrame) -> DataFrame:
    """``doc, th, runs``: runs that overlap or touch become one; sorted, [start, end)."""
    before = W.partitionBy(*_ROW).orderBy("pos", "len")
    ends = runs.withColumn("end", F.col("pos") + F.col("len"))
    since = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    fresh = ends.withColumn("fresh", F.coalesce((F.col("pos") > since).cast("int"), F.lit(1)))
    parts = fresh.withColumn("part", F.sum("fresh").over(before.rowsBetween(W.unboundedPreceding, 0)))
    parts = parts.groupBy(*_ROW, "part").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return parts.groupBy(*_ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """What lies between the runs."""
    n = F.size(runs)
    start = lambda i: F.when(i < n, F.get(runs, i)["start"]).otherwise(F.size(lines))
    end = lambda i: F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, end(i) + 1, start(i) - end(i))))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, prefix: str = "_") -> DataFrame:
    """All columns of ``docs`` with the text cut, and ``_lines``, ``_removed``, ``_runs`` (maximal, [start, end))."""
    named, many = _named(docs, id_col, text_col)
    found = maximal_runs(repeated_runs(named, min_chars))
    doc, th, runs = (C.fresh(docs, name) for name in ("doc", "th", "runs"))
    found = found.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("runs").alias(runs))
    same = F.xxhash64(F.col(text_col)) if many else F.lit(0).cast("long")
    out = docs.join(found, (F.col(id_col).cast("long") == F.col(doc)) & F.col(text_col).isNotNull() & (same == F.col(th)), "left").drop(doc, th)
    lines, some = F.split(F.col(text_col), "\n", -1), F.col(runs).isNotNull()
    gone = F.aggregate(runs, F.lit(0), lambda s, x: s + x["end"] - x["start"])
    out = out.withColumns({f"{prefix}lines": F.when(F.col(text_col).isNotNull(), F.size(lines)).otherwise(0), f"{prefix}removed": F.coalesce(gone, F.lit(0)), f"{prefix}runs": F.col(runs)})
    return out.withColumn(text_col, F.when(some, F.array_join(_kept(lines, F.col(runs)), "\n")).otherwise(F.col(text_col))).drop(runs)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.greatest(F.size("_runs"), F.lit(0)).alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: A line goes if a run that ends the empty lines from it on, or begins with the line before them, has an earlier copy.
ORACLE = """
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
x AS (
  SELECT *, min(CASE WHEN line <> '' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx,
         max(CASE WHEN line <> '' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv FROM l),
z AS (
  SELECT x.doc_id, x.pos, x.line,
         x.nx IS NOT NULL AND row_number() OVER (PARTITION BY a.line, x.nx - x.pos ORDER BY x.doc_id, x.pos) > 1
         OR x.pv IS NOT NULL AND row_number() OVER (PARTITION BY b.line, x.pos - x.pv ORDER BY x.doc_id, x.pos) > 1 AS gone
  FROM x LEFT JOIN l a ON a.doc_id = x.doc_id AND a.pos = x.nx LEFT JOIN l b ON b.doc_id = x.doc_id AND b.pos = x.pv),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM z),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, coalesce(n_runs, 0)::INT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": ORACLE}
