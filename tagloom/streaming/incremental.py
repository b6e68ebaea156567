"""Incremental queries: aggregates whose monoid allows q(S + dS) = q(S) x q(dS), run by Structured Streaming.

``monoid_of`` tells by which monoid a query's result can be merged; aggregates
that have one run natively in update or complete mode with a watermark for late
rows; any other merge runs in ``foreachBatch`` over a stored state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.functions import monoids
from tagloom.lang.syntax import Parser, free


@dataclass(frozen=True)
class Merge:
    """How results merge: ``kind`` is bag, value, group or none; ``ops`` the monoids of the values."""

    kind: str
    ops: tuple[str, ...] = ()


def monoid_of(text: str, stream: str) -> Merge:
    """The monoid by which a query's results over parts of a stream merge."""
    parser = Parser(text, {n for n in monoids._MONOIDS if n.isidentifier()})
    e = parser.expr()
    parser.take("")
    return _infer(e, stream)


def _infer(e, stream: str) -> Merge:
    if stream not in free(e):
        return Merge("none")
    if e[0] == "var":
        return Merge("bag", ("++",))
    if e[0] == "reduce":
        inner = _infer(e[2], stream)
        return Merge("value", (e[1],)) if inner.kind == "bag" else Merge("none")
    if e[0] == "select":
        _, distinct, head, quals, where, group, second, having, order = e
        uses = sum(stream in free(q[-2] if q[0] == "gen" else q[-1]) for q in quals if q[0] != "cond")
        if uses != 1 or second or order or having or where and stream in free(where):
            return Merge("none")  # a product of the stream with itself, or a filter on merged values, isn't additive
        if not group:
            return Merge("bag", ("distinct",) if distinct else ("++",))
        ops = [x[1] for x in (head[1] if head[0] == "tuple" else [head]) if x[0] == "reduce"]
        return Merge("group", tuple(ops))
    if e[0] == "op" and e[1] in ("union", "++"):
        sides = {_infer(x, stream).kind for x in e[2:] if stream in free(x)}
        return Merge("bag", ("++",)) if sides == {"bag"} else Merge("none")
    return Merge("none")


def windowed(stream: DataFrame, time: str, late: str, width: str, slide: str | None, keys: Sequence[str | Column], **aggs: Column) -> DataFrame:
    """Aggregates by event-time window and keys, with rows later than ``late`` dropped and state bounded by the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])


def sessions(stream: DataFrame, time: str, late: str, gap: str, keys: Sequence[str | Column], **aggs: Column) -> DataFrame:
    """Aggregates by session: runs of rows of a key with gaps under ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])


def merge_results(old: DataFrame, new: DataFrame, keys: Sequence[str], ops: dict[str, str]) -> DataFrame:
    """Two results merged by key, each value by its monoid: one union and one aggregate with map-side combine."""
    return old.unionByName(new).groupBy(*keys).agg(*[monoids.get("+" if op == "count" else op).agg(F.col(c)).alias(c) for c, op in ops.items()])


def incremental(stream: DataFrame, compute: Callable[[DataFrame], DataFrame], keys: Sequence[str], ops: dict[str, str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``compute`` of all rows so far as Parquet under ``path``: each batch's result is merged into the last version.

    Versions are written beside each other and named by the batch, so a batch
    that is run again writes the same version from the same predecessor.
    """
    spark = stream.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)

    def merge(batch: DataFrame, number: int) -> None:
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        new = compute(batch)
        if number and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 1}")):
            new = merge_results(spark.read.parquet(f"{path}/v={number - 1}"), new, keys, ops)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str) -> DataFrame:
    """The newest version that :func:`incremental` has written."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)
    version = max(int(f.getPath().getName().partition("=")[2]) for f in found if f.getPath().getName().startswith("v="))
    return spark.read.parquet(f"{path}/v={version}")
