"""Sparse arrays as DataFrames: vectors (i, v), matrices (i, j, v) and maps (k, v).

Writes merge by index: ``update`` is right-biased, ``increment`` combines with a
monoid.  Reads are joins, so an absent cell contributes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions import monoids
from tagloom.session import cut


def index_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "v"]


def update(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the cells of ``new`` put in their places."""
    return merge(old, new, None)


def increment(old: DataFrame, new: DataFrame, op: str = "+") -> DataFrame:
    """``old`` with each cell of ``new`` combined into it; cells that ``old`` lacks are made."""
    return merge(old, new, op)


def merge(old: DataFrame, new: DataFrame, op: str | None) -> DataFrame:
    keys = index_columns(old)
    both = old.join(new.withColumnRenamed("v", "__new"), keys, "full_outer")
    value = F.coalesce("__new", "v")
    if op is not None:
        value = F.when(F.col("v").isNotNull() & F.col("__new").isNotNull(), monoids.get(op).combine(F.col("v"), F.col("__new"))).otherwise(value)
    return both.select(*keys, value.alias("v"))


def join_aggregate(x: DataFrame, y: DataFrame, on: Sequence[str], keys: dict[str, Column], value: Column, op: str = "+") -> DataFrame:
    """Join, group and reduce in one: partial aggregation follows the join in the same stage."""
    joined = x.join(y, list(on))
    return joined.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(monoids.get(op).agg(value).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of sparse matrices."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("__a")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("__b"))
    return join_aggregate(left, right, ["k"], {"i": F.col("i"), "j": F.col("j")}, F.col("__a") * F.col("__b"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return increment(a, b, "+")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * by)


def covariance(a: DataFrame, rows: int, columns: int) -> DataFrame:
    """Covariances of a matrix' columns over ``rows`` rows (absent cells are 0), divided by rows - 1."""
    a = a.where((F.col("i") >= 0) & (F.col("i") < rows) & (F.col("j") >= 0) & (F.col("j") < columns))
    total = a.groupBy("j").agg(F.sum("v").alias("s"))
    left, right = a.select("i", "j", "v"), a.select("i", F.col("j").alias("k"), F.col("v").alias("w"))
    cross = left.join(right, "i").groupBy("j", "k").agg(F.sum(F.col("v") * F.col("w")).alias("xy"))
    cross = cross.join(total, "j").join(total.withColumnsRenamed({"j": "k", "s": "t"}), "k")
    return cross.select(F.col("j").alias("i"), F.col("k").alias("j"), ((F.col("xy") - F.col("s") * F.col("t") / rows) / (rows - 1)).alias("v"))


def errors(r: DataFrame, p: DataFrame, q: DataFrame) -> DataFrame:
    """R - P x Q on the cells of R; R's cells meet the factors, the whole product is never made."""
    left = r.join(p.select("i", F.col("j").alias("k"), F.col("v").alias("__a")), "i").join(q.select(F.col("i").alias("k"), "j", F.col("v").alias("__b")), ["k", "j"])
    return left.groupBy("i", "j").agg((F.first("v") - F.sum(F.col("__a") * F.col("__b"))).alias("v"))


def factorize_step(r: DataFrame, p: DataFrame, q: DataFrame, a: float = 0.002, b: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """One gradient step of R ~ P x Q on the cells of R (all matrices sparse)."""
    error = errors(r, p, q).withColumnRenamed("v", "e")
    k = F.col("k")
    pe = error.join(q.select(F.col("i").alias("k"), "j", F.col("v").alias("w")), "j").groupBy("i", k).agg(F.sum(F.col("e") * F.col("w")).alias("d"), F.count(F.lit(1)).alias("n"))
    qe = error.join(p.select("i", F.col("j").alias("k"), F.col("v").alias("w")), "i").groupBy(k, "j").agg(F.sum(F.col("e") * F.col("w")).alias("d"), F.count(F.lit(1)).alias("n"))
    step = lambda d: F.col("v") + a * (2 * F.col("d") - b * F.col("n") * F.col("v"))
    new_p = p.join(pe.withColumnRenamed("k", "j"), ["i", "j"], "left").select("i", "j", F.coalesce(step("d"), "v").alias("v"))
    new_q = q.join(qe.withColumnRenamed("k", "i"), ["i", "j"], "left").select("i", "j", F.coalesce(step("d"), "v").alias("v"))
    return new_p, new_q


def distinct_cells(df: DataFrame, order: Sequence[Column], strict: bool = False) -> DataFrame:
    """One value for each index: the last by ``order``; ``strict``: an error if an index has several values."""
    keys = index_columns(df)
    if strict:
        n = F.count_distinct("v")
        return df.groupBy(*keys).agg(F.when(n <= 1, F.first("v")).otherwise(F.raise_error(F.lit("several values for one index"))).alias("v"))
    return df.groupBy(*keys).agg(F.max_by("v", F.struct(*order)).alias("v"))


def with_index(df: DataFrame, order: Sequence[str | Column], name: str = "i") -> DataFrame:
    """Rows numbered from 0 in the given order, without gathering all rows in one task.

    Rows are range-partitioned; the only thing that is added up across
    partitions is one count each.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id())
    spread = cut(spread)  # a recomputed range partition could differ
    counts = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__k").alias("__first"))
    base = counts.select("__p", "__first", (F.sum("n").over(W.orderBy("__p")) - F.col("n")).alias("__base"))
    return spread.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + F.col("__k") - F.col("__first")).drop("__p", "__k", "__base", "__first")
