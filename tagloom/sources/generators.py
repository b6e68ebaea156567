"""Deterministic generators of test data; the size is a parameter and rows are made on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inclusive_range(spark: SparkSession, first: int, last: int, step: int = 1, name: str = "value") -> DataFrame:
    """first, first + step, ... up to and including last."""
    return spark.range(first, last + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def uniform(seed: int, salt: int, n: int, key: str = "id") -> Column:
    """A number in [0, n) that only depends on seed, salt and row id: the same in every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)), F.lit(n))


def random_rows(spark: SparkSession, n: int, fill: Callable[[np.random.Generator, int], dict[str, np.ndarray]], schema: str, seed: int = 0, chunk: int = 10_000) -> DataFrame:
    """``n`` rows from a filler that gets a generator and a count; each chunk of rows has a generator of its own, so reruns agree."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in fill(np.random.default_rng([seed, k]), rows).items()})

    chunks = spark.range(-(-n // chunk)).select("id", F.least(F.lit(chunk), F.lit(n) - F.col("id") * chunk).alias("rows"))
    return chunks.mapInArrow(make, schema)


def zipf(rng: np.random.Generator, size: int, n: int, exponent: float) -> np.ndarray:
    """Zipf ranks 0..n-1 by the inverse of the cumulated weights."""
    total = np.cumsum(np.arange(1, n + 1, dtype=np.float64) ** -exponent)
    return np.searchsorted(total, rng.random(size) * total[-1], side="left").clip(0, n - 1)


def _groups(exponent: float | None, groups: int):
    return (lambda rng, n: zipf(rng, n, groups, exponent)) if exponent is not None else (lambda rng, n: rng.integers(0, groups, n))


def visits(spark: SparkSession, total: int, groups: int, exponent: float | None = None, seed: int = 123) -> DataFrame:
    """``grp, ip``: uniform groups, or Zipf-distributed with an exponent."""
    pick = _groups(exponent, groups)
    return random_rows(spark, total, lambda r, n: {"grp": pick(r, n), "ip": r.integers(0, max(1, total // groups), n)}, "grp long, ip long", seed)


def day_graph(spark: SparkSession, edges: int, vertices: int, days: int, exponent: float | None = None, seed: int = 123) -> DataFrame:
    """``day, src, dst``."""
    pick = _groups(exponent, days)
    return random_rows(spark, edges, lambda r, n: {"day": pick(r, n), "src": r.integers(0, vertices, n), "dst": r.integers(0, vertices, n)}, "day long, src long, dst long", seed)


def component_graph(spark: SparkSession, components: int, vertices: int, extra: int, seed: int = 123) -> DataFrame:
    """``cid, src, dst`` in both directions: each component is a path over its vertices (so it is connected) and random edges."""
    each = max(2, vertices // components)
    path = spark.range(components * (each - 1)).select((F.col("id") / (each - 1)).cast("long").alias("cid"), (F.col("id") % (each - 1)).alias("a"))
    path = path.select("cid", (F.col("cid") * each + F.col("a")).alias("src"), (F.col("cid") * each + F.col("a") + 1).alias("dst"))
    rand = spark.range(extra).select(uniform(seed, 1, components).alias("cid"), uniform(seed, 2, each).alias("a"), uniform(seed, 3, each).alias("b"))
    rand = rand.select("cid", (F.col("cid") * each + F.col("a")).alias("src"), (F.col("cid") * each + F.col("b")).alias("dst"))
    one = path.union(rand).where("src <> dst")
    return one.union(one.select("cid", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def zipf_components(spark: SparkSession, components: int, vertices: int, extra: int, exponent: float, seed: int = 123, chunk: int = 10_000) -> DataFrame:
    """``cid, src, dst`` in both directions: connected components whose sizes (at least 2) follow Zipf's law.

    ``extra`` random edges are dealt to the components in proportion to their sizes.  Long paths are
    made in chunks, so the largest component isn't one task's.
    """
    weight = F.pow(F.col("cid") + 1, F.lit(-exponent))
    total = spark.range(components).withColumnRenamed("id", "cid").agg(F.sum(weight)).first()[0]
    size = F.greatest(F.lit(2), F.floor(F.lit(vertices) * weight / total))
    stride = max(2, int(vertices / total))  # the first component's size: ids of components are apart
    sizes = spark.range(components).withColumnRenamed("id", "cid").withColumn("n", size)
    at = lambda a: F.col("cid") * stride + a
    chunks = sizes.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / chunk)))).repartition("cid", "c")
    path = chunks.select("cid", F.explode(F.sequence(F.col("c") * chunk, F.least(F.col("n") - 2, F.col("c") * chunk + chunk - 1))).alias("a")).select("cid", at(F.col("a")).alias("src"), at(F.col("a") + 1).alias("dst"))
    unit = lambda k: uniform(seed, k, 1 << 53).cast("double") / float(1 << 53)
    here = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.ceil(F.lit(extra) * F.col("n") / vertices / (F.floor((F.col("n") - 2) / chunk) + 1)))))
    rand = chunks.select("cid", "n", "c", here.alias("e")).withColumn("id", F.xxhash64("cid", "c", "e"))
    rand = rand.select("cid", at(F.floor(unit(1) * F.col("n"))).alias("src"), at(F.floor(unit(2) * F.col("n"))).alias("dst"))
    one = path.union(rand).where("src <> dst")
    return one.union(one.select("cid", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def points(spark: SparkSession, n: int, dims: int = 2, seed: int = 123) -> DataFrame:
    """``id, point``: uniform in the unit cube."""
    unit = [uniform(seed, i, 1 << 53).cast("double") / float(1 << 53) for i in range(dims)]
    return spark.range(n).select("id", F.array(*unit).alias("point"))


def grid_points(spark: SparkSession, n: int, side: int = 10, spread: float = 0.4, seed: int = 123) -> DataFrame:
    """``x, y`` clustered around the centres of a side x side grid."""
    cell = F.col("id") % (side * side)
    unit = lambda k: uniform(seed, k, 1 << 53).cast("double") / float(1 << 53) - 0.5
    return spark.range(n).select((F.floor(cell / side) + 0.5 + spread * unit(1)).alias("x"), (cell % side + 0.5 + spread * unit(2)).alias("y"))


def rmat(spark: SparkSession, edges: int, scale: int, quadrants: tuple[float, float, float] = (0.57, 0.19, 0.19), seed: int = 123) -> DataFrame:
    """``src, dst`` of an R-MAT graph of 2**scale vertices: one choice of quadrant for each bit."""
    a, b, c = quadrants

    def fill(r: np.random.Generator, n: int) -> dict[str, np.ndarray]:
        src, dst = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for _ in range(scale):
            u = r.random(n)
            src, dst = src * 2 + (u >= a + b), dst * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c))
        return {"src": src, "dst": dst}

    return random_rows(spark, edges, fill, "src long, dst long", seed)


def sparse_matrix(spark: SparkSession, rows: int, columns: int, sparsity: float, seed: int = 123) -> DataFrame:
    """``i, j, v``: each cell is there with the given chance."""
    cell = spark.range(rows * columns).select((F.col("id") / columns).cast("long").alias("i"), (F.col("id") % columns).alias("j"), "id")
    unit = lambda k: uniform(seed, k, 1 << 53).cast("double") / float(1 << 53)
    return cell.where(unit(1) < sparsity).select("i", "j", unit(2).alias("v"))
