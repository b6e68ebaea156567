"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Equal vectors become one class with a count first, so a very common vector is
one row.  Classes are dealt into blocks; each pair of blocks is a tile.  In a
tile all unit vectors are quantised to int8 with one step s, and for each vector
the norm of what quantisation loses is kept: |x.y - s*s*qx.qy| <= |s qx||ey| + |ex||y|.
The integer product (exact in float32 for this many terms) rules out all pairs
that can't reach the threshold; the others are recomputed in double precision.

A tile returns counts of links and a spanning forest of its links, never the
pairs.  Tiles are bounded by the block size; their number grows with the square
of the number of blocks, as an exact all-pairs comparison must.

Nulls and odd rows: a vector that is null, zero, or holds a null or non-finite
component has no links and is its own component; vectors of other lengths
than their block's are compared with those of their length only; rows that
repeat an id are separate vectors; a null id keeps a null component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.llm import components as G

THRESHOLD = 0.95
BLOCK, LEAST_BLOCK = 32_768, 1024  #: vectors of a block, at most and (with few vectors) about at least
_STRIPE = 512
_EXACT_TERMS = 1000  #: so many products of int8 values add up exactly in float32


class _Side:
    def __init__(self, payload: bytes, dims: int):
        self.rep, self.count, flat = C.unpack(payload)
        x = flat.reshape(len(self.rep), dims).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
        self.x = x / np.linalg.norm(x, axis=1, keepdims=True)

    def quantise(self, step: float) -> None:
        self.q = np.rint(self.x / step).astype(np.int8)
        self.lost = np.linalg.norm(self.x - step * self.q.astype(np.float64), axis=1)
        self.size = np.linalg.norm(step * self.q.astype(np.float64), axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of int8 values: whole numbers, exact."""
    out = None
    for lo in range(0, a.shape[1], _EXACT_TERMS):
        part = a[:, lo : lo + _EXACT_TERMS].astype(np.float32) @ b[:, lo : lo + _EXACT_TERMS].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def tile(a: _Side, b: _Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked vectors of each vector of either side, and the linked pairs' spanning forest (as positions; b's follow a's)."""
    step = max(float(np.abs(a.x).max()), float(np.abs(b.x).max())) / 127
    a.quantise(step)
    b.quantise(step)
    most_lost, n = float(b.lost.max()), len(a.rep)
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(b.rep), np.int64)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    for lo in range(0, n, _STRIPE):
        rows = slice(lo, min(n, lo + _STRIPE))
        slack = a.size[rows] * most_lost + a.lost[rows] + 1e-9
        possible = _product(a.q[rows], b.q) >= ((threshold - slack) / (step * step))[:, None]
        i, j = np.nonzero(possible)
        if same:
            i, j = i[j > i + lo], j[j > i + lo]
        if not len(i):
            continue
        r, c = np.unique(i), np.unique(j)
        if len(i) * 3 > len(r) * len(c):  # dense: one product in double precision
            whole = a.x[rows][r] @ b.x[c].T
            value = whole[np.searchsorted(r, i), np.searchsorted(c, j)]
        else:
            value = np.concatenate([np.einsum("ij,ij->i", a.x[i[k : k + 100_000] + lo], b.x[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)])
        i, j = i[value >= threshold] + lo, j[value >= threshold]
        links_a += np.bincount(i, b.count[j], n).astype(np.int64)
        links_b += np.bincount(j, a.count[i], len(b.rep)).astype(np.int64)
        u, v = G.forest(i, j if same else j + n)
        us.append(u)
        vs.append(v)
    if us:
        u, v = G.forest(np.concatenate(us), np.concatenate(vs))
    else:
        u = v = np.zeros(0, np.int64)
    return links_a, links_b, u, v


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    flat = table["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    data = C.pack(table["rep"].to_numpy(), table["n"].to_numpy(), flat.astype(np.float32 if table["e"].type.value_type == pa.float32() else np.float64))
    return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "payload": pa.array([data], pa.binary())})


def _compare(threshold: float):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dims, blocks = key[0].as_py(), table["block"].to_pylist()
        sides = [_Side(p, dims) for _, p in sorted(zip(blocks, table["payload"].to_pylist(), strict=True))]
        a, b, same = sides[0], sides[-1], key[1].as_py() == key[2].as_py()
        if len(sides) == 1 and not same:  # the other block has no vector of this length
            return pa.table({"rep": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if same:
            b = _Side(table["payload"][0].as_py(), dims)
        la, lb, u, v = tile(a, b, same, threshold)
        if same:
            reps, counts = a.rep, la + lb
        else:
            reps, counts = np.concatenate([a.rep, b.rep]), np.concatenate([la, lb])
        hit = np.flatnonzero(counts)
        return pa.table({"rep": pa.array(np.concatenate([reps[hit], reps[u]])), "other": pa.array(np.concatenate([np.full(len(hit), -1), reps[v]]), mask=np.arange(len(hit) + len(u)) < len(hit)), "links": pa.array(np.concatenate([counts[hit], np.zeros(len(u), np.int64)]))})

    return compare


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    C.importable(vectors)
    e = F.col("e")
    good = e.isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e")).withColumn("good", F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"k1": F.when(F.col("good"), F.xxhash64("e")), "k2": F.when(F.col("good"), F.xxhash64(F.lit(7), "e"))})
    classes = C.checkpoint(rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("e").alias("e"), F.size(F.first("e")).alias("dims")))
    count, cores = classes.count(), vectors.sparkSession.sparkContext.defaultParallelism
    # each block travels to as many tiles as there are blocks: as few as give every core a tile, as many as memory asks for
    blocks = max(1, math.ceil(count / block), min(math.ceil(count / LEAST_BLOCK), math.ceil((2 * cores) ** 0.5)))
    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 2)
    packed = classes.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).groupBy("dims", "block").applyInArrow(_pack, "dims int, block int, payload binary")
    packed = C.checkpoint(packed)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = packed.select("*", other.alias("o")).select("dims", "block", "payload", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    found = C.checkpoint(pairs.repartition(n, "dims", "i", "j").groupBy("dims", "i", "j").applyInArrow(_compare(threshold), "rep long, other long, links long"))
    joined = G.components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(C.read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(l.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN least l ON l.u = e.vec_id"""

QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLES = {"op7_embedding_dedup": ORACLE}
