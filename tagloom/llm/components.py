"""Connected components of an edge list, by alternating large-star and small-star rounds.

The rounds are plain joins and aggregates (map-side combined, so a hub costs one
row a task), each cut by a reliable checkpoint.  ``forest`` contracts the links
that one task knows to a spanning forest, so a dense group never travels as all
its pairs.  What the tasks' forests leave, where it is counted and found small,
is solved by one task: a round has a dozen exchanges, whose files outweigh it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import common as C

ALONE = 1_000_000  #: edges that one task solves (16 MB)
PART = 1_000_000  #: links that a task gathers before it contracts them


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component among ``n`` nodes."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge a node, (node, smaller node), that connects what the links connect."""
    if not len(u):
        return u, v
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = labels(len(nodes), inverse[: len(u)], inverse[len(u) :])
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as a forest, (larger node, smaller node); edges of ``PART`` links at most are held besides it."""
    v, u, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for b in batches:
        more.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
        if sum(len(x) for x, _ in more) >= PART:
            v, u = forest(*(np.concatenate([a, *(m[i] for m in more)]) for i, a in enumerate((v, u))))
            more = []
    v, u = forest(*(np.concatenate([a, *(m[i] for m in more)]) for i, a in enumerate((v, u))))
    if len(v):
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["v", "u"])


def components(edges: DataFrame, u: str = "u", v: str = "v", alone: int = ALONE) -> DataFrame:
    """``node, component`` of every node of an edge list; the component is its smallest node.

    Up to ``alone`` edges (after each task's contraction) are solved by one task, more by rounds.
    """
    C.importable(edges)
    now = edges.select(F.greatest(u, v).cast("long").alias("v"), F.least(u, v).cast("long").alias("u")).where("u < v")
    now = C.checkpoint(now.mapInArrow(lambda b: C.released(_forests(b)), "v long, u long"))
    if now.count() <= alone:  # proven bound
        solved = C.checkpoint(now.coalesce(1).mapInArrow(lambda b: C.released(_forests(b)), "v long, u long"))
        C.forget(now)
        return solved.select(F.col("v").alias("node"), F.col("u").alias("component")).union(solved.select("u", "u").distinct())
    before = None
    while True:
        # large star: every larger neighbour of a node hangs on to the least of the node's neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("u < v").distinct()
        # small star: a node and its smaller neighbours hang on to the least of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
        last, now = now, C.checkpoint(small.where("u < v").distinct())
        C.forget(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct())
        before = state
