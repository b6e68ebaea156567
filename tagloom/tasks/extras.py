"""Queries on lineage, generators and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.lineage import Traced
from tagloom.registry import query, table
from tagloom.session import cut, shared_folder
from tagloom.sources import generators
from tagloom.streaming.incremental import incremental, latest, windowed


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders WHERE o_totalprice > 1000")
def lineage_group_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Each sum with the orders behind it."""
    o = Traced.source(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "orders", ["o_orderkey"])
    sums = o.where("o_totalprice > 1000").group_by("o_custkey", total=F.round(F.sum("o_totalprice"), 2))
    return sums.inputs().select("o_custkey", F.get_json_object("row", "$.o_orderkey").cast("long").alias("o_orderkey"), "total")


@query("WITH j AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_name, r_name, 'nation' AS source, n_nationkey AS id FROM j UNION ALL SELECT n_name, r_name, 'region', r_regionkey FROM j")
def lineage_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each joined row with the two rows that it was made of."""
    n = Traced.source(table(spark, sf, "nation").select("n_name", F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("id")), "nation", ["id"])
    r = Traced.source(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), "r_name", F.col("r_regionkey").alias("id")), "region", ["id"])
    both = n.select("n_name", "k").join(r.select("r_name", "k"), ["k"])
    return both.inputs().select("n_name", "r_name", "source", F.get_json_object("row", "$.id").cast("int").alias("id"))


@query("""SELECT r_name, '{"group":[' || string_agg(t, ',' ORDER BY t) || ']}' AS tree FROM (SELECT r_name,
    '{"join":[{"source":"nation","row":{"id":' || n_nationkey || '}},{"source":"region","row":{"id":' || r_regionkey || '}}]}' AS t FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name""")
def lineage_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Each region with the tree of its group: the joins in it, and the rows that they joined."""
    n = Traced.source(table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("id")), "nation", ["id"], tree=True)
    r = Traced.source(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), "r_name", F.col("r_regionkey").alias("id")), "region", ["id"], tree=True)
    return n.select("k").join(r.select("r_name", "k"), ["k"]).group_by("r_name").df.select("r_name", F.col("_tree").alias("tree"))


@query("SELECT n_nationkey, 100.0 / nullif(n_regionkey, 0) AS x, CASE WHEN n_regionkey = 0 THEN 'division by zero' END AS error FROM nation")
def lineage_error_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A row whose expression fails is kept, with a message."""
    n = Traced.source(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "nation")
    out = n.guarded("x", F.lit(100.0) / F.nullif(F.col("n_regionkey"), F.lit(0)), F.col("n_regionkey") != 0, "division by zero")
    return out.df.select("n_nationkey", "x", F.col("_error").alias("error"))


@query("SELECT x FROM range(3, 30, 4) t(x)")
def source_inclusive_range(spark: SparkSession, sf: str) -> DataFrame:
    return generators.inclusive_range(spark, 3, 29, 4, "x")


@query("SELECT c AS cid, 1 AS components, 20 AS vertices FROM range(5) t(c)")
def source_component_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Every generated component has all its vertices and hangs together."""
    g = cut(generators.component_graph(spark, 5, 100, 60).select("cid", "src", "dst"))
    found = spread_least(g.select("src", "dst")).withColumnRenamed("v", "src")
    return g.join(found, "src").groupBy("cid").agg(F.count_distinct("least").cast("int").alias("components"), F.count_distinct("src").cast("int").alias("vertices"))


@query("SELECT c AS cid, greatest(2, floor(400 * (c + 1)::DOUBLE ** -1.2 / sum((c + 1)::DOUBLE ** -1.2) OVER ()))::BIGINT AS vertices FROM range(12) t(c)")
def source_zipf_components(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the components of a generated graph, found by spreading the smallest id along the edges."""
    g = cut(generators.zipf_components(spark, 12, 400, 200, 1.2))
    found = spread_least(g.select("src", "dst"))
    return g.select("cid", F.col("src").alias("v")).distinct().join(found, "v").groupBy("cid", "least").agg(F.count(F.lit(1)).alias("vertices")).select("cid", "vertices")


def spread_least(edges: DataFrame) -> DataFrame:
    """``v, least``: the smallest vertex that each can reach, edges being there in both directions."""
    state = cut(edges.select(F.col("src").alias("v")).distinct().withColumn("least", F.col("v")))
    while True:
        near = edges.join(state.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("least").alias("near"))
        # a vertex takes its neighbours' least, then what that vertex has
        new = state.join(near, "v", "left").select("v", F.least("least", F.coalesce("near", "least")).alias("least"))
        jump = state.select(F.col("v").alias("least"), F.col("least").alias("far"))
        new = cut(new.join(jump, "least").select("v", F.least("least", "far").alias("least")))
        if new.join(state, ["v", "least"], "left_anti").isEmpty():
            return new
        state = new


@query()
def source_zipf_visits(spark: SparkSession, sf: str) -> DataFrame:
    return generators.visits(spark, 20_000, 16, 1.1).groupBy("grp").count()


@query()
def source_rmat(spark: SparkSession, sf: str) -> DataFrame:
    return generators.rmat(spark, 5_000, 8).groupBy("src").count()


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s, max(event_id) AS last FROM events GROUP BY event_type")
def streaming_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """A grouped aggregate kept up to date batch by batch."""
    base = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    compute = lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.max("event_id").alias("last"))
    incremental(_stream(spark, sf), compute, ["event_type"], {"n": "count", "s": "+", "last": "max"}, f"{base}/out", f"{base}/log").awaitTermination()
    return latest(spark, f"{base}/out").select("event_type", "n", F.round("s", 4).alias("s"), "last")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling event-time windows with a watermark."""
    name = f"windows_{uuid.uuid4().hex}"
    base = f"{shared_folder(spark)}/{name}"
    out = windowed(_stream(spark, sf), "ts", "1 day", "1 day", None, ["event_type"], n=F.count(F.lit(1)))
    out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
