"""Readers and sinks: tables written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.registry import query, table
from tagloom.session import shared_folder
from tagloom.sources import readers


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT c_custkey::VARCHAR || ',' || c_mktsegment AS value FROM customer")
def source_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Written twice to one place: the second time replaces the first."""
    path = _place(spark)
    for _ in range(2):
        readers.write_text(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), path)
    return readers.text_lines(spark, path, 4)


@query("SELECT n_regionkey AS r_regionkey, count(*) AS lines, sum(length(n_name) + 1)::BIGINT AS chars FROM nation GROUP BY n_regionkey")
def source_whole_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file a region: the names of its nations, a line each."""
    path = _place(spark)
    names = table(spark, sf, "nation").select("n_regionkey", F.col("n_name").alias("value"))
    names.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    files = readers.whole_files(spark, f"{path}/*")
    region = F.regexp_extract("path", "n_regionkey=(\\d+)", 1).cast("int")
    return files.select(region.alias("r_regionkey"), F.regexp_count("content", F.lit("\n")).cast("long").alias("lines"), F.length("content").cast("long").alias("chars"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def source_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.csv(path, sep="|")
    return readers.csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double", sep="|")


@query("SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL")
def source_coo_matrix(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark)
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
    readers.write_matrix(cells.agg(F.sum("l_quantity").cast("double").alias("v")), path)
    return readers.coo_matrix(spark, path)


@query("SELECT max(l_suppkey)::BIGINT AS rows FROM lineitem")
def source_matrix_metadata(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark)
    table(spark, sf, "lineitem").agg(F.max("l_suppkey").alias("rows"), F.max("l_partkey").alias("cols")).write.json(path)
    return spark.range(1).select(F.lit(readers.matrix_rows(spark, path)).cast("long").alias("rows"))


@query("SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS degree, min(l_partkey) AS first FROM lineitem GROUP BY l_suppkey")
def source_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a node and its neighbours."""
    path = _place(spark)
    near = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).cast("array<string>").alias("near"))
    readers.write_text(near.select("l_suppkey", F.array_join("near", ",").alias("near")), path)
    out = readers.adjacency(spark, path)
    return out.select("node", F.size("neighbours").cast("long").alias("degree"), F.get("neighbours", F.lit(0)).alias("first"))
