"""Readers and sinks for the formats that programs here use; all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.arrays import with_index


def text_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``value``: one row a line."""
    out = spark.read.text(path)
    return out.repartition(partitions) if partitions else out


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content``: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep)


def coo_matrix(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """``i, j, v`` of lines "i j v"."""
    return spark.read.csv(path, sep=sep, schema="i bigint, j bigint, v double")


def matrix_rows(spark: SparkSession, path: str) -> int:
    """The number of rows that a matrix' metadata file (JSON) gives."""
    return spark.read.json(path, multiLine=True).select("rows").first()[0]


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``node, neighbours`` of lines "n,n1,n2,..."; a line may name no neighbour."""
    xs = F.split("value", ",").cast("array<bigint>")
    return spark.read.text(path).where("trim(value) <> ''").select(xs.getItem(0).alias("node"), F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))).alias("neighbours"))


def indexed_vector(df: DataFrame, value: str | Column, order: list[str | Column]) -> DataFrame:
    """``i, v``: a column numbered from 0 in the given order."""
    return with_index(df, order).select("i", (F.col(value) if isinstance(value, str) else value).alias("v"))


def write_text(df: DataFrame, path: str, sep: str = ",") -> None:
    """Rows as lines; what was there goes first."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str) -> None:
    df.select("i", "j", "v").write.mode("overwrite").csv(path, sep=" ")


def force(df: DataFrame) -> None:
    """Runs the plan and drops the rows."""
    df.write.format("noop").mode("overwrite").save()


def partition_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).count()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
