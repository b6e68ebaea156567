"""Sessions, reliable cuts of a plan's lineage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000  #: known row counts up to this get a broadcast hint


def session(name: str = "tagloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on and UTC times; other settings are the caller's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine if driver and executors are one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local["):
        return tempfile.mkdtemp(prefix="checkpoints-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a plan that is a scan of a reliable checkpoint (in ``spark.checkpoint.dir``).

    A checkpoint keeps the size estimate of the plan that it cuts, and a join's
    estimate is a product: in a loop its digits double every round.  The scan is
    therefore made anew from the checkpointed rows, without that estimate.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    kept = df.checkpoint(eager=True)._jdf
    rdd = kept.queryExecution().logical().rdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, kept.schema(), False), spark)
    out._tagloom_cut, file = True, rdd.getCheckpointFile()
    out._tagloom_file = file.get() if file.isDefined() else None
    return out


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, in Parquet: a few bytes a cell in place of a serialized row; for plain columns with names of their own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of what :func:`cut` returned; no plan may need them any more."""
    file = getattr(df, "_tagloom_file", None)
    if file:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_cut(df: DataFrame) -> bool:
    """Whether a frame is just what :func:`cut` returned."""
    return getattr(df, "_tagloom_cut", False)


def hinted(df: DataFrame, rows: int | None, strategy: str = "auto") -> DataFrame:
    """``df`` as the small side of a join: broadcast only if asked for, or if its known size allows; else adaptive execution decides."""
    if strategy == "broadcast" or strategy == "auto" and rows is not None and rows <= BROADCAST_ROWS:
        return F.broadcast(df)
    if strategy == "repartition":
        return df.hint("shuffle_hash")
    if strategy not in ("auto", "broadcast"):
        raise ValueError(f"no such strategy: {strategy}")
    return df
