"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from engramlake.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where the session names none, a temporary one on a local master, and an error on a
    cluster, whose executors don't see the driver's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="engramlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str = "round", compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table; it outlives the executors that made it.  The
    package is sent to the executors first, so operators may be called without a registered query."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that :func:`cut` wrote, once no plan in use reads it."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
