"""Tables that a query writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables of this process that are not swept yet.
MADE: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if Spark runs in one local process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints"


def held(df: DataFrame) -> DataFrame:
    """df written and read again: its plan is run once however often it is used, and lost executors don't lose it."""
    path = f"{folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that held() has written in this process, when nothing reads them any more."""
    while MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
