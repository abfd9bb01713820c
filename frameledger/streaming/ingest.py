"""Folders of images as a stream into a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameledger.sources.ledger import Ledger

FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, *, run: str | None = None, glob: str = "*.png", once: bool = True) -> StreamingQuery:
    """Puts every new image of a folder. A batch that runs again stores nothing twice: the operation of a row is its path and content,
    so a file that changed is another image whatever its length. What became of each file is kept, see ``outcomes``."""
    source = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    def put(batch: DataFrame, number: int) -> None:
        operation = F.sha2(F.concat_ws("|", "path", F.sha2("content", 256)), 256)
        rows = batch.select(F.col("path").alias("key"), "content", F.lit(run).cast("string").alias("run"), operation.alias("operation_id"))
        got = Ledger.open(batch.sparkSession, root).put(rows)
        got.write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}/outcomes/batch={number}")

    stream = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def outcomes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key (path), image_id, outcome, error and batch of every file that a stream with this checkpoint has seen."""
    return spark.read.schema("key string, image_id string, outcome string, error string, batch long").parquet(f"{checkpoint.rstrip('/')}/outcomes")
