"""What the operators of this package share: the shared folder, joins on uneven keys, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to Python, where the session leaves Spark's own bound.
BATCH_BYTES = 4 << 20
#: A key with fewer narrow rows than this fits a task. With more, and with a thousandth of all rows, it is split.
HOT_ROWS, HOT_SHARE, SALTS = 1_000_000, 1000, 64
#: Rows of a narrow table in a file; with fewer, a table of known length isn't spread over more files.
FILE_ROWS = 16_384
#: Rows of whole texts or sets in a file, likewise.
FILE_TEXTS = 4096
#: Folders that this process has made and not yet deleted.
MADE: list[str] = []


class Scratch:
    """Parquet tables in the shared folder that the cluster names in spark.checkpoint.dir.

    A written table cuts lineage and survives lost executors. Where the setting is absent and Spark runs
    in one local process, as in tests, a folder under /tmp/checkpoints is set; on a cluster without it
    ValueError is raised. ``drop`` deletes tables that no later step reads; ``sweep`` deletes the rest.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "/tmp/checkpoints"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        MADE.append(self.root)

    def write(self, df: DataFrame, name: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
        """df written and read again. rows: a bound of its length, if known, by which small tables get few files of each rows."""
        path = f"{self.root}/{name}"
        (df if rows is None else few(df, rows, each)).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df in no more partitions than its rows need."""
    return df.coalesce(-(-rows // each) or 1)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, besides: Iterable[str] = ()) -> None:
    """Deletes the scratch folders of this process, when the results that read them have been written."""
    for root in [r for r in MADE if r not in set(besides)]:
        delete(spark, root)
        MADE.remove(root)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, unless it has a bound of its own: whole texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """big joined with small, which has one row for a key, on a key that may hold a large share of big. rows: a bound of big's length, if known.

    Keys with more than a thousandth of big's rows, of which there are fewer than a thousand, are split over SALTS tasks.
    """
    n = big.count() if rows is None else rows
    code = F.xxhash64(key)  # keys may be structs; two keys of one code are split alike
    hot = [r[0] for r in big.groupBy(code).count().where(F.col("count") > max(HOT_ROWS, n // HOT_SHARE)).collect()] if n > HOT_ROWS else []
    if not hot:
        return big.join(small, key, how)
    among, salt = code.isin(hot), unused("salt", big, small)
    told_apart = [c for c, kind in big.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = big.withColumn(salt, F.when(among, F.pmod(F.xxhash64(*told_apart), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = small.withColumn(salt, F.explode(F.when(among, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, salt], how).drop(salt)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like the given one that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def some(df: DataFrame, most: int) -> DataFrame:
    """A side of a join: broadcast if it is counted to have no more rows than most, else joined by shuffling."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch, columns: list[str], most_bytes: int = 4 << 20):
    """Row ranges of an Arrow record batch whose listed columns hold about most_bytes each, one row at least."""
    n, start = batch.num_rows, 0
    if not n:
        return
    step = max(1, int(n * most_bytes / max(1, sum(batch.column(batch.schema.get_field_index(c)).nbytes for c in columns))))
    while start < n:
        yield batch.slice(start, step)
        start += step


def frugal(batches: Iterator) -> Iterator:
    """The batches of a Python step; behind the last one its worker, which lives on, gives its unused memory back."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)
