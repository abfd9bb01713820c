"""Sharding by histogram sort, to shards of near equal bytes.

Rows are ordered by (hash of the text, doc_id). The splitters between shards are found by counting,
over all partitions, the exact bytes in buckets of that order, and then only in those buckets that
hold a splitter, with finer probes each round, until every splitter meets the tolerance. Then the
rows are exchanged once. Equal texts lie together, so a splitter falls between groups of them where
the tolerance allows it; a group too large for that is split by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Hex digits that a round of probes adds to the open prefixes (4096 buckets for each), and digits of a whole place.
STEP, DIGITS = 3, 32


def place(*keys: Column) -> Column:
    """Hex digits whose order is that of the signed 64-bit keys."""
    sign = F.lit(-(2**63)).cast("long")
    return F.concat(*[F.lpad(F.hex(k.bitwiseXOR(sign)), 16, "0") for k in keys])


class Splitter:
    """Looks for the place below which target bytes lie."""

    def __init__(self, target: float):
        self.target, self.prefix, self.below, self.done = target, "", 0, False

    def refine(self, buckets: dict[str, int], tolerance: float) -> None:
        """buckets: bytes of all rows by the digits that follow the prefix."""
        left = self.below
        for digits, size in sorted(buckets.items()):
            right = left + size
            if right >= self.target:
                lower, upper = self.target - left, right - self.target
                self.prefix, self.below = self.prefix + digits, left
                self.done = len(self.prefix) == DIGITS or min(lower, upper) <= tolerance
                if self.done and upper < lower:
                    self.prefix, self.below = following(self.prefix), right
                return
            left = right


def following(prefix: str) -> str:
    """The next prefix of as many digits; 'G' is behind all."""
    return "G" if set(prefix) == {"F"} else f"{int(prefix, 16) + 1:0{len(prefix)}X}"


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[str]:
    """rows: place, size. In a round at most 4096 counts for each splitter come to the driver."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    splitters = [Splitter(total * i / shards) for i in range(1, shards)]
    digits, waiting = 0, splitters if total else []
    while waiting:
        width = min(STEP, DIGITS - digits)
        prefix = F.substring("place", 1, digits)
        probed = rows.where(prefix.isin(sorted({s.prefix for s in waiting}))) if digits else rows
        found: dict[str, dict[str, int]] = {}
        for before, bucket, size in probed.groupBy(prefix, F.substring("place", digits + 1, width)).agg(F.sum("size")).collect():
            found.setdefault(before, {})[bucket] = size
        for s in waiting:
            s.refine(found[s.prefix], tolerance * total / shards)
        digits, waiting = digits + width, [s for s in waiting if not s.done]
    return [s.prefix for s in splitters if s.prefix]


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 1. Each splitter is within tolerance times the mean shard, or
    within one row of its target. slot numbers a shard's rows from 0 in the order of (hash, doc_id).
    Reads doc_id and text; other columns have no effect. A null text has no bytes and hashes as empty; a null
    doc_id sorts first; repeated rows follow one another; an empty table gives no rows. Of documents only
    narrow rows move: hash, id, size and checksum.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.write(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            place(F.xxhash64(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))).alias("place"),
        ),
        "rows",
    )
    number = F.lit(0)
    for splitter in find_splitters(rows, shards, tolerance):
        number = number + F.when(F.col("place") >= splitter, 1).otherwise(0)
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.write(
        rows.withColumn("shard", number.cast("int")).repartitionByRange(count, "place").sortWithinPartitions("place").withColumn("row", F.monotonically_increasing_id()),
        "dealt",
    )
    dealt = dealt.withColumn("part", F.shiftright("row", 33))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row for each partition and splitter, whatever the number of documents
    offsets = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return dealt.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
