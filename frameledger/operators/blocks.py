"""Running counts along a numeric order without a task for each key: a key's rows are cut into blocks of the order.

A window runs over one block, which holds no more than SIZE numbers of the order; what earlier blocks of the key
add comes from one row a block. So a key that holds any share of all rows is spread over tasks. Keys are not null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order in a block.
SIZE = 1 << 16


def cut(rows: DataFrame, order: str, name: str = "__block", size: int = SIZE) -> DataFrame:
    return rows.withColumn(name, F.floor(F.col(order) / size).cast("long"))


def numbered(rows: DataFrame, keys: list[str], order: str, name: str, size: int = SIZE) -> DataFrame:
    """rows with name: their place, from 0, among the rows of their keys along order, a distinct whole number."""
    placed = cut(rows, order, size=size)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order))
    out = placed.withColumn("__place", inside).join(counts, [*keys, "__block"])
    return out.withColumn(name, (F.col("__base") + F.col("__place") - 1).cast("long")).drop("__block", "__base", "__place")


def islands(rows: DataFrame, keys: list[str], order: str, same: list[str], size: int = SIZE) -> DataFrame:
    """rows with isl (from 1 within their keys) and start: runs along order without gap in which the columns same don't change."""
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    shape = F.struct(order, *same)

    def breaks(now: Column, before: Column) -> Column:
        fits = now[order] == before[order] + 1
        for c in same:
            fits = fits & now[c].eqNullSafe(before[c])
        return F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)

    placed = cut(rows, order, size=size).withColumn("__now", shape)
    # within a block; whether its first row begins a run depends on the block before
    first = F.row_number().over(w) == 1
    marked = placed.withColumn("__break", F.when(first, 0).otherwise(breaks(F.col("__now"), F.lag("__now").over(w))))
    marked = marked.withColumn("__count", F.sum("__break").over(w)).withColumn("__start", F.max(F.when(F.col("__break") == 1, F.col(order))).over(w))
    along = Window.partitionBy(*keys).orderBy("__block")
    ends = marked.groupBy(*keys, "__block").agg(
        F.min_by("__now", order).alias("__first"), F.max_by("__now", order).alias("__last"), F.sum("__break").alias("__breaks"), F.max("__start").alias("__latest"),
    )
    ends = ends.withColumn("__opens", breaks(F.col("__first"), F.lag("__last").over(along)))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("__opens") == 1, F.col("__first")[order])
    carried = F.max(F.coalesce("__latest", own)).over(earlier)
    ends = ends.select(*keys, "__block", (F.coalesce(F.sum(F.col("__breaks") + F.col("__opens")).over(earlier), F.lit(0)) + F.col("__opens")).alias("__base"), F.coalesce(own, carried).alias("__since"))
    out = marked.join(ends, [*keys, "__block"])
    out = out.withColumn("isl", (F.col("__base") + F.col("__count")).cast("long")).withColumn("start", F.coalesce("__start", "__since"))
    return out.drop("__now", "__break", "__count", "__start", "__base", "__since", "__block")


def ranked(rows: DataFrame, order: str, base: int, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with seq, dense behind base in the order of a column. Partitions are sorted ranges; only their counts meet on the driver.

    held writes a table and reads it again, so that ranges are drawn once."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    ranged = held(ranged.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    starts, total = [], base + 1
    for part, n in sorted(ranged.groupBy("__part").count().collect()):
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    return ranged.join(F.broadcast(offsets), "__part").withColumn("seq", F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")
