"""Exact deduplication by a 128-bit content hash with a byte comparison inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, some, spread_join

#: The characters [\x20\x09-\x0D], which equality ignores.
BLANKS = " \t\n\x0b\x0c\r"
#: Ids that are broadcast at most to choose texts; with more those are shuffled once.
MOST_IDS = 1 << 20


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of the normalised text, written once in narrow rows. The texts of hash groups
    with several rows are read again and grouped by the normalised bytes themselves, so that two texts with one
    hash stay apart. Each task first reduces its own rows to one per text, and groups that hold a large
    share of all rows are split, so no group of any size lies in one task. The member with the most code points
    in its original text stays, then the one with the smallest doc_id.

    Reads doc_id and text; other columns have no effect. A null text counts as empty. A null doc_id comes
    last among equals. Repeated rows count in group_size and are all kept or all dropped with their id.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).cast("binary").alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
    # one decimal, which a hash aggregate holds in place, orders members by code points and then by small ids
    edge = F.lit("9223372036854775808").cast("decimal(20,0)")
    small = F.coalesce((edge - F.col("doc_id")).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    rank = F.concat(F.col("points").cast("string"), F.lpad(small.cast("string"), 20, "0")).cast("decimal(38,0)")
    rest = F.right(F.col("rank").cast("string"), F.lit(20)).cast("decimal(20,0)")
    key = F.unhex(F.md5("norm")).alias("hash")
    members = scratch.write(rows.select("doc_id", key, F.unhex(F.sha2("norm", 256)).alias("sha")), "members")
    most = members.count()
    several = scratch.write(members.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "several", most)
    ids = scratch.write(spread_join(members, several, "hash", "left_semi", most).select(F.col("doc_id").alias("id")).distinct(), "ids", most)
    again = rows.join(some(ids, MOST_IDS), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    groups = again.select(key, "norm", rank.alias("rank")).groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("rank"))
    place = F.struct("hash", "sha").alias("place")
    groups = groups.select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", F.when(rest > 0, (edge - rest).cast("long")).alias("keep_id")).where("group_size > 1")
    groups = scratch.write(groups.select(place, "group_size", "keep_id"), "groups")
    scratch.drop("several", "ids")
    out = spread_join(members.select("doc_id", place), groups, "place", rows=most)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("place.sha")).alias("text_sha256")
    )


#: DuckDB, for the query's columns.
ORACLE = r"""
with t as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id,
  cast(count(*) over (partition by norm) as bigint) as group_size,
  doc_id = first_value(doc_id) over (partition by norm order by points desc, doc_id) as kept, sha256(norm) as text_sha256
from t
"""
