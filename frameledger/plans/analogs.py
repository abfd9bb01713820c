"""The catalog's relations as views over the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameledger.operators import blocks, packing
from frameledger.sources.shared import held

GROUP = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations. Every tenth user is outside any run."""
    grouped = F.col("user_id") % 10 != 0
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.concat(F.lit("img-"), F.col("event_id").cast("string")).alias("image_id"),
        F.when(grouped, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("run"), F.when(grouped, F.col("event_type")).alias("stream"),
        (F.floor("value").cast("long") % 3 + 1).alias("width"), F.sha2("props", 256).alias("pixel_sha256"),
    )
    columns = ["seq", "image_id", "run", "stream", "frame_no", "width", "pixel_sha256"]
    inside = blocks.numbered(rows.where("run is not null"), ["run", "stream"], "seq", "frame_no")
    return inside.select(*columns).unionAll(rows.where("run is null").withColumn("frame_no", F.lit(None).cast("long")).select(*columns))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First representation of each image: a PNG object that two consecutive events share."""
    half = F.floor(F.col("event_id") / 2).cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("img-"), F.col("event_id").cast("string")).alias("image_id"), F.lit(1).alias("representation_version"), F.lit("png").alias("representation_kind"),
        F.sha2(half.cast("string"), 256).alias("png_sha"), F.lit(None).cast("string").alias("segment_id"), (half % 900 + 100).alias("png_bytes"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).groupBy(F.col("png_sha").alias("sha256")).agg(F.max("png_bytes").alias("byte_length"))


def grouped(spark: SparkSession, sf_dir: str, runs: DataFrame | None = None) -> DataFrame:
    """Candidates in groups, with a stand-in for the coded size of each group; of the given runs, if any (a bounded number of them)."""
    taken = images(spark, sf_dir) if runs is None else images(spark, sf_dir).join(F.broadcast(runs), "run", "left_semi")
    rows = packing.groups(packing.candidates(taken, stored(spark, sf_dir), objects(spark, sf_dir)), GROUP)
    key = ["run", "stream", "isl", "part"]
    size = F.floor(F.sum("png_bytes").over(Window.partitionBy(*key)) * (F.col("isl") % 7 + 5) / 10).cast("long")
    return rows.withColumn("candidate_bytes", size)


@dataclass(frozen=True)
class Packed:
    """What packing the images gives: written once, as several relations come of it."""

    spark: SparkSession
    sf_dir: str
    rows: DataFrame
    plan: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, runs: DataFrame | None = None) -> Packed:
        rows = held(grouped(spark, sf_dir, runs))
        return cls(spark, sf_dir, rows, held(packing.plan(rows)))

    @cached_property
    def members(self) -> DataFrame:
        return held(packing.members(self.rows, self.plan))

    @cached_property
    def log(self) -> DataFrame:
        """Representation log: every image's PNG, and the segment of those that were packed."""
        second = self.members.select("image_id", F.lit(2).alias("representation_version"), F.lit("temporal_segment").alias("representation_kind"), F.lit(None).cast("string").alias("png_sha"), "segment_id")
        return stored(self.spark, self.sf_dir).drop("png_bytes").unionByName(second)

    @cached_property
    def active(self) -> DataFrame:
        return held(packing.active(self.log))

    @cached_property
    def retired(self) -> DataFrame:
        seq = F.substring("image_id", 5, 20).cast("long") + 1
        state = F.when(seq % 7 == 0, "deleted").when(seq % 5 == 0, "pending").otherwise("retained")
        return packing.retired(self.log).withColumn("prune_state", state)

    @cached_property
    def segments(self) -> DataFrame:
        return self.members.groupBy("segment_id").agg(F.max("frame_count").alias("frame_count"), F.max("segment_bytes").alias("segment_bytes"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects kept as sources: those of every 97th image."""
    return stored(spark, sf_dir).where((F.substring("image_id", 5, 20).cast("long") + 1) % 97 == 0).select(F.col("png_sha").alias("source_sha"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    value = lambda c: F.when(F.col(c) == 1, "true").otherwise("false").alias("value_json")
    both = labels.select("doc_id", F.lit("quality").alias("kind"), F.lit("rule").alias("producer"), value("quality"), F.lit(None).cast("double").alias("confidence")).unionAll(
        labels.select("doc_id", F.lit("toxic"), F.lit("model"), value("toxic"), (F.col("doc_id") % 100).cast("double") / 100)
    )
    # two rows a document in a fixed order: the number needs no global sort
    return both.select((F.col("doc_id") * 2 + F.when(F.col("kind") == "toxic", 2).otherwise(1)).alias("seq"), F.concat(F.lit("img-"), F.col("doc_id").cast("string")).alias("image_id"), "kind", "producer", "value_json", "confidence")


#: DuckDB: the same views.
VIEWS = {
    "images": """select event_id+1 as seq, 'img-'||event_id as image_id, case when user_id%10=0 then null else 'u'||user_id end as run, case when user_id%10=0 then null else event_type end as stream,
 case when user_id%10=0 then null else cast(row_number() over (partition by user_id,event_type order by event_id)-1 as bigint) end as frame_no, cast(floor(value) as bigint)%3+1 as width, sha256(props) as pixel_sha256 from events""",
    "stored": """select 'img-'||event_id as image_id, sha256(cast(event_id//2 as varchar)) as png_sha, (event_id//2)%900+100 as png_bytes from events""",
    "objects": "select png_sha as sha256, max(png_bytes) as byte_length from stored group by 1",
    "judgments": """select doc_id*2+1 as seq, 'img-'||doc_id as image_id, 'quality' as kind, 'rule' as producer, case when quality=1 then 'true' else 'false' end as value_json, cast(null as double) as confidence from labels
 union all select doc_id*2+2, 'img-'||doc_id, 'toxic', 'model', case when toxic=1 then 'true' else 'false' end, cast(doc_id%100 as double)/100 from labels""",
    "candidates": "select i.*, s.png_sha, s.png_bytes from images i join stored s using (image_id) where run is not null",
    "marked": "select *, case when frame_no = lag(frame_no) over w + 1 and width = lag(width) over w then 0 else 1 end as brk from candidates window w as (partition by run,stream order by frame_no)",
    "islands": "select *, cast(sum(brk) over (partition by run,stream order by frame_no) as bigint) as isl from marked",
    "grouped": f"select *, cast(floor((row_number() over (partition by run,stream,isl order by frame_no)-1)/{GROUP}.0) as bigint) as part from islands",
    "plan0": """select run,stream,isl,part, cast(count(*) as bigint) as n, min(frame_no) as first_frame, max(frame_no) as last_frame, cast(floor(sum(png_bytes)*(max(isl)%7+5)/10) as bigint) as candidate_bytes from grouped group by run,stream,isl,part""",
    "plan1": "select run,stream,isl,part, cast(sum(b) as bigint) as png_distinct_bytes from (select run,stream,isl,part,png_sha,max(png_bytes) as b from grouped group by run,stream,isl,part,png_sha) q group by run,stream,isl,part",
    "plan": """select *, case when n<2 then 'skipped' when candidate_bytes>=png_distinct_bytes then 'not_beneficial' else 'packed' end as status,
 case when n<2 then 'insufficient_compatible_frames' when candidate_bytes>=png_distinct_bytes then 'temporal_bytes_not_smaller_than_distinct_png_bytes' else 'temporal_bytes_smaller_than_distinct_png_bytes' end as reason,
 'seg-'||run||'-'||stream||'-'||isl||'-'||part as segment_id from plan0 join plan1 using (run,stream,isl,part)""",
    "members": """select g.seq, g.image_id, g.run, g.stream, g.frame_no, g.width, g.png_sha, p.segment_id, p.n as frame_count, p.candidate_bytes as segment_bytes, cast(row_number() over (partition by p.segment_id order by g.frame_no)-1 as bigint) as frame_index
 from grouped g join plan p using (run,stream,isl,part) where p.status='packed'""",
    "active": """select s.image_id, case when m.segment_id is null then 'png' else 'temporal_segment' end as representation_kind, case when m.segment_id is null then 1 else 2 end as representation_version,
 case when m.segment_id is null then s.png_sha end as png_sha, m.segment_id from stored s left join members m using (image_id)""",
    "retired": "select image_id, png_sha, 1 as representation_version, 2 as replacement_version, case when seq%7=0 then 'deleted' when seq%5=0 then 'pending' else 'retained' end as prune_state from members",
    "sources": "select png_sha from stored where (cast(substr(image_id,5) as bigint)+1)%97=0",
    "live": "select distinct png_sha as sha256 from (select png_sha from active where png_sha is not null union all select png_sha from sources) q",
    "prunable": "select * from objects where sha256 in (select png_sha from retired where prune_state<>'deleted') and sha256 not in (select sha256 from live)",
    "coverage": "select r.png_sha as sha256, cast(count(*) as bigint) as total, cast(count(*) filter (a.representation_version>=r.replacement_version) as bigint) as covered from retired r left join active a on a.image_id=r.image_id and a.representation_kind<>'png' group by 1",
}


def sql(body: str) -> str:
    """A DuckDB statement with the views that it needs in front, each behind those that it reads."""
    import re

    def needs(text: str) -> set[str]:
        found = {v for v in VIEWS if re.search(rf"\b(?:from|join)\s+{v}\b", text)}
        return found.union(*(needs(VIEWS[v]) for v in found)) if found else found

    used = needs(body)
    views = ", ".join(f"{v} as ({VIEWS[v]})" for v in VIEWS if v in used)
    if not views:
        return body
    return f"with {views}, {body.removeprefix('with ')}" if body.startswith("with ") else f"with {views} {body}"
