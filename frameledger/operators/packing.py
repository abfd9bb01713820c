"""Packing: groups of consecutive compatible frames, the keep-whichever-is-smaller rule, representations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

SHAPE = ("width", "height", "bit_depth", "color_type")


def candidates(images: DataFrame, representations: DataFrame, objects: DataFrame, *, run: str | None = None, stream: str | None = None, high: int | None = None) -> DataFrame:
    """Images that are still stored as a PNG of their own, up to a frozen seq."""
    rows = images.where("run is not null")
    for test in ([F.col("run") == run] if run else []) + ([F.col("stream") == stream] if stream else []) + ([F.col("seq") <= high] if high is not None else []):
        rows = rows.where(test)
    png = representations.where("representation_kind = 'png'").select("image_id", "representation_version", "png_sha")
    return rows.join(png, "image_id").join(objects.select(F.col("sha256").alias("png_sha"), F.col("byte_length").alias("png_bytes")), "png_sha")


def groups(rows: DataFrame, size: int) -> DataFrame:
    """rows with isl and part: runs of frames without gap and of one shape, cut into groups of size frames.

    Windows run over blocks of frame numbers, so a camera with any share of the frames is spread over tasks.
    """
    shape = [c for c in SHAPE if c in rows.columns]
    out = blocks.islands(rows.where("run is not null"), ["run", "stream"], "frame_no", shape)
    return out.withColumn("part", F.floor((F.col("frame_no") - F.col("start")) / size).cast("long")).drop("start")


def plan(grouped: DataFrame) -> DataFrame:
    """One row per group: n, first and last frame, bytes of its distinct objects, candidate bytes, decision.

    A group keeps its objects unless the coded segment is strictly smaller than the distinct objects. candidate_bytes
    must be a column of grouped: what coding the group would take, the same in each row.
    """
    key = ["run", "stream", "isl", "part"]
    distinct = grouped.groupBy(*key, "png_sha").agg(F.max("png_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("frame_no").alias("first"), F.max("frame_no").alias("last"), F.max("candidate_bytes").alias("candidate_bytes"))
    out = distinct.groupBy(*key).agg(
        F.sum("n").cast("long").alias("n"), F.min("first").alias("first_frame"), F.max("last").alias("last_frame"), F.sum("bytes").cast("long").alias("png_distinct_bytes"),
        F.max("candidate_bytes").cast("long").alias("candidate_bytes"),
    )
    status = F.when(F.col("n") < 2, "skipped").when(F.col("candidate_bytes") >= F.col("png_distinct_bytes"), "not_beneficial").otherwise("packed")
    reason = F.when(F.col("n") < 2, "insufficient_compatible_frames").when(F.col("candidate_bytes") >= F.col("png_distinct_bytes"), "temporal_bytes_not_smaller_than_distinct_png_bytes").otherwise("temporal_bytes_smaller_than_distinct_png_bytes")
    segment = F.concat_ws("-", F.lit("seg"), "run", "stream", F.col("isl").cast("string"), F.col("part").cast("string"))
    return out.withColumn("status", status).withColumn("reason", reason).withColumn("segment_id", segment)


def decided(planned: DataFrame) -> DataFrame:
    """A plan's status and reason where groups may have failed (error) or hold no frame that is predicted from another."""
    skipped = F.col("status") == "skipped"
    own = ~skipped & F.col("error").isNull() & ~F.coalesce("inter_predicted", F.lit(True))
    status = F.when(skipped, F.col("status")).when(F.col("error").isNotNull(), "failed").when(own, "not_beneficial").otherwise(F.col("status"))
    reason = F.when(skipped, F.col("reason")).when(F.col("error").isNotNull(), F.col("error")).when(own, "no_inter_prediction").otherwise(F.col("reason"))
    return planned.withColumns({"status": status, "reason": reason})


def report(planned: DataFrame) -> DataFrame:
    """Totals of a plan."""
    packed, coded = F.col("status") == "packed", ~F.col("status").isin("skipped", "failed")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    count = lambda status: F.count_if(F.col("status") == status).cast("long")
    images = lambda status: total(F.when(F.col("status") == status, F.col("n")))
    return planned.agg(
        F.count(F.lit(1)).cast("long").alias("groups_considered"), total("n").alias("candidate_images"), count("packed").alias("segments_packed"), images("packed").alias("images_packed"),
        count("not_beneficial").alias("segments_not_beneficial"), images("not_beneficial").alias("images_not_beneficial"), images("skipped").alias("images_skipped"), count("failed").alias("segments_failed"),
        total(F.when(coded, F.col("png_distinct_bytes"))).alias("png_distinct_bytes"), total(F.when(coded, F.col("candidate_bytes"))).alias("temporal_candidate_bytes"), total(F.when(packed, F.col("candidate_bytes"))).alias("published_object_bytes"),
    )


def members(grouped: DataFrame, planned: DataFrame) -> DataFrame:
    """Images of packed segments with their frame index."""
    key = ["run", "stream", "isl", "part"]
    packed = planned.where("status = 'packed'").select(*key, "segment_id", F.col("n").alias("frame_count"), F.col("candidate_bytes").alias("segment_bytes"))
    index = F.row_number().over(Window.partitionBy(*key).orderBy("frame_no")).cast("long") - 1
    return grouped.withColumn("frame_index", index).join(packed, key)


def active(log: DataFrame) -> DataFrame:
    """The newest representation of each image in an append-only log."""
    return log.groupBy("image_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "image_id"]), "representation_version").alias("r")).select("image_id", "r.*")


def retired(log: DataFrame) -> DataFrame:
    """Representations of the log that have a successor, with the version that replaced them."""
    w = Window.partitionBy("image_id").orderBy("representation_version")
    return log.withColumn("replacement_version", F.lead("representation_version").over(w)).where("replacement_version is not null")


def activation(expected: DataFrame, log: DataFrame) -> DataFrame:
    """Segments that may become active: all members still have the version and object that the plan saw."""
    now = active(log).select("image_id", F.col("representation_version").alias("now_version"), F.col("representation_kind").alias("now_kind"), F.col("png_sha").alias("now_sha"))
    moved = ~((F.col("now_version") == F.col("representation_version")) & (F.col("now_kind") == "png") & (F.col("now_sha") == F.col("png_sha")))
    return expected.join(now, "image_id", "left").groupBy("segment_id").agg(F.coalesce(F.bool_or(F.coalesce(moved, F.lit(True))), F.lit(False)).alias("moved")).withColumn("reason", F.when(F.col("moved"), "concurrent_representation_change"))


def decode_memory(width, height, alpha, container_bytes, descriptor_bytes):
    """Bytes that decoding a frame may take: three planes and twelve surfaces of a stream, four copies of the samples, two of the stored bytes, and 32 MiB."""
    pixels = width.cast("long") * height.cast("long")
    streams, channels = F.when(alpha, 2).otherwise(1), F.when(alpha, 4).otherwise(3)
    return pixels * streams * 36 + pixels * channels * 4 + container_bytes * 2 + descriptor_bytes * 2 + (32 << 20)


def decode_bytes(width: int, height: int, alpha: bool, container_bytes: int, descriptor_bytes: int) -> int:
    """decode_memory of one segment."""
    pixels = width * height
    return pixels * (2 if alpha else 1) * 36 + pixels * (4 if alpha else 3) * 4 + container_bytes * 2 + descriptor_bytes * 2 + (32 << 20)


def encode_memory(width, height, alpha, png_bytes):
    """Bytes that coding a group may take: surfaces of the streams, four copies of a frame's samples, three of the largest file, and 32 MiB."""
    pixels = width.cast("long") * height.cast("long")
    return pixels * F.when(alpha, 2).otherwise(1) * 36 + pixels * F.when(alpha, 4).otherwise(3) * 4 + png_bytes * 3 + (32 << 20)


def guard(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """Candidates, and whether they are more than a pack takes."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("images")).withColumn("refused", F.col("images") > most)


def largest_descriptor(places: DataFrame, descriptors: DataFrame) -> DataFrame:
    """segment_id and the bytes of its largest descriptor, 0 if it has none. places: image_id, segment_id."""
    rows = places.select("image_id", "segment_id").join(descriptors.select("image_id", "descriptor_byte_length"), "image_id", "left")
    return rows.groupBy("segment_id").agg(F.coalesce(F.max("descriptor_byte_length"), F.lit(0)).cast("long").alias("descriptor_bytes"))


def located(active: DataFrame, places: DataFrame, segments: DataFrame) -> DataFrame:
    """Active representations in segments with their place, by image and segment, and the segment's header."""
    now = active.where("segment_id is not null").select("image_id", "segment_id", "representation_version")
    return now.join(places, ["image_id", "segment_id"]).join(segments, "segment_id")


def mixed_segments(members: DataFrame) -> DataFrame:
    """Segments whose images differ in width, which no group may."""
    return members.groupBy("segment_id").agg(F.count_distinct("width").alias("widths")).where("widths > 1")
