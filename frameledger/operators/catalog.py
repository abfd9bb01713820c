"""Catalog operators: pages, exact lookups, previous frames, frame numbers, retries, metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

#: Limits of metadata in UTF-8 bytes, and of tags; fixed values.
LIMITS = {"run": 128, "stream": 128, "label": 256, "note": 2048, "tag": 64, "tags": 16, "escaped": 6000}
PAGE_BYTES = 16 * 1024 - 64


def page(rows: DataFrame, limit: int, *, last: int | None = None, high: int | None = None, key: str = "seq", where: dict | None = None) -> DataFrame:
    """Newest-first keyset page of limit + 1 rows, so that the caller sees whether more follow.

    where: equality filters that are present. Filters and limit act before any join, so a page
    is one stage with pushed filters and a top-n.
    """
    tests = [F.col(c) == v for c, v in (where or {}).items() if v is not None]
    tests += [F.col(key) <= high] if high is not None else []
    tests += [F.col(key) < last] if last is not None else []
    rows = rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows
    return rows.orderBy(F.desc(key)).limit(limit + 1)


def high_water(rows: DataFrame, key: str = "seq") -> DataFrame:
    """Highest key, 0 for none: the snapshot that a cursor pins."""
    return rows.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("high"))


def images_of(images: DataFrame, run: str | None = None, stream: str | None = None) -> DataFrame:
    """Images by filters that may be absent."""
    for name, value in (("run", run), ("stream", stream)):
        images = images if value is None else images.where(F.col(name) == value)
    return images


def with_next(found: DataFrame, limit: int, key: str = "seq") -> DataFrame:
    """The first limit rows of a page of limit + 1, with next_last on the last one if another follows."""
    place, more = F.row_number().over(Window.orderBy(F.desc(key))), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    rows = found.withColumns({"__place": place, "__n": more}).where(F.col("__place") <= limit)
    return rows.withColumn("next_last", F.when((F.col("__place") == limit) & (F.col("__n") > limit), F.col(key))).drop("__place", "__n")


def byte_budget(rows: DataFrame, size: Column, budget: int = PAGE_BYTES, key: str = "seq") -> DataFrame:
    """The longest newest-first prefix of a bounded page whose sizes add up to the budget at most."""
    w = Window.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_bytes", F.sum(size).over(w).cast("long")).where(F.col("running_bytes") <= budget)


def frame(rows: DataFrame, run: str, stream: str, frame_no: int) -> DataFrame:
    """The row of an exact frame, never a nearest one."""
    return rows.where((F.col("run") == run) & (F.col("stream") == stream) & (F.col("frame_no") == frame_no))


def previous_frame(images: DataFrame) -> DataFrame:
    """Each image beside the frame before it in its run and stream, if that number exists.

    An equi-join on the frame number, so a camera with any share of the frames is spread over tasks."""
    before = images.where("run is not null").select(
        F.col("run").alias("__run"), F.col("stream").alias("__stream"), (F.col("frame_no") + 1).alias("__next"), F.col("image_id").alias("previous_image_id"), F.col("pixel_sha256").alias("__pixels"),
    )
    same = (F.col("run") == F.col("__run")) & (F.col("stream") == F.col("__stream")) & (F.col("frame_no") == F.col("__next"))
    return images.join(before, same, "left").select("seq", "image_id", "run", "stream", "frame_no", "previous_image_id", (F.col("__pixels") == F.col("pixel_sha256")).alias("same_pixels"))


def allocate_frames(batch: DataFrame, existing: DataFrame, order: str = "seq") -> DataFrame:
    """Frame numbers of a batch: dense and zero-based in each run and stream, behind those that exist. No run, no number.

    order is a distinct whole number in each row."""
    base = existing.where("run is not null").groupBy("run", "stream").agg((F.max("frame_no") + 1).alias("base"))
    inside = blocks.numbered(batch.where("run is not null"), ["run", "stream"], order, "place").join(base, ["run", "stream"], "left")
    inside = inside.withColumn("new_frame_no", F.col("place") + F.coalesce("base", F.lit(0))).drop("place", "base")
    return inside.unionByName(batch.where("run is null").withColumn("new_frame_no", F.lit(None).cast("long")))


def backfill_frames(images: DataFrame) -> DataFrame:
    """Frame numbers for images of the first schema, which knows runs but no streams."""
    inside = blocks.numbered(images.where("run is not null"), ["run"], "seq", "frame_no").withColumn("stream", F.lit("default"))
    return inside.unionByName(images.where("run is null").withColumn("stream", F.lit(None).cast("string")).withColumn("frame_no", F.lit(None).cast("long")))


def retries(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """What a repeated operation_id leads to: 'reuse' on the same fingerprint, else 'conflict'; new ones are 'insert'.

    Where existing has fingerprint_version and batch fingerprint_v1, operations of the first version are held against that."""
    versions = "fingerprint_version" in existing.columns
    older = F.coalesce(F.col("fingerprint_version") == 1, F.lit(False)) if versions else F.lit(False)
    known = existing.where("operation_id is not null").select("operation_id", F.col("fingerprint").alias("known"), F.col("image_id").alias("known_image_id"), older.alias("older"))
    own = F.when(F.col("older"), F.col("fingerprint_v1")).otherwise(F.col("fingerprint")) if versions and "fingerprint_v1" in batch.columns else F.col("fingerprint")
    outcome = F.when(F.col("known").isNull(), "insert").when(F.col("known") == own, "reuse").otherwise("conflict")
    return batch.join(known, "operation_id", "left").withColumn("outcome", outcome).drop("known", "older")


def insert_absent(batch: DataFrame, existing: DataFrame, key: str = "sha256") -> DataFrame:
    """One row for each new key of a batch."""
    return batch.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def normalise_metadata(rows: DataFrame, escaped: int = LIMITS["escaped"]) -> DataFrame:
    """Empty run, label and note become null; tags are sorted by bytes and distinct; error names the first limit broken."""
    empty = {c: F.nullif(F.col(c), F.lit("")) for c in ("run", "label", "note")}
    rows = rows.withColumns(empty | {"tags": F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))})
    too_long = reduce(lambda a, b: a | b, [F.coalesce(F.octet_length(c) > LIMITS[c], F.lit(False)) for c in ("run", "stream", "label", "note")])
    tags = (F.size("tags") > LIMITS["tags"]) | F.exists("tags", lambda t: (t == "") | (F.octet_length(t) > LIMITS["tag"]))
    invalid = (F.col("stream") == "") | (F.col("run").isNull() & F.col("stream").isNotNull())
    given = F.col("captured_at") if "captured_at" in rows.columns else F.lit(None).cast("string")
    size = F.octet_length(json_array(F.col("run"), F.col("stream"), F.col("label"), F.col("note"), F.col("tags"), given))
    large = too_long | tags | (size > escaped)
    return rows.withColumn("error", F.when(F.coalesce(invalid, F.lit(False)), "E_INVALID_ARGUMENT").when(large, "E_LIMIT_EXCEEDED"))


def json_array(*fields: Column) -> Column:
    """The JSON text of an array of fields, null ones included."""

    def one(f: Column) -> Column:
        text = F.to_json(F.array(f))
        return F.when(f.isNull(), "null").otherwise(text.substr(F.lit(2), F.length(text) - 2))

    return F.concat(F.lit("["), F.concat_ws(",", *map(one, fields)), F.lit("]"))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the JSON array of an operation's fields."""
    return F.sha2(json_array(*fields), 256)


def object_path(sha: Column, extension: Column | str) -> Column:
    """Content address of an object; null for what is not a lower-case hash."""
    ext = F.lit(extension) if isinstance(extension, str) else extension
    return F.when(sha.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("objects/sha256/"), sha.substr(1, 2), F.lit("/"), sha.substr(3, 2), F.lit("/"), sha, F.lit("."), ext))


def info(images: DataFrame, representations: DataFrame, objects: DataFrame, locations: DataFrame, segments: DataFrame, descriptors: DataFrame | None = None) -> DataFrame:
    """Images with the form they are stored in: own object, or place in a segment. stored_bytes of a segment are shared by its images,
    with the image's own descriptor if descriptors (image_id, descriptor_byte_length) are given."""
    png = objects.select(F.col("sha256").alias("png_sha"), F.col("byte_length").alias("png_bytes"))
    placed = locations.join(segments.select("segment_id", "frame_count", "segment_bytes"), "segment_id")
    out = images.join(representations, "image_id").join(png, "png_sha", "left").join(placed, ["image_id", "segment_id"], "left")
    own = F.col("representation_kind") == "png"
    out = out.withColumn("descriptor_byte_length", F.lit(0)) if descriptors is None else out.join(descriptors.select("image_id", "descriptor_byte_length"), "image_id", "left")
    return out.select(
        "seq", "image_id", "run", "stream", "frame_no", "representation_kind", "representation_version", "segment_id", "frame_index",
        F.when(own, F.col("png_bytes")).otherwise(F.col("segment_bytes") + F.coalesce("descriptor_byte_length", F.lit(0))).cast("long").alias("stored_bytes"),
        F.when(own, F.lit(1)).otherwise(F.col("frame_count")).cast("long").alias("shared_image_count"),
    )


def info_page(page: DataFrame, log: DataFrame, objects: DataFrame, locations: DataFrame, segments: DataFrame, descriptors: DataFrame | None = None) -> DataFrame:
    """info of a bounded page, from the representation log itself: its ids cut every relation first, so that nothing is
    aggregated or joined but what the page needs."""
    from .packing import active

    ids = F.broadcast(page.select("image_id"))
    now = active(log.join(ids, "image_id", "left_semi"))
    placed = locations.join(ids, "image_id", "left_semi")
    parts = segments.join(F.broadcast(placed.select("segment_id").distinct()), "segment_id", "left_semi")
    own = objects.join(F.broadcast(now.where("png_sha is not null").select(F.col("png_sha").alias("sha256"))), "sha256", "left_semi")
    return info(page, now, own, placed, parts, None if descriptors is None else descriptors.join(ids, "image_id", "left_semi"))
