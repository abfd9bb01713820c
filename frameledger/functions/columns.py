"""Byte functions as columns: Arrow batches in, structs out. Whole relations go through; a broken image is a row with a code."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameledger.errors import LedgerError

from . import codec, container, png, pngr

META = "width int, height int, bit_depth int, color_type int, scanline_sha256 string, non_idat_sha256 string, pixel_sha256 string"
NAMES = [f.split()[0] for f in META.split(", ")]
HASHES = NAMES[-3:]
#: Bytes of samples in a batch that leaves a Python step.
BATCH_BYTES = 4 << 20


def attempt(work, *args) -> tuple[str | None, object]:
    try:
        return None, work(*args)
    except LedgerError as error:
        return error.code, None


def per_row(df: DataFrame, schema: str, work, together: int = 64) -> DataFrame:
    """Applies work(row dict) -> row dict to Arrow batches of df, to a few rows with large binaries at a time."""
    target = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                yield pa.RecordBatch.from_pylist([work(r) for r in batch.slice(at, together).to_pylist()], schema=target)

    return df.mapInArrow(run, schema)


def limit_error(source: Column, width: Column, height: Column, channels: Column, limits: png.Limits = png.Limits()) -> Column:
    """E_LIMIT_EXCEEDED where an image of that size would be refused, before any of it is read."""
    w, h = width.cast("decimal(20,0)"), height.cast("decimal(20,0)")
    inflated = h * (w * channels.cast("decimal(2,0)") + 1)
    memory = source.cast("decimal(20,0)") * 3 + inflated * 4 + png.HEADROOM
    large = (source > limits.source_bytes) | (F.greatest(w, h) > limits.max_edge) | (w * h > limits.pixels) | (inflated > limits.inflated_bytes) | (memory > limits.memory_bytes)
    return F.when(large, "E_LIMIT_EXCEEDED")


def png_meta(df: DataFrame, limits: png.Limits = png.Limits()) -> DataFrame:
    """df(key string, content binary) to key, error and the image's meta data."""

    def work(row: dict) -> dict:
        error, found = attempt(lambda: png.meta(png.parse(row["content"] or b"", limits)))
        return {"key": row["key"], "error": error} | (found or dict.fromkeys(NAMES))

    return per_row(df.select("key", "content"), f"key string, error string, {META}", work)


def png_repack(df: DataFrame, level: int = 6, limits: png.Limits = png.Limits()) -> DataFrame:
    """df(key, content) to key, error, content (never larger), compression_applied and the meta data."""

    def work(row: dict) -> dict:
        error, found = attempt(png.repack, row["content"] or b"", level, limits)
        content, applied, meta = found or (None, None, dict.fromkeys(NAMES))
        return {"key": row["key"], "error": error, "content": content, "compression_applied": applied} | meta

    return per_row(df.select("key", "content"), f"key string, error string, content binary, compression_applied boolean, {META}", work)


def png_roundtrip(df: DataFrame) -> DataFrame:
    """df(key, content) to key, error and whether the image rebuilt from descriptor and samples has the same three hashes."""

    def work(row: dict) -> dict:
        def both():
            descriptor, samples, meta = pngr.extract(row["content"] or b"")
            again = png.meta(png.parse(pngr.rebuild(descriptor, samples, meta)))
            return len(descriptor), again == meta, meta["pixel_sha256"]

        error, found = attempt(both)
        size, same, pixels = found or (None, None, None)
        return {"key": row["key"], "error": error, "descriptor_bytes": size, "same": same, "pixel_sha256": pixels}

    return per_row(df.select("key", "content"), "key string, error string, descriptor_bytes long, same boolean, pixel_sha256 string", work)


@dataclass(frozen=True)
class PackLimits:
    """Limits of a pack; a group beyond one of them fails, max_images refuses the whole pack."""

    max_images: int = 100_000
    segment_bytes: int = 128 << 20
    segment_packets: int = 1024
    descriptor_bytes: int = 64 << 20
    encode_seconds: float = 300.0
    image: png.Limits = png.Limits()


FRAME = "image_id string, frame_index int, descriptor_sha string, descriptor binary"
SEGMENT = f"group_id string, error string, segment_id string, descriptor_json string, width int, height int, frame_count int, color binary, alpha binary, coded_bytes long, descriptor_bytes long, inter_predicted boolean, frames array<struct<{FRAME.replace(' ', ':').replace(',:', ',')}>>"


class Coder:
    """Codes the frames of one group as they come; what it holds are coded packets and the distinct descriptors."""

    def __init__(self, group_id: str, limits: PackLimits):
        self.group_id, self.limits, self.began = group_id, limits, time.monotonic()
        self.error, self.shape, self.images, self.pixels, self.descriptors, self.places = None, None, [], [], {}, []
        self.color, self.alpha = codec.Encoder(), codec.Encoder()

    def push(self, row: dict) -> None:
        if self.error:
            return
        try:
            if "samples" in row:
                samples = np.frombuffer(row["samples"], np.uint8).reshape(row["height"], row["width"], row["channels"])
                descriptor, meta = b"", {"pixel_sha256": png.sha(row["samples"])}
            else:
                descriptor, samples, meta = pngr.extract(row["content"], self.limits.image)
                if any(meta[c] != row[c] for c in HASHES):
                    raise LedgerError("E_INTEGRITY", "an image differs from the catalog")
            self.shape = self.shape or samples.shape
            color, alpha = codec.split_alpha(samples)
            self.color.push(color)
            if alpha is not None:
                self.alpha.push(alpha)
            key = png.sha(descriptor)
            self.places.append({"image_id": row["image_id"], "frame_index": len(self.places), "descriptor_sha": key, "descriptor": None if key in self.descriptors else descriptor})
            self.descriptors[key] = len(descriptor)
            self.pixels.append(meta["pixel_sha256"])
            if sum(self.descriptors.values()) > self.limits.descriptor_bytes or time.monotonic() - self.began > self.limits.encode_seconds:
                raise LedgerError("E_LIMIT_EXCEEDED", "group")
        except LedgerError as refused:
            self.error = refused.code

    def row(self) -> dict:
        out = dict.fromkeys(f.split()[0] for f in SEGMENT.split("array<")[0].split(", ")) | {"group_id": self.group_id, "frames": []}
        try:
            if self.error:
                raise LedgerError(self.error)
            height, width, channels = self.shape
            streams = [self.color.finish(), self.alpha.finish() if channels == 4 else None]
            color, alpha = (container.encode(width, height, len(s), s) if s else None for s in streams)
            coded = len(color) + len(alpha or b"")
            if coded > self.limits.segment_bytes or len(streams[0]) > self.limits.segment_packets:
                raise LedgerError("E_LIMIT_EXCEEDED", "segment")
            descriptor = container.describe(codec.NAME, width, height, len(streams[0]), channels)
            self.check(descriptor, color, alpha)
        except LedgerError as refused:
            return out | {"error": refused.code}
        parts = (png.sha(color), png.sha(alpha) if alpha else None)
        return out | {
            "segment_id": container.segment_id(descriptor.encode(), *parts, [p["image_id"] for p in self.places]), "descriptor_json": descriptor, "width": width, "height": height, "frame_count": len(self.places),
            "color": color, "alpha": alpha, "coded_bytes": coded, "descriptor_bytes": sum(self.descriptors.values()), "inter_predicted": any(not p.key for p in streams[0]), "frames": self.places,
        }

    def check(self, descriptor: str, color: bytes, alpha: bytes | None) -> None:
        """The coded segment decodes to the frames that went in."""
        for samples, want in zip(samples_of(descriptor, color, alpha), self.pixels, strict=True):
            if png.sha(samples.tobytes()) != want:
                raise LedgerError("E_CODEC_FAILURE", "a segment doesn't decode to its frames")


def samples_of(descriptor: str, color: bytes, alpha: bytes | None) -> Iterator[np.ndarray]:
    """The frames of a stored segment one after another."""
    body, packets, more = container.sequence(descriptor, color, alpha)
    codec.require(body["codec"])
    shape = (body["height"], body["width"])
    planes = codec.decode(more, (*shape, 1)) if more else None
    for frame in codec.decode(packets, (*shape, 3)):
        yield codec.merge_alpha(frame, next(planes) if planes else None)


def schema_of(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text))


def encode_groups(frames: DataFrame, limits: PackLimits = PackLimits()) -> DataFrame:
    """One row of SEGMENT for each group_id of frames(group_id, frame_no, image_id, content and HASHES); error is set where a group fails.
    In place of content and HASHES there may be width, height, channels and samples.

    A group's frames come to a task in order and are coded one by one, so neither its files nor its samples are held together.
    """
    target = schema_of(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if coder is None or coder.group_id != row["group_id"]:
                    if coder:
                        yield pa.RecordBatch.from_pylist([coder.row()], schema=target)
                    coder = Coder(row["group_id"], limits)
                coder.push(row)
        if coder:
            yield pa.RecordBatch.from_pylist([coder.row()], schema=target)

    chosen = frames.select("group_id", "frame_no", "image_id", *(["width", "height", "channels", "samples"] if "samples" in frames.columns else ["content", *HASHES]))
    return chosen.repartition("group_id").sortWithinPartitions("group_id", "frame_no").mapInArrow(run, SEGMENT)


def decode_segments(segments: DataFrame) -> DataFrame:
    """segment_id, frame_index and samples of every frame of segments(segment_id, descriptor_json, color, alpha); each is decoded once."""
    schema = "segment_id string, frame_index int, samples binary"
    target = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                held, size = [], 0
                for i, samples in enumerate(samples_of(row["descriptor_json"], row["color"], row["alpha"])):
                    held.append({"segment_id": row["segment_id"], "frame_index": i, "samples": samples.tobytes()})
                    size += samples.nbytes
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=target)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=target)

    return segments.select("segment_id", "descriptor_json", "color", "alpha").mapInArrow(run, schema)


def segment_issues(segments: DataFrame) -> DataFrame:
    """segment_id and code of segments that don't decode to their images.

    segments: segment_id, descriptor_json, color, alpha and frames, an array of frame_index, descriptor and the image's meta data.
    """

    def work(row: dict) -> dict:
        def check() -> None:
            frames = sorted(row["frames"], key=lambda f: f["frame_index"])
            body = container.sequence(row["descriptor_json"], row["color"] or b"", row["alpha"])[0]
            if [f["frame_index"] for f in frames] != list(range(body["frame_count"])):
                raise LedgerError("E_INTEGRITY", "members")
            for frame, samples in zip(frames, samples_of(row["descriptor_json"], row["color"], row["alpha"]), strict=True):
                pngr.rebuild(frame["descriptor"] or b"", samples, frame)

        return {"segment_id": row["segment_id"], "code": attempt(check)[0]}

    return per_row(segments.select("segment_id", "descriptor_json", "color", "alpha", "frames"), "segment_id string, code string", work, 1).where("code is not null")
