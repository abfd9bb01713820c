"""Segment containers: packets of one coded sequence."""

from __future__ import annotations

import hashlib
import json
import struct
from dataclasses import dataclass

from frameledger.errors import LedgerError

#: Fixed layout, big-endian: magic, version, width, height, frames, packets; for each packet length, pts, duration, flags, data.
MAGIC, VERSION = b"VSVP9S\0\0", 1
HEAD, PACKET = struct.Struct(">8sHIIII"), struct.Struct(">IqQB")
KEY, HIDDEN = 1, 2


@dataclass(frozen=True)
class Packet:
    data: bytes
    pts: int
    duration: int = 1
    key: bool = False
    hidden: bool = False


def encode(width: int, height: int, frames: int, packets: list[Packet]) -> bytes:
    return HEAD.pack(MAGIC, VERSION, width, height, frames, len(packets)) + b"".join(PACKET.pack(len(p.data), p.pts, p.duration, KEY * p.key | HIDDEN * p.hidden) + p.data for p in packets)


def decode(data: bytes, most_bytes: int = 128 << 20, most_packets: int = 1024) -> tuple[int, int, int, list[Packet]]:
    """width, height, frames and packets; anything that is not exactly the layout is refused."""
    broken = LedgerError("E_INTEGRITY", "segment container")
    if len(data) > most_bytes:
        raise LedgerError("E_LIMIT_EXCEEDED", "segment bytes")
    if len(data) < HEAD.size:
        raise broken
    magic, version, width, height, frames, count = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise broken
    if version != VERSION:
        raise LedgerError("E_SCHEMA_VERSION", "segment container")
    if count > most_packets:
        raise LedgerError("E_LIMIT_EXCEEDED", "segment packets")
    if not width or not height or not frames or not count:
        raise broken
    at, packets = HEAD.size, []
    for i in range(count):
        if len(data) - at < PACKET.size:
            raise broken
        size, pts, duration, flags = PACKET.unpack_from(data, at)
        at += PACKET.size
        if size > len(data) - at or flags & ~3 or not 0 <= pts < frames or not duration or (i == 0 and not flags & KEY):
            raise broken
        packets.append(Packet(data[at : at + size], pts, duration, bool(flags & KEY), bool(flags & HIDDEN)))
        at += size
    if at != len(data):
        raise broken
    return width, height, frames, packets


def segment_id(descriptor: bytes, color_sha: str, alpha_sha: str | None, image_ids: list[str]) -> str:
    """Identity of a segment by its parts, each behind its length."""
    parts = [descriptor, color_sha.encode(), *([alpha_sha.encode()] if alpha_sha else []), *(i.encode() for i in image_ids)]
    return hashlib.sha256(b"".join(struct.pack(">Q", len(p)) + p for p in parts)).hexdigest()


#: Pixel layouts by channels, and bytes of a segment's descriptor at most; fixed values.
LAYOUTS = {3: "rgb8", 4: "rgba8"}
MOST_DESCRIPTOR = 16 << 10


def describe(codec: str, width: int, height: int, frames: int, channels: int) -> str:
    """The descriptor of a segment: canonical JSON."""
    return json.dumps({"codec": codec, "frame_count": frames, "height": height, "pixel_layout": LAYOUTS[channels], "width": width}, sort_keys=True, separators=(",", ":"))


def sequence(descriptor: str, color: bytes, alpha: bytes | None, most_bytes: int = 128 << 20) -> tuple[dict, list[Packet], list[Packet] | None]:
    """Descriptor and packets of a stored segment, whose parts must agree with one another."""
    broken = LedgerError("E_INTEGRITY", "segment descriptor")
    if len(descriptor.encode()) > MOST_DESCRIPTOR:
        raise LedgerError("E_LIMIT_EXCEEDED", "segment descriptor")
    try:
        body = json.loads(descriptor)
    except ValueError as error:
        raise broken from error
    if not isinstance(body, dict) or set(body) != {"codec", "frame_count", "height", "pixel_layout", "width"} or (body["pixel_layout"] == "rgba8") != (alpha is not None):
        raise broken
    streams = [decode(part, most_bytes) if part is not None else None for part in (color, alpha)]
    for stream in filter(None, streams):
        if stream[:3] != (body["width"], body["height"], body["frame_count"]) or len(stream[3]) != stream[2]:
            raise broken
    return body, streams[0][3], streams[1][3] if streams[1] else None
