"""Reconstruction descriptors: all of a PNG but its samples, shareable between frames."""

from __future__ import annotations

import struct

import numpy as np

from frameledger.errors import LedgerError

from . import png as P

#: Fixed layout, big-endian: magic, version, chunk count, filter count; for each chunk placement, type, length, data; then filters.
MAGIC, VERSION = b"VSPNGR\0\0", 1
HEAD, ENTRY = struct.Struct(">8sHII"), struct.Struct(">B4sI")


def encode(chunks: list[tuple[int, bytes, bytes]], filters: bytes) -> bytes:
    """chunks: placement (0 before, 1 behind the image data), type, data."""
    return HEAD.pack(MAGIC, VERSION, len(chunks), len(filters)) + b"".join(ENTRY.pack(p, k, len(d)) + d for p, k, d in chunks) + filters


def decode(data: bytes, most: int = 64 << 20) -> tuple[list[tuple[int, bytes, bytes]], bytes]:
    if len(data) > most:
        raise LedgerError("E_LIMIT_EXCEEDED", "descriptor")
    if len(data) < HEAD.size:
        raise LedgerError("E_INTEGRITY", "descriptor is short")
    magic, version, count, rows = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise LedgerError("E_INTEGRITY", "magic")
    if version != VERSION:
        raise LedgerError("E_SCHEMA_VERSION", "descriptor version")
    at, out, stage = HEAD.size, [], 0
    for _ in range(count):
        if len(data) - at < ENTRY.size:
            raise LedgerError("E_INTEGRITY", "descriptor is short")
        place, kind, size = ENTRY.unpack_from(data, at)
        at += ENTRY.size
        if place > 1 or place < stage or size > len(data) - at:
            raise LedgerError("E_INTEGRITY", "descriptor chunk")
        stage = place
        out.append((place, kind, data[at : at + size]))
        at += size
    filters = data[at:]
    if len(filters) != rows or (filters and max(filters) > 4):
        raise LedgerError("E_INTEGRITY", "filters")
    return out, filters


def extract(source: bytes, limits: P.Limits = P.Limits()) -> tuple[bytes, np.ndarray, dict]:
    """Descriptor, samples as (height, width, channels), and meta data."""
    png = P.parse(source, limits)
    lines = P.scanlines(png)
    seen, chunks = 0, []
    for kind, data in png.chunks:
        if kind == b"IDAT":
            seen = 1
        else:
            chunks.append((seen, kind, data))
    samples = P.unfilter(lines, png.stride, png.channels).reshape(png.height, png.width, png.channels)
    return encode(chunks, lines[:: png.stride + 1]), samples, P.meta(png, lines, samples)


def rebuild(descriptor: bytes, samples: np.ndarray, meta: dict, level: int = 6) -> bytes:
    """The PNG of a descriptor and samples; its three hashes must be those of meta."""
    chunks, filters = decode(descriptor)
    height, width, channels = samples.shape
    kinds = [(k, d) for _, k, d in chunks]
    if not kinds or kinds[0][0] != b"IHDR" or kinds[0][1][:8] != struct.pack(">II", width, height) or len(filters) != height:
        raise LedgerError("E_INTEGRITY", "descriptor and samples differ")
    if P.sha(np.ascontiguousarray(samples).tobytes()) != meta["pixel_sha256"]:
        raise LedgerError("E_INTEGRITY", "samples")
    lines = P.refilter(samples.reshape(height, width * channels), filters, channels)
    out = P.assemble(kinds, sum(p == 0 for p, _, _ in chunks), lines, level)
    # the samples' hash has been checked, and rows determine samples: what is left are the rows and the other chunks
    png = P.parse(out)
    if P.scanlines(png) != lines or P.meta(png, lines, samples) != {k: meta[k] for k in ("width", "height", "bit_depth", "color_type", "scanline_sha256", "non_idat_sha256", "pixel_sha256")}:
        raise LedgerError("E_INTEGRITY", "rebuilt image")
    return out
