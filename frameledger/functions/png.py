"""PNG: strict parsing, scanlines, samples, hashes and lossless repacking, for 8-bit RGB and RGBA."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from frameledger.errors import LedgerError

#: Fixed values of the format and of the limits.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST_CHUNKS = 65_536
REPEATABLE = {b"IDAT", b"tEXt", b"zTXt", b"iTXt"}
BEFORE_IDAT = {b"PLTE", b"cHRM", b"gAMA", b"iCCP", b"sBIT", b"sRGB", b"bKGD", b"tRNS", b"pHYs", b"cICP", b"mDCV", b"cLLI"}
ONCE = BEFORE_IDAT | {b"IHDR", b"IEND", b"tIME", b"eXIf"}
ANIMATED = {b"acTL", b"fcTL", b"fdAT"}
CHANNELS = {2: 3, 6: 4}
PART = 1 << 20
#: Bytes that work on an image takes besides its copies; fixed value.
HEADROOM = 16 << 20
#: Rows, and bytes of 16-bit samples, that are unfiltered together.
BAND_ROWS, BAND_BYTES = 512, 32 << 20


@dataclass(frozen=True)
class Limits:
    source_bytes: int = 64 << 20
    max_edge: int = 16_384
    pixels: int = 16_777_216
    inflated_bytes: int = 128 << 20
    memory_bytes: int = 256 << 20


@dataclass(frozen=True)
class Png:
    width: int
    height: int
    color_type: int
    chunks: tuple[tuple[bytes, bytes], ...]

    @property
    def channels(self) -> int:
        return CHANNELS[self.color_type]

    @property
    def stride(self) -> int:
        return self.width * self.channels


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def bad(message: str) -> LedgerError:
    return LedgerError("E_INVALID_IMAGE", message)


def read_chunks(source: bytes) -> list[tuple[bytes, bytes]]:
    if source[:8] != SIGNATURE:
        raise bad("signature")
    at, out = 8, []
    while at < len(source):
        if len(source) - at < 12 or len(out) >= MOST_CHUNKS:
            raise bad("truncated or too many chunks")
        size, kind = struct.unpack_from(">I4s", source, at)
        if size > len(source) - at - 12:
            raise bad("chunk beyond the end")
        if not (kind.isalpha() and kind.isascii()) or kind[2:3].islower():
            raise bad("chunk type")
        data = source[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", source, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise bad("checksum")
        out.append((kind, data))
        at += 12 + size
        if kind == b"IEND":
            break
    if at != len(source) or not out or out[-1] != (b"IEND", b""):
        raise bad("end")
    return out


def parse(source: bytes, limits: Limits = Limits()) -> Png:
    """The validated chunks of a PNG. Order, repetition and the kinds of chunks are strict; what can't be kept exactly is refused."""
    if len(source) > limits.source_bytes:
        raise LedgerError("E_LIMIT_EXCEEDED", "source bytes")
    chunks = read_chunks(source)
    kinds = [k for k, _ in chunks]
    if kinds[0] != b"IHDR" or len(chunks[0][1]) != 13:
        raise bad("header")
    if ANIMATED & set(kinds):
        raise LedgerError("E_UNSUPPORTED_IMAGE", "animation")
    width, height, depth, color, deflate, filters, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    if not width or not height or deflate or filters or interlace > 1:
        raise bad("header values")
    if depth != 8 or color not in CHANNELS or interlace:
        raise LedgerError("E_UNSUPPORTED_IMAGE", "only 8-bit RGB and RGBA without interlace")
    data = [i for i, k in enumerate(kinds) if k == b"IDAT"]
    if not data or data != list(range(data[0], data[0] + len(data))):
        raise bad("image data")
    seen = set()
    for i, kind in enumerate(kinds):
        if kind in ONCE and kind in seen:
            raise bad(f"repeated {kind.decode()}")
        seen.add(kind)
        if kind in BEFORE_IDAT and i > data[0]:
            raise bad(f"{kind.decode()} behind the image data")
        # of other kinds only those may be carried along that are ancillary and safe to copy; they may repeat
        if kind not in ONCE | REPEATABLE and (kind[:1].isupper() or kind[3:].isupper()):
            raise LedgerError("E_UNSUPPORTED_METADATA", kind.decode())
    stride = width * CHANNELS[color]
    inflated = height * (stride + 1)
    if max(width, height) > limits.max_edge or width * height > limits.pixels or inflated > limits.inflated_bytes or memory_estimate(len(source), inflated) > limits.memory_bytes:
        raise LedgerError("E_LIMIT_EXCEEDED", "dimensions")
    return Png(width, height, color, tuple(chunks))


def memory_estimate(source: int, inflated: int) -> int:
    """Bytes for three copies of the file, four of its rows, and headroom."""
    return 3 * source + 4 * inflated + HEADROOM


def scanlines(png: Png) -> bytes:
    """Filtered rows: exactly the header's size, one complete stream, filters 0 to 4."""
    want = png.height * (png.stride + 1)
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(b"".join(d for k, d in png.chunks if k == b"IDAT"), want + 1)
        while len(out) <= want and not stream.eof and stream.unconsumed_tail:
            out += stream.decompress(stream.unconsumed_tail, want + 1 - len(out))
    except zlib.error as error:
        raise bad("compressed data") from error
    if len(out) != want or not stream.eof or stream.unused_data or stream.unconsumed_tail:
        raise bad("size of the image data")
    if max(out[:: png.stride + 1]) > 4:
        raise bad("filter")
    return out


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The neighbour (left, above, above left) nearest to left + above - above left; ties in that order."""
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def wave(raw: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Samples of rows (n, w, channels) below a known row. A sample needs its left, upper and upper left neighbours, so all
    samples of a diagonal are worked out at once: row j of the table is row j - 1 of the image, moved j places to the right."""
    n, w, channels = raw.shape
    table = np.zeros((w + n + 1, n + 1, channels), np.int16)
    step, item = table.strides[0], table.strides[1]
    straight = np.lib.stride_tricks.as_strided(table[2:, 1:], (n, w, channels), (step + item, step, table.strides[2]))
    straight[:] = raw
    table[1 : w + 1, 0] = above
    kind = np.concatenate([[0], kinds])[:, None]
    has = set(kinds.tolist())
    for t in range(2, w + n + 1):
        low, high = max(1, t - w), min(n, t - 1) + 1
        left, up, corner = table[t - 1, low:high], table[t - 1, low - 1 : high - 1], table[t - 2, low - 1 : high - 1]
        own, guess = kind[low:high], 0
        if 4 in has:
            a, b = up - corner, left - corner
            pa, pb, pc = np.abs(a), np.abs(b), np.abs(a + b)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        if has != {4}:
            for k, value in ((3, (left + up) >> 1), (2, up), (1, left), (0, 0)):
                if k in has:
                    guess = np.where(own == k, value, guess)
        table[t, low:high] = (table[t, low:high] + guess) & 255
    return straight.astype(np.uint8)


def unfilter(lines: bytes, stride: int, channels: int) -> np.ndarray:
    """Samples of filtered rows, as (height, stride). Rows go one by one up to one of Average or Paeth, then in bands by diagonals."""
    rows = np.frombuffer(lines, np.uint8).reshape(-1, stride + 1)
    out = np.zeros((len(rows), stride), np.uint8)
    above, y, width = np.zeros(stride, np.uint8), 0, stride // channels
    kinds = rows[:, 0]
    while y < len(rows):
        row, kind = rows[y, 1:], int(kinds[y])
        if kind < 3:
            out[y] = row if kind == 0 else row + above if kind == 2 else np.cumsum(row.reshape(-1, channels), axis=0, dtype=np.uint8).ravel()
            y += 1
        else:
            band = max(16, min(BAND_ROWS, BAND_BYTES // ((width + BAND_ROWS) * channels * 2)))
            own = slice(y, min(len(rows), y + band))
            out[own] = wave(rows[own, 1:].reshape(-1, width, channels), kinds[own], above.reshape(width, channels)).reshape(-1, stride)
            y = own.stop
        above = out[y - 1]
    return out


def refilter(samples: np.ndarray, kinds: bytes, channels: int) -> bytes:
    """Filtered rows of samples (height, stride) under a filter for each row."""
    height, stride = samples.shape
    above = np.vstack([np.zeros((1, stride), np.uint8), samples[:-1]])
    left, corner = (np.hstack([np.zeros((height, channels), np.uint8), x[:, :-channels]]) for x in (samples, above))
    kind = np.frombuffer(kinds, np.uint8)[:, None]
    average = ((left.astype(np.uint16) + above) >> 1).astype(np.uint8)
    guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, average, paeth(left, above, corner)], np.uint8(0))
    return np.hstack([kind, samples - guess]).astype(np.uint8).tobytes()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def other_chunks(png: Png) -> bytes:
    """All chunks but the image data, each as length, type and data."""
    return b"".join(struct.pack(">I", len(d)) + k + d for k, d in png.chunks if k != b"IDAT")


def meta(png: Png, lines: bytes | None = None, samples: np.ndarray | None = None) -> dict:
    """Dimensions and the three hashes. Rows and samples are worked out where they aren't given."""
    lines = scanlines(png) if lines is None else lines
    samples = unfilter(lines, png.stride, png.channels) if samples is None else samples
    return {
        "width": png.width, "height": png.height, "bit_depth": 8, "color_type": png.color_type, "scanline_sha256": sha(lines), "non_idat_sha256": sha(other_chunks(png)), "pixel_sha256": sha(samples.tobytes()),
    }


def assemble(chunks: list[tuple[bytes, bytes]], at: int, lines: bytes, level: int) -> bytes:
    """A PNG of other chunks with image data in parts before place at."""
    data = zlib.compress(lines, level)
    parts = b"".join(chunk(b"IDAT", data[i : i + PART]) for i in range(0, len(data), PART))
    return SIGNATURE + b"".join(chunk(*c) for c in chunks[:at]) + parts + b"".join(chunk(*c) for c in chunks[at:])


def repack(source: bytes, level: int = 6, limits: Limits = Limits()) -> tuple[bytes, bool, dict]:
    """The smaller of a PNG and its recompressed form, whether that was taken, and the meta data. Rows, samples and other chunks never change."""
    png = parse(source, limits)
    lines = scanlines(png)
    at = [k for k, _ in png.chunks].index(b"IDAT")
    packed = assemble([c for c in png.chunks if c[0] != b"IDAT"], at, lines, level)
    before = meta(png, lines)
    if len(packed) >= len(source):
        return source, False, before
    again = parse(packed, limits)
    # equal rows under equal dimensions are equal samples
    if (again.width, again.height, again.color_type) != (png.width, png.height, png.color_type) or scanlines(again) != lines or other_chunks(again) != other_chunks(png):
        raise LedgerError("E_INTEGRITY", "repacked image differs")
    return packed, True, before
