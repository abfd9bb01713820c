"""A lossless inter-frame codec, 'row-delta-zstd': differences of rows in compressed streams, flushed at each frame.

A packet is one flushed block. The first byte of a frame says whether it is coded by itself (key) or against the
frame before it; a key frame begins a new stream, so frames 0..i decode from packets 0..i, and from the last key on.
Samples stay interleaved, as planes of one picture change together. Colour and alpha are separate streams.
"""

from __future__ import annotations

import zlib

import numpy as np

from frameledger.errors import LedgerError

from .container import Packet

try:
    import zstandard
except ImportError:
    zstandard = None

NAME = "row-delta-zstd" if zstandard else "row-delta-deflate"
LEAST, MOST = 2, 128


def require(codec: str) -> None:
    if codec != NAME:
        raise LedgerError("E_CODEC_UNAVAILABLE", codec)


def predicted(now: np.ndarray, before: np.ndarray | None) -> bytes:
    """Mode byte and samples of a frame (height, width, planes): each row less the one above, of the frame or of its change."""
    change = now if before is None else now - before
    rows = change.copy()
    rows[1:] -= change[:-1]
    return (b"\0" if before is None else b"\1") + rows.tobytes()


def restored(raw: bytes, shape: tuple[int, int, int], before: np.ndarray | None) -> np.ndarray:
    height, width, planes = shape
    if len(raw) != 1 + height * width * planes or raw[0] > 1 or (raw[0] and before is None):
        raise LedgerError("E_CODEC_FAILURE", "frame")
    change = np.cumsum(np.frombuffer(raw, np.uint8, offset=1).reshape(shape), axis=0, dtype=np.uint8)
    return change + before if raw[0] else change


def prefers_delta(now: np.ndarray, before: np.ndarray) -> bool:
    """Whether a frame repeats a good part of the one before, or differs less from it than its rows do from one another."""
    size = lambda x: int(np.minimum(x, -x).sum(dtype=np.int64))  # noqa: E731  (differences wrap around)
    if 4 * np.count_nonzero(now == before) >= now.size:
        return True
    return 100 * size(now - before) < 95 * (size(now[1:] - now[:-1]) + size(now[:1]))


class Encoder:
    """Takes the frames of one stream one after another; only the last one is held."""

    def __init__(self, all_intra: bool = False):
        self.packets: list[Packet] = []
        self.before, self.stream, self.all_intra = None, None, all_intra

    def compress(self, raw: bytes, key: bool) -> bytes:
        if not zstandard:
            return zlib.compress(zlib.compress(raw, 9), 9)
        if key:
            # tables no larger than a whole segment of such frames needs
            sized = zstandard.ZstdCompressionParameters.from_level(19, source_size=len(raw) * MOST)
            self.stream = zstandard.ZstdCompressor(compression_params=sized).compressobj()
        return self.stream.compress(raw) + self.stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)

    def push(self, now: np.ndarray) -> None:
        before = self.before
        if len(self.packets) == MOST or (before is not None and before.shape != now.shape):
            raise LedgerError("E_INVALID_ARGUMENT", "frames of a segment")
        key = before is None or self.all_intra or not prefers_delta(now, before)
        self.packets.append(Packet(self.compress(predicted(now, None if key else before), key), len(self.packets), 1, key))
        self.before = now

    def finish(self) -> list[Packet]:
        if len(self.packets) < LEAST:
            raise LedgerError("E_INVALID_ARGUMENT", "frames of a segment")
        return self.packets


def encode(frames: list[np.ndarray], all_intra: bool = False) -> list[Packet]:
    """Packets of one stream of LEAST to MOST frames of one shape."""
    out = Encoder(all_intra)
    for frame in frames:
        out.push(frame)
    return out.finish()


def payload(packets: list[Packet]) -> int:
    """Coded bytes of a stream, without its container."""
    return sum(len(p.data) for p in packets)


def decode(packets: list[Packet], shape: tuple[int, int, int]):
    """Frames one after another; only one is held."""
    stream, before = None, None
    for p in packets:
        if p.key and zstandard:
            stream = zstandard.ZstdDecompressor().decompressobj()
        try:
            raw = stream.decompress(p.data) if zstandard else zlib.decompress(zlib.decompress(p.data))
        except Exception as error:
            raise LedgerError("E_CODEC_FAILURE", "packet") from error
        before = restored(raw, shape, None if p.key else before)
        yield before


def decode_one(packets: list[Packet], shape: tuple[int, int, int], index: int) -> np.ndarray:
    """Frame index, from packets 0..index alone."""
    if not 0 <= index < len(packets):
        raise LedgerError("E_INVALID_ARGUMENT", "frame index")
    frame = None
    for frame in decode(packets[: index + 1], shape):
        pass
    return frame


def split_alpha(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    return samples[:, :, :3], samples[:, :, 3:] if samples.shape[2] == 4 else None


def merge_alpha(color: np.ndarray, alpha: np.ndarray | None) -> np.ndarray:
    return color if alpha is None else np.concatenate([color, alpha], axis=2)
