"""PNG, descriptor, container, codec and canonical JSON."""

import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameledger.errors import LedgerError
from frameledger.functions import canonical, codec, container, png, pngr


def picture(samples, kinds, before=(), after=(), part=None):
    h, w, ch = samples.shape
    lines = zlib.compress(png.refilter(samples.reshape(h, -1), bytes(kinds), ch), 0)
    part = part or len(lines)
    idat = [(b"IDAT", lines[i : i + part]) for i in range(0, len(lines), part)]
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if ch == 3 else 6, 0, 0, 0)
    return png.SIGNATURE + b"".join(png.chunk(*c) for c in [(b"IHDR", head), *before, *idat, *after, (b"IEND", b"")])


def slow_unfilter(lines, stride, ch):
    rows, out = [lines[i : i + stride + 1] for i in range(0, len(lines), stride + 1)], []
    up = bytes(stride)
    for row in rows:
        own = bytearray()
        for x in range(stride):
            a, b, c = (own[x - ch] if x >= ch else 0), up[x], (up[x - ch] if x >= ch else 0)
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            own.append((row[1 + x] + (0, a, b, (a + b) // 2, best)[row[0]]) % 256)
        out.append(bytes(own))
        up = bytes(own)
    return b"".join(out)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([3, 4]), st.randoms(), st.integers(1, 40))
def test_filters_repack_and_rebuild(h, w, ch, rnd, part):
    samples = np.array([rnd.randrange(256) for _ in range(h * w * ch)], np.uint8).reshape(h, w, ch)
    source = picture(samples, [rnd.randrange(5) for _ in range(h)], [(b"gAMA", b"\0\0\0\1")], [(b"tEXt", b"a\0b")], part)
    parsed = png.parse(source)
    lines = png.scanlines(parsed)
    assert slow_unfilter(lines, parsed.stride, ch) == samples.tobytes() == png.unfilter(lines, parsed.stride, ch).tobytes()
    packed, applied, meta = png.repack(source)
    assert (len(packed) < len(source)) == applied and png.meta(png.parse(packed)) == meta
    descriptor, got, same = pngr.extract(source)
    assert (got == samples).all() and same == meta
    assert png.meta(png.parse(pngr.rebuild(descriptor, got, meta))) == meta


def test_every_mutation_is_refused():
    source = picture(np.arange(60, dtype=np.uint8).reshape(4, 5, 3), [0, 1, 2, 4])
    for i in range(len(source)):
        for broken in (source[:i], source[:i] + bytes([source[i] ^ 0xFF]) + source[i + 1 :]):
            with pytest.raises(LedgerError):
                png.scanlines(png.parse(broken))


@pytest.mark.parametrize("kind,code", [(b"vpAG", "E_UNSUPPORTED_METADATA"), (b"ABCD", "E_UNSUPPORTED_METADATA"), (b"acTL", "E_UNSUPPORTED_IMAGE")])
def test_chunks_that_are_refused(kind, code):
    with pytest.raises(LedgerError) as error:
        png.parse(picture(np.zeros((2, 2, 3), np.uint8), [0, 0], [(kind, b"x")]))
    assert error.value.code == code


@settings(max_examples=60, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=4, max_size=4), st.integers(1, 3))
def test_unknown_chunks_by_their_letters(name, times):
    """Ancillary ones that are safe to copy are carried along, any number of times; others are refused."""
    kind = name[:2].encode() + name[2].upper().encode() + name[3].encode()
    if kind in png.ONCE | png.REPEATABLE | png.ANIMATED:
        return
    source = picture(np.zeros((2, 2, 3), np.uint8), [0, 4], [(kind, b"x")], [(kind, b"y")] * times)
    if kind[:1].islower() and kind[3:].islower():
        descriptor, samples, meta = pngr.extract(source)
        assert [c[1] for c in pngr.decode(descriptor)[0]].count(kind) == 1 + times and png.read_chunks(pngr.rebuild(descriptor, samples, meta))[1] == (kind, b"x")
    else:
        with pytest.raises(LedgerError) as error:
            png.parse(source)
        assert error.value.code == "E_UNSUPPORTED_METADATA"


@pytest.mark.parametrize("kinds", [[4], [3], [4, 3], [0, 1, 2, 3, 4], [2, 2, 2, 4, 1]])
def test_bands_of_rows(kinds, monkeypatch):
    """Images higher than a band, and of one row or column."""
    monkeypatch.setattr(png, "BAND_BYTES", 1)
    own = np.random.default_rng(4)
    for h, w, ch in ((70, 23, 3), (1, 50, 4), (50, 1, 3)):
        samples = own.integers(0, 256, (h, w * ch), dtype=np.uint8)
        lines = png.refilter(samples, bytes(kinds[i % len(kinds)] for i in range(h)), ch)
        assert (png.unfilter(lines, w * ch, ch) == samples).all()


def test_memory_estimate():
    source = picture(np.zeros((8, 8, 4), np.uint8), [0] * 8)
    need = 3 * len(source) + 4 * 8 * 33 + 16 * 2**20
    assert png.parse(source, png.Limits(memory_bytes=need)).width == 8
    with pytest.raises(LedgerError):
        png.parse(source, png.Limits(memory_bytes=need - 1))


def test_limits():
    source = picture(np.zeros((8, 8, 4), np.uint8), [0] * 8)
    for limit in ({"source_bytes": 10}, {"max_edge": 4}, {"pixels": 63}, {"inflated_bytes": 5}, {"memory_bytes": 1024}):
        with pytest.raises(LedgerError) as error:
            png.parse(source, png.Limits(**limit))
        assert error.value.code == "E_LIMIT_EXCEEDED"


def test_descriptor_corruption():
    data, _, _ = pngr.extract(picture(np.zeros((3, 2, 3), np.uint8), [0, 1, 2]))
    assert pngr.encode(*pngr.decode(data)) == data
    for i in range(len(data)):
        with pytest.raises(LedgerError):
            pngr.decode(data[:i])
    with pytest.raises(LedgerError) as error:
        pngr.decode(data[:9] + b"\2" + data[10:])
    assert error.value.code == "E_SCHEMA_VERSION"


@pytest.mark.parametrize("planes,size,n", [(3, (13, 17), 5), (1, (11, 15), 4), (3, (7, 9), 2), (3, (2, 3), 128)])
def test_codec_is_lossless_and_decodes_prefixes(planes, size, n):
    rng = np.random.default_rng(1)
    frames = [rng.integers(0, 256, (*size, planes), dtype=np.uint8)]
    for _ in range(n - 1):
        frames.append(np.roll(frames[-1], 1, axis=1))
    packets = codec.encode(frames)
    assert all((a == b).all() for a, b in zip(codec.decode(packets, frames[0].shape), frames, strict=True))
    assert (codec.decode_one(packets[: n // 2 + 1], frames[0].shape, n // 2) == frames[n // 2]).all()
    assert packets[0].key and [p.key for p in codec.encode([frames[0]] * n)] == [True] + [False] * (n - 1)
    noise = [rng.integers(0, 256, (64, 64, planes), dtype=np.uint8) for _ in range(3)]
    assert all(p.key for p in codec.encode(noise))  # nothing to predict from
    data = container.encode(size[1], size[0], n, packets)
    assert container.decode(data) == (size[1], size[0], n, packets)
    for broken in (data[:-1], data + b"x", b"x" + data[1:]):
        with pytest.raises(LedgerError):
            container.decode(broken)


def test_codec_bounds():
    one = np.zeros((2, 2, 3), np.uint8)
    for frames in ([one], [one] * 129, [one, np.zeros((2, 3, 3), np.uint8)]):
        with pytest.raises(LedgerError):
            codec.encode(frames)
    with pytest.raises(LedgerError) as error:
        codec.require("vp9")
    assert error.value.code == "E_CODEC_UNAVAILABLE"


def test_delta_beats_intra_on_a_moving_box():
    frames = []
    for i in range(16):
        f = (np.indices((64, 96)).sum(0) // 16 % 2 * 24 + 32).astype(np.uint8)
        f[20:32, 3 * i : 3 * i + 12] = 240
        frames.append(np.stack([f, f + np.uint8(5), f + np.uint8(11)], axis=2))
    size = lambda packets: sum(len(p.data) for p in packets)
    assert size(codec.encode(frames)) < size(codec.encode(frames, all_intra=True)) and [p.key for p in codec.encode(frames)] == [True] + [False] * 15


@pytest.mark.parametrize("text,want", [('{"b":1,"a":[1.0,1e2,2.50,-0.0]}', '{"a":[1.0,100.0,2.5,-0.0],"b":1}'), ("1", "1"), ("1.0", "1.0"), ("NaN", None), ("1e400", None), ("not", None), ('{"a":1,"a":2}', '{"a":2}'), ('"é"', '"é"'), ("1e16", "1e16"), ("null", "null")])
def test_canonical(text, want):
    assert canonical.canonical_or_none(text) == want


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_canonical_is_stable(value):
    text = canonical.canonical_json(json.dumps(value))
    assert canonical.canonical_json(text) == text and json.loads(text) == value
