"""Queries on bytes. The SQL beside them works filters, chunks, checksums and identities out by itself, from the vectors that the pictures are drawn of."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.errors import LedgerError
from frameledger.functions import codec, columns, container, png, pngr
from frameledger.sources.shared import held

from . import analogs as A
from .base import query

#: Filters of the rows of a picture.
KINDS = (0, 1, 2, 3, 4, 4, 3, 2)


def pictures(spark, d) -> DataFrame:
    """Vectors as 8 x 8 frames, a PNG each: gray, 5 and 11 more of it, and every fifth with an alpha of 255 less gray.

    All five filters occur. Every seventh has a broken checksum; of the others every eleventh holds an unknown chunk that is
    not safe to copy, and every third an unknown one that is.
    """
    gray = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1.0) * 127.5), F.lit(0)), F.lit(255)).cast("int"))
    rows = A.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "label", "vec_id", gray.alias("gray"))

    def draw(row: dict) -> dict:
        n, gray = row["vec_id"], np.array(row["gray"], np.uint8).reshape(8, 8)
        planes = [gray, gray + np.uint8(5), gray + np.uint8(11)] + ([np.uint8(255) - gray] if n % 5 == 0 else [])
        samples = np.stack(planes, axis=2)
        channels = len(planes)
        lines = png.refilter(samples.reshape(8, 8 * channels), bytes(KINDS), channels)
        extra = [(b"zqXZ", b"?")] if n % 11 == 0 else [(b"prVt", b"kept")] if n % 3 == 0 else []
        chunks = [(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2 if channels == 3 else 6, 0, 0, 0)), *extra, (b"IDAT", zlib.compress(lines, 0)), (b"IEND", b"")]
        content = bytearray(png.SIGNATURE + b"".join(png.chunk(*c) for c in chunks))
        if n % 7 == 0:
            content[-1] ^= 1
        return {"key": row["key"], "label": row["label"], "vec_id": n, "channels": channels, "content": bytes(content), "samples": samples.tobytes()}

    return columns.per_row(rows, "key string, label int, vec_id long, channels int, content binary, samples binary", draw)


def drawn() -> str:
    """SQL views: gray values, the samples' hex, the filtered rows' hex, each worked out from the values around a place."""
    s = lambda y, x, c: f"(case when {c} = 3 then 255 - g[({y}) * 8 + ({x}) + 1] else (g[({y}) * 8 + ({x}) + 1] + [0, 5, 11, 0][{c} + 1]) % 256 end)"
    y, x, c = "(i // (8 * ch))", "((i % (8 * ch)) // ch)", "(i % ch)"
    left, up = f"(case when {x} > 0 then {s(y, x + ' - 1', c)} else 0 end)", f"(case when {y} > 0 then {s(y + ' - 1', x, c)} else 0 end)"
    corner = f"(case when {x} > 0 and {y} > 0 then {s(y + ' - 1', x + ' - 1', c)} else 0 end)"
    around = f"list_transform(range(64 * ch), lambda i: {{'k': {list(KINDS)}[{y} + 1], 'v': {s(y, x, c)}, 'a': {left}, 'b': {up}, 'c': {corner}, 'i': i}})"
    near = "case when abs(p.b - p.c) <= abs(p.a - p.c) and abs(p.b - p.c) <= abs(p.a + p.b - 2 * p.c) then p.a when abs(p.a - p.c) <= abs(p.a + p.b - 2 * p.c) then p.b else p.c end"
    guess = f"(case p.k when 0 then 0 when 1 then p.a when 2 then p.b when 3 then (p.a + p.b) // 2 else {near} end)"
    return f"""grays as (select vec_id, case when vec_id % 5 = 0 then 4 else 3 end as ch, list_transform(embedding, lambda x: cast(least(greatest(floor((cast(x as double) + 1.0) * cast(127.5 as double)), 0), 255) as integer)) as g,
 case when vec_id % 7 = 0 then 'E_INVALID_IMAGE' when vec_id % 11 = 0 then 'E_UNSUPPORTED_METADATA' end as error from embeddings),
 places as (select vec_id, ch, error, {around} as ps from grays),
 drawn as (select cast(vec_id as varchar) as key, ch, error, array_to_string(list_transform(ps, lambda p: printf('%02x', p.v)), '') as samples,
  array_to_string(list_transform(ps, lambda p: (case when p.i % (8 * ch) = 0 then printf('%02x', p.k) else '' end) || printf('%02x', (p.v - {guess} + 512) % 256)), '') as lines,
  '0000000d4948445200000008000000080' || '8' || case when ch = 3 then '02' else '06' end || '000000' || case when vec_id % 3 = 0 then '0000000470725674' || hex(encode('kept')) else '' end || '0000000049454e44' as others from places),
 metas as (select key, error, ch, case when error is null then 8 end as width, case when error is null then 8 end as height, case when error is null then 8 end as bit_depth, case when error is null then case when ch = 3 then 2 else 6 end end as color_type,
  case when error is null then sha256(unhex(lines)) end as scanline_sha256, case when error is null then sha256(unhex(others)) end as non_idat_sha256, case when error is null then sha256(unhex(samples)) end as pixel_sha256, samples from drawn)"""


@query(f"with {drawn()} select key, error, width, height, bit_depth, color_type, scanline_sha256, non_idat_sha256, pixel_sha256 from metas")
def png_meta(spark, d) -> DataFrame:
    return columns.png_meta(pictures(spark, d))


@query(f"with {drawn()} select key, error, width, height, scanline_sha256, non_idat_sha256, pixel_sha256, case when error is null then true end as not_larger from metas")
def png_repack(spark, d) -> DataFrame:
    """What is read again from the repacked pictures."""
    drawings = held(pictures(spark, d))
    packed = held(columns.png_repack(drawings, 9).select("key", "content", F.col("error").alias("refused")))
    sizes = packed.join(drawings.select("key", F.octet_length("content").alias("size")), "key").select("key", "refused", (F.octet_length("content") <= F.col("size")).alias("not_larger"))
    found = columns.png_meta(packed.where("refused is null")).drop("error")
    return sizes.join(found, "key", "left").select("key", F.col("refused").alias("error"), "width", "height", "scanline_sha256", "non_idat_sha256", "pixel_sha256", "not_larger")


@query(f"with {drawn()} select key, error, case when error is null then true end as same, case when error is null then pixel_sha256 end as pixel_sha256 from metas")
def pngr_roundtrip(spark, d) -> DataFrame:
    return columns.png_roundtrip(pictures(spark, d)).select("key", "error", "same", "pixel_sha256")


@query(f"with {drawn()} select key, ch as channels, sha256(unhex(samples)) as merged_sha256 from drawn")
def plane_split(spark, d) -> DataFrame:
    """Colour and alpha apart and together again."""

    def both(row: dict) -> dict:
        samples = np.frombuffer(row["samples"], np.uint8).reshape(8, 8, row["channels"])
        return {"key": row["key"], "channels": row["channels"], "content": codec.merge_alpha(*codec.split_alpha(samples)).tobytes()}

    return columns.per_row(pictures(spark, d).select("key", "channels", "samples"), "key string, channels int, content binary", both).select("key", "channels", F.sha2("content", 256).alias("merged_sha256"))


@query(f"""with {drawn()}, groups as (select *, vec_id // 4 as grp, count(*) over (partition by vec_id // 4, ch) as n, row_number() over (partition by vec_id // 4, ch order by vec_id) - 1 as idx from (select *, cast(key as bigint) as vec_id from drawn) q)
 select grp || '-' || ch as segment_id, cast(idx as integer) as frame_index, sha256(unhex(samples)) as pixel_sha256 from groups where n >= 2""")
def segment_sequence(spark, d) -> DataFrame:
    """Pictures of a shape in fours, coded in colour and alpha streams under a descriptor, stored, and decoded from the stored parts."""
    rows = pictures(spark, d).select("vec_id", "channels", "samples").withColumns({"group_id": F.concat_ws("-", F.floor(F.col("vec_id") / 4).cast("string"), "channels"), "width": F.lit(8), "height": F.lit(8), "frame_no": F.col("vec_id"), "image_id": F.col("vec_id").cast("string")})
    segments = columns.encode_groups(rows).where("error is null")  # a frame alone is no segment
    return columns.decode_segments(segments.withColumn("segment_id", F.col("group_id"))).select("segment_id", "frame_index", F.sha2("samples", 256).alias("pixel_sha256"))


@query("select cast(doc_id as varchar) as key, case when doc_id % 3 = 1 then 'E_INTEGRITY' when doc_id % 3 = 2 then 'E_SCHEMA_VERSION' end as error, case when doc_id % 3 = 0 then sha256(text) end as sha from documents")
def descriptor_roundtrip(spark, d) -> DataFrame:
    """Descriptors with a text as a chunk: sound ones, ones with a byte too many, and ones of another version."""

    def both(row: dict) -> dict:
        data = pngr.encode([(0, b"tEXt", row["content"])], bytes([0, 1, 4]))
        data = (data, data + b"\x05", data[:9] + b"\x02" + data[10:])[int(row["key"]) % 3]
        error, found = columns.attempt(pngr.decode, data)
        return {"key": row["key"], "error": error, "content": found[0][0][2] if found and pngr.encode(*found) == data else None}

    rows = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("content"))
    return columns.per_row(rows, "key string, error string, content binary", both).select("key", "error", F.sha2("content", 256).alias("sha"))


@query("select cast(doc_id as varchar) as key, sha256(text) as sha from documents")
def container_roundtrip(spark, d) -> DataFrame:
    def both(row: dict) -> dict:
        packets = [container.Packet(row["content"][:9], 0, 1, True), container.Packet(row["content"][9:], 1)]
        data = b"".join(p.data for p in container.decode(container.encode(1, 1, 2, packets))[3])
        return {"key": row["key"], "content": data}

    rows = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("content"))
    return columns.per_row(rows, "key string, content binary", both).select("key", F.sha2("content", 256).alias("sha"))


@query("""select cast(doc_id as varchar) as key, case doc_id % 6 when 0 then 'E_LIMIT_EXCEEDED' when 1 then 'E_INTEGRITY' when 2 then 'E_SCHEMA_VERSION' when 3 then 'E_INTEGRITY' when 4 then 'E_LIMIT_EXCEEDED' end as error,
 case when doc_id % 6 = 5 then cast(strlen(text) as bigint) end as payload_bytes from documents""")
def container_checks(spark, d) -> DataFrame:
    """Containers that break one rule each: too many packets, a first packet that is no key, version, a frame number beyond the end, size."""

    def check(row: dict) -> dict:
        n, content = int(row["key"]) % 6, row["content"]
        packets = [container.Packet(content[:5], 0, 1, n != 1), container.Packet(content[5:], 9 if n == 3 else 1)]
        data = container.encode(1, 1, 2, packets)
        data = data[:9] + b"\x09" + data[10:] if n == 2 else data
        error, found = columns.attempt(container.decode, data, len(data) - 1 if n == 4 else 128 << 20, 1 if n == 0 else 1024)
        return {"key": row["key"], "error": error, "payload_bytes": codec.payload(found[3]) if found else None}

    rows = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    return columns.per_row(rows, "key string, error string, payload_bytes long", check)


@query(f"""with m as (select segment_id, '{codec.NAME.encode().hex()}' as head, min(png_sha) filter (frame_index = 0) as color, list(image_id order by frame_index) as ids from members group by 1),
 parts as (select segment_id, list_concat([head, hex(encode(color))], list_transform(ids, lambda i: hex(encode(i)))) as ps from m)
 select segment_id as segment, sha256(unhex(array_to_string(list_transform(ps, lambda p: lpad(hex(cast(strlen(p) // 2 as bigint)), 16, '0') || p), ''))) as segment_sha from parts""")
def segment_id(spark, d) -> DataFrame:
    def digest(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["frame_index"])
        value = container.segment_id(codec.NAME.encode(), rows[0]["png_sha"], None, [r["image_id"] for r in rows])
        return pa.table({"segment": [rows[0]["segment_id"]], "segment_sha": [value]})

    members = A.Packed.of(spark, d).members  # a segment has 128 images at most
    return members.select("segment_id", "frame_index", "image_id", "png_sha").groupBy("segment_id").applyInArrow(digest, "segment string, segment_sha string")


@query("""with t as (select list_transform(range(256), lambda n: list_reduce(list_concat([cast(n as ubigint)], list_transform(range(8), lambda i: cast(i as ubigint))), lambda c, i: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end)) as crc),
 b as (select page_id, hex(encode(html)) as h, strlen(html) as n from pages)
 select page_id, cast(xor(list_reduce(list_concat([cast(4294967295 as ubigint)], list_transform(range(n), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as int), 2) as ubigint))), lambda c, x: xor(t.crc[cast((xor(c, x) & 255) as int) + 1], c >> 8)), cast(4294967295 as ubigint)) as bigint) as crc from b, t""")
def crc32(spark, d) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", F.crc32(F.col("html").cast("binary")).alias("crc"))


@query("""with q as (select o_orderkey, o_orderkey % 90 * 1000000 as source, o_orderkey % 7 * 3000 + 1 as w, o_orderkey % 5 * 2500 + 1 as h, case when o_orderkey % 2 = 0 then 3 else 4 end as ch from orders),
 r as (select *, h * (w * ch + 1) as inflated from q)
 select o_orderkey, case when source > 67108864 or greatest(w, h) > 16384 or w * h > 16777216 or inflated > 134217728 or 3 * source + 4 * inflated + 16777216 > 268435456 then 'E_LIMIT_EXCEEDED' end as error from r""")
def image_limits(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    rows = A.table(spark, d, "orders").select("o_orderkey", (key % 90 * 1000000).alias("source"), (key % 7 * 3000 + 1).alias("w"), (key % 5 * 2500 + 1).alias("h"), F.when(key % 2 == 0, 3).otherwise(4).alias("ch"))
    return rows.select("o_orderkey", columns.limit_error(F.col("source"), F.col("w"), F.col("h"), F.col("ch")).alias("error"))


def refused(check) -> str | None:
    try:
        check()
    except LedgerError as error:
        return error.code
    return None


@query("select conv_id, turn, case when turn < 2 and role = 'user' then null when role = 'user' then 'E_INVALID_ARGUMENT' else 'E_CODEC_UNAVAILABLE' end as error from conversations")
def codec_refusals(spark, d) -> DataFrame:
    """Codecs by name, and places in a stream of two frames."""
    packets = codec.encode([np.zeros((2, 2, 3), np.uint8)] * 2)

    def check(row: dict) -> dict:
        own = refused(lambda: codec.require(codec.NAME if row["role"] == "user" else "vp9")) or refused(lambda: codec.decode_one(packets, (2, 2, 3), row["turn"]))
        return {"conv_id": row["conv_id"], "turn": row["turn"], "error": own}

    return columns.per_row(A.table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id long, turn long, error string", check)
