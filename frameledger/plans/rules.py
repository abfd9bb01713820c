"""Queries on rules: limits, validation, references, versions, planted violations. What is planted is chosen by a key, the same way in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.functions import tokens
from frameledger.operators import blocks, catalog, judgments, packing, pruning
from frameledger.sources import files, migration
from frameledger.sources.ledger import as_objects
from frameledger.sources.shared import held

from . import analogs as A
from .base import query

UUID = "lpad(lower(hex(event_id)), 8, '0')||'-0000-4000-8000-'||lpad(lower(hex(event_id)), 12, '0')"


def uuids(spark, d) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", "event_type", "user_id", F.expr("concat(lpad(lower(hex(event_id)), 8, '0'), '-0000-4000-8000-', lpad(lower(hex(event_id)), 12, '0'))").alias("image_id"))


# lookups, pages, references


@query("select seq, run, stream, frame_no, png_bytes from candidates where run = 'u1'")
def pack_candidates_run(spark, d) -> DataFrame:
    """A filter that is given, and one that isn't."""
    rows = packing.candidates(A.images(spark, d), A.stored(spark, d).drop("png_bytes"), A.objects(spark, d), run="u1", stream=None)
    return rows.select("seq", "run", "stream", "frame_no", "png_bytes")


@query("select coalesce(max(seq), 0) as high from images where run = 'u1' and stream = 'click'")
def freeze_point(spark, d) -> DataFrame:
    return catalog.high_water(catalog.images_of(A.images(spark, d), "u1", "click"))


@query("select coalesce(max(seq), 0) as high from judgments")
def judgment_high_water(spark, d) -> DataFrame:
    return catalog.high_water(A.judgments(spark, d))


@query("select event_type as stream, cast(count(*) as bigint) as images, count(*) > 1000 as refused from events where user_id % 10 <> 0 group by 1")
def pack_guard(spark, d) -> DataFrame:
    """Candidates of each stream against the most that a pack takes."""
    return packing.guard(packing.candidates(A.images(spark, d), A.stored(spark, d).drop("png_bytes"), A.objects(spark, d)), 1000, "stream")


@query(f"""with r as (select event_id, {UUID} as id from events)
 select event_id, case when event_id % 5 in (0, 1) then id end as image_id, case event_id % 5 when 2 then 'E_STORE_MISMATCH' when 3 then 'E_INVALID_ARGUMENT' when 4 then 'E_INVALID_ARGUMENT' end as error from r""")
def reference_parse(spark, d) -> DataFrame:
    """References to this store, bare ids, references to another store, of another kind, and texts that are none."""
    n, one = F.col("event_id") % 5, F.col("image_id")
    text = F.when(n == 0, F.concat(F.lit("frame://s/images/"), F.upper(one))).when(n == 1, one).when(n == 2, F.concat(F.lit("frame://t/images/"), one)).when(n == 3, F.concat(F.lit("frame://s/blobs/"), one)).otherwise(F.substring(one, 2, 40))
    found = tokens.parsed_reference(text, "s")
    return uuids(spark, d).select("event_id", found["image_id"].alias("image_id"), found["error"].alias("error"))


@query("""select event_id, rtrim(translate(to_base64(encode('{"last":' || event_id + 1 || ',"max":' || event_id + 5 || ',"query":{"run":"' || event_type || '"},"store":"s","version":1}')), '+/', '-_'), '=') as cursor from events""")
def cursors(spark, d) -> DataFrame:
    run = F.concat(F.lit('{"run":"'), "event_type", F.lit('"}'))
    return A.table(spark, d, "events").select("event_id", tokens.cursor("s", run, F.col("event_id") + 5, F.col("event_id") + 1).alias("cursor"))


@query("select seq, image_id, cast(case when r = 20 and n > 20 then seq end as bigint) as next_last from (select *, row_number() over (order by seq desc) as r, count(*) over () as n from images where run = 'u1') q where r <= 20")
def page_with_next(spark, d) -> DataFrame:
    """A page, and on its last row where the next one begins if there is one."""
    return catalog.with_next(catalog.page(A.images(spark, d), 20, where={"run": "u1"}), 20).select("seq", "image_id", "next_last")


@query("""select i.seq, i.image_id, i.run, cast(null as varchar) as stream, cast(null as bigint) as frame_no, 'png' as representation_kind, 1 as representation_version, s.png_bytes as stored_bytes, cast(1 as bigint) as shared_image_count
 from images i join stored s using (image_id)""")
def v1_list(spark, d) -> DataFrame:
    """Images as the first format lists them."""
    rows = A.images(spark, d).join(A.stored(spark, d).select("image_id", F.col("png_sha").alias("stored_blob_sha256")), "image_id")
    return migration.listed(rows, A.objects(spark, d))


@query("select p_partkey as migration_id, p_name as state, p_size as from_version from part order by p_partkey desc limit 1")
def newest_migration(spark, d) -> DataFrame:
    return migration.newest(A.table(spark, d, "part").select(F.col("p_partkey").alias("migration_id"), F.col("p_name").alias("state"), F.col("p_size").alias("from_version")))


@query("""select o_orderkey, sha256('[1,"'||o_orderstatus||'",null,["'||o_orderpriority||'"],false,6]') as fingerprint from orders""")
def fingerprint_v1(spark, d) -> DataFrame:
    fields = (F.lit(1), F.col("o_orderstatus"), F.lit(None).cast("string"), F.array("o_orderpriority"), F.lit(False), F.lit(6))
    return A.table(spark, d, "orders").select("o_orderkey", catalog.fingerprint(*fields).alias("fingerprint"))


@query("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) + 100 as seq from orders")
def assigned_seq(spark, d) -> DataFrame:
    """A batch numbered behind what there is, in an order of its own."""
    rows = A.table(spark, d, "orders").select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("place"))
    return blocks.ranked(rows, "place", 100, held).select("o_orderkey", "seq")


# metadata and judgments


@query("""with r as (select o_orderkey, o_orderkey % 2100 as n from orders)
 select o_orderkey, case when n > 2048 or 2 * n + 2 + strlen('["r","default",null,,["a","b"],null]') - case when n = 0 then -2 else 0 end > 4000 then 'E_LIMIT_EXCEEDED' end as error from r""")
def metadata_escaped(spark, d) -> DataFrame:
    """Notes of quotes, which take two bytes each as JSON text, against a bound of 4000."""
    none = F.lit(None).cast("string")
    rows = A.table(spark, d, "orders").select("o_orderkey", F.lit("r").alias("run"), F.lit("default").alias("stream"), none.alias("label"), F.expr("repeat('\"', cast(o_orderkey % 2100 as int))").alias("note"), F.array(F.lit("b"), F.lit("a")).alias("tags"))
    return catalog.normalise_metadata(rows, escaped=4000).select("o_orderkey", "error")


@query("""with r as (select *, doc_id % 12 as n from labels)
 select doc_id, case when n in (0, 1, 2, 3, 4, 5, 6) then 'E_INVALID_ARGUMENT' when n in (7, 8, 9) then 'E_LIMIT_EXCEEDED' end as error from r""")
def judgment_rules(spark, d) -> DataFrame:
    """Judgments that break one rule each: no kind, no producer, empty model, version 0, probability, confidence, metadata; kind, value and both too long."""
    n = F.col("doc_id") % 12
    when = lambda i, bad, good: F.when(n == i, F.lit(bad)).otherwise(F.lit(good))
    rows = A.table(spark, d, "labels").select(
        "doc_id", F.when(n == 0, "").when(n == 7, "k" * 129).otherwise("quality").alias("kind"), when(1, "", "rule").alias("producer"), F.when(n == 2, "").alias("model"), when(3, 0, 1).alias("schema_version"),
        F.when(n == 4, 1.5).alias("probability"), F.when(n == 5, -0.1).alias("confidence"), F.when(n == 6, "[]").when(n == 9, '{"a":"' + "x" * 4000 + '"}').otherwise("{}").alias("metadata_json"),
        F.when(n == 8, "1" * 4097).when(n == 9, "1" * 3000).otherwise("true").alias("value_json"),
    )
    return judgments.validate(rows).select("doc_id", "error")


@query("""with r as (select *, doc_id % 7 as n from labels)
 select 'd' || doc_id as key, case when n in (1, 2, 3, 4) then 'E_INVALID_ARGUMENT' when n = 5 then 'E_LIMIT_EXCEEDED' end as error, case when n in (0, 6) then '{"a":1.5,"b":[' || toxic || ',null]}' end as value_json,
 case when n in (0, 6) then cast(quality as double) / 4 end as confidence from r""")
def judgment_source(spark, d) -> DataFrame:
    """Judgments as JSON texts: sound ones in any order of fields, an unknown field, no value, a field twice, no JSON, and a text too long."""
    body = F.format_string('{"confidence":%s,"kind":"k","producer":"p","value":{"b":[%d,null],"a":1.50}}', (F.col("quality").cast("double") / 4).cast("string"), "toxic")
    n = F.col("doc_id") % 7
    text = F.when(n == 1, F.replace(body, F.lit('"kind"'), F.lit('"x":1,"kind"'))).when(n == 2, F.lit('{"kind":"k","producer":"p"}')).when(n == 3, F.replace(body, F.lit('"kind"'), F.lit('"kind":"j","kind"')))
    text = text.when(n == 4, F.substring(body, 1, 20)).when(n == 5, F.concat(body, F.lit(" " * (64 << 10)))).otherwise(body)
    rows = A.table(spark, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.lit("i").alias("image_id"), text.alias("json"))
    return files.judgments(rows).select("key", "error", "value_json", "confidence")


# objects, sums, verification


@query("""select cast(doc_id as varchar) as sha256, case when doc_id % 3 = 0 then 'media' when doc_id % 3 = 1 then 'path' end as wrong from documents where doc_id % 3 < 2""")
def object_consistency(spark, d) -> DataFrame:
    """Objects whose media type or path isn't that of their kind and hash."""
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    rows = as_objects(A.table(spark, d, "documents").select("doc_id", sha.alias("sha256"), F.when(F.col("doc_id") % 2 == 0, "png").otherwise("bitstream").alias("object_kind")))
    n = F.col("doc_id") % 3
    rows = rows.withColumns({"media_type": F.when(n == 0, "text/plain").otherwise(F.col("media_type")), "relative_path": F.when(n == 1, F.concat("relative_path", F.lit("x"))).otherwise(F.col("relative_path"))})
    found = rows.select("doc_id", "sha256", "object_kind", F.col("media_type").alias("m"), F.col("relative_path").alias("p"))
    wrong = F.when(~F.col("m").eqNullSafe(F.col("media_type")), "media").when(~F.col("p").eqNullSafe(F.col("relative_path")), "path")
    return as_objects(found).withColumn("wrong", wrong).where("wrong is not null").select(F.col("doc_id").cast("string").alias("sha256"), "wrong")


@query("""select event_type, case when total < 9223372036854775808 then cast(total as bigint) end as total, case when total >= 9223372036854775808 then 'E_LIMIT_EXCEEDED' end as error
 from (select event_type, sum(cast(event_id as hugeint) * case when event_type < 'd' then 9000000000000000 else 3 end) as total from events group by 1) q""")
def checked_sums(spark, d) -> DataFrame:
    """Byte totals, some of them beyond 64 bits."""
    big = F.col("event_id").cast("decimal(38,0)") * F.when(F.col("event_type") < "d", F.lit(9000000000000000).cast("decimal(20,0)")).otherwise(F.lit(3).cast("decimal(20,0)"))
    rows = A.table(spark, d, "events").select("event_type", big.cast("decimal(38,0)").alias("bytes"))
    total = pruning.checked_sum("bytes")
    return rows.groupBy("event_type").agg(total.alias("t")).select("event_type", "t.total", "t.error")


@query("select segment_id, cast(max(seq % 500 + 20) as bigint) as descriptor_bytes from members group by 1")
def segment_descriptors(spark, d) -> DataFrame:
    """The largest descriptor of each segment, which bounds what decoding it takes."""
    members = A.Packed.of(spark, d).members.withColumn("descriptor_byte_length", F.col("seq") % 500 + 20)
    return packing.largest_descriptor(members, members.select("image_id", "descriptor_byte_length")).select("segment_id", "descriptor_bytes")


@query("select m.image_id, m.segment_id, m.frame_index, cast(0 as bigint) as decode_start_index, m.frame_count, cast(m.segment_bytes as bigint) as segment_bytes, a.representation_version from members m join active a on a.image_id = m.image_id and a.segment_id = m.segment_id")
def temporal_locations(spark, d) -> DataFrame:
    """Where each packed image lies, with its segment's header."""
    made = A.Packed.of(spark, d)
    places = made.members.select("image_id", "segment_id", "frame_index", F.lit(0).cast("long").alias("decode_start_index"))
    return packing.located(made.active, places, made.segments).select("image_id", "segment_id", "frame_index", "decode_start_index", "frame_count", "segment_bytes", "representation_version")


@query("""select i.seq, i.image_id, a.representation_kind, cast(case when a.representation_kind = 'png' then o.byte_length else m.segment_bytes + i.seq % 500 + 20 end as bigint) as stored_bytes
 from images i join active a using (image_id) left join objects o on o.sha256 = a.png_sha left join members m on m.image_id = i.image_id""")
def representation_bytes(spark, d) -> DataFrame:
    """What each image's form takes: its object, or its segment and its own descriptor."""
    made = A.Packed.of(spark, d)
    descriptors = made.members.select("image_id", (F.col("seq") % 500 + 20).alias("descriptor_byte_length"))
    out = catalog.info(A.images(spark, d), made.active, A.objects(spark, d), made.members.select("image_id", "segment_id", "frame_index"), made.segments, descriptors)
    return out.select("seq", "image_id", "representation_kind", "stored_bytes")


@query("""with r as (select image_id, png_sha from active where png_sha is not null union select image_id, png_sha from retired where prune_state <> 'deleted' union select image_id, png_sha from stored where (cast(substr(image_id,5) as bigint)+1)%97=0)
 select png_sha as sha256, cast(count(*) as bigint) as images from r group by 1""")
def images_of_objects(spark, d) -> DataFrame:
    """Images that refer to each object, now, before, or as their source."""
    made = A.Packed.of(spark, d)
    own = A.stored(spark, d).where((F.substring("image_id", 5, 20).cast("long") + 1) % 97 == 0)
    refs = pruning.object_images((made.active, "png_sha"), (made.retired.where("prune_state <> 'deleted'"), "png_sha"), (own, "png_sha"))
    return refs.groupBy("sha256").agg(F.count(F.lit(1)).alias("images"))


@query("""with l as (select png_sha as sha256, prune_state, cast(row_number() over (partition by png_sha order by image_id) as bigint) as pos from retired)
 select sha256, arg_max(prune_state, pos) as prune_state, cast(count(*) as bigint) as changes from l group by 1""")
def prune_states(spark, d) -> DataFrame:
    """The state of each object by the newest row of a log."""
    from pyspark.sql import Window

    log = A.Packed.of(spark, d).retired.select(F.col("png_sha").alias("sha256"), "prune_state", F.row_number().over(Window.partitionBy("png_sha").orderBy("image_id")).cast("long").alias("at"))
    return pruning.newest_state(log, ["sha256"]).select("sha256", "prune_state", "changes")


PLANTED = {
    "halves": "select 'partial_frame_key' as code, image_id as key from images where run is not null and seq % 1000 = 1",
    "twice": "select 'duplicate_frame' as code, run || '/' || stream || '/' || frame_no as key from images where run is not null and seq % 1000 = 2",
    "unions": "select 'representation_union' as code, image_id as key from active where cast(substr(image_id, 5) as bigint) % 1000 = 3",
    "bounds": "select 'frame_bounds' as code, image_id as key from members where seq % 1000 = 4",
    "orphans": "select 'orphan_representation' as code, 'lost-' || image_id as key from active where cast(substr(image_id, 5) as bigint) % 1000 = 5",
}
ISSUES = " union all ".join(PLANTED.values())


def broken(spark, d) -> DataFrame:
    """Violations of the catalog's constraints, each kind planted in a thousandth of the rows."""
    made, n = A.Packed.of(spark, d), F.substring("image_id", 5, 20).cast("long")
    images = A.images(spark, d)
    halves = images.withColumn("stream", F.when((F.col("seq") % 1000 == 1) & F.col("run").isNotNull(), None).otherwise(F.col("stream")))
    again = images.where("run is not null and seq % 1000 = 2").withColumn("image_id", F.concat(F.lit("twin-"), "image_id"))
    active = made.active.withColumn("segment_id", F.when(n % 1000 != 3, F.col("segment_id")).when(F.col("segment_id").isNull(), "x"))
    lost = made.active.where(n % 1000 == 5).withColumn("image_id", F.concat(F.lit("lost-"), "image_id"))
    places = made.members.select("image_id", F.when(F.col("seq") % 1000 == 4, F.col("frame_count")).otherwise(F.col("frame_index")).alias("frame_index"), "frame_count")
    return pruning.constraint_issues(halves.unionByName(again), active.unionByName(lost), places)


@query(ISSUES)
def verify_constraints(spark, d) -> DataFrame:
    return broken(spark, d)


@query(f"select cast((select count(*) from images) as bigint) as images_checked, cast(count(*) as bigint) as error_count, cast(count(distinct code) as bigint) as codes, count(*) = 0 as valid from ({ISSUES}) q")
def verify_rollup(spark, d) -> DataFrame:
    return pruning.rollup(broken(spark, d), A.images(spark, d))


@query(f"select code, key from ({ISSUES}) q order by code, key limit 20")
def verify_examples(spark, d) -> DataFrame:
    return pruning.first_examples(broken(spark, d), "code", "key")


@query("select segment_id, cast(2 as bigint) as widths from members where frame_index = 1 and seq % 5 = 0")
def segment_homogeneity(spark, d) -> DataFrame:
    """Segments that mix widths: planted where the second frame's number is divisible by five."""
    members = A.Packed.of(spark, d).members
    width = F.when((F.col("frame_index") == 1) & (F.col("seq") % 5 == 0), F.col("width") + 10).otherwise(F.col("width"))
    return packing.mixed_segments(members.withColumn("width", width))

