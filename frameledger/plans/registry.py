"""Queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameledger.functions import canonical, columns, tokens
from frameledger.operators import blocks, catalog, judgments, packing, pruning
from frameledger.sources.shared import held

from . import analogs as A
from . import pictures, rules  # noqa: F401  (their queries register themselves)
from .base import ORACLES, QUERIES, query  # noqa: F401

LIST = ["seq", "image_id", "run", "stream", "frame_no", "width"]
ROW = ", ".join(LIST)


# pages and lookups


@query(f"select {ROW} from images order by seq desc limit 21")
def list_all(spark, d) -> DataFrame:
    return catalog.page(A.images(spark, d).select(*LIST), 20)


@query(f"select {ROW} from images where run='u1' order by seq desc limit 21")
def list_run(spark, d) -> DataFrame:
    return catalog.page(A.images(spark, d).select(*LIST), 20, where={"run": "u1"})


@query(f"select {ROW} from images where seq<=900 and seq<450 order by seq desc limit 21")
def list_page2_snapshot(spark, d) -> DataFrame:
    return catalog.page(A.images(spark, d).select(*LIST), 20, last=450, high=900)


@query("select cast(coalesce(max(seq),0) as bigint) as high from images")
def high_water(spark, d) -> DataFrame:
    return catalog.high_water(A.images(spark, d))


@query("""select p.seq, p.image_id, a.representation_kind, cast(case when a.representation_kind='png' then o.byte_length else m.segment_bytes end as bigint) as stored_bytes
 from (select * from images order by seq desc limit 21) p join active a using (image_id) left join objects o on o.sha256=a.png_sha
 left join members m on m.image_id=p.image_id""")
def list_stored_bytes(spark, d) -> DataFrame:
    page = held(catalog.page(A.images(spark, d), 20))
    made = A.Packed.of(spark, d, page.where("run is not null").select("run").distinct())
    return catalog.info_page(page, made.log, A.objects(spark, d), made.members.select("image_id", "segment_id", "frame_index"), made.segments).select("seq", "image_id", "representation_kind", "stored_bytes")


@query("""select i.seq, i.image_id, i.run, i.stream, i.frame_no, a.representation_kind, a.representation_version, a.segment_id, m.frame_index, cast(case when a.representation_kind='png' then o.byte_length else m.segment_bytes end as bigint) as stored_bytes, cast(case when a.representation_kind='png' then 1 else m.frame_count end as bigint) as shared_image_count
 from images i join active a using (image_id) left join objects o on o.sha256=a.png_sha left join members m on m.image_id=i.image_id""")
def info_record(spark, d) -> DataFrame:
    made = A.Packed.of(spark, d)
    return catalog.info(A.images(spark, d), made.active, A.objects(spark, d), made.members.select("image_id", "segment_id", "frame_index"), made.segments)


@query("""select seq, image_id, running_bytes from (select seq, image_id, cast(sum(length(image_id)*20) over (order by seq desc) as bigint) as running_bytes from (select *
 from images order by seq desc limit 101) p) q where running_bytes <= 16320""")
def page_byte_budget(spark, d) -> DataFrame:
    return catalog.byte_budget(catalog.page(A.images(spark, d), 100), F.octet_length("image_id") * 20).select("seq", "image_id", "running_bytes")


@query(f"select {ROW} from images where run='u1' and stream='click' and frame_no=2")
def get_frame(spark, d) -> DataFrame:
    return catalog.frame(A.images(spark, d).select(*LIST), "u1", "click", 2)


@query("""select i.seq, i.image_id, i.run, i.stream, i.frame_no, p.image_id as previous_image_id, p.pixel_sha256 = i.pixel_sha256 as same_pixels from images i
 left join images p on p.run=i.run and p.stream=i.stream and p.frame_no=i.frame_no-1""")
def features_previous(spark, d) -> DataFrame:
    return catalog.previous_frame(A.images(spark, d))


# ingest


def operations(spark, d) -> DataFrame:
    """Two images an operation."""
    return A.images(spark, d).select("image_id", F.concat(F.lit("op-"), F.floor(F.col("seq") / 2).cast("string")).alias("operation_id"), (F.col("seq") % 3).cast("string").alias("fingerprint"), "seq")


@query("""with o as (select seq, image_id, 'op-' || (seq // 2) as operation_id, cast(seq % 3 as varchar) as fp from images)
 select b.seq, b.operation_id, e.image_id as known_image_id, case when e.fp is null then 'insert' when e.fp = b.fp then 'reuse' else 'conflict' end as outcome
 from o b left join (select * from o where seq % 4 = 0) e using (operation_id)""")
def op_retry_conflict(spark, d) -> DataFrame:
    """Every image against those that every other operation has stored."""
    rows = operations(spark, d)
    return catalog.retries(rows, rows.where("seq % 4 = 0").select("image_id", "operation_id", "fingerprint")).select("seq", "operation_id", "known_image_id", "outcome")


@query("""with h as (select max(seq) // 2 as half from images), e as (select run, stream, max(frame_no) + 1 as base from images, h where seq <= half group by 1, 2)
 select i.seq, i.run, i.stream, case when i.run is not null then cast(row_number() over (partition by i.run, i.stream order by i.seq) - 1 as bigint) + coalesce(e.base, 0) end as new_frame_no
 from images i join h on i.seq > h.half left join e on e.run = i.run and e.stream = i.stream""")
def frame_alloc(spark, d) -> DataFrame:
    """The later half of the images as a batch behind the earlier one."""
    rows = A.images(spark, d)
    half = catalog.high_water(A.table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"))).first()["high"] // 2
    return catalog.allocate_frames(rows.where(F.col("seq") > half).drop("frame_no"), rows.where(F.col("seq") <= half)).select("seq", "run", "stream", "new_frame_no")


@query("""select seq, run, case when run is not null then 'default' end as stream, case when run is not null then cast(row_number() over (partition by run order by seq)-1 as bigint) end as frame_no
 from images""")
def v1_backfill(spark, d) -> DataFrame:
    return catalog.backfill_frames(A.images(spark, d).select("seq", "run")).select("seq", "run", "stream", "frame_no")


@query("""select o_orderkey, nullif(case when o_orderkey%3=0 then '' else o_orderpriority end,'') as label, array_to_string(list_sort(list_distinct([o_orderstatus, o_orderpriority, o_orderstatus])),'|') as tags, case when strlen(repeat('界', cast(o_orderkey%60 as integer)))>128 then 'E_LIMIT_EXCEEDED' end as error
 from orders""")
def metadata_normalise(spark, d) -> DataFrame:
    rows = A.table(spark, d, "orders").select(
        "o_orderkey", F.expr("repeat('界', cast(o_orderkey % 60 as int))").alias("run"), F.lit(None).cast("string").alias("stream"), F.lit("").alias("note"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("label"), F.array("o_orderstatus", "o_orderpriority", "o_orderstatus").alias("tags"),
    )
    return catalog.normalise_metadata(rows).select("o_orderkey", "label", F.array_join("tags", "|").alias("tags"), "error")


@query("select sha256(text) as sha256, cast(max(strlen(text)) as bigint) as byte_length, cast(count(*) as bigint) as copies from documents group by 1")
def dedupe_blobs(spark, d) -> DataFrame:
    rows = A.table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byte_length"))
    return rows.groupBy("sha256").agg(F.max("byte_length").alias("byte_length"), F.count(F.lit(1)).alias("copies"))


@query("select distinct sha256(text) as sha256 from documents where sha256(text) not in (select sha256(text) from documents where doc_id%2=0)")
def insert_absent(spark, d) -> DataFrame:
    rows = A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return catalog.insert_absent(rows, rows.where("doc_id % 2 = 0").distinct()).select("sha256")


@query("select image_id, 'objects/sha256/'||substr(pixel_sha256,1,2)||'/'||substr(pixel_sha256,3,2)||'/'||pixel_sha256||'.png' as path from images")
def object_path(spark, d) -> DataFrame:
    return A.images(spark, d).select("image_id", catalog.object_path(F.col("pixel_sha256"), "png").alias("path"))


@query("""select o_orderkey, sha256('[2,"'||o_orderstatus||'",null,"'||o_orderpriority||'"]') as fingerprint from orders""")
def fingerprint(spark, d) -> DataFrame:
    return A.table(spark, d, "orders").select("o_orderkey", catalog.fingerprint(F.lit(2), F.col("o_orderstatus"), F.lit(None).cast("string"), F.col("o_orderpriority")).alias("fingerprint"))


# judgments

J = "seq, image_id, kind, producer, value_json, confidence"


@query(f"select {J} from judgments where kind='toxic' and value_json='true' order by seq desc limit 21")
def judg_by_kind_value(spark, d) -> DataFrame:
    return judgments.search(A.judgments(spark, d), 20, kind="toxic", value=" true ")


@query(f"select {J} from judgments where confidence<0.25 order by seq desc limit 21")
def judg_conf_below(spark, d) -> DataFrame:
    return judgments.search(A.judgments(spark, d), 20, confidence_below=0.25)


@query(f"select {J} from judgments where producer='rule' and seq<=400 and seq<300 order by seq desc limit 21")
def judg_producer_page(spark, d) -> DataFrame:
    return judgments.search(A.judgments(spark, d), 20, producer="rule", last=300, high=400)


@query(f"select {J} from (select *, row_number() over (partition by image_id, kind order by seq desc) as r from judgments) q where r=1")
def judg_latest_per_image(spark, d) -> DataFrame:
    return judgments.latest(A.judgments(spark, d))


@query("""select event_id, '{"a":['||event_id||'.5,'||event_id||'],"b":"'||event_type||'"}' as value_json from events""")
def canonical_json(spark, d) -> DataFrame:
    raw = F.format_string('{ "b" : "%s", "a":[%d.50, %d] }', "event_type", "event_id", "event_id")
    return A.table(spark, d, "events").select("event_id", canonical.canonical(raw).alias("value_json"))


# packing

P = "run, stream, isl, part"


@query("select seq, run, stream, frame_no, png_sha, png_bytes from candidates where seq<=(select coalesce(max(seq),0) from images)")
def pack_candidates(spark, d) -> DataFrame:
    """All candidates: the bound is the highest seq, frozen as a pack does."""
    rows = A.images(spark, d)
    return packing.candidates(rows, A.stored(spark, d).drop("png_bytes"), A.objects(spark, d), high=catalog.high_water(rows).first()["high"]).select("seq", "run", "stream", "frame_no", "png_sha", "png_bytes")


@query(f"select {P}, n, first_frame, last_frame from plan")
def pack_groups(spark, d) -> DataFrame:
    return packing.plan(A.grouped(spark, d)).select("run", "stream", "isl", "part", "n", "first_frame", "last_frame")


@query(f"select {P} from plan where status='skipped'")
def pack_skipped_singletons(spark, d) -> DataFrame:
    return packing.plan(A.grouped(spark, d)).where("status = 'skipped'").select("run", "stream", "isl", "part")


@query("select segment_id, png_distinct_bytes from plan")
def pack_distinct_bytes(spark, d) -> DataFrame:
    return packing.plan(A.grouped(spark, d)).select("segment_id", "png_distinct_bytes")


@query("select segment_id, n, candidate_bytes, png_distinct_bytes, status, reason from plan")
def pack_decision(spark, d) -> DataFrame:
    return packing.plan(A.grouped(spark, d)).select("segment_id", "n", "candidate_bytes", "png_distinct_bytes", "status", "reason")


@query("""select cast(count(*) as bigint) as groups_considered, cast(coalesce(sum(n),0) as bigint) as candidate_images,
 cast(count(*) filter (status='packed') as bigint) as segments_packed, cast(coalesce(sum(n) filter (status='packed'),0) as bigint) as images_packed,
 cast(count(*) filter (status='not_beneficial') as bigint) as segments_not_beneficial, cast(coalesce(sum(n) filter (status='not_beneficial'),0) as bigint) as images_not_beneficial,
 cast(coalesce(sum(n) filter (status='skipped'),0) as bigint) as images_skipped, cast(count(*) filter (status='failed') as bigint) as segments_failed,
 cast(coalesce(sum(png_distinct_bytes) filter (status not in ('skipped','failed')),0) as bigint) as png_distinct_bytes,
 cast(coalesce(sum(candidate_bytes) filter (status not in ('skipped','failed')),0) as bigint) as temporal_candidate_bytes,
 cast(coalesce(sum(candidate_bytes) filter (status='packed'),0) as bigint) as published_object_bytes
 from (select n, png_distinct_bytes, candidate_bytes, case when n<2 then 'skipped' when isl%13=0 then 'failed' when isl%11=0 then 'not_beneficial' else status end as status from plan) q""")
def pack_report(spark, d) -> DataFrame:
    planned = A.Packed.of(spark, d).plan
    found = planned.withColumns({"error": F.when(F.col("isl") % 13 == 0, "E_INTEGRITY"), "inter_predicted": F.col("isl") % 11 != 0})
    return packing.report(packing.decided(found))


def members_of(spark, d) -> DataFrame:
    return A.Packed.of(spark, d).members


@query("select segment_id, string_agg(image_id, ',' order by frame_index) as images from members group by 1")
def segment_members(spark, d) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("frame_index", "image_id")))  # 128 members at most
    return members_of(spark, d).groupBy("segment_id").agg(F.array_join(F.transform(listed, lambda x: x["image_id"]), ",").alias("images"))


@query("select image_id, representation_version, representation_kind, png_sha, segment_id from active")
def repr_active(spark, d) -> DataFrame:
    return packing.active(A.Packed.of(spark, d).log)


@query("select image_id, png_sha, representation_version, replacement_version, prune_state from retired")
def repr_retired(spark, d) -> DataFrame:
    return A.Packed.of(spark, d).retired.select("image_id", "png_sha", "representation_version", "replacement_version", "prune_state")


@query("select segment_id, bool_or(seq%11=0) as moved from members group by 1")
def pack_activation(spark, d) -> DataFrame:
    log, rows = A.stored(spark, d).drop("png_bytes"), members_of(spark, d)
    moved = log.join(rows.where("seq % 11 = 0").select("image_id"), "image_id", "left_semi").withColumn("representation_version", F.lit(2))
    return packing.activation(rows.select("segment_id", "image_id", "representation_version", "png_sha"), log.unionByName(moved)).select("segment_id", "moved")


# capacity, pruning, verification


def refs(spark, d, made: A.Packed | None = None) -> DataFrame:
    made = made or A.Packed.of(spark, d)
    return pruning.live_refs((made.active, "png_sha", "active"), (A.sources(spark, d), "source_sha", "source"))


@query("select cast(coalesce(sum(byte_length),0) as bigint) as bytes, cast(count(*) as bigint) as objects from objects where sha256 in (select png_sha from active where png_sha is not null)")
def cap_active(spark, d) -> DataFrame:
    return pruning.capacity(A.objects(spark, d), refs(spark, d).where("role = 'active'"))


@query("select cast(coalesce(sum(byte_length),0) as bigint) as bytes, cast(count(*) as bigint) as objects from objects where sha256 in (select png_sha from sources)")
def cap_source(spark, d) -> DataFrame:
    return pruning.capacity(A.objects(spark, d), refs(spark, d).where("role = 'source'"))


def prunable(spark, d, made: A.Packed) -> DataFrame:
    return pruning.candidates(made.retired, A.objects(spark, d), refs(spark, d, made))


@query("select sha256, byte_length from prunable")
def prune_candidates(spark, d) -> DataFrame:
    return prunable(spark, d, A.Packed.of(spark, d))


@query("select sha256, total, covered from coverage")
def prune_coverage(spark, d) -> DataFrame:
    made = A.Packed.of(spark, d)
    return pruning.coverage(made.retired, made.active)


@query("""select cast(count(*) filter (total=covered) as bigint) as reclaimable_objects, cast(coalesce(sum(byte_length) filter (total=covered),0) as bigint) as reclaimable_bytes, cast(count(*) filter (total<>covered) as bigint) as held_objects, count(*) filter (total=covered)>10000 as over_limit
 from prunable join coverage using (sha256)""")
def prune_report(spark, d) -> DataFrame:
    made = A.Packed.of(spark, d)
    return pruning.report(prunable(spark, d, made), pruning.coverage(made.retired, made.active), 10_000)


@query("select sha256 from objects where sha256 not in (select sha256 from live)")
def unreferenced_objects(spark, d) -> DataFrame:
    return pruning.unreferenced(A.objects(spark, d).select("sha256"), refs(spark, d))


@query("select sha256 from objects where sha256 in (select sha256 from live)")
def expected_present(spark, d) -> DataFrame:
    return A.objects(spark, d).select("sha256").join(refs(spark, d), "sha256", "left_semi")


@query("select sha256(text) as sha256, case when max(doc_id)%10=0 then 'missing' when max(doc_id)%10=1 then 'length' else 'hash' end as issue from documents group by 1 having max(doc_id)%10<3")
def verify_blob_hash(spark, d) -> DataFrame:
    rows = A.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.max("doc_id").alias("id"), F.max("text").alias("text"))
    n = F.col("id") % 10
    # a byte too many, whatever the text ends in: its length tells, or its hash alone where the length on record has it too
    more = F.concat(F.coalesce("text", F.lit("")), F.lit("x"))
    objects = rows.select("sha256", F.octet_length(F.when((n < 3) & (n != 1), more).otherwise(F.col("text"))).cast("long").alias("byte_length"))
    present = rows.where(~n.eqNullSafe(0)).select("sha256", F.when(n < 3, more).otherwise(F.col("text")).cast("binary").alias("content"))
    return pruning.blob_issues(objects, present)


# bytes


def text_frames(spark, d) -> DataFrame:
    """Turns as one-row frames, 128 of a conversation at most in a segment, which gives them their width. A conversation of any length is spread over tasks."""
    rows = A.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("samples"))
    rows = blocks.numbered(rows, ["conv_id"], "turn", "place")
    rows = rows.withColumn("segment_id", F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.floor(F.col("place") / 128).cast("string")))
    segment = Window.partitionBy("segment_id")
    rows = rows.withColumns({"width": F.ceil(F.max(F.octet_length("samples")).over(segment) / 3).cast("int"), "n": F.count(F.lit(1)).over(segment)})
    padded = F.unhex(F.expr("cast(rpad(hex(samples), width * 6, '00') as string)"))
    return rows.select("segment_id", (F.col("place") % 128).alias("frame_no"), "width", F.lit(1).alias("height"), F.lit(3).alias("channels"), padded.alias("samples"), F.col("samples").alias("text"), "n")


@query("""with places as (select *, row_number() over (partition by conv_id order by turn)-1 as place
 from conversations), parts as (select *, count(*) over (partition by conv_id, place//128) as n from places)
 select 'c-'||conv_id||'-'||(place//128) as segment_id, cast(place%128 as integer) as frame_index, sha256(text) as text_sha256, case when n<2 then 'skipped' else 'coded' end as status from parts""")
def codec_roundtrip(spark, d) -> DataFrame:
    """All turns: a conversation is cut into parts of 128 frames at most; the turn of a one-turn part is not coded and stays as it is."""
    frames = held(text_frames(spark, d))
    coded = frames.where("n >= 2")
    segments = columns.encode_groups(coded.withColumns({"group_id": F.col("segment_id"), "image_id": F.concat_ws("/", "segment_id", F.col("frame_no").cast("string"))}))
    out = columns.decode_segments(segments.withColumn("segment_id", F.col("group_id")))
    out = out.join(coded.select("segment_id", F.col("frame_no").cast("int").alias("frame_index"), F.octet_length("text").alias("size")), ["segment_id", "frame_index"])
    out = out.select("segment_id", "frame_index", F.sha2(F.expr("substring(samples, 1, size)"), 256).alias("text_sha256"), F.lit("coded").alias("status"))
    return out.unionAll(frames.where("n < 2").select("segment_id", F.col("frame_no").cast("int"), F.sha2("text", 256), F.lit("skipped")))


@query("select event_type, list_sort(list(value))[cast(ceil(count(*)*50/100.0) as integer)] as p50, list_sort(list(value))[cast(ceil(count(*)*95/100.0) as integer)] as p95 from events group by 1")
def latency_percentiles(spark, d) -> DataFrame:
    return A.table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("select image_id, 'frame://store/images/'||image_id as reference from images")
def references(spark, d) -> DataFrame:
    return A.images(spark, d).select("image_id", tokens.reference("store", F.col("image_id")).alias("reference"))


@query("select event_id, strftime(ts - interval 9 hour, '%Y-%m-%dT%H:%M:%S.%f')||'000Z' as captured_at from events")
def captured_utc(spark, d) -> DataFrame:
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+09:00'")
    return A.table(spark, d, "events").select("event_id", tokens.utc(local).alias("captured_at"))


@query("select seq, cast(width*(case when seq%2=0 then 72+16 else 36+12 end) + 2*(seq%1000) + 2*seq + 33554432 as bigint) as bytes from images")
def decode_memory(spark, d) -> DataFrame:
    return A.images(spark, d).select("seq", packing.decode_memory(F.col("width"), F.lit(1), F.col("seq") % 2 == 0, F.col("seq") % 1000, F.col("seq")).alias("bytes"))
