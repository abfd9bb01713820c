"""The stored catalog: commits, puts, pages, judgments, packing, pruning, streams, files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.errors import LedgerError
from frameledger.functions import png, tokens
from frameledger.sources import files, ledger
from frameledger.sources.ledger import Ledger
from frameledger.streaming.ingest import ingest, outcomes


def picture(i: int, width: int = 64, height: int = 48) -> bytes:
    y, x = np.mgrid[:height, :width]
    samples = np.stack([13 * x % 256, 17 * y % 256, 7 * (x + y) % 256], axis=2).astype(np.uint8)
    samples[5:10, i : i + 4] = (255, 0, 31)
    lines = png.refilter(samples.reshape(height, width * 3), bytes(height), 3)
    return png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(lines, 0)) + png.chunk(b"IEND", b"")


def batch(spark, rows):
    return spark.createDataFrame(rows, "key string, content binary, run string, operation_id string")


def code(call, *args, **named):
    with pytest.raises(LedgerError) as caught:
        call(*args, **named)
    return caught.value.code


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    """Ten frames of one run, one image outside any run, a broken one, a retry and a conflict; then packed."""
    root = str(tmp_path_factory.mktemp("store"))
    store = Ledger.init(spark, root)
    rows = [(f"k{i:02}", picture(i), "r", f"op{i}") for i in range(10)]
    rows += [("k10", picture(0), None, None), ("k11", b"no image", "r", None), ("k12", picture(0), "r", "op0"), ("k13", picture(1), "r", "op0")]
    out = {r["key"]: r for r in store.put(batch(spark, rows)).collect()}
    again = {r["key"]: r for r in store.put(batch(spark, rows[:3])).collect()}
    plan = store.pack(size=4).collect()
    return store, out, again, plan


def test_put_outcomes(packed):
    store, out, again, _ = packed
    assert [out[f"k{i:02}"]["outcome"] for i in range(14)] == ["insert"] * 11 + ["rejected", "reuse", "conflict"]
    assert out["k11"]["error"] == "E_INVALID_IMAGE" and out["k13"]["error"] == "E_CONFLICT"
    assert out["k12"]["image_id"] == out["k00"]["image_id"]
    assert {k: (r["outcome"], r["image_id"]) for k, r in again.items()} == {k: ("reuse", out[k]["image_id"]) for k in again}
    rows = store.table("images").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 12)) and [r["frame_no"] for r in rows] == [*range(10), None]
    assert {r["stream"] for r in rows} == {"default", None}


def test_pages_follow_a_snapshot(packed):
    store = packed[0]
    items, cursor = store.list(limit=4)
    assert [r["seq"] for r in items] == [11, 10, 9, 8]
    items, cursor = store.list(limit=4, cursor=cursor)
    assert [r["seq"] for r in items] == [7, 6, 5, 4] and items[0]["reference"].startswith(f"frame://{store.id}/")
    items, end = store.list(limit=4, cursor=cursor)
    assert [r["seq"] for r in items] == [3, 2, 1] and end is None
    assert code(store.list, "r", 4, cursor) == "E_INVALID_CURSOR" and code(store.list, limit=0) == "E_INVALID_ARGUMENT"


def test_packed_frames_come_back(packed):
    store, out, _, plan = packed
    assert sorted((r["n"], r["status"]) for r in plan) == [(2, "packed"), (4, "packed"), (4, "packed")]
    for i in (0, 5, 9):
        got = png.meta(png.parse(store.get(out[f"k{i:02}"]["image_id"])))
        assert got == png.meta(png.parse(picture(i)))
    assert store.verify().count() == 0
    bytes_ = {r["sha256"]: r["byte_length"] for r in store.table("blobs").collect()}
    parts = {r["image_id"]: r["descriptor_sha"] for r in store.table("png_reconstruction").collect()}
    colour = {r["segment_id"]: r["color_sha"] for r in store.table("segments").collect()}
    for r in store.list(limit=50)[0]:
        assert r["representation_kind"] == "png" or r["stored_bytes"] == bytes_[colour[r["segment_id"]]] + bytes_[parts[r["image_id"]]]
    assert code(store.get, "none") == "E_NOT_FOUND" and code(store.get, out["k00"]["image_id"], "source") == "E_SOURCE_NOT_RETAINED"


def test_prune_leaves_what_is_referenced(spark, packed, monkeypatch):
    store, out = packed[0], packed[1]
    before = store.version
    found = {r["sha256"] for r in store.prune().collect()}
    assert len(found) == 9  # the image outside any run still holds one of the ten
    assert code(store.prune, True, 8) == "E_LIMIT_EXCEEDED"

    def crash(name):
        if name == "prune-after-pending":
            raise OSError

    monkeypatch.setattr(ledger, "fault", crash)
    with pytest.raises(OSError):
        store.prune(apply=True)
    monkeypatch.setattr(ledger, "fault", lambda name: None)
    store = Ledger.open(spark, store.root)
    assert {r["prune_state"] for r in store.retired().collect()} == {"pending", "retained"} and store.verify_report()["valid"]
    done = store.prune(apply=True)  # takes up what was cut off
    assert {r["sha256"] for r in done.collect()} == found
    report = store.prune_report(done, before)
    assert report["pruned_objects"] == 9 and report["physical_object_bytes_before"] - report["physical_object_bytes_after"] == report["reclaimed_bytes"] > 0
    assert store.prune().count() == 0 and store.verify().count() == 0
    assert store.get(out["k10"]["image_id"]) and store.get(out["k03"]["image_id"])
    old = Ledger.open(spark, store.root, before)
    assert old.table("blobs").count() == store.table("blobs").count() + 9
    assert store.compact() == 1 and store.batches().count() == store.table("blobs").count()
    assert store.get(out["k03"]["image_id"]) and store.vacuum(age=0) and store.verify_report()["valid"] and code(store.get, "none") == "E_NOT_FOUND"
    # the same picture comes back after its object was pruned
    again = store.put(batch(spark, [("again", picture(4), "r2", None)])).first()
    assert png.meta(png.parse(store.get(again["image_id"]))) == png.meta(png.parse(picture(4)))


def test_frames_and_memory(packed):
    store, out = packed[0], packed[1]
    store = Ledger.open(store.spark, store.root)
    image, data = store.get_frame("r", 5)
    assert image == out["k05"]["image_id"] and png.meta(png.parse(data)) == png.meta(png.parse(picture(5)))
    assert code(store.get_frame, "r", 10) == "E_NOT_FOUND" == code(store.get_frame, "r", 5, "other")
    assert code(store.get_frame, "r", 5, limits=png.Limits(memory_bytes=1 << 20)) == "E_LIMIT_EXCEEDED"
    assert store.features(image)["previous_image_id"] == out["k04"]["image_id"] and store.features(image)["same_pixels"] is False


def noise(i: int) -> bytes:
    samples = np.random.default_rng(i).integers(0, 256, (60, 80, 4), dtype=np.uint8)
    lines = png.refilter(samples.reshape(60, 320), bytes(60), 4)
    return png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 80, 60, 8, 6, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(lines, 9)) + png.chunk(b"IEND", b"")


def test_pack_outcomes_limits_and_races(spark, tmp_path, monkeypatch):
    store = Ledger.init(spark, str(tmp_path / "s"))
    rows = [(f"a{i}", picture(i), "good", None) for i in range(5)] + [(f"b{i}", noise(i), "noise", None) for i in range(4)] + [(f"c{i}", picture(i, 80), "broken", None) for i in range(4)]
    ids = {r["key"]: r["image_id"] for r in store.put(batch(spark, rows)).collect()}
    status = lambda plan: sorted((r["run"], r["n"], r["status"], r["reason"]) for r in plan.collect())
    assert code(store.pack, size=4, limits=ledger.PackLimits(max_images=12)) == "E_LIMIT_EXCEEDED"
    for limits in (ledger.PackLimits(descriptor_bytes=10), ledger.PackLimits(segment_bytes=40), ledger.PackLimits(segment_packets=2), ledger.PackLimits(encode_seconds=-1), ledger.PackLimits(image=png.Limits(memory_bytes=32 << 20))):
        assert {r["reason"] for r in store.pack("good", size=4, limits=limits).collect()} == {"E_LIMIT_EXCEEDED", "insufficient_compatible_frames"}
    # images that are not what the catalog says fail with their group alone
    wrong = store.table("images").where("run = 'good' and frame_no < 2").withColumns({"run": F.lit("wrong"), "image_id": F.concat(F.lit("w"), "image_id"), "seq": F.col("seq") + 100, "pixel_sha256": F.lit("0" * 64)})
    forms = store.table("representations").withColumn("image_id", F.concat(F.lit("w"), "image_id")).join(wrong.select("image_id"), "image_id", "left_semi")
    store = store.commit(lambda at: {"images": wrong, "representations": forms})
    dry = store.pack(size=4, dry_run=True)
    assert status(dry) == [
        ("broken", 4, "would_pack", "temporal_bytes_smaller_than_distinct_png_bytes"), ("good", 1, "skipped", "insufficient_compatible_frames"), ("good", 4, "would_pack", "temporal_bytes_smaller_than_distinct_png_bytes"),
        ("noise", 4, "not_beneficial", "no_inter_prediction"), ("wrong", 2, "failed", "E_INTEGRITY"),
    ]
    report = ledger.pack_report(dry, True)
    assert (report["groups_considered"], report["candidate_images"], report["images_skipped"], report["segments_packed"], report["result_count"]) == (5, 15, 1, 0, 5)
    assert ledger.pack_report(store.pack("absent"))["results"][0]["status"] == "no_op"
    # one group's images move on while it is coded
    raced = []

    def other(name):
        if name == "staged-representations" and not raced:
            raced.append(1)
            now = Ledger.open(spark, store.root)
            one = now.active().where(F.col("image_id") == ids["c2"]).withColumn("representation_version", F.lit(2))
            monkeypatch.setattr(ledger, "fault", lambda name: None)
            now.commit(lambda at: {"representations": one})

    monkeypatch.setattr(ledger, "fault", other)
    plan = store.pack(size=4)
    assert [r for r in status(plan) if r[0] in ("broken", "good")] == [("broken", 4, "skipped", "concurrent_representation_change"), ("good", 1, "skipped", "insufficient_compatible_frames"), ("good", 4, "packed", "temporal_bytes_smaller_than_distinct_png_bytes")]
    assert {r["key"] for r in store.verify().collect()} <= {r["png_sha"] for r in forms.collect()}
    # segments are named by their content
    segment = store.table("segments").first()
    members = [r["image_id"] for r in store.table("frame_locations").orderBy("frame_index").collect()]
    assert segment["segment_id"] == ledger.container_id(segment, members)


def test_verify_finds_what_is_planted(spark, tmp_path):
    store = Ledger.init(spark, str(tmp_path / "s"))
    ids = {r["key"]: r["image_id"] for r in store.put(batch(spark, [(f"k{i}", picture(i), "r", None) for i in range(4)])).collect()}
    store.pack(size=2)
    good = store.verify_report()
    assert good["valid"] and (good["images_checked"], good["segments_checked"], good["error_count"]) == (4, 2, 0)
    rows = store.table("images")
    wrong = rows.where(F.col("image_id") == ids["k1"]).withColumns({"image_id": F.lit("twin"), "pixel_sha256": F.lit("0" * 64), "seq": F.lit(9)})
    lone = store.table("representations").where(F.col("image_id") == ids["k1"]).where("representation_kind = 'png'").withColumn("image_id", F.lit("twin"))
    spare = spark.createDataFrame([("ab" * 32, 3, "png", "text/plain", "x", b"abc")], "sha256 string, byte_length long, object_kind string, media_type string, relative_path string, content binary")
    place = store.table("frame_locations").where(F.col("image_id") == ids["k0"]).withColumn("frame_index", F.lit(7))
    store.commit(lambda at: {"images": wrong, "representations": lone, "blobs": spare, "frame_locations": place})
    found = Ledger.open(spark, store.root).verify_report()
    codes = {r["code"] for r in found["issues"]}
    assert not found["valid"] and {"duplicate_frame", "E_INTEGRITY", "blob_hash", "blob_path", "unreferenced_candidate", "frame_bounds", "E_INVALID_IMAGE"} <= codes
    assert found["unreferenced_candidates"] == 1 and found["issue_count"] == found["error_count"] + 1


def test_judgments(spark, packed):
    store, out = Ledger.open(spark, packed[0].root), packed[1]
    image = out["k00"]["image_id"]
    texts = [("a", image, '{"kind":"k","producer":"p","value":{"b":1,"a":2.50},"confidence":0.2}'), ("b", image, '{"kind":"k","producer":"p","value":1,"extra":0}'), ("c", "absent", '{"kind":"k","producer":"p","value":1}'), ("d", image, '{"kind":"k","producer":"p","value":null,"confidence":1.5}'), ("e", image, "[")]
    errors = {r["key"]: r["error"] for r in store.judge(spark.createDataFrame(texts, "key string, image_id string, json string")).collect()}
    assert errors == {"a": None, "b": "E_INVALID_ARGUMENT", "c": "E_NOT_FOUND", "d": "E_INVALID_ARGUMENT", "e": "E_INVALID_ARGUMENT"}
    items, cursor = store.search(value='{"a":2.5,"b":1}', confidence_below=0.5)
    assert [r["value_json"] for r in items] == ['{"a":2.5,"b":1}'] and cursor is None and items[0]["metadata_json"] == "{}"
    assert store.search(confidence_below=0.2)[0] == []


def test_writers_meet(spark, tmp_path, monkeypatch):
    store = Ledger.init(spark, str(tmp_path / "s"))
    met = []

    def other(name):
        if name == "before-commit" and not met:
            met.append(name)
            Ledger.open(spark, store.root).put(batch(spark, [("x", picture(3), "r", None)]))

    monkeypatch.setattr(ledger, "fault", other)
    store.put(batch(spark, [("y", picture(4), "r", None)]))
    assert [(r["seq"], r["frame_no"]) for r in store.table("images").orderBy("seq").collect()] == [(1, 0), (2, 1)]

    def crash(name):
        if name == "before-commit":
            raise OSError

    monkeypatch.setattr(ledger, "fault", crash)
    with pytest.raises(OSError):
        store.put(batch(spark, [("z", picture(5), "r", None)]))
    assert Ledger.open(spark, store.root).table("images").count() == 2
    monkeypatch.setattr(ledger, "fault", lambda name: None)
    assert store.restore(1).table("images").count() == 1
    assert Ledger.init(spark, store.root).id == store.id
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "file").write_text("x")
    assert code(Ledger.init, spark, str(tmp_path / "full")) == "E_CONFLICT" and code(Ledger.open, spark, str(tmp_path / "no")) == "E_STORE_NOT_INITIALIZED"


def test_stream_is_put_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(picture(i))
    store = Ledger.init(spark, str(tmp_path / "s"))
    for mark in ("one", "one", "two"):  # the same checkpoint, and a lost one
        ingest(spark, str(tmp_path / "in"), store.root, str(tmp_path / mark), run="cam").awaitTermination(120)
    assert [r["frame_no"] for r in Ledger.open(spark, store.root).table("images").orderBy("seq").collect()] == [0, 1, 2]
    assert [r["outcome"] for r in outcomes(spark, str(tmp_path / "one")).collect()] == ["insert"] * 3 and {r["outcome"] for r in outcomes(spark, str(tmp_path / "two")).collect()} == {"reuse"}
    # a file that changes and keeps its length, and one that is no image
    for i, content in ((5, picture(7)), (6, b"x")):
        (tmp_path / "in" / f"{i}.png").write_bytes(content)
    ingest(spark, str(tmp_path / "in"), store.root, str(tmp_path / "two"), run="cam").awaitTermination(120)
    (tmp_path / "in" / "5.png").write_bytes(picture(8))
    ingest(spark, str(tmp_path / "in"), store.root, str(tmp_path / "three"), run="cam").awaitTermination(120)
    assert Ledger.open(spark, store.root).table("images").count() == 5 and {r["error"] for r in outcomes(spark, str(tmp_path / "two")).where("outcome = 'rejected'").collect()} == {"E_INVALID_IMAGE"}


def test_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.png").write_bytes(picture(i) * (i + 1))
    seen = spark.createDataFrame(files.images(spark, str(tmp_path), png.Limits(source_bytes=len(picture(0)))).collect(), "key string, content binary, length long, modified timestamp, error string")
    assert [r["error"] for r in seen.orderBy("key").collect()] == [None, "E_LIMIT_EXCEEDED"]
    assert files.changed(spark, str(tmp_path), seen).count() == 0
    (tmp_path / "1.png").unlink()
    assert [r["error"] for r in files.changed(spark, str(tmp_path), seen).collect()] == ["E_SOURCE_CHANGED"]
    sha = "ab" + "cd" + "0" * 60
    good, bad = tmp_path / "objects/sha256/ab/cd" / f"{sha}.png", tmp_path / "objects/sha256/ab/ce" / f"{sha}.png"
    for p in (good, bad):
        p.parent.mkdir(parents=True)
        p.write_bytes(b"x")
    assert sorted((r["sha256"] or "", r["error"] or "") for r in files.objects(spark, str(tmp_path)).collect()) == [("", "unexpected_object_entry"), (sha, "")]
    out = str(tmp_path / "out.png")
    assert files.export(b"1", out) == out and code(files.export, b"2", out) == "E_OUTPUT_EXISTS" and (tmp_path / "out.png").read_bytes() == b"1"
    issues = spark.range(2).select(F.lit("c").alias("code"), F.col("id").cast("string").alias("key"))
    files.report(issues, str(tmp_path / "report"))
    assert code(files.report, issues, str(tmp_path / "report")) == "E_OUTPUT_EXISTS"


def test_times_in_columns(spark):
    """The built-in form gives what the plain one does."""
    texts = ["2026-09-15T12:00:00+09:00", "2026-09-15 12:00:00.1234567899z", "2026-09-15", "2026-13-15T12:00:00Z", "2026-02-30T12:00:00Z", "2026-09-15T24:00:01Z", "2026-09-15T12:00:60Z", "2026-09-15T12:00:00", "0001-01-01T00:00:00-00:01", "9999-12-31T23:59:59.9-00:00", "1969-12-31T23:59:59-23:59", "2026-01-01T00:30:00+01:00", None, ""]

    def plain(text):
        try:
            return None if text is None else tokens.utc_nanos(text)
        except LedgerError:
            return None

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.utc(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]


def test_tokens():
    assert tokens.utc_nanos("2026-09-15T12:00:00+09:00") == "2026-09-15T03:00:00.000000000Z"
    assert tokens.utc_nanos("2026-09-15T12:00:00.1234567899Z") == "2026-09-15T12:00:00.123456789Z"
    for text in ("2026-09-15", "2026-13-15T12:00:00Z", "2026-09-15T12:00:00"):
        assert code(tokens.utc_nanos, text) == "E_INVALID_ARGUMENT"
    image, store = "c3d40628-1111-4111-8111-111111111111", "s"
    assert tokens.parse_reference(f"frame://s/images/{image}", store) == image == tokens.parse_reference(image, store)
    assert code(tokens.parse_reference, f"frame://t/images/{image}", store) == "E_STORE_MISMATCH" and code(tokens.parse_reference, "x", store) == "E_INVALID_ARGUMENT"
    cursor = tokens.encode_cursor("s", {"run": "r"}, 9, 4)
    assert tokens.decode_cursor(cursor, "s", {"run": "r"}) == (9, 4)
    for args in ((cursor, "t", {"run": "r"}), (cursor, "s", {}), (cursor[:-3], "s", {"run": "r"}), ("!" * 5000, "s", {})):
        assert code(tokens.decode_cursor, *args) == "E_INVALID_CURSOR"
