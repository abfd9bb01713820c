"""The command line: envelopes, exit statuses and bounds; migration of the first format with cuts at each step."""

import json
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from frameledger import cli
from frameledger.errors import EXIT, LedgerError
from frameledger.functions import png
from frameledger.operators import catalog
from frameledger.sources import ledger, migration
from frameledger.sources.ledger import Ledger

from .test_ledger import picture


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("cli") / "store")


def call(root, *argv):
    text, status = cli.envelope(["--store", root, *argv])
    body = json.loads(text)
    assert body["schema_version"] == 2 and body["ok"] == (status == 0) and "\n" not in text and len(text.encode()) < 16 << 10
    if status:
        assert status == EXIT[body["error"]["code"]] and body["error"]["retryable"] == (body["error"]["code"] in ("E_BUSY", "E_SOURCE_CHANGED"))
    return body.get("data"), body.get("error", {}).get("code")


def test_commands(spark, root, tmp_path):
    assert call(root, "list") == (None, "E_STORE_NOT_INITIALIZED")
    first, _ = call(root, "init")
    assert call(root, "init")[0] == first | {"already_initialized": True}
    ids = []
    for i in range(6):
        path = tmp_path / f"{i}.png"
        path.write_bytes(picture(i))
        data, error = call(root, "put", "--file", str(path), "--run", "r", "--tag", "b", "--tag", "a", "--operation-id", f"op{i}", "--captured-at", "2026-09-15T12:00:00+09:00")
        assert error is None and (data["frame_no"], data["tags"], data["captured_at"]) == (i, ["a", "b"], "2026-09-15T03:00:00.000000000Z")
        ids.append(data["image_id"])
    again, _ = call(root, "put", "--file", str(tmp_path / "0.png"), "--run", "r", "--tag", "a", "--tag", "b", "--operation-id", "op0", "--captured-at", "2026-09-15T03:00:00Z")
    assert again["reused"] and again["image_id"] == ids[0]
    assert call(root, "put", "--file", str(tmp_path / "0.png"), "--run", "other", "--operation-id", "op0")[1] == "E_CONFLICT"
    assert call(root, "put", "--file", str(tmp_path / "none.png"))[1] == "E_NOT_FOUND" and call(root, "put")[1] == "E_INVALID_ARGUMENT"
    assert call(root, "put", "--file", str(tmp_path))[1] == "E_INVALID_ARGUMENT" and call(root, "--max-source-bytes", "10", "put", "--file", str(tmp_path / "0.png"))[1] == "E_LIMIT_EXCEEDED"
    (tmp_path / "bad.png").write_bytes(b"x")
    assert call(root, "put", "--file", str(tmp_path / "bad.png"))[1] == "E_INVALID_IMAGE"
    page, _ = call(root, "list", "--limit", "4")
    rest, _ = call(root, "list", "--limit", "4", "--cursor", page["next_cursor"])
    assert [r["image_id"] for r in page["items"] + rest["items"]] == ids[::-1] and rest["next_cursor"] is None
    reference = page["items"][0]["reference"]
    assert call(root, "info", reference)[0]["representation_kind"] == "png" and call(root, "info", f"frame://other/images/{ids[0]}")[1] == "E_STORE_MISMATCH"
    assert call(root, "pack", "--run", "r", "--segment-frames", "3", "--dry-run")[0]["results"][0]["status"] == "would_pack"
    packed, _ = call(root, "pack", "--run", "r", "--segment-frames", "3")
    assert (packed["segments_packed"], packed["images_packed"], packed["frozen_through_seq"]) == (2, 6, 6)
    out = str(tmp_path / "out.png")
    got, _ = call(root, "get-frame", "--run", "r", "--frame", "4", "--output", out)
    assert got["image_id"] == ids[4] and png.meta(png.parse(open(out, "rb").read())) == png.meta(png.parse(picture(4)))
    assert call(root, "get", ids[0], "--output", out)[1] == "E_OUTPUT_EXISTS" and call(root, "get", ids[0], "--variant", "source")[1] == "E_SOURCE_NOT_RETAINED"
    assert os.path.exists(call(root, "get", ids[0])[0]["path"]) and call(root, "get-frame", "--run", "r", "--frame", "9")[1] == "E_NOT_FOUND"
    assert call(root, "features", ids[1])[0]["previous_image_id"] == ids[0]
    assert call(root, "judgment", "add", ids[0], "--kind", "k", "--producer", "p", "--value", '{"b":1,"a":2.50}', "--confidence", "0.4")[1] is None
    assert call(root, "judgment", "add", ids[0], "--kind", "k")[1] == "E_INVALID_ARGUMENT" and call(root, "judgment", "add", ids[0], "--kind", "k", "--stdin")[1] == "E_INVALID_ARGUMENT"
    (tmp_path / "j.json").write_text('{"kind":"k","producer":"q","value":true}')
    assert call(root, "judgment", "add", ids[1], "--json", str(tmp_path / "j.json"))[1] is None
    assert [r["value_json"] for r in call(root, "judgment", "search", "--value", '{"a":2.5,"b":1}', "--confidence-below", "0.5")[0]["items"]] == ['{"a":2.5,"b":1}']
    assert [r["producer"] for r in call(root, "judgment", "list", ids[1])[0]["items"]] == ["q"]
    assert call(root, "prune")[1] == "E_INVALID_ARGUMENT" == call(root, "prune", "--dry-run", "--apply")[1]
    assert call(root, "prune", "--dry-run")[0]["candidate_objects"] == 6 and call(root, "prune", "--apply")[0]["pruned_objects"] == 6
    assert call(root, "verify", "--report", str(tmp_path / "report"))[0]["valid"] and call(root, "verify", "--report", str(tmp_path / "report"))[1] == "E_OUTPUT_EXISTS"
    assert call(root, "migrate", "--to", "3")[1] == "E_SCHEMA_VERSION"
    store = Ledger.open(spark, root)
    store.commit(lambda at: {"blobs": spark.createDataFrame([("ab" * 32, 3, "png", "x", "x", b"abc")], "sha256 string, byte_length long, object_kind string, media_type string, relative_path string, content binary")})
    broken, error = call(root, "verify")
    assert error == "E_INTEGRITY" and not broken["valid"] and broken["issues"]


def test_a_process_prints_one_line(tmp_path):
    out = subprocess.run([sys.executable, "-m", "frameledger.cli", "--store", str(tmp_path / "s"), "nonsense"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=100)
    assert out.returncode == 2 and json.loads(out.stdout)["error"]["code"] == "E_INVALID_ARGUMENT" and out.stdout.count("\n") == 1


def old_store(spark, root):
    """Four images of the first format in two runs and outside them, each with its own fingerprint of the first version."""
    rows, blobs = [], []
    for i, run in enumerate(["a", "b", "a", None]):
        content, applied, meta = png.repack(picture(i))
        source = png.sha(picture(i))
        blobs.append((png.sha(content), len(content), content))
        rows.append((i + 1, str(uuid.UUID(int=i + 1)), run, "2026-01-01T00:00:00.000000000Z", None, None, None, [], *(meta[k] for k in ("width", "height", "bit_depth", "color_type")), source, len(picture(i)), None, png.sha(content), meta["scanline_sha256"], meta["non_idat_sha256"], meta["pixel_sha256"], f"op{i}", None))
    images = spark.createDataFrame(rows, migration.V1["v1_images"])
    none = F.lit(None).cast("string")
    printed = catalog.fingerprint(F.lit(1), F.col("source_sha256"), F.col("run"), F.col("label"), F.col("note"), F.col("tags"), none, F.lit(False), F.lit(6))
    migration.create_v1(spark, root, images.withColumn("fingerprint", printed), spark.createDataFrame(blobs, migration.V1["v1_blobs"]))
    return images


def test_migration_with_cuts(spark, tmp_path, monkeypatch):
    for step in ("migrate-journal", "migrate-staged", "migrate-committed", "migrate-manifest", None):
        for way in ("resume", "restore") if step in ("migrate-staged", "migrate-manifest") else ("resume",):
            root = str(tmp_path / f"{step}-{way}")
            old_store(spark, root)
            with pytest.raises(LedgerError, match="E_SCHEMA_VERSION"):
                Ledger.open(spark, root)

            def cut(name, step=step):
                if name == step:
                    raise OSError

            monkeypatch.setattr(ledger, "fault", cut)
            if step:
                with pytest.raises(OSError):
                    migration.migrate(spark, root)
                monkeypatch.setattr(ledger, "fault", lambda name: None)
                for again in (lambda root=root: Ledger.open(spark, root), lambda root=root: migration.migrate(spark, root)):
                    with pytest.raises(LedgerError, match="E_MIGRATION_INCOMPLETE"):
                        again()
                assert migration.migrate(spark, root, **{way: True})["state"] in ("completed", "restored")
                if way == "restore":
                    assert ledger.manifest(root)["format"] == 1
                    continue
            else:
                migration.migrate(spark, root)
            store = Ledger.open(spark, root)
            assert [(r["run"], r["stream"], r["frame_no"]) for r in store.table("images").orderBy("seq").collect()] == [("a", "default", 0), ("b", "default", 0), ("a", "default", 1), (None, None, None)]
    assert store.verify_report()["valid"] and png.meta(png.parse(store.get_frame("a", 1)[1])) == png.meta(png.parse(picture(2)))
    # operations of the first version can still be retried
    batch = spark.createDataFrame([("0", picture(0), "a", "op0"), ("1", picture(1), "a", "op1")], "key string, content binary, run string, operation_id string")
    assert {r["key"]: (r["outcome"], r["error"]) for r in store.put(batch).collect()} == {"0": ("reuse", None), "1": ("conflict", "E_CONFLICT")}
