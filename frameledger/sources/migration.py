"""Ledgers of the first two formats, and their conversion.

Format 1 has tables v1_images and v1_blobs: images with a stored and a source object each, runs without streams or
frame numbers, and fingerprints of the first version. Format 2 is the present one without judgments. A conversion
stages its tables, keeps a journal beside the manifest, commits, and replaces the manifest last; whatever it is cut off at, it
can be resumed or restored, and until then the ledger isn't opened.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.errors import LedgerError
from frameledger.functions import tokens
from frameledger.operators import catalog

from . import ledger as L

V1 = {
    "v1_images": "seq long, image_id string, run string, created_at string, captured_at string, label string, note string, tags array<string>, width int, height int, bit_depth int, color_type int, "
    "source_sha256 string, source_byte_length long, source_blob_sha256 string, stored_blob_sha256 string, scanline_sha256 string, non_idat_sha256 string, pixel_sha256 string, operation_id string, fingerprint string",
    "v1_blobs": "sha256 string, byte_length long, content binary",
}
JOURNAL = "migration.json"


def converted_images(images: DataFrame) -> DataFrame:
    """Images of the first format as they are now: every run gets the stream 'default' and dense frame numbers in order of seq."""
    return catalog.backfill_frames(images).withColumn("fingerprint_version", F.when(F.col("fingerprint").isNotNull(), 1))


def first_representations(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.lit(1).alias("representation_version"), F.lit("png").alias("representation_kind"), F.col("stored_blob_sha256").alias("png_sha"), F.lit(None).cast("string").alias("segment_id"), "created_at")


def listed(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows of the first format in the shape of today's lists: no stream, no frame number, one PNG each."""
    sizes = blobs.select(F.col("sha256").alias("stored_blob_sha256"), F.col("byte_length").alias("stored_bytes"))
    out = images.join(sizes, "stored_blob_sha256", "left")
    return out.select(
        "seq", "image_id", "run", F.lit(None).cast("string").alias("stream"), F.lit(None).cast("long").alias("frame_no"), F.lit("png").alias("representation_kind"), F.lit(1).alias("representation_version"),
        "stored_bytes", F.lit(1).cast("long").alias("shared_image_count"),
    )


def newest(migrations: DataFrame) -> DataFrame:
    """The last migration that was begun."""
    return migrations.groupBy().agg(F.max_by(F.struct(*migrations.columns), "migration_id").alias("m")).select("m.*")


def replace_manifest(root: str, manifest: dict) -> None:
    held = f"{root}/ledger.json.{uuid.uuid4().hex}.part"
    with open(held, "x") as f:
        json.dump(manifest, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(held, f"{root}/ledger.json")


def create_v1(spark: SparkSession, root: str, images: DataFrame, blobs: DataFrame) -> None:
    """A ledger of the first format, for tests and imports."""
    os.makedirs(f"{root}/commits", exist_ok=True)
    tables = {}
    for name, df in (("v1_images", images), ("v1_blobs", blobs)):
        folder = f"data/{name}/{uuid.uuid4().hex}"
        df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in V1[name].split(", ")]).write.parquet(f"{root}/{folder}")
        tables[name] = [folder]
    L.create(f"{root}/commits/{0:020d}.json", {"tables": tables, "at": tokens.now()})
    L.create(f"{root}/ledger.json", {"format": 1, "store_id": str(uuid.uuid4())})


def migrate(spark: SparkSession, root: str, to: int = L.FORMAT, resume: bool = False, restore: bool = False) -> dict:
    """Converts a ledger to the present format; with restore, takes a conversion that was cut off back."""
    root = root.rstrip("/")
    manifest = L.manifest(root)
    path = f"{root}/{JOURNAL}"
    begun = os.path.exists(path)
    if resume and restore or to not in (2, L.FORMAT):
        raise LedgerError("E_INVALID_ARGUMENT", "migrate")
    if begun and not (resume or restore):
        raise LedgerError("E_MIGRATION_INCOMPLETE", "resume or restore it")
    if not begun and (resume or restore):
        raise LedgerError("E_INVALID_ARGUMENT", "no migration was begun")
    if begun:
        with open(path) as f:
            journal = json.load(f)
    else:
        if not manifest["format"] < to:
            raise LedgerError("E_SCHEMA_VERSION", f"format {manifest['format']}")
        journal = {"migration_id": 1, "from": manifest["format"], "to": to, "before": L.head_of(root), "started_at": tokens.now()}
        L.create(path, journal)
        L.fault("migrate-journal")
    store = L.Ledger(spark, root, manifest, journal["before"])
    number = f"{root}/commits/{journal['before'] + 1:020d}.json"
    if restore:
        # the commit is only named by the manifest's new format; without it the old one holds
        if manifest["format"] == journal["to"]:
            replace_manifest(root, manifest | {"format": journal["from"]})
        if os.path.exists(number):
            os.unlink(number)
        os.unlink(path)
        return journal | {"state": "restored"}
    if not os.path.exists(number):
        tables = {t: [] for t in L.TABLES} | {t: p for t, p in store.folders().items() if t in L.TABLES}
        if journal["from"] == 1:
            read = {t: spark.read.schema(V1[t]).parquet(*[f"{root}/{p}" for p in store.folders()[t]]) for t in V1}
            made = {
                "images": converted_images(read["v1_images"]), "representations": first_representations(read["v1_images"]),
                "blobs": L.as_objects(read["v1_blobs"].withColumn("object_kind", F.lit("png"))),
            }
            for t, df in made.items():
                tables[t] = [store.stage(L.shaped(df, t), t)]
        L.fault("migrate-staged")
        L.create(number, {"tables": tables, "at": tokens.now(), "migration": journal})
    L.fault("migrate-committed")
    replace_manifest(root, manifest | {"format": journal["to"]})
    L.fault("migrate-manifest")
    os.unlink(path)
    return journal | {"state": "completed", "completed_at": tokens.now()}
