"""The stored catalog: Parquet tables under a log of commits.

A commit is one JSON file, numbered without gaps, that lists the data folders of every table. Writers stage
Parquet first and then create the next number; a number is created once, so of two writers one fails, looks at
the new head, checks its conditions again and retries. Readers stay with the number they opened. Data of
older commits is kept until ``vacuum``, so a backup is a number.

Objects lie in folders by the first two digits of their hash, sorted, so one is found without a look at the others. A
pruned object gets a row in the prune log that names its batch, which costs as much as what is pruned; ``compact``
rewrites batches of which a good part is gone, and ``vacuum`` deletes folders that no kept commit names.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.errors import LedgerError
from frameledger.functions import codec, columns, container, pngr, tokens
from frameledger.functions.columns import PackLimits
from frameledger.functions.png import Limits
from frameledger.operators import blocks, catalog, judgments, packing, pruning

from . import files

FORMAT = 3
#: Bytes of a manifest at most; fixed value.
MOST_MANIFEST = 4096
#: Times that a writer may lose against others; each attempt stages its rows anew, so seconds would not bound it.
ATTEMPTS = 8
IMAGE = "run string, stream string, frame_no long, created_at string, captured_at string, label string, note string, tags array<string>, width int, height int, bit_depth int, color_type int"
HASHES = "source_sha256 string, source_byte_length long, source_blob_sha256 string, scanline_sha256 string, non_idat_sha256 string, pixel_sha256 string"
TABLES = {
    "images": f"seq long, image_id string, {IMAGE}, {HASHES}, operation_id string, fingerprint string, fingerprint_version int",
    "blobs": "sha256 string, byte_length long, object_kind string, media_type string, relative_path string, content binary",
    "representations": "image_id string, representation_version int, representation_kind string, png_sha string, segment_id string, created_at string",
    "segments": "segment_id string, codec string, descriptor_json string, width int, height int, frame_count int, color_sha string, alpha_sha string, segment_bytes long",
    "frame_locations": "image_id string, segment_id string, frame_index int, decode_start_index int",
    "png_reconstruction": "image_id string, descriptor_sha string, descriptor_byte_length long",
    "judgments": "seq long, judgment_id string, image_id string, kind string, producer string, model string, schema_version long, value_json string, probability double, confidence double, metadata_json string, created_at string",
    "prune_log": "sha256 string, batch string, prune_state string, at string",
}
#: Media type and file extension of each kind of object; fixed values.
KINDS = {"png": ("image/png", "png"), "bitstream": ("application/octet-stream", "seg"), "png_reconstruction": ("application/octet-stream", "pngr")}
#: Examples in a report, and objects that a prune takes at most unless told otherwise; fixed values.
EXAMPLES, MOST_PRUNED = 20, 10_000
INPUT = {"run": "string", "stream": "string", "label": "string", "note": "string", "tags": "array<string>", "captured_at": "string", "operation_id": "string"}

#: Called with a name at each step that a crash may interrupt; tests replace it.
fault: Callable[[str], None] = lambda name: None


class Ledger:
    def __init__(self, spark: SparkSession, root: str, manifest: dict, version: int):
        self.spark, self.root, self.id, self.version = spark, root, manifest["store_id"], version

    # the log

    @classmethod
    def init(cls, spark: SparkSession, root: str) -> Ledger:
        """A new ledger, or the one that is there. A folder that holds anything else is refused."""
        root = root.rstrip("/")
        if not os.path.exists(f"{root}/ledger.json"):
            if os.path.isdir(root) and os.listdir(root):
                raise LedgerError("E_CONFLICT", "folder is not empty")
            os.makedirs(f"{root}/commits", exist_ok=True)
            create(f"{root}/commits/{0:020d}.json", {"tables": {t: [] for t in TABLES}, "at": tokens.now()})
            create(f"{root}/ledger.json", {"format": FORMAT, "store_id": str(uuid.uuid4())})
        return cls.open(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> Ledger:
        root = root.rstrip("/")
        found = manifest(root)
        if os.path.exists(f"{root}/migration.json"):
            raise LedgerError("E_MIGRATION_INCOMPLETE", "resume or restore it")
        if found["format"] not in (2, FORMAT):
            raise LedgerError("E_SCHEMA_VERSION", "manifest")
        out = cls(spark, root, found, 0)
        out.version = out.head() if version is None else version
        return out

    def head(self) -> int:
        return head_of(self.root)

    def folders(self) -> dict[str, list[str]]:
        try:
            with open(f"{self.root}/commits/{self.version:020d}.json") as f:
                return json.load(f)["tables"]
        except FileNotFoundError as error:
            raise LedgerError("E_NOT_FOUND", f"commit {self.version}") from error

    def table(self, name: str) -> DataFrame:
        if name == "blobs":
            # what has been pruned is gone, though its row may still be in a batch
            log = self.folders()["prune_log"]
            gone = self.table("prune_log").where("prune_state = 'deleted'").select("sha256", "batch").distinct()
            return self.batches().join(gone, ["sha256", "batch"], "left_anti") if log else self.batches()
        paths = [f"{self.root}/{p}" for p in self.folders()[name]]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def batches(self) -> DataFrame:
        """All rows of blobs, pruned ones too, with their batch and prefix."""
        schema, paths = f"{TABLES['blobs']}, batch string, prefix string", [f"{self.root}/{p}" for p in self.folders()["blobs"]]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data/blobs").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, df: DataFrame, name: str) -> str:
        folder = f"data/{name}/{'batch=' if name == 'blobs' else ''}{uuid.uuid4().hex}"
        if name == "blobs":
            placed = df.withColumn("prefix", F.substring("sha256", 1, 2))
            placed.repartitionByRange("prefix", "sha256").sortWithinPartitions("prefix", "sha256").write.partitionBy("prefix").parquet(f"{self.root}/{folder}")
        else:
            df.write.parquet(f"{self.root}/{folder}")
        fault(f"staged-{name}")
        return folder

    def held(self, df: DataFrame, name: str) -> DataFrame:
        """df written, so that ids and times in it are taken once."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.stage(df, name)}")

    def commit(self, build: Callable[[Ledger], dict[str, DataFrame]], without: frozenset[str] | set[str] = frozenset()) -> Ledger:
        """Appends what build makes of the head, and drops the folders without. Where another writer was first, build sees the new head."""
        for _ in range(ATTEMPTS):
            at = Ledger(self.spark, self.root, {"store_id": self.id}, self.head())
            before = at.folders()
            added = {t: at.stage(shaped(df, t), t) for t, df in build(at).items()}
            tables = {t: [p for p in before[t] if p not in without] + ([added[t]] if t in added else []) for t in TABLES}
            fault("before-commit")
            try:
                create(f"{self.root}/commits/{at.version + 1:020d}.json", {"tables": tables, "at": tokens.now()})
            except FileExistsError:
                continue
            fault("after-commit")
            return Ledger(self.spark, self.root, {"store_id": self.id}, at.version + 1)
        raise LedgerError("E_BUSY", "other writers")

    def restore(self, version: int) -> Ledger:
        """A new commit with the tables of an older one."""
        old = Ledger(self.spark, self.root, {"store_id": self.id}, version).folders()
        number = self.head() + 1
        try:
            create(f"{self.root}/commits/{number:020d}.json", {"tables": old, "at": tokens.now()})
        except FileExistsError as error:
            raise LedgerError("E_BUSY", "other writers") from error
        return Ledger(self.spark, self.root, {"store_id": self.id}, number)

    # images

    def put(self, batch: DataFrame, level: int = 6, keep_source: bool = False, limits: Limits = Limits()) -> DataFrame:
        """Stores batch(key, content and any of INPUT) and returns key, image_id, outcome and error of each row.

        Keys are distinct and give the order of frames. A broken row is refused by itself. A repeated operation_id, in
        the ledger or in the batch, is reused or a conflict. Bytes are stored once for each hash.
        """
        missing = {c: F.lit(None).cast(t) for c, t in INPUT.items() if c not in batch.columns}
        rows = batch.withColumns(missing).select("key", "content", *INPUT)
        rows = rows.withColumn("stream", F.when((F.col("run") != "") & F.col("stream").isNull(), "default").otherwise(F.col("stream")))
        given = F.col("captured_at")
        rows = catalog.normalise_metadata(rows).withColumn("captured_at", tokens.utc(given)).withColumn("error", F.when(given.isNotNull() & F.col("captured_at").isNull(), "E_INVALID_ARGUMENT").otherwise(F.col("error")))
        rows = rows.withColumns({"source_sha256": F.sha2("content", 256), "source_byte_length": F.octet_length("content").cast("long")})
        fields = ("source_sha256", "run", "stream", "label", "note", "tags", "captured_at")
        prints = {
            "fingerprint": catalog.fingerprint(F.lit(2), *[F.col(c) for c in fields], F.lit(keep_source), F.lit(level)),
            "fingerprint_v1": catalog.fingerprint(F.lit(1), *[F.col(c) for c in fields if c != "stream"], F.lit(keep_source), F.lit(level)),
        }
        packed = self.held(columns.png_repack(batch.select("key", "content"), level, limits).withColumnRenamed("error", "image_error").withColumns({"png_sha": F.sha2("content", 256), "byte_length": F.octet_length("content").cast("long")}), "incoming")
        joined = rows.drop("content").withColumns(prints).join(packed.drop("content"), "key").withColumn("error", F.coalesce("error", "image_error"))
        fresh = self.held(joined.withColumns({"new_id": F.expr("uuid()"), "created_at": F.lit(tokens.now())}), "incoming")
        # each operation's first row; rows without one stand alone
        own = F.coalesce(F.concat(F.lit("o"), "operation_id"), F.concat(F.lit("k"), "key"))
        first = fresh.where("error is null").groupBy(own.alias("op")).agg(F.min_by(F.struct(F.col("key").alias("k"), F.col("new_id").alias("id"), F.col("fingerprint").alias("f")), "key").alias("first"))
        last: dict[str, DataFrame] = {}

        def build(at: Ledger) -> dict[str, DataFrame]:
            existing = at.table("images")
            judged = catalog.retries(fresh.where("error is null"), existing.select("operation_id", "fingerprint", "fingerprint_version", "image_id")).withColumn("op", own).join(first, "op")
            twin = F.when(F.col("first.k") == F.col("key"), "insert").when(F.col("first.f") == F.col("fingerprint"), "reuse").otherwise("conflict")
            judged = judged.withColumn("outcome", F.when(F.col("outcome") == "insert", twin).otherwise(F.col("outcome"))).withColumn("image_id", F.coalesce("known_image_id", "first.id"))
            last["judged"] = judged = at.held(judged.drop("op", "first"), "incoming")
            new = blocks.ranked(judged.where("outcome = 'insert'"), "key", catalog.high_water(existing).first()[0], lambda df: at.held(df, "incoming"))
            new = catalog.allocate_frames(new, existing.select("run", "stream", "frame_no")).withColumn("frame_no", F.col("new_frame_no"))
            new = at.held(new.withColumns({"fingerprint_version": F.lit(2), "source_blob_sha256": F.col("source_sha256") if keep_source else F.lit(None).cast("string")}), "incoming")
            bytes_ = packed.join(new.select("key"), "key", "left_semi").select(F.col("png_sha").alias("sha256"), "byte_length", "content")
            if keep_source:
                raw = batch.select("key", "content").join(new.select("key"), "key", "left_semi").select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_length"), "content")
                bytes_ = bytes_.unionByName(raw)
            blobs = as_objects(catalog.insert_absent(bytes_, at.table("blobs").select("sha256")).withColumn("object_kind", F.lit("png")))
            one = new.select("image_id", F.lit(1).alias("representation_version"), F.lit("png").alias("representation_kind"), "png_sha", F.lit(None).alias("segment_id"), "created_at")
            return {"images": new, "blobs": blobs, "representations": one}

        done = self.commit(build)
        self.version = done.version
        rejected = fresh.where("error is not null").select("key", F.lit(None).cast("string").alias("image_id"), F.lit("rejected").alias("outcome"), "error")
        return last["judged"].select("key", F.when(F.col("outcome") != "conflict", F.col("image_id")).alias("image_id"), "outcome", F.when(F.col("outcome") == "conflict", "E_CONFLICT").alias("error")).unionAll(rejected)

    def active(self) -> DataFrame:
        return packing.active(self.table("representations"))

    def info(self, images: DataFrame | None = None) -> DataFrame:
        """Images (all of them by default) with the form they are stored in."""
        rows = self.table("images") if images is None else images
        out = catalog.info(rows, self.active().drop("created_at"), self.table("blobs").select("sha256", "byte_length"), self.table("frame_locations"), self.table("segments"), self.table("png_reconstruction"))
        return out.withColumn("reference", tokens.reference(self.id, F.col("image_id")))

    def list(self, run: str | None = None, limit: int = 20, cursor: str | None = None) -> tuple[list[dict], str | None]:
        """A page of image rows and the cursor of the next one; the page is cut to its byte budget."""
        return self.pages("images", {"run": run or None}, limit, cursor, lambda rows, **at: self.info_page(catalog.page(rows, limit, where={"run": run or None}, **at)))

    def info_page(self, page: DataFrame) -> DataFrame:
        out = catalog.info_page(page, self.table("representations").drop("created_at"), self.table("blobs").select("sha256", "byte_length"), self.table("frame_locations"), self.table("segments"), self.table("png_reconstruction"))
        return out.withColumn("reference", tokens.reference(self.id, F.col("image_id")))

    def pages(self, table: str, query: dict, limit: int, cursor: str | None, rows_of) -> tuple[list[dict], str | None]:
        if not 1 <= limit <= 100:
            raise LedgerError("E_INVALID_ARGUMENT", "limit")
        query = {"of": table} | query
        high, last = tokens.decode_cursor(cursor, self.id, query) if cursor else (catalog.high_water(self.table(table)).first()[0], None)
        # limit + 1 rows at most
        rows = sorted((r.asDict(True) for r in rows_of(self.table(table), high=high, last=last).collect()), key=lambda r: -r["seq"])
        kept, size = [], 0
        for row in rows[:limit]:
            size += len(json.dumps(row, ensure_ascii=False, separators=(",", ":")).encode()) + 1
            if size > catalog.PAGE_BYTES - tokens.MOST_CURSOR // 8:
                break
            kept.append(row)
        if rows and not kept:
            raise LedgerError("E_LIMIT_EXCEEDED", "one item is above the page's bytes")
        return kept, tokens.encode_cursor(self.id, query, high, kept[-1]["seq"]) if len(kept) < len(rows) else None

    def get(self, image_id: str, variant: str = "stored", limits: Limits = Limits()) -> bytes:
        """The bytes of one image, checked against their hashes. Nothing is decoded that may take more memory than the limit."""
        found = self.table("images").where(F.col("image_id") == image_id).join(self.active().drop("created_at"), "image_id").first()
        if not found:
            raise LedgerError("E_NOT_FOUND", image_id)
        if variant == "source":
            if not found["source_blob_sha256"]:
                raise LedgerError("E_SOURCE_NOT_RETAINED", image_id)
            return self.blob(found["source_blob_sha256"])
        if found["representation_kind"] == "png":
            return self.blob(found["png_sha"])
        places = self.table("frame_locations").where(F.col("image_id") == image_id).where(F.col("segment_id") == found["segment_id"])
        place = places.join(self.table("segments"), "segment_id").join(self.table("png_reconstruction").where(F.col("image_id") == image_id), "image_id").first()
        if not place:
            raise LedgerError("E_INTEGRITY", image_id)
        codec.require(place["codec"])
        if packing.decode_bytes(place["width"], place["height"], bool(place["alpha_sha"]), place["segment_bytes"], place["descriptor_byte_length"]) > limits.memory_bytes:
            raise LedgerError("E_LIMIT_EXCEEDED", "decoding takes too much memory")
        frames = columns.samples_of(place["descriptor_json"], *[self.blob(x) if x else None for x in (place["color_sha"], place["alpha_sha"])])
        for _ in range(place["frame_index"]):
            next(frames)
        return pngr.rebuild(self.blob(place["descriptor_sha"]), next(frames), found.asDict())

    def get_frame(self, run: str, frame_no: int, stream: str = "default", limits: Limits = Limits()) -> tuple[str, bytes]:
        """Image id and bytes of an exact frame; one that is absent is no other."""
        found = catalog.frame(self.table("images"), run, stream, frame_no).select("image_id").first()
        if not found:
            raise LedgerError("E_NOT_FOUND", f"{run}/{stream}/{frame_no}")
        return found["image_id"], self.get(found["image_id"], limits=limits)

    def features(self, image_id: str) -> dict:
        """An image's row, the frame before it, and whether their pixels are the same."""
        rows = self.table("images")
        own = rows.where(F.col("image_id") == image_id).first()
        if not own:
            raise LedgerError("E_NOT_FOUND", image_id)
        before = None if own["run"] is None else catalog.frame(rows, own["run"], own["stream"], own["frame_no"] - 1).select("image_id", "pixel_sha256").first()
        out = own.asDict(True) | {"previous_image_id": None, "same_pixels": None}
        return out | ({"previous_image_id": before["image_id"], "same_pixels": before["pixel_sha256"] == own["pixel_sha256"]} if before else {})

    def blob(self, sha: str) -> bytes:
        """One object, from the folder of its prefix, by the statistics of its sorted files."""
        rows = self.batches().where((F.col("prefix") == sha[:2]) & (F.col("sha256") == sha)).select("batch", "content", F.sha2("content", 256).alias("actual")).collect()
        if rows and self.folders()["prune_log"]:
            gone = {r["batch"] for r in self.table("prune_log").where((F.col("sha256") == sha) & (F.col("prune_state") == "deleted")).select("batch").collect()}
            rows = [r for r in rows if r["batch"] not in gone]
        if not rows or rows[0]["actual"] != sha:
            raise LedgerError("E_INTEGRITY", sha)
        return bytes(rows[0]["content"])

    # judgments

    def judge(self, texts: DataFrame) -> DataFrame:
        """Appends texts(key, image_id, json) that are sound and whose image exists; returns key, judgment_id and error."""
        rows = judgments.validate(files.judgments(texts).withColumnRenamed("error", "refused"))
        known = self.table("images").select("image_id", F.lit(True).alias("known"))
        rows = rows.join(known, "image_id", "left").withColumn("error", F.coalesce("refused", "error", F.when(F.col("known").isNull(), "E_NOT_FOUND")))
        rows = self.held(rows.withColumns({"judgment_id": F.expr("uuid()"), "created_at": F.lit(tokens.now())}), "incoming")
        done = self.commit(lambda at: {"judgments": blocks.ranked(rows.where("error is null"), "key", catalog.high_water(at.table("judgments")).first()[0], lambda df: at.held(df, "incoming"))})
        self.version = done.version
        return rows.select("key", F.when(F.col("error").isNull(), F.col("judgment_id")).alias("judgment_id"), "error")

    def search(self, limit: int = 20, cursor: str | None = None, **filters) -> tuple[list[dict], str | None]:
        """A page of judgments that meet all filters of judgments.search."""
        return self.pages("judgments", filters, limit, cursor, lambda rows, **at: judgments.search(rows, limit, **filters, **at))

    # packing and pruning

    def pack(self, run: str | None = None, stream: str | None = None, size: int = 32, dry_run: bool = False, limits: PackLimits = PackLimits()) -> DataFrame:
        """Codes groups of consecutive frames up to the highest seq at the start, keeps those that get smaller, and returns a row for each group.

        A group that breaks a limit or holds a broken image fails by itself, with the code as its reason.
        """
        if not codec.LEAST <= size <= codec.MOST:
            raise LedgerError("E_INVALID_ARGUMENT", "frames of a segment")
        of = [F.col(c) == v for c, v in (("run", run), ("stream", stream)) if v]
        images = self.table("images")
        for test in of:
            images = images.where(test)
        high = catalog.high_water(images).first()["high"]
        rows = packing.candidates(images, self.active(), self.table("blobs").select("sha256", "byte_length"), high=high)
        key = ["run", "stream", "isl", "part"]
        grouped = packing.groups(rows, size).withColumn("group_id", F.sha2(F.to_json(F.struct(*key)), 256))
        grouped = self.held(grouped.drop("created_at"), "packing")
        if grouped.count() > limits.max_images:
            raise LedgerError("E_LIMIT_EXCEEDED", "images of a pack")
        sizes = grouped.groupBy(*key, "group_id").agg(F.count(F.lit(1)).alias("group_n"), F.max(packing.encode_memory(F.col("width"), F.col("height"), F.col("color_type") == 6, F.col("png_bytes"))).alias("memory"))
        wanted = sizes.where("group_n > 1").where(F.col("memory") <= limits.image.memory_bytes).select("group_id")
        content = self.table("blobs").select(F.col("sha256").alias("png_sha"), "content")
        segments = self.held(columns.encode_groups(grouped.join(wanted, "group_id", "left_semi").join(content, "png_sha"), limits), "packing")
        segments = segments.withColumns({"color_sha": F.sha2("color", 256), "alpha_sha": F.sha2("alpha", 256)})
        cost = F.col("coded_bytes") + F.col("descriptor_bytes") + F.octet_length("descriptor_json")
        found = sizes.join(segments.select("group_id", "error", F.col("segment_id").alias("content_id"), "inter_predicted", cost.alias("cost")), "group_id", "left")
        found = found.withColumn("error", F.when(F.col("group_n") < 2, None).otherwise(F.coalesce("error", F.when(F.col("memory") > limits.image.memory_bytes, "E_LIMIT_EXCEEDED"), F.when(F.col("content_id").isNull(), "E_INTEGRITY"))))
        priced = grouped.join(found.select("group_id", F.coalesce("cost", F.lit(0)).alias("candidate_bytes")), "group_id")
        planned = packing.plan(priced).drop("segment_id").join(found.select(*key, "group_id", "error", F.col("content_id").alias("segment_id"), "inter_predicted"), key)
        planned = packing.decided(planned).withColumn("status", F.when((F.col("status") == "packed") & F.lit(dry_run), "would_pack").otherwise(F.col("status"))).withColumn("frozen_through_seq", F.lit(high))
        planned = self.held(planned, "packing")
        if dry_run or not planned.where("status = 'packed'").limit(1).count():
            return planned
        members = self.held(packing.members(grouped, planned.drop("group_id")), "packing")
        moved: dict[str, DataFrame] = {}

        def build(at: Ledger) -> dict[str, DataFrame]:
            moved["all"] = stale = at.held(packing.activation(members.select("segment_id", "image_id", "representation_version", "png_sha"), at.table("representations")).where("moved"), "packing")
            ok = members.join(stale.select("segment_id"), "segment_id", "left_anti").withColumn("decode_start_index", F.lit(0))
            chosen = segments.join(ok.select("group_id").distinct(), "group_id", "left_semi").withColumns({"codec": F.lit(codec.NAME), "segment_bytes": F.col("coded_bytes")})
            parts = chosen.select(F.explode("frames").alias("f")).select("f.*")
            sized = parts.where("descriptor is not null").select("descriptor_sha", F.octet_length("descriptor").cast("long").alias("descriptor_byte_length")).distinct()
            blob = lambda df, sha, data, kind: df.where(F.col(data).isNotNull()).select(F.col(sha).alias("sha256"), F.octet_length(data).cast("long").alias("byte_length"), F.lit(kind).alias("object_kind"), F.col(data).alias("content"))
            new = blob(chosen, "color_sha", "color", "bitstream").unionAll(blob(chosen, "alpha_sha", "alpha", "bitstream")).unionAll(blob(parts, "descriptor_sha", "descriptor", "png_reconstruction"))
            log = ok.select("image_id", (F.col("representation_version") + 1).alias("representation_version"), F.lit("temporal_segment").alias("representation_kind"), F.lit(None).alias("png_sha"), "segment_id", F.lit(tokens.now()).alias("created_at"))
            known = at.table("segments").select("segment_id")
            return {
                "segments": chosen.join(known, "segment_id", "left_anti").dropDuplicates(["segment_id"]), "frame_locations": ok, "png_reconstruction": parts.join(sized, "descriptor_sha"), "representations": log,
                "blobs": as_objects(catalog.insert_absent(new, at.table("blobs").select("sha256"))),
            }

        self.version = self.commit(build).version
        late = planned.join(moved["all"].select("segment_id", F.col("reason").alias("late")), "segment_id", "left")
        return self.held(late.withColumn("status", F.when(F.col("late").isNotNull(), "skipped").otherwise(F.col("status"))).withColumn("reason", F.coalesce("late", "reason")).drop("late"), "packing")

    def live(self) -> DataFrame:
        active, segments = self.active(), self.table("segments")
        return pruning.live_refs((active, "png_sha", "png"), (segments, "color_sha", "color"), (segments, "alpha_sha", "alpha"), (self.table("png_reconstruction"), "descriptor_sha", "descriptor"), (self.table("images"), "source_blob_sha256", "source"))

    def retired(self) -> DataFrame:
        """Representations that have a successor, with the state of the prune of their object."""
        state = self.table("prune_log").groupBy("sha256", "batch").agg(F.max_by("prune_state", "at").alias("prune_state"))
        # an object that came back after a prune lies in another batch
        here = self.batches().select("sha256", "batch").join(state, ["sha256", "batch"], "left").groupBy(F.col("sha256").alias("png_sha")).agg(F.min(F.coalesce("prune_state", F.lit("retained"))).alias("lowest"), F.max(F.coalesce("prune_state", F.lit("retained"))).alias("prune_state"))
        rows = packing.retired(self.table("representations")).where("png_sha is not null").join(here.drop("lowest"), "png_sha", "left")
        return rows.withColumn("prune_state", F.coalesce("prune_state", F.lit("deleted")))

    def prunable(self) -> DataFrame:
        """Objects of retired representations that nothing refers to: sha256, byte_length and batch."""
        return pruning.candidates(self.retired(), self.table("blobs").where("object_kind = 'png'").select("sha256", "byte_length", "batch"), self.live().select("sha256"))

    def prune(self, apply: bool = False, max_objects: int = MOST_PRUNED) -> DataFrame:
        """sha256, byte_length, status and reason of each object that can go.

        With apply an object goes in two commits: it is marked pending, then deleted, with nothing but references checked
        between them. A prune that was cut off is taken up by the next one, as pending objects are still candidates. The
        segments that stand in for the images are decoded first, once, outside of the commits.
        """
        found = self.held(self.prunable(), "pruning")
        if found.count() > max_objects:
            raise LedgerError("E_LIMIT_EXCEEDED", "objects of a prune")
        retired = self.retired().where("prune_state <> 'deleted'")
        covered = pruning.coverage(retired, self.active())
        stands = retired.select("image_id", F.col("png_sha").alias("sha256")).join(found.select("sha256"), "sha256", "left_semi").join(self.active().select("image_id", "segment_id"), "image_id")
        broken = stands.join(self.segment_issues(stands.select("segment_id").distinct()), "segment_id", "left_semi").select("sha256").distinct().withColumn("broken", F.lit(True))
        rows = found.join(covered, "sha256", "left").join(broken, "sha256", "left")
        sound = F.coalesce((F.col("total") == F.col("covered")) & (F.col("total") > 0), F.lit(False)) & F.col("broken").isNull()
        rows = self.held(rows.select("sha256", "byte_length", "batch", F.when(sound, "reclaimable").otherwise("failed").alias("status"), F.when(sound, "verified_replacement").otherwise("E_INTEGRITY").alias("reason")), "pruning")
        if not apply:
            return rows.drop("batch")
        if rows.where("status = 'failed'").limit(1).count():
            raise LedgerError("E_INTEGRITY", "replacements are not sound")

        def mark(state: str) -> Callable[[Ledger], dict[str, DataFrame]]:
            def build(at: Ledger) -> dict[str, DataFrame]:
                if rows.join(at.live().select("sha256"), "sha256", "left_semi").limit(1).count():
                    raise LedgerError("E_INTEGRITY", "an object is referred to again")
                return {"prune_log": rows.select("sha256", "batch", F.lit(state).alias("prune_state"), F.lit(tokens.now()).alias("at"))}

            return build

        if rows.limit(1).count():
            fault("prune-before-pending")
            self.version = self.commit(mark("pending")).version
            fault("prune-after-pending")
            self.version = self.commit(mark("deleted")).version
            fault("prune-after-deleted")
        return rows.select("sha256", "byte_length", F.lit("pruned").alias("status"), F.lit("file_removed").alias("reason"))

    def prune_report(self, rows: DataFrame, before: int) -> dict:
        """Totals of a prune against the commit before it, and the first objects."""
        total = lambda of: checked(of.agg(F.sum(F.col("byte_length").cast("decimal(38,0)"))).first()[0])
        old = Ledger(self.spark, self.root, {"store_id": self.id}, before)
        sizes, live = old.table("blobs").select("sha256", "byte_length"), old.live()
        done = rows.where("status = 'pruned'")
        return {
            "active_representation_bytes": checked(pruning.capacity(sizes, live.where("role <> 'source'")).first()["bytes"]), "source_retained_bytes": checked(pruning.capacity(sizes, live.where("role = 'source'")).first()["bytes"]),
            "retired_candidate_bytes": total(rows), "reclaimable_bytes": total(rows.where("status <> 'failed'")), "reclaimed_bytes": total(done), "physical_object_bytes_before": total(sizes),
            "physical_object_bytes_after": total(self.table("blobs").select("byte_length")), "candidate_objects": rows.count(), "pruned_objects": done.count(), **examples(rows, "sha256"),
        }

    def compact(self, share: float = 0.2) -> int:
        """Rewrites the batches of objects of which the given share is pruned, and returns their number. Old folders stay until vacuum."""
        gone = self.table("prune_log").where("prune_state = 'deleted'").select("sha256", "batch").distinct().groupBy("batch").agg(F.count(F.lit(1)).alias("gone"))
        sizes = self.batches().groupBy("batch").agg(F.count(F.lit(1)).alias("n")).join(gone, "batch")
        # no more rows than there are batches
        chosen = [r["batch"] for r in sizes.where(F.col("gone") >= F.col("n") * share).select("batch").collect()]
        if chosen:
            self.version = self.commit(lambda at: {"blobs": at.table("blobs").where(F.col("batch").isin(chosen))}, without={f"data/blobs/batch={b}" for b in chosen}).version
        return len(chosen)

    def vacuum(self, keep: int = 1, age: float = 3600.0) -> list[str]:
        """Deletes folders that none of the last commits names and that are older than age seconds, and the commits before them."""
        head = self.head()
        named = {p for v in range(max(0, head - keep + 1), head + 1) for ps in Ledger(self.spark, self.root, {"store_id": self.id}, v).folders().values() for p in ps}
        gone = []
        for table in sorted(os.listdir(f"{self.root}/data")) if os.path.isdir(f"{self.root}/data") else []:
            for name in sorted(os.listdir(f"{self.root}/data/{table}")):
                folder = f"data/{table}/{name}"
                if folder not in named and time.time() - os.path.getmtime(f"{self.root}/{folder}") >= age:
                    shutil.rmtree(f"{self.root}/{folder}")
                    gone.append(folder)
        for version in range(max(0, head - keep + 1)):
            if os.path.exists(path := f"{self.root}/commits/{version:020d}.json"):
                os.unlink(path)
        return gone

    # verification

    def segment_issues(self, ids: DataFrame) -> DataFrame:
        """segment_id and code of those among the segments of ids that don't decode to the images that the catalog names."""
        blobs = self.table("blobs").select("sha256", "content")
        data = lambda sha, name: blobs.select(F.col("sha256").alias(sha), F.col("content").alias(name))
        chosen = self.table("segments").join(ids, "segment_id", "left_semi").join(data("color_sha", "color"), "color_sha", "left").join(data("alpha_sha", "alpha"), "alpha_sha", "left")
        meta = [F.col(c) for c in columns.NAMES]
        frames = self.table("frame_locations").join(ids, "segment_id", "left_semi").join(self.table("images").select("image_id", *meta), "image_id").join(self.table("png_reconstruction").select("image_id", "descriptor_sha"), "image_id").join(data("descriptor_sha", "descriptor"), "descriptor_sha", "left")
        # a segment has 128 frames at most
        listed = frames.groupBy("segment_id").agg(F.collect_list(F.struct("frame_index", "descriptor", *meta)).alias("frames"))
        return columns.segment_issues(chosen.join(listed, "segment_id", "left").withColumn("frames", F.coalesce("frames", F.array().cast(listed.schema["frames"].dataType))))

    def image_issues(self) -> DataFrame:
        """code and key of PNG objects that differ from an image that refers to them, now, before, or as its source."""
        images, names = self.table("images"), columns.NAMES
        refs = self.table("representations").select("image_id", F.col("png_sha").alias("key")).unionAll(images.select("image_id", F.col("source_blob_sha256").alias("key"))).where("key is not null").distinct()
        found = columns.png_meta(self.table("blobs").where("object_kind = 'png'").select(F.col("sha256").alias("key"), "content"))
        broken = found.where("error is not null").select(F.col("error").alias("code"), "key")
        both = found.where("error is null").select("key", *[F.col(c).alias(f"own_{c}") for c in names]).join(refs, "key").join(images.select("image_id", "source_sha256", "source_blob_sha256", *names), "image_id")
        differs = F.lit(False)
        for c in names:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"own_{c}"))
        differs = differs | ((F.col("key") == F.col("source_blob_sha256")) & (F.col("key") != F.col("source_sha256")))
        return broken.unionAll(both.where(differs).select(F.lit("E_INTEGRITY").alias("code"), "key").distinct())

    def verify(self) -> DataFrame:
        """code and key of every violation: bytes, hashes and paths of objects, absent references, images against their objects,
        segments against their images, constraints of the catalog. unreferenced_candidate is no error."""
        blobs, live, active = self.table("blobs"), self.live(), self.active()
        bytes_ = pruning.blob_issues(blobs.select("sha256", "byte_length"), blobs.where("content is not null").select("sha256", "content")).select(F.concat(F.lit("blob_"), "issue").alias("code"), F.col("sha256").alias("key"))
        paths = as_objects(blobs.withColumnsRenamed({"media_type": "m", "relative_path": "p"})).where("not (m <=> media_type and p <=> relative_path)").select(F.lit("blob_path").alias("code"), F.col("sha256").alias("key"))
        retired = self.retired().where("prune_state <> 'deleted'").select(F.col("png_sha").alias("sha256"))
        absent = live.select("sha256").distinct().join(blobs.select("sha256"), "sha256", "left_anti").select(F.lit("blob_missing").alias("code"), F.col("sha256").alias("key"))
        spare = pruning.unreferenced(blobs.select("sha256"), live.select("sha256").unionAll(retired)).select(F.lit("unreferenced_candidate").alias("code"), F.col("sha256").alias("key"))
        places = self.table("frame_locations").join(self.table("segments").select("segment_id", "frame_count"), "segment_id")
        decoded = self.segment_issues(self.table("segments").select("segment_id")).select("code", F.col("segment_id").alias("key"))
        out = bytes_.unionAll(paths).unionAll(absent).unionAll(spare).unionAll(self.image_issues()).unionAll(decoded)
        return out.unionAll(pruning.constraint_issues(self.table("images"), active, places))

    def verify_report(self) -> dict:
        """Counts, the first issues, and whether the ledger is sound."""
        issues = self.held(self.verify(), "verify")
        spare = issues.where("code = 'unreferenced_candidate'").count()
        n = issues.count()
        counts = {f"{name}_checked": self.table(name).count() for name in ("images", "blobs", "segments")}
        return {"store_id": self.id, **counts, "error_count": n - spare, "unreferenced_candidates": spare, "issue_count": n, "issues": examples(issues, "code", "key")["results"], "valid": n == spare}


def as_objects(rows: DataFrame) -> DataFrame:
    """rows with the media type and the path that an object of their kind and hash has."""
    pick = lambda i: F.coalesce(*[F.when(F.col("object_kind") == k, v[i]) for k, v in KINDS.items()])
    return rows.withColumns({"media_type": pick(0), "relative_path": catalog.object_path(F.col("sha256"), pick(1))})


def container_id(segment, image_ids: list[str]) -> str:
    """What a segment's row and the images in it give as its id."""
    return container.segment_id(segment["descriptor_json"].encode(), segment["color_sha"], segment["alpha_sha"], image_ids)


def checked(total) -> int:
    """A sum as a 64-bit number; one beyond it is refused."""
    if total is not None and int(total) >= 1 << 63:
        raise LedgerError("E_LIMIT_EXCEEDED", "byte total")
    return int(total or 0)


def examples(rows: DataFrame, *order: str) -> dict:
    """How many rows there are, and the first of them."""
    return {"result_count": rows.count(), "results": [r.asDict(True) for r in rows.orderBy(*order).limit(EXAMPLES).collect()]}


def pack_report(rows: DataFrame, dry_run: bool = False) -> dict:
    """Totals of a pack's groups, and the first of them."""
    if not rows.limit(1).count():
        return {"dry_run": dry_run, "groups_considered": 0, "result_count": 1, "results": [{"status": "no_op", "reason": "no_active_png_candidates"}]}
    out = packing.report(rows).first().asDict()
    return {"dry_run": dry_run, "frozen_through_seq": rows.first()["frozen_through_seq"]} | {k: checked(v) for k, v in out.items()} | examples(rows.drop("error", "frozen_through_seq"), "run", "stream", "first_frame")


def manifest(root: str) -> dict:
    try:
        with open(f"{root}/ledger.json", "rb") as f:
            raw = f.read(MOST_MANIFEST + 1)
        found = json.loads(raw)
    except FileNotFoundError as error:
        raise LedgerError("E_STORE_NOT_INITIALIZED", root) from error
    except ValueError as error:
        raise LedgerError("E_INTEGRITY", "manifest") from error
    if len(raw) > MOST_MANIFEST or not isinstance(found, dict) or set(found) != {"format", "store_id"}:
        raise LedgerError("E_INTEGRITY", "manifest")
    return found


def head_of(root: str) -> int:
    return max(int(n[:20]) for n in os.listdir(f"{root}/commits") if n.endswith(".json") and len(n) == 25)


def shaped(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in TABLES[table].split(", ")])


def create(path: str, body: dict) -> None:
    """A JSON file that appears whole and is never replaced."""
    held = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(held, "x") as f:
            json.dump(body, f)
            f.flush()
            os.fsync(f.fileno())
        os.link(held, path)
    finally:
        os.unlink(held)
