"""Files in and out: image snapshots, the tree of objects, judgment JSON, exports and reports."""

from __future__ import annotations

import json
import os
import stat

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.errors import LedgerError
from frameledger.functions.canonical import canonical_json
from frameledger.functions.columns import per_row
from frameledger.functions.png import Limits

OBJECT = r"objects/sha256/([0-9a-f]{2})/([0-9a-f]{2})/([0-9a-f]{64})\.([a-z]+)$"
#: Bytes of a judgment file at most; fixed value.
MOST_JUDGMENT = 64 << 10
#: Fields of a judgment with their JSON types; fixed values.
JUDGMENT = {"kind": str, "producer": str, "model": str, "schema_version": int, "value": object, "probability": (int, float), "confidence": (int, float), "metadata": dict}


def images(spark: SparkSession, path: str, limits: Limits = Limits(), glob: str = "*.png") -> DataFrame:
    """key (path), content, length, modified and error of image files. Content of a file above the limit is never read: its length is tested in the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    named = files.select(F.col("path").alias("key"), "content", "length", F.col("modificationTime").alias("modified"))
    fits = named.where(F.col("length") <= limits.source_bytes).withColumn("error", F.lit(None).cast("string"))
    large = named.where(F.col("length") > limits.source_bytes).withColumn("content", F.lit(None).cast("binary")).withColumn("error", F.lit("E_LIMIT_EXCEEDED"))
    return fits.unionByName(large)


def snapshot(path: str, most: int) -> bytes:
    """The content of one regular file that didn't change while it was read."""
    handle = os.open(path, os.O_RDONLY | os.O_NONBLOCK)
    try:
        before = os.fstat(handle)
        if not stat.S_ISREG(before.st_mode):
            raise LedgerError("E_INVALID_ARGUMENT", "not a regular file")
        if before.st_size > most:
            raise LedgerError("E_LIMIT_EXCEEDED", "source bytes")
        parts, size = [], 0
        while size <= most and (part := os.read(handle, min(1 << 20, most + 1 - size))):
            parts.append(part)
            size += len(part)
        if size > most:
            raise LedgerError("E_LIMIT_EXCEEDED", "source bytes")
        same = [(s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns) for s in (before, os.fstat(handle), os.stat(path))]
    finally:
        os.close(handle)
    if len(set(same)) > 1 or size != before.st_size:
        raise LedgerError("E_SOURCE_CHANGED", path)
    return b"".join(parts)


def changed(spark: SparkSession, path: str, seen: DataFrame, glob: str = "*.png") -> DataFrame:
    """Keys of files whose length or time is no longer what the snapshot seen holds (E_SOURCE_CHANGED), those that vanished among them."""
    again = images(spark, path, Limits(source_bytes=2**62), glob).select("key", F.col("length").alias("length2"), F.col("modified").alias("modified2"))
    same = F.col("length").eqNullSafe(F.col("length2")) & F.col("modified").eqNullSafe(F.col("modified2"))
    return seen.select("key", "length", "modified").join(again, "key", "left").where(~same).select("key", F.lit("E_SOURCE_CHANGED").alias("error"))


def objects(spark: SparkSession, root: str) -> DataFrame:
    """sha256, extension, byte_length, path and error of all files in an object tree, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/objects").select("path", F.col("length").alias("byte_length"))
    part = lambda i: F.regexp_extract("path", OBJECT, i)
    fits = (part(3) != "") & (part(1) == F.substring(part(3), 1, 2)) & (part(2) == F.substring(part(3), 3, 2))
    return files.select(F.when(fits, part(3)).alias("sha256"), F.when(fits, part(4)).alias("extension"), "byte_length", "path", F.when(~fits, "unexpected_object_entry").alias("error"))


def judgment(text: str) -> dict:
    """A judgment's row from strict JSON: unknown fields are refused, defaults filled in, value and metadata canonical."""
    bad = LedgerError("E_INVALID_ARGUMENT", "judgment")
    if len(text.encode()) > MOST_JUDGMENT:
        raise LedgerError("E_LIMIT_EXCEEDED", "judgment")
    try:
        body = json.loads(text)
        if not isinstance(body, dict) or not {"kind", "producer", "value"} <= set(body) <= set(JUDGMENT):
            raise bad
        body = {"model": None, "schema_version": 1, "probability": None, "confidence": None, "metadata": {}} | body
        raw = json.loads(text, parse_float=str, parse_int=str, object_pairs_hook=lambda pairs: pairs)
        if len(dict(raw)) != len(raw):
            raise bad
        value, metadata = (canonical_json(json.dumps(body[k], ensure_ascii=False)) for k in ("value", "metadata"))
    except (ValueError, RecursionError) as error:
        raise bad from error
    for field, kind in JUDGMENT.items():
        optional = field in ("model", "probability", "confidence") and body[field] is None
        if not optional and (not isinstance(body[field], kind) or (isinstance(body[field], bool) and field != "value")):
            raise bad
    number = lambda x: None if x is None else float(x)
    return {k: body[k] for k in ("kind", "producer", "model", "schema_version")} | {"value_json": value, "metadata_json": metadata, "probability": number(body["probability"]), "confidence": number(body["confidence"])}


def judgments(texts: DataFrame) -> DataFrame:
    """texts(key, image_id, json) to judgment rows; error holds the code of what is refused."""
    fields = "kind string, producer string, model string, schema_version long, value_json string, metadata_json string, probability double, confidence double"

    def work(row: dict) -> dict:
        try:
            error, found = None, judgment(row["json"] or "")
        except LedgerError as refused:
            error, found = refused.code, dict.fromkeys(f.split()[0] for f in fields.split(", "))
        return {"key": row["key"], "image_id": row["image_id"], "error": error} | found

    return per_row(texts.select("key", "image_id", "json"), f"key string, image_id string, error string, {fields}", work)


def export(content: bytes, path: str) -> str:
    """A new file; one that exists is never replaced, nor is a part of the content ever seen under the name."""
    held = f"{path}.{os.getpid()}.part"
    try:
        with open(held, "xb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.link(held, path)
    except FileExistsError as error:
        raise LedgerError("E_OUTPUT_EXISTS", path) from error
    finally:
        if os.path.exists(held):
            os.unlink(held)
    return path


def report(issues: DataFrame, path: str) -> None:
    """All issues as JSON lines in a new folder."""
    try:
        issues.write.mode("error").json(path)
    except AnalysisException as error:
        if "ALREADY_EXISTS" in str(error).upper():
            raise LedgerError("E_OUTPUT_EXISTS", path) from error
        raise
