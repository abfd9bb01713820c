"""Judgments: validation, filtered search and the latest one of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameledger.functions.canonical import canonical_json

from .catalog import page

#: Limits in UTF-8 bytes, fixed values.
NAME, MODEL, VALUE, BOTH = 128, 256, 4096, 6144


def search(judgments: DataFrame, limit: int, *, image_id=None, kind=None, producer=None, value=None, confidence_below=None, last=None, high=None) -> DataFrame:
    """Keyset page of the judgments that meet every filter given. value is JSON text and compared in canonical form;
    a judgment without confidence is never below a bound."""
    rows = judgments if confidence_below is None else judgments.where(F.col("confidence") < confidence_below)
    value = None if value is None else canonical_json(value)
    return page(rows, limit, last=last, high=high, where={"image_id": image_id, "kind": kind, "producer": producer, "value_json": value})


def latest(judgments: DataFrame) -> DataFrame:
    """The newest judgment of each image and kind."""
    newest = F.row_number().over(Window.partitionBy("image_id", "kind").orderBy(F.desc("seq")))
    return judgments.withColumn("newest", newest).where("newest = 1").drop("newest")


def validate(rows: DataFrame) -> DataFrame:
    """rows with error: null for a sound judgment. Expects value_json and metadata_json in canonical form, null where invalid."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    unit = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    broken = (size("kind") == 0) | (size("producer") == 0) | (F.col("model") == "") | (F.col("schema_version") < 1) | ~unit("probability") | ~unit("confidence") | F.col("value_json").isNull() | ~F.col("metadata_json").startswith("{")
    large = (size("kind") > NAME) | (size("producer") > NAME) | (size("model") > MODEL) | (size("value_json") > VALUE) | (size("metadata_json") > VALUE) | (size("value_json") + size("metadata_json") > BOTH)
    return rows.withColumn("error", F.when(F.coalesce(broken, F.lit(False)), "E_INVALID_ARGUMENT").when(large, "E_LIMIT_EXCEEDED"))
