"""Texts that leave the ledger: UTC times in nanoseconds, references and page cursors."""

from __future__ import annotations

import base64
import binascii
import json
import re
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameledger.errors import LedgerError

SCHEME = "frame"
#: Characters of a cursor at most; fixed value.
MOST_CURSOR = 4096
SQL_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]+))?(Z|z|[+-][0-9]{2}:[0-9]{2})$"
TIME = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|z|[+-]\d\d:\d\d)")


def utc_nanos(text: str) -> str:
    """An RFC 3339 time in UTC with nine digits behind the second; further digits are cut."""
    found = TIME.fullmatch(text)
    if not found:
        raise LedgerError("E_INVALID_ARGUMENT", "time")
    day, clock, part, zone = found.groups()
    try:
        whole = datetime.fromisoformat(f"{day}T{clock}{'+00:00' if zone in 'Zz' else zone}").astimezone(UTC)
    except (ValueError, OverflowError) as error:
        raise LedgerError("E_INVALID_ARGUMENT", "time") from error
    return f"{whole.isoformat()[:19]}.{(part or '')[:9]:0<9}Z"


def now() -> str:
    seconds, nanos = divmod(time.time_ns(), 10**9)
    return f"{datetime.fromtimestamp(seconds, UTC):%Y-%m-%dT%H:%M:%S}.{nanos:09d}Z"


def utc(text: Column) -> Column:
    """utc_nanos of a column in built-in functions, null where it is no time; whole seconds count from 1970, so no session zone matters."""
    part = lambda i: F.regexp_extract(text, SQL_TIME, i)
    zone = F.when(F.upper(part(4)) == "Z", "+00:00").otherwise(part(4))
    local = F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hours, minutes = zone.substr(2, 2).try_cast("int"), zone.substr(5, 2).try_cast("int")
    seconds = F.unix_seconds(local) - sign * (hours * 3600 + minutes * 60)
    day = F.floor(seconds / 86400).cast("int")
    rest = (seconds - day.cast("long") * 86400).cast("int")
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")
    clock = F.concat_ws(":", *[F.lpad((rest / n).cast("int").cast("string") if n == 3600 else ((rest / n).cast("int") % 60).cast("string"), 2, "0") for n in (3600, 60, 1)])
    nanos = F.rpad(F.substring(part(3), 1, 9), 9, "0")
    sound = text.rlike(SQL_TIME) & local.isNotNull() & (hours < 24) & (minutes < 60) & date.rlike("^[0-9]{4}-")
    return F.when(sound, F.concat(date, F.lit("T"), clock, F.lit("."), nanos, F.lit("Z")))


def reference(store: str, image_id: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://{store}/images/"), image_id)


def parse_reference(text: str, store: str) -> str:
    """The image id of a reference to this store, or of a bare id."""
    bare = text
    if text.startswith(f"{SCHEME}://"):
        parts = text.removeprefix(f"{SCHEME}://").split("/")
        if len(parts) != 3 or parts[1] != "images":
            raise LedgerError("E_INVALID_ARGUMENT", "reference")
        if parts[0] != store:
            raise LedgerError("E_STORE_MISMATCH", "reference of another store")
        bare = parts[2]
    try:
        return str(uuid.UUID(bare))
    except ValueError as error:
        raise LedgerError("E_INVALID_ARGUMENT", "reference") from error


def encode_cursor(store: str, query: dict, high: int, last: int) -> str:
    """Where the next page begins: bound to the store, the query and the highest key that the first page saw."""
    body = json.dumps({"version": 1, "store": store, "query": query, "max": high, "last": last}, separators=(",", ":"), sort_keys=True)
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(text: str, store: str, query: dict) -> tuple[int, int]:
    """(high, last) of a cursor of exactly this store and query."""
    refused = LedgerError("E_INVALID_CURSOR", "invalid, or of another query")
    if len(text) > MOST_CURSOR:
        raise refused
    try:
        body = json.loads(base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True))
    except (ValueError, binascii.Error) as error:
        raise refused from error
    if not isinstance(body, dict) or set(body) != {"version", "store", "query", "max", "last"}:
        raise refused
    high, last = body["max"], body["last"]
    if (body["version"], body["store"], body["query"]) != (1, store, query) or type(high) is not int or type(last) is not int or not 0 < last <= high:
        raise refused
    return high, last


def parsed_reference(text: Column, store: str) -> Column:
    """parse_reference of a column: a struct of image_id and error."""
    inside = text.startswith(f"{SCHEME}://")
    parts = F.split(F.substring(text, len(SCHEME) + 4, 1 << 30), "/")
    form = ~inside | ((F.size(parts) == 3) & (F.get(parts, F.lit(1)) == "images"))
    bare = F.lower(F.when(inside, F.get(parts, F.lit(2))).otherwise(text))
    error = F.when(~form, "E_INVALID_ARGUMENT").when(inside & (F.get(parts, F.lit(0)) != store), "E_STORE_MISMATCH").when(~F.coalesce(bare.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False)), "E_INVALID_ARGUMENT")
    return F.struct(F.when(error.isNull(), bare).alias("image_id"), error.alias("error"))


def cursor(store: str, query: Column, high: Column, last: Column) -> Column:
    """encode_cursor of columns; query is JSON text."""
    body = F.concat(F.lit('{"last":'), last.cast("string"), F.lit(',"max":'), high.cast("string"), F.lit(',"query":'), query, F.lit(f',"store":{json.dumps(store)},"version":1}}'))
    return F.rtrim(F.translate(F.base64(body.cast("binary")), "+/\r\n", "-_"), F.lit("="))
