"""Canonical JSON: sorted keys, no blanks, numbers of one textual form for each class."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def number(text: str) -> str:
    """Shortest form of a float; it always shows that it is one."""
    value = float(text)
    if math.isinf(value):
        raise ValueError("number out of range")
    sign = "-" if math.copysign(1, value) < 0 else ""
    digits, exponent = Decimal(repr(abs(value))).normalize().as_tuple()[1:]
    point = len(digits) + exponent
    if value == 0:
        return sign + "0.0"
    if not -5 < point <= 16:
        body = str(digits[0]) + ("." + "".join(map(str, digits[1:])) if len(digits) > 1 else "")
        return f"{sign}{body}e{point - 1}"
    plain = format(Decimal((0, digits, exponent)), "f")
    return sign + (plain if "." in plain else plain + ".0")


class Float(float):
    def __repr__(self) -> str:
        return number(float.__repr__(self))


def whole(text: str) -> int | Float:
    value = int(text)
    return value if -(2**63) <= value < 2**64 else Float(text)


def refuse(text: str):
    raise ValueError(text)


def render(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{render(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(render, value)) + "]"
    return repr(value) if isinstance(value, Float) else json.dumps(value, ensure_ascii=False)


def canonical_json(text: str) -> str:
    """Canonical text of a JSON value. Raises ValueError for what is not JSON; 1 and 1.0 stay different; of repeated keys the last counts."""
    return render(json.loads(text, parse_float=lambda t: Float(number(t)), parse_int=whole, parse_constant=refuse))


def canonical_or_none(text: str | None) -> str | None:
    try:
        return None if text is None else canonical_json(text)
    except (ValueError, RecursionError):
        return None


@pandas_udf(StringType())
def _canonical(text: pd.Series) -> pd.Series:
    return text.map(canonical_or_none)


def canonical(text: Column) -> Column:
    """Canonical JSON of a column, null where it is invalid."""
    return _canonical(text)
