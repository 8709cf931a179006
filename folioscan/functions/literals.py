"""Typed number literals in search text.

``Ix5``, ``Lx5``, ``Fx2.5`` and ``Dx1.5`` are an int, a long, a float and a double;
``0x`` with 8 or 16 hex digits is an int or a long. ``NULL`` and ``*`` mean no bound.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a typed number.
TYPED_NUMBER = r"^\wx[-\w.]+$"

# What follows the prefix, for both decoders.
WHOLE = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
HEX = r"^[0-9A-Fa-f]+$"
_FLOAT_LIMIT = 3.4028235677973366e38
_BOUNDS = {"int": 31, "long": 63}


@dataclass(frozen=True)
class Number:
    kind: str
    value: int | float


def is_typed(text: str) -> bool:
    return re.match(TYPED_NUMBER, text) is not None


def _whole(digits: str, kind: str, text: str) -> Number:
    if not re.fullmatch(WHOLE, digits):
        raise ValueError(f"not a number: {text!r}")
    value = int(digits)
    limit = 1 << _BOUNDS[kind]
    if not -limit <= value < limit:
        raise ValueError(f"out of range for {kind}: {text!r}")
    return Number(kind, value)


def decode(text: str | None) -> Number | None:
    """Decode a literal when the query is built; anything malformed is a ``ValueError``."""
    if text is None or text == "*" or text.upper() == "NULL":
        return None
    if len(text) <= 2:
        raise ValueError(f"a typed number has more than 2 characters: {text!r}")
    prefix, digits = text[:2], text[2:]
    if prefix == "0x" and len(digits) in (8, 16) and re.fullmatch(HEX, digits):
        bits = 4 * len(digits)
        raw = int(digits, 16)
        return Number("int" if bits == 32 else "long", raw - (1 << bits) if raw >> (bits - 1) else raw)
    if prefix == "Ix":
        return _whole(digits, "int", text)
    if prefix == "Lx":
        return _whole(digits, "long", text)
    if prefix in ("Fx", "Dx"):
        if not re.fullmatch(DECIMAL, digits):
            raise ValueError(f"not a number: {text!r}")
        value = float(digits)
        if abs(value) == float("inf") or prefix == "Fx" and abs(value) >= _FLOAT_LIMIT:
            raise ValueError(f"out of range: {text!r}")
        return Number("double", value) if prefix == "Dx" else Number("float", struct.unpack("f", struct.pack("f", value))[0])
    raise ValueError(f"unknown number form: {text!r}")


def decode_column(text: Column) -> Column:
    """Decode a column of literals into ``struct<kind, long_value, double_value>``.

    ``kind`` is ``int``, ``long``, ``float``, ``double``, ``open`` for an absent bound, or ``error``.
    """
    prefix = F.substring(text, 1, 2)
    digits = F.substr(text, F.lit(3))
    is_hex, is_whole, is_decimal = (digits.rlike(p) for p in (HEX, WHOLE, DECIMAL))
    kind = (
        F.when(text.isNull() | (text == "*") | (F.upper(text) == "NULL"), "open")
        .when(F.length(text) <= 2, "error")
        .when((prefix == "0x") & is_hex & (F.length(digits) == 8), "int")
        .when((prefix == "0x") & is_hex & (F.length(digits) == 16), "long")
        .when((prefix == "Ix") & is_whole & digits.try_cast("int").isNotNull(), "int")
        .when((prefix == "Lx") & is_whole & digits.try_cast("bigint").isNotNull(), "long")
        .when((prefix == "Fx") & is_decimal & (F.abs(digits.try_cast("float")) < float("inf")), "float")
        .when((prefix == "Dx") & is_decimal & (F.abs(digits.try_cast("double")) < float("inf")), "double")
        .otherwise("error")
    )
    from_hex = F.conv(F.when(is_hex & (F.length(digits) <= 16), digits), 16, -10).try_cast("bigint")
    int_from_hex = F.shiftright(F.shiftleft(from_hex, 32), 32)
    whole = F.when(prefix != "0x", digits.try_cast("bigint")).when(F.length(digits) == 8, int_from_hex).otherwise(from_hex)
    return F.struct(
        kind.alias("kind"),
        F.when(kind.isin("int", "long"), whole).alias("long_value"),
        F.when(kind == "float", digits.try_cast("float").cast("double"))
        .when(kind == "double", digits.try_cast("double"))
        .alias("double_value"),
    )
