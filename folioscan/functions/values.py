"""Text forms of typed values, as they are indexed.

All functions are built-in expressions. Times with a zone are taken in UTC and times
without one, and dates, as they are written; the session time zone plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ticks are 100 ns steps since 0001-01-01; this is 1970-01-01.
TICKS_AT_EPOCH = 621355968000000000
# Date-time text has seven fractional digits.
FRACTION_DIGITS = 7
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def datetime_ticks(value: Column) -> Column:
    """Ticks of a timestamp in UTC, or of the wall clock of a zone-less timestamp or date."""
    since = (value.cast("timestamp_ntz") - F.expr(_EPOCH)).cast("interval second").cast("decimal(20,6)")
    wall = (since * F.lit(1_000_000)).cast("bigint")
    # The type is known when the query is planned, so one branch is left.
    micros = F.when(F.typeof(value) == "timestamp", F.unix_micros(value.cast("timestamp"))).otherwise(wall)
    return micros * F.lit(10) + F.lit(TICKS_AT_EPOCH).cast("bigint")


def utc_wall_clock(value: Column) -> Column:
    """A timestamp with a zone as the zone-less time that clocks in UTC show."""
    seconds = (F.unix_micros(value).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _without_trailing_zeros(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def raw_decimal_text(value: Column, scale: int) -> Column:
    """Decimal text with all its fraction digits.

    Outside of ANSI mode Spark writes decimals below 1e-6 with an exponent; those are
    written out again.
    """
    text = value.cast("string")
    if scale <= 6:
        return text
    digits = F.replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), F.lit("."), F.lit(""))
    zeros = F.regexp_extract(text, r"E-([0-9]+)$", 1).try_cast("int") - 1
    fraction = F.rpad(F.concat(F.repeat(F.lit("0"), zeros), digits), scale, "0")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    return F.when(F.contains(text, F.lit("E")), F.concat(sign, F.lit("0."), fraction)).otherwise(text)


def decimal_text(value: Column, scale: int = 0) -> Column:
    """Decimal text without trailing fraction zeros: ``1.50`` gives ``1.5``, ``100.00`` gives ``100``."""
    return _without_trailing_zeros(raw_decimal_text(value, scale))


def float_text(value: Column) -> Column:
    """Culture-free text of a float or double.

    Plain digits from 1e-5 up to 1e15 (``23``, ``10000000``), and a signed exponent of
    two or more digits outside of that (``1E+15``, ``2.5E-07``). Digits are the shortest
    that read back to the same number.
    """
    text = value.cast("string")
    size = F.abs(value)
    plain = _without_trailing_zeros(text.try_cast("decimal(38,18)").cast("string"))
    # Below 1e-3 Spark writes an exponent; the digits are set behind its zeros, all of them.
    digits = F.rtrim(F.replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), F.lit("."), F.lit("")), F.lit("0"))
    zeros = F.regexp_extract(text, r"E-([0-9]+)$", 1).try_cast("int") - 1
    small = F.concat(F.when(value < 0, "-0.").otherwise("0."), F.repeat(F.lit("0"), zeros), digits)
    mantissa = F.regexp_replace(text, r"\.0E", "E")
    exponent = F.regexp_replace(F.regexp_replace(mantissa, r"E(\d)", "E+$1"), r"E([+-])(\d)$", "E$10$2")
    return (
        F.when(~F.contains(text, F.lit("E")), F.regexp_replace(text, r"\.0$", ""))
        .when((size >= F.lit(1e-5)) & (size < F.lit(1e-3)), small)
        .when((size >= F.lit(1e-3)) & (size < F.lit(1e15)), plain)
        .otherwise(exponent)
    )


def bool_text(value: Column, analyzed: bool = True) -> Column:
    text = value.cast("string")
    return text if analyzed else F.initcap(text)


def datetime_text(value: Column, utc: bool) -> Column:
    """Date-time text: of a timestamp with a zone in UTC (``utc``), or of a wall clock."""
    text = (utc_wall_clock(value) if utc else value.cast("timestamp_ntz")).cast("string")
    return _iso_text(text, "Z" if utc else "")


def _iso_text(text: Column, zone: str) -> Column:
    # A time's text leaves out trailing zeros of the fraction.
    fraction = F.rpad(F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(""), FRACTION_DIGITS, "0")
    return F.concat(F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T")), F.lit("."), fraction, F.lit(zone))


def offset_datetime_text(local: Column, offset: Column, keep_offset: bool) -> Column:
    """Text of a local time with its zone offset (``+02:00``): in UTC, or as given."""
    if keep_offset:
        return F.concat(datetime_text(local, utc=False), offset)
    return _iso_text(F.convert_timezone(offset, F.lit("UTC"), local.cast("timestamp_ntz")).cast("string"), "Z")


def json_text(value: Column) -> Column:
    return F.to_json(value)


_WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def kind_of(dtype: T.DataType) -> str:
    """The value family of a Spark type; binary columns are refused."""
    if isinstance(dtype, T.BinaryType):
        raise ValueError("binary fields are not supported")
    families = (
        ((T.StringType, T.CharType, T.VarcharType), "text"),
        ((T.TimestampType, T.TimestampNTZType, T.DateType), "date"),
        ((T.BooleanType,), "bool"),
        ((T.DecimalType,), "decimal"),
        (_WHOLE_NUMBERS + _FLOATS, "number"),
        ((T.MapType, T.StructType), "json"),
        ((T.NullType,), "null"),
    )
    for types, kind in families:
        if isinstance(dtype, types):
            return kind
    raise ValueError(f"no field rule for {dtype.simpleString()}")


def value_text(value: Column, dtype: T.DataType, analyzed: bool = True) -> Column:
    """The text of a value; ``analyzed=False`` keeps the raw form of numbers and flags."""
    kind = kind_of(dtype)
    if kind == "date":
        return datetime_text(value, utc=isinstance(dtype, T.TimestampType))
    if kind == "bool":
        return bool_text(value, analyzed)
    if kind == "decimal":
        return decimal_text(value, dtype.scale) if analyzed else raw_decimal_text(value, dtype.scale)
    if isinstance(dtype, _FLOATS):
        return float_text(value)
    if kind == "json":
        return json_text(value)
    return value.cast("string")
