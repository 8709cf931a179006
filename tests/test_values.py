"""Texts of single values, and typed literals."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import literals, values


def texts(spark, data, spark_type, rule):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {spark_type}")
    return [r.t for r in rows.select("i", rule(F.col("v")).alias("t")).orderBy("i").collect()]


def test_decimal_text(spark):
    data = [Decimal("1.50"), Decimal("100.00"), Decimal("0.05"), Decimal("0.00"), Decimal("-7.10"), None]
    assert texts(spark, data, "decimal(12,2)", values.decimal_text) == ["1.5", "100", "0.05", "0", "-7.1", None]
    whole = texts(spark, [Decimal(100), Decimal(0)], "decimal(12,0)", values.decimal_text)
    assert whole == ["100", "0"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_small_decimals(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        data = [Decimal("0E-10"), Decimal("-0.0000000015"), Decimal("0.0000001"), Decimal("12.5")]
        dtype = T.DecimalType(20, 10)
        raw = texts(spark, data, "decimal(20,10)", lambda c: values.value_text(c, dtype, analyzed=False))
        assert raw == ["0.0000000000", "-0.0000000015", "0.0000001000", "12.5000000000"]
        trimmed = texts(spark, data, "decimal(20,10)", lambda c: values.value_text(c, dtype))
        assert trimmed == ["0", "-0.0000000015", "0.0000001", "12.5"]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_double_text(spark):
    data = [23.0, 1e7, -1e7, 0.5, 123456789.125, 1e14, 1e15, 1.5e20, 1e-4, 0.00001, 2.5e-7, 0.0, float("nan"), None]
    expected = ["23", "10000000", "-10000000", "0.5", "123456789.125", "100000000000000", "1E+15", "1.5E+20"]
    expected += ["0.0001", "0.00001", "2.5E-07", "0", "NaN", None]
    assert texts(spark, data, "double", values.float_text) == expected


def test_float_text(spark):
    assert texts(spark, [23.0, 0.25, 16777216.0], "float", values.float_text) == ["23", "0.25", "16777216"]


def test_flags(spark):
    assert texts(spark, [True, False], "boolean", values.bool_text) == ["true", "false"]
    assert texts(spark, [True, False], "boolean", lambda c: values.bool_text(c, analyzed=False)) == ["True", "False"]


def test_datetimes(spark):
    moment = datetime(2009, 11, 18, 7, 5, 3, 123456)
    local = texts(spark, [moment], "timestamp_ntz", lambda c: values.value_text(c, T.TimestampNTZType()))
    assert local == ["2009-11-18T07:05:03.1234560"]
    cast = texts(spark, [moment], "timestamp_ntz", lambda c: values.value_text(c.cast("timestamp"), T.TimestampType()))
    assert cast == ["2009-11-18T07:05:03.1234560Z"]
    offset = F.lit("-05:30")
    kept = texts(spark, [moment], "timestamp_ntz", lambda c: values.offset_datetime_text(c, offset, keep_offset=True))
    assert kept == ["2009-11-18T07:05:03.1234560-05:30"]
    utc = texts(spark, [moment], "timestamp_ntz", lambda c: values.offset_datetime_text(c, offset, keep_offset=False))
    assert utc == ["2009-11-18T12:35:03.1234560Z"]


def test_ticks(spark):
    days = (datetime(2009, 11, 18) - datetime(1, 1, 1)).days
    found = texts(spark, [datetime(2009, 11, 18), datetime(1970, 1, 1)], "timestamp_ntz", values.datetime_ticks)
    assert found == [days * 864_000_000_000, values.TICKS_AT_EPOCH]


def test_kinds():
    with pytest.raises(ValueError):
        values.kind_of(T.BinaryType())
    assert values.kind_of(T.ShortType()) == "number"
    assert values.kind_of(T.MapType(T.StringType(), T.StringType())) == "json"


LITERALS = {
    "Ix5": ("int", 5),
    "Ix-12": ("int", -12),
    "Lx-5": ("long", -5),
    "Lx9000000000": ("long", 9000000000),
    "Dx1.5": ("double", 1.5),
    "Fx2.5": ("float", 2.5),
    "0xFFFFFFFF": ("int", -1),
    "0x0000000A": ("int", 10),
    "0x7FFFFFFFFFFFFFFF": ("long", 2**63 - 1),
    "0xFFFFFFFFFFFFFFFE": ("long", -2),
    "NULL": None,
    "null": None,
    "*": None,
}
MALFORMED = ["xx", "Ix", "Zx5", "0xFFF", "Ixabc", "Dx--", "Ix99999999999", "0xGGGGGGGG", "Ix1_0", "0xFFFFFFFFFFFFFFFFFF"]


def test_decode():
    for text, expected in LITERALS.items():
        found = literals.decode(text)
        assert (found and (found.kind, found.value)) == expected, text
    assert literals.decode(None) is None
    for text in MALFORMED:
        with pytest.raises(ValueError):
            literals.decode(text)


def test_decode_column_agrees(spark):
    rows = spark.createDataFrame([(t,) for t in [*LITERALS, *MALFORMED, None]], "t string")
    for row in rows.select("t", literals.decode_column(F.col("t")).alias("n")).collect():
        if row.t in MALFORMED:
            assert row.n.kind == "error", row
        elif LITERALS.get(row.t) is None:
            assert row.n.kind == "open", row
        else:
            kind, value = LITERALS[row.t]
            number = row.n.long_value if kind in ("int", "long") else row.n.double_value
            assert (row.n.kind, number) == (kind, value), row


def test_typed_detector():
    assert literals.is_typed("Lx-5") and literals.is_typed("0xFF") and literals.is_typed("Dx1.5")
    assert not literals.is_typed("Lx") and not literals.is_typed("blue") and not literals.is_typed("Lx 5")
