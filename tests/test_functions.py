"""Column builders against the adversarial cases (NULL tokens, coercion, names, months)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import UnsafeIdentifierError
from tidemark.functions import (
    expected_month, month_window, na_to_null, normalize_ident, normalize_ident_col,
    sanitize_ident, to_datetime, to_integer, to_number,
)
from tidemark.functions.identifiers import is_safe_ident_col
from tidemark.functions.months import expected_month_col, month_end_col, month_start_col


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_na_tokens(spark):
    vals = ["", "NA", "N/A", "null", "None", "<NA>", "#N/A", "-", " NA ", "x"]
    assert _apply(spark, vals, na_to_null) == [None] * 7 + ["-", " NA ", "x"]


def test_number_accepts(spark):
    vals = [" 5 ", "+5", "1e3", "inf", "-Infinity", ".5", "5."]
    assert _apply(spark, vals, to_number) == [5.0, 5.0, 1000.0, float("inf"), float("-inf"), 0.5, 5.0]


def test_number_rejects(spark):
    vals = ["1,000", "1_000", "0x10", "1.5d", "True", "abc", "1.5f", "", None]
    assert _apply(spark, vals, to_number) == [None] * len(vals)


def test_decimal_exact(spark):
    got = _apply(spark, ["0.1", "1e2", "12345678901234567.89", "inf"], lambda c: to_number(c, T.DecimalType(20, 2)))
    assert [str(g) if g is not None else None for g in got] == ["0.10", "100.00", "12345678901234567.89", None]


def test_integer_accepts(spark):
    vals = ["3.0", " 5 ", "1e3", "-3.0", "9007199254740993", "3.0000000001", "+7", "007"]
    assert _apply(spark, vals, to_integer) == [3, 5, 1000, -3, 9007199254740993, 3, 7, 7]


def test_integer_rejects(spark):
    vals = ["1.5", "-1.5", "2.9999999999", "inf", "nan", "abc", "1e-3"]
    assert _apply(spark, vals, to_integer) == [None] * len(vals)


@pytest.mark.parametrize("text,target", [("70000", T.ShortType()), ("1e100", T.LongType()),
                                         ("99999999999999999999", T.LongType())])
def test_integer_overflow_fails(spark, text, target):
    with pytest.raises(Exception):
        _apply(spark, [text], lambda c: to_integer(c, target))


def test_datetime(spark):
    vals = ["2024-01-01 00:00:00", "2024-01-02", "bad", "01/02/2024", "2024", "2024-02-30",
            "2024-01-01T10:11:12.5"]
    assert _apply(spark, vals, to_datetime) == [
        datetime(2024, 1, 1), datetime(2024, 1, 2), None, None, None, None,
        datetime(2024, 1, 1, 10, 11, 12, 500000)]


@pytest.mark.parametrize("raw,out", [("VendorID", "vendorid"), ("pickup-date", "pickup_date"),
                                     ("Rate Code", "rate_code"), ("  a..b//c  ", "a_b_c"),
                                     ("__x__", "x"), ("a\u00a0b", "a_b")])
def test_normalize_ident(spark, raw, out):
    assert normalize_ident(raw) == out
    assert _apply(spark, [raw], normalize_ident_col) == [out]


def test_normalize_ident_empty(spark):
    with pytest.raises(UnsafeIdentifierError):
        normalize_ident("--")
    assert _apply(spark, ["--"], normalize_ident_col) == [None]


@pytest.mark.parametrize("bad", ["1abc", "a-b", "a b", "", "abc\n"])
def test_sanitize_rejects(spark, bad):
    with pytest.raises(UnsafeIdentifierError):
        sanitize_ident(bad)
    assert _apply(spark, [bad], is_safe_ident_col) == [False]


def test_sanitize_accepts(spark):
    assert sanitize_ident("_a1") == "_a1"
    assert _apply(spark, ["_a1"], is_safe_ident_col) == [True]


def test_expected_month(spark):
    names = ["yellow_tripdata_2024_01", "trips", "a_2024_011"]
    assert [expected_month(n) for n in names] == ["2024_01", None, "2024_01"]
    assert _apply(spark, names, expected_month_col) == ["2024_01", None, "2024_01"]


def test_month_window(spark):
    assert month_window("2024_12") == (datetime(2024, 12, 1), datetime(2025, 1, 1))
    assert _apply(spark, ["2024_12"], month_start_col) == [datetime(2024, 12, 1)]
    assert _apply(spark, ["2024_12"], month_end_col) == [datetime(2025, 1, 1)]
    with pytest.raises(ValueError):
        month_window("2024_13")
