"""Conform a source DataFrame to the target schema.

One projection: required-column check, target order, NULL tokens, datetime
pairs, tolerant numeric and integer parsing, ANSI cast of everything else.
It is a single ``select`` of built-in expressions, so the whole conform runs
inside the scan's whole-stage-codegen span and Parquet columns not in the
target are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import MissingColumnsError
from tidemark.functions.coerce import (
    DATETIME_FORMATS, WHOLE_TOLERANCE, datetime_fits, fraction_flag, is_integral_type, is_numeric_type, to_datetime, to_integer,
    to_number, _parsed_double,
)
from tidemark.functions.identifiers import quote_ident
from tidemark.functions.nulls import empty_to_null, na_to_null
from tidemark.operators.schema import datetime_pair_columns

_NESTED = (T.ArrayType, T.MapType, T.StructType)
_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def missing_columns(source_columns: list[str], target: T.StructType) -> list[str]:
    """Target columns absent from the source; names compare exactly (case kept)."""
    have = set(source_columns)
    return [f.name for f in target.fields if f.name not in have]


def require_columns(source_columns: list[str], target: T.StructType, what: str = "source") -> None:
    miss = missing_columns(source_columns, target)
    if miss:
        raise MissingColumnsError(f"{what} missing columns required by target table: {miss}")


def _from_text(raw: Column, f: T.StructField, is_pair: bool, written: str = "iso") -> Column:
    t = f.dataType
    if is_pair and isinstance(t, _TEMPORAL + (T.StringType,)):
        ts = to_datetime(raw, T.TimestampNTZType(), written)
        return ts if isinstance(t, T.TimestampNTZType) else ts.cast(t)
    if is_integral_type(t):
        return to_integer(raw, t)
    if is_numeric_type(t):
        return to_number(raw, t)
    if isinstance(t, T.StringType):
        return raw
    return raw.cast(t)


def conform_text(df: DataFrame, target: T.StructType, formats: dict[str, str] | None = None) -> DataFrame:
    """All-text source -> target schema (CSV/TSV path). ``formats`` names how the
    datetimes of a column are written, where it is not ISO."""
    require_columns(df.columns, target)
    pairs, formats = datetime_pair_columns(target.fieldNames()), formats or {}
    out = [_from_text(na_to_null(F.col(quote_ident(f.name))), f, f.name in pairs, formats.get(f.name, "iso")).alias(f.name)
           for f in target.fields]
    return df.select(*out)


def _from_typed(c: Column, st: T.DataType, f: T.StructField, is_pair: bool, written: str) -> Column:
    t = f.dataType
    if isinstance(st, T.StringType):
        return _from_text(empty_to_null(c), f, is_pair, written)
    if isinstance(st, _NESTED):
        return F.to_json(c).cast(t) if not isinstance(t, T.StringType) else F.to_json(c)
    if isinstance(st, (T.FloatType, T.DoubleType)):
        c = F.nanvl(c, F.lit(None).cast(st))          # NaN is missing, as in text
        if is_integral_type(t):
            frac = F.pmod(c.cast("double"), F.lit(1.0))
            return F.when(frac <= WHOLE_TOLERANCE, (c.cast("double") - frac)).cast(t)
    if isinstance(st, T.DecimalType) and is_integral_type(t):
        return F.when(c == F.floor(c), c).cast(t)     # a fraction is NULL, never cut off
    if isinstance(st, T.BinaryType) and isinstance(t, T.StringType):
        return F.base64(c)
    return c.cast(t)


def conform_typed(df: DataFrame, target: T.StructType, formats: dict[str, str] | None = None) -> DataFrame:
    """Typed (Parquet) source -> target schema."""
    require_columns(df.columns, target)
    pairs, formats = datetime_pair_columns(target.fieldNames()), formats or {}
    src = {f.name: f.dataType for f in df.schema.fields}
    out = [_from_typed(F.col(quote_ident(f.name)), src[f.name], f, f.name in pairs, formats.get(f.name, "iso")).alias(f.name)
           for f in target.fields]
    return df.select(*out)


def _fraction(c: Column, st: T.DataType, text: bool) -> tuple[Column, Column] | None:
    """(value is nulled for its fraction, value as double), None where a source
    of this type has no fractions."""
    if isinstance(st, T.StringType):
        raw = na_to_null(c) if text else empty_to_null(c)
        return fraction_flag(raw), _parsed_double(raw)
    if isinstance(st, T.DecimalType):
        return c != F.floor(c), c.cast("double")
    if isinstance(st, (T.FloatType, T.DoubleType)):
        d = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        return ~F.coalesce(F.pmod(d, F.lit(1.0)) <= WHOLE_TOLERANCE, F.lit(False)) & d.isNotNull(), d
    return None


def fraction_aggregates(df: DataFrame, target: T.StructType, text: bool = True) -> list[Column]:
    """Per integer target column fed by text, floats or decimals: values nulled
    for a fraction (P8).

    Returns aggregate Columns ``<col>__fractions`` and ``<col>__example``; the
    example is the smallest offending value, so it is deterministic.
    """
    src = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for f in target.fields:
        if not is_integral_type(f.dataType) or f.name not in src:
            continue
        found = _fraction(F.col(quote_ident(f.name)), src[f.name], text)
        if found is None:
            continue
        bad, value = found
        aggs += [F.count_if(bad).alias(f"{f.name}__fractions"),
                 F.min(F.when(bad, value)).alias(f"{f.name}__example")]
    return aggs


def _dated(df: DataFrame, target: T.StructType) -> list[str]:
    """Columns of the datetime pairs that the source holds as text."""
    pairs = datetime_pair_columns(target.fieldNames())
    src = {f.name: f.dataType for f in df.schema.fields}
    return [f.name for f in target.fields if f.name in pairs and isinstance(src.get(f.name), T.StringType)
            and isinstance(f.dataType, _TEMPORAL + (T.StringType,))]


def datetime_aggregates(df: DataFrame, target: T.StructType, text: bool = True,
                        formats: dict[str, str] | None = None) -> list[Column]:
    """Per datetime column fed by text: ``<col>__undated``, the values that are
    present but become NULL because they are not written in its format (P9), and
    ``<col>__formats``, the bits of the formats that would read all its values."""
    aggs = []
    for name in _dated(df, target):
        c = F.col(quote_ident(name))
        raw = na_to_null(c) if text else empty_to_null(c)
        written = (formats or {}).get(name, "iso")
        aggs += [F.count_if(raw.isNotNull() & to_datetime(raw, fmt=written).isNull()).alias(f"{name}__undated"),
                 F.bit_and(datetime_fits(raw)).alias(f"{name}__formats")]
    return aggs


def datetime_formats(df: DataFrame, target: T.StructType, text: bool = True) -> DataFrame:
    """(column_name, formats) per datetime column fed by text, from one aggregate:
    the names of the formats that read every value of the column, the preferred
    one first; empty where no single one does, null where there is no value."""
    names = _dated(df, target)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, formats array<string>")

    def of(name: str) -> Column:
        bits = F.col(quote_ident(f"{name}__formats"))
        named = [F.when(bits.bitwiseAND(1 << i) > 0, F.lit(f)) for i, f in enumerate(DATETIME_FORMATS)]
        return F.when(bits.isNotNull(), F.array_compact(F.array(*named)))

    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), of(n).alias("formats")) for n in names])
    return df.agg(*datetime_aggregates(df, target, text)).select(F.inline(rows))


def datetime_report(df: DataFrame, target: T.StructType, text: bool = True) -> DataFrame:
    """(column_name, undated) per datetime column fed by text, from one aggregate."""
    names = _dated(df, target)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, undated bigint")
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(quote_ident(f"{n}__undated")).alias("undated"))
                     for n in names])
    return df.agg(*datetime_aggregates(df, target, text)).select(F.inline(rows))


def integer_report(df: DataFrame, target: T.StructType, text: bool = True) -> DataFrame:
    """(column_name, fractions, example) per integer column, from one aggregate."""
    aggs = fraction_aggregates(df, target, text)
    cols = [f.name for f in target.fields if is_integral_type(f.dataType) and f.name in df.columns
            and _fraction(F.lit(None), df.schema[f.name].dataType, text) is not None]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, fractions bigint, example double")
    agg = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              F.col(quote_ident(f"{c}__fractions")).alias("fractions"),
                              F.col(quote_ident(f"{c}__example")).alias("example")) for c in cols])
    return agg.select(F.inline(rows))
