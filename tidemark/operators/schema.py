"""Target-schema resolution.

The schema is fixed once: the first load derives it (from all of its Parquet
footers, or from the text itself); every later load is conformed to the
published table's schema. No schema evolution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import IncompatibleTypesError, MissingColumnsError
from tidemark.functions.coerce import DATETIME_PAIRS, INTEGER_PATTERN, NUMBER_OR_INF_PATTERN, strip_ws
from tidemark.functions.identifiers import quote_ident, sanitize_ident
from tidemark.functions.nulls import na_to_null

# Text a reader takes as a boolean.
BOOLEAN_TOKENS = ("True", "False", "true", "false", "TRUE", "FALSE")
# Integers beyond bigint keep every digit in this type; beyond it they stay text.
WIDE_INTEGER = T.DecimalType(38, 0)


def parquet_column_type(t: T.DataType) -> T.DataType:
    """Spark type read from a Parquet footer -> type of the target column."""
    if isinstance(t, T.ByteType):
        return T.ShortType()
    if isinstance(t, (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                      T.BooleanType, T.StringType, T.DateType, T.DecimalType, T.BinaryType,
                      T.TimestampType, T.TimestampNTZType)):
        return t
    # nested values and anything else are kept as text (JSON for nested)
    return T.StringType()


def parquet_target_schema(source: T.StructType) -> T.StructType:
    """Footer-only: no data is read. Column names must be safe identifiers."""
    return T.StructType([T.StructField(sanitize_ident(f.name), parquet_column_type(f.dataType), True)
                         for f in source.fields])


# Digits that a whole number of each type may have.
_INTEGER_DIGITS = {T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_FLOATING = (T.FloatType, T.DoubleType)


def join_types(kinds: list[T.DataType]) -> T.DataType | None:
    """The least target type that holds the values of all ``kinds``, None if there
    is none. It depends on the set of types only, not on the order of the files.

    Whole numbers widen to the longest one, exact numbers to a decimal with the
    longest whole part and scale, numbers of which one is floating to double, a
    date and a datetime without zone to the latter. Others only meet themselves.
    """
    distinct = list(dict.fromkeys(kinds))
    if len(distinct) == 1:
        return distinct[0]
    exact = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_INTEGER_DIGITS[type(t)], 0)
             for t in distinct if isinstance(t, (T.DecimalType, *_INTEGER_DIGITS))]
    if len(exact) == len(distinct):
        if not any(isinstance(t, T.DecimalType) for t in distinct):
            return max(distinct, key=lambda t: _INTEGER_DIGITS[type(t)])
        whole, scale = (max(parts) for parts in zip(*exact))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    if len(exact) + sum(isinstance(t, (T.FloatType, T.DoubleType)) for t in distinct) == len(distinct):
        return T.DoubleType()
    if {type(t) for t in distinct} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    return None


def merged_target_schema(footers: list[tuple[str, T.StructType]]) -> T.StructType:
    """The target schema of a first load of files with these (example file, footer).

    Columns are those of the footers in order of first appearance; each must be
    in every footer. A column's type is the join of its types over all footers.
    """
    found: dict[str, dict[T.DataType, str]] = {}
    for file, footer in footers:
        for f in parquet_target_schema(footer).fields:
            found.setdefault(f.name, {}).setdefault(f.dataType, file)
    for file, footer in footers:
        lacking = [n for n in found if n not in set(footer.fieldNames())]
        if lacking:
            raise MissingColumnsError(f"Parquet file {file} missing columns that other files of the load have: {lacking}")
    fields = []
    for name, kinds in found.items():
        wide = join_types(list(kinds))
        if wide is None:
            told = "; ".join(f"{t.simpleString()} in {file}" for t, file in kinds.items())
            raise IncompatibleTypesError(f"no one type holds column {name!r}: {told}")
        fields.append(T.StructField(name, wide, True))
    return T.StructType(fields)


def datetime_pair_columns(columns: list[str]) -> set[str]:
    """Columns of the known pickup/dropoff pairs whose partner is also present."""
    cols = set(columns)
    out: set[str] = set()
    for a, b in DATETIME_PAIRS:
        if a in cols and b in cols:
            out.update((a, b))
    return out


def infer_text_schema(df: DataFrame) -> T.StructType:
    """Type every text column from the whole input in one aggregate.

    Rule, over the non-missing values of a column: all integer text -> bigint
    if every value fits it, else decimal(38,0) if every value fits that, else
    string, so no digit is lost; all numbers -> double; all boolean words ->
    boolean; a known datetime pair -> timestamp_ntz; else (incl. all missing)
    string.
    One map-side partial aggregate per task, a single tiny final merge.
    """
    cols = df.columns
    for c in cols:
        sanitize_ident(c)
    pairs = datetime_pair_columns(cols)
    aggs = []
    for i, c in enumerate(cols):
        v = na_to_null(F.col(quote_ident(c)))
        s = strip_ws(v)
        whole = F.when(s.rlike(INTEGER_PATTERN), s)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(whole).alias(f"w{i}"),
            F.count(whole.try_cast("bigint")).alias(f"i{i}"),
            F.count(whole.try_cast(WIDE_INTEGER)).alias(f"x{i}"),
            F.count_if(s.rlike(NUMBER_OR_INF_PATTERN)).alias(f"d{i}"),
            F.count_if(v.isin(*BOOLEAN_TOKENS)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    fields = []
    for i, c in enumerate(cols):
        n, ni, nd, nb = row[f"n{i}"], row[f"i{i}"], row[f"d{i}"], row[f"b{i}"]
        if c in pairs:
            t: T.DataType = T.TimestampNTZType()
        elif n and ni == n:
            t = T.LongType()
        elif n and row[f"w{i}"] == n:
            t = WIDE_INTEGER if row[f"x{i}"] == n else T.StringType()
        elif n and nd == n:
            t = T.DoubleType()
        elif n and nb == n:
            t = T.BooleanType()
        else:
            t = T.StringType()
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)


def table_exists(spark: SparkSession, fq_name: str) -> bool:
    """True for tables and views."""
    return spark.catalog.tableExists(fq_name)


def table_columns(spark: SparkSession, fq_name: str) -> DataFrame:
    """(ordinal, column_name, data_type) of a table, in table order."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(spark.table(fq_name).schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A StructType as (ordinal, column_name, data_type) rows."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string")
