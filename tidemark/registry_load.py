"""Registered load queries: sources (S), schema (C), conform (P), validation (V), publish (W).

Each reads the given tables in full, directly or through files Spark writes
from them into the shared scratch folder, and returns a DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixtures as fx
from tidemark.errors import MissingColumnsError, TableExistsError
from tidemark.functions.coerce import to_datetime, to_integer, to_number
from tidemark.functions.identifiers import (
    WHITESPACE_CHARS, is_safe_ident_col, normalize_ident_col,
)
from tidemark.functions.months import expected_month, expected_month_col, month_end_col, month_start_col
from tidemark.functions.nulls import NA_TOKENS, na_to_null
from tidemark.operators import publish as pub
from tidemark.operators.conform import conform_typed, datetime_report, integer_report
from tidemark.operators.schema import (
    infer_text_schema, parquet_target_schema, schema_rows, table_columns,
)
from tidemark.operators.validate import detect_datetime_column, exceeds_expr, validation_metrics
from tidemark.pipeline import ingest, ingest_month, read_conformed
from tidemark.plans import queries as Q
from tidemark.plans.trips import read_table, trips_from_tables, zones_from_nation
from tidemark.registry import ORACLE_SQL, register
from tidemark.session import scratch_database
from tidemark.sources.paths import (
    FileFormat, detect_format_col, month_path_col, month_table_col, table_name_from_url_col,
)
from tidemark.sources.text import read_delimited


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:10]}"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------ dirty text --
# Adversarial text cycled over every row of ``orders`` by o_orderkey; the
# {K}/{C}/{TS}/{D} slots are filled from the row itself.
DIRTY_NUMBERS = (
    "N/A", "", "1.5", "3.0", "abc", " 5 ", "1e3", "-1.5", "2.9999999999", " NA ", "+7", "inf",
    "1,000", "0x10", "{C}.0", "{K}", "9007199254740993", "3.0000000001", "-3.0", "1_000", "1.5d",
    "True", "-", "NaN", ".5", "-0", "1e400", "null", "  -12  ", "{K}",
)
DIRTY_DATETIMES = (
    "bad", "{D}", "{TS}", "2024-02-30 00:00:00", "2024", "01/02/2024", "{D}T12:30:45", " {TS} ",
    "", "{TS}.123456", "2024-13-01", "NA", "{D} 25:00:00", "{TS}", "{D}T12:30:45Z", "{TS}+02:00", "{TS}.123456789",
    "01/05/2024 10:00:00 AM",
)


def _dirty_case(values: tuple[str, ...], text_type: str) -> str:
    slots = {"{K}": f"CAST(o_orderkey AS {text_type})", "{C}": f"CAST(o_custkey AS {text_type})",
             "{TS}": f"CAST(o_orderdate AS {text_type})",
             "{D}": f"CAST(CAST(o_orderdate AS DATE) AS {text_type})"}
    arms = []
    for i, v in enumerate(values):
        parts, rest = [], v
        while rest:
            hit = min(((rest.find(k), k) for k in slots if k in rest), default=None)
            if hit is None:
                parts.append(_sql_str(rest))
                break
            pos, k = hit
            if pos:
                parts.append(_sql_str(rest[:pos]))
            parts.append(slots[k])
            rest = rest[pos + len(k):]
        expr = " || ".join(parts) if parts else "''"
        arms.append(f"WHEN {i} THEN {expr}")
    return f"CASE CAST(o_orderkey % {len(values)} AS INT) " + " ".join(arms) + " END"


def _dirty(spark, sf, values) -> DataFrame:
    return read_table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", _dirty_case(values, "STRING") + " AS s")


def _dirty_sql(values) -> str:
    return f"SELECT o_orderkey AS id, {_dirty_case(values, 'VARCHAR')} AS s FROM orders"


_NA_LIST = ", ".join(_sql_str(t) for t in NA_TOKENS)
_NUM_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_INF = "lower(trim(s)) IN ('inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity')"
_CLEAN = f"CASE WHEN s IN ({_NA_LIST}) THEN NULL ELSE s END"


@register("p_na", f"SELECT id, {_CLEAN} AS s FROM ({_dirty_sql(DIRTY_NUMBERS)})")
def p_na(spark, sf):
    return _dirty(spark, sf, DIRTY_NUMBERS).select("id", na_to_null("s").alias("s"))


# numerals beyond the double range are missing; only the infinity words are infinite
_PARSED = (f"CASE WHEN regexp_matches(trim(s), '{_NUM_RE}') AND isfinite(CAST(trim(s) AS DOUBLE)) "
           f"THEN CAST(trim(s) AS DOUBLE) WHEN {_INF} THEN CAST(trim(s) AS DOUBLE) END")


@register("p_num", f"""
SELECT id, {_PARSED} AS value
FROM (SELECT id, {_CLEAN} AS s FROM ({_dirty_sql(DIRTY_NUMBERS)}))""")
def p_num(spark, sf):
    return _dirty(spark, sf, DIRTY_NUMBERS).select("id", to_number(na_to_null("s")).alias("value"))


_X = "CAST(trim(s) AS DOUBLE)"
_P_INT_SQL = f"""
SELECT id, CASE WHEN regexp_matches(trim(s), '^[+-]?[0-9]+$') THEN CAST(trim(s) AS BIGINT)
  WHEN (regexp_matches(trim(s), '{_NUM_RE}') OR {_INF}) AND {_X} - floor({_X}) <= 1e-9
  THEN CAST(floor({_X}) AS BIGINT) END AS value
FROM (SELECT id, {_CLEAN} AS s FROM ({_dirty_sql(DIRTY_NUMBERS)}))"""


@register("p_int", _P_INT_SQL)
def p_int(spark, sf):
    return _dirty(spark, sf, DIRTY_NUMBERS).select("id", to_integer(na_to_null("s")).alias("value"))


@register("p_int_report", f"""
SELECT 's' AS column_name, count(*) FILTER (WHERE x - floor(x) > 1e-9) AS fractions,
       min(CASE WHEN x - floor(x) > 1e-9 THEN x END) AS example
FROM (SELECT CASE WHEN NOT regexp_matches(trim(s), '^[+-]?[0-9]+$') THEN {_PARSED} END AS x
      FROM (SELECT {_CLEAN} AS s FROM ({_dirty_sql(DIRTY_NUMBERS)})))""")
def p_int_report(spark, sf):
    df = _dirty(spark, sf, DIRTY_NUMBERS).select("s")
    return integer_report(df, T.StructType([T.StructField("s", T.LongType())]), text=True)


# the expected value of each dirty literal, in order of DIRTY_DATETIMES: o_orderdate, its day, or nothing
_DAY = "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)"
_DT_VALUES = (
    None, _DAY, "o_orderdate", None, None, None, f"{_DAY} + INTERVAL 45045 SECOND", "o_orderdate",
    None, "o_orderdate + INTERVAL 123456 MICROSECOND", None, None, None, "o_orderdate",
    f"{_DAY} + INTERVAL 45045 SECOND", "o_orderdate", "o_orderdate + INTERVAL 123456 MICROSECOND", None,
)
_DT_MISSING = (8, 11)       # the empty text and NA are missing, not undated
_DT_CASE = f"CASE CAST(o_orderkey % {len(_DT_VALUES)} AS INT) " + " ".join(
    f"WHEN {i} THEN {v}" for i, v in enumerate(_DT_VALUES) if v) + " END"


@register("p_dt", f"SELECT o_orderkey AS id, {_DT_CASE} AS ts FROM orders")
def p_dt(spark, sf):
    return _dirty(spark, sf, DIRTY_DATETIMES).select("id", to_datetime(na_to_null("s")).alias("ts"))


# a row without an order date has no text in the literals made from it
@register("p_dt_report", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_DT_CASE} IS NULL
  AND CAST(o_orderkey % {len(_DT_VALUES)} AS INT) NOT IN {_DT_MISSING}
  AND ({_dirty_case(DIRTY_DATETIMES, 'VARCHAR')}) IS NOT NULL) AS undated FROM orders"""
                                            for c in ("lpep_pickup_datetime", "lpep_dropoff_datetime")))
def p_dt_report(spark, sf):
    """Datetime text that is present but becomes NULL is counted, not lost without a word."""
    pair = ("lpep_pickup_datetime", "lpep_dropoff_datetime")
    df = _dirty(spark, sf, DIRTY_DATETIMES).select(*[F.col("s").alias(c) for c in pair])
    return datetime_report(df, T.StructType([T.StructField(c, T.TimestampNTZType()) for c in pair]))


# prices with and without a fraction, as a decimal and as a double
_PRICE = "CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE o_totalprice END"
_TYPED = (f"SELECT o_orderkey, CAST({_PRICE} AS DECIMAL(12,2)) AS price_dec, CAST({_PRICE} AS DOUBLE) AS price_dbl "
          "FROM {t}")
_TYPED_TARGET = T.StructType([T.StructField(c, T.LongType()) for c in ("o_orderkey", "price_dec", "price_dbl")])


_WRITTEN_AT = "o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT))"


@register("p_dt_formats", f"""
SELECT o_orderkey AS trip_id, {_WRITTEN_AT} AS lpep_pickup_datetime,
  date_trunc('minute', {_WRITTEN_AT} + INTERVAL 1 DAY) AS lpep_dropoff_datetime FROM orders""")
def p_dt_formats(spark, sf):
    """A load whose pickup column is written with the month first and hours of
    twelve, and whose dropoff column is ISO without seconds."""
    at = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") * 7919 % 86400)
    rows = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trip_id"), F.date_format(at, "M/d/yyyy h:mm:ss a").alias("lpep_pickup_datetime"),
        F.date_format(at + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm").alias("lpep_dropoff_datetime"))
    m = ingest(spark, fx.write_text(spark, rows, "formats"), _name("formats"), database=scratch_database(spark))
    return spark.table(m["table"])


def _typed_prices(spark, sf) -> DataFrame:
    return spark.sql(_TYPED.replace("{t}", "{o}"), o=fx.orders(spark, sf))


@register("p_int_decimal", f"""
SELECT o_orderkey, CASE WHEN price_dec = floor(price_dec) THEN CAST(price_dec AS BIGINT) END AS price_dec,
  CASE WHEN price_dbl - floor(price_dbl) <= 1e-9 THEN CAST(floor(price_dbl) AS BIGINT) END AS price_dbl
FROM ({_TYPED.replace("{t}", "orders")})""")
def p_int_decimal(spark, sf):
    """Typed fractions going into an integer column are NULL, never cut off."""
    return conform_typed(_typed_prices(spark, sf), _TYPED_TARGET)


@register("p_int_report_typed", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} - floor({c}) > 1e-9) AS fractions,
  CAST(min({c}) FILTER (WHERE {c} - floor({c}) > 1e-9) AS DOUBLE) AS example
FROM ({_TYPED.replace("{t}", "orders")})""" for c in ("price_dec", "price_dbl")))
def p_int_report_typed(spark, sf):
    """The fraction report covers decimal and double sources too."""
    return integer_report(_typed_prices(spark, sf), _TYPED_TARGET, text=False)


# ------------------------------------------------------- delimited scans --
def _read_back(spark, path, fmt, target) -> DataFrame:
    df, _, _ = read_conformed(spark, [path], FileFormat(fmt), target, observe=False)
    return df


@register("s_csv", "SELECT * FROM orders")
def s_csv(spark, sf):
    o = fx.orders(spark, sf)
    path = fx.write_text(spark, o, "orders_csv", ",", gzip=True)
    return _read_back(spark, path, "csv", parquet_target_schema(o.schema))


@register("s_csv_split", """
SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents""")
def s_csv_split(spark, sf):
    """All documents, line breaks inside quotes, as plain CSV, a file for each task that
    reads the table, and many tasks read each file by ranges: the range size is set to a
    small one for this load."""
    from tidemark.session import scratch_path

    path, kept = scratch_path(spark, "sources", "documents", suffix=".csv"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    fx.as_text(read_table(spark, sf, "documents")).write.option("header", "true").option("escape", '"').csv(path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        m = ingest(spark, path, _name("documents"), fmt="csv", database=scratch_database(spark))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    return spark.table(m["table"])


@register("s_tsv", "SELECT * FROM orders")
def s_tsv(spark, sf):
    o = fx.orders(spark, sf)
    path = fx.write_text(spark, o, "orders_tsv", "\t", gzip=True)
    return _read_back(spark, path, "tsv", parquet_target_schema(o.schema))


@register("s_parquet", "SELECT * FROM orders")
def s_parquet(spark, sf):
    o = fx.orders(spark, sf)
    path = fx.write_parquet(spark, o, "orders_parquet")
    return _read_back(spark, path, "parquet", parquet_target_schema(o.schema))


@register("s_parquet_drift", "SELECT * FROM orders")
def s_parquet_drift(spark, sf):
    """One folder whose files hold the customer key as bigint and as double."""
    o = fx.orders(spark, sf)
    early, late = fx.split_early(o)
    path = fx.write_parquet(spark, early, "orders_drift")
    late.withColumn("o_custkey", F.col("o_custkey").cast("double")).write.mode("append").parquet(path)
    return _read_back(spark, path, "parquet", parquet_target_schema(o.schema))


@register("c_parquet_widen", """
SELECT o_orderkey, CAST(CASE WHEN early THEN o_custkey ELSE o_custkey + 0.5 END AS DOUBLE) AS o_custkey,
  CASE WHEN early THEN round(CAST(o_totalprice AS DECIMAL(18, 2)), 1) ELSE CAST(o_totalprice AS DECIMAL(18, 2)) END::DOUBLE AS o_totalprice,
  CAST(o_orderkey % 1000 AS BIGINT) AS rest
FROM (SELECT *, coalesce(o_orderdate < TIMESTAMP '1998-01-01', false) AS early FROM orders)""")
def c_parquet_widen(spark, sf):
    """A first load of files that differ in types: bigint and fractions in the later
    file, decimals of two scales, int and bigint."""
    early, late = fx.split_early(fx.orders(spark, sf))
    price, rest = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey") % 1000
    a = early.select("o_orderkey", "o_custkey", F.round(price, 1).cast("decimal(12,1)").alias("o_totalprice"), rest.cast("int").alias("rest"))
    b = late.select("o_orderkey", (F.col("o_custkey") + F.lit(0.5)).alias("o_custkey"), price.alias("o_totalprice"), rest.cast("bigint").alias("rest"))
    folder = fx.write_parquet(spark, a, "widen_a"), fx.write_parquet(spark, b, "widen_b")
    m = ingest(spark, list(folder), _name("widen"), database=scratch_database(spark))
    return spark.table(m["table"]).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


# Suffixes cycled over page ids to form file names for format routing.
_SUFFIXES = (".csv", ".CSV.GZ", ".tsv", ".tsv.gz", ".parquet", ".parquet.gz", ".json", "", ".Parquet", ".csv.bz2")
_SUFFIX_CASE_SQL = "CASE CAST(page_id % {n} AS INT) " + " ".join(
    f"WHEN {i} THEN {_sql_str(s)}" for i, s in enumerate(_SUFFIXES)) + " END"


@register("s_format", f"""
SELECT page_id, p AS path, CASE WHEN lower(p) LIKE '%.parquet' THEN 'parquet'
  WHEN lower(p) LIKE '%.csv' OR lower(p) LIKE '%.csv.gz' THEN 'csv'
  WHEN lower(p) LIKE '%.tsv' OR lower(p) LIKE '%.tsv.gz' THEN 'tsv' ELSE 'unknown' END AS format
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || {_SUFFIX_CASE_SQL.format(n=len(_SUFFIXES))} AS p FROM pages)""")
def s_format(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    p = pages.select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""),
                                         F.expr(_SUFFIX_CASE_SQL.format(n=len(_SUFFIXES)))).alias("path"))
    return p.select("page_id", "path", detect_format_col("path").alias("format"))


_BASE = "hdfs://landing/trips"
_DATASET_SQL = "CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'yellow' ELSE 'fhv' END"
_FMT_SQL = "CASE WHEN o_orderpriority < '3' THEN 'csv' ELSE 'parquet' END"


def _monthly(spark, sf) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        "o_orderkey", F.expr(_DATASET_SQL).alias("dataset"), F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("m"), F.expr(_FMT_SQL).alias("fmt"))


@register("s_month_path", f"""
SELECT o_orderkey, '{_BASE}/' || ds || '/' || ds || '_tripdata_' || CAST(y AS VARCHAR) || '-' ||
  lpad(CAST(m AS VARCHAR), 2, '0') || '.' || CASE fmt WHEN 'parquet' THEN 'parquet' ELSE 'csv.gz' END AS path
FROM (SELECT o_orderkey, {_DATASET_SQL} AS ds, year(o_orderdate) AS y, month(o_orderdate) AS m,
             {_FMT_SQL} AS fmt FROM orders)""")
def s_month_path(spark, sf):
    d = _monthly(spark, sf)
    return d.select("o_orderkey", month_path_col(_BASE, F.col("dataset"), F.col("y"), F.col("m"),
                                                 F.col("fmt")).alias("path"))


_MONTH_TABLE_SQL = (f"{_DATASET_SQL} || '_tripdata_' || CAST(year(o_orderdate) AS VARCHAR) || '_' || "
                    "lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')")


@register("s_month_table", f"SELECT o_orderkey, {_MONTH_TABLE_SQL} AS table_name FROM orders")
def s_month_table(spark, sf):
    d = _monthly(spark, sf)
    return d.select("o_orderkey", month_table_col(F.col("dataset"), F.col("y"), F.col("m")).alias("table_name"))


_URL_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?[^?#]*?([^/?#]*)/*(?:[?#].*)?$"


@register("s_table_name", f"""
SELECT page_id, replace(regexp_replace(regexp_extract(url, '{_URL_RE}', 1),
  '[.](csv|tsv|parquet)([.]gz)?$', '', 'i'), '-', '_') AS table_name FROM pages""")
def s_table_name(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    return pages.select("page_id", table_name_from_url_col("url").alias("table_name"))


# ------------------------------------------------------------ identifiers --
def _re2_class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


_WS = _re2_class(WHITESPACE_CHARS)
_C_IDENT_SQL = (
    "nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    f"'^[{_WS}]+|[{_WS}]+$', '', 'g'), '[{_WS}\\-.:/]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')), '')")


@register("c_ident", f"SELECT doc_id, {_C_IDENT_SQL} AS ident FROM documents")
def c_ident(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", normalize_ident_col("text").alias("ident"))


@register("c_ident_ok", f"""
SELECT doc_id, ident, regexp_full_match(ident, '[A-Za-z_][A-Za-z0-9_]*') AS ok
FROM (SELECT doc_id, {_C_IDENT_SQL} AS ident FROM documents)""")
def c_ident_ok(spark, sf):
    d = c_ident(spark, sf)
    return d.select("doc_id", "ident", is_safe_ident_col("ident").alias("ok"))


# ----------------------------------------------------------------- schema --
_SCHEMA_ROWS_SQL = """
SELECT CAST(ordinal_position AS INTEGER) AS ordinal, column_name,
  CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'string' ELSE lower(data_type) END AS data_type
FROM information_schema.columns WHERE table_name = '{t}'"""


@register("c_parquet", _SCHEMA_ROWS_SQL.format(t="embeddings"))
def c_parquet(spark, sf):
    return schema_rows(spark, parquet_target_schema(read_table(spark, sf, "embeddings").schema))


@register("c_infer", """
SELECT * FROM (VALUES (1, 'trip_id', 'bigint'), (2, 'lpep_pickup_datetime', 'timestamp_ntz'),
  (3, 'lpep_dropoff_datetime', 'timestamp_ntz'), (4, 'trip_distance', 'double'),
  (5, 'total_amount', 'double'), (6, 'store_and_fwd_flag', 'string')) t(ordinal, column_name, data_type)""")
def c_infer(spark, sf):
    path = fx.write_text(spark, fx.green_trips(spark, sf), "green_csv")
    groups = read_delimited(spark, [path], "csv")
    return schema_rows(spark, infer_text_schema(groups[0][1]))


@register("c_infer_wide", """
SELECT CAST(9223372036854775807 - o_orderkey AS BIGINT) AS id,
  '1' || lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS wide FROM orders""")
def c_infer_wide(spark, sf):
    """Identifiers of 19 and 20 digits keep every digit through the inferred types."""
    ids = fx.orders(spark, sf).selectExpr("9223372036854775807L - o_orderkey AS id",
                                          "'1' || lpad(CAST(o_orderkey AS STRING), 19, '0') AS wide")
    df, target, _ = read_conformed(spark, [fx.write_text(spark, ids, "wide_csv")], FileFormat.CSV, observe=False)
    assert [f.dataType.simpleString() for f in target.fields] == ["bigint", "decimal(38,0)"], target
    return df.select("id", F.col("wide").cast("string").alias("wide"))


@register("c_exists", f"""
SELECT DISTINCT {_MONTH_TABLE_SQL} AS table_name,
  {_MONTH_TABLE_SQL} = 'green_tripdata_1997_03' AS table_exists FROM orders""")
def c_exists(spark, sf):
    """Which monthly tables named by the data exist (C6; the published one is a view)."""
    import uuid as _uuid
    from tidemark.session import scratch_root
    db = f"tidemark_exists_{_uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch_root(spark)}/warehouse/{db}.db'")
    early, _ = fx.split_early(fx.orders(spark, sf))
    ingest(spark, fx.write_parquet(spark, early, "orders_early"), "green_tripdata_1997_03", database=db)
    listed = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables(db)] or [("",)],
                                   "table_name string").distinct()
    names = s_month_table(spark, sf).select("table_name").distinct()
    # bound: the listing of a database this call created (one view, one part)
    return (names.join(F.broadcast(listed.withColumn("table_exists", F.lit(True))), "table_name", "left")
                 .select("table_name", F.coalesce("table_exists", F.lit(False)).alias("table_exists")))


@register("c_columns", _SCHEMA_ROWS_SQL.format(t="orders"))
def c_columns(spark, sf):
    db = scratch_database(spark)
    t = _name("c_columns")
    ingest(spark, fx.write_parquet(spark, fx.orders(spark, sf), "orders_parquet"), t, database=db)
    return table_columns(spark, f"{db}.{t}")


@register("c_final", _SCHEMA_ROWS_SQL.format(t="orders"))
def c_final(spark, sf):
    """Once published, a text load takes the table's types, not inferred ones."""
    db = scratch_database(spark)
    t = _name("c_final")
    o = fx.orders(spark, sf)
    early, late = fx.split_early(o)
    ingest(spark, fx.write_parquet(spark, early, "orders_early"), t, database=db)
    ingest(spark, fx.write_text(spark, late, "orders_late_csv"), t, database=db, if_exists="append")
    return table_columns(spark, f"{db}.{t}")


@register("c_like", _SCHEMA_ROWS_SQL.format(t="orders"))
def c_like(spark, sf):
    """A staged table has exactly the published table's columns and types."""
    db = scratch_database(spark)
    t = _name("c_like")
    early, late = fx.split_early(fx.orders(spark, sf))
    ingest(spark, fx.write_parquet(spark, early, "orders_early"), t, database=db)
    m = ingest(spark, fx.write_text(spark, late, "orders_late_csv"), t, database=db, if_exists="append")
    return table_columns(spark, f"{db}.{m['parts'][-1]}")


# ---------------------------------------------------------------- conform --
@register("p_conform", fx.GREEN_TRIPS_SQL)
def p_conform(spark, sf):
    """Text file -> inferred schema -> conformed rows, end to end."""
    path = fx.write_text(spark, fx.green_trips(spark, sf), "green_csv")
    df, _, _ = read_conformed(spark, [path], FileFormat.CSV, None, observe=False)
    return df


@register("p_header", "SELECT * FROM orders")
def p_header(spark, sf):
    """Header names padded with spaces are trimmed before matching."""
    o = fx.orders(spark, sf)
    path = fx.write_text(spark, o, "orders_padded_csv", header_names=[f"  {c} " for c in o.columns])
    return _read_back(spark, path, "csv", parquet_target_schema(o.schema))


@register("p_project", "SELECT o_totalprice, o_orderkey FROM orders")
def p_project(spark, sf):
    """Extra source columns are dropped and the rest put in the target order."""
    target = T.StructType([T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderkey", T.LongType())])
    return conform_typed(fx.orders(spark, sf), target)


@register("p_missing", """
SELECT 'MissingColumnsError' AS outcome, 'o_comment' AS missing, count(*) AS source_rows FROM orders""")
def p_missing(spark, sf):
    """A target column absent from the source fails the load, naming it."""
    o = fx.orders(spark, sf)
    target = T.StructType(parquet_target_schema(o.schema).fields + [T.StructField("o_comment", T.StringType())])
    path = fx.write_text(spark, o, "orders_csv")
    try:
        read_conformed(spark, [path], FileFormat.CSV, target, observe=False)
        outcome, missing = "loaded", ""
    except MissingColumnsError as e:
        outcome, missing = type(e).__name__, str(e).split("[")[-1].strip("]'\" ")
    return (spark.read.csv(path, header=True).agg(F.count(F.lit(1)).alias("source_rows"))
            .select(F.lit(outcome).alias("outcome"), F.lit(missing).alias("missing"), "source_rows"))


# JSON text of a float the way the JVM prints it: shortest digits, plain for
# 1e-3 <= |x| < 1e7, else d.dddE<exp>. DuckDB gives the same shortest digits.
_S = "CAST(x AS VARCHAR)"
_JVM_FLOAT = f"""CASE
  WHEN x = 0 OR (abs(x) >= 0.001 AND abs(x) < 1e7 AND {_S} NOT LIKE '%e%') THEN {_S}
  WHEN {_S} LIKE '%e%' THEN
    regexp_extract({_S}, '^(-?[0-9]+)', 1) || '.' ||
    coalesce(nullif(regexp_extract({_S}, '^-?[0-9]+[.]([0-9]+)e', 1), ''), '0') ||
    'E' || CAST(CAST(regexp_extract({_S}, 'e([-+]?[0-9]+)$', 1) AS INTEGER) AS VARCHAR)
  ELSE
    CASE WHEN x < 0 THEN '-' ELSE '' END ||
    substr(regexp_extract({_S}, '0[.]0*([0-9]+)$', 1), 1, 1) || '.' ||
    coalesce(nullif(substr(regexp_extract({_S}, '0[.]0*([0-9]+)$', 1), 2), ''), '0') ||
    'E-' || CAST(length(regexp_extract({_S}, '0[.](0*)[0-9]+$', 1)) + 1 AS VARCHAR)
END"""


@register("p_nested", f"""
SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: {_JVM_FLOAT}), ',') || ']' AS embedding,
  label FROM embeddings""")
def p_nested(spark, sf):
    """Nested Parquet values are conformed to JSON text."""
    e = read_table(spark, sf, "embeddings")
    return conform_typed(e, parquet_target_schema(e.schema))


# ------------------------------------------------------------- validation --
@register("v_rowcount", "SELECT CAST(count(*) AS BIGINT) AS rowcount FROM orders")
def v_rowcount(spark, sf):
    return validation_metrics(fx.orders(spark, sf)).select("rowcount")


@register("v_dtcol", "SELECT 'lpep_pickup_datetime' AS datetime_col, count(*) AS rowcount FROM orders")
def v_dtcol(spark, sf):
    g = fx.green_trips(spark, sf)
    return validation_metrics(g, detect_datetime_column(g.columns)).select("datetime_col", "rowcount")


@register("v_profile", """
SELECT count(*) AS rowcount, 'tpep_pickup_datetime' AS datetime_col, min(o_orderdate) AS min_dt,
  max(o_orderdate) AS max_dt, count(*) FILTER (WHERE o_orderdate IS NULL) AS null_dt FROM orders""")
def v_profile(spark, sf):
    y = fx.orders(spark, sf).withColumnRenamed("o_orderdate", "tpep_pickup_datetime")
    return validation_metrics(y, detect_datetime_column(y.columns))


_SPILL_DT = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END"


@register("v_month_spill", f"""
SELECT rowcount, 'lpep_pickup_datetime' AS datetime_col, min_dt, max_dt, null_dt, outside_month,
  inside_month, '1997_03' AS expected_month, CAST(outside_month AS DOUBLE) / rowcount AS outside_ratio,
  (outside_month > 200 OR CAST(outside_month AS DOUBLE) / rowcount > 0.005) AS exceeds
FROM (SELECT count(*) AS rowcount, min(dt) AS min_dt, max(dt) AS max_dt,
        count(*) FILTER (WHERE dt IS NULL) AS null_dt,
        count(*) FILTER (WHERE dt < TIMESTAMP '1997-03-01' OR dt >= TIMESTAMP '1997-04-01') AS outside_month,
        count(*) FILTER (WHERE dt >= TIMESTAMP '1997-03-01' AND dt < TIMESTAMP '1997-04-01') AS inside_month
      FROM (SELECT {_SPILL_DT} AS dt FROM orders))""")
def v_month_spill(spark, sf):
    df = fx.orders(spark, sf).select(F.expr(_SPILL_DT).alias("lpep_pickup_datetime"))
    return validation_metrics(df, "lpep_pickup_datetime", "1997_03")


@register("v_month_events", """
SELECT count(*) AS rowcount, 'pickup_datetime' AS datetime_col, min(ts) AS min_dt, max(ts) AS max_dt,
  count(*) FILTER (WHERE ts IS NULL) AS null_dt,
  count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01' OR ts >= TIMESTAMP '2024-02-01') AS outside_month,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01') AS inside_month,
  '2024_01' AS expected_month,
  CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01' OR ts >= TIMESTAMP '2024-02-01') AS DOUBLE) / count(*) AS outside_ratio,
  (count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01' OR ts >= TIMESTAMP '2024-02-01') > 200 OR
   CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01' OR ts >= TIMESTAMP '2024-02-01') AS DOUBLE) / count(*) > 0.005) AS exceeds
FROM events""")
def v_month_events(spark, sf):
    """A table whose rows all fall in its month: the event stream as ``fhv_tripdata_2024_01``."""
    ev = read_table(spark, sf, "events").select(F.col("ts").alias("pickup_datetime"), "event_type", "value")
    return validation_metrics(ev, detect_datetime_column(ev.columns), expected_month("fhv_tripdata_2024_01"))


@register("v_month", f"""
SELECT o_orderkey, table_name, nullif(regexp_extract(table_name, '([0-9]{{4}})_([0-9]{{2}})', 0), '') AS expected_month
FROM (SELECT o_orderkey, {_MONTH_TABLE_SQL} AS table_name FROM orders)""")
def v_month(spark, sf):
    t = s_month_table(spark, sf)
    return t.select("o_orderkey", "table_name", expected_month_col("table_name").alias("expected_month"))


@register("v_window", f"""
SELECT o_orderkey, m AS expected_month, strptime(m, '%Y_%m') AS window_start,
  strptime(m, '%Y_%m') + INTERVAL 1 MONTH AS window_end
FROM (SELECT o_orderkey, nullif(regexp_extract({_MONTH_TABLE_SQL}, '([0-9]{{4}})_([0-9]{{2}})', 0), '') AS m FROM orders)""")
def v_window(spark, sf):
    m = v_month(spark, sf)
    return m.select("o_orderkey", "expected_month",
                    month_start_col(F.col("expected_month")).alias("window_start"),
                    month_end_col(F.col("expected_month")).alias("window_end"))


@register("v_verdict", """
SELECT month, cnt AS inside_month, n - nulls - cnt AS outside_month,
  CAST(n - nulls - cnt AS DOUBLE) / n AS outside_ratio,
  (n - nulls - cnt > 200 OR CAST(n - nulls - cnt AS DOUBLE) / n > 0.005) AS exceeds
FROM (SELECT month, cnt, CAST(sum(cnt) OVER () AS BIGINT) AS n,
             CAST(coalesce(sum(CASE WHEN month IS NULL THEN cnt END) OVER (), 0) AS BIGINT) AS nulls
      FROM (SELECT strftime(o_orderdate, '%Y_%m') AS month, count(*) AS cnt FROM orders GROUP BY 1))
WHERE month IS NOT NULL""")
def v_verdict(spark, sf):
    """Spill-over verdict of the whole table against each month it touches.

    One grouped aggregate (partial per task; NULL dates form their own group),
    then totals as window sums over the per-month rows: one row per calendar
    month, so the window's single partition stays small. No join.
    """
    from pyspark.sql import Window

    o = fx.orders(spark, sf).select("o_orderdate")
    per_month = (o.groupBy(F.date_format("o_orderdate", "yyyy_MM").alias("month"))
                  .agg(F.count(F.lit(1)).alias("cnt")))
    every = Window.partitionBy()
    n = F.sum("cnt").over(every)
    nulls = F.coalesce(F.sum(F.when(F.col("month").isNull(), F.col("cnt"))).over(every), F.lit(0))
    j = per_month.select("month", F.col("cnt").alias("inside_month"), n.alias("n"), nulls.alias("nulls"))
    outside = F.col("n") - F.col("nulls") - F.col("inside_month")
    return (j.filter(F.col("month").isNotNull())
             .select("month", "inside_month", outside.alias("outside_month"),
                     (outside.cast("double") / F.col("n")).alias("outside_ratio"),
                     exceeds_expr(outside, F.col("n")).alias("exceeds")))


# ---------------------------------------------------------------- publish --
def _orders_files(spark, sf, kind: str = "parquet"):
    early, late = fx.split_early(fx.orders(spark, sf))
    if kind == "parquet":
        return (fx.write_parquet(spark, early, "orders_early"), fx.write_parquet(spark, late, "orders_late"))
    return (fx.write_text(spark, early, "orders_early_csv"), fx.write_text(spark, late, "orders_late_csv"))


@register("w_stage", "SELECT * FROM orders")
def w_stage(spark, sf):
    db = scratch_database(spark)
    o = fx.orders(spark, sf)
    staged = pub.stage(conform_typed(o, parquet_target_schema(o.schema)), db, _name("w_stage"))
    return spark.table(f"{db}.{staged}")


@register("w_append", "SELECT * FROM orders")
def w_append(spark, sf):
    """Parquet month first (types from its footer), then a CSV month appended to it."""
    db, t = scratch_database(spark), _name("w_append")
    a, _ = _orders_files(spark, sf, "parquet")
    _, b = _orders_files(spark, sf, "csv")
    ingest(spark, a, t, database=db)
    ingest(spark, b, t, database=db, if_exists="append")
    return spark.table(f"{db}.{t}")


@register("w_replace", "SELECT * FROM orders WHERE NOT coalesce(o_orderdate < TIMESTAMP '1998-01-01', false)")
def w_replace(spark, sf):
    db, t = scratch_database(spark), _name("w_replace")
    a, b = _orders_files(spark, sf)
    ingest(spark, a, t, database=db, fmt="parquet")
    ingest(spark, b, t, database=db, fmt="parquet", if_exists="replace")
    return spark.table(f"{db}.{t}")


@register("w_policy", "SELECT * FROM orders")
def w_policy(spark, sf):
    """replace, then skip and fail (both leave it), then append: the whole table."""
    db, t = scratch_database(spark), _name("w_policy")
    a, b = _orders_files(spark, sf)
    ingest(spark, a, t, database=db, fmt="parquet", if_exists="fail")
    assert ingest(spark, b, t, database=db, fmt="parquet", if_exists="skip")["status"] == "skipped"
    try:
        ingest(spark, b, t, database=db, fmt="parquet", if_exists="fail")
        raise AssertionError("if_exists='fail' loaded into an existing table")
    except TableExistsError:
        pass
    ingest(spark, b, t, database=db, fmt="parquet", if_exists="append")
    return spark.table(f"{db}.{t}")


@register("w_cleanup", "SELECT * FROM orders")
def w_cleanup(spark, sf):
    """A failure at any stage before the flip leaves the published table as it was."""
    db, t = scratch_database(spark), _name("w_cleanup")
    full = fx.write_parquet(spark, fx.orders(spark, sf), "orders_parquet")
    a, _ = _orders_files(spark, sf)
    ingest(spark, full, t, database=db)
    for stage_name in ("read", "stage", "validate"):
        try:
            ingest(spark, a, t, database=db, if_exists="replace", fail_after=stage_name)
        except Exception as e:  # noqa: BLE001
            assert "injected" in str(e), e
    left = [r.tableName for r in spark.sql(f"SHOW TABLES IN {db} LIKE '{t}__r_*'").collect()]
    assert len(left) == 1, left
    return spark.table(f"{db}.{t}")


_ANALYZED = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@register("w_analyze", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS VARCHAR) AS num_nulls FROM orders"
    if c != "o_orderdate" else
    f"SELECT '{c}', strftime(min({c}), '%Y-%m-%d %H:%M:%S.%f'), strftime(max({c}), '%Y-%m-%d %H:%M:%S.%f'), "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS VARCHAR) FROM orders" for c in _ANALYZED))
def w_analyze(spark, sf):
    """Column statistics of the published physical table, as the optimizer sees them."""
    db, t = scratch_database(spark), _name("w_analyze")
    m = ingest(spark, fx.write_parquet(spark, fx.orders(spark, sf), "orders_parquet"), t,
               database=db, analyze_columns=True)
    phys = f"{db}.{m['parts'][-1]}"
    rows = []
    for c in _ANALYZED:
        info = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {phys} {c}").collect()}
        rows.append((c, info["min"], info["max"], info["num_nulls"]))
    return spark.createDataFrame(rows, "column_name string, min string, max string, num_nulls string")


@register("w_ingest", fx.GREEN_TRIPS_SQL)
def w_ingest(spark, sf):
    """Whole pipeline from a gzip CSV trip file into a monthly table (A1 layout)."""
    db = scratch_database(spark)
    base = fx.scratch_path(spark, "landing")
    g = fx.green_trips(spark, sf)
    path = f"{base}/green/green_tripdata_1997-03.csv.gz"
    fx.as_text(g).write.option("header", "true").option("compression", "gzip").csv(path)
    m = ingest_month(spark, "green", 1997, 3, base=base, fmt="csv", database=db)
    return spark.table(m["table"])


@register("w_buckets", """
SELECT o_orderkey, o_custkey, count(*) AS lines, sum(CAST(l_quantity AS DOUBLE)) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-06-01' GROUP BY o_orderkey, o_custkey""")
def w_buckets(spark, sf):
    """Orders and line items published in buckets of the order key, the latter by two
    loads: months of orders join all line items where they are stored."""
    db = scratch_database(spark)
    o, li = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    orders = ingest(spark, fx.write_parquet(spark, o, "orders_b"), _name("orders_b"), database=db, bucket_by=("o_orderkey", 8))["table"]
    t = _name("lines_b")
    for half in (0, 1):
        path = fx.write_parquet(spark, li.where(F.pmod("l_linenumber", F.lit(2)) == half), "lines_b")
        lines = ingest(spark, path, t, database=db, bucket_by=("l_orderkey", 8), if_exists="append")["table"]
    months = spark.table(orders).where("o_orderdate >= TIMESTAMP_NTZ '1997-03-01' AND o_orderdate < TIMESTAMP_NTZ '1997-06-01'")
    return (months.join(spark.table(lines), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_custkey")
            .agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("double")).alias("quantity")))


# -------------------------------------------------------------- streaming --
@register("st_landing", "SELECT * FROM orders")
def st_landing(spark, sf):
    """Two text files land in a folder; the stream appends each once: the whole table."""
    from tidemark.session import scratch_path
    from tidemark.streaming import landing_stream

    db, t = scratch_database(spark), _name("st_landing")
    o = fx.orders(spark, sf)
    early, late = fx.split_early(o)
    landing = scratch_path(spark, "landing")
    # the first month defines the table (types from Parquet), later months stream in as text
    first = fx.write_parquet(spark, early, "orders_early")
    ingest(spark, first, t, database=db)
    fx.as_text(late).write.option("header", "true").csv(landing + "/m1")
    q = landing_stream(spark, landing + "/*", t, fmt="csv", database=db)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.table(f"{db}.{t}")


@register("st_landing_batches", "SELECT * FROM orders")
def st_landing_batches(spark, sf):
    """All of the table as several text files, taken one a trigger."""
    from tidemark.session import scratch_path
    from tidemark.streaming import landing_stream

    db, t = scratch_database(spark), _name("st_batches")
    o = fx.orders(spark, sf)
    landing = scratch_path(spark, "landing")
    fx.as_text(o).repartition(3, "o_orderkey").write.option("header", "true").csv(landing)
    q = landing_stream(spark, landing, t, fmt="csv", database=db, target=parquet_target_schema(o.schema),
                       max_files_per_trigger=1)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.table(f"{db}.{t}")


def _landed(spark, landing: str, t: str, **kwargs):
    """One run of the stream to its end; the error that stopped it, if any."""
    from tidemark.streaming import landing_stream

    q = landing_stream(spark, landing, t, database=scratch_database(spark), **kwargs)
    try:
        q.awaitTermination()
    except StreamingQueryException as e:
        return e
    return q.exception()


@register("st_parquet_drift", """
SELECT o_orderkey, CAST(CASE WHEN coalesce(o_orderdate < TIMESTAMP '1998-01-01', false) THEN o_custkey ELSE o_custkey + 0.5 END AS DOUBLE) AS o_custkey,
  o_totalprice FROM orders""")
def st_parquet_drift(spark, sf):
    """Landed Parquet whose files hold the key as bigint and as fractions, and the
    columns in another order: merged at the start, then conformed file by file."""
    from tidemark.session import scratch_path

    landing, t = scratch_path(spark, "landing"), _name("st_drift")
    early, late = fx.split_early(fx.orders(spark, sf))
    early.select("o_orderkey", "o_custkey", "o_totalprice").write.parquet(landing)
    late.select("o_totalprice", (F.col("o_custkey") + F.lit(0.5)).alias("o_custkey"), "o_orderkey").write.mode("append").parquet(landing)
    e = _landed(spark, landing, t, fmt="parquet", max_files_per_trigger=1)
    if e:
        raise e
    return spark.table(f"{scratch_database(spark)}.{t}")


@register("st_parquet_missing", "SELECT * FROM orders WHERE coalesce(o_orderdate < TIMESTAMP '1998-01-01', false)")
def st_parquet_missing(spark, sf):
    """A file that lands without a required column fails its batch: the table keeps
    the rows of the files before it."""
    from tidemark.session import scratch_path

    landing, t = scratch_path(spark, "landing"), _name("st_missing")
    early, late = fx.split_early(fx.orders(spark, sf))
    early.write.parquet(landing)
    e = _landed(spark, landing, t, fmt="parquet")
    if e:
        raise e
    late.drop("o_custkey").withColumn("o_totalprice", F.col("o_totalprice") + 0.5).write.mode("append").parquet(landing)
    if "missing columns" not in str(_landed(spark, landing, t, fmt="parquet")):
        raise AssertionError("a file without a required column was accepted")
    return spark.table(f"{scratch_database(spark)}.{t}")


@register("v_month_stream", """
SELECT count(*) AS rowcount, count(*) FILTER (WHERE d >= TIMESTAMP '1997-03-01' AND d < TIMESTAMP '1997-04-01') AS inside_month,
  count(*) FILTER (WHERE d < TIMESTAMP '1997-03-01' OR d >= TIMESTAMP '1997-04-01') AS outside_month,
  count(*) FILTER (WHERE d IS NULL) AS null_dt, min(d) AS min_dt, max(d) AS max_dt,
  count(*) FILTER (WHERE d < TIMESTAMP '1997-03-01' OR d >= TIMESTAMP '1997-04-01') > 200 OR
  count(*) FILTER (WHERE d < TIMESTAMP '1997-03-01' OR d >= TIMESTAMP '1997-04-01') / count(*) > 0.005 AS exceeds,
  count(*) FILTER (WHERE o_orderkey % 10 = 0) AS datetime_nulls
FROM (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS d, o_orderkey FROM orders)""")
def v_month_stream(spark, sf):
    """The verdict of a month's stream over all of its batches, a file each and in
    two runs; a tenth of the datetimes is no datetime."""
    from tidemark.session import scratch_path
    from tidemark.streaming import stream_report

    landing, t, db = scratch_path(spark, "landing"), _name("green") + "_tripdata_1997_03", scratch_database(spark)
    texts = fx.as_text(fx.green_trips(spark, sf)).withColumn(
        "lpep_pickup_datetime", F.when(F.col("trip_id").cast("bigint") % 10 == 0, F.lit("soon")).otherwise(F.col("lpep_pickup_datetime")))
    target = T.StructType([T.StructField("trip_id", T.LongType()), T.StructField("lpep_pickup_datetime", T.TimestampNTZType()),
                           T.StructField("lpep_dropoff_datetime", T.TimestampNTZType())])
    for half in (0, 1):
        texts.where(F.col("trip_id").cast("bigint") % 2 == half).repartition(2, "trip_id").write.option("header", "true").mode("append").csv(landing)
        e = _landed(spark, landing, t, fmt="csv", target=target, max_files_per_trigger=1)
        if e:
            raise e
    r = stream_report(spark, t, db)["totals"]
    row = (r["rowcount"], r["inside_month"], r["outside_month"], r["null_dt"], r["min_dt"], r["max_dt"], r["exceeds"],
           r["datetime_nulls"].get("lpep_pickup_datetime", 0))
    return (spark.createDataFrame([row], "rowcount bigint, inside_month bigint, outside_month bigint, null_dt bigint, min_dt string, "
                                         "max_dt string, exceeds boolean, datetime_nulls bigint")
            .withColumn("min_dt", F.col("min_dt").cast("timestamp_ntz")).withColumn("max_dt", F.col("max_dt").cast("timestamp_ntz")))


# ------------------------------------------------- queries over a load --
def _published(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The source's flow: trips and zones loaded from files into published tables."""
    db = scratch_database(spark)
    trips = ingest(spark, fx.write_parquet(spark, trips_from_tables(spark, sf), "green_trips"),
                   _name("green_tripdata"), database=db)
    zones = ingest(spark, fx.write_text(spark, zones_from_nation(spark, sf), "zones"), _name("taxi_zone_lookup"),
                   database=db)
    return pub.read_published(spark, *trips["table"].split(".")), spark.table(zones["table"])


@register("q_zone_revenue_published", ORACLE_SQL["q_zone_revenue"])
def q_zone_revenue_published(spark, sf):
    return Q.zone_revenue(*_published(spark, sf))


@register("q_short_trips_published", ORACLE_SQL["q_short_trips"])
def q_short_trips_published(spark, sf):
    return Q.short_trips(_published(spark, sf)[0])


@register("q_longest_days_published", ORACLE_SQL["q_longest_days"])
def q_longest_days_published(spark, sf):
    return Q.longest_days(_published(spark, sf)[0])


@register("q_tip_dropoff_published", ORACLE_SQL["q_tip_dropoff"])
def q_tip_dropoff_published(spark, sf):
    return Q.tip_dropoff(*_published(spark, sf))
