"""Source files derived from the given tables, for the load queries.

The load operators need files to read. These helpers write them from the
test tables into the shared scratch folder (``spark.checkpoint.dir``), so a
load query's work grows with the tables. Each call writes a fresh folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.trips import read_table
from tidemark.session import scratch_path

# Split point of the two "monthly" files used by append / replace queries.
SPLIT_AT = "1998-01-01 00:00:00"


def as_text(df: DataFrame) -> DataFrame:
    """Every column cast to its Spark text form (what a text export holds)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def write_text(spark: SparkSession, df: DataFrame, kind: str, sep: str = ",", gzip: bool = False,
               header_names: list[str] | None = None) -> str:
    """Write ``df`` as delimited text with a header; return the folder path."""
    suffix = (".tsv" if sep == "\t" else ".csv") + (".gz" if gzip else "")
    path = scratch_path(spark, "sources", kind, suffix=suffix)
    out = as_text(df)
    if header_names is not None:
        out = out.toDF(*header_names)
    w = out.write.option("header", "true").option("sep", sep)
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)
    return path


def write_parquet(spark: SparkSession, df: DataFrame, kind: str) -> str:
    path = scratch_path(spark, "sources", kind, suffix=".parquet")
    df.write.parquet(path)
    return path


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders")


def green_trips(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` shaped as a monthly trip file (pickup/dropoff pair included)."""
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_orderdate").alias("lpep_pickup_datetime"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("lpep_dropoff_datetime"),
        (F.col("o_totalprice") / 1000).alias("trip_distance"),
        F.col("o_totalprice").alias("total_amount"),
        F.col("o_orderstatus").alias("store_and_fwd_flag"))


GREEN_TRIPS_SQL = """SELECT o_orderkey AS trip_id, o_orderdate AS lpep_pickup_datetime,
  o_orderdate + INTERVAL 1 DAY AS lpep_dropoff_datetime, o_totalprice / 1000 AS trip_distance,
  o_totalprice AS total_amount, o_orderstatus AS store_and_fwd_flag FROM orders"""


def split_early(df: DataFrame, ts_col: str = "o_orderdate") -> tuple[DataFrame, DataFrame]:
    """The table as two files: rows before ``SPLIT_AT`` and the rest (NULLs go to the rest)."""
    cut = F.lit(SPLIT_AT).cast("timestamp_ntz")
    early = F.coalesce(F.col(ts_col) < cut, F.lit(False))
    return df.filter(early), df.filter(~early)
