"""The trip fact and zone dimension, derived from the star-schema tables.

A trip is one line item: pickup = order date, dropoff = ship date,
distance = (quantity - 1) * 3, pickup zone = customer nation, drop-off zone
= supplier nation, total = extended price, tip = order total. Only the
columns a query touches are read, and filters on pickup time or distance are
pushed below the joins into the ``orders`` / ``lineitem`` scans by Catalyst.

With ``with_identity``, ``trip_file`` / ``trip_row`` (a 64-bit hash of the line
item's file and its row position) identify a trip; ordered full results use them as a
deterministic tie-breaker. Other queries leave them out of the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The star-schema columns the trip view and zone dimension use.
# Declaring them skips the footer-inference job a schema-less read runs; the
# Parquet reader still matches columns by name and rejects a wrong type.
STAR_COLUMNS = {
    "lineitem": "l_orderkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
                "l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ, o_totalprice DOUBLE",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "nation": "n_nationkey INT, n_name STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: str | None = None) -> DataFrame:
    """One of the given tables; ``columns`` (DDL) reads just those, without inference."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.read.schema(columns).parquet(path) if columns else spark.read.parquet(path)


def _star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, STAR_COLUMNS[name])


# Largest set of orders broadcast into the order/line-item join once proven
# (about 64 MB of hash table); a bigger set is joined by shuffle.
ORDERS_BROADCAST_ROWS = 2_000_000


def trips_from_tables(spark: SparkSession, sf_dir: str, with_identity: bool = False,
                      pickup_day: str | None = None) -> DataFrame:
    """The trip view; ``pickup_day`` keeps only that day's orders.

    With a day, that day's orders are broadcast into the join with line
    items once a bounded count proves they are few (``ORDERS_BROADCAST_ROWS``):
    line items are then joined where they are read, with no shuffle of the
    largest table. Without a proof (or without a day) the planner decides.
    """
    ident = ([F.xxhash64("_metadata.file_path").alias("trip_file"), F.col("_metadata.row_index").alias("trip_row")]
             if with_identity else [])
    li = _star(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", *ident)
    o = _star(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    if pickup_day is not None:
        day = F.lit(pickup_day).cast("date")
        o = o.filter((F.col("o_orderdate") >= day.cast("timestamp_ntz"))
                     & (F.col("o_orderdate") < F.date_add(day, 1).cast("timestamp_ntz")))
        from tidemark.plans.queries import dimension_join_side  # noqa: PLC0415 (cycle)
        o = dimension_join_side(o, ORDERS_BROADCAST_ROWS)
    c = _star(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = _star(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # orders first: date filters land on the smaller side of the biggest join
    return (o.join(li, o.o_orderkey == li.l_orderkey)
             .join(c, o.o_custkey == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey)
             .select(F.col("o_orderdate").alias("lpep_pickup_datetime"),
                     F.col("l_shipdate").alias("lpep_dropoff_datetime"),
                     ((F.col("l_quantity") - 1) * 3).alias("trip_distance"),
                     F.col("c_nationkey").alias("PULocationID"),
                     F.col("s_nationkey").alias("DOLocationID"),
                     F.col("l_extendedprice").alias("total_amount"),
                     F.col("o_totalprice").alias("tip_amount"),
                     *(["trip_file", "trip_row"] if with_identity else [])))


def zones_from_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("LocationID"), F.col("n_name").alias("Zone"))
