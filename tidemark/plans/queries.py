"""The analytic queries (Q1-Q6) over a trip fact and a zone dimension.

Each takes DataFrames, so it runs unchanged over a published monthly table
or over the derived trip view. Ordering follows the original statements
(``DESC`` puts NULLs first, as the source database does); the top-1 variants
put NULLs last and break ties by name so the answer is deterministic.

Full ordered results use extra tie-breakers after the stated keys: ties are
unordered in the statement anyway, and a unique tail keeps a hot sort key
(one value holding a large share of rows) from landing in one range
partition of the global sort. The tail is the trip's row identity
(``trip_file``, ``trip_row``) when the fact carries it: deterministic, so a
sort stage re-run after a lost executor routes every row as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parameters of the original statements, re-aimed at the
# test tables (month, day and pickup zone).
MONTH_START = "1997-03-01 00:00:00"
MONTH_END = "1997-04-01 00:00:00"
REVENUE_DAY = "1997-03-18"
PICKUP_ZONE = "NATION_3"
SHORT_TRIP_MAX = 1
LONG_TRIP_LIMIT = 100
# Largest dimension broadcast without question; a bigger one is shuffled.
DIMENSION_BROADCAST_ROWS = 1_000_000


def _in_range(ts: Column, start: str, end: str) -> Column:
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def is_bounded(dim: DataFrame, max_rows: int = DIMENSION_BROADCAST_ROWS) -> bool:
    """Proof that ``dim`` has at most ``max_rows`` rows: a plain count, one row per task."""
    return dim.count() <= max_rows


def dimension_join_side(dim: DataFrame, max_rows: int = DIMENSION_BROADCAST_ROWS,
                        bounded: bool | None = None) -> DataFrame:
    """Broadcast-hint a dimension only after proving it has at most ``max_rows`` rows.

    ``bounded`` passes a proof already made for the table ``dim`` is derived
    from (a filter or projection of a bounded table is bounded). Beyond the
    bound the join is left to the planner (sort-merge, or AQE's runtime
    broadcast if the side turns out small after filters).
    """
    ok = is_bounded(dim, max_rows) if bounded is None else bounded
    return F.broadcast(dim) if ok else dim


def short_trips(trips: DataFrame, start: str = MONTH_START, end: str = MONTH_END,
                max_distance: float = SHORT_TRIP_MAX) -> DataFrame:
    """Q1: count of trips in [start, end) with distance <= max_distance."""
    return (trips.filter(_in_range(F.col("lpep_pickup_datetime"), start, end)
                         & (F.col("trip_distance") <= max_distance))
                 .agg(F.count(F.lit(1)).alias("short_trip_count")))


ROW_IDENTITY = ("trip_file", "trip_row")


def _identity(df: DataFrame) -> list[str]:
    return [c for c in ROW_IDENTITY if c in df.columns]


def _valid_long(trips: DataFrame, start: str, end: str, limit: float) -> DataFrame:
    return (trips.filter((F.col("trip_distance") < limit)
                         & _in_range(F.col("lpep_pickup_datetime"), start, end))
                 .select(F.to_date("lpep_pickup_datetime").alias("pickup_day"), "trip_distance",
                         "lpep_pickup_datetime", *_identity(trips)))


def longest_days(trips: DataFrame, start: str = MONTH_START, end: str = MONTH_END,
                 limit: float = LONG_TRIP_LIMIT) -> DataFrame:
    """Q2: pickup day of every trip under ``limit``, longest first."""
    v = _valid_long(trips, start, end, limit)
    return (v.orderBy(F.col("trip_distance").desc_nulls_first(), "lpep_pickup_datetime", *_identity(v))
             .select("pickup_day"))


def longest_day_top1(trips: DataFrame, start: str = MONTH_START, end: str = MONTH_END,
                     limit: float = LONG_TRIP_LIMIT) -> DataFrame:
    """Q2 as asked: the one day with the longest trip (per-task top-1, then merge)."""
    return (_valid_long(trips, start, end, limit)
            .orderBy(F.col("trip_distance").desc_nulls_last(), "pickup_day").limit(1)
            .select("pickup_day"))


def _zone_rev(trips: DataFrame, zones: DataFrame, day: str) -> DataFrame:
    per_zone = (trips.filter(F.to_date("lpep_pickup_datetime") == F.lit(day).cast("date"))
                     .groupBy("PULocationID")
                     .agg(F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("rev")))
    z = dimension_join_side(zones)
    return per_zone.join(z, per_zone.PULocationID == z.LocationID).select(
        F.col("Zone").alias("pickup_zone"), "rev")


def zone_revenue(trips: DataFrame, zones: DataFrame, day: str = REVENUE_DAY) -> DataFrame:
    """Q3: revenue per pickup zone on one day (aggregated before the dimension join)."""
    return (_zone_rev(trips, zones, day).orderBy(F.col("rev").desc_nulls_first(), "pickup_zone")
            .select("pickup_zone", F.col("rev").cast("double").alias("total_revenue")))


def zone_revenue_top1(trips: DataFrame, zones: DataFrame, day: str = REVENUE_DAY) -> DataFrame:
    return (_zone_rev(trips, zones, day).orderBy(F.col("rev").desc_nulls_last(), "pickup_zone").limit(1)
            .select("pickup_zone", F.col("rev").cast("double").alias("total_revenue")))


def _tips(trips: DataFrame, zones: DataFrame, zone: str, start: str, end: str) -> DataFrame:
    small = is_bounded(zones)               # one proof serves both roles of the dimension
    pu = dimension_join_side(zones.filter(F.col("Zone") == zone).select(F.col("LocationID").alias("pu_id")),
                             bounded=small)
    eh = (trips.filter(_in_range(F.col("lpep_pickup_datetime"), start, end))
               .join(pu, F.col("PULocationID") == F.col("pu_id"))
               .select("DOLocationID", "tip_amount", "lpep_pickup_datetime", *_identity(trips)))
    do = dimension_join_side(zones.select(F.col("LocationID").alias("do_id"), F.col("Zone").alias("dropoff_zone")),
                             bounded=small)
    return eh.join(do, eh.DOLocationID == do.do_id)


def tip_dropoff(trips: DataFrame, zones: DataFrame, zone: str = PICKUP_ZONE,
                start: str = MONTH_START, end: str = MONTH_END) -> DataFrame:
    """Q4: drop-off zone and tip of every trip picked up in ``zone``, largest tip first."""
    t = _tips(trips, zones, zone, start, end)
    return (t.orderBy(F.col("tip_amount").desc_nulls_first(), "dropoff_zone", "lpep_pickup_datetime",
                      *_identity(t))
             .select("dropoff_zone", "tip_amount"))


def tip_dropoff_top1(trips: DataFrame, zones: DataFrame, zone: str = PICKUP_ZONE,
                     start: str = MONTH_START, end: str = MONTH_END) -> DataFrame:
    return (_tips(trips, zones, zone, start, end)
            .orderBy(F.col("tip_amount").desc_nulls_last(), "dropoff_zone").limit(1)
            .select("dropoff_zone"))


def row_count(df: DataFrame) -> DataFrame:
    """Q5: ``count(*)`` as bigint (Parquet answers it from footers)."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("rows_n"))


def sample_rows(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Q6: ``n`` rows of some columns (the limit is the feature).

    The statement has no order, so any ``n`` rows answer it. Spark starts with
    the first partition and stops once it has them, so a table of one small
    file gives its first rows as stored and a large one is never scanned.
    """
    return df.select(*columns).limit(n)


def run_sql(spark, text: str, args: dict | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text with bound named parameters (``:name``) over temp views.

    Parameters are bound, never spliced into the text.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


SHORT_TRIPS_SQL = """
WITH month_trips AS (
  SELECT trip_distance FROM trips
  WHERE lpep_pickup_datetime >= CAST(:start AS TIMESTAMP_NTZ)
    AND lpep_pickup_datetime < CAST(:end AS TIMESTAMP_NTZ))
SELECT count(*) AS short_trip_count FROM month_trips WHERE trip_distance <= :max_distance
"""


def short_trips_sql(spark, trips: DataFrame, start: str = MONTH_START, end: str = MONTH_END,
                    max_distance: float = SHORT_TRIP_MAX) -> DataFrame:
    """Q1 as SQL text with a CTE and bound parameters; same plan as :func:`short_trips`."""
    return run_sql(spark, SHORT_TRIPS_SQL, {"start": start, "end": end, "max_distance": max_distance},
                   {"trips": trips})
