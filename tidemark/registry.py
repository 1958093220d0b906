"""Registered queries (name -> callable(spark, sf_dir)) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import queries as Q
from tidemark.plans.trips import read_table, trips_from_tables, zones_from_nation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle.strip()
        return fn
    return deco


# ---------------------------------------------------------------- Q1-Q6 --
_TRIPS_CTE = """
WITH trips AS (
  SELECT o_orderdate AS lpep_pickup_datetime, l_shipdate AS lpep_dropoff_datetime,
         (l_quantity - 1) * 3 AS trip_distance, c_nationkey AS PULocationID,
         s_nationkey AS DOLocationID, l_extendedprice AS total_amount, o_totalprice AS tip_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
zones AS (SELECT n_nationkey AS LocationID, n_name AS Zone FROM nation)
"""
_RANGE = ("lpep_pickup_datetime >= TIMESTAMP '1997-03-01 00:00:00' "
          "AND lpep_pickup_datetime < TIMESTAMP '1997-04-01 00:00:00'")


def _tz(spark, sf):
    return trips_from_tables(spark, sf), zones_from_nation(spark, sf)


def _tz_day(spark, sf):
    return trips_from_tables(spark, sf, pickup_day=Q.REVENUE_DAY), zones_from_nation(spark, sf)


@register("q_short_trips", _TRIPS_CTE + f"""
SELECT count(*) AS short_trip_count FROM trips WHERE {_RANGE} AND trip_distance <= 1""")
def q_short_trips(spark, sf):
    return Q.short_trips(trips_from_tables(spark, sf))


@register("q_short_trips_sql", _TRIPS_CTE + f"""
SELECT count(*) AS short_trip_count FROM trips WHERE {_RANGE} AND trip_distance <= 1""")
def q_short_trips_sql(spark, sf):
    return Q.short_trips_sql(spark, trips_from_tables(spark, sf))


@register("q_longest_days", _TRIPS_CTE + f"""
SELECT CAST(lpep_pickup_datetime AS DATE) AS pickup_day FROM trips
WHERE trip_distance < 100 AND {_RANGE} ORDER BY trip_distance DESC""")
def q_longest_days(spark, sf):
    return Q.longest_days(trips_from_tables(spark, sf, with_identity=True))


@register("q_longest_day_top1", _TRIPS_CTE + f"""
SELECT CAST(lpep_pickup_datetime AS DATE) AS pickup_day FROM trips
WHERE trip_distance < 100 AND {_RANGE}
ORDER BY trip_distance DESC NULLS LAST, pickup_day LIMIT 1""")
def q_longest_day_top1(spark, sf):
    return Q.longest_day_top1(trips_from_tables(spark, sf))


_ZR = _TRIPS_CTE + """,
zr AS (SELECT PULocationID, sum(CAST(total_amount AS DECIMAL(18,2))) AS rev FROM trips
       WHERE CAST(lpep_pickup_datetime AS DATE) = DATE '1997-03-18' GROUP BY PULocationID)
SELECT Zone AS pickup_zone, CAST(rev AS DOUBLE) AS total_revenue
FROM zr JOIN zones ON PULocationID = LocationID"""


@register("q_zone_revenue", _ZR + " ORDER BY rev DESC")
def q_zone_revenue(spark, sf):
    return Q.zone_revenue(*_tz_day(spark, sf))


@register("q_zone_revenue_top1", _ZR + " ORDER BY rev DESC NULLS LAST, pickup_zone LIMIT 1")
def q_zone_revenue_top1(spark, sf):
    return Q.zone_revenue_top1(*_tz_day(spark, sf))


_TIPS = _TRIPS_CTE + f""",
eh AS (SELECT t.DOLocationID, t.tip_amount FROM trips t JOIN zones z ON t.PULocationID = z.LocationID
       WHERE z.Zone = 'NATION_3' AND {_RANGE})
"""


@register("q_tip_dropoff", _TIPS + """
SELECT z.Zone AS dropoff_zone, eh.tip_amount AS tip_amount
FROM eh JOIN zones z ON eh.DOLocationID = z.LocationID ORDER BY eh.tip_amount DESC""")
def q_tip_dropoff(spark, sf):
    return Q.tip_dropoff(trips_from_tables(spark, sf, with_identity=True), zones_from_nation(spark, sf))


@register("q_tip_dropoff_top1", _TIPS + """
SELECT z.Zone AS dropoff_zone FROM eh JOIN zones z ON eh.DOLocationID = z.LocationID
ORDER BY eh.tip_amount DESC NULLS LAST, dropoff_zone LIMIT 1""")
def q_tip_dropoff_top1(spark, sf):
    return Q.tip_dropoff_top1(*_tz(spark, sf))


@register("q_rows", "SELECT CAST(count(*) AS BIGINT) AS rows_n FROM orders")
def q_rows(spark, sf):
    return Q.row_count(read_table(spark, sf, "orders"))


# first rows as stored; DuckDB keeps insertion order for a query without ORDER BY
@register("q_sample", "SELECT o_orderdate, o_orderkey FROM orders LIMIT 5")
def q_sample(spark, sf):
    return Q.sample_rows(read_table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"])


# load operators register themselves on import
from tidemark import registry_load  # noqa: E402,F401
