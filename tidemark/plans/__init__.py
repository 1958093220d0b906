"""Relational plans: the trip fact view and the analytic queries over it."""

from tidemark.plans.trips import read_table, trips_from_tables, zones_from_nation
from tidemark.plans.queries import (
    short_trips, longest_days, longest_day_top1, zone_revenue, zone_revenue_top1,
    tip_dropoff, tip_dropoff_top1, row_count, sample_rows, dimension_join_side,
)

__all__ = [
    "read_table", "trips_from_tables", "zones_from_nation", "short_trips", "longest_days",
    "longest_day_top1", "zone_revenue", "zone_revenue_top1", "tip_dropoff", "tip_dropoff_top1",
    "row_count", "sample_rows", "dimension_join_side",
]
