"""Validation of a staged load (V1-V7) as ONE aggregate over the staged table.

Row count, datetime profile and month spill-over are computed in a single
pass that reads only the datetime column (Parquet pruning); each task emits
one partial row, so the final merge is a single tiny task however large the
input. The driver only reads the one result row to decide.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import EmptyLoadError, MonthSpillError
from tidemark.functions.coerce import to_datetime
from tidemark.functions.identifiers import quote_ident
from tidemark.functions.months import expected_month, month_window

log = logging.getLogger("tidemark.validate")

# Pickup-datetime columns looked for, in order of preference.
DATETIME_CANDIDATES = ("lpep_pickup_datetime", "tpep_pickup_datetime", "pickup_datetime")
# Default spill-over thresholds (rows, ratio) and failure policy.
MAX_OUTSIDE_ROWS = 200
MAX_OUTSIDE_RATIO = 0.005
FAIL_ON_OUTSIDE_MONTH = False


def detect_datetime_column(columns: list[str]) -> str | None:
    """First candidate present, matched on trimmed lower-case names (V2)."""
    rank = {name: k for k, name in enumerate(DATETIME_CANDIDATES)}
    ranked = [(rank[key], -i, c) for i, c in enumerate(columns) if (key := c.strip().lower()) in rank]
    return min(ranked)[2] if ranked else None


def exceeds_expr(outside: Column, rowcount: Column, max_rows: int = MAX_OUTSIDE_ROWS,
                 max_ratio: float = MAX_OUTSIDE_RATIO) -> Column:
    """Verdict (V7): strictly more than ``max_rows`` or a ratio above ``max_ratio``."""
    return (outside > F.lit(max_rows)) | (outside_ratio(outside, rowcount) > F.lit(max_ratio))


def exceeds(outside: int, rowcount: int, max_rows: int = MAX_OUTSIDE_ROWS, max_ratio: float = MAX_OUTSIDE_RATIO) -> bool:
    """The verdict of :func:`exceeds_expr` on counts that the driver already has."""
    return outside > max_rows or (outside / rowcount if rowcount else 0.0) > max_ratio


def outside_ratio(outside: Column, rowcount: Column) -> Column:
    """Outside rows over ALL rows; 0.0 for an empty load (never a division by zero)."""
    return F.when(rowcount > 0, outside.cast("double") / rowcount).otherwise(F.lit(0.0))


def validation_metrics(df: DataFrame, dt_col: str | None = None, month: str | None = None,
                       max_rows: int = MAX_OUTSIDE_ROWS, max_ratio: float = MAX_OUTSIDE_RATIO) -> DataFrame:
    """One-row DataFrame: rowcount, datetime profile and spill-over counts.

    NULL datetimes are neither inside nor outside the window but are counted
    in the ratio's denominator (all rows).
    """
    aggs = [F.count(F.lit(1)).alias("rowcount")]
    if dt_col is not None:
        c = F.col(quote_ident(dt_col))
        aggs += [F.min(c).alias("min_dt"), F.max(c).alias("max_dt"),
                 F.count_if(c.isNull()).alias("null_dt")]
        if month is not None:
            start, end = month_window(month)
            dtype = df.schema[dt_col].dataType
            if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                c, dtype = to_datetime(c), T.TimestampNTZType()
            # wall-clock bounds from text: no driver time zone is involved
            lo = F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast(dtype)
            hi = F.lit(end.strftime("%Y-%m-%d %H:%M:%S")).cast(dtype)
            aggs += [F.count_if((c < lo) | (c >= hi)).alias("outside_month"),
                     F.count_if((c >= lo) & (c < hi)).alias("inside_month")]
    m = df.agg(*aggs).withColumn("datetime_col", F.lit(dt_col).cast("string"))
    if dt_col is not None and month is not None:
        m = (m.withColumn("expected_month", F.lit(month))
              .withColumn("outside_ratio", outside_ratio(F.col("outside_month"), F.col("rowcount")))
              .withColumn("exceeds", exceeds_expr(F.col("outside_month"), F.col("rowcount"), max_rows, max_ratio)))
    return m


def validate(df: DataFrame, table_name: str, max_rows: int = MAX_OUTSIDE_ROWS,
             max_ratio: float = MAX_OUTSIDE_RATIO, fail_on_outside_month: bool = FAIL_ON_OUTSIDE_MONTH
             ) -> dict:
    """Run the aggregate, then decide: no rows fails; spill-over fails only if asked."""
    dt_col = detect_datetime_column(df.columns)
    month = expected_month(table_name)
    row = validation_metrics(df, dt_col, month if dt_col else None, max_rows, max_ratio).first()
    result = row.asDict()
    if result["rowcount"] == 0:
        raise EmptyLoadError(f"validation failed: staged load of {table_name} has 0 rows")
    if "exceeds" in result:
        told = spill_message(table_name, result, max_rows, max_ratio)
        if result["exceeds"] and fail_on_outside_month:
            raise MonthSpillError(told)
        log.log(logging.WARNING if result["exceeds"] else logging.INFO, told)
    return result


def spill_message(table_name: str, result: dict, max_rows: int, max_ratio: float) -> str:
    """One line on how many rows lie outside the table's month, from the verdict's fields."""
    allowed = f"allowed are {max_rows} rows or a share of {max_ratio:g}"
    return (f"{table_name}: {result['outside_month']} of {result['rowcount']} rows (share {result['outside_ratio']:.6f}) "
            f"are not in {result['expected_month']}; {allowed}; values run from {result['min_dt']} to {result['max_dt']}")
