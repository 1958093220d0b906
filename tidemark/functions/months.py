"""Expected month of a table and its half-open window (V4, V5)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# A table name's month is its first "YYYY_MM".
MONTH_PATTERN = r"([0-9]{4})_([0-9]{2})"


@dataclass(frozen=True)
class Month:
    """A calendar month by its number since year 0; adding one gives the next."""

    index: int

    @classmethod
    def parse(cls, text: str) -> Month:
        year, _, month = text.partition("_")
        if not (year.isdigit() and month.isdigit() and 1 <= int(month) <= 12):
            raise ValueError(f"month out of range: {text!r}")
        return cls(int(year) * 12 + int(month) - 1)

    @property
    def start(self) -> datetime:
        return datetime(self.index // 12, self.index % 12 + 1, 1)

    @property
    def end(self) -> datetime:
        return Month(self.index + 1).start


def expected_month(table_name: str) -> str | None:
    """Month text in a table's name (``..._2024_01`` -> ``2024_01``), None without one."""
    return next((found[0] for found in re.finditer(MONTH_PATTERN, table_name)), None)


def month_window(month: str) -> tuple[datetime, datetime]:
    """``2024_12`` -> [2024-12-01, 2025-01-01)."""
    parsed = Month.parse(month)
    return parsed.start, parsed.end


def expected_month_col(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(c, MONTH_PATTERN, 0), F.lit(""))


def month_start_col(month: Column) -> Column:
    return F.to_timestamp_ntz(month, F.lit("yyyy_MM"))


def month_end_col(month: Column) -> Column:
    return F.add_months(F.to_date(month, "yyyy_MM"), 1).cast("timestamp_ntz")
