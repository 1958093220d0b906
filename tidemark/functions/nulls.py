"""NULL tokens of delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens a delimited-file reader treats as missing
# (the pandas ``read_csv`` default NA set, plus the empty field).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def na_to_null(c: Column | str) -> Column:
    """Text field -> NULL when it is exactly one of the NA tokens (no trimming)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def empty_to_null(c: Column | str) -> Column:
    """Parquet text: only the empty string is missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))
