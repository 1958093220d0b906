"""Sources: delimited text and Parquet scans, format routing, monthly names."""

from tidemark.sources.paths import (
    FileFormat, detect_format, detect_format_col, normalize_month, month_path, month_path_col,
    month_table, month_table_col, table_name_from_url, table_name_from_url_col, DATASETS,
)
from tidemark.sources.text import check_delimiter, read_header, read_delimited
from tidemark.sources.parquet import read_parquet

__all__ = [
    "FileFormat", "detect_format", "detect_format_col", "normalize_month", "month_path",
    "month_path_col", "month_table", "month_table_col", "table_name_from_url",
    "table_name_from_url_col", "DATASETS", "check_delimiter", "read_header", "read_delimited",
    "read_parquet",
]
