"""Column-expression builders. All run JVM-side inside whole-stage codegen."""

from tidemark.functions.nulls import NA_TOKENS, na_to_null, empty_to_null
from tidemark.functions.coerce import (
    strip_ws, is_number_text, is_integer_text, to_number, to_integer,
    fraction_flag, to_datetime, DATETIME_PAIRS,
)
from tidemark.functions.identifiers import (
    normalize_ident, normalize_ident_col, sanitize_ident, is_safe_ident, is_safe_ident_col,
    quote_ident,
)
from tidemark.functions.months import (
    expected_month, expected_month_col, month_window, month_start_col, month_end_col,
)

__all__ = [
    "NA_TOKENS", "na_to_null", "empty_to_null", "strip_ws", "is_number_text", "is_integer_text",
    "to_number", "to_integer", "fraction_flag", "to_datetime", "DATETIME_PAIRS",
    "normalize_ident", "normalize_ident_col", "sanitize_ident", "is_safe_ident",
    "is_safe_ident_col", "quote_ident", "expected_month", "expected_month_col", "month_window",
    "month_start_col", "month_end_col",
]
