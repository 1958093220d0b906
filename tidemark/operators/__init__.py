"""Operators: schema resolution, conform, validation, staged publish."""

from tidemark.operators.schema import (
    parquet_target_schema, infer_text_schema, table_exists, table_columns, schema_rows,
    datetime_pair_columns,
)
from tidemark.operators.conform import (
    conform_text, conform_typed, missing_columns, require_columns, integer_report,
    fraction_aggregates,
)
from tidemark.operators.validate import (
    detect_datetime_column, validation_metrics, validate, exceeds_expr,
)
from tidemark.operators.publish import (
    stage, publish_staged, published_parts, compact, analyze, drop_if_exists, drop_published,
    cleanup_best_effort, new_run_id, physical_name,
)

__all__ = [
    "parquet_target_schema", "infer_text_schema", "table_exists", "table_columns", "schema_rows",
    "datetime_pair_columns", "conform_text", "conform_typed", "missing_columns", "require_columns",
    "integer_report", "fraction_aggregates", "detect_datetime_column", "validation_metrics",
    "validate", "exceeds_expr", "stage", "publish_staged", "published_parts", "compact", "analyze",
    "drop_if_exists", "drop_published", "cleanup_best_effort", "new_run_id", "physical_name",
]
