"""tidemark: staged, validated, schema-conforming loads and trip queries on Spark.

Layout:
  sources/    CSV/TSV/Parquet scans, format routing, monthly paths and table names
  functions/  Column builders: NULL tokens, tolerant coercion, identifiers, months
  operators/  target schema, conform, one-pass validation, staged publish
  plans/      trip fact view and the analytic queries
  streaming/  landing-folder ingest with Structured Streaming
  pipeline    ingest() / ingest_month(): the end-to-end load
"""

from tidemark.session import build_session, scratch_root, scratch_database
from tidemark.pipeline import ingest, ingest_month, read_conformed
from tidemark.operators.publish import compact, drop_published, published_parts
from tidemark.streaming import landing_stream

__all__ = ["build_session", "scratch_root", "scratch_database", "ingest", "ingest_month",
           "read_conformed", "compact", "drop_published", "published_parts", "landing_stream"]
