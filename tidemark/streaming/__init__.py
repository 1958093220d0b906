"""Structured Streaming: landing-folder ingest through the staged publish."""

from tidemark.streaming.landing import landing_stream, stream_report

__all__ = ["landing_stream", "stream_report"]
