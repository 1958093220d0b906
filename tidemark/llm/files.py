"""Raw files in the shared scratch folder, reached from any task."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from tidemark.session import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared scratch root."""
    return scratch_path(spark, "llm", suffix="-" + name)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI (local and shared mounts, HDFS,
    S3 or GCS, as the installed Arrow supports)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def unique_name(prefix: str, suffix: str) -> str:
    """A name that no other attempt of a task uses: only what a finished task
    reports is read later, and the rests of lost ones lie unread."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
