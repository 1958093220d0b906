"""Parquet scan (S3): vectorized, columns pruned and filters pushed by Catalyst.

Spark takes one footer's schema for a whole read: a file that lacks a column
would read as NULL and one that holds it in another type would fail. The footers
of all files are therefore read first, by tasks, and files are grouped by what
their footers say, one scan for each group. A folder whose files agree needs one
row from the tasks and is scanned as a folder.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Footers that one task reads, about, and most tasks for it.
FOOTERS_A_TASK, FOOTER_TASKS = 64, 2000
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def read_parquet(spark: SparkSession, paths: str | list[str], merge_schema: bool = False) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    return reader.parquet(*paths)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files behind one path (file, folder or glob); a listing, no job."""
    files = spark.read.schema("_unused string").parquet(path).inputFiles()
    return sorted(unquote(f) for f in files)


def _base_of(source: str, files: list[str]) -> str | None:
    """The folder that partition columns are read from; None for a file or a glob."""
    if any(ch in source for ch in "*?[{"):
        return None
    name = source.rstrip("/").rsplit("/", 1)[-1]
    return None if len(files) == 1 and files[0].rsplit("/", 1)[-1] == name else source


def _footer_print(uri: str) -> str | None:
    """A digest of what Spark derives a file's schema from: the Parquet schema, and
    the Spark schema where Spark wrote the file. None where Arrow cannot open the
    store; Spark then reads the footer itself."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    try:
        if uri.startswith(("/", "file:")):
            fs, path = pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
        else:
            fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            meta = pq.read_metadata(f)
    except (OSError, ValueError, pa.ArrowException):
        return None
    spark_schema = (meta.metadata or {}).get(_SPARK_SCHEMA, b"")
    columns = [(c.path, c.physical_type, str(c.logical_type), c.max_definition_level, c.max_repetition_level, c.length)
               for c in (meta.schema.column(i) for i in range(meta.num_columns))]
    return hashlib.sha256(json.dumps([columns, spark_schema.decode("utf-8", "replace")]).encode()).hexdigest()


def footer_prints(spark: SparkSession, files: list[str]) -> DataFrame:
    """(nth, footer) of each file of a list, read by tasks; footer is null where
    Arrow cannot open the file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_footer_print(u) for u in b.column(1).to_pylist()], pa.string())], ["nth", "footer"])

    tasks = max(1, min(FOOTER_TASKS, len(files) // FOOTERS_A_TASK))
    listed = spark.createDataFrame(pa.table({"nth": pa.array(range(len(files)), pa.int64()), "file": pa.array(files, pa.string())}))
    return listed.repartition(tasks, "nth").mapInArrow(task, "nth long, footer string")


def _footers(spark: SparkSession, files: list[str]) -> list[str]:
    """A name for each file's schema, equal for equal ones.

    One job reads all footers in tasks. Only counts of the distinct ones reach the
    driver, and a number for each file if they differ. In a store that Arrow does
    not open, Spark reads the footers, sixteen small jobs at a time."""
    prints = footer_prints(spark, files)
    kinds = prints.groupBy("footer").agg(F.count("*").alias("n"), F.min("nth").alias("first")).orderBy("first").collect()
    if any(k.footer is None for k in kinds):
        with ThreadPoolExecutor(max_workers=16) as pool:
            return list(pool.map(lambda f: spark.read.parquet(f).schema.json(), files))
    if len(kinds) == 1:
        return [kinds[0].footer] * len(files)
    rows = prints.select("nth", "footer").toArrow()
    of = dict(zip(rows["nth"].to_pylist(), rows["footer"].to_pylist()))
    return [of[i] for i in range(len(files))]


def read_by_footer(spark: SparkSession, sources: list[str], base: str | None = None) -> list[tuple[list[str], DataFrame]]:
    """One (files, DataFrame) for each distinct footer schema, in source order.

    With ``base``, ``sources`` are single files below that folder, and partition
    columns are read from it. The driver holds file names and distinct schemas.
    """
    if base:
        places = [(base, f) for f in sources]
    else:
        with ThreadPoolExecutor(max_workers=16) as pool:
            listed = list(pool.map(lambda s: list_files(spark, s), sources))
        places = [(_base_of(s, files), f) for s, files in zip(sources, listed) for f in files]
        if len(places) < 2:
            return [(list(sources), read_parquet(spark, sources))]
    distinct = list(OrderedDict.fromkeys(f for _, f in places))
    footers = dict(zip(distinct, _footers(spark, distinct)))
    groups: OrderedDict[tuple[str | None, str], list[str]] = OrderedDict()
    for at, f in places:
        groups.setdefault((at, footers[f]), []).append(f)
    alike = len(set(footers.values())) == 1
    out = []
    for (at, _), files in groups.items():
        reader = spark.read.option("basePath", at) if at else spark.read
        whole = alike and at and at != base and sources.count(at) == 1  # all files of the folder: a shorter way to name them
        out.append((files, reader.parquet(at) if whole else reader.parquet(*files)))
    return out
