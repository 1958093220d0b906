"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: Key of a null id: a value that real ids do not take.
NULL_ID = -(2 ** 63)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark send this package to the Python workers, once an application,
    for sessions that were started without it on the workers' path."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), "tidemark")
        sc.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared scratch and read it back.

    Cuts the lineage: what follows reads files that every executor sees, so a
    lost executor costs its own tasks only, and nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", suffix="-" + name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``stored`` returned and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def passing(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stored``, for as long as a block takes that leaves no plan on its files."""
    kept = stored(df, name)
    try:
        yield kept
    finally:
        discard(kept)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` that counts its rows, from 0, in the order
    in which Spark wrote them to the files that ``df`` reads. Spark itself reads
    files in no such order. A frame of no files has an order of its own; its
    numbers have gaps. A column of that name is replaced; any others may be there.
    """
    plain = {f"c{i}": c for i, c in enumerate(df.columns) if c.lower() != name.lower()}
    own = [F.col(f"`{c}`").alias(k) for k, c in plain.items()]
    try:
        place = df.metadataColumn("_metadata")
        rows = df.select(*own, place["file_name"].alias("file"), place["row_index"].alias("row"))
    except AnalysisException:
        rows = df.select(*own, F.monotonically_increasing_id().alias("at"))
    else:
        # part-00012-...-c001...: written by task 12, its second file
        task, nth = (F.regexp_extract("file", p, 1).try_cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\b"))
        before = Window.orderBy(task, nth, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
        start = (rows.groupBy("file").agg(F.count("*").alias("n"))
                 .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
        rows = rows.join(F.broadcast(start), "file").withColumn("at", F.col("start") + F.col("row"))
    return rows.select(*(F.col(k).alias(c) for k, c in plain.items()), F.col("at").alias(name))


def fold(col: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % parts, F.lit(0))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def lists_as_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one common length, without nulls, as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def as_lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def finite(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, vectors) of the lists of ``dim`` components, all finite and not null."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)  # null: NaN
    ok = np.isfinite(x).all(1)
    return at[ok], x[ok]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches small, so that long texts do not pile up in a worker."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def slices_by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a column's values take ``most`` bytes, or are one."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
            yield b.slice(i, j - i)
            i = j


def concat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one uint8 array and the n+1 offsets of the parts."""
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=off[1:])
    return np.frombuffer(b"".join(parts), np.uint8), off


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def frequent(counts: DataFrame, key: str, n: str, limit: int) -> list:
    """The most frequent rows of ``counts``, at most ``limit`` of them, collected.

    A histogram over the logarithm of ``n`` finds the cut first, so the driver
    only ever receives rows that it keeps: every key from some frequency on.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    cut, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if total + r["count"] > limit:
            break
        cut, total = r.level, total + r["count"]
    if cut is None:
        return []
    return counts.where(level >= cut).select(key, n).orderBy(F.desc(n), key).collect()


def spread(df: DataFrame, *keys: str, most: int = 10_000) -> DataFrame:
    """Deal small rows that stand for much work, such as places in files, to
    about a task each; a given number of partitions is not coalesced."""
    return df.repartition(max(1, min(most, df.count())), *keys)
