"""Staged publish (W1-W6): a failed load never changes what readers see.

The published name is a catalog *view* over one or more run-scoped physical
tables ``<final>__r_<run_id>``; the view records its parts in a table
property. Both publish modes are a single ``CREATE OR REPLACE VIEW``:

* replace: the view becomes the new staged table alone; the old parts are
  dropped by the publish after it, so running readers keep their files.
* append: the new staged table is added to the view's parts (no data copied).
  ``compact`` merges the smaller parts when they pile up.

Staged tables are ordinary Parquet tables, written by one Spark job with the
file commit protocol: task retries after a lost executor never duplicate or
half-write files, and a failed job leaves no table behind.
"""

from __future__ import annotations

import sys

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import IngestError, LostPublishError
from tidemark.functions.identifiers import quote_ident, sanitize_ident
from tidemark.operators.validate import detect_datetime_column

PROPERTY_PREFIX = "tidemark."
PARTS_PROPERTY = "tidemark.parts"
GENERATION_PROPERTY = "tidemark.generation"
PREVIOUS_PROPERTY = "tidemark.previous"
BUCKETS_PROPERTY = "tidemark.buckets"
RUN_MARK = "__r_"


def new_run_id() -> str:
    return time.strftime("%Y%m%d%H%M%S") + "_" + uuid.uuid4().hex[:8]


def physical_name(final: str, run_id: str) -> str:
    return sanitize_ident(f"{final}{RUN_MARK}{run_id}")


def fq(database: str, name: str) -> str:
    return f"{sanitize_ident(database)}.{sanitize_ident(name)}"


def write_part(df: DataFrame, database: str, name: str, buckets: tuple[str, int] | None = None) -> None:
    """Write one physical part. With ``buckets``, (column, number), its rows are
    dealt by a hash of the column, a file for each bucket, sorted by it. Parts
    that are dealt alike join and group by that column where they are stored."""
    w = df.write
    if buckets:
        column, n = buckets
        w = df.repartition(n, quote_ident(column)).write.bucketBy(n, column).sortBy(column)
    w.format("parquet").mode("errorifexists").saveAsTable(fq(database, name))


def published_buckets(props: dict[str, str]) -> tuple[str, int] | None:
    """(column, number of buckets) that the parts of a published table are dealt by."""
    number, _, column = props.get(BUCKETS_PROPERTY, "").partition(":")
    return (column, int(number)) if column else None


def bucket_props(buckets: tuple[str, int] | None) -> dict[str, str]:
    return {BUCKETS_PROPERTY: f"{buckets[1]}:{buckets[0]}"} if buckets else {}


def stage(df: DataFrame, database: str, final: str, name: str | None = None, buckets: tuple[str, int] | None = None) -> str:
    """Write the conformed rows as a new physical table (W1). Returns its name.

    ``name`` is a physical name from :func:`physical_name`; a fresh run id is
    used when it is not given. ``buckets``: see :func:`write_part`.
    """
    name = name or physical_name(final, new_run_id())
    if not name.startswith(final + RUN_MARK):
        raise IngestError(f"staged name {name!r} does not belong to {final!r}")
    write_part(df, database, name, buckets)
    return name


def published_state(spark: SparkSession, database: str, final: str) -> tuple[list[str], dict[str, str]] | None:
    """(physical parts, our view properties) of a published table; None if absent."""
    name = fq(database, final)
    if not spark.catalog.tableExists(name):
        return None
    tbl = spark.catalog.getTable(name)
    props = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if tbl.tableType != "VIEW" or PARTS_PROPERTY not in props:
        raise IngestError(f"{name} exists but was not published by this library")
    ours = {k: v for k, v in props.items() if k.startswith(PROPERTY_PREFIX) and k != PARTS_PROPERTY}
    return [p for p in props[PARTS_PROPERTY].split(",") if p], ours


def published_parts(spark: SparkSession, database: str, final: str) -> list[str] | None:
    """Physical tables behind a published view; None when nothing is published."""
    state = published_state(spark, database, final)
    return None if state is None else state[0]


def _create_view(spark: SparkSession, database: str, final: str, parts: list[str],
                 props: dict[str, str] | None = None) -> None:
    body = " UNION ALL ".join(f"SELECT * FROM {fq(database, p)}" for p in parts)
    allp = {**(props or {}), PARTS_PROPERTY: ",".join(parts)}
    text = ", ".join(f"'{k}' = '{v}'" for k, v in sorted(allp.items()))
    spark.sql(f"CREATE OR REPLACE VIEW {fq(database, final)} TBLPROPERTIES ({text}) AS {body}")


def publish_staged(spark: SparkSession, database: str, final: str, staged: str, mode: str,
                   props: dict[str, str] | None = None) -> list[str]:
    """Flip the published view in one catalog call (W2 append / W3 replace).

    ``props`` are recorded on the view in the same call (a stream's last
    published batch id, so publish and bookkeeping change together).
    """
    if not spark.catalog.tableExists(fq(database, staged)):
        raise IngestError(f"staged table does not exist: {fq(database, staged)}")
    old, old_props = published_state(spark, database, final) or ([], {})
    parts = old + [staged] if mode == "append" else [staged]
    _flip(spark, database, final, old, parts, {**old_props, **(props or {})}, staged)
    return parts


def _names(text: str) -> list[str]:
    return [p for p in text.split(",") if p]


def _flip(spark: SparkSession, database: str, final: str, old: list[str], parts: list[str],
          props: dict[str, str], new_part: str) -> None:
    """Point the view at ``parts``, confirm it, and drop the generation before the last.

    Parts that leave the view stay on disk until the next publish, so a reader
    planned just before this call still finds its files.
    """
    generation = int(props.get(GENERATION_PROPERTY, "0")) + 1
    expired = _names(props.get(PREVIOUS_PROPERTY, ""))
    left = [p for p in old if p not in parts]
    _create_view(spark, database, final, parts,
                 {**props, GENERATION_PROPERTY: str(generation), PREVIOUS_PROPERTY: ",".join(left)})
    now, now_props = published_state(spark, database, final) or ([], {})
    if new_part not in now:
        raise LostPublishError(f"{fq(database, final)}: generation {generation} was overwritten by another writer "
                               f"(now {now_props.get(GENERATION_PROPERTY)}); load again, one writer at a time")
    for p in expired:
        if p not in now:
            drop_if_exists(spark, fq(database, p))


def read_published(spark: SparkSession, database: str, final: str, identity: tuple[str, str] = ("trip_file", "trip_row")) -> DataFrame:
    """Rows of a published table with their place: the file of a staged part and
    the position in it. No two rows share a place and no retry changes it, so a
    sort that ends with it splits rows that are equal otherwise."""
    parts = published_parts(spark, database, final)
    if not parts:
        raise IngestError(f"not published: {fq(database, final)}")
    places = [F.col("_metadata.file_path").alias(identity[0]), F.col("_metadata.row_index").alias(identity[1])]
    return reduce(DataFrame.unionByName, [spark.table(fq(database, p)).select("*", *places) for p in parts])


def part_bytes(spark: SparkSession, database: str, part: str) -> int:
    """Size of a physical part from its catalog statistics (metadata only). A part
    of unknown size counts as the largest, so that it is not rewritten by chance."""
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {fq(database, part)}").collect():
        if r[0] == "Statistics" and r[1]:
            head = str(r[1]).split(" ", 1)[0]
            return int(head) if head.isdigit() else sys.maxsize
    return sys.maxsize


def compact(spark: SparkSession, database: str, final: str, max_parts: int = 1) -> list[str]:
    """Merge parts once there are more than ``max_parts`` of them; returns the parts.

    The smaller half of the parts (by stored size) is rewritten as one new part
    and the view flipped to it in one catalog call; big parts stay as they
    are. A row is thus rewritten only when its part is among the smaller
    half, so repeated appends cost a logarithmic number of rewrites per row,
    not a rewrite of the whole table each time. ``max_parts=1`` merges all.
    """
    parts, props = published_state(spark, database, final) or ([], {})
    if len(parts) <= max(1, max_parts):
        return parts
    by_size = sorted(parts, key=lambda p: part_bytes(spark, database, p))
    merge = parts if max_parts <= 1 else by_size[: max(2, len(parts) // 2 + 1)]
    keep = [p for p in parts if p not in merge]
    merged = physical_name(final, new_run_id())
    try:
        union = reduce(DataFrame.unionAll, [spark.table(fq(database, p)) for p in merge])
        buckets = published_buckets(props)
        stage(union if buckets else time_sorted(union), database, final, merged, buckets)
        analyze(spark, database, merged)
        _flip(spark, database, final, parts, keep + [merged], props, merged)
    except BaseException:
        if merged not in (published_parts(spark, database, final) or []):
            cleanup_best_effort(spark, fq(database, merged))
        raise
    return keep + [merged]


def time_sorted(df: DataFrame) -> DataFrame:
    """Rows of each written file in order of the pickup time, where there is one:
    a local sort, no shuffle, so that row groups cover narrow time ranges."""
    dt_col = detect_datetime_column(df.columns)
    return df if dt_col is None else df.sortWithinPartitions(quote_ident(dt_col))


def analyze(spark: SparkSession, database: str, table: str, columns: bool = False) -> None:
    """Refresh optimizer statistics of a physical table."""
    what = "FOR ALL COLUMNS" if columns else ""
    spark.sql(f"ANALYZE TABLE {fq(database, table)} COMPUTE STATISTICS {what}")


def drop_if_exists(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_published(spark: SparkSession, database: str, final: str) -> None:
    """Remove a published view and every part behind it."""
    parts, props = published_state(spark, database, final) or ([], {})
    spark.sql(f"DROP VIEW IF EXISTS {fq(database, final)}")
    for p in parts + _names(props.get(PREVIOUS_PROPERTY, "")):
        drop_if_exists(spark, fq(database, p))


def cleanup_best_effort(spark: SparkSession, name: str | None) -> None:
    """Drop a staged table after a failure without masking the first error."""
    if not name:
        return
    try:
        drop_if_exists(spark, name)
    except Exception:  # noqa: BLE001 - cleanup must never hide the original failure
        pass
