"""Landing-folder ingest with Structured Streaming.

Files dropped into a folder (one per month, say) are picked up once each by
Spark's file source; the checkpoint records which files were taken, so a
restarted job resumes where it stopped. Every micro-batch goes through the
same steps as a batch load: conform -> staged table -> one validation
aggregate -> append to the published view. The view records the last batch
id each stream published, in the same catalog call that appends the batch,
so a batch replayed after a failure is recognised and never appended twice
(exactly-once publish on top of at-least-once ``foreachBatch``), even after
compaction has merged the batch's table away.

A Parquet stream carries file names, not rows: each micro-batch reads its own
files by their own footers, as a batch load does, so a file without a required
column fails its batch and a file of drifted types is conformed. Which files share
a batch is chance, and Spark's writers leave files without rows (the first task's):
a batch without rows publishes nothing, and a first load fails if no file has rows.

Beside the batch id the view keeps a report: counts of each of the last batches
and totals over all of them, changed in the same call. The totals are the state
of the month verdict: they survive restarts and count a replayed batch once.
"""

from __future__ import annotations

import hashlib
import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import BadDatetimeError, EmptyLoadError, MonthSpillError
from tidemark.functions.identifiers import WHITESPACE_CHARS, sanitize_ident
from tidemark.operators import publish as pub
from tidemark.operators.conform import conform_text
from tidemark.operators.schema import infer_text_schema, merged_target_schema
from tidemark.operators.validate import MAX_OUTSIDE_RATIO, MAX_OUTSIDE_ROWS, exceeds, spill_message, validate
from tidemark.pipeline import nulled, observed, read_conformed, spread
from tidemark.session import stable_root
from tidemark.sources.parquet import read_by_footer
from tidemark.sources.paths import FileFormat
from tidemark.sources.text import DEFAULT_SEP, check_delimiter, read_raw_header


log = logging.getLogger("tidemark.streaming")

# Batches whose own counts the report keeps; the totals are over all batches.
REPORTED_BATCHES = 64
# The schema of Spark's file listing source.
_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                       T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def _token(checkpoint: str) -> str:
    return hashlib.sha1(checkpoint.encode()).hexdigest()[:8]


def _batch_table(final: str, checkpoint: str, batch_id: int) -> str:
    return pub.physical_name(final, f"s{_token(checkpoint)}_{batch_id:08d}")


def batch_property(checkpoint: str) -> str:
    """View property holding the last batch id this stream (checkpoint) published."""
    return f"{pub.PROPERTY_PREFIX}batch.{_token(checkpoint)}"


def report_property(checkpoint: str) -> str:
    """View property holding the counts of this stream's batches."""
    return f"{pub.PROPERTY_PREFIX}report.{_token(checkpoint)}"


def default_checkpoint(spark: SparkSession, db: str, final: str) -> str:
    """One fixed place per table, so a restarted stream resumes."""
    return f"{stable_root(spark)}/tidemark-streams/{db}.{final}"


def stream_report(spark: SparkSession, table: str, database: str | None = None, checkpoint: str | None = None) -> dict:
    """``totals`` over all published batches of a stream and ``batches``, the counts
    of the last ones: rowcount, min_dt, max_dt, null_dt, inside_month,
    outside_month (where the table has a datetime and a month), datetime_nulls
    and fraction_nulls by column; the totals also have the verdict ``exceeds``."""
    final, db = sanitize_ident(table), sanitize_ident(database or spark.catalog.currentDatabase())
    _, props = pub.published_state(spark, db, final) or ([], {})
    text = props.get(report_property(checkpoint or default_checkpoint(spark, db, final)))
    return json.loads(text) if text else {"totals": {}, "batches": []}


def add_up(total: dict, batch: dict) -> dict:
    """Counts of two disjoint sets of rows as the counts of both: sums, the least
    and the largest datetime, sums by column. Associative, so any batches add up."""
    out = dict(total)
    for k, v in batch.items():
        had = out.get(k)
        if v is None or had is None:
            out[k] = had if v is None else v
        elif isinstance(v, dict):
            out[k] = add_up(had, v)
        elif k == "min_dt":
            out[k] = min(had, v)
        elif k == "max_dt":
            out[k] = max(had, v)
        else:
            out[k] = had + v
    return out


def _landed_first(spark: SparkSession, files: list[str]) -> tuple:
    """When the first of some files landed, and its path: names only, no content."""
    listed = spark.read.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(files)
    return tuple(listed.agg(F.min(F.struct("modificationTime", "path")).alias("first")).first().first)


def landing_stream(spark: SparkSession, landing_dir: str, table: str, *, fmt: str = "csv",
                   database: str | None = None, checkpoint: str | None = None,
                   header: list[str] | None = None, target: T.StructType | None = None,
                   sep: str | None = None, encoding: str = "UTF-8", max_files_per_trigger: int | None = None,
                   available_now: bool = True, max_outside_rows: int = MAX_OUTSIDE_ROWS,
                   max_outside_ratio: float = MAX_OUTSIDE_RATIO, fail_on_outside_month: bool = False,
                   compact_after: int | None = 64, clean_source: str = "off",
                   archive_dir: str | None = None, fail_on_bad_datetimes: bool = False,
                   datetime_formats: dict[str, str] | None = None, verdict_over: str = "batch") -> StreamingQuery:
    """Start the stream; ``available_now`` takes every file present, then stops.

    Text files must share one header: ``header``, else the header of a file
    already in the folder, else the published table's column order; Spark
    checks every new file's header against it. The target schema is the
    published table's, else ``target``, else (Parquet) merged from all footers, with
    the columns in the order of the file that landed first, whatever the files'
    names, or (text) inferred from all files in the folder at the start. Batches are
    checked like loads: ``fail_on_bad_datetimes`` refuses a batch with datetime
    text that is not ISO (or ``datetime_formats`` of its column), and
    ``fail_on_outside_month`` one with too many rows outside the month, in itself
    or, with ``verdict_over="stream"``, together with all batches before it;
    :func:`stream_report` has the counts. ``clean_source``
    (``archive`` to ``archive_dir``, or ``delete``) lets Spark move or remove
    files once their batch is committed; by default sources are kept.
    ``checkpoint`` defaults to a fixed folder per table under
    ``spark.checkpoint.dir``, so restarting the stream resumes it.
    """
    final = sanitize_ident(table)
    db = sanitize_ident(database or spark.catalog.currentDatabase())
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    fq_final = pub.fq(db, final)
    f = FileFormat(fmt)
    checkpoint = checkpoint or default_checkpoint(spark, db, final)
    if verdict_over not in ("batch", "stream"):
        raise ValueError("verdict_over must be batch or stream")
    if spark.catalog.tableExists(fq_final):
        target = spark.table(fq_final).schema

    if clean_source not in ("off", "archive", "delete"):
        raise ValueError("clean_source must be off, archive or delete")
    reader = spark.readStream.option("cleanSource", clean_source)
    if clean_source == "archive":
        if not archive_dir:
            raise ValueError("clean_source='archive' needs archive_dir")
        reader = reader.option("sourceArchiveDir", archive_dir)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if f is FileFormat.PARQUET:
        if target is None:          # footers of the files already landed (no data read)
            scans = read_by_footer(spark, [landing_dir])
            if len(scans) > 1:      # Spark's own file names are random: they tell no order
                scans.sort(key=lambda scan: _landed_first(spark, scan[0]))
            target = merged_target_schema([(files[0], raw.schema) for files, raw in scans])
            if all(raw.isEmpty() for _, raw in scans):
                raise EmptyLoadError(f"validation failed: no file in {landing_dir} has rows")
        src = reader.format("binaryFile").schema(_FILES).load(landing_dir).select("path")   # names only, no content
    else:
        s = check_delimiter(sep if sep is not None else DEFAULT_SEP[f.value], f.value)
        names = header
        if names is None:
            try:                    # the files' own header, when one has landed
                names = read_raw_header(spark, landing_dir, s, encoding)
            except (AnalysisException, EmptyLoadError) as e:
                # nothing has landed: the table's own order; other faults are real
                nothing = isinstance(e, EmptyLoadError) or any(k in str(e) for k in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))
                if target is None or not nothing:
                    raise
                names = target.fieldNames()
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        # Spark checks each new file's header against these names (no silent
        # positional binding of a file whose columns are in another order)
        src = (reader.schema(schema).option("header", "true").option("enforceSchema", "false")
               .option("sep", s).option("quote", '"').option("escape", '"').option("multiLine", "true")
               .option("encoding", encoding).csv(landing_dir)
               .toDF(*[n.strip(WHITESPACE_CHARS) for n in names]))
        if target is None:      # all files present decide, however small a batch is
            present = (spark.read.schema(schema).option("header", "true").option("enforceSchema", "false")
                       .option("sep", s).option("quote", '"').option("escape", '"').option("multiLine", "true")
                       .option("encoding", encoding).csv(landing_dir)
                       .toDF(*[n.strip(WHITESPACE_CHARS) for n in names]))
            target = infer_text_schema(present)

    base = landing_dir if f is FileFormat.PARQUET and not any(ch in landing_dir for ch in "*?[{") else None
    load_batch = batch_loader(db, final, checkpoint, f, target, max_outside_rows, max_outside_ratio,
                              fail_on_outside_month, compact_after, fail_on_bad_datetimes, datetime_formats, verdict_over, base)
    w = src.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _few_splits(spark: SparkSession, df: DataFrame) -> bool:
    try:
        return df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no RDD view (Connect): leave the splits alone
        return False


def batch_loader(db: str, final: str, checkpoint: str, f: FileFormat, target: T.StructType,
                 max_outside_rows: int = MAX_OUTSIDE_ROWS, max_outside_ratio: float = MAX_OUTSIDE_RATIO,
                 fail_on_outside_month: bool = False, compact_after: int | None = 64, fail_on_bad_datetimes: bool = False,
                 formats: dict[str, str] | None = None, verdict_over: str = "batch", base: str | None = None):
    """The ``foreachBatch`` function: conform, stage, validate and append one micro-batch.

    A batch holds rows of text, or the names of Parquet files (column ``path``).
    """
    mark, told = batch_property(checkpoint), report_property(checkpoint)

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        sess = batch.sparkSession
        staged = _batch_table(final, checkpoint, batch_id)
        parts, props = pub.published_state(sess, db, final) or ([], {})
        if int(props.get(mark, "-1")) >= batch_id:      # replayed batch: already published
            return
        pub.drop_if_exists(sess, pub.fq(db, staged))     # half-done earlier attempt
        if f is FileFormat.PARQUET:     # a batch is a list of files, each with its own footer
            files = sorted(r.path for r in batch.select("path").distinct().collect())
            if not files:
                return
            conformed, _, counts = read_conformed(sess, files, f, target, formats=formats, base=base)
        else:   # a batch of few unsplittable files: spread before the per-value work
            if batch.isEmpty():
                return
            counts = []
            rows = observed(spread(batch) if _few_splits(sess, batch) else batch, target, True, True, counts, formats)
            conformed = conform_text(rows, target, formats)
        buckets = pub.published_buckets(props)
        pub.write_part(conformed if buckets else pub.time_sorted(conformed), db, staged, buckets)
        try:
            metrics = validate(sess.table(pub.fq(db, staged)), final, max_outside_rows, max_outside_ratio,
                               fail_on_outside_month and verdict_over == "batch")
            own = {k: str(v) if k in ("min_dt", "max_dt") and v is not None else v for k, v in metrics.items()
                   if k in ("rowcount", "min_dt", "max_dt", "null_dt", "inside_month", "outside_month")}
            own |= {"datetime_nulls": nulled(counts, "__undated"), "fraction_nulls": nulled(counts, "__fractions")}
            if own["datetime_nulls"] and fail_on_bad_datetimes:
                raise BadDatetimeError(f"text that is no datetime of its column's format, by column: {own['datetime_nulls']}")
            for col, n in own["datetime_nulls"].items():
                log.warning("batch %d: text in datetime column %r set to NULL: %d", batch_id, col, n)
            report = json.loads(props.get(told, '{"totals": {}, "batches": []}'))
            totals = add_up({k: v for k, v in report["totals"].items() if k != "exceeds"}, {**own, "batches": 1})
            if "outside_month" in totals:
                totals["exceeds"] = exceeds(totals["outside_month"], totals["rowcount"], max_outside_rows, max_outside_ratio)
                if totals["exceeds"] and fail_on_outside_month and verdict_over == "stream":
                    ratio = totals["outside_month"] / totals["rowcount"]
                    raise MonthSpillError(spill_message(final, {**totals, "outside_ratio": ratio, "expected_month": metrics["expected_month"]},
                                                        max_outside_rows, max_outside_ratio))
            batches = [*report["batches"], {"batch_id": batch_id, **own}][-REPORTED_BATCHES:]
            pub.publish_staged(sess, db, final, staged, "append" if parts else "replace",
                               {mark: str(batch_id), told: json.dumps({"totals": totals, "batches": batches})})
        except EmptyLoadError as e:     # only Parquet files get here, with all columns but no rows
            pub.cleanup_best_effort(sess, pub.fq(db, staged))
            log.warning("batch %d publishes nothing: %s", batch_id, e)
            return
        except BaseException:
            pub.cleanup_best_effort(sess, pub.fq(db, staged))
            raise
        pub.analyze(sess, db, staged)
        if compact_after and len(parts) + 1 > compact_after:
            pub.compact(sess, db, final, compact_after)
    return load_batch
