"""End-to-end load (W7) and its two entry points (A1 monthly, A2 by path).

source -> target schema -> conform -> job 1: write staged table
       -> job 2: one validation aggregate -> driver decides
       -> one catalog call publishes (append or replace) -> statistics.

Nothing of the data passes through the driver: it reads one header record
per given path, single aggregate rows (validation metrics, inferred types,
file-size stats) and catalog metadata.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import (
    BadDatetimeError, IngestError, TableExistsError, UnsupportedFormatError, UnsupportedStrategyError,
)
from tidemark.functions.coerce import DATETIME_FORMATS, fitting_formats
from tidemark.functions.identifiers import sanitize_ident
from tidemark.operators import publish as pub
from tidemark.operators.conform import (
    conform_text, conform_typed, datetime_aggregates, fraction_aggregates, require_columns,
)
from tidemark.operators.schema import infer_text_schema, merged_target_schema
from tidemark.operators.validate import MAX_OUTSIDE_RATIO, MAX_OUTSIDE_ROWS, validate
from tidemark.sources.parquet import read_by_footer
from tidemark.sources.paths import (
    FileFormat, detect_format, month_path, month_table, table_name_from_url,
)
from tidemark.session import scratch_database
from tidemark.sources.text import DEFAULT_SEP, file_stats, read_delimited, splits_by_range

POLICIES = ("skip", "fail", "replace", "append")
log = logging.getLogger("tidemark.ingest")

# Stages after which ``fail_after`` can inject a failure (tests).
STAGES = ("read", "stage", "validate", "publish", "analyze")


def _fmt_of(sources: list[str], fmt: str | None) -> FileFormat:
    if fmt is not None:
        f = FileFormat(fmt.lower())
    else:
        found = {detect_format(s) for s in sources}
        if len(found) != 1:
            raise UnsupportedFormatError(f"sources mix formats: {sorted(x.value for x in found)}")
        f = found.pop()
    if f is FileFormat.UNKNOWN:
        raise UnsupportedFormatError(f"no loader for the format of {sources[0]!r}")
    return f


# A file this many times the mean file size is a straggler worth spreading,
# once it is also bigger than the floor (small inputs are not worth a shuffle).
HOT_FILE_FACTOR = 4
HOT_FILE_FLOOR_BYTES = 32 * 1024 * 1024


def _parallelism(spark: SparkSession) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext (Connect)
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def needs_spread(spark: SparkSession, sources: list[str], multi_line: bool, sep: str = ",", encoding: str = "UTF-8") -> bool:
    """Should parsed rows of unsplittable text be spread before the per-value work?

    Yes when there are fewer files than cores, or when one file is a hot
    source (several times the mean file size): its single task would
    otherwise conform and write that whole share alone. Splittable input, large
    plain files of multi-line records too, is read by many tasks already. Decided from file sizes (listing only).
    """
    n, total, largest, gzipped = file_stats(spark, sources)
    if n == 0 or not (multi_line or gzipped):
        return False
    if multi_line and splits_by_range(spark, sources, sep, encoding):
        return False
    if n < _parallelism(spark):
        return True
    return largest > HOT_FILE_FLOOR_BYTES and largest > HOT_FILE_FACTOR * (total / n)


def spread(df: DataFrame) -> DataFrame:
    """Spread parsed rows of unsplittable files (one ``.gz`` = one task) over all cores.

    Parsing stays one task per file, but the per-value checks and casts that
    follow, and the Parquet write, run on every core. Rows are hashed on their
    position in the input (unique, so even a file of identical rows spreads
    evenly, and no sort is needed as for round-robin); a file split is read in
    the same order when a task is retried after a lost executor, so every
    row goes to the same partition again. No fixed partition count: shuffle
    partitions, coalesced by AQE to the data's size.
    """
    return df.repartition(F.monotonically_increasing_id())


def stage_raw_text(spark: SparkSession, df: DataFrame, cleanup: list[str]) -> DataFrame:
    """Write spread text once as Parquet in the shared scratch database; read it back.

    Used on a first load of few unsplittable files: the type inference and
    the conform then both read this columnar copy in parallel instead of
    parsing the compressed text twice in one task per file. The table name
    is added to ``cleanup``; the caller drops it when the load ends.
    """
    db = scratch_database(spark)
    name = pub.physical_name("raw_text", pub.new_run_id())
    cleanup.append(pub.fq(db, name))
    spread(df).write.format("parquet").saveAsTable(pub.fq(db, name))
    return spark.table(pub.fq(db, name))


def read_conformed(spark: SparkSession, sources: list[str], fmt: FileFormat,
                   target=None, *, sep: str | None = None, encoding: str = "UTF-8",
                   multi_line: bool = True, observe: bool = True, cleanup: list[str] | None = None,
                   formats: dict[str, str] | None = None, base: str | None = None):
    """(conformed DataFrame, target schema, observations) for the given sources.

    With ``cleanup`` given, a first text load of few unsplittable files goes
    through :func:`stage_raw_text`; the caller drops the tables listed there.
    ``formats`` names how datetime text is written, by column (ISO where none is
    given). ``base`` makes Parquet ``sources`` single files of that folder.
    """
    observations: list[Observation] = []
    if fmt is FileFormat.PARQUET:
        scans = read_by_footer(spark, sources, base)
        target = target or merged_target_schema([(files[0], raw.schema) for files, raw in scans])
        for files, raw in scans:        # every file's own footer has the columns
            require_columns(raw.columns, target, what=f"Parquet file {files[0]}")
        parts = [conform_typed(observed(raw, target, False, observe, observations, formats), target, formats) for _, raw in scans]
        return reduce(DataFrame.unionAll, parts), target, observations
    hot = needs_spread(spark, sources, multi_line, sep or DEFAULT_SEP[fmt.value], encoding)
    groups = []
    for h, g in read_delimited(spark, sources, fmt.value, sep, encoding, multi_line):
        if hot and target is None and cleanup is not None:
            groups.append((h, stage_raw_text(spark, g, cleanup)))
        else:
            groups.append((h, spread(g) if hot else g))
    if target is None:
        first = groups[0][1]
        target = infer_text_schema(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                                          [g for _, g in groups[1:]], first))
    parts = [conform_text(observed(df, target, True, observe, observations, formats), target, formats) for _, df in groups]
    return reduce(DataFrame.unionAll, parts), target, observations


def observed(df: DataFrame, target, text: bool, observe: bool, observations: list[Observation],
              formats: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the counts of values that conforming will null, taken as rows pass by."""
    aggs = fraction_aggregates(df, target, text) + datetime_aggregates(df, target, text, formats) if observe else []
    if not aggs:
        return df
    obs = Observation(f"nulled_{len(observations)}")
    observations.append(obs)
    return df.observe(obs, *aggs)


def nulled(observations: list[Observation], suffix: str) -> dict:
    """Observed counts whose names end in ``suffix``, by column; zeros left out."""
    out: dict = {}
    for obs in observations:
        for k, v in (obs.get or {}).items():
            if k.endswith(suffix):
                col = k[: -len(suffix)]
                out[col] = out.get(col, 0) + (v or 0)
    return {k: v for k, v in out.items() if v}


def _written(observations: list[Observation], formats: dict[str, str]) -> dict[str, list[str]]:
    """Formats that read all values, by column, of the columns with values that
    ISO does not read. A column of no single format is not among them."""
    bits: dict[str, int] = {}
    for obs in observations:
        for k, v in (obs.get or {}).items():
            if k.endswith("__formats") and v is not None:
                col = k[: -len("__formats")]
                bits[col] = bits.get(col, -1) & v
    named = {c: fitting_formats(b) for c, b in bits.items() if c not in formats}
    return {c: names for c, names in named.items() if names and names[0] != "iso"}


def ingest(spark: SparkSession, source: str | list[str], table: str | None = None, *,
           database: str | None = None, if_exists: str = "replace", fmt: str | None = None,
           sep: str | None = None, encoding: str = "UTF-8", multi_line: bool = True,
           max_outside_rows: int = MAX_OUTSIDE_ROWS, max_outside_ratio: float = MAX_OUTSIDE_RATIO,
           fail_on_outside_month: bool = False, fail_on_bad_datetimes: bool = False,
           datetime_formats: dict[str, str] | None = None, analyze_columns: bool = False, compact_after: int | None = 64, cluster_by_time: bool = True,
           bucket_by: tuple[str, int] | None = None, fail_after: str | None = None) -> dict:
    """Load ``source`` (one path, a list, or a directory/glob) into ``table``.

    Returns the validation metrics plus ``status``, ``parts``,
    ``fraction_nulls`` and ``datetime_nulls`` (values nulled, by column);
    ``fail_on_bad_datetimes`` makes the latter an error before anything is
    published. Datetime text is read as ISO; if all values of a column are written
    in one other format of ``DATETIME_FORMATS``, the load is staged again with it
    (``datetime_formats`` of the result; ``datetime_ambiguous`` where several fit
    and the first was taken). ``datetime_formats`` names formats by column
    beforehand. ``cluster_by_time`` sorts each written file by the
    pickup datetime column (when there is one). ``bucket_by``, (column, number),
    deals the rows of every part into buckets of that column, sorted by it
    instead; appends and compaction keep it, and tables dealt alike join by the
    column without a shuffle. ``fail_after`` (tests) raises
    after the named stage.
    """
    sources = [source] if isinstance(source, str) else list(source)
    if if_exists not in POLICIES:
        raise UnsupportedStrategyError(f"unsupported if_exists strategy: {if_exists!r}")
    final = sanitize_ident(table or table_name_from_url(sources[0]))
    if database is not None and not database.strip():
        raise ValueError("database name must not be blank")
    db = sanitize_ident(database or spark.catalog.currentDatabase())
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")          # C7
    fq_final = pub.fq(db, final)
    f = _fmt_of(sources, fmt)

    exists = spark.catalog.tableExists(fq_final)
    buckets = bucket_by
    if exists:
        _, props = pub.published_state(spark, db, final)      # fails fast on a table not published here
        kept = pub.published_buckets(props)
        if if_exists == "append" and bucket_by not in (None, kept):
            raise ValueError(f"{fq_final} is dealt by {kept}; an append cannot deal its rows by {bucket_by}")
        buckets = bucket_by or kept
    if exists and if_exists == "skip":
        return {"status": "skipped", "table": fq_final}
    if exists and if_exists == "fail":
        raise TableExistsError(f"{fq_final} already exists")
    mode = "append" if (exists and if_exists == "append") else "replace"

    if fail_after is not None and fail_after not in STAGES:
        raise ValueError(f"fail_after must be one of {STAGES}")

    def _hook(stage_name: str) -> None:
        if fail_after == stage_name:
            raise IngestError(f"injected failure after {stage_name}")

    staged = None
    scratch: list[str] = []
    formats, ambiguous = dict(datetime_formats or {}), {}
    unknown = set(formats.values()) - set(DATETIME_FORMATS)
    if unknown:
        raise ValueError(f"unknown datetime formats {sorted(unknown)}; known are {list(DATETIME_FORMATS)}")
    try:
        target = spark.table(fq_final).schema if exists else None
        while True:
            conformed, target, observations = read_conformed(
                spark, sources, f, target, sep=sep, encoding=encoding, multi_line=multi_line, cleanup=scratch, formats=formats)
            _hook("read")
            if buckets and buckets[0] not in target.fieldNames():
                raise ValueError(f"no column {buckets[0]!r} to deal rows by")
            if cluster_by_time and not buckets:
                conformed = pub.time_sorted(conformed)
            staged = pub.physical_name(final, pub.new_run_id())   # known before the write, for cleanup
            pub.stage(conformed, db, final, staged, buckets)
            _hook("stage")
            written = _written(observations, formats)
            if not written:
                break
            # whole columns in another format: once more, with it
            ambiguous.update({c: names for c, names in written.items() if len(names) > 1})
            formats.update({c: names[0] for c, names in written.items()})
            pub.cleanup_best_effort(spark, pub.fq(db, staged))
        metrics = validate(spark.table(pub.fq(db, staged)), final, max_outside_rows,
                           max_outside_ratio, fail_on_outside_month)
        _hook("validate")
        undated = nulled(observations, "__undated")
        if undated and fail_on_bad_datetimes:
            raise BadDatetimeError(f"text that is no datetime of its column's format, by column: {undated}")
        # the policy is checked again right before the flip (another run may have published)
        if not exists and spark.catalog.tableExists(fq_final) and if_exists in ("skip", "fail"):
            if if_exists == "skip":
                pub.cleanup_best_effort(spark, pub.fq(db, staged))
                return {"status": "skipped", "table": fq_final}
            raise TableExistsError(f"{fq_final} was published by another run")
        parts = pub.publish_staged(spark, db, final, staged, mode, pub.bucket_props(buckets))
        _hook("publish")
        pub.analyze(spark, db, staged, analyze_columns)
        if compact_after and len(parts) > compact_after:
            parts = pub.compact(spark, db, final, compact_after)
        _hook("analyze")
    except BaseException:
        if staged is not None:
            still = pub.published_parts(spark, db, final) if spark.catalog.tableExists(fq_final) else None
            if not still or staged not in still:
                pub.cleanup_best_effort(spark, pub.fq(db, staged))
        raise
    finally:
        for t in scratch:
            pub.cleanup_best_effort(spark, t)
    fractions = nulled(observations, "__fractions")
    for col, n in fractions.items():
        log.warning("non-integer values in integer column %r set to NULL: %d", col, n)
    for col, n in undated.items():
        log.warning("text in datetime column %r that is no %s datetime set to NULL: %d", col, formats.get(col, "iso"), n)
    for col, names in ambiguous.items():
        log.warning("datetimes of column %r fit %s; read as %s", col, names, names[0])
    metrics.update(status=mode, table=fq_final, parts=parts, fraction_nulls=fractions, datetime_nulls=undated,
                   datetime_formats=formats, datetime_ambiguous=ambiguous)
    log.info("loaded %s (%s): %s rows", fq_final, mode, metrics.get("rowcount"))
    return metrics


def ingest_month(spark: SparkSession, dataset: str, year: int, month: int | str, *, base: str,
                 fmt: str = "parquet", **kwargs) -> dict:
    """Monthly file of a dataset into ``{dataset}_tripdata_{year}_{mm}`` (A1)."""
    return ingest(spark, month_path(base, dataset, year, month, fmt),
                  month_table(dataset, year, month), fmt=None, **kwargs)
