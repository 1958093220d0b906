"""Delimited text scans (S1 CSV, S2 TSV) with raw-header handling.

Every field is read as text; typing happens in ``operators.conform``.
Spark binds an explicit schema by position, so each given path's header line
is read first (one record) and paths are grouped by header; each group is
read with a schema of its header names, which Spark checks against the
header of every file it opens (files inside one folder included). Large plain
files are read by many tasks, quoted line breaks or not (``split_text``).
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import DuplicateColumnsError, EmptyLoadError, UnsupportedFormatError
from tidemark.functions.identifiers import WHITESPACE_CHARS
from tidemark.sources.split_text import read_records

# Characters a delimiter may not be, per format.
_FORBIDDEN = {"csv": {"\n", "\r", "\t", "'", '"'}, "tsv": {"\n", "\r", "'", '"'}}
DEFAULT_SEP = {"csv": ",", "tsv": "\t"}


def check_delimiter(sep: str, fmt: str = "csv") -> str:
    if fmt not in _FORBIDDEN:
        raise UnsupportedFormatError(f"not a delimited format: {fmt!r}")
    usable = isinstance(sep, str) and len(sep) == 1 and sep not in _FORBIDDEN[fmt]
    if not usable:
        raise ValueError(f"{sep!r} cannot separate the fields of a {fmt} file: one character, no quote or line break")
    return sep


def _reader(spark: SparkSession, sep: str, encoding: str, multi_line: bool):
    return (spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
            .option("encoding", encoding).option("multiLine", str(multi_line).lower())
            .option("mode", "PERMISSIVE"))


def read_raw_header(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
                    multi_line: bool = True) -> list[str]:
    """First record of one file (or of the first file of a folder), as written."""
    first = (_reader(spark, sep, encoding, multi_line).option("header", "false")
             .csv(path).limit(1).collect())
    if not first:
        raise EmptyLoadError(f"no header row in {path}")
    return ["" if v is None else v for v in first[0]]


def read_header(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
                multi_line: bool = True) -> list[str]:
    """First record of one file, parsed with the data's quoting rules, names trimmed.

    Reads a single record (the scan stops after it). Duplicate names after
    trimming are an error, in CSV and TSV alike.
    """
    return _trimmed_unique(read_raw_header(spark, path, sep, encoding, multi_line), path, _case_sensitive(spark))


def _case_sensitive(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"


def _trimmed_unique(raw: list[str], path: str, case_sensitive: bool) -> list[str]:
    names = [v.strip(WHITESPACE_CHARS) for v in raw]
    seen, dups = set(), []
    for n in names:
        if n in seen:
            dups.append(n)
        seen.add(n)
    if dups:
        raise DuplicateColumnsError(f"duplicate columns in header of {path}: {sorted(set(dups))}")
    if not case_sensitive:
        folded = Counter(n.lower() for n in names)
        alike = [n for n in names if folded[n.lower()] > 1]
        if alike:
            raise DuplicateColumnsError(f"columns of {path} that differ only by case: {alike}; "
                                        "set spark.sql.caseSensitive=true to load them all")
    return names


def read_delimited(spark: SparkSession, paths: str | list[str], fmt: str = "csv", sep: str | None = None,
                   encoding: str = "UTF-8", multi_line: bool = True) -> list[tuple[list[str], DataFrame]]:
    """Return one (header, all-text DataFrame) per distinct header among ``paths``.

    ``multi_line`` keeps quoted newlines inside a field (pandas parity). Files of
    one split then go to Spark's reader, a task each, as ``.gz`` does anyway;
    larger plain files are joined to records by ranges, with the same rows.
    Turned off, Spark's reader splits files that have no embedded newlines.
    Short rows are padded with NULL, extra trailing fields are ignored.
    """
    sep = check_delimiter(sep if sep is not None else DEFAULT_SEP.get(fmt, ","), fmt)
    paths = [paths] if isinstance(paths, str) else list(paths)
    # one single-record job per given path, submitted concurrently (a folder or
    # glob is one path: its files are checked by Spark while reading)
    with ThreadPoolExecutor(max_workers=min(16, len(paths))) as pool:
        headers = list(pool.map(lambda p: read_raw_header(spark, p, sep, encoding, multi_line), paths))
    groups: OrderedDict[tuple[str, ...], list[str]] = OrderedDict()
    for p, h in zip(paths, headers):
        groups.setdefault(tuple(h), []).append(p)
    out = []
    for raw, group in groups.items():
        names = _trimmed_unique(list(raw), group[0], _case_sensitive(spark))
        # the schema carries the names as written and Spark checks every file's
        # header against it while reading (a folder whose files disagree fails
        # instead of binding columns by position); then names are trimmed
        if multi_line and splits_by_range(spark, group, sep, encoding):
            df = read_records(spark, group, list(raw), sep)
            if df is not None:
                out.append((names, df.toDF(*names)))
                continue
        schema = T.StructType([T.StructField(n, T.StringType(), True) for n in raw])
        df = (_reader(spark, sep, encoding, multi_line).option("header", "true")
              .option("enforceSchema", "false").schema(schema).csv(group))
        out.append((names, df.toDF(*names)))
    return out


def _bytes(text: str) -> int:
    """A size as Spark writes it: ``128m``, ``134217728b``, ``1gb``."""
    number, unit = re.fullmatch(r"\s*([0-9]+)\s*([a-z]?)b?\s*", text.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]


def splits_by_range(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> bool:
    """Is a file longer than one split, and can its ranges be read by themselves?
    Not where it is compressed, or in an encoding whose bytes hide separators."""
    if encoding.upper().replace("_", "-") not in ("UTF-8", "UTF8", "US-ASCII") or not sep.isascii():
        return False
    if all(p.lower().endswith(".gz") for p in paths):
        return False
    _, _, largest, gzipped = file_stats(spark, paths)
    return not gzipped and largest > _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def file_stats(spark: SparkSession, paths: list[str]) -> tuple[int, int, int, int]:
    """(files, total bytes, largest file bytes, gzip files) behind ``paths``.

    Plain text read line by line splits; gzip text does not.

    Spark's ``binaryFile`` source lists the files; the content column is
    never read, so this is one metadata-only job returning one row.
    """
    row = (spark.read.format("binaryFile").load(list(paths))
           .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.max("length").alias("largest"),
                F.count_if(F.lower("path").endswith(".gz")).alias("gzipped"))
           .first())
    return int(row["n"] or 0), int(row["total"] or 0), int(row["largest"] or 0), int(row["gzipped"] or 0)
