"""Records of large plain delimited files with quoted line breaks, by byte ranges.

A reader that starts in the middle of a file cannot know whether it stands inside
quotes, so Spark reads a file of multi-line records in one task. Here every range
is read twice. First a task finds, for each of its ranges, whether a quoted field
is open at its end if none, and if one, was open at its start: two bits, a
function that composes, so the state at each range's start is a running
composition over the ranges of its file. Then the lines of a range are joined to
records from that known state; what a range holds of a record that crosses its
border is a fragment, and only fragments are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = b"\xef\xbb\xbf"


def open_after(line: bytes, sep: bytes, inside: bool) -> bool:
    """Is a quoted field open after a line, if one was (``inside``) before it?

    A quote opens a field only as its first character; two in a quoted field are
    one of its characters; after the closing one, what follows up to the next
    separator belongs to the field and opens nothing.
    """
    if b'"' not in line:
        return inside
    if not inside and line[0] != 34:
        at = line.find(sep + b'"')
        if at < 0:
            return False
        at += 2
    else:
        at = 0 if inside else 1
    while True:
        close = line.find(b'"', at)
        if close < 0:
            return True
        if line[close + 1:close + 2] == b'"':
            at = close + 2
            continue
        at = line.find(sep + b'"', close + 1)
        if at < 0:
            return False
        at += 2


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, start, line, size): the lines of all ranges, in order inside a range."""
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.col("value").cast("binary").alias("line"), F.col("_metadata.file_size").alias("size")))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes], int]]:
    """(range, lines, file size) of a task, batch by batch, cut where a range ends."""
    for b in batches:
        files, starts, found, sizes = b.column(0).dictionary_encode(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_numpy()
        codes, names = files.indices.to_numpy(), files.dictionary.to_pylist()
        i = 0
        while i < len(found):
            j = i + 1
            while j < len(found) and starts[j] == starts[i] and codes[j] == codes[i]:
                j += 1
            yield (names[codes[i]], int(starts[i])), found[i:j], int(sizes[i])
            i = j


def range_states(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """(file, start, inside, begin, crlf, lone, cut): is a quoted field open at the start
    of each range, and the start of the range where that record begins; do the file's
    lines end in CR LF; is its first CR no part of one; does the file end in a line
    break inside quotes that never close."""
    mark = sep.encode()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[str, int], list] = {}
        sizes: dict[tuple[str, int], int] = {}
        for key, some, sizes[key] in _by_range(batches):
            first = key not in out
            state = out.setdefault(key, [False, True, False, False, False, 0])
            state[5] += sum(map(len, some)) + len(some)
            if first and key[1] == 0:
                state[2], state[3] = some[0].endswith(b"\r"), b"\r" in some[0][:-1]
            for line in some:
                if b'"' in line:
                    state[0], state[1] = open_after(line, mark, state[0]), open_after(line, mark, state[1])
                    state[4] = state[4] or not state[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int64()),
             *(pa.array([v[i] for v in out.values()], pa.bool_()) for i in range(5)),
             pa.array([v[5] for v in out.values()], pa.int64()), pa.array([sizes[k] for k in out], pa.int64())],
            ["file", "start", "if_closed", "if_open", "crlf", "lone", "ends", "ended", "size"])

    ranges = lines(spark, paths).mapInArrow(
        scan, "file string, start long, if_closed boolean, if_open boolean, crlf boolean, lone boolean, ends boolean, ended long, size long")
    # a range keeps the state, turns it over, or ends in one state whatever it was: the state
    # before a range is that of the last fixed end, turned as often as the ranges since turn it
    by_file = Window.partitionBy("file").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    ranges = (ranges.withColumn("turns", F.sum((F.col("if_closed") & ~F.col("if_open")).cast("long")).over(by_file))
              .withColumn("fixed", F.when(F.col("if_closed") == F.col("if_open"), F.struct("if_closed", "turns"))))
    last, turns = F.last("fixed", ignorenulls=True).over(before), F.coalesce(F.max("turns").over(before), F.lit(0))
    turned = (turns - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    whole = Window.partitionBy("file")
    ranges = ranges.withColumn("inside", F.coalesce(last["if_closed"], F.lit(False)) != turned)
    # a record that is open at a range's start began in the last range that it does not run through
    ranges = ranges.withColumn("begin", F.last(F.when(~F.col("inside") | F.col("ends"), F.col("start")), ignorenulls=True).over(before))
    after = F.when(F.col("inside"), F.col("if_open")).otherwise(F.col("if_closed"))
    # each line and a line break after it make up the file, but for the last one's where there is none
    cut = (F.max_by(after, "start").over(whole) & (F.sum("ended").over(whole) == F.col("size"))
           & (F.col("start") == F.max("start").over(whole)))
    return ranges.select("file", "start", "inside", "begin", F.max("crlf").over(whole).alias("crlf"), F.max("lone").over(whole).alias("lone"), cut.alias("cut"))


def records(spark: SparkSession, paths: list[str], sep: str) -> DataFrame | None:
    """(record, first) of all files: the text of each record that is not empty, and
    whether it is its file's first one. None where a file's lines end in CR alone.

    The driver receives two numbers for each range that starts inside quotes, and the names of files that have such ranges or CR LF line ends.
    """
    states = range_states(spark, paths, sep)
    odd = states.where("inside OR crlf OR lone OR cut").groupBy("file").agg(
        F.max("crlf").alias("crlf"), F.max("lone").alias("lone"), F.max(F.when(F.col("cut"), F.col("start"))).alias("cut"),
        F.collect_list(F.when(F.col("inside"), F.struct("start", "begin"))).alias("inside")).collect()
    if any(r.lone for r in odd):
        return None
    held = spark.sparkContext.broadcast({r.file: (r.crlf, {p.start: p.begin for p in r.inside}, r.cut) for r in odd})
    mark = sep.encode()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, crlf, last, parts, fresh, head, starts = None, False, False, None, [], False, False, {}
        out: list[tuple] = []

        def cut(key, text: bytes, kind: int | None, first: bool) -> None:
            """A record (kind None), or a fragment: 0 goes on from the range before, 1 begins here."""
            if text or kind is not None:
                out.append((text, first, *((None, None, None) if kind is None else (*key, key[1] if kind else starts[key[1]]))))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 5
            out.clear()
            types = pa.binary(), pa.bool_(), pa.string(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["record", "first", "file", "start", "begin"])

        def rest() -> None:
            if parts:  # with the line break that ends a file inside quotes
                cut(now, b"\n".join(parts if now[1] != last else [*parts, b""]), 0 if head else 1, fresh)

        for key, some, _ in _by_range(batches):
            if key != now:
                rest()
                crlf, starts, last = held.value.get(key[0], (False, {}, None))
                now, inside, parts = key, key[1] in starts, []
                head, fresh = inside, key[1] == 0
                if fresh and some[0].startswith(BOM):
                    some[0] = some[0][len(BOM):]
            for line in some:
                if crlf and line.endswith(b"\r"):
                    line = line[:-1]
                inside = open_after(line, mark, inside)
                if inside:
                    parts.append(line)
                    continue
                text = b"\n".join([*parts, line]) if parts else line
                cut(key, text, 0 if head else None, fresh)
                fresh = fresh and not text  # empty lines before the first record are none
                head, parts = False, []
            yield batch()
        rest()
        yield batch()

    found = lines(spark, paths).mapInArrow(join, "record binary, first boolean, file string, start long, begin long")
    whole = found.where("file IS NULL").select("record", "first")
    # fragments meet by the place where their record begins, so one large file's are dealt to all tasks
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", F.col("record").cast("string").alias("text")))), lambda p: p["text"]), "\n")
    crossing = (found.where("file IS NOT NULL").groupBy("file", "begin").agg(text.alias("record"), F.max("first").alias("first"))
                .select("record", "first"))
    return whole.select(F.col("record").cast("string").alias("record"), "first").unionByName(crossing)


def read_records(spark: SparkSession, paths: list[str], header: list[str], sep: str) -> DataFrame | None:
    """The rows of plain UTF-8 files that begin with ``header``, all columns text, named
    c0, c1, ...; what Spark's multi-line reader gives, read by many tasks. Another
    header in a file is an error. None where it cannot be split (see records)."""
    found = records(spark, paths, sep)
    if found is None:
        return None
    n = len(header)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    alike = (lambda c: c) if spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true" else F.lower
    names = F.from_csv("record", ", ".join(f"c{i} string" for i in range(n + 1)), options)
    same = F.coalesce(names[f"c{n}"], F.lit("")) == ""
    for i, name in enumerate(header):
        same = same & (alike(F.coalesce(names[f"c{i}"], F.lit(""))) == alike(F.lit(name)))
    wrong = F.raise_error(F.concat(F.lit(f"the header of a file does not match the columns {header}: "), "record"))
    rows = found.where(F.when(F.col("first"), F.when(same, F.lit(False)).otherwise(wrong.cast("boolean"))).otherwise(F.lit(True)))
    parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(n)), options)
    return rows.select(parsed.alias("r")).select(*(F.col(f"r.c{i}") for i in range(n)))
