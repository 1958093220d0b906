"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader cuts archives into byte
ranges without any index: a task looks for the gzip magic in its range, takes
a place for a record if a member that decodes to a WARC header starts there,
and owns the records that start inside its range, reading past its end to
finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, slices, spread, stored
from tidemark.llm.files import new_folder, open_folder, unique_name

#: Bytes after which a task starts another archive, and of a reader's range.
ARCHIVE_BYTES, RANGE_BYTES = 1 << 28, 1 << 22
#: Payloads from this size on are written once and revisited.
MIN_REVISIT_BYTES = 0
#: Fixed values of the format.
MAGIC, END = b"\x1f\x8b\x08", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_READ = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit carries no payload, but its
    digest and, in an extension field, its length."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page), "WARC-Date": DATE,
            "WARC-Payload-Digest": "sha1:" + digest(payload), "X-Payload-Length": str(len(payload)),
            "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(lines.encode() + block + END) + pack.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
          min_revisit: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row; returns the archives (file, bytes, records).

    Of rows with equal payloads of at least ``min_revisit`` bytes, that with
    the largest id is a response and the others revisit it; rows that share
    the largest id are all responses. A null payload is empty, a null url is
    left out, and a null id is below every other.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    often = (rows.where(F.octet_length("html") >= min_revisit).groupBy("sha")
             .agg(F.count("*").alias("n"), F.max("page").alias("top")).where("n > 1").select("sha", "top"))
    rows = (rows.join(often, "sha", "left").select(
        "page", "url", "html", "top", (F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top"))).alias("revisit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        part, out, done = TaskContext.get().partitionId(), None, []
        for b in slices(batches):
            pages_, urls, tops, again = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            for page, link, html, top, revisit in zip(pages_, urls, as_bytes(b.column(2)), tops, again):
                if out is None or size >= archive_bytes:
                    if out is not None:
                        out.close()
                        done.append((name, size, n))
                    name, size, n = unique_name(f"part-{part:06d}", ".warc.gz"), 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page, link, html, top, revisit)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            done.append((name, size, n))
        cols = list(zip(*done)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.int64())], ["file", "bytes", "records"])

    return stored(rows.mapInArrow(run, "file string, bytes long, records long"), "archives")


class _Window:
    """Bytes of a file from ``start`` on, read as far as they are asked for."""

    def __init__(self, f, start: int, size: int):
        self.f, self.start, self.size, self.data = f, start, size, bytearray()

    def upto(self, n: int) -> bool:
        """Whether ``n`` bytes could be read."""
        more = min(self.start + n, self.size) - self.start - len(self.data)
        if more > 0:
            self.data += self.f.read_at(max(more, min(1 << 20, self.size - self.start - len(self.data))), self.start + len(self.data))
        return len(self.data) >= n


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """(content, compressed length) of the record's gzip member at ``at``, or
    None if none starts there."""
    pack, out, i = zlib.decompressobj(31), [], at
    try:
        while not pack.eof:
            w.upto(i + _READ)
            piece = bytes(w.data[i:i + _READ])
            if not piece:
                return None
            out.append(pack.decompress(piece))
            i += len(piece)
            if out[0] and not out[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(out), i - len(pack.unused_data) - at


def parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """(fields, block) of a record, None unless it is whole."""
    head, found, rest = content.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    return (fields, rest[:int(length)]) if length.isdigit() and len(rest) >= int(length) else None


def records(f, size: int, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an open archive that start in [start, stop)."""
    w, at = _Window(f, start, size), 0
    w.upto(stop - start + len(MAGIC))
    while True:
        at = w.data.find(MAGIC, at)
        if at < 0 or start + at >= stop:
            return
        member = _member(w, at)
        found = parse(member[0]) if member else None
        if found:
            yield found
            at += member[1]
        else:
            at += 1


def read(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)
    of every record of the archives, by byte ranges. A response's digest is
    computed from its payload and must be the one in its header; a revisit has
    no payload of its own and reports its header's digest and length."""
    ranges = (archives.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start")))
    ranges = spread(ranges, "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for b in batches:
            for file, size, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows = []
                with fs.open_input_file(f"{path}/{file}") as f:
                    for fields, block in records(f, size, start, min(size, start + range_bytes)):
                        rows.append(_row(fields, block))
                        if len(rows) == 256:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return ranges.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to long, payload binary")


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind, page = fields["warc-type"], _page(fields["warc-record-id"])
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        return page, int(fields["x-payload-length"]), told, kind, _page(fields["warc-refers-to"]), None
    payload = block.partition(END)[2]
    if digest(payload) != told:
        raise ValueError(f"payload of record {fields['warc-record-id']} does not have the digest of its header")
    return page, len(payload), told, kind, None, payload


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` and read the archives back, without the payloads."""
    folder = new_folder(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder).drop("payload")
