"""Exact substring dedup with suffix arrays, by two-stage sorting.

Every byte that lies in a ``width``-byte string found at two places of the
corpus, or more, is removed. Equal strings must meet in one task without the
corpus passing through one: each string is owned by the smallest hash of the
32-byte pieces inside it, so equal strings have equal owners, and neighbouring
strings with one owner travel together as a segment. Owners seen once need no
text at all; segments that repeat as a whole are found by counting. The texts
of what is left, one for each distinct segment, are sorted owner by owner with
a two-stage suffix array, whose adjacent common prefixes tell which strings
repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, as_bytes, concat, mix64, ranges, slices, slices_by_bytes, stored

#: Length of the strings that count as repeated.
WIDTH = 200
#: Length of the pieces that choose a string's owner (a power of two).
PIECE = 32
#: Distinct segments of one owner above which its strings are counted by
#: 128-bit fingerprints across tasks, instead of being sorted in one task.
HOT_SEGMENTS = 4096
#: Bytes of an owner's distinct segments above which they are counted so too.
HOT_BYTES = 1 << 20
#: Tasks over which the places of one counted string are dealt.
DEALT = 32
#: Bytes of segments that one suffix array takes, more only for a single owner.
ARRAY_BYTES = 1 << 19
#: Strings of a text that are looked at together; a segment is no longer.
CHUNK = 1 << 20

_SEEDS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9F4B, 0xD1B54A32D192ED03)


def window_hash(t: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of the ``width`` bytes from each position of ``t`` on, by
    doubling: a string's hash joins those of its halves."""
    base = _SEEDS[seed] | 1
    h = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(base))[t]
    out, got, size = None, 0, 1
    while True:
        if width & size:
            if out is None:
                out = h
            else:  # bytes already joined stand before these
                k = min(len(out), len(h) - got)
                out = out[:k] * np.uint64(pow(base, size, 1 << 64)) + h[got:got + k]
            got += size
        if got == width:
            return mix64(out[:max(0, len(t) - width + 1)])
        k = max(0, len(h) - size)
        h = h[:k] * np.uint64(pow(base, size, 1 << 64)) + h[size:size + k]
        size *= 2


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` neighbours."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    pad = -len(h) % w
    blocks = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def segments(texts: list[bytes], width: int = WIDTH, piece: int = PIECE):
    """(text number, first string, strings, owner, inner) of every segment: a
    longest run of neighbouring ``width``-byte strings with one owner. Inner:
    the owner stands in it twice, so strings may repeat inside the segment.

    Texts of more than ``CHUNK`` strings are taken a chunk at a time, which cuts
    the run at its border in two segments of one owner; equal strings meet by
    their owner all the same."""
    long = {i for i, t in enumerate(texts) if len(t) >= CHUNK + width}
    found = [_segments([b"" if i in long else t for i, t in enumerate(texts)], width, piece)]
    for i in sorted(long):
        for a in range(0, len(texts[i]) - width + 1, CHUNK):
            doc, first, *rest = _segments([texts[i][a:a + CHUNK + width - 1]], width, piece)
            found.append((doc + i, first + a, *rest))
    return tuple(np.concatenate(c) for c in zip(*found)) if long else found[0]


def _segments(texts: list[bytes], width: int, piece: int):
    t, off = concat(texts)
    pieces, w = window_hash(t, piece), width - piece + 1
    owner = _sliding_min(pieces, w)
    count = np.maximum(np.diff(off) - width + 1, 0)
    at = ranges(off[:-1], count)
    doc = np.repeat(np.arange(len(texts)), count)
    own = owner[at]
    head = np.flatnonzero(np.r_[len(own) > 0, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]) if len(own) else at
    size = np.diff(np.r_[head, len(own)])
    inner = np.zeros(len(head), bool)
    for a in range(0, len(head), 4096):
        part = slice(a, a + 4096)
        first, last = at[head[part]], at[head[part]] + size[part] - 1
        view = np.lib.stride_tricks.sliding_window_view(pieces, w)
        inner[part] = first + view[first].argmin(1) != last + w - 1 - view[last][:, ::-1].argmin(1)
    return doc[head], at[head] - off[doc[head]], size, own[head].view(np.int64), inner


# ---------------------------------------------------------- suffix array --
def two_stage_order(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` suffixes of ``t`` (ascending positions), in the order of
    their first ``depth`` bytes.

    Only suffixes smaller than their successor are sorted directly. Scanning
    the buckets of first bytes in ascending order, each suffix puts the one
    before it, if that is the larger, at the front end of its bucket.
    """
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    smaller = np.zeros(n, bool)  # than the successor; the text's end is smallest
    nxt = np.searchsorted(change, np.arange(n))
    has = nxt < len(change)
    edge = change[np.minimum(nxt, len(change) - 1)] if len(change) else np.zeros(n, np.int64)
    smaller[has] = t[edge[has]] < t[np.minimum(edge[has] + 1, n - 1)]
    # a larger suffix is placed by its successors, up to the first smaller one
    anchor = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
    needed = np.zeros(n + 2, np.int64)
    np.add.at(needed, wanted, 1)
    np.add.at(needed, np.minimum(anchor[wanted], n) + 1, -1)
    needed = np.cumsum(needed)[:n] > 0
    direct = np.flatnonzero(needed & smaller)
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")] if len(direct) else direct
    cuts = np.searchsorted(t[direct], np.arange(257))
    induce = needed & ~smaller
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and induce[n - 1]:
        front[t[n - 1]].append(np.array([n - 1]))
    out = []

    def before(x: np.ndarray) -> np.ndarray:
        x = x[x > 0] - 1
        return x[induce[x]]

    for c in np.flatnonzero(np.bincount(t[needed], minlength=256)) if n else []:
        wave = np.concatenate(front[c]) if front[c] else np.zeros(0, np.int64)
        bucket = [wave]
        while len(wave):  # larger suffixes of a run of one byte, shortest first
            wave = before(wave)
            wave = wave[t[wave] == c]
            bucket.append(wave)
        full = np.concatenate([*bucket, direct[cuts[c]:cuts[c + 1]]])
        out.append(full)
        put = before(full)
        to = t[put]
        put, to = put[to > c], to[to > c]
        order = np.argsort(to, kind="stable")
        ends = np.flatnonzero(np.r_[to[order][1:] != to[order][:-1], len(to) > 0]) + 1 if len(to) else []
        for part in np.split(put[order], ends)[:-1] if len(to) else []:
            front[t[part[0]]].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return order[keep[order]]


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one sorted before it, in whole
    8-byte words, or ``depth`` where at least that many bytes agree."""
    padded = np.concatenate([t, np.zeros(depth + 8, np.uint8)])
    word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        a, b = order[live] + k, order[live - 1] + k
        live = live[word[a] == word[b]]
        lcp[live] = min(k + 8, depth)
    return lcp


def repeated_strings(parts: list[bytes], width: int = WIDTH):
    """(part, first string, strings) of the runs of ``width``-byte strings that
    start at two places of ``parts`` or more."""
    t, off = concat(parts)
    count = np.maximum(np.diff(off) - width + 1, 0)
    wanted = ranges(off[:-1], count)
    order = two_stage_order(t, wanted, width)
    same = common_prefixes(t, order, width) >= width
    hit = np.zeros(len(t) + 1, bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    part = np.repeat(np.arange(len(parts)), count)
    on = np.flatnonzero(hit[wanted])
    part, at = part[on], wanted[on]
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])]) if len(on) else on
    return part[head], at[head] - off[part[head]], np.diff(np.r_[head, len(on)])


# -------------------------------------------------------------- operator --
def _keyed(docs: DataFrame, id_col: str, text: str) -> list[Column]:
    """Columns that identify a row by its id and whole text."""
    return [F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("_id"),
            F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("_hash")]


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
          hot: int = HOT_SEGMENTS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(_id, _hash, spans array<struct<first, end>>): for each row with any, the
    byte ranges covered by strings that start at two places or more."""
    rows = docs.select(*_keyed(docs, id_col, text), F.col(text).alias("_text"))

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(batches, 512):
            own, inner = segments(as_bytes(b.column(0)), width)[3:]
            got = np.unique(np.concatenate([own, own[inner]]), return_counts=True)
            held.append(got)
            n += len(got[0])
            if n > 1 << 19:
                yield emit(held)
                held, n = [], 0
        if held:
            yield emit(held)

    def emit(held: list) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["owner", "n"])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            texts = as_bytes(b.column(2))
            doc, first, size, own, inner = segments(texts, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)),
                 pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(inner)],
                ["owner", "_id", "_hash", "first", "size", "inner"])

    repeated = (rows.select("_text").mapInArrow(owners, "owner long, n long")
                .groupBy("owner").agg(F.sum("n").alias("n")).where("n > 1").select("owner"))
    # places of owners that repeat, gathered by row; copies of a row repeat them
    places = (rows.mapInArrow(located, "owner long, _id long, _hash long, first int, size int, inner boolean")
              .join(repeated, "owner").groupBy("_id", "_hash")
              .agg(F.collect_set(F.struct("first", "size", "owner", "inner")).alias("places")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], [], [], [], [], []]
            for i, h, t, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)),
                                      b.column(3).to_pylist()):
                for p in found:
                    seg = t[p["first"]:p["first"] + p["size"] + width - 1]
                    print_ = hashlib.blake2b(seg, digest_size=8).digest()
                    for col, x in zip(out, (p["owner"], int.from_bytes(print_, "little", signed=True), i, h, p["first"],
                                           len(seg), p["inner"], seg)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32()),
                 pa.array(out[6], pa.bool_()), pa.array(out[7], pa.binary())],
                ["owner", "print", "_id", "_hash", "first", "bytes", "inner", "segment"])

    cuts = stored(rows.join(places, ["_id", "_hash"]).select("_id", "_hash", "_text", "places")
                  .mapInArrow(cut, "owner long, print long, _id long, _hash long, first int, bytes int, inner boolean, segment binary"),
                  "segments")
    # one row for each distinct segment; those that repeat are covered whole
    kinds = (cuts.groupBy("owner", "print")
             .agg(F.count("*").alias("n"), F.max("inner").alias("inner"), F.max("bytes").alias("bytes"),
                  F.min(F.struct("_id", "_hash", "first")).alias("at")))
    kinds = stored(kinds, "kinds")
    varied = (kinds.groupBy("owner").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner"), F.sum(F.col("bytes").cast("long")).alias("bytes"))
              .where("kinds > 1 or inner").select("owner", ((F.col("kinds") > hot) | (F.col("bytes") > hot_bytes)).alias("large")))
    whole = (cuts.select("owner", "print", "_id", "_hash", "first", "bytes")
             .join(kinds.where("n > 1").select("owner", "print"), ["owner", "print"])
             .select("_id", "_hash", "first", (F.col("first") + F.col("bytes")).alias("end")))
    alone = (kinds.join(varied, "owner")
             .select("owner", "print", "n", "large", F.col("at._id").alias("_id"), F.col("at._hash").alias("_hash"),
                     F.col("at.first").alias("first")))
    texts = (cuts.join(alone, ["owner", "print", "_id", "_hash", "first"])
             .dropDuplicates(["owner", "print"])
             .select("owner", "large", "n", "_id", "_hash", "first", "segment"))
    texts = stored(texts, "kind-texts")

    def sort_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, total = [], None, 0
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(6))):
                if total > ARRAY_BYTES and r[0] != last:
                    yield sort(held)
                    held, total = [], 0
                held.append(r)
                last, total = r[0], total + len(r[5])
        if held:
            yield sort(held)

    def sort(held: list[tuple]) -> pa.RecordBatch:
        part, first, size = repeated_strings([r[5] for r in held], width)
        out = [(held[p][2], held[p][3], held[p][4] + a, held[p][4] + a + s + width - 1)
               for p, a, s in zip(part.tolist(), first.tolist(), size.tolist()) if held[p][1] == 1]
        return spans_batch(out)

    def spans_batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
             pa.array(cols[3], pa.int32())], ["_id", "_hash", "first", "end"])

    span_type = "_id long, _hash long, first int, end int"
    sorted_ = (texts.where("not large").select("owner", "n", "_id", "_hash", "first", "segment")
               .repartition("owner").sortWithinPartitions("owner").mapInArrow(sort_owner, span_type))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices_by_bytes(batches, 4, CHUNK):
            segs = as_bytes(b.column(4))
            t, off = concat(segs)
            count = np.diff(off) - width + 1
            at, part = ranges(off[:-1], count), np.repeat(np.arange(len(segs)), count)
            a, c = (window_hash(t, width, s)[at].view(np.int64) for s in (1, 2))
            take = pa.array(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(c), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take),
                 pa.array((np.array(b.column(3))[part] + at - off[part]).astype(np.int32))],
                ["a", "b", "n", "_id", "_hash", "first"])

    single = (texts.where("large").select("n", "_id", "_hash", "first", "segment")
              .mapInArrow(strings, "a long, b long, n long, _id long, _hash long, first int"))
    # a string may stand in a large part of the places: each is dealt over some tasks
    often = (single.groupBy("a", "b").count().where("count > 1")
             .select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("salt")))
    counted = (single.where("n = 1").withColumn("salt", F.pmod(F.xxhash64("_id", "first"), F.lit(DEALT)).cast("int")).join(often, ["a", "b", "salt"])
               .select("_id", "_hash", "first", (F.col("first") + width).alias("end")))
    return (whole.unionByName(sorted_).unionByName(counted)
            .groupBy("_id", "_hash").agg(F.collect_set(F.struct("first", "end")).alias("spans")))


def removed_runs(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the (first, end) ranges, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def _with_spans(docs: DataFrame, id_col: str, text: str, width: int, hot: int, hot_bytes: int = HOT_BYTES) -> DataFrame:
    found = spans(docs, id_col, text, width, hot, hot_bytes)
    names = docs.columns
    both = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], *_keyed(docs, id_col, text))
    return both.join(found, ["_id", "_hash"], "left").select(*[f"c{k}" for k in range(len(names))], "spans")


def _runs(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [removed_runs([(s["first"], s["end"]) for s in x or ()]) for x in column.to_pylist()]


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                 hot: int = HOT_SEGMENTS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    A null text is empty. Texts below ``width`` bytes lose nothing. A repeated
    row is a document of its own, so both copies lose what they share. Null
    ids are kept as null; other columns are not read.
    """
    pair = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(len(t), sum(y - x for x, y in r), len(r), hashlib.sha256(_kept(t, r)).hexdigest())
                    for t, r in zip(as_bytes(b.column(1)), _runs(b.column(2)))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]),
                                              pa.array(cols[3], pa.string())],
                                             [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _with_spans(pair, "i", "t", width, hot, hot_bytes).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                   hot: int = HOT_SEGMENTS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs`` with all columns, repeated bytes cut out of the text.

    A cut inside a character of several bytes leaves its other bytes behind;
    those are dropped, so that the text stays valid UTF-8. A null text stays
    null, and a text that repeats as a whole becomes empty.
    """
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = [None if null else _kept(t, r).decode("utf-8", "ignore") for t, r, null in
                    zip(as_bytes(b.column(at)), _runs(b.column(b.num_columns - 1)), b.column(at).is_null().to_pylist())]
            cols = [pa.array(kept, b.column(at).type) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return _with_spans(docs, id_col, text, width, hot).mapInArrow(run, docs.schema)
