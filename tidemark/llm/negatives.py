"""Hard negatives of anchor rows, by exact integer products of tiles.

Every vector becomes whole numbers. A task holds a tile of candidates, meets
the anchors in tiles, and multiplies the two by Strassen's recursion: seven
products of half the size instead of eight, odd sides padded with zeros, all
additions exact (they wrap at 64 bits, and wrap back, as a score itself fits).
A first round keeps a heap of the best same-label rows for each anchor, a
second a heap for each anchor and positive of the other-label rows inside the
positive's score window. Heaps of different tiles merge: the best of two heaps
are the best of both tiles, so tasks send only heaps, never scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_lists, finite, lists_as_rows, stored

#: Candidates that a task holds at a time, and rows of the tiles multiplied.
CELL_ROWS, TILE_ROWS, TILE_ANCHORS = 8192, 4096, 256
#: Sides up to this long are multiplied directly.
LEAF = 16
#: Rows of a label's and of the other labels' heap.
POSITIVES, NEGATIVES = 5, 10
#: Largest squared length of an integer vector: any score then fits a long.
LARGEST = 2.0 ** 62


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 matrix product, exact where the true entries fit 64 bits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ij,jk->ik", a, b)
    odd = [(s % 2) for s in (m, k, n)]
    if any(odd):
        a, b = (np.pad(x, ((0, p), (0, q))) for x, p, q in ((a, odd[0], odd[1]), (b, odd[1], odd[2])))
        return strassen(a, b, leaf)[:m, :n]
    (a11, a12), (a21, a22) = ((a[i:i + m // 2, :k // 2], a[i:i + m // 2, k // 2:]) for i in (0, m // 2))
    (b11, b12), (b21, b22) = ((b[i:i + k // 2, :n // 2], b[i:i + k // 2, n // 2:]) for i in (0, k // 2))
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:m // 2, :n // 2] = p1 + p4 - p5 + p7
    out[:m // 2, n // 2:] = p3 + p5
    out[m // 2:, :n // 2] = p2 + p4
    out[m // 2:, n // 2:] = p1 - p2 + p3 + p6
    return out


def window(positive: np.ndarray, low: int = 30, high: int = 90) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole score s with low * p <= 100 * s <= high * p, without
    products that could leave 64 bits."""
    tens, rest = positive // 100, positive % 100
    return low * tens - (-low * rest) // 100, high * tens + (high * rest) // 100


def integers(rows: DataFrame) -> DataFrame:
    """(id, label, x, asked): the rows of (id, label, v, asked) that take part, with
    whole components, each once."""
    kind = rows.schema["id"].dataType.simpleString()
    named = rows.select("id", F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"),
                        "asked").where("id is not null and label is not null and v is not null")
    common = named.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = common.n if common else 0

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = finite(b.column(2), dim)
            v = np.floor(256 * v)
            if (v * v).sum(1).max(initial=0) > LARGEST:
                raise OverflowError("a vector is so long that its scores would not fit 64 bits")
            own = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), as_lists(v.astype(np.int64)), own.column(3)], ["id", "label", "x", "asked"])

    return (named.mapInArrow(whole, f"id {kind}, label long, x array<long>, asked boolean")
            .groupBy("id", "label", "x").agg(F.max("asked").alias("asked")))


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where rows with new keys begin, and the end."""
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(np.r_[True, new, True])


def heap(owner: np.ndarray, key: np.ndarray, score: np.ndarray, size: int) -> np.ndarray:
    """Positions of each owner's ``size`` best: largest score, then smallest key.
    The heap of two heaps' rows is the heap of all rows that they were made of."""
    order = np.lexsort((key, -score, owner))
    if not len(order):
        return order
    head = _edges(owner[order])
    nth = np.arange(len(order)) - np.repeat(head[:-1], np.diff(head))
    return order[nth < size]


def column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().to_numpy(zero_copy_only=False)


def scores(who: pa.Table, cand: pa.Table) -> np.ndarray:
    """Inner products of all rows of two tiles."""
    a, b = (lists_as_rows(t["x"]) for t in (who, cand))
    return strassen(a, np.ascontiguousarray(b.T))


def same_label(who: pa.Table, cand: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    """(anchor, id, score) of the positives a tile offers."""
    s, cid = scores(who, cand), column(cand, "id")
    free = column(who, "id")[:, None] != cid[None]
    if len(cid) > 4 * size:  # what scores less than the last place cannot be in the heap
        free &= s >= np.partition(np.where(free, s, np.iinfo(np.int64).min), len(cid) - size, 1)[:, len(cid) - size, None]
    at, other = np.nonzero(free)
    return at, cid[other], s[at, other]


def other_labels(who: pa.Table, cand: pa.Table, low: int, high: int, size: int) -> tuple[np.ndarray, ...]:
    """(nth positive of all the anchors', id, score) of the negatives a tile offers."""
    s, cid = scores(who, cand), column(cand, "id")
    free = (column(who, "label")[:, None] != column(cand, "label")[None]) & (column(who, "id")[:, None] != cid[None])
    anchor, _, positive = listed(who)
    lo, hi = window(positive, low, high)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for p, a in enumerate(anchor):  # the rows inside the window of one positive of one anchor
        at = np.flatnonzero((s[a] >= lo[p]) & (s[a] <= hi[p]) & free[a])
        if len(at) > 4 * size:  # what scores less than the last place cannot be in the heap
            at = at[s[a][at] >= np.partition(s[a][at], len(at) - size)[len(at) - size]]
        found.append((np.full(len(at), p), at))
    of, other = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), ())))
    return of, cid[other], s[anchor[of], other]


def listed(who: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, id, score) of all positives in the anchors' lists."""
    lists = who["best"].combine_chunks()
    flat = lists.flatten()
    return (np.repeat(np.arange(len(who)), np.diff(lists.offsets.to_numpy())),
            *(flat.field(f).to_numpy(zero_copy_only=False) for f in ("positive_id", "score")))


def over_tiles(offers: Callable[..., tuple], size: int, finish: Callable[..., list[np.ndarray]], names: list[str]):
    """Task over rows sorted by cell, candidates before anchors: keeps the heaps
    of what each tile of candidates ``offers`` to a tile of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cands = None, [], None
        for b in batches:
            group, cell, asked = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = _edges(group, cell, asked) if b.num_rows else []
            for a, z in zip(edges, edges[1:]):
                part = pa.Table.from_batches([b.slice(a, z - a)])
                if (group[a], cell[a]) != now:
                    now, held, cands = (group[a], cell[a]), [], None
                if not asked[a]:
                    held.append(part)
                    continue
                if cands is None and held:
                    cands = pa.concat_tables(held)
                for i in range(0, z - a if cands else 0, TILE_ANCHORS):
                    who, best = part.slice(i, TILE_ANCHORS), None
                    for j in range(0, len(cands), TILE_ROWS):
                        new = offers(who, cands.slice(j, TILE_ROWS))
                        new = [np.concatenate(c) for c in zip(best, new)] if best else new
                        keep = heap(*new, size)
                        best = [c[keep] for c in new]
                    types = {"id": b.schema.field("id").type}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, types["id"] if n.endswith("id") else pa.int64()) for n, c in zip(names, finish(who, *best))], names)

    return run


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that the condition ``anchors`` (on the columns of
    ``vectors``) holds for. An anchor's positives are the ``positives`` rows of
    its label with the largest scores; for each, the ``negatives`` best rows of
    other labels with low % to high % of the positive's score. Ties go to the
    smaller id; fewer rows give fewer. A positive of negative score has an empty
    window, one of score 0 the negatives of score 0.

    Rows with a null id, a null label, a null vector, a null or non-finite
    component, or a vector whose length is not the most common one take no part.
    Repeated rows count once. Rows that share an id but differ are rows of their
    own, never each other's positive or negative. An empty table gives no rows.
    Vectors too long for 64-bit scores (components of a million and more) raise.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = integers(vectors.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label}`") if isinstance(label, str) else label).alias("label"),
                                   F.col(f"`{vector}`").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked")))
    rows = stored(rows.withColumn("twin", F.xxhash64("label", "x")), "integers")
    cells = max(1, -(-rows.count() // cell_rows))
    cell = F.pmod(F.xxhash64("id", "twin"), F.lit(cells))  # a label of a third of all rows is dealt over as many cells as all rows
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")

    def met(group: Column, asked: DataFrame, *more: str) -> DataFrame:
        """The rows of each cell, then the anchors that they are compared with."""
        plain = ["id", "twin", "label", "x"]
        here = rows.select(group, cell.alias("cell"), F.lit(False).alias("asked"), *plain, *(F.lit(None).cast(asked.schema[m].dataType).alias(m) for m in more))
        there = asked.select(group, every, F.lit(True).alias("asked"), *plain, *more)
        return here.unionByName(there).repartition("group", "cell").sortWithinPartitions("group", "cell", "asked", "id")

    task = over_tiles(lambda who, cand: same_label(who, cand, positives), positives, lambda who, at, key, s: [column(who, "id")[at], column(who, "twin")[at], key, s],
                      ["id", "twin", "positive_id", "score"])
    offered = met(F.col("label").alias("group"), rows.where("asked")).mapInArrow(task, f"id {kind}, twin long, positive_id {kind}, score long")
    first = Window.partitionBy("id", "twin").orderBy(F.desc("score"), "positive_id")
    best = (offered.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives)
            .groupBy("id", "twin").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "score"))).alias("best")))

    def named(who: pa.Table, of: np.ndarray, key: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        anchor, positive, value = listed(who)
        return [column(who, "id")[anchor[of]], column(who, "twin")[anchor[of]], positive[of], value[of], key, s]

    task = over_tiles(lambda who, cand: other_labels(who, cand, low, high, negatives), negatives, named,
                      ["anchor_id", "twin", "positive_id", "positive_score", "negative_id", "negative_score"])
    found = (met(F.lit(0).alias("group"), rows.where("asked").join(best, ["id", "twin"]), "best")
             .mapInArrow(task, f"anchor_id {kind}, twin long, positive_id {kind}, positive_score long, negative_id {kind}, negative_score long"))
    place = Window.partitionBy("anchor_id", "twin", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
