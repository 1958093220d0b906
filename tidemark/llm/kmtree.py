"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row descends it to one leaf. A
query walks the tree best bin first: a priority queue holds the children of
the nodes seen, and the one whose centre has the largest inner product with
the query is opened next, until it has visited a number of leaves. That number
is calibrated: on sample queries, against brute force, it is widened until the
target recall is reached. Leaves are packed into bins of bounded size, large
leaves cut into several, and each query meets the rows of its leaves there.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

#: Most rows of the sample that the tree is fitted on.
SAMPLE_ROWS = 50_000
#: Children of a node, sample rows of a leaf at most, and rounds of k-means.
BRANCH, LEAF_ROWS, ROUNDS = 8, 48, 8
#: Mean recall that the number of visited leaves is widened to, and how many
#: sample queries measure it.
RECALL, PROBES = 0.98, 200
#: Rows of a bin, and queries compared with them at a time.
BIN_ROWS, QUERIES = 4096, 512


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the row's nearest centre, empty ones left out."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        _, at = np.unique(at, return_inverse=True)
        n = np.bincount(at)
        c = np.stack([np.bincount(at, x[:, d]) for d in range(x.shape[1])], 1) / n[:, None]
    return c, at


@dataclass
class Tree:
    """Nodes with the centres of their children; a negative child is a leaf."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0
    visits: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 7, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)

        def grow(rows: np.ndarray) -> int:
            c, at = _kmeans(rows, branch, rng) if len(rows) > leaf_rows else (None, None)
            if c is None or len(c) < 2:  # small, or all rows alike
                tree.leaves += 1
                return -tree.leaves
            node = len(tree.centres)
            tree.centres.append(c)
            tree.children.append(np.zeros(0, np.int64))
            tree.children[node] = np.array([grow(rows[at == k]) for k in range(len(c))])
            return node

        root = grow(x)
        if root < 0:  # one leaf for all
            tree.centres, tree.children = [np.zeros((1, x.shape[1]))], [np.array([-1])]
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child's, from the root down."""
        leaf, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            c = self.centres[node]
            at = ((c * c).sum(1)[None] - 2 * x[rows] @ c.T).argmin(1)
            for k, child in enumerate(self.children[node].tolist()):
                own = rows[at == k]
                if len(own) and child < 0:
                    leaf[own] = -child - 1
                elif len(own):
                    todo.append((child, own))
        return leaf

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """The first leaves of the best-bin-first walk."""
        out: list[int] = []
        queue = [(-math.inf, 0)]
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                continue
            for s, child in zip((self.centres[node] @ q).tolist(), self.children[node].tolist()):
                heapq.heappush(queue, (-s, child))
        return out

    def calibrate(self, x: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES, seed: int = 3) -> float:
        """Widen the visits until the mean recall of ``k`` neighbours among the
        sample reaches the target; returns the recall measured."""
        rng = np.random.default_rng(seed)
        picks = rng.choice(len(x), min(probes, len(x)), replace=False)
        leaf, needed = self.assign(x), []
        for p in picks:
            s = x @ x[p]
            s[p] = -np.inf
            top = np.argsort(-s, kind="stable")[:min(k, len(x) - 1)]
            rank = np.zeros(self.leaves, np.int64)
            rank[self.visit(x[p], self.leaves)] = np.arange(self.leaves)
            needed.append(np.sort(rank[leaf[top]]) + 1)
        needed = [n for n in needed if len(n)]
        if not needed:
            return 1.0
        weights = np.concatenate([np.full(len(n), 1 / len(n)) for n in needed])
        found = np.bincount(np.concatenate(needed), weights, self.leaves + 1).cumsum() / len(needed)
        self.visits = min(self.leaves, int(np.searchsorted(found, min(recall, found[-1] - 1e-12))))
        return float(found[self.visits])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of ``dim`` components each, as rows; a null component is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def usable(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, vectors) of the rows that take part: of ``dim`` finite
    components, not all zero."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    x = matrix(column.take(pa.array(at)), dim)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[ok], x[ok]


def search(vectors: DataFrame, queries, id_col: str = "vec_id", vector: str = "embedding", k: int = 20,
           sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, bin_rows: int = BIN_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows with the largest inner
    product to each row that the condition ``queries`` holds for.

    A query's own row is no candidate of it (rows that share its id neither).
    Vectors that are null, zero, not finite, hold a null, or whose length is
    not the most common one, take no part; nor do rows with a null id. Ties go
    to the smaller id; fewer candidates give fewer rows; repeated rows are one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("is_query")).where("id is not null and v is not null").distinct()
    rows = stored(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    out_type = f"query_id {kind}, rank int, vec_id {kind}, score double"
    dim = common.n if common else 0
    if not dim:
        return spark.createDataFrame([], out_type)
    share = min(1.0, sample_rows / common["count"])
    picked = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()
    x = usable(picked["v"], dim)[1]
    x = x[np.lexsort(x.T)]  # the same tree, however the rows arrive
    if not len(x):
        return spark.createDataFrame([], out_type)
    tree = Tree.fit(x)
    tree.calibrate(x, k, recall)
    held = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            at, x = usable(b.column(1), dim)
            own = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(held.value.assign(x))], ["id", "v", "is_query", "leaf"])

    index = stored(rows.mapInArrow(place, f"id {kind}, v array<double>, is_query boolean, leaf long"), "index")
    sizes = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row for each leaf
    first, parts, at, fill = {}, {}, 0, 0
    for leaf in sorted(sizes):
        n = sizes[leaf]
        if fill and fill + n > bin_rows:
            at, fill = at + 1, 0
        first[leaf], parts[leaf] = at, max(1, math.ceil(n / bin_rows))
        fill += n
        if parts[leaf] > 1:
            at, fill = at + parts[leaf], 0
    bins = spark.sparkContext.broadcast((first, parts))
    places = spark.createDataFrame([(leaf, first[leaf], parts[leaf]) for leaf in sizes], "leaf long, bin0 long, parts long")
    targets = (index.join(F.broadcast(places), "leaf")  # no more rows than the tree has leaves
               .select((F.col("bin0") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("bin"), "id", "v", "leaf",
                       F.lit(None).cast("array<long>").alias("leaves")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = bins.value
        for b in slices(batches, 512):
            out: list[tuple] = []
            for i, q in enumerate(matrix(b.column(1), dim)):
                goes: dict[int, list[int]] = {}
                for leaf in held.value.visit(q, held.value.visits):
                    for p in range(parts.get(leaf, 0)):
                        goes.setdefault(first[leaf] + p, []).append(leaf)
                out += [(bin_, i, leaves) for bin_, leaves in goes.items()]
            cols = list(zip(*out)) or [()] * 3
            take = pa.array(cols[1], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), b.column(0).take(take), b.column(1).take(take),
                 pa.nulls(len(out), pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], ["bin", "id", "v", "leaf", "leaves"])

    asked = (index.where("is_query").select("id", "v")
             .mapInArrow(walk, f"bin long, id {kind}, v array<double>, leaf long, leaves array<bigint>"))
    met = (targets.unionByName(asked).repartition("bin")
           .sortWithinPartitions("bin", F.col("leaf").isNull(), "leaf", "id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cand, rows, places = None, [], None, None, {}
        for b in batches:
            bins, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), dim)
            leaf, asked_ = b.column(3).to_numpy(zero_copy_only=False), b.column(3).is_null().to_numpy(zero_copy_only=False)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            edges = np.flatnonzero(np.r_[True, (bins[1:] != bins[:-1]) | (asked_[1:] != asked_[:-1]), True]) if len(bins) else []
            for a, z in zip(edges, edges[1:]):
                if bins[a] != now:
                    now, held, cand, places = bins[a], [], None, {}
                if not asked_[a]:  # rows of a bin come before its queries
                    held.append((ids[a:z], x[a:z], leaf[a:z].astype(np.int64)))
                    continue
                if cand is None and held:
                    cand, rows, leaves = (np.concatenate(c) for c in zip(*held))
                    cuts = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1], True])
                    places = {int(leaves[c]): slice(c, d) for c, d in zip(cuts, cuts[1:])}
                for i in range(a, z if places else a, QUERIES):
                    j = min(i + QUERIES, z)
                    lists = b.column(4).slice(i, j - i)
                    who, wants = np.repeat(np.arange(j - i), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
                    found.append(near(ids[i:j], x[i:j], who, wants, cand, rows, places))
            yield best_of(found, b.column(1).type)

    def near(ids: np.ndarray, x: np.ndarray, who: np.ndarray, wants: np.ndarray, cand: np.ndarray, rows: np.ndarray, places: dict[int, slice]):
        """(query, candidate, score) of the best rows of a bin for queries, each in
        the leaves that it ``wants``; fast products find them, exact ones score them."""
        rough = np.full((len(ids), len(cand)), -np.inf)
        order = np.argsort(wants, kind="stable")
        cuts = np.flatnonzero(np.r_[True, wants[order][1:] != wants[order][:-1], True]) if len(wants) else []
        for c, d in zip(cuts, cuts[1:]):
            own, at = who[order[c:d]], places.get(int(wants[order[c]]))
            if at is not None:
                rough[own, at] = x[own] @ rows[at].T
        rough[ids[:, None] == cand[None]] = -np.inf  # not the query itself
        least = np.full(len(ids), -np.finfo(np.float64).max)
        if len(cand) > k:  # what is below the k-th by more than the rounding cannot be among the best
            size = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", rows, rows).max())
            least = np.maximum(least, np.partition(rough, len(cand) - k, 1)[:, len(cand) - k] - 1e-12 * size)
        at, other = np.nonzero(rough >= least[:, None])
        return ids[at], cand[other], np.einsum("ij,ij->i", x[at], rows[other])  # the same sum for equal vectors

    def best_of(found: list, id_type: pa.DataType) -> pa.RecordBatch:
        q, c, s = (np.concatenate(z) if found else np.zeros(0) for z in (zip(*found) if found else ((), (), ())))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        if len(q):
            head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            ok = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)])) < k
            q, c, s = q[ok], c[ok], s[ok]
        return pa.RecordBatch.from_arrays([pa.array(q, id_type), pa.array(c, id_type), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.mapInArrow(compare, f"query_id {kind}, vec_id {kind}, score double")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
