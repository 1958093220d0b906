"""Whitening of embeddings by QDWH spectral divide and conquer.

Vectors become whole numbers; each distinct one enters the statistics once.
Sums and second moments of the vectors less their rounded mean are added up as
exact integers by Spark, so the covariance does not depend on the order of the
rows or on lost tasks. A matrix of (components of a vector) squared reaches the
driver, which splits it: the polar factor of the covariance less a shift, found
by QR-based dynamically weighted Halley steps, gives the projector onto the
eigenvectors above the shift; both sides are split again until a subspace is a
component. The components are broadcast and every row is projected on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_lists, finite, lists_as_rows, passing, slices

#: Components that are returned.
COMPONENTS = 4
EPS = float(np.finfo(np.float64).eps)


# ------------------------------------------------------- spectral division --
def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its matrix sign."""
    size = float(np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max()))
    x, low, eye = a / size, EPS, np.eye(len(a))
    for _ in range(20):
        # the weights that lift the interval [low, 1] most, as a rational function of degree (3, 2)
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:len(a)] @ q[len(a):].T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low ** 2) / (1 + wc * low ** 2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < (4 * EPS) ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def _split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k vectors span the eigenvectors above a
    shift between the eigenvalues; None if there is nothing to split."""
    m = len(a)
    mean = float(np.trace(a)) / m
    spread = float(np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m))
    if spread <= m * EPS * scale:
        return None  # all alike: any basis will do
    # eigenvalues lie on both sides of their mean; where one lies on it, a little beside it
    for shift in (mean, *(mean + s * f * spread for f in (1e-3, 1e-2, 0.05, 0.1, 0.3) for s in (1, -1))):
        u = polar(a - shift * np.eye(m))
        if np.linalg.norm(u @ u - np.eye(m)) > 1e-10:
            continue  # an eigenvalue is on the shift
        p = (u + np.eye(m)) / 2
        k = int(round(float(np.trace(p))))
        if not 0 < k < m:
            continue
        q = np.linalg.qr(p @ rng.standard_normal((m, k)))[0]
        return np.linalg.qr(p @ q, mode="complete")[0], k
    return None


def components(v: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric
    matrix; the first ``most`` of them. The largest entry of each is positive."""
    most, rng = len(v) if most is None else min(most, len(v)), np.random.default_rng(11)
    scale, done = float(np.linalg.norm(v)) or 1.0, []
    todo = [np.eye(len(v))]
    while todo and sum(b.shape[1] for b in done) < most:  # the subspace of larger eigenvalues comes first
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        cut = _split(a, scale, rng) if len(a) > 1 else None
        if cut is None:
            done.append(basis)
        else:
            q, k = cut
            todo += [basis @ q[:, k:], basis @ q[:, :k]]
    found = np.linalg.qr(np.hstack(done))[0] if done else np.zeros((len(v), 0))
    e = np.einsum("ij,ij->j", found, v @ found)
    order = np.argsort(-e, kind="stable")[:most]
    found, e = found[:, order], e[order]
    return e, found * np.where(found[np.abs(found).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)


# ------------------------------------------------------------- exact sums --
def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y of whole numbers, exact: in doubles, longs or Python's integers."""
    bound = len(x) * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0))
    if bound < 2.0 ** 53:
        return (x.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
    return np.einsum("ij,ik->jk", x, y) if bound < 2.0 ** 62 else x.T.astype(object) @ y.astype(object)


def _totals(fit: DataFrame, of_rows, width: int) -> list[int]:
    """Exact sums over all rows of the ``width`` whole numbers that ``of_rows`` makes of a matrix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for b in slices(batches, 4096):
            total = [s + int(t) for s, t in zip(total, of_rows(lists_as_rows(b.column(0))).ravel())]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["at", "part"])

    sums = fit.mapInArrow(task, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("part"))
    got = {r.at: int(r.part) for r in sums.collect()}  # one row for each number
    return [got.get(i, 0) for i in range(width)]


@dataclass
class Whitener:
    """What every task needs: the count, the sums as centre * n + rest, the
    components with their eigenvalues, and the report of the fit."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def real(self) -> np.ndarray:
        """Components that have a variance beyond rounding."""
        return self.values > len(self.centre) * EPS * max(self.values.max(initial=0.0), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; 0 on components of no variance."""
        centred = (x - self.centre).astype(np.float64) - self.rest / self.n
        weights = np.where(self.real, self.vectors / np.sqrt(np.where(self.real, self.values, 1.0)), 0.0)
        return np.einsum("ij,jk->ik", centred, weights)  # the same sum for equal rows, whatever is beside them

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2; None where a long cannot hold it."""
        y, r, n = x - self.centre, self.rest, self.n
        bound = max(float(np.abs(y).max(initial=0)), float(np.abs(r).max(initial=0))) ** 2 * len(r)
        y, r = (y, r) if bound < 2.0 ** 62 else (y.astype(object), r.astype(object))
        squares, mixed = (y * y).sum(1).tolist(), (y * r).sum(1).tolist()
        rest = sum(int(v) ** 2 for v in r)
        out = [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, mixed)]
        return [v if v < 2 ** 63 else None for v in out]


def whole(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, x): whole vectors of the rows that take part, and their length."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("v is not null")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = common.n if common else 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            at, v = finite(b.column(1), dim)
            v = np.floor(256 * v) + 0
            if np.abs(v).max(initial=0) >= 2.0 ** 62:
                raise OverflowError("a component is too large for a long")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), as_lists(v.astype(np.int64))], ["id", "x"])

    return rows.mapInArrow(task, f"id {kind}, x array<long>"), dim


def fit(distinct: DataFrame, dim: int, most: int) -> Whitener | None:
    """The whitener of the vectors in the column x of ``distinct``."""
    n, *sums = _totals(distinct, lambda x: np.r_[len(x), _products(np.ones((len(x), 1), np.int64), x)[0]], 1 + dim)
    if not n:
        return None
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the mean, rounded
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], np.int64)
    i, j = np.triu_indices(dim)
    moments = _totals(distinct, lambda x: _products(x - centre, x - centre)[i, j], len(i))
    v = np.zeros((dim, dim))
    for a, b, m in zip(i.tolist(), j.tolist(), moments):
        v[a, b] = v[b, a] = (n * m - int(rest[a]) * int(rest[b])) / (n * n)  # one rounding
    values, found = components(v, most)
    total = float(np.trace(v))
    out = Whitener(n, centre, rest, values, found, np.clip(values / total if total > 0 else 0 * values, 0.0, 1.0))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(values), len(values)))
        for b in slices(batches, 4096):
            w = out.whitened(lists_as_rows(b.column(0)))
            total += w.T @ w
        a, b = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total.ravel())], ["a", "b", "part"])

    real = out.real
    covariance = distinct.mapInArrow(products, "a int, b int, part double").groupBy("a", "b").agg(F.sum("part").alias("part")).collect()
    out.identity_error = max([0.0, *(abs(r.part / n - (r.a == r.b)) for r in covariance if real[r.a] and real[r.b])])
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a
    row for each row of ``vectors`` that takes part and each of its first
    ``most`` components (all, if the vectors are shorter).

    Rows with a null vector, a null or non-finite component, or a vector whose
    length is not the most common one take no part. Repeated rows and null ids
    stay, each with rows of its own; equal vectors enter the statistics once.
    Components of no variance (all vectors alike, or in a smaller subspace) come
    last, with whitened and explained 0, and are no part of identity_error;
    components of equal variance are any basis of theirs. A deviation that a
    long cannot hold is null. An empty table gives no rows. Components of
    2 ** 54 and more raise.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows, dim = whole(vectors, id_col, vector)
    out_type = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], out_type)
    with passing(rows.select("x").distinct(), "fit-list") as distinct:
        model = fit(distinct, dim, most)
    if model is None:
        return spark.createDataFrame([], out_type)
    held = spark.sparkContext.broadcast(model)  # a few numbers for each dimension

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.values)
        for b in batches:
            x = lists_as_rows(b.column(1)) if b.num_rows else np.zeros((0, dim), np.int64)
            take = pa.array(np.repeat(np.arange(len(x)), k))
            rows = len(take)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, m.n)),
                 pa.array(m.deviation(x), pa.int64()).take(take), pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.explained, len(x))),
                 pa.array(np.full(rows, m.identity_error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, out_type)
