"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over quantile bins. The tables are
learnt by cyclic boosting: round after round, one shallow tree for each
feature in turn is fitted to the current gradient of the log loss and added,
shrunk, to that feature's table. Pairs of features with the strongest
remaining gain get two-dimensional tables in the same way. A score is the
logistic of the sum of one entry from each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, fold, slices

#: Most labelled rows the model is fitted on (the bound of the training sample).
TRAIN_ROWS = 20_000
#: A text is kept from this score on.
THRESHOLD = 0.3

FEATURES = ("log_words", "word_bytes", "distinct_words", "distinct_triples", "top_word", "short_words", "long_words",
            "log_lines", "line_words", "distinct_lines", "capitals", "digits", "non_ascii", "commas_stops", "bangs",
            "marks", "pipes", "brackets", "quotes", "slashes_at", "other_punctuation", "spaces")

_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def features(b: bytes) -> list[float]:
    """Features of one text's UTF-8 bytes; the empty text has all zeros."""
    n = len(b)
    if not n:
        return [0.0] * len(FEATURES)
    words = b.split()
    k = len(words) or 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:])))

    def share(chars: bytes) -> float:
        return sum(map(b.count, [chars[i:i + 1] for i in range(len(chars))])) / n if len(chars) < 9 \
            else 1 - len(b.translate(None, chars)) / n

    return [np.log1p(len(words)), n / k, len(seen) / k, triples / max(1, len(words) - 2),
            max(seen.values(), default=0) / k, float((lens <= 3).sum()) / k, float((lens > 15).sum()) / k,
            np.log1p(len(lines)), len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
            share(_CAPITALS), share(_DIGITS), share(_HIGH), share(b",."), share(b"!?"), share(b"#*$%&"), share(b"|"),
            share(b"<>{}[]()"), share(b"\"'`"), share(b"/\\@"), share(b":;-_=+~^"), share(b" \n\t")]


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best cut of binned gradients: (gain, first bin of the right side)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge)
    gain[(hl < 1e-9) | (hr < 1e-9)] = -1
    at = int(np.argmax(gain))
    return float(gain[at] - g.sum() ** 2 / (h.sum() + ridge)), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values, per bin, of a tree with few leaves fitted to binned gradients."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b], ridge), k) for k, (a, b) in enumerate(parts) if b - a > 1), default=None)
        if best is None or best[0] <= 1e-12:
            break
        _, cut, k = best
        a, b = parts.pop(k)
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Depth-two tree on a grid: one cut along an axis, then one along the
    other on each side. Returns its gain over the best single leaf and values."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        _, cut = _split(gg.sum(1), hh.sum(1), ridge)
        out, gain = np.zeros_like(gg), 0.0
        for side in (slice(0, cut), slice(cut, None)):
            g1, h1 = gg[side].sum(0), hh[side].sum(0)
            tree = _shallow_tree(g1, h1, 2, ridge)
            out[side] = tree
            gain += float((tree * g1).sum())
        if gain > best[0]:
            best = (gain, out.T if flip else out)
    return best


@dataclass
class AdditiveModel:
    """Lookup tables of a fitted model."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # per feature, ascending
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin, per feature
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: table entries added up."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, bins: int = 64,
            grid: int = 12, n_pairs: int = 10, rate: float = 0.1, leaves: int = 3, ridge: float = 5.0) -> AdditiveModel:
        """Fit to features ``x`` and labels ``y`` (0/1). Without rows, or with
        one label only, the model is its smoothed prior."""
        m, n, k = cls(), len(x), x.shape[1]
        prior = (y.sum() + 0.5) / (n + 1)
        m.intercept = float(np.log(prior / (1 - prior)))
        cuts = np.linspace(0, 1, bins + 1)[1:-1]
        m.edges = [np.unique(np.quantile(x[:, f], cuts)) if n else np.zeros(0) for f in range(k)]
        m.tables = [np.zeros(len(e) + 1) for e in m.edges]
        m.coarse = [np.arange(len(e) + 1) * grid // (len(e) + 1) for e in m.edges]
        if not n or y.min() == y.max():
            return m
        b, total = m.bins(x), np.full(n, m.intercept)

        def gradient() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for f in range(k):
                g, h = gradient()
                size = len(m.tables[f])
                step = rate * _shallow_tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size), leaves, ridge)
                m.tables[f] += step
                total += step[b[:, f]]
        c = np.stack([m.coarse[f][b[:, f]] for f in range(k)], 1)

        def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, h = gradient()
            at = c[:, i] * grid + c[:, j]
            return at, np.bincount(at, g, grid * grid).reshape(grid, grid), np.bincount(at, h, grid * grid).reshape(grid, grid)

        gains = [(_grid_tree(*cells(i, j)[1:], ridge)[0], i, j) for i in range(k) for j in range(i)]
        m.pairs = [(i, j, np.zeros((grid, grid))) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
        for _ in range(pair_rounds):
            for i, j, t in m.pairs:
                at, g, h = cells(i, j)
                step = rate * _grid_tree(g, h, ridge)[1]
                t += step
                total += step.ravel()[at]
        return m


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(b) for b in texts], np.float64).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAIN_ROWS, folds: int = 5) -> AdditiveModel:
    """Fit on labelled rows outside fold 0, at most about ``rows`` of them.

    With more labels than that, a hash of the id picks the sample. Several
    labels of one id count by their mean; null labels and null ids teach nothing.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id_col), folds) != 0))
             .groupBy(F.col(id_col).alias("_key")).agg(F.avg(label).alias("_label")))
    share = min(1.0, rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(_matrix(as_bytes(b.column(2)))), pa.list_(pa.float64()))],
                ["k", "y", "x"])

    # the sample's ids are few by the bound above, whatever the tables hold
    got = (docs.select(F.col(id_col).alias("_key"), F.col(text).alias("_text"))
           .join(F.broadcast(picked), "_key").select("_key", "_label", "_text")
           .mapInArrow(extract, f"k {docs.schema[id_col].dataType.simpleString()}, y double, x array<double>").collect())
    got.sort(key=lambda r: (r.k, r.x))
    x = np.array([r.x for r in got], np.float64).reshape(len(got), len(FEATURES))
    return AdditiveModel.fit(x, (np.array([r.y for r in got]) >= 0.5).astype(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text: str = "text",
          folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``.

    The whole text is scored; null counts as empty, and the empty text has a
    score too. Repeated rows give repeated results; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = held.value.score(_matrix(as_bytes(b.column(2))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col), (fold(F.col(id_col), folds) == 0).alias("held_out"), F.col(text).alias("_text"))
            .mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches the threshold."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(held.value.score(_matrix(as_bytes(b.column(at)))) >= threshold))

    plain = {f"c{k}": c for k, c in enumerate(docs.columns)}  # names that mapInArrow takes
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in plain.items())
    kept = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in plain.items())).mapInArrow(run, kinds)
    return kept.select(*(F.col(k).alias(c) for k, c in plain.items()))
