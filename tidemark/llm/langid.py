"""Language identification by prediction by partial matching.

For each language a context tree holds which byte follows the one, two or
three bytes before it, how often, over all training texts. A byte that was
never seen after the longest known context escapes to the next shorter one,
with the probability that new bytes had there, and bytes seen in the longer
context are excluded there; the shortest is uniform. The counts are frozen, so
each tree becomes one table of code lengths in whole fractions of a bit: a text
costs in each language the sum of its bytes' lengths, and the cheapest wins.

Bytes are folded first: ASCII letters to lower case, and any run of other ASCII
to one space; the bytes of longer characters stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, concat, fold, passing, slices

#: One part in so many of the ids is held out.
PARTS = 5
#: A context of two or three bytes is a node of a language's tree if it holds
#: this share of the language's bytes: at most 2 / SHARE nodes, of any corpus.
SHARE = 2e-5
#: Code lengths that the table may hold (contexts x bytes x languages): beyond
#: it, contexts of the smallest share leave the trees first.
CELLS = 8_000_000
#: Code lengths are whole multiples of 1 / UNIT bit.
UNIT = 65_536
#: Folded bytes: space, 26 letters, 128 bytes of longer characters.
SYMBOLS = 155
#: Keys that a task gathers before it counts them, and bytes scored at a time.
GATHER, CHUNK = 4_000_000, 1 << 20

_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a"):ord("z") + 1] = _FOLD[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_FOLD[128:] = np.arange(27, SYMBOLS)


def folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each text after one space, and where texts begin."""
    data, off = concat([b" " + t for t in texts])
    s = _FOLD[data]
    keep = (s != 0) | np.r_[True, s[:-1] != 0]
    keep[off[:-1]] = True
    return s[keep], np.r_[0, np.cumsum(np.add.reduceat(keep, off[:-1], dtype=np.int64))] if texts else off


def contexts(s: np.ndarray, off: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, ...]:
    """The symbols at start..stop and the three before each; 0 before a text."""
    begins = off[np.searchsorted(off, start - 2):np.searchsorted(off, stop)]
    out = [s[start:stop]]
    for k in (1, 2, 3):
        c = np.zeros(stop - start, s.dtype)
        lead = max(0, k - start)
        c[lead:] = s[start - k + lead:stop - k]
        for j in range(k):
            at = begins + (j - start)
            c[at[(at >= 0) & (at < len(c))]] = 0
        out.append(c)
    return tuple(out)


def keys(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each symbol with the three before it, as one number, some at a time; a text's first space is given."""
    s, off = folded(texts)
    for start in range(0, len(s), CHUNK):
        stop = min(start + CHUNK, len(s))
        b, c1, c2, c3 = (x.astype(np.uint32) for x in contexts(s, off, start, stop))
        given = np.zeros(stop - start, bool)
        given[off[np.searchsorted(off, start):np.searchsorted(off, stop)] - start] = True
        yield (c3 << 24 | c2 << 16 | c1 << 8 | b)[~given]


def grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, key, n): how often each symbol follows each three, by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle() -> None:
            for name, parts in held.items():
                key, n = np.unique(np.concatenate(parts), return_counts=True)
                if name in total:
                    both = np.concatenate([total[name][0], key])
                    key, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([total[name][1], n])).astype(np.int64)
                total[name] = key, n
            held.clear()

        waiting = 0
        for b in slices(batches):
            names = b.column(0).to_pylist()
            for name in dict.fromkeys(names):
                own = b.column(1).take(pa.array([i for i, x in enumerate(names) if x == name], pa.int64()))
                for k in keys(as_bytes(own)):
                    held.setdefault(name, []).append(k)
                    waiting += len(k)
                    if waiting > GATHER:
                        settle()
                        waiting = 0
        settle()
        for name, (key, n) in total.items():
            for i in range(0, len(key), 65_536):
                k = key[i:i + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n[i:i + 65_536].astype(np.int64))], ["lang", "key", "n"])

    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def row_of(parent: np.ndarray, n: np.ndarray, stands_for: np.ndarray) -> np.ndarray:
    """Probabilities of the next symbol in contexts (rows) with the counts ``n``,
    where the shorter context gives ``parent``; a column stands for so many symbols."""
    total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    rest = np.where(n > 0, 0.0, parent)
    left = (rest * stands_for).sum(1, keepdims=True)
    open_ = left > 0  # a context in which every symbol was seen has no escape
    escape = np.where(open_, kinds, 0)
    out = (n + rest / np.where(open_, left, 1) * escape) / np.maximum(total + escape, 1)
    return np.where(total > 0, out, parent)


@dataclass
class Model:
    """Languages; the number of each folded byte among the ``size`` that are told
    apart (the last: all that no text had); the longest context after three
    symbols; code lengths by context, symbol and language."""

    langs: list[str]
    size: int
    number: np.ndarray
    state: np.ndarray
    lengths: np.ndarray

    def cost(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of the texts (rows) in each language, in 1 / UNIT bits."""
        s, off = folded(texts)
        s, size = self.number[s], self.size
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for start in range(0, len(s), CHUNK):
            stop = min(start + CHUNK, len(s))
            b, c1, c2, c3 = (x.astype(np.int64) for x in contexts(s, off, start, stop))
            each = self.lengths.take(self.state.take((c3 * size + c2) * size + c1) * size + b, 0)
            own = np.searchsorted(off, start, "right") - 1, np.searchsorted(off, stop, "left")
            begins = np.maximum(off[own[0]:own[1]], start) - start
            each[off[own[0]:own[1]][off[own[0]:own[1]] >= start] - start] = 0  # a text's first space is given
            out[own[0]:own[1]] += np.add.reduceat(each, begins, axis=0, dtype=np.int64)
        return out


def _lengths(trees: list[dict[tuple[int, ...], np.ndarray]], kept: list[tuple[int, ...]], size: int, unseen: int) -> np.ndarray:
    """Code lengths (contexts x symbols, languages); a context that a language's
    tree lacks is coded as the next shorter one."""
    place = {c: i for i, c in enumerate(kept)}
    out = np.zeros((len(kept) * size, len(trees)), np.int32)
    stands_for, none = np.r_[np.ones(size - 1), unseen], np.zeros(size)
    for lang, tree in enumerate(trees):
        p = np.zeros((len(kept), size))
        for order in range(1 + max(map(len, kept))):  # shorter contexts first
            own = [c for c in kept if len(c) == order]
            parent = p[[place[c[1:]] for c in own]] if order else np.full((1, size), 1 / SYMBOLS)
            p[[place[c] for c in own]] = row_of(parent, np.stack([tree.get(c, none) for c in own]), stands_for)
        out[:, lang] = np.rint(-np.log2(p) * UNIT).ravel()
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE, cells: int = CELLS) -> Model | None:
    """The trees of all languages that have a text; every byte of ``docs`` counts."""
    with passing(grams(docs, text, lang), "grams") as table:
        return _trees(table, share, cells)


def _trees(table: DataFrame, share: float, cells: int) -> Model | None:
    size_of = {r.lang: int(r.n) for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    if not size_of:
        return None
    langs = sorted(size_of)
    least = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(size_of[k] * share))])
    found = []
    for order in range(4):
        key = F.col("key").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("key")
        pairs = table.groupBy("lang", key).agg(F.sum("n").alias("n")) if order < 3 else table
        tree = (pairs.groupBy("lang", F.shiftright("key", 8).alias("context"))
                .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("key").bitwiseAND(255).alias("b"), "n"))).alias("next")))
        # at most 1 / share contexts of a language, each of at most SYMBOLS symbols
        found.append((order, (tree.where(F.col("n") >= least[F.col("lang")]) if order > 1 else tree).toArrow()))
    alphabet = np.unique(found[0][1]["next"].combine_chunks().flatten().field("b").to_numpy())
    size = len(alphabet) + 1
    number = np.full(SYMBOLS, size - 1, np.uint8)
    number[alphabet] = np.arange(len(alphabet))
    trees: list[dict[tuple[int, ...], np.ndarray]] = [{} for _ in langs]
    shares: dict[tuple[int, ...], float] = {}
    for order, rows in found:
        lists = rows["next"].combine_chunks()
        b, n, cut = number[lists.flatten().field("b").to_numpy()], lists.flatten().field("n").to_numpy(), lists.offsets.to_numpy()
        for i, (name, context, total) in enumerate(zip(*(rows[c].to_pylist() for c in ("lang", "context", "n")))):
            c = tuple(int(number[context >> 8 * k & 255]) for k in range(order - 1, -1, -1))  # oldest first
            row = np.zeros(size, np.float32 if total < 1 << 24 else np.float64)  # counts stay exact
            row[b[cut[i]:cut[i + 1]]] = n[cut[i]:cut[i + 1]]
            trees[langs.index(name)][c] = row
            shares[c] = max(shares.get(c, 0.0), total / size_of[name])
    # a context never has a larger share than a shorter one, so the trees stay whole
    kept = sorted(shares, key=lambda c: (len(c) > 1, -shares[c] if len(c) > 1 else 0, len(c), c))
    kept = kept[:max(sum(len(c) < 2 for c in kept), cells // (size * len(langs)))]
    state = np.zeros((size, size, size), np.int32)
    place = {c: i for i, c in enumerate(kept)}
    for c in sorted(kept, key=len):  # a longer context takes the place of a shorter one
        state[(Ellipsis, *c)] = place[c]
    return Model(langs, size, number, state.ravel(), _lengths(trees, kept, size, SYMBOLS - len(alphabet)))


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with lang_pred and score: the language
    in which the text's code is shortest, and its share of the probabilities
    2 ** -length of all languages.

    ``und`` with score 0 where the text is null or has no letter, or no language
    was learned. Equal lengths go to the first name; repeated rows are judged
    alike, as a text's lengths are whole numbers and depend on nothing beside it.
    Columns lang_pred and score of ``docs`` are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # CELLS lengths at most, and a number for each three symbols
    plain = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    moved = [*plain, *([text] if text not in plain else [])]
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(moved)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches):
            texts = b.column(moved.index(text))
            judged = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, score = ["und"] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(judged) if m else []
            if len(at):
                cost = m.cost(as_bytes(texts.take(pa.array(at))))
                score[at] = 1 / np.exp2((cost.min(1, keepdims=True) - cost) / UNIT).sum(1)
                for i, k in zip(at.tolist(), cost.argmin(1).tolist()):
                    names[i] = m.langs[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(plain)], pa.array(names, pa.string()), pa.array(score)],
                                             [*(f"c{i}" for i in range(len(plain))), "lang_pred", "score"])

    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(plain)]
    out = renamed.mapInArrow(task, ", ".join([*kinds, "lang_pred string", "score double"]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(plain)), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = PARTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from the rows that are not held
    out and have a language and a text, told for all. A null id is held out. Ids
    and languages decide what is learnt from, never a prediction. Any column may
    be null; an empty table gives no rows, one without languages only ``und``."""
    model = train(docs.where(fold(F.col(f"`{id_col}`"), parts) != 0), text, lang)
    return (predict(docs, model, text, keep=[id_col])
            .select(id_col, (fold(F.col(f"`{id_col}`"), parts) == 0).alias("held_out"), "lang_pred", "score"))
