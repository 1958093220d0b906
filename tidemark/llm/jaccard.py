"""Similarity join of texts by the Jaccard index of their word 5-grams.

Chosen-path join: every set stands for a sketch of 64 min-hashes, whose shared
entries are a sample of the shared tokens. From a root node for each run, a
set walks to a child node for each sketch entry that the node's own hash picks
(1 / (0.8 * 64) of them), so two similar sets tend to walk on together and
others part. Nodes with few sets are compared by brute force, larger ones
split again, and the walk is repeated from other roots until the target recall
is reached. Close sketches form candidate groups; within those, every pair of
texts is compared exactly, on the whole sets of n-grams.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, as_bytes, concat, mix64, slices, stored
from tidemark.llm.components import components

#: Words in a token of the compared sets.
WORDS = 5
#: Least Jaccard index of a link.
SIMILARITY = 0.8
#: Min-hashes of a sketch.
SKETCH = 64
#: Share of links that the walks must find, for links at the threshold.
RECALL = 0.999
#: Sets that a node may have before it splits further, and levels of splits;
#: a larger node of the last level is compared in blocks of this many sets.
NODE_SETS, LEVELS = 512, 3
#: Texts of a candidate group compared in one block.
BLOCK = 400

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 2 ** 64, 256, np.uint64) | np.uint64(1)
_MUL = _rng.integers(1, 2 ** 32, SKETCH, np.uint32) | np.uint32(1)
_XOR = _rng.integers(1, 2 ** 32, SKETCH, np.uint32)
_P = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.ones(1, np.uint64), np.full(max(0, n - 1), _P, np.uint64)])


def ngram_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, text after text, and how many each text has.
    A text of fewer words has one n-gram, of all its words; without words, none."""
    t, off = concat([x + b" " for x in texts])
    solid = ~_WHITE[t]
    first = np.flatnonzero(solid & np.r_[True, ~solid[:-1]]) if len(t) else np.zeros(0, np.int64)
    n_words = np.diff(np.searchsorted(first, off))
    if not len(first):
        return np.zeros(0, np.uint64), n_words
    at = np.flatnonzero(solid)
    word = np.cumsum(np.isin(at, first, assume_unique=True)) - 1
    inside = at - first[word]
    value = _BYTE[t[at]] * _powers(int(inside.max()) + 1)[inside]
    whole = mix64(np.add.reduceat(value, np.searchsorted(at, first)))
    doc = np.repeat(np.arange(len(texts)), n_words)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    gram = np.zeros(len(first), np.uint64)
    for k in range(words):
        inside_text = nth + k < n_words[doc]
        i = np.flatnonzero(inside_text)
        gram[i] = gram[i] * np.uint64(_P) + whole[i + k]
    keep = (nth == 0) | (nth + words <= n_words[doc])
    return mix64(gram[keep]), np.bincount(doc[keep], minlength=len(texts))


def sketches(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Min-hash sketch of each text; of one without words, all ones."""
    grams, count = ngram_hashes(texts, words)
    out = np.full((len(texts), SKETCH), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(count)
    if len(some):
        heads = (np.cumsum(count) - count)[some]
        h = (grams >> np.uint64(32)).astype(np.uint32)
        for k in range(SKETCH):
            v = (h ^ _XOR[k]) * _MUL[k]
            out[some, k] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), heads)
    return out


def text_key(t: bytes) -> bytes:
    """128-bit fingerprint of a text's words: texts with one key are copies."""
    return hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest()


def _children(node: np.ndarray, sketch: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, child node) of the sketch entries that each set's node picks."""
    entry = mix64(sketch.astype(np.uint64) | (np.arange(SKETCH, dtype=np.uint64)[None] << np.uint64(32)))
    child = mix64(entry ^ mix64(node.view(np.uint64))[:, None])
    picked = child < np.uint64(int(2.0 ** 64 / (similarity * SKETCH)))
    row, col = np.nonzero(picked)
    return row, mix64(child[row, col] + np.uint64(_P)).view(np.int64)


def runs_for(recall: float, levels: int) -> int:
    """Walks needed so that two sets at the threshold meet, with probability
    ``recall``, in some node of the last level. They share one picked entry on
    average, so their meetings are a critical branching process."""
    meet = 1.0
    for _ in range(levels):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _stars(link: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a symmetric link matrix."""
    label = np.arange(len(link))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(link)).min(1, initial=len(link)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted rows whose first ``keys`` columns are their key."""
    last, rows = None, []
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
            if r[:keys] != last:
                if rows:
                    yield last, rows
                last, rows = r[:keys], []
            rows.append(r)
    if rows:
        yield last, rows


def _emit(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values())], list(types))


def _blocks(df: DataFrame, size: str, block: int) -> DataFrame:
    """Split the groups of ``df`` into blocks by the key's hash, and give each
    row to every pair of blocks (lo <= hi) that has its own."""
    parts = F.ceil(F.col(size) / block).cast("int")
    part = F.pmod(F.xxhash64("key"), F.greatest(parts, F.lit(1))).cast("int")
    return (df.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other"))


def candidates(sets: DataFrame, similarity: float, recall: float, node_sets: int, levels: int) -> DataFrame:
    """(a, b) edges, by key, some more than once, whose components hold every pair of
    close sketches that met. ``sets`` has key and sketch."""
    runs = runs_for(recall, levels)
    least = math.floor(similarity * SKETCH - 4 * math.sqrt(SKETCH * similarity * (1 - similarity)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, SKETCH)
            if b.num_columns > 2:
                found = [_children(b.column(2).to_numpy(), s, similarity)]
            else:
                found = [_children(np.full(len(s), r + 1, np.int64), s, similarity) for r in range(runs)]
            row, node = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(node), b.column(0).take(pa.array(row))], ["node", "key"])

    at = sets.select("key", "sketch")
    leaves = None
    for level in range(1, levels + 1):
        met = at.mapInArrow(walk, "node long, key binary")
        crowd = met.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        met = stored(met.join(crowd, "node"), "nodes")
        here = met if level == levels else met.where(F.col("n") <= node_sets)
        leaves = here if leaves is None else leaves.unionByName(here)
        at = met.where(F.col("n") > node_sets).join(sets, "key").select("key", "sketch", "node")
        if level < levels and met.where(F.col("n") > node_sets).isEmpty():
            break
    rows = (_blocks(leaves, "n", node_sets).join(sets, "key")
            .select("node", "lo", "hi", "key", "part", "sketch")
            .repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"a": pa.binary(), "b": pa.binary()}
        out: set[tuple[bytes, bytes]] = set()
        for _, group in _grouped(batches, 3):
            keys = [r[3] for r in group]
            if len(keys) < 2:
                continue
            s = np.frombuffer(b"".join(r[5] for r in group), np.uint32).reshape(-1, SKETCH)
            if len(keys) <= 32:
                close = (s[:, None] == s[None]).sum(2) >= least
            else:
                same = np.zeros((len(keys), len(keys)), np.uint8)
                for c in range(SKETCH):
                    same += s[:, c][:, None] == s[:, c][None]
                close = same >= least
            for i, j in enumerate(_stars(close).tolist()):
                if i != j:
                    out.add((keys[i], keys[j]))
            if len(out) > 1 << 15:
                yield _emit(list(out), types)
                out = set()
        yield _emit(list(out), types)

    return rows.mapInArrow(compare, "a binary, b binary")


def _ngrams(text: bytes, words: int) -> set:
    w = text.split()
    return set(zip(*(w[k:] for k in range(words)))) if len(w) >= words else {tuple(w)} if w else set()


def linked(texts: list[bytes], words: int, similarity: float) -> np.ndarray:
    """Symmetric matrix of which texts are linked, exactly."""
    sets, n = [_ngrams(t, words) for t in texts], len(texts)
    sizes = np.array([len(s) for s in sets])
    if n <= 24:
        both = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i):
                both[i, j] = both[j, i] = len(sets[i] & sets[j])
    else:
        number: dict = {}
        ids = [np.fromiter((number.setdefault(g, len(number)) for g in s), np.int64, len(s)) for s in sets]
        flat = np.concatenate(ids)
        shared = np.bincount(flat, minlength=len(number)) > 1  # others add to no intersection
        place = np.cumsum(shared) - 1
        width = (int(shared.sum()) + 63) // 64 or 1
        bits = np.zeros((n, width * 64), bool)
        for i, x in enumerate(ids):
            bits[i, place[x[shared[x]]]] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        both = np.stack([np.bitwise_count(packed & row).sum(1, dtype=np.int64) for row in packed])
    union = sizes[:, None] + sizes[None] - both
    link = (both >= similarity * union - 1e-9) & (union > 0)
    link[np.arange(n), np.arange(n)] = False
    return link


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS,
                    similarity: float = SIMILARITY, recall: float = RECALL, node_sets: int = NODE_SETS,
                    levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_links) of every row of ``docs``.

    Two rows are linked if their words are the same, or if the Jaccard index of
    their n-gram sets is ``similarity`` or more. class_id is the smallest id of
    all rows reached over links; n_links counts the other rows linked directly.
    A text of fewer than ``words`` words has one n-gram, of all of them; null
    and wordless texts are copies of one another. A null id counts as the
    smallest one and stays null. Columns beside the two are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (_classes(docs, id_col, text, words, similarity, recall, node_sets, levels, block)
            .select(F.when(F.col("_id") != NULL_ID, F.col("_id")).cast(kind).alias(id_col),
                    F.when(F.col("class_id") != NULL_ID, F.col("class_id")).cast(kind).alias("class_id"), "n_links"))


def _keyed(docs: DataFrame, id_col: str, text: str, words: int, sketch: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            texts = as_bytes(b.column(1))
            key = pa.array(map(text_key, texts), pa.binary())
            more = pa.array([r.tobytes() for r in sketches(texts, words)], pa.binary()) if sketch else b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), key, more], ["_id", "key", "more"])

    return (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text).alias("_text"))
            .mapInArrow(run, f"_id long, key binary, more {'binary' if sketch else 'string'}"))


def _classes(docs, id_col, text, words, similarity, recall, node_sets, levels, block) -> DataFrame:
    """(_id, key, class_id, n_links) of every row."""
    rows = stored(_keyed(docs, id_col, text, words, True), "sketches")
    sets = stored(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("_id").alias("_id"),
                                          F.first("more").alias("sketch")), "sets")
    group = components(candidates(sets.select("key", "sketch"), similarity, recall, node_sets, levels), "a", "b")
    size = group.groupBy("root").agg(F.count("*").alias("n"))
    member = (group.join(size, "root").select("root", "n", F.col("node").alias("key"))
              .join(sets.select("key", "copies", "_id"), "key"))
    # one text for each member: that of the row which stands for its copies
    texts = (_keyed(docs, id_col, text, words, False).join(member, ["_id", "key"]).dropDuplicates(["_id", "key"])
             .select("root", "n", "key", "copies", F.col("more").alias("text")))
    pairs = (_blocks(texts, "n", block).select("root", "lo", "hi", "key", "part", "copies", "text")
             .repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"a": pa.binary(), "b": pa.binary(), "links": pa.int64()}
        out: list[tuple] = []
        for (_, lo, hi), found in _grouped(batches, 3):
            link = linked([(r[6] or "").encode() for r in found], words, similarity)
            part, copies = np.array([r[4] for r in found]), np.array([r[5] for r in found])
            star = _stars(link)
            # a pair within one block is counted where that block meets itself
            counted = link if lo == hi else link & (part[:, None] != part[None])
            total = counted @ copies
            out += [(found[i][3], found[j][3], int(total[i])) for i, j in enumerate(star.tolist())]
            if len(out) > 1 << 14:
                yield _emit(out, types)
                out = []
        yield _emit(out, types)

    checked = stored(pairs.mapInArrow(verify, "a binary, b binary, links long"), "links")
    links = checked.groupBy("a").agg(F.sum("links").alias("links"))
    root = components(checked, "a", "b")
    classed = (sets.join(root.withColumnRenamed("node", "key"), "key", "left")
               .join(links.withColumnRenamed("a", "key"), "key", "left")
               .select("key", "_id", "copies", F.coalesce("root", "key").alias("root"),
                       (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    first = classed.groupBy("root").agg(F.min("_id").alias("class_id"))
    per_text = classed.join(first, "root").select("key", "class_id", "n_links")
    return rows.select("_id", "key").join(per_text, "key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with all columns, reduced to one row of each class: the row
    with the class's smallest id; of rows repeating it, one."""
    settings = {"words": WORDS, "similarity": SIMILARITY, "recall": RECALL, "node_sets": NODE_SETS,
                "levels": LEVELS, "block": BLOCK} | options
    kept = (_classes(docs, id_col, text, **settings).where("_id = class_id").select("_id", "key").distinct())
    names = docs.columns
    at = names.index(text)

    def add_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            key = pa.array(map(text_key, as_bytes(b.column(at))), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, key], [*(f"c{k}" for k in range(len(names))), "key"])

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    keyed = plain.mapInArrow(add_key, ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in
                                                   enumerate(docs.schema.fields)), "key binary"]))
    own = F.coalesce(F.col(f"c{names.index(id_col)}").cast("long"), F.lit(NULL_ID))
    return (keyed.withColumn("_id", own).join(kept, ["_id", "key"]).dropDuplicates(["_id", "key"])
            .select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)]))
