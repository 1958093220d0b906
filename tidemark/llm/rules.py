"""Quality rules: counts of simple faults, and a log-likelihood ratio test.

Every byte 3-gram of a text is hashed to a bucket. Two multinomials over the
buckets are counted on whole texts, one on trusted documents (labelled good),
one on the raw corpus, both with add-one smoothing. A text's score is the mean
over its n-grams of log p(trusted) - log p(raw); a fixed threshold decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, concat, ranges, slices

#: Bytes of an n-gram, and buckets that they are hashed to (a power of two).
GRAM, BUCKET_BITS = 3, 14
#: Least mean log-likelihood ratio of a text that is kept.
THRESHOLD = -0.5
#: Characters counted as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"
#: Fewest words, and most words in repeated windows, in percent (fixed values).
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_CONTINUATION = bytes(range(0x80, 0xC0))


def counts(b: bytes) -> tuple[int, int, int, int, int]:
    """(words, their code points, symbols, repeated lines, words in 3-word
    windows that occur twice or more) of one text."""
    words = b.split()
    n = len(words)
    chars = sum(map(len, words)) - (len(b) - len(b.translate(None, _CONTINUATION)))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if not x.isspace() and x]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = 0
    if len(seen) < len(windows):
        end = 0  # words before it are counted already
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), covered


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def gram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, text after text, and each text's number of them.
    A text shorter than an n-gram has none."""
    t, off = concat(texts)
    n = np.maximum(np.diff(off) - GRAM + 1, 0)
    if not n.sum():
        return np.zeros(0, np.int64), n
    code = np.zeros(len(t) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | t[k:len(t) - GRAM + 1 + k]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return code[ranges(off[:-1], n)].astype(np.int64), n


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
               label: str = "quality") -> np.ndarray:
    """log p(trusted) - log p(raw) of each bucket, over all documents.

    Trusted are the rows whose labels average 0.5 or more; null ids and null
    labels trust nothing. Without trusted rows every ratio is 0.
    """
    trusted = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_key"))
               .agg(F.avg(label).alias("_q")).where("_q >= 0.5").select("_key", F.lit(True).alias("_trusted")))
    # labels grow with the corpus: joined by a shuffle at every size, not only where they no longer fit a broadcast
    rows = (docs.select(F.col(id_col).alias("_key"), F.col(text).alias("_text")).join(trusted.hint("merge"), "_key", "left")
            .select("_text", F.coalesce("_trusted", F.lit(False)).alias("_trusted")))
    size = 1 << BUCKET_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in slices(batches):
            at, n = gram_buckets(as_bytes(b.column(0)))
            raw += np.bincount(at, minlength=size)
            good += np.bincount(at[np.repeat(b.column(1).to_numpy(zero_copy_only=False), n)], minlength=size)
        on = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(raw[on]), pa.array(good[on])], ["bucket", "raw", "good"])

    both = np.zeros((2, size))
    for r in (rows.mapInArrow(add, "bucket long, raw long, good long").groupBy("bucket")
              .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()):  # one row for each bucket
        both[:, r.bucket] = r.raw, r.good
    if not both[1].any():
        return np.zeros(size)
    p = (both + 1) / (both.sum(1, keepdims=True) + size)
    return np.log(p[1]) - np.log(p[0])


def judge(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr, kept) of every row.

    A null text has no words; it and every text of fewer than ``MIN_WORDS``
    words fail. A text without n-grams has ratio 0. Repeated rows are judged
    alike, null ids stay null, and other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = as_bytes(b.column(1))
            base = [counts(t) for t in texts]
            failed = np.array([base_failed(r[0], r[4]) for r in base], bool)
            at, n = gram_buckets(texts)
            llr, some = np.zeros(len(n)), np.flatnonzero(n)
            if len(some):  # a sum of each document's own, whatever is beside it
                llr[some] = np.add.reduceat(held.value[at], (np.cumsum(n) - n)[some]) / n[some]
            cols = [pa.array([r[k] for r in base], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *cols, pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))],
                [id_col, *names, "base_failed", "llr", "kept"])

    return (docs.select(F.col(id_col), F.col(text).alias("_text"))
            .mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in names)
                        + ", base_failed boolean, llr double, kept boolean"))
