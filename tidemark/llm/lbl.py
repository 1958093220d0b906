"""Language-model scores from a log-bilinear neural model.

A word is predicted from the two before it: their vectors, weighted by
position, add up to a predicted vector, whose inner products with the words'
output vectors, plus biases, are scores. The model is trained in numpy by
noise-contrastive estimation on word-class trigrams counted over the whole
training corpus. Classes are the most frequent words and, for every other
word, a hash of its ending; inside a class a rare word has its smoothed share
of the class's training tokens, so probabilities of whole texts are normalised.
Both kinds of classes grow with the corpus's vocabulary. The normaliser of every context comes from one
product of two matrices, since the exponent of a sum factors.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, fold, frequent, mix64, passing, slices_by_bytes, stored

#: Words with a class of their own: so many times the sixth root of the number of
#: distinct words, which keeps their share of a corpus's tokens from falling as it
#: grows. One hashed ending for so many of them, and bytes of an ending.
OWN_SCALE, WORDS_FOR_ENDING, ENDING_BYTES = 115, 3, 3
#: Bytes of texts that a worker takes at a time; a longer text is taken alone.
SLICE = 1 << 20
#: Trigrams that a worker holds before it hands their sums on.
HELD = 1 << 19
#: Most words whose counts are sent to the executors; others are joined.
SENT_WORDS = 1 << 17
#: Vector size; rounds, after each of which the shards' parameters are averaged;
#: least steps of a round; samples and noise of a step.
SIZE, ROUNDS, STEPS, SAMPLES, NOISE = 32, 4, 160, 2048, 64
#: Trigrams of a shard, about, and stretches of the trigrams' hashes joined in one task.
SHARD_GRAMS, STRETCHES = 1 << 19, 4
#: Shards whose parameters are added up in one group, and parameters of a row that is added.
ADDED, ADDED_NUMBERS = 64, 1 << 14
#: Contexts whose normalisers are worked out at a time.
CONTEXTS = 256


def ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % endings


#: What a byte does to a crc32: the register after one byte, from each start.
_CRC = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)
_CRC ^= _CRC[0]


def all_endings(words: pa.LargeBinaryArray, endings: int) -> np.ndarray:
    """``ending`` of many words."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)
    last, size, crc = at[1:], np.diff(at), np.full(len(words), 0xFFFFFFFF, np.uint32)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for k in range(ENDING_BYTES, 0, -1):
        has = size >= k
        now = crc[has]
        crc[has] = _CRC[(now ^ text[last[has] - k]) & 0xFF] ^ (now >> np.uint32(8))
    return (~crc % np.uint32(endings)).astype(np.int64)


def own_words(types: int) -> int:
    """Words with classes of their own, at a number of distinct words."""
    return round(OWN_SCALE * types ** (1 / 6))


@dataclass
class Corpus:
    """What scoring needs to know of the training corpus."""

    tokens: int  # N, with ends
    types: int  # V, with the end
    ends: int  # training texts
    own: int  # words with classes of their own, from 1 on; class 0 is the end
    sent: pa.LargeBinaryArray  # words, those of their own classes first
    sent_counts: np.ndarray  # of each sent word, in training
    class_tokens: np.ndarray  # of each ending
    class_types: np.ndarray

    @property
    def classes(self) -> int:
        return 1 + self.own + len(self.class_tokens)

    def class_of(self, words: pa.LargeBinaryArray, place: np.ndarray | None = None) -> np.ndarray:
        """Class of each word; its place among the sent words may be known."""
        if place is None:
            place = pc.fill_null(pc.index_in(words, value_set=self.sent.slice(0, self.own)), -1).to_numpy()
        own = (place >= 0) & (place < self.own)
        return np.where(own, place + 1, 1 + self.own + all_endings(words, len(self.class_tokens)))


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of every word in place, and words per text.

    Words are what stands between ASCII white space, A-Z in lower case; a null
    text has none. Arrow also cuts an empty word off where white space starts or
    ends a text: it may be among the distinct words, and no code refers to it.
    """
    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = cut.offsets.to_numpy().astype(np.int64)
    # Arrow's ascii_lower reads a cast slice from its buffer's start, so words are lowered, not texts
    words = pc.ascii_lower(cut.values).slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary.cast(pa.large_binary())
    n, empty = np.diff(offsets), pc.index(distinct, pa.scalar(b"", pa.large_binary())).as_py()
    if empty >= 0:
        real = codes != empty
        n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
        codes = codes[real]
    return distinct, codes, n


def _sequences(classes: np.ndarray, n: np.ndarray):
    """(before last, last, next, text) of every token, ends included; texts
    start in the context of two ends."""
    starts = np.cumsum(n + 3) - (n + 3)
    line = np.zeros(int((n + 3).sum()), np.int64)  # two ends, the words, the end
    inside = np.ones(len(line), bool)
    inside[starts], inside[starts + 1], inside[starts + n + 2] = False, False, False
    line[inside] = classes
    at = np.ones(len(line), bool)
    at[starts], at[starts + 1] = False, False
    i = np.flatnonzero(at)
    return line[i - 2], line[i - 1], line[i], np.repeat(np.arange(len(n)), n + 1)


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``slices_by_bytes``; after the last one a worker, which outlives its task,
    gives back what Arrow keeps for more."""
    yield from slices_by_bytes(batches, column, most)
    pa.default_memory_pool().release_unused()


def survey(train: DataFrame) -> tuple[Corpus, DataFrame]:
    """Counts of the training texts (column _text): (corpus, (word, n) table)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _scorer.cache_clear()  # a worker outlives a query: the tables of the last one go
        texts = 0
        # coding a larger slice at once is cheaper than adding up the words of small ones
        for b in _texts(batches, 0, 4 * SLICE):
            distinct, codes, _ = _coded(b.column(0))
            n = np.bincount(codes, minlength=len(distinct))
            texts += b.num_rows
            yield from pa.table({"word": distinct, "n": n}).filter(pa.array(n > 0)).cast(kind).to_batches()
        if texts:
            yield from pa.table({"word": [b""], "n": [texts]}).cast(kind).to_batches()

    kind = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    # the empty word stands for the end
    counts = stored(train.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    tokens, types, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.octet_length("word") == 0, F.col("n")))).first()
    real = counts.where(F.octet_length("word") > 0)
    sent = {bytes(r.word): r.n for r in frequent(real, "word", "n", SENT_WORDS)}
    most = own_words(types or 0)
    endings = 1 + most // WORDS_FOR_ENDING
    often = sorted(sent, key=lambda w: (-sent[w], w))
    own, often = sorted(often[:most]), often[most:]
    end = F.crc32(F.when(F.octet_length("word") > ENDING_BYTES, F.substring("word", -ENDING_BYTES, ENDING_BYTES)).otherwise(F.col("word"))) % endings
    n, v = np.zeros(endings, np.int64), np.zeros(endings, np.int64)
    for r in real.groupBy(end.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n[r.e], v[r.e] = r.n, r.v
    for w in own:  # they have classes of their own
        n[ending(w, endings)] -= sent[w]
        v[ending(w, endings)] -= 1
    often = own + often
    return Corpus(tokens or 0, types or 0, ends or 0, len(own), pa.array(often, pa.large_binary()),
                  np.array([sent[w] for w in often], np.int64), n, v), counts


def _part(grams: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal stretches of the hashes a gram's hash is in."""
    part = mix64(grams)
    part >>= np.uint64(32)
    part *= np.uint64(parts)
    part >>= np.uint64(32)
    return part.view(np.int64)


def _piece(part: int, grams: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """A row (part, distinct, grams, counts) of ascending grams: kept are the
    distances from one to the next."""
    return part, len(grams), np.diff(grams, prepend=0).tobytes(), counts.tobytes()


def _packed(part: int, grams: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """``_piece``, with as few bytes a number as the largest takes: a shard is one
    row, which every buffer on its way holds whole."""
    return part, len(grams), *(x.astype(np.min_scalar_type(x.max())).tobytes() for x in (np.diff(grams, prepend=0), counts))


def _added(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all pieces, packed or not, ascending, and the sums of their counts."""
    grams, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        for k, x, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            grams.append(np.cumsum(np.frombuffer(x, f"u{len(x) // k}"), dtype=np.int64))
            counts.append(np.frombuffer(n, f"u{len(n) // k}").astype(np.int64))
    g, n = np.concatenate(grams), np.concatenate(counts)
    if len(grams) == 2:  # one piece is ascending
        return g, n
    del grams, counts
    order = np.argsort(g)
    g = g[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    return g[first], np.add.reduceat(n[order], first) if len(first) else n


def _pieces(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, PIECE.types)], schema=PIECE)


#: Counted grams of one stretch of the hashes, as tasks pass them on.
PIECE = pa.schema([("part", pa.int32()), ("distinct", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_PIECE = "part int, distinct long, grams binary, counts binary"


def trigrams(train: DataFrame, corpus: Corpus, row: Callable = _piece) -> DataFrame:
    """Counts of class trigrams of all training texts, ends included: a piece for
    each stretch of the grams' hashes, of which there are as many as keep one to
    ``SHARD_GRAMS`` grams; a gram is its classes as digits of the number of classes.
    ``row`` makes the pieces, ``_packed`` smaller ones."""
    held, size, parts = train.sparkSession.sparkContext.broadcast(corpus), corpus.classes, _stretches(corpus.tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, n = [], 0

        def summed() -> pa.RecordBatch:
            g = np.concatenate(lists)
            lists.clear()
            g += _part(g, parts) * size ** 3
            g.sort()
            first = np.flatnonzero(np.diff(g, prepend=-1))
            total, g = np.diff(first, append=len(g)), g[first]
            edges = np.searchsorted(g, np.arange(parts + 1) * size ** 3)
            return _pieces([_packed(k, g[i:j] - k * size ** 3, total[i:j]) for k, (i, j) in enumerate(zip(edges, edges[1:])) if i < j])

        for b in _texts(batches, 0, SLICE):
            distinct, codes, lens = _coded(b.column(0))
            c2, c1, w, _ = _sequences(held.value.class_of(distinct)[codes], lens)
            lists.append((c2 * size + c1) * size + w)
            n += len(w)
            if n > HELD:
                yield summed()
                n = 0
        if n:
            yield summed()

    return _joined(train.mapInArrow(count, _PIECE), parts, row)


def _joined(pieces: DataFrame, parts: int, row: Callable) -> DataFrame:
    """A row for each part, of all its pieces; a task makes ``STRETCHES`` of them."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            for i, part in enumerate(b.column(0).to_pylist()):
                own.setdefault(part, []).append(b.slice(i, 1))
        for part in sorted(own):
            yield _pieces([row(part, *_added(own.pop(part)))])

    task = F.floor(F.col("part") / STRETCHES).cast("int")
    return pieces.repartitionById(-(-parts // STRETCHES), task).mapInArrow(join, _PIECE)


def _stretches(grams: int) -> int:
    return max(1, -(-grams // SHARD_GRAMS))


@dataclass
class Model:
    """Parameters: input vectors, output vectors, biases, position weights."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    c: np.ndarray  # weights of the word before last, and of the last

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int) -> Model:
        g, v = np.random.default_rng(seed), len(unigram)
        start = g.normal(0, 0.1, (v, SIZE)), g.normal(0, 0.1, (v, SIZE)), np.log(unigram), np.full((2, SIZE), 0.7)
        return cls(*(x.astype(np.float32) for x in start))

    def flat(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.c)])

    @classmethod
    def of_flat(cls, x: np.ndarray) -> Model:
        v = (len(x) - 2 * SIZE) // (2 * SIZE + 1)
        r, q, b, c = np.split(x, np.cumsum([v * SIZE, v * SIZE, v]))
        return cls(r.reshape(v, SIZE), q.reshape(v, SIZE), b, c.reshape(2, SIZE))

    def train(self, grams: np.ndarray, counts: np.ndarray, unigram: np.ndarray, seed: int, rate: float = 0.08) -> None:
        """One round of noise-contrastive steps: whole passes over the grams,
        as many as ``STEPS`` steps take, one at least. A pass takes every gram,
        weighted by its count; a large count is split into several samples. The
        noise, shared by a step's samples, follows the unigram."""
        v, g = len(unigram), np.random.default_rng(seed)
        most = 2 * counts.sum() / len(counts)
        times = np.ceil(counts / most).astype(np.int64)
        weight = counts / times
        samples = np.repeat(np.arange(len(grams)), times)
        weight *= len(samples) / counts.sum()  # 1 on average
        weight = (weight / SAMPLES).astype(np.float32)
        classes = np.stack([grams // (v * v), grams // v % v, grams % v], 1).astype(np.int32)
        noise_cdf, log_noise = np.cumsum(unigram), np.log(unigram * NOISE).astype(np.float32)
        sums = [np.full(p.shape, 1e-2, np.float32) for p in (self.r, self.q, self.b, self.c)]
        step_size, half = np.float32(rate * np.sqrt(SAMPLES)), np.float32(0.5)
        cells = np.arange(v * SIZE // 2).reshape(v, SIZE // 2)  # of each row of a parameter, two numbers a cell

        def climb(k: int, d: np.ndarray) -> None:
            """A step of the k-th parameter; what has no gradient stays."""
            p, s = (self.r, self.q, self.b, self.c)[k], sums[k]
            grown = d * d
            grown *= np.float32(SAMPLES)
            s += grown
            d *= step_size
            d /= np.sqrt(s, out=grown)
            p += d

        def summed(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """Sums over equal rows, in place of each class."""
            out = np.zeros(v * SIZE // 2, np.complex64)  # adds two numbers at a time
            np.add.at(out, cells.take(at, 0).ravel(), rows.view(np.complex64).ravel())
            return out.view(np.float32).reshape(v, SIZE)

        steps, one = -(-len(samples) // SAMPLES), np.ones(SAMPLES, np.float32)
        for step in range(steps * -(-STEPS // steps)):
            if step % steps == 0:
                g.shuffle(samples)
            pick = samples[step % steps * SAMPLES:][:SAMPLES]
            share, (f, l, w) = weight.take(pick), classes.take(pick, 0).T.astype(np.int64)
            noise = np.minimum(np.searchsorted(noise_cdf, g.random(NOISE)), v - 1)
            hat, q, q_noise = self.r.take(f, 0), self.q.take(w, 0), self.q[noise]
            hat *= self.c[0]
            hat += self.c[1] * self.r.take(l, 0)
            # 1 / (1 + exp(-x)) is (1 + tanh(x / 2)) / 2
            half_share = half * share
            good = np.einsum("ij,ij->i", hat, q) + self.b[w] - log_noise[w]
            d_good = half_share * (1 - np.tanh(half * good))
            d_bad = hat @ (half * q_noise).T
            d_bad += half * (self.b[noise] - log_noise[noise])
            np.tanh(d_bad, out=d_bad)
            d_bad += 1
            d_bad *= -half_share[:, None]
            d_hat = d_bad @ q_noise
            q *= d_good[:, None]
            d_hat += q
            d_far, d_last = summed(f, d_hat), summed(l, d_hat)
            d_c = np.stack([(d * self.r).sum(0) for d in (d_far, d_last)])
            d_noise, d_b = d_bad.T @ hat, np.bincount(w, d_good, v).astype(np.float32)
            hat *= d_good[:, None]
            d_q = summed(w, hat)
            np.add.at(d_q, noise, d_noise)
            np.add.at(d_b, noise, one[:len(pick)] @ d_bad)
            d_far *= self.c[0]
            d_last *= self.c[1]
            d_far += d_last
            climb(0, d_far)
            climb(1, d_q)
            climb(2, d_b)
            climb(3, d_c)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score part of the word before last, of the last with the bias, log
        normaliser), each by class pair. exp(a + b) = exp(a) exp(b), so one
        matrix product sums over all next words for every context."""
        far = (self.r * self.c[0]) @ self.q.T
        near = (self.r * self.c[1]) @ self.q.T + self.b
        top_far, top_near = far.max(1, keepdims=True).astype(np.float64), near.max(1, keepdims=True).astype(np.float64)
        shares = near - top_near
        np.exp(shares, out=shares)
        z = np.empty((len(far), len(near)))
        for i in range(0, len(far), CONTEXTS):  # products of all contexts at once would take as much again as the tables
            rows = slice(i, i + CONTEXTS)
            np.matmul(np.exp(far[rows] - top_far[rows]), shares.T, out=z[rows])
        np.log(np.maximum(z, 1e-300, out=z), out=z)
        z += top_far
        z += top_near.T
        return far, near, z


def fit(grams: DataFrame, corpus: Corpus, seed: int = 1) -> Model:
    """Train on all class trigrams: shards, by a hash of the trigram, train side
    by side, and their parameters are averaged, weighted by tokens, after a
    round. How Spark partitions the table makes no difference to the model."""
    kept = stored(grams, "trigrams")
    shards = _stretches(kept.agg(F.sum("distinct")).first()[0] or 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                g, n = _added([b.slice(i, 1)])
                part = _part(g, shards)
                yield _pieces([_packed(int(k), g[part == k], n[part == k]) for k in np.unique(part)])

    # a shard is a row, a few are a file; rounds scan them without a shuffle
    with passing(_joined(kept.mapInArrow(cut, _PIECE), shards, _packed), "shards") as table:
        discard(kept)
        return _fit(table, corpus, seed)


#: A run of the parameters that a shard has come to.
RUN = pa.schema([("shard", pa.int64()), ("run", pa.int32()), ("tokens", pa.int64()), ("numbers", pa.binary())])
_RUN = "shard long, run int, tokens long, numbers binary"


def _mean(table: pa.Table) -> pa.Table:
    """Mean of one run of the shards' parameters, weighted by tokens, as such a row."""
    rows, mean = table.sort_by("shard"), 0.0
    tokens = rows["tokens"].to_pylist()
    total = sum(tokens)
    for n, x in zip(tokens, rows["numbers"]):
        mean = mean + np.frombuffer(x.as_buffer(), np.float32) * (n / total)
    return pa.table([rows["shard"][:1], rows["run"][:1], [total], pa.array([mean.tobytes()], pa.binary())], schema=RUN)


def _fit(shards: DataFrame, corpus: Corpus, seed: int) -> Model:
    unigram = 1.0 + np.r_[corpus.ends, corpus.sent_counts[:corpus.own], corpus.class_tokens]
    unigram /= unigram.sum()
    model = Model.start(unigram, seed)
    if not corpus.tokens:
        return model
    context = shards.sparkSession.sparkContext
    for k in range(ROUNDS):
        held = context.broadcast((model, unigram))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, noise = held.value
            for b in batches:
                for i in range(b.num_rows):
                    shard, (g, n) = b.column(0)[i].as_py(), _added([b.slice(i, 1)])
                    m = Model(*(x.copy() for x in (start.r, start.q, start.b, start.c)))
                    m.train(g, n, noise, seed * 1000 + k + (shard << 20), 0.08 / (1 + k))
                    tokens, x = int(n.sum()), m.flat()
                    rows = [(shard, run, tokens, x[j:j + ADDED_NUMBERS].tobytes()) for run, j in enumerate(range(0, len(x), ADDED_NUMBERS))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RUN.types)], schema=RUN)

        # rows of one group and one run of the parameters are added up at a time
        done = shards.mapInArrow(each, _RUN)
        got = done.groupBy(F.shiftright("shard", ADDED.bit_length() - 1), "run").applyInArrow(_mean, _RUN).toArrow()
        runs = [_mean(got.filter(pc.equal(got["run"], r))) for r in range(pc.max(got["run"]).as_py() + 1)]
        model = Model.of_flat(np.concatenate([np.frombuffer(r["numbers"][0].as_py(), np.float32) for r in runs]))
    return model


@functools.lru_cache(1)
def _scorer(data: bytes):
    corpus, model = pickle.loads(data)
    return corpus, [x.ravel() for x in model.tables()], np.log10(corpus.class_tokens + corpus.class_types + 1.0)


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row, learnt from the rows outside fold ``held``.

    A null text is empty: one end. Without training rows all counts are 0 and
    the model is uniform over its classes. Repeated rows count and score as
    often as they stand; null ids are in fold 0 and stay null; other columns
    are not read.
    """
    part = fold(F.col(id_col), folds)
    rows = docs.select(F.col(id_col).alias("_id"), (part == held).alias("_held"), F.col(text).alias("_text"))
    train = rows.where(~F.col("_held")).select("_text")
    corpus, counts = survey(train)
    model = fit(trigrams(train, corpus, _packed), corpus)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps((corpus, model)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, (far, near, z), class_size = _scorer(sent.value)
        first, v = 1 + corpus.own, corpus.classes
        end_log, counted = np.log10(corpus.ends + 1.0), np.r_[corpus.sent_counts, 0]
        for b in _texts(batches, 3, SLICE):
            distinct, codes, n = _coded(b.column(3))
            place = pc.fill_null(pc.index_in(distinct, value_set=corpus.sent), -1).to_numpy().astype(np.int64)
            cls = corpus.class_of(distinct, place)
            known = np.where(place >= 0, counted[place], 0)
            log_count, doc = np.log10(known + 1.0), np.repeat(np.arange(len(n)), n)
            c2, c1, w, at = _sequences(cls[codes], n)
            lm = np.bincount(at, (far.take(c2 * v + w).astype(np.float64) + near.take(c1 * v + w) - z.take(c2 * v + c1)) / np.log(10), len(n))
            rare_class = cls[codes] - first
            other = rare_class >= 0
            lm += np.bincount(doc[other], log_count[codes[other]] - class_size[rare_class[other]], len(n))
            base = np.bincount(doc, log_count[codes], len(n)) + end_log
            found = np.bincount(doc, known[codes] > 0, len(n)).astype(np.int64) + (corpus.ends > 0)
            missing = known[codes] == 0  # not sent: joined with the counts
            pair, times = np.unique(doc[missing] * max(1, len(distinct)) + codes[missing], return_counts=True)
            owner, code = np.divmod(pair, max(1, len(distinct)))
            words, ends = distinct.take(pa.array(code)).cast(pa.binary()), np.searchsorted(owner, np.arange(len(n) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [words, pa.array(times.astype(np.int32))], ["word", "m"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n + 1), pa.array(found), pa.array(base), pa.array(lm), lists],
                ["_row", "_id", "_held", "n", "known", "base", "lm", "rare"])

    done = stored(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_held", "_text").mapInArrow(
        run, f"_row long, _id {kind}, _held boolean, n long, known long, base double, lm double, "
             "rare array<struct<word: binary, m: int>>"), "scores")
    rare = (done.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.m").join(counts, "word")
            .groupBy("_row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("log")))
    total = F.lit(corpus.tokens + corpus.types + 1.0)
    extra = F.coalesce("log", F.lit(0.0))
    return done.drop("rare").join(rare, "_row", "left").select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n") * F.log10(total)).alias("base_score"), (F.col("lm") + extra).alias("score"))
