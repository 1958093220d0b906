"""Every corpus operator against brute force, an exact round trip or held-out labels, and on awkward tables."""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, gam, jaccard, kmtree, lbl, mixing, rules, suffix, tokens, warc
from tidemark.llm.common import concat, ranges, table

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, _id string, spans int"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, an empty and a long text, ties and repeated rows, clashing names."""
    long = " ".join(f"wörd{i % 997}" for i in range(30_000))
    rows = [(1, "a b c d e f", None), (1, "a b c d e f", None), (2, None, "s"), (3, "", "s"), (None, "x y", "t"), (4, long, "t"),
            (5, long + " tail", "t"), (6, " \n\t ", None), (7, "aaaa" * 200, "s"), (2, "other text of id two", "s")]
    return spark.createDataFrame([(i, t, None, s, None, 1.5, "k", "i", 3) for i, t, s in rows], AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], AWKWARD)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCAB)


# ---------------------------------------------------------------------- 1 --
def test_gam_holds_out_and_separates(spark, docs):
    big = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in gam.score(big, gam.train(big, labels)).collect()}
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95


def test_gam_learns_a_pair():
    g = np.random.default_rng(0)
    x = np.zeros((3000, len(gam.FEATURES)))
    x[:, :2] = g.random((3000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells alone
    m = gam.AdditiveModel.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


def test_gam_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = gam.train(awkward, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (5, 0)], none.schema))
    out = gam.score(awkward, model).collect()
    assert len(out) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    prior = gam.train(empty, none)
    assert gam.score(empty, prior).count() == 0 and gam.keep_good(awkward, prior).columns == awkward.columns


# ---------------------------------------------------------------------- 2 --
def test_bpe_is_the_library(docs, texts, library):
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in bpe.encode(docs, VOCAB, lexicon_words=500).collect():
        assert r.ids == ids[r.doc_id] and r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_bpe_hard_texts(library):
    hard = ["", "   a   b  ", "a\n\n b \n", "a \n b", "x<|endoftext|> y<|endoftext|>", "aaaa aaaaaaa", "\x1c a\x1d b", "a　 b\x85c    d",
            "don't I'LL 'sx", "½²٣ x", "\t\t x \t y", "日本語 テキスト", "🙂🙂 a", "​ a᠎ b "]
    lexicon = bpe.Lexicon.mapped(bpe.compile_lexicon({w: bpe.vocabulary(VOCAB).merge([w])[0] for w in (b" a", b" b", b"a", b"don", b" \xf0")}))
    signs = ["a", "b", " ", " ", "\n", "\t", "\xa0", "\x85", "\u3000", "\x1f", "'s", "1", "!", "é", "日", "<|endoftext|>"]
    g = np.random.default_rng(5)
    hard += ["".join(signs[k] for k in g.integers(0, len(signs), n)) for n in g.integers(0, 14, 3000)]
    want = [e.ids for e in library.encode_batch(hard, add_special_tokens=False)]
    for enc in (bpe.Encoder(bpe.vocabulary(VOCAB), lexicon), bpe.Encoder(bpe.vocabulary(VOCAB))):
        assert enc.batch(hard) == want
    assert [x.tolist() for x in tokens.LibraryEncoder(VOCAB).batch(pa.array([None, *hard]))] == [[], *want]


def test_bpe_joins_what_is_known_of_chunks(library, monkeypatch):
    """The texts' parts are joined by Arrow; only texts that are not cut take the way by ``batch``."""
    hard = ["", " a", "a  b", "x<|endoftext|> y", "a \n b", "\u3000 a", "don't do it", " ", "z\xa0 z", "\U0001f642 \U0001f642\U0001f642", "é è a"]
    signs = ["a", "bc", " ", " ", "\n", "\xa0", "\x85", "'s", "1", "!", "é", "日", "<|endoftext|>"]
    g = np.random.default_rng(6)
    hard += ["".join(signs[k] for k in g.integers(0, len(signs), n)) for n in g.integers(0, 14, 2000)]
    enc, odd = bpe.Encoder(bpe.vocabulary(VOCAB)), []
    real = enc.batch
    monkeypatch.setattr(enc, "batch", lambda texts: odd.extend(texts) or real(texts))
    want = [[], *(e.ids for e in library.encode_batch(hard, add_special_tokens=False)), [64]]
    for _ in range(2):
        got = enc.coded(pa.array([None, *hard, "a"]))
        assert got.ids.to_pylist() == want
        assert got.decimals == [",".join(map(str, x)).encode() for x in want]
        assert [t.decode("utf-8", "replace") for t in got.decoded] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert 0 < len(odd) < len(hard) * 1.6 and "don't do it" not in odd and "x<|endoftext|> y" in odd
    assert enc.coded(pa.array([], pa.string())).ids.to_pylist() == []
    assert enc.coded(pa.array(hard)[3:5]).ids.to_pylist() == want[4:6]


def test_lexicon_is_minimal_and_exact():
    words = {w: (k, k + 1) for k, w in enumerate([b"tap", b"taps", b"top", b"tops", b"a", b"tapsx"])}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    probe = [*words, b"ta", b"", b"zz", b"tapsy", b"topsx"]
    assert [lex.output(int(i)) if i >= 0 else None for i in lex.find(probe)] == [*words.values(), *[None] * 5]
    shared = bpe.Lexicon(bpe.compile_lexicon({w: (1,) for w in (b"tap", b"taps", b"top", b"tops")}))
    assert len(shared.finals) - 1 == 5  # t, a|o, p, s share their ends


def test_bpe_awkward(awkward, empty, library):
    out = bpe.encode_digests(awkward, VOCAB, with_ids=True).collect()
    assert len(out) == 10 and sorted(r.n_tokens for r in out)[:2] == [0, 0] and all(len(r.ids) == r.n_tokens for r in out)
    assert bpe.encode(empty, VOCAB).count() == 0


# ---------------------------------------------------------------------- 3 --
def test_lbl_base_is_exact_and_model_is_normalised(spark, docs, texts, monkeypatch):
    for name, n in (("ROUNDS", 1), ("STEPS", 30), ("SENT_WORDS", 300), ("OWN_SCALE", 10)):
        monkeypatch.setattr(lbl, name, n)
    c, ends = Counter(), 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t.encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    better = []
    for r in lbl.score(docs).collect():
        w = texts[r.doc_id].encode().lower().split()
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1))
        assert abs(base - r.base_score) < 1e-8 * abs(base) and (r.n_tokens, r.train_tokens) == (len(w) + 1, n)
        assert r.n_known == sum(c[x] > 0 for x in w) + 1
        better.append(r.score > r.base_score)
    assert np.mean(better) > 0.5
    far, near, z = lbl.Model.start(np.full(9, 1 / 9), 1).tables()
    assert np.allclose(np.exp(far[:, None] + near[None] - z[:, :, None]).sum(2), 1)


def test_lbl_trains_on_every_gram(monkeypatch):
    monkeypatch.setattr(lbl, "STEPS", 1)
    monkeypatch.setattr(lbl, "SAMPLES", 64)
    v = 3_000  # each class is the context of one gram, and the word of another
    grams, counts = np.arange(v) * (v * v) + np.roll(np.arange(v), 1) * v + np.roll(np.arange(v), 2), np.random.default_rng(1).zipf(1.8, v)
    start, model = (lbl.Model.start(np.full(v, 1 / v), 1) for _ in range(2))
    model.train(grams, np.minimum(counts, 10_000), np.full(v, 1 / v), 1)
    assert (model.r != start.r).any(1).all() and (model.q != start.q).any(1).all()


def test_lbl_words():
    texts = [" a\tB\x0bc\x0c", None, "", "\n \r", "\x1cx\x85y z\u00a0\u0130 A b", "ß Ä"]
    want = [[w for w in re.split("[\t-\r ]+", t or "") if w] for t in texts]
    want = [[w.encode().lower() for w in ws] for ws in want]
    for i in range(len(texts)):  # slices too
        distinct, codes, n = lbl._coded(pa.array(texts).slice(i))
        words = distinct.to_pylist()
        assert n.tolist() == list(map(len, want[i:])) and [words[c] for c in codes] == [w for ws in want[i:] for w in ws]


def test_lbl_classes_follow_the_vocabulary():
    sizes = [lbl.own_words(10 ** k) for k in range(3, 13)]
    assert all(b > a for a, b in zip(sizes, sizes[1:])) and lbl.own_words(64 * 10 ** 6) == 2 * lbl.own_words(10 ** 6)


def test_lbl_step_is_the_gradient(monkeypatch):
    """One step against sums written out sample by sample."""
    v, g = 7, np.random.default_rng(3)
    for name, n in (("STEPS", 1), ("SAMPLES", 40), ("NOISE", 5)):
        monkeypatch.setattr(lbl, name, n)
    grams, unigram = g.permutation(v ** 3)[:40], g.dirichlet(np.ones(v))
    start, model = (lbl.Model.start(unigram, 1) for _ in range(2))
    model.train(grams, np.ones(40, np.int64), unigram, 9, 0.1)
    again = np.random.default_rng(9)
    again.shuffle(np.arange(40))
    noise = np.minimum(np.searchsorted(np.cumsum(unigram), again.random(5)), v - 1)
    r, q, b, c = (x.astype(float) for x in (start.r, start.q, start.b, start.c))
    d = [np.zeros(x.shape) for x in (r, q, b, c)]
    for x in grams.tolist():
        f, l, w = x // (v * v), x // v % v, x % v
        hat = c[0] * r[f] + c[1] * r[l]
        for k, good in [(w, True), *((k, False) for k in noise.tolist())]:
            p = 1 / (1 + np.exp(-(hat @ q[k] + b[k] - np.log(unigram[k] * 5))))
            e = ((1 - p) if good else -p) / 40
            d[0][f] += e * q[k] * c[0]
            d[0][l] += e * q[k] * c[1]
            d[1][k] += e * hat
            d[2][k] += e
            d[3][0] += e * q[k] * r[f]
            d[3][1] += e * q[k] * r[l]
    for p, x, e in zip((r, q, b, c), (model.r, model.q, model.b, model.c), d):
        assert np.allclose(x, p + 0.1 * e * np.sqrt(40) / np.sqrt(0.01 + e * e * 40), atol=1e-5)


def test_lbl_classes_of_many_words():
    words = [b"", b"a", b"ab", b"abc", b"abcd", b"\xff\x00\x01zz", b"the", b"of"]
    held = pa.array(words, pa.large_binary())
    corpus = lbl.Corpus(9, 9, 1, 2, pa.array([b"abc", b"the", b"of"], pa.large_binary()), np.ones(3, np.int64), np.zeros(97, int), np.zeros(97, int))
    want = [{b"abc": 1, b"the": 2}.get(w, 3 + zlib.crc32(w[-3:]) % 97) for w in words]
    assert corpus.class_of(held).tolist() == want and corpus.class_of(held.slice(3, 4)).tolist() == want[3:7]
    place = np.array([[b"abc", b"the", b"of"].index(w) if w in (b"abc", b"the", b"of") else -1 for w in words])
    assert corpus.class_of(held, place).tolist() == want


def test_lbl_trigrams_are_counted_in_pieces(spark, docs, texts, monkeypatch):
    """Few rows of many grams leave the tasks, and hold every gram once."""
    for name, n in (("SHARD_GRAMS", 5_000), ("HELD", 1_000), ("SLICE", 1 << 14), ("OWN_SCALE", 10)):
        monkeypatch.setattr(lbl, name, n)
    train = docs.select("text").toDF("_text")
    corpus, _ = lbl.survey(train)
    rows = lbl.trigrams(train, corpus).collect()
    got, v = Counter(), corpus.classes
    for r in rows:
        grams = np.cumsum(np.frombuffer(r.grams, np.int64))
        assert r.distinct == len(grams) and not got.keys() & set(grams.tolist())
        got.update(dict(zip(grams.tolist(), np.frombuffer(r.counts, np.int64).tolist())))
    own, want = corpus.sent.to_pylist()[:corpus.own], Counter()
    for t in texts.values():
        line = [0, 0, *(own.index(w) + 1 if w in own else 1 + len(own) + lbl.ending(w, len(corpus.class_tokens)) for w in t.encode().lower().split()), 0]
        want.update((a * v + b) * v + c for a, b, c in zip(line, line[1:], line[2:]))
    assert got == want and len(rows) == -(-corpus.tokens // 5_000)
    after = np.bincount([g % v for g in want], list(want.values()), v)
    assert (after == np.r_[corpus.ends, corpus.sent_counts[:corpus.own], corpus.class_tokens]).all()


def test_lbl_shards_are_packed():
    """A shard of half a million grams is one row: of megabytes, not of 16 bytes a gram."""
    g = np.random.default_rng(1)
    grams, counts = np.unique(g.integers(0, 1_880 ** 3, 100_000)), None
    for counts in (g.zipf(1.6, len(grams)).clip(max=200), g.integers(1, 1 << 40, len(grams))):
        row = lbl._packed(3, grams, counts)
        got = lbl._added([lbl._pieces([row])])
        assert (got[0] == grams).all() and (got[1] == counts).all()
        twice = lbl._added([lbl._pieces([row, lbl._piece(3, grams[::2], counts[::2])])])  # packed or not
        assert (twice[0] == grams).all() and (twice[1] == counts + counts * (np.arange(len(grams)) % 2 == 0)).all()
    assert sum(map(len, lbl._packed(3, grams, np.minimum(counts, 200))[2:])) <= 5 * len(grams)


def test_lbl_tables_without_a_copy():
    """Besides the tables, one array of their size and a few of their rows."""
    model, v = lbl.Model.start(np.full(1_500, 1 / 1_500), 1), 1_500
    tracemalloc.start()
    far, near, z = model.tables()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3.6 * 8 * v * v
    assert np.allclose(z, np.log(np.exp(far.astype(float)) @ np.exp(near.astype(float)).T))


def test_lbl_tasks_count_several_stretches(spark, docs, monkeypatch):
    for name, n in (("SHARD_GRAMS", 5_000), ("HELD", 1_000), ("OWN_SCALE", 10)):
        monkeypatch.setattr(lbl, name, n)
    train = docs.select("text").toDF("_text")
    corpus, _ = lbl.survey(train)
    plain, packed = ({r.part: r for r in lbl.trigrams(train, corpus, row).select("*", F.spark_partition_id().alias("p")).collect()} for row in (lbl._piece, lbl._packed))
    assert sorted(plain) == sorted(packed) == list(range(-(-corpus.tokens // 5_000))) and all(r.p == k // lbl.STRETCHES for k, r in packed.items())
    for k, r in plain.items():
        both = [lbl._added([lbl._pieces([(k, x.distinct, bytes(x.grams), bytes(x.counts))])]) for x in (r, packed[k])]
        assert (both[0][0] == both[1][0]).all() and (both[0][1] == both[1][1]).all() and 2 * len(packed[k].grams) <= len(r.grams)


def test_lbl_parameters_are_averaged_in_runs(monkeypatch):
    """No row that is averaged holds a whole model, and the runs make up their weighted mean."""
    monkeypatch.setattr(lbl, "ADDED_NUMBERS", 1_000)
    models, tokens = [lbl.Model.start(np.full(40, 1 / 40), k) for k in range(3)], [5, 2, 9]
    flat, out = [m.flat() for m in models], []
    for run, i in enumerate(range(0, len(flat[0]), 1_000)):
        rows = [(k, run, n, x[i:i + 1_000].tobytes()) for k, (n, x) in enumerate(zip(tokens, flat))]
        mean = lbl._mean(pa.table([list(c) for c in zip(*rows[::-1])], schema=lbl.RUN))
        assert mean["tokens"].to_pylist() == [16] and mean["run"].to_pylist() == [run]
        out.append(np.frombuffer(mean["numbers"][0].as_py(), np.float32))
    got = lbl.Model.of_flat(np.concatenate(out))
    for f in ("r", "q", "b", "c"):
        want = sum(getattr(m, f) * (n / 16) for m, n in zip(models, tokens))
        assert getattr(got, f).shape == want.shape and np.allclose(getattr(got, f), want, atol=1e-6)


def test_lbl_survey_drops_the_last_scorer():
    """A worker that has scored keeps no tables while it works on the next query."""
    corpus = lbl.Corpus(9, 3, 1, 1, pa.array([b"a"], pa.large_binary()), np.ones(1, np.int64), np.ones(1, int), np.ones(1, int))
    lbl._scorer(pickle.dumps((corpus, lbl.Model.start(np.full(3, 1 / 3), 1))))
    step = []

    class Texts:
        def mapInArrow(self, f, kind):
            step.append(f)
            raise StopIteration

    with pytest.raises(StopIteration):
        lbl.survey(Texts())
    assert lbl._scorer.cache_info().currsize == 1 and list(step[0](iter([]))) == [] and lbl._scorer.cache_info().currsize == 0


def test_lbl_awkward(awkward, empty, monkeypatch):
    monkeypatch.setattr(lbl, "ROUNDS", 1)
    monkeypatch.setattr(lbl, "STEPS", 3)
    out = lbl.score(awkward).collect()
    assert len(out) == 10 and all(np.isfinite([r.base_score, r.score]).all() and r.n_tokens >= 1 for r in out)
    assert lbl.score(empty).count() == 0


# ---------------------------------------------------------------------- 4 --
@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 5000])
def test_coder_round_trip(n):
    g = np.random.default_rng(n)
    for ids in (g.integers(0, 50257, n), np.zeros(n, int), np.minimum(50256, g.pareto(1, n) * 5).astype(int)):
        lanes, data = tokens.pack(ids.astype(np.uint32), 50257)
        assert (tokens.unpack(data, n, 50257, lanes) == ids).all()


def test_coder_bits():
    """Contexts are worth it: fewer bits an id than the ids' frequencies alone would take."""
    g = np.random.default_rng(4)
    ids = np.minimum(50256, g.pareto(0.8, 1 << 18) * 20).astype(np.uint32)
    follows = g.integers(0, 50257, 50257, dtype=np.uint32)
    at = np.flatnonzero(g.random(len(ids)) < 0.4)[1:]
    for k in at.tolist():
        ids[k] = follows[ids[k - 1]]
    lanes, data = tokens.pack(ids, 50257)
    shares = np.bincount(ids) / len(ids)
    assert len(data) * 8 / len(ids) < 0.95 * -(shares[shares > 0] * np.log2(shares[shares > 0])).sum()
    assert (tokens.unpack(data, len(ids), 50257, lanes) == ids).all()


class _Asked:
    """A library that remembers what it is asked to encode."""

    def __init__(self, library):
        self.library, self.asked = library, []

    def encode_batch_fast(self, texts, **options):
        self.asked += [w for t in texts for w in (t if options.get("is_pretokenized") else [t])]
        return self.library.encode_batch_fast(texts, **options)


def test_library_is_asked_once_for_each_word(library):
    """Whatever the white space around it: no text but one with a special token goes to the library whole."""
    enc = tokens.LibraryEncoder(VOCAB)
    enc.library, enc.by_word = _Asked(enc.library), _Asked(enc.by_word)
    texts = ["one  two, three.\n  one\ttwo", " two, one  two, extraordinarily-longish ", "extraordinarilylongish extraordinarilylongish"]
    for _ in range(2):
        assert [x.tolist() for x in enc.batch(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.library.asked == [] and len(enc.by_word.asked) == len(set(enc.by_word.asked))
    enc.batch(pa.array([None, "<|endoftext|> one"]))
    assert enc.library.asked == ["<|endoftext|> one"]


def test_library_encoder_in_stretches(library, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 7)
    monkeypatch.setattr(tokens, "MEMO_WORDS", 20)
    enc = tokens.LibraryEncoder(VOCAB)
    texts = [f"word{k} and some, more  text don't\n" + "x" * k + "\0" * (k % 4) + "é日 " * (k % 3) for k in range(60)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for k in range(0, 60, 9) for x in enc.batch(pa.array(texts).slice(k, 9))] == want


def test_memo_keys_are_exact():
    words = [b"\0", b"\0\0", b"a", b"a\0", *(b"x" * n for n in range(1, 16)), *(b"%d" % n for n in range(3000))]
    data = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    sizes = np.array(list(map(len, words)))
    low, high = tokens.Memo.keys(data, np.cumsum(sizes) - sizes, sizes)
    memo, values = tokens.Memo(4), np.arange(1, len(words) + 1, dtype=np.uint64)
    assert not memo.find(low, high).any()
    for k in range(0, len(words), 500):
        memo.put(low[k:k + 500], high[k:k + 500], values[k:k + 500])
        assert (memo.find(low, high) == np.where(np.arange(len(words)) < k + 500, values, 0)).all()


def test_damaged_block_is_found():
    data = bytearray(tokens.write_block([(1, np.arange(50)), (None, np.array([], int))], 50))
    assert [(i, x.tolist()) for i, x in tokens.read_block(bytes(data))] == [(1, list(range(50))), (None, [])]
    data[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokens.read_block(bytes(data))


def test_token_files(docs, texts, library):
    got = {r.doc_id: r for r in tokens.round_trip(docs, VOCAB, block_ids=5000).collect()}
    start = 0
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_awkward(awkward, empty):
    out = sorted(tokens.round_trip(awkward, VOCAB).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 1, 2, 2, 3, 4, 5, 6, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
    assert tokens.round_trip(empty, VOCAB).count() == 0


# ---------------------------------------------------------------------- 5 --
def _removed(rows, width):
    seen = Counter(t[i:i + width] for _, t in rows for i in range(len(t) - width + 1))
    out = []
    for i, t in rows:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if seen[t[k:k + width]] > 1:
                mark[k:k + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mark])
        out.append((i, len(t), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix.HOT_SEGMENTS, 0])
def test_suffix_dedup(docs, texts, hot):
    want = _removed([(i, t.encode()) for i, t in texts.items()], 200)
    got = suffix.dedup_report(docs, hot=hot).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_two_stage_order_is_a_suffix_array():
    rng = random.Random(1)
    for trial in range(60):
        parts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 5))]
        t, off = concat(parts)
        wanted = ranges(off[:-1], np.maximum(np.diff(off) - 8, 0))
        order, padded = suffix.two_stage_order(t, wanted, 9), t.tobytes() + bytes(9)
        keys = [padded[i:i + 9] for i in order]
        assert sorted(order) == sorted(wanted) and keys == sorted(keys)


def test_suffix_awkward(awkward, empty):
    rows = [(r.doc_id, (r.text or "").encode()) for r in awkward.collect()]
    got = suffix.dedup_report(awkward).collect()
    order = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(_removed(rows, 200), key=order)
    cut = suffix.remove_repeats(awkward)
    assert cut.columns == awkward.columns and cut.count() == 10 and suffix.dedup_report(empty).count() == 0


# ---------------------------------------------------------------------- 6 --
def test_kmtree_recall_and_order(spark):
    v = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = v.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32).astype(float)
    from pyspark.sql import functions as F
    got: dict = {}
    for r in kmtree.search(v, F.col("vec_id") % 20 == 0, bin_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21)) and [-z for _, _, z in found] == sorted(-z for _, _, z in found)
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & {i for _, i, _ in found}) / 20)
    assert np.mean(hits) >= 0.9


def test_kmtree_calibrates_to_its_target():
    x = np.random.default_rng(5).normal(size=(4_000, 16))
    tree = kmtree.Tree.fit(x)
    assert tree.calibrate(x, 20) >= 0.98 and tree.visits < tree.leaves


def test_kmtree_awkward(spark):
    from pyspark.sql import functions as F
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [None, 1.0]),
            (8, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    v = spark.createDataFrame([(i, x, "z") for i, x in rows], "vec_id long, embedding array<double>, leaf string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kmtree.search(v, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert kmtree.search(v.limit(0), F.lit(True)).count() == 0


# ---------------------------------------------------------------------- 7 --
def test_warc_ranges_find_every_record_once(spark):
    pages = table(spark, SF, "pages")
    from tidemark.llm.files import new_folder
    folder = new_folder(spark, "warc-test")
    archives = warc.write(pages, folder, archive_bytes=20_000)
    got = warc.read(archives, folder, range_bytes=997).collect()
    want = {r.page_id: r.html.encode() for r in pages.collect()}
    assert sorted(r.page_id for r in got) == sorted(want)
    assert all(bytes(r.payload) == want[r.page_id] for r in got if r.record_type == "response")


def test_warc_awkward(spark):
    inner = warc.record(9, "u", b"x" * 50, None, False).decode("latin-1")
    rows = [(1, "http://a/ b\r\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "lone"), (6, "u", inner), (7, "u", "é" * 100_000)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 7 and (got[1].record_type, got[1].refers_to) == ("revisit", 2) and (got[3].record_type, got[3].refers_to) == ("revisit", 4)
    assert got[1].payload_bytes == 4 and got[1].payload_digest == got[2].payload_digest == warc.digest(b"same") and got[7].payload_bytes == 200_000
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------------- 8 --
def test_pfair_keeps_every_source_within_a_block():
    for seed in range(40):
        g = np.random.default_rng(seed)
        k = int(g.integers(1, 9))
        blocks, weights = g.integers(1, 200, k), g.random(k) + 0.01
        phases = mixing.schedule(blocks, weights, 64)
        src, blk = np.repeat(np.arange(k), blocks), np.concatenate([np.arange(b) for b in blocks])
        slot, _, release, due = mixing.slots_of(phases, src, blk)
        assert sorted(slot) == list(range(blocks.sum())) and (release <= slot).all() and (slot < due).all()
        order = src[np.argsort(slot)]
        for p in phases:
            ran, share = np.zeros(k), p.share / p.share.sum()
            for t, s in enumerate(order[p.slot:p.slot + p.length]):
                ran[s] += 1
                assert (np.abs(ran - share * (t + 1)) < 1).all()


@pytest.mark.parametrize("blocks, weights", [
    ([2_000] * 20, [1] * 20), ([30_000, 20_000, 1], [0.6, 0.4 - 1e-5, 1e-5]), ([300, 200, 40], [0.6, 0.4, 0]), ([900, 500, 300], [0.5, 0.3, 0.2])])
def test_pfair_follows_the_weights_passed_in(blocks, weights):
    blocks, weights = np.array(blocks), np.array(weights, float)
    phases = mixing.schedule(blocks, weights, 64)
    src, blk = np.repeat(np.arange(len(blocks)), blocks), np.concatenate([np.arange(b) for b in blocks])
    slot, _, release, due = mixing.slots_of(phases, src, blk)
    assert sorted(slot) == list(range(blocks.sum()))
    first = phases[0].length
    ran = np.zeros((first, len(blocks)))
    ran[np.arange(first), src[np.argsort(slot)][:first]] = 1
    w = weights / weights.sum()
    assert (np.abs(ran.cumsum(0) - np.outer(np.arange(1, first + 1), w)) < 1).all()
    for s in np.flatnonzero(w):
        j = np.arange(min(blocks[s], int(first * w[s])))
        at = np.searchsorted(src, s) + j
        assert (np.abs(release[at] - j / w[s]) < 1 + 1e-6).all() and (np.abs(due[at] - (j + 1) / w[s]) < 1 + 1e-6).all()


def test_mix_places_rows_by_the_schedule(spark):
    rows = spark.range(9_000).selectExpr("id doc_id", "case when id % 9 < 5 then 'a' when id % 9 < 8 then 'b' end source", "cast(id as string) text")
    out = mixing.mix(rows, {"a": 0.7, "b": 0.3}, block=2, period=64).collect()
    counts = Counter(r.source for r in out)
    assert counts == {"a": 5_000, "b": 3_000, None: 1_000} and len({r.doc_id for r in out}) == 9_000
    number = {None: 0, "a": 1, "b": 2}
    phases = mixing.schedule(np.array([500, 2_500, 1_500]), np.array([0, 0.7, 0.3]), 64)
    want = mixing.slots_of(phases, np.array([number[r.source] for r in out]), np.array([r.block for r in out]))
    assert all(np.array_equal(w, [r[c] for r in out]) for w, c in zip(want, ("slot", "phase", "release", "deadline")))
    assert sorted(r.position for r in out) == list(range(9_000)) and all(r.position // 2 == r.slot for r in out)


def test_mix_awkward(awkward, empty, docs):
    out = mixing.mix(awkward, {"s": 2, "t": 1}, block=2).collect()
    assert len(out) == 10 and len({r.position for r in out}) == 10
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns
    whole = mixing.mixed(docs, block=4)
    assert whole.columns == docs.columns and sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in docs.collect())


# ---------------------------------------------------------------------- 9 --
def test_rules_base_and_verdict(spark):
    big, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = {r.doc_id: r for r in rules.judge(big, rules.log_ratios(big, labels)).collect()}
    for r in big.limit(150).collect():
        b = r.text.encode()
        w = b.split()
        seen = Counter(zip(w, w[1:], w[2:]))
        near = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
        g = got[r.doc_id]
        assert (g.n_words, g.n_repeat_words) == (len(w), len(near)) and g.word_chars == sum(len(x.decode()) for x in w)
        assert g.base_failed == (len(w) < 50 or 100 * len(near) > 50 * len(w)) and not (g.kept and g.base_failed)
    judged = [(r.quality, got[r.doc_id].kept) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.97


def test_rules_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.judge(awkward, rules.log_ratios(awkward, none)).count() == 10
    assert rules.judge(empty, rules.log_ratios(empty, none)).count() == 0
    assert rules.counts(b"") == (0, 0, 0, 0, 0) and rules.counts(b"a a a a\na a a a\n\n#") == (9, 9, 1, 1, 8)


# --------------------------------------------------------------------- 10 --
def _classes(rows):
    sets = [jaccard._ngrams(t, 5) for _, t in rows]
    key = [b" ".join(t.split()) for _, t in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if key[i] == key[j] or (both and both >= 0.8 * len(sets[i] | sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda k: -2 ** 63 if rows[k][0] is None else rows[k][0])
                root[b] = a
    return [(rows[i][0], rows[find(i)][0], links[i]) for i in range(n)]


@pytest.mark.parametrize("node_sets,block", [(jaccard.NODE_SETS, jaccard.BLOCK), (3, 2)])
def test_jaccard_join_finds_every_link(spark, node_sets, block):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), node_sets=node_sets, block=block).collect()
    assert sorted(tuple(r) for r in got) == sorted(_classes([(i, t.encode()) for i, t in rows]))


def test_jaccard_awkward(awkward, empty):
    order = lambda r: tuple(-1 if x is None else x for x in r)
    rows = [(r.doc_id, (r.text or "").encode()) for r in awkward.collect()]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(awkward).collect()), key=order)
    assert got == sorted(_classes(rows), key=order)
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(order((r.doc_id,)) for r in kept.collect()) == [(-1,), (1,), (2,), (2,), (4,), (7,)]
    assert jaccard.near_duplicates(empty).count() == 0


# --------------------------------------------------------------- pipeline --
def test_pipeline_stages(spark, docs):
    import corpus_pipeline
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.dtypes == docs.dtypes, name
        rows = spark.createDataFrame(out.collect(), docs.schema)
    assert 0 < rows.count() < docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert last.count() == rows.count()


def test_pipeline_keeps_the_order_of_the_mix(spark, monkeypatch):
    import corpus_pipeline

    mixed_in = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [
        ("some", lambda spark, docs, sf_dir: docs), ("mixing sources", lambda spark, docs, sf_dir: mixed_in.append(docs) or corpus_pipeline.mix_sources(spark, docs, sf_dir)),
        corpus_pipeline.STAGES[-1]])
    # files of one task each, several rows a file, so that size and order differ
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxRecordsPerFile", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", "37")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
        want = [r.doc_id for r in mixing.mix(mixed_in[0]).orderBy("position").collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(r.position for r in got) == list(range(len(want)))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == want
