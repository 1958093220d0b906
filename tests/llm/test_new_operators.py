"""Hard negatives, language identification and whitening: against brute force, SQL and held-out texts, and on awkward tables."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scripts.check_oracle import compare, duck
from tidemark.llm import langid, negatives, whiten
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"
NAN = float("nan")


# --------------------------------------------------------------------- 11 --
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 40), st.integers(1, 70), st.integers(0, 2 ** 31), st.sampled_from([3, 2 ** 20, 2 ** 28]))
def test_strassen_is_the_product(m, k, n, seed, size):
    g = np.random.default_rng(seed)
    a, b = g.integers(-size, size, (m, k)), g.integers(-size, size, (k, n))
    assert (negatives.strassen(a, b, leaf=4) == a @ b).all()


@given(st.integers(-2 ** 62, 2 ** 62))
def test_window_is_exact(p):
    lo, hi = negatives.window(np.array([p]))
    assert (lo[0], hi[0]) == (-((-30 * p) // 100), 90 * p // 100)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(-3, 3)), max_size=40), st.integers(0, 40))
def test_heaps_merge(rows, cut):
    def best(of):
        o, k, s = (np.array(c, np.int64) for c in (zip(*of) if of else ((), (), ())))
        return [of[i] for i in negatives.heap(o, k, s, 3)]

    assert best(best(rows[:cut]) + best(rows[cut:])) == best(rows)


def test_negatives_are_the_oracles(spark):
    ok, msg = compare(spark, duck(SF), SF, "op11_strassen_negatives")
    assert ok, msg


def _mined(rows, is_anchor, low=30, high=90):
    """Brute force over (id, label, whole vector)."""
    out = []
    for i, label, x in rows:
        if not is_anchor(i):
            continue
        other = sorted(((-sum(a * b for a, b in zip(x, y)), j, k) for j, k, y in rows if j != i), key=lambda r: r[:2])
        for s, j, _ in [r for r in other if r[2] == label][:5]:
            near = [r for r in other if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:10]
            out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("cell_rows", [negatives.CELL_ROWS, 7])
def test_negatives_of_a_hot_label_ties_and_small_cells(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 2)
    g = np.random.default_rng(3)
    rows = [(i, int(g.choice([0, 0, 0, 1, 2])), g.integers(-2, 3, 3).tolist()) for i in range(90)]
    v = spark.createDataFrame([(i, k, [c / 256 for c in x]) for i, k, x in rows], "vec_id long, label int, embedding array<float>")
    got = negatives.mine(v, F.col("vec_id") % 10 == 0, cell_rows=cell_rows).collect()
    assert sorted(map(tuple, got)) == _mined(rows, lambda i: i % 10 == 0)


def test_negatives_awkward(spark):
    kind = "vec_id long, embedding array<double>, label int, id string, cell int, asked boolean, twin long"
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 0.5], 3), (3, [0.25, 0.5], 3), (4, [1.0, 0.0], None),
            (5, None, 1), (6, [None, 1.0], 1), (7, [NAN, 1.0], 1), (8, [math.inf, 1.0], 2), (9, [1.0], 2), (None, [0.5, 0.0], 2), (100, [0.0, 0.0], 1)]
    v = spark.createDataFrame([(i, x, k, "a", 1, None, 2) for i, x, k in rows], kind)
    got = sorted(map(tuple, negatives.mine(v, F.col("vec_id") % 100 == 0).collect()))
    # the other row of id 3 scores a quarter, below the window
    want = [(0, 1, n, j, 256 * 256, 128 * 256) for n, j in ((1, 2), (2, 3))]
    # the row of zeros scores 0 with every row, and so does its window; both rows of id 3 are there
    want += [(100, p, n, j, 0, 0) for p in (0, 1) for n, j in ((1, 2), (2, 3), (3, 3))]
    assert got == sorted(want)
    assert negatives.mine(v.limit(0), F.lit(True)).count() == 0
    assert negatives.mine(v.where("label is null"), F.lit(True)).count() == 0
    far = spark.createDataFrame([(0, [1e9], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(far, F.lit(True)).collect()


# --------------------------------------------------------------------- 12 --
def test_languages_are_told(spark):
    docs = table(spark, SF, "documents")
    said = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(said) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r.lang_pred == said[r.doc_id] for r in got if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in got)


def _plain_cost(text: bytes, counts) -> float:
    """Bits of a text by escape and exclusion, symbol by symbol; counts: {context: {symbol: n}}."""
    s = [0]
    for x in text:
        c = x - 128 + 27 if x > 127 else (x | 32) - 96 if chr(x).isalpha() else 0
        if c or s[-1]:
            s.append(c)
    bits, padded = 0.0, [0, 0, *s]
    for i in range(3, len(padded)):
        context, gone, p = tuple(padded[i - 3:i]), set(), 1.0
        while True:
            own = counts.get(context, {}) if context is not None else dict.fromkeys(range(langid.SYMBOLS), 1)
            left = {k: n for k, n in own.items() if k not in gone}
            if context is None:
                p *= 1 / len(left)
                break
            total, kinds = sum(own.values()), len(own)
            # after the bytes of longer contexts are excluded, the rest of this context is renormalised
            if own:
                share = {k: n / (total + kinds) for k, n in own.items()}
                rest = 1 - sum(v for k, v in share.items() if k in gone)
                if padded[i] in left:
                    p *= share[padded[i]] / rest
                    break
                p *= (rest - sum(share[k] for k in left)) / rest
                gone |= own.keys()
            context = context[1:] if context else None
        bits -= math.log2(p)
    return bits


def test_code_lengths_are_those_of_escapes_and_exclusion(spark):
    texts = [("a", "abra cadabra abracadabra, dab!"), ("a", "a bad cab\n\nbar"), ("b", "Über grün, öde über Öl übt")]
    model = langid.train(spark.createDataFrame(texts, "lang string, text string"), share=0.0)
    trees = {}
    for lang in ("a", "b"):
        counts = defaultdict(lambda: defaultdict(int))
        for name, t in texts:
            s, _ = langid.folded([t.encode()])
            padded = [0, 0, *s.tolist()]
            for i in range(3, len(padded)) if name == lang else ():
                for k in range(4):
                    counts[tuple(padded[i - k:i])][padded[i]] += 1
        trees[lang] = counts
    probe = ["abra", "cadüber x", "", "zzz", "a" * 50, "日本 ab"]
    got = model.cost([t.encode() for t in probe])
    assert model.langs == ["a", "b"]
    for row, t in zip(got, probe):
        for cost, lang in zip(row, model.langs):
            assert abs(cost / langid.UNIT - _plain_cost(t.encode(), trees[lang])) < 0.01, (t, lang)


def test_code_lengths_do_not_depend_on_neighbours(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs)
    texts = [r.text.encode() for r in docs.limit(40).collect()] + [b"", b"x", b"  ", b"ab" * 5000]
    alone = np.concatenate([model.cost([t]) for t in texts])
    monkeypatch.setattr(langid, "CHUNK", 777)
    assert (model.cost(texts) == alone).all()
    s, off = langid.folded(texts)
    assert sum(map(len, langid.keys(texts))) == len(s) - len(texts)


def test_language_table_is_bounded(spark):
    docs = table(spark, SF, "documents")
    model = langid.train(docs, cells=4 * 60 * 400)
    assert model.lengths.size <= 4 * 60 * 400
    got = langid.predict(docs, model).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_languages_awkward(spark):
    kind = "doc_id long, text string, lang string, lang_pred string, score string, `a.b` int"
    long = "le chat noir dort sur la table " * 40_000
    rows = [(1, "the cat sat on the mat with the dog", "en"), (2, "le chat et le chien dans la rue", "fr"), (2, "le chat et le chien dans la rue", "fr"),
            (3, None, "fr"), (4, "", "en"), (5, "12 34 !?", "en"), (None, "the dog", None), (6, long, None), (7, "漢字かな", None), (8, "\U0001f642 ²", None)]
    docs = spark.createDataFrame([(i, t, k, "old", "x", 1) for i, t, k in rows], kind)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    said = defaultdict(set)
    for r in got:
        said[r.doc_id].add((r.held_out, r.lang_pred, r.score))
    assert all(len(v) == 1 for v in said.values())  # repeated rows alike
    pred = {k: next(iter(v)) for k, v in said.items()}
    assert [pred[k][1] for k in (1, 2, 6)] == ["en", "fr", "fr"] and pred[None][0] is True
    assert all(pred[k][1:] == ("und", 0.0) for k in (3, 4, 5, 8)) and pred[7][1] in ("en", "fr")
    whole = langid.predict(docs, None)
    assert set(whole.columns) == set(docs.columns) and {(r.lang_pred, r.score) for r in whole.collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --------------------------------------------------------------------- 13 --
@pytest.mark.parametrize("d", [1, 2, 5, 17, 64])
def test_components_are_the_eigenvectors(d):
    a = np.random.default_rng(d).normal(size=(d, d + 3))
    a = a @ a.T
    e, v = whiten.components(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-12) and np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    assert np.abs(a @ v - v * e).max() < 1e-13 * e[0]
    some, few = whiten.components(a, 3)
    assert np.allclose(some, e[:3], rtol=1e-12) and np.allclose(few, v[:, :3], atol=1e-9)


def test_components_of_repeated_and_vanishing_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(7, 7)))[0]
    for want in ([3, 3, 3, 1, 1e-9, 0, 0], [1] * 7, [0] * 7, [5, 4, 3, 2, 1, 0, -1], [1, 0, 0, 0, 0, 0, 0]):
        a = q @ np.diag(np.array(want, float)) @ q.T
        e, v = whiten.components((a + a.T) / 2)
        assert np.allclose(e, want, atol=1e-13) and np.abs(v.T @ v - np.eye(7)).max() < 1e-13


def test_polar_factor_is_the_matrix_sign():
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(6, 6)))[0]
    a = q @ np.diag([5, 1e-3, 1e-8, -1e-8, -2, -7]) @ q.T
    assert np.allclose(whiten.polar((a + a.T) / 2), q @ np.diag([1, 1, 1, -1, -1, -1]) @ q.T, atol=1e-6)


def _whitened(x, most=4):
    u = np.unique(x, axis=0)
    centred = u - u.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / len(u))
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    s = u.sum(0)
    return (x - u.mean(0)) @ v / np.sqrt(e), e / (centred ** 2).sum() * len(u), [sum(int(c) ** 2 for c in len(u) * r - s) for r in x.astype(int)], len(u)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_whitening_is_that_of_a_plain_eigensolver(spark, sf):
    v = table(spark, sf, "embeddings")
    rows = sorted(v.collect(), key=lambda r: r.vec_id)
    x = np.floor(256 * np.array([r.embedding for r in rows], np.float64))
    want, share, deviation, n = _whitened(x)
    got = sorted(whiten.whiten(v).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == [(r.vec_id, c) for r in rows for c in (1, 2, 3, 4)]
    mine = np.array([r.whitened for r in got]).reshape(-1, 4)
    assert np.abs(mine - want * np.sign((mine * want).sum(0))).max() < 1e-10
    assert np.allclose([r.explained for r in got[:4]], share, rtol=1e-12)
    assert [r.deviation for r in got[::4]] == deviation and {r.n for r in got} == {n} and got[0].identity_error < 1e-12


def test_sums_stay_exact_for_large_components(spark):
    g = np.random.default_rng(4)
    rows = [(i, [float(c) for c in g.integers(-2 ** 45, 2 ** 45, 3)]) for i in range(50)]
    v = spark.createDataFrame([*rows, *rows[:20]], "vec_id long, embedding array<double>")
    x = [[int(256 * c) for c in r] for _, r in rows]
    distinct, dim = whiten.whole(v, "vec_id", "embedding")
    model = whiten.fit(distinct.select("x").distinct(), dim, 3)
    assert model.n == 50 and [50 * int(c) + int(r) for c, r in zip(model.centre, model.rest)] == [sum(c) for c in zip(*x)]
    assert set(model.deviation(np.array(x))) == {None} and model.identity_error < 1e-9


def test_whitening_awkward(spark):
    kind = "vec_id long, embedding array<float>, component int, whitened string, n int"
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [0.5, 0.25]), (3, None), (4, [None, 1.0]), (5, [NAN, 1.0]), (6, [1.0]), (7, [])]
    v = spark.createDataFrame([(i, x, 1, "w", 2) for i, x in rows], kind)
    got = whiten.whiten(v).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((i, c) for i in ("0", "0", "2", "None") for c in (1, 2)) and {r.n for r in got} == {3}
    want, share, deviation, _ = _whitened(np.array([[256, 0], [0, 256], [128, 64]], float), 2)
    by = {(r.vec_id, r.component): r for r in got}
    for i, k in enumerate((0, None, 2)):
        assert np.allclose([abs(by[k, c].whitened) for c in (1, 2)], np.abs(want[i])) and by[k, 1].deviation == deviation[i]
    alike = whiten.whiten(v.where("vec_id = 0")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alike] == [(c, 1, 0, 0.0, 0.0, 0.0) for c in (1, 2)] * 2
    assert whiten.whiten(v.limit(0)).count() == 0 and whiten.whiten(v.where("embedding is null")).count() == 0
