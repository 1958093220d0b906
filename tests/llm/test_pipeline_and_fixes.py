"""Every pipeline stage's rows, texts and order against plain Python; any column names; op5's bounds; op6 and op9 row by row."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import gam, kmtree, lbl, mixing, rules, suffix
from tidemark.llm.common import numbered, table
from test_llm_operators import VOCAB, _classes, _removed, library  # noqa: F401 - a fixture

SF = "/root/testdata/sf0.001"
ODD = ("position", "_file", "_row", "_start", "_metadata", "_key", "_text", "_hash", "_id", "block", "slot", "class_id", "n", "file", "row", "at", "c0", "a.b", "ids", "spans")


def _stage_rows(model, rows):
    """(quality, near duplicates, repeated passages): what each stage leaves, by plain Python."""
    good = [r for r in rows if model.score(np.array([gam.features((r[1] or "").encode())]))[0] >= gam.THRESHOLD]
    roots: dict = {}
    for (i, root, _), r in zip(_classes([(r[0], (r[1] or "").encode()) for r in good]), good):
        roots.setdefault(root, []).append(r)
    kept = [min(v, key=lambda r: r[0]) for v in roots.values()]
    removed = []
    texts = [(r[0], (r[1] or "").encode()) for r in kept]
    seen = Counter(t[i:i + 200] for _, t in texts for i in range(len(t) - 199))
    for i, t in texts:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k:k + 200]] > 1:
                mark[k:k + 200] = True
        removed.append((i, bytes(np.frombuffer(t, np.uint8)[~mark]).decode("utf-8", "ignore")))
    return good, kept, removed


@pytest.fixture(scope="module")
def ran(spark):
    """One run on the small table: the rows that each stage left, in the order of
    the files, and the last one's."""
    seen, kept = [], corpus_pipeline.STAGES
    corpus_pipeline.STAGES = [(n, (lambda f: lambda spark, docs, sf: seen.append(docs) or f(spark, docs, sf))(f)) for n, f in kept]
    try:
        last = corpus_pipeline.run(spark, SF).collect()
    finally:
        corpus_pipeline.STAGES = kept
    left = [sorted(numbered(d, "position").collect(), key=lambda r: r.position) for d in seen[1:]]
    assert all(d.dtypes == seen[0].dtypes for d in seen)
    return [*left, last]


def test_stages_leave_the_rows_and_texts_of_plain_python(spark, ran):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good, kept, cut = _stage_rows(gam.train(docs, table(spark, SF, "labels")), rows)
    assert 0 < len(kept) < len(good) < len(rows)
    assert sorted((r.doc_id, r.text) for r in ran[0]) == sorted(good)
    assert sorted((r.doc_id, r.text) for r in ran[1]) == sorted(kept)
    assert sorted((r.doc_id, r.text) for r in ran[2]) == sorted(cut) and any(len(t) < len(dict(kept)[i]) for i, t in cut)
    assert all(r.n_chars == len(r.text) for r in ran[2])


def test_mixed_order_is_that_of_the_schedule(spark, ran):
    before, after = ran[2], ran[3]
    assert sorted(tuple(r)[:-1] for r in before) == sorted(tuple(r)[:-1] for r in after)
    n = Counter(r.source for r in before)
    names = sorted(n, key=lambda s: (s is not None, str(s)))
    blocks = np.array([-(-n[s] // mixing.BLOCK) for s in names])
    weights = np.array([n[s] ** mixing.TEMPERATURE for s in names])
    order = []
    for ph_index, ph in enumerate(phases := mixing.schedule(blocks, weights)):
        for k in range(ph.periods):
            source, block, slot, *_ = mixing.period_slots(phases, ph_index, k)
            order += list(zip(slot.tolist(), source.tolist()))
    left, want = Counter(n), []
    for _, s in sorted(order):
        take = min(mixing.BLOCK, left[names[s]])
        want += [names[s]] * take
        left[names[s]] -= take
    assert [r.source for r in after] == want


def test_last_stage_is_the_library_in_the_order_of_the_mix(ran, library):  # noqa: F811
    got = sorted(ran[4], key=lambda r: r.position)
    assert [(r.position, r.doc_id) for r in got] == [(k, r.doc_id) for k, r in enumerate(ran[3])]
    for r, before in zip(got, ran[3]):
        assert r.ids == library.encode(before.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture()
def odd(spark):
    long = " ".join(f"wörd{i % 997}" for i in range(3_000))
    good = next(r.text for r in table(spark, SF, "documents").limit(50).collect() if len(r.text) > 300)
    rows = [(1, good, None), (1, good, None), (2, None, "s"), (3, "", "s"), (None, "x y", "t"), (4, long, "t"), (5, long + " tail", "t"), (6, " \n\t ", None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in ODD)
    return spark.createDataFrame([(i, t, None, s, None, *["x"] * len(ODD)) for i, t, s in rows], kind)


def test_pipeline_takes_any_column_names(spark, odd, tmp_path):
    folder = str(tmp_path / "sf")
    odd.repartition(3).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(folder + "/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and sorted(r.position for r in got) == list(range(len(got)))
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == odd.dtypes, name
        assert all(tuple(r)[5:] == ("x",) * len(ODD) for r in docs.collect()), name


def test_pipeline_of_empty_and_null_tables(spark, odd, tmp_path):
    for k, rows in enumerate((odd.limit(0), odd.select(*[F.lit(None).cast(t).alias(c) for c, t in odd.dtypes]))):
        folder = str(tmp_path / f"sf{k}")
        rows.write.parquet(folder + "/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(folder + "/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert len(got) == min(k, 1) and all(r.doc_id is None and r.n_tokens == 0 for r in got)


def test_numbering_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.range(500).selectExpr("id", "'x' AS file", "'y' AS `Position`", "1 AS _metadata").repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    got = numbered(spark.read.parquet(path), "position")
    assert got.columns == ["id", "file", "_metadata", "position"]
    assert all(r.id == r.position and r.file == "x" and r["_metadata"] == 1 for r in got.collect())


# ---------------------------------------------------------------------- 3 --
def test_model_does_not_depend_on_partitions(spark, monkeypatch):
    for name, n in (("ROUNDS", 2), ("STEPS", 10), ("SHARD_GRAMS", 4_000), ("OWN_SCALE", 12)):
        monkeypatch.setattr(lbl, name, n)
    docs, kept, got = table(spark, SF, "documents"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got.append(sorted((r.doc_id, r.score) for r in lbl.score(docs.repartition(parts)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert [i for i, _ in got[0]] == [i for i, _ in got[1]]
    assert np.abs(np.array([s for _, s in got[0]]) - np.array([s for _, s in got[1]])).max() < 1e-8


# ---------------------------------------------------------------------- 5 --
def test_long_texts_are_cut_in_chunks_without_a_loss(spark, monkeypatch):
    g = np.random.default_rng(2)
    noise = bytes(g.integers(97, 123, 3_000, np.uint8)).decode()
    rows = [(1, "ab" * 2_000), (2, noise + "xyz" * 900 + noise[:700]), (3, noise[1_000:1_900]), (4, "q" + "ab" * 300), (5, "z" * 5_000), (6, noise[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(_removed([(i, t.encode()) for i, t in rows], 200))
    monkeypatch.setattr(suffix, "CHUNK", 611)
    parts = suffix.segments([t.encode() for _, t in rows])
    assert max(parts[2]) <= 611 and sum(parts[2]) == sum(max(0, len(t) - 199) for _, t in rows)
    for bytes_ in (suffix.HOT_BYTES, 2_000, 0):
        assert sorted(map(tuple, suffix.dedup_report(docs, hot_bytes=bytes_).collect())) == want


def test_long_periodic_text_keeps_to_its_memory():
    import tracemalloc
    text = b"ab" * (6 << 20)
    tracemalloc.start()
    doc, first, size, own, inner = suffix.segments([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size.max() <= suffix.CHUNK and size.sum() == len(text) - 199 and peak < 300 << 20


# ---------------------------------------------------------------------- 6 --
def test_rows_of_one_id_count_by_the_larger_score(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.75, 0.0]), (1, [0.25, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = kmtree.search(v, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 0.75), (2, 2, 0.5)]


def test_scores_are_exact_products(spark):
    v = table(spark, "/root/testdata/sf0.01", "embeddings")
    x = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in v.collect()}
    for r in kmtree.search(v, F.col("vec_id") % 20 == 0, bin_rows=64).collect():
        assert abs(r.score - sum(a * b for a, b in zip(x[r.query_id], x[r.vec_id]))) < 1e-15


# ---------------------------------------------------------------------- 9 --
def _plain_base(text: str) -> tuple:
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    lines = [ln for ln in text.split("\n") if re.search(r"[^ \t-\r]", ln)]
    triples = Counter(zip(words, words[1:], words[2:]))
    near = {i + k for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(near))


def test_rules_row_by_row(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    ratios = rules.log_ratios(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rules.judge(docs, ratios).collect():
        n = _plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        at, _ = rules.gram_buckets([texts[r.doc_id].encode()])
        llr = sum(ratios[at]) / max(1, len(at))
        assert abs(r.llr - llr) < 1e-9 and r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and r.llr >= rules.THRESHOLD)


def test_ratio_of_a_document_does_not_depend_on_its_neighbours(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    ratios = rules.log_ratios(docs, labels)
    whole = {(r.doc_id, r.llr) for r in rules.judge(docs, ratios).collect()}
    assert whole == {(r.doc_id, r.llr) for r in rules.judge(docs.repartition(17).union(docs.limit(9)), ratios).collect()}


def test_plain_scorer_agrees(spark):
    docs = table(spark, SF, "documents")
    model = gam.train(docs, table(spark, SF, "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in gam.score(docs, model).collect():
        x = gam.features(texts[r.doc_id].encode())
        alone = model.score(np.array([x]))[0]
        assert abs(r.score - alone) < 1e-12 and r.predicted == (alone >= 0.3)


def test_components_stop_as_soon_as_all_are_stars(spark, monkeypatch):
    import random

    from tidemark.llm import components as cc

    kept, calls = cc.stored, []
    monkeypatch.setattr(cc, "stored", lambda df, name: calls.append(name) or kept(df, name))
    g = random.Random(5)
    for edges, rounds in (([(k, 0) for k in range(1, 30)] + [(41, 40), (40, 41), (7, 7)], 1),
                          ([(g.randrange(60), g.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)], None)):
        calls.clear()
        root = {n: n for e in edges for n in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        linked = {n for a, b in edges if a != b for n in (a, b)}
        got = cc.components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b").collect()
        assert sorted(map(tuple, got)) == sorted((n, r) for n, r in root.items() if n in linked)
        assert rounds is None or calls.count("stars") == rounds
