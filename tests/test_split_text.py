"""Large plain text read by byte ranges equals Spark's one-task multi-line reader."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidemark import ingest
from tidemark.sources import split_text
from tidemark.sources.text import _bytes, _reader, read_delimited, splits_by_range


@pytest.fixture()
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in kept.items():
        spark.conf.set(k, v)


def _whole(spark, paths, names=("a", "b", "c"), sep=","):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return Counter(tuple(r) for r in _reader(spark, sep, "UTF-8", True).option("header", "true").schema(schema).csv(paths).collect())


def _random_file(g: random.Random) -> str:
    nl, wild = g.choice(["\n", "\n", "\r\n"]), g.random() < 0.5

    def field() -> str:
        kind = g.random()
        if kind < 0.4:
            return "".join(g.choice("ab é1 ") for _ in range(g.randint(0, 5)))
        if kind < 0.8 or not wild:
            return '"' + "".join(g.choice(["a", "b", ",", '""', nl, nl, " ", "é"]) for _ in range(g.randint(0, 12))) + '"'
        return "".join(g.choice('ab" ,') for _ in range(g.randint(0, 6)))  # quotes where none should be

    rows = [",".join(field() for _ in range(g.randint(1, 4))) if g.random() < 0.7 else "" for _ in range(g.randint(0, 60))]
    text = "a,b,c" + nl + "".join(r + nl for r in rows)
    return ("﻿" if g.random() < 0.2 else "") + (text[:-len(nl)] if g.random() < 0.2 else text)


@pytest.mark.parametrize("seed", range(7))
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, small_ranges, seed):
    g = random.Random(seed)
    paths = []
    for i in range(3):
        paths.append(str(tmp_path / f"{i} x.csv"))
        (tmp_path / f"{i} x.csv").write_bytes(_random_file(g).encode())
    want = _whole(spark, paths)
    small_ranges(g.choice([16, 50, 200]))
    assert Counter(tuple(r) for r in split_text.read_records(spark, paths, ["a", "b", "c"], ",").collect()) == want


@given(st.lists(st.text(alphabet='ab",', max_size=12), max_size=6), st.booleans())
def test_two_states_tell_all(found, inside):
    """The state after some lines from either start is the composition of theirs."""
    def after(state):
        for line in found:
            state = split_text.open_after(line.encode(), b",", state)
        return state

    assert after(inside) == (after(True) if inside else after(False))
    # against a reader of single characters: S field start, U plain, Q quoted, E quote in quoted
    mode = "Q" if inside else "S"
    for line in found:
        for c in line:
            if mode == "Q":
                mode = "E" if c == '"' else "Q"
            elif mode == "E" and c == '"':
                mode = "Q"
            else:
                mode = "Q" if mode == "S" and c == '"' else "S" if c == "," else "U"
        mode = "Q" if mode == "Q" else "S"
    assert after(inside) == (mode == "Q")


def test_states_of_ranges(spark, tmp_path, small_ranges):
    p = tmp_path / "s.csv"
    p.write_text("a,b,c\n" + 'x,"' + "line\n" * 40 + '",y\n' + "1,2,3\n" * 40)
    small_ranges(32)
    rows = sorted(split_text.range_states(spark, [str(p)], ",").collect(), key=lambda r: r.start)
    quoted = range(6 + 3, 6 + 3 + 5 * 40)  # a range that starts there begins with a line inside the quotes
    assert len(rows) > 8 and [r.inside for r in rows] == [r.start in quoted for r in rows] and not any(r.crlf or r.lone or r.cut for r in rows)


def test_large_plain_file_is_parsed_by_many_tasks(spark, db, tmp_path, small_ranges):
    p = tmp_path / "big.csv"
    p.write_text("a,b,c\n" + "".join(f'{i},"line {i}\nof ""two"", {i % 7}",{i / 2}\n' for i in range(20_000)))
    want = _whole(spark, [str(p)])
    small_ranges("64k")
    assert splits_by_range(spark, [str(p)], ",", "UTF-8") and not splits_by_range(spark, [str(p)], ",", "ISO-8859-1")
    (names, df), = read_delimited(spark, [str(p)])
    assert names == ["a", "b", "c"] and df.rdd.getNumPartitions() > 8
    assert Counter(tuple(r) for r in df.collect()) == want
    m = ingest(spark, str(p), "big", database=db)
    assert m["rowcount"] == 20_000 and dict(spark.table(f"{db}.big").dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert spark.table(f"{db}.big").where("b LIKE 'line %\n%of \"two\", %'").count() == 20_000


def test_fragments_of_one_file_are_dealt_to_many_tasks(spark, tmp_path, small_ranges):
    p = tmp_path / "long.csv"
    p.write_text("a,b,c\n" + "".join(f'{i},"' + "text \n" * (i % 60) + f'",{i}\n' for i in range(400)))
    want = _whole(spark, [str(p)])
    small_ranges(100)
    df = split_text.read_records(spark, [str(p)], ["a", "b", "c"], ",")
    assert Counter(tuple(r) for r in df.collect()) == want
    # no operator gathers the texts of a file
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_records_that_run_through_ranges_know_their_begin(spark, tmp_path, small_ranges):
    p = tmp_path / "s.csv"
    p.write_text("a,b,c\n" + 'x,"' + "line\n" * 40 + '",y\n' + "1,2,3\n" * 40)
    small_ranges(32)
    assert {r.begin for r in split_text.range_states(spark, [str(p)], ",").collect() if r.inside} == {0}


def test_csv_of_many_tasks(spark, tmp_path, small_ranges, monkeypatch):
    """The documents are written by the tasks that read them; each file is read by ranges."""
    from tidemark import registry_load

    rows = [(i, f'line {i}\nof "two", ' + "x" * 300, "en", "s", i) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    small_ranges("64k")
    loaded = []
    monkeypatch.setattr(registry_load, "ingest", lambda spark, path, *a, **kw: loaded.append(path) or ingest(spark, path, *a, **kw))
    got = registry_load.s_csv_split(spark, str(tmp_path))
    assert sorted(got.collect()) == rows
    files = spark.read.format("binaryFile").load(loaded[0]).select("length").collect()
    assert len(files) >= 4 and max(f.length for f in files) > 1 << 18


def test_headers_are_checked_and_lone_returns_left_to_spark(spark, tmp_path, small_ranges):
    a, b, c = (tmp_path / f"{n}.csv" for n in "abc")
    a.write_text("x,y\n" + "1,2\n" * 50)
    b.write_text("y,x\n" + "1,2\n" * 50)
    c.write_text("x,y\r" + "1,2\r" * 50)
    small_ranges(40)
    with pytest.raises(Exception, match="header of a file does not match"):
        split_text.read_records(spark, [str(a), str(b)], ["x", "y"], ",").collect()
    with pytest.raises(Exception, match="header of a file does not match"):
        split_text.read_records(spark, [str(a)], ["x"], ",").collect()
    assert split_text.read_records(spark, [str(c)], ["x", "y"], ",") is None
    (names, df), = read_delimited(spark, [str(c)])
    assert df.count() == 50
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "1.csv").write_text('\n\n"x"\t y \n' + "1\t\n" * 30)
    (folder / "2.csv").write_text('"x"\t y \n')
    (names, df), = read_delimited(spark, [str(folder)], fmt="tsv")
    assert names == ["x", "y"] and df.collect() == [("1", None)] * 30


def test_sizes():
    assert [_bytes(t) for t in ("128m", "134217728b", "134217728", "1gb", "64k")] == [1 << 27, 1 << 27, 1 << 27, 1 << 30, 1 << 16]
