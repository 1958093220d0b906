"""Published tables dealt into buckets: kept by appends, compaction and streams; joins need no shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from conftest import SF_SMALL
from tidemark import ingest
from tidemark.operators import publish as pub
from tidemark.plans.trips import read_table
from tidemark.sources.paths import FileFormat
from tidemark.streaming.landing import batch_loader


@pytest.fixture()
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_and_lines_join_where_they_are_stored(spark, db, tmp_path, no_broadcast):
    o, li = str(tmp_path / "o.parquet"), str(tmp_path / "l.parquet")
    read_table(spark, SF_SMALL, "orders").write.parquet(o)
    read_table(spark, SF_SMALL, "lineitem").write.parquet(li)
    ingest(spark, o, "orders", database=db, bucket_by=("o_orderkey", 4))
    ingest(spark, li, "lines", database=db, bucket_by=("l_orderkey", 4))
    join = "SELECT o_orderkey, count(*) n FROM {0}.orders JOIN {0}.lines ON o_orderkey = l_orderkey WHERE o_orderdate < '1997-01-01' GROUP BY o_orderkey".format(db)
    assert "Exchange" not in _plan(spark.sql(join))
    once = {r.o_orderkey: r.n for r in spark.sql(join).collect()}
    for _ in range(2):  # appends keep the buckets, given or not
        ingest(spark, li, "lines", database=db, if_exists="append")
    assert "Exchange" not in _plan(spark.sql(join))
    assert {r.o_orderkey: r.n for r in spark.sql(join).collect()} == {k: 3 * n for k, n in once.items()} and once
    with pytest.raises(ValueError, match="dealt by"):
        ingest(spark, li, "lines", database=db, if_exists="append", bucket_by=("l_orderkey", 5))
    parts = pub.compact(spark, db, "lines")
    assert len(parts) == 1 and "Exchange" not in _plan(spark.sql(join))
    assert {r.o_orderkey: r.n for r in spark.sql(join).collect()} == {k: 3 * n for k, n in once.items()}
    files = spark.table(pub.fq(db, parts[0])).inputFiles()
    assert len(files) % 4 == 0  # whole files for each bucket


def test_replace_keeps_or_changes_the_buckets(spark, db, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.range(50).selectExpr("id", "id % 3 AS k").write.parquet(p)
    ingest(spark, p, "t", database=db, bucket_by=("k", 3))
    ingest(spark, p, "t", database=db)
    assert pub.published_buckets(pub.published_state(spark, db, "t")[1]) == ("k", 3)
    ingest(spark, p, "t", database=db, bucket_by=("id", 2))
    assert pub.published_buckets(pub.published_state(spark, db, "t")[1]) == ("id", 2)
    with pytest.raises(ValueError, match="no column"):
        ingest(spark, p, "u", database=db, bucket_by=("x", 2))
    assert not spark.catalog.tableExists(f"{db}.u") and sorted(r.id for r in spark.table(f"{db}.t").collect()) == list(range(50))


def test_streamed_batches_are_dealt_too(spark, db, tmp_path, no_broadcast):
    p = str(tmp_path / "t.parquet")
    spark.range(20).write.parquet(p)
    ingest(spark, p, "s", database=db, bucket_by=("id", 3))
    load = batch_loader(db, "s", "ck", FileFormat.CSV, T.StructType([T.StructField("id", T.LongType())]))
    load(spark.createDataFrame([("7",), ("8",)], "id string"), 0)
    grouped = spark.table(f"{db}.s").groupBy("id").count()
    assert "Exchange" not in _plan(grouped) and {r.id: r["count"] for r in grouped.collect()}[7] == 2
