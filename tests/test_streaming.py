"""Landing-folder stream: each file published once, restarts resume, replays do not duplicate."""

from pyspark.sql import types as T

from tidemark.operators.publish import published_parts
from tidemark.streaming import landing_stream


def _run(spark, landing, db, ckpt, **kw):
    q = landing_stream(spark, str(landing) + "/*.csv", "trips_2024_01", database=db, checkpoint=ckpt, **kw)
    q.awaitTermination()
    assert q.exception() is None


def test_stream_appends_each_file_once(spark, db, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text("id,pickup_datetime\n1,2024-01-01 00:00:00\n2,2024-01-02 00:00:00\n")
    ckpt = str(tmp_path / "ckpt")
    _run(spark, landing, db, ckpt)
    t = spark.table(f"{db}.trips_2024_01")
    assert dict(t.dtypes) == {"id": "bigint", "pickup_datetime": "string"}
    assert t.count() == 2
    _run(spark, landing, db, ckpt)                       # nothing new: nothing appended
    assert spark.table(f"{db}.trips_2024_01").count() == 2
    (landing / "b.csv").write_text("id,pickup_datetime\n3,2024-01-03 00:00:00\n")
    _run(spark, landing, db, ckpt)
    assert sorted(r.id for r in spark.table(f"{db}.trips_2024_01").collect()) == [1, 2, 3]
    assert len(published_parts(spark, db, "trips_2024_01")) == 2


def test_replayed_batch_is_not_published_twice(spark, db):
    """foreachBatch may run a batch again after a failure; it is published once."""
    from tidemark.sources.paths import FileFormat
    from tidemark.streaming.landing import _batch_table, batch_loader

    load = batch_loader(db, "replay_t", "ckpt-x", FileFormat.CSV, T.StructType([T.StructField("id", T.LongType())]))
    batch = spark.createDataFrame([("1",), ("2",)], "id string")
    load(batch, 0)
    load(batch, 0)
    assert spark.table(f"{db}.replay_t").count() == 2
    assert published_parts(spark, db, "replay_t") == [_batch_table("replay_t", "ckpt-x", 0)]
    load(batch, 1)
    assert spark.table(f"{db}.replay_t").count() == 4


def test_replay_after_compaction_is_still_recognised(spark, db):
    from tidemark.sources.paths import FileFormat
    from tidemark.streaming.landing import batch_loader

    load = batch_loader(db, "cmp_stream", "ckpt-y", FileFormat.CSV, T.StructType([T.StructField("id", T.LongType())]), compact_after=2)
    batch = spark.createDataFrame([("1",)], "id string")
    for i in range(5):
        load(batch, i)
    assert len(published_parts(spark, db, "cmp_stream")) <= 2
    for i in range(5):          # every batch replayed: nothing is appended again
        load(batch, i)
    assert spark.table(f"{db}.cmp_stream").count() == 5
    load(batch, 5)
    assert spark.table(f"{db}.cmp_stream").count() == 6


def test_stream_file_with_other_column_order_fails(spark, db, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text("id,v\n1,x\n")
    ckpt = str(tmp_path / "ckpt")
    q = landing_stream(spark, str(landing) + "/*.csv", "order_t", database=db, checkpoint=ckpt)
    q.awaitTermination()
    (landing / "b.csv").write_text("v,id\ny,2\n")
    q = landing_stream(spark, str(landing) + "/*.csv", "order_t", database=db, checkpoint=ckpt)
    try:
        q.awaitTermination()
        failed = q.exception() is not None
    except Exception:  # noqa: BLE001
        failed = True
    assert failed
    assert spark.table(f"{db}.order_t").collect() == [(1, "x")]


def test_parquet_stream_takes_footer_schema(spark, db, tmp_path):
    landing = tmp_path / "pq"
    spark.range(5).selectExpr("id", "cast(id as tinyint) AS small").write.parquet(str(landing / "m1"))
    q = landing_stream(spark, str(landing) + "/*", "pq_t", fmt="parquet", database=db,
                       checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    t = spark.table(f"{db}.pq_t")
    assert dict(t.dtypes) == {"id": "bigint", "small": "smallint"} and t.count() == 5


def test_archive_processed_files(spark, db, tmp_path):
    import os
    landing, archive = tmp_path / "in", tmp_path / "archive"
    landing.mkdir()
    (landing / "a.csv").write_text("id\n1\n")
    ckpt = str(tmp_path / "ck")
    q = landing_stream(spark, str(landing), "arch_t", database=db, checkpoint=ckpt,
                       clean_source="archive", archive_dir=str(archive))
    q.awaitTermination()
    (landing / "b.csv").write_text("id\n2\n")      # archiving happens as later batches commit
    q = landing_stream(spark, str(landing), "arch_t", database=db, checkpoint=ckpt,
                       clean_source="archive", archive_dir=str(archive))
    q.awaitTermination()
    assert sorted(r.id for r in spark.table(f"{db}.arch_t").collect()) == [1, 2]
    archived = [f for _, _, fs in os.walk(archive) for f in fs]
    assert "a.csv" in archived


def test_default_checkpoint_is_stable(spark, db, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.csv").write_text("id\n1\n")
    for _ in range(2):      # no checkpoint given: the second run resumes, nothing is re-appended
        q = landing_stream(spark, str(landing), "stable_t", database=db)
        q.awaitTermination()
    assert spark.table(f"{db}.stable_t").count() == 1
