"""Validation and the staged publish protocol (V1-V7, W1-W7), with failure injection."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import write_file
from tidemark import ingest
from tidemark.errors import EmptyLoadError, IngestError, MonthSpillError, TableExistsError
from tidemark.operators.publish import published_parts
from tidemark.operators.validate import validation_metrics, validate

TRIPS = ("VendorID,lpep_pickup_datetime,lpep_dropoff_datetime,trip_distance,PULocationID,total_amount\n"
         "1,2024-01-01 10:00:00,2024-01-01 10:20:00,1.5,7,12.5\n"
         "2,2024-01-02 11:00:00,2024-01-02 11:05:00,0.5,3.0,8\n"
         "2,bad,2024-01-03 00:00:00,N/A,,1e1\n")


def _metrics(spark, inside, outside, nulls, month="2024_01"):
    rows = ([(datetime(2024, 1, 5),)] * inside + [(datetime(2023, 12, 31),)] * outside + [(None,)] * nulls)
    df = spark.createDataFrame(rows, "pickup_datetime timestamp_ntz")
    return validation_metrics(df, "pickup_datetime", month).first()


def test_verdict_thresholds(spark):
    assert _metrics(spark, 99_800, 200, 0).exceeds is False       # 200 of 100000: ok
    assert _metrics(spark, 99_799, 201, 0).exceeds is True        # 201 rows: exceeds
    assert _metrics(spark, 995, 5, 0).exceeds is False            # ratio exactly 0.005: ok
    assert _metrics(spark, 994, 6, 0).exceeds is True


def test_nulls_counted_in_ratio_only(spark):
    m = _metrics(spark, 10, 2, 3)
    assert (m.rowcount, m.inside_month, m.outside_month, m.null_dt) == (15, 10, 2, 3)
    assert m.outside_ratio == pytest.approx(2 / 15)


def test_validate_raises(spark):
    empty = spark.createDataFrame([], "pickup_datetime timestamp_ntz")
    with pytest.raises(EmptyLoadError):
        validate(empty, "fhv_tripdata_2024_01")
    df = spark.createDataFrame([(datetime(2023, 1, 1),)] * 3, "pickup_datetime timestamp_ntz")
    assert validate(df, "fhv_tripdata_2024_01")["exceeds"] is True      # warns only
    with pytest.raises(MonthSpillError):
        validate(df, "fhv_tripdata_2024_01", fail_on_outside_month=True)
    assert "exceeds" not in validate(df, "no_month_here")


def test_first_load_infers_and_conforms(spark, db, tmp_path):
    p = write_file(tmp_path, "green_tripdata_2024-01.csv", TRIPS)
    m = ingest(spark, p, database=db)
    assert m["status"] == "replace" and m["rowcount"] == 3 and m["null_dt"] == 1
    t = spark.table(f"{db}.green_tripdata_2024_01")
    types = dict(t.dtypes)
    assert types["lpep_pickup_datetime"] == "timestamp_ntz" and types["VendorID"] == "bigint"
    assert types["trip_distance"] == "double" and types["PULocationID"] == "double"
    rows = sorted(t.collect(), key=lambda r: r.total_amount)
    assert rows[0].trip_distance == 0.5 and rows[1].lpep_pickup_datetime is None
    assert rows[1].total_amount == 10.0 and rows[1].trip_distance is None


def test_fraction_report(spark, db, tmp_path):
    p1 = write_file(tmp_path, "n1.csv", "k,v\n1,2\n")
    ingest(spark, p1, "nums", database=db)
    p2 = write_file(tmp_path, "n2.csv", "v,k\n2.5,3.0\n7,1.25\n")
    m = ingest(spark, p2, "nums", database=db, if_exists="append")
    assert m["fraction_nulls"] == {"v": 1, "k": 1}
    assert sorted(spark.table(f"{db}.nums").collect(), key=str) == sorted([(1, 2), (3, None), (None, 7)], key=str)


def test_append_twice_doubles(spark, db, tmp_path):
    p = write_file(tmp_path, "green_tripdata_2024-01.csv", TRIPS)
    ingest(spark, p, database=db)
    ingest(spark, p, database=db, if_exists="append")
    assert spark.table(f"{db}.green_tripdata_2024_01").count() == 6
    assert len(published_parts(spark, db, "green_tripdata_2024_01")) == 2


def test_policies(spark, db, tmp_path):
    p = write_file(tmp_path, "x.csv", "a\n1\n")
    assert ingest(spark, p, "pol", database=db, if_exists="skip")["status"] == "replace"
    assert ingest(spark, p, "pol", database=db, if_exists="skip")["status"] == "skipped"
    with pytest.raises(TableExistsError):
        ingest(spark, p, "pol", database=db, if_exists="fail")
    with pytest.raises(ValueError):
        ingest(spark, p, "pol", database=db, if_exists="merge")
    assert spark.table(f"{db}.pol").count() == 1


@pytest.mark.parametrize("stage", ["read", "stage", "validate"])
def test_failure_leaves_old_table(spark, db, tmp_path, stage):
    p = write_file(tmp_path, "old.csv", "a\n1\n2\n")
    ingest(spark, p, "keep", database=db)
    before = sorted(spark.table(f"{db}.keep").collect())
    q = write_file(tmp_path, "new.csv", "a\n3\n")
    with pytest.raises(IngestError, match="injected"):
        ingest(spark, q, "keep", database=db, fail_after=stage)
    assert sorted(spark.table(f"{db}.keep").collect()) == before
    leftovers = [r.tableName for r in spark.sql(f"SHOW TABLES IN {db}").collect() if "__r_" in r.tableName]
    assert len(leftovers) == 1


def test_failed_first_load_leaves_no_table(spark, db, tmp_path):
    q = write_file(tmp_path, "new.csv", "a\n3\n")
    with pytest.raises(IngestError):
        ingest(spark, q, "fresh", database=db, fail_after="validate")
    assert not spark.catalog.tableExists(f"{db}.fresh")
    assert not [r for r in spark.sql(f"SHOW TABLES IN {db}").collect() if "fresh" in r.tableName]


def test_empty_file_fails_and_keeps_table(spark, db, tmp_path):
    ingest(spark, write_file(tmp_path, "a.csv", "a\n1\n"), "e", database=db)
    with pytest.raises(EmptyLoadError):
        ingest(spark, write_file(tmp_path, "empty.csv", ""), "e", database=db)
    with pytest.raises(EmptyLoadError):
        ingest(spark, write_file(tmp_path, "header_only.csv", "a\n"), "e", database=db)
    assert spark.table(f"{db}.e").count() == 1


def test_bad_value_fails_whole_load(spark, db, tmp_path):
    ingest(spark, write_file(tmp_path, "s.csv", "k,flag\n1,true\n"), "b", database=db)
    with pytest.raises(Exception):
        ingest(spark, write_file(tmp_path, "s2.csv", "k,flag\n2,maybe\n"), "b", database=db, if_exists="append")
    assert spark.table(f"{db}.b").collect() == [(1, True)]


def test_replace_keeps_one_generation_for_running_readers(spark, db, tmp_path):
    def physical():
        return [r.tableName for r in spark.sql(f"SHOW TABLES IN {db}").collect() if r.tableName.startswith("rep__r_")]

    p = write_file(tmp_path, "r.csv", "a\n1\n")
    ingest(spark, p, "rep", database=db)
    ingest(spark, p, "rep", database=db, if_exists="append")
    reader = spark.table(f"{db}.rep")
    assert reader.schema.names == ["a"]                    # planned before the replace
    ingest(spark, write_file(tmp_path, "r2.csv", "a\n5\n"), "rep", database=db, if_exists="replace")
    assert spark.table(f"{db}.rep").collect() == [(5,)]
    assert reader.collect() == [(1,), (1,)] and len(physical()) == 3
    ingest(spark, write_file(tmp_path, "r3.csv", "a\n6\n"), "rep", database=db, if_exists="replace")
    assert spark.table(f"{db}.rep").collect() == [(6,)] and len(physical()) == 2


def test_a_lost_append_is_noticed(spark, db, tmp_path, monkeypatch):
    from tidemark.errors import LostPublishError
    from tidemark.operators import publish as pub
    p = write_file(tmp_path, "l.csv", "a\n1\n")
    first = ingest(spark, p, "lost", database=db)["parts"]
    create = pub._create_view

    def overtaken(session, database, final, parts, props=None):
        create(session, database, final, parts, props)
        create(session, database, final, first, props)     # another writer, which read the state before

    monkeypatch.setattr(pub, "_create_view", overtaken)
    with pytest.raises(LostPublishError):
        ingest(spark, p, "lost", database=db, if_exists="append")
    assert published_parts(spark, db, "lost") == first


def test_parquet_folder_is_conformed_file_by_file(spark, db, tmp_path):
    from tidemark.errors import MissingColumnsError
    drift, short = str(tmp_path / "drift.parquet"), str(tmp_path / "short.parquet")
    ingest(spark, write_file(tmp_path, "v.csv", "id,v\n9,9\n"), "typed", database=db)
    spark.range(2).selectExpr("id", "id * 2 AS v").write.parquet(drift)
    spark.range(2, 4).selectExpr("id", "id + IF(id = 3, 0.5D, 0D) AS v").write.mode("append").parquet(drift)
    m = ingest(spark, drift, "typed", database=db, if_exists="append")
    assert sorted(spark.table(f"{db}.typed").collect(), key=str) == [(0, 0), (1, 2), (2, 2), (3, None), (9, 9)]
    assert m["fraction_nulls"] == {"v": 1}
    spark.range(2).selectExpr("id", "id * 2 AS v").write.parquet(short)
    spark.range(2).selectExpr("id").write.mode("append").parquet(short)
    with pytest.raises(MissingColumnsError, match="short.parquet"):
        ingest(spark, short, "typed", database=db, if_exists="append")
    parted = str(tmp_path / "parted.parquet")
    spark.range(4).selectExpr("id", "id % 2 AS v").write.partitionBy("v").parquet(parted)
    ingest(spark, parted, "typed", database=db)
    assert sorted(spark.table(f"{db}.typed").collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_bad_datetimes_are_counted_or_refused(spark, db, tmp_path):
    from tidemark.errors import BadDatetimeError
    p = write_file(tmp_path, "d.csv", "pickup_datetime,dropoff_datetime\n"
                   "01/05/2024 10:00:00 AM,2024-02-01T00:00:00Z\nNA,2024-02-01 01:02:03.123456789\n2024-02-03,2024-02-01 05:00:00+02:00\n")
    m = ingest(spark, p, "dates", database=db)
    assert m["datetime_nulls"] == {"pickup_datetime": 1} and m["datetime_formats"] == {}
    assert sorted(str(r[1]) for r in spark.table(f"{db}.dates").collect()) == [
        "2024-02-01 00:00:00", "2024-02-01 01:02:03.123456", "2024-02-01 05:00:00"]
    with pytest.raises(BadDatetimeError):
        ingest(spark, p, "dates", database=db, if_exists="append", fail_on_bad_datetimes=True)
    assert spark.table(f"{db}.dates").count() == 3


def test_names_that_differ_by_case(spark, db, tmp_path):
    from tidemark.errors import DuplicateColumnsError
    with pytest.raises(DuplicateColumnsError, match="caseSensitive"):
        ingest(spark, write_file(tmp_path, "fee.csv", "Airport_fee,airport_fee\n1,2\n"), "fees", database=db)


def test_compaction(spark, db, tmp_path):
    p = write_file(tmp_path, "c.csv", "a\n1\n")
    ingest(spark, p, "cmp", database=db)
    for _ in range(3):
        ingest(spark, p, "cmp", database=db, if_exists="append", compact_after=2)
    assert spark.table(f"{db}.cmp").count() == 4
    assert len(published_parts(spark, db, "cmp")) <= 2


def test_parquet_source_types(spark, db, tmp_path):
    path = str(tmp_path / "p.parquet")
    (spark.range(3).select(F.col("id").cast("tinyint").alias("small"), F.array(F.col("id")).alias("arr"),
                           F.when(F.col("id") == 0, F.lit("")).otherwise(F.lit("NA")).alias("txt"),
                           F.when(F.col("id") == 1, F.lit(float("nan"))).otherwise(F.lit(2.5)).alias("d"))
     .write.parquet(path))
    ingest(spark, path, "pq", database=db)
    t = spark.table(f"{db}.pq")
    assert dict(t.dtypes) == {"small": "smallint", "arr": "string", "txt": "string", "d": "double"}
    rows = sorted(t.collect())
    assert rows[0] == (0, "[0]", None, 2.5) and rows[1] == (1, "[1]", "NA", None)


def test_database_created_and_names_checked(spark, tmp_path):
    import uuid
    from tidemark.errors import UnsafeIdentifierError
    from tidemark.operators.schema import table_exists
    db = "new_" + uuid.uuid4().hex[:6]
    p = write_file(tmp_path, "z.csv", "LocationID,Zone\n1,Airport\n")
    assert not spark.catalog.databaseExists(db)
    ingest(spark, p, "taxi_zone_lookup", database=db)
    assert spark.catalog.databaseExists(db) and table_exists(spark, f"{db}.taxi_zone_lookup")
    with pytest.raises(ValueError):
        ingest(spark, p, "z", database="  ")
    with pytest.raises(UnsafeIdentifierError):
        ingest(spark, p, "bad-name", database=db)
    with pytest.raises(UnsafeIdentifierError):
        ingest(spark, write_file(tmp_path, "y.csv", "bad col\n1\n"), "y", database=db)


def test_foreign_table_is_refused_before_any_work(spark, db, tmp_path):
    spark.sql(f"CREATE TABLE {db}.foreign_t (a BIGINT) USING parquet")
    with pytest.raises(IngestError, match="not published by this library"):
        ingest(spark, write_file(tmp_path, "f.csv", "a\n1\n"), "foreign_t", database=db, if_exists="append")
    assert not [r for r in spark.sql(f"SHOW TABLES IN {db}").collect() if "__r_" in r.tableName]


def test_failed_write_leaves_no_staged_table(spark, db, tmp_path):
    ingest(spark, write_file(tmp_path, "ok.csv", "k\n1\n"), "wf", database=db)
    # 20 digits overflow the table's bigint under ANSI: the staging job itself fails
    with pytest.raises(Exception):
        ingest(spark, write_file(tmp_path, "bad.csv", "k\n99999999999999999999\n"), "wf", database=db,
               if_exists="append")
    assert spark.table(f"{db}.wf").collect() == [(1,)]
    assert len([r for r in spark.sql(f"SHOW TABLES IN {db}").collect() if "wf__r_" in r.tableName]) == 1


def test_parquet_paths_each_checked(spark, db, tmp_path):
    from tidemark.errors import MissingColumnsError
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    spark.range(2).selectExpr("id", "id * 2 AS v").write.parquet(a)
    spark.range(2).selectExpr("id").write.parquet(b)
    with pytest.raises(MissingColumnsError, match="b.parquet"):
        ingest(spark, [a, b], "pq_multi", database=db)
    assert not spark.catalog.tableExists(f"{db}.pq_multi")
    ingest(spark, [a, a], "pq_multi", database=db)
    assert spark.table(f"{db}.pq_multi").count() == 4


def test_compaction_keeps_big_parts(spark, db, tmp_path):
    big = write_file(tmp_path, "big.csv", "a\n" + "".join(f"{i}\n" for i in range(20000)))
    small = write_file(tmp_path, "small.csv", "a\n7\n")
    first = ingest(spark, big, "tier", database=db)["parts"][0]
    for _ in range(4):
        ingest(spark, small, "tier", database=db, if_exists="append", compact_after=3)
    parts = published_parts(spark, db, "tier")
    assert first in parts and len(parts) <= 3
    assert spark.table(f"{db}.tier").count() == 20004


def test_raw_text_copy_is_dropped(spark, db, tmp_path):
    from tidemark.session import scratch_database
    p = write_file(tmp_path, "raw.csv.gz", "a,b\n1,x\n2,y\n")
    ingest(spark, p, "rawcopy", database=db)
    q = write_file(tmp_path, "bad.csv.gz", "a,b\n1,x\n")
    with pytest.raises(IngestError):
        ingest(spark, q, "rawcopy2", database=db, fail_after="stage")
    sdb = scratch_database(spark)
    assert not [r for r in spark.sql(f"SHOW TABLES IN {sdb}").collect() if r.tableName.startswith("raw_text")]
    assert sorted(spark.table(f"{db}.rawcopy").collect()) == [(1, "x"), (2, "y")]


def test_spread_decision(spark, tmp_path, monkeypatch):
    import gzip
    from tidemark import pipeline as P
    par = spark.sparkContext.defaultParallelism
    d = tmp_path / "files"
    d.mkdir()
    for i in range(par + 2):                       # more files than cores, similar sizes
        with gzip.open(d / f"f{i}.csv.gz", "wt") as f:
            f.write("a\n" + "".join(f"{j}\n" for j in range(50)))
    paths = sorted(str(p) for p in d.iterdir())
    monkeypatch.setattr(P, "HOT_FILE_FLOOR_BYTES", 0)
    assert not P.needs_spread(spark, paths, multi_line=True)
    with gzip.open(d / "hot.csv.gz", "wt") as f:   # one source holding most rows
        f.write("a\n" + "".join(f"{j * 7919 % 100003}\n" for j in range(200_000)))
    assert P.needs_spread(spark, paths + [str(d / "hot.csv.gz")], multi_line=True)
    assert P.needs_spread(spark, paths[:1], multi_line=True)          # fewer files than cores
    plain = write_file(tmp_path, "plain.csv", "a\n1\n")
    assert not P.needs_spread(spark, [plain], multi_line=False)       # Spark splits it itself


def test_warnings_are_logged(spark, db, tmp_path, caplog):
    import logging
    caplog.set_level(logging.WARNING, logger="tidemark")
    ingest(spark, write_file(tmp_path, "k.csv", "k\n1\n"), "warn_t", database=db)
    ingest(spark, write_file(tmp_path, "k2.csv", "k\n1.5\n"), "warn_t", database=db, if_exists="append")
    df = spark.createDataFrame([(datetime(2023, 1, 1),)] * 3, "pickup_datetime timestamp_ntz")
    validate(df, "fhv_tripdata_2024_01")
    text = caplog.text
    assert "non-integer values in integer column 'k'" in text and "3 of 3 rows (share 1.000000) are not in 2024_01" in text


def test_staged_files_sorted_by_pickup_time(spark, db, tmp_path):
    from pyspark.sql import functions as F
    rows = "".join(f"2024-01-{(i * 7) % 28 + 1:02d} {(i * 5) % 24:02d}:00:00,{i}\n" for i in range(500))
    p = write_file(tmp_path, "yellow_tripdata_2024-01.csv", "tpep_pickup_datetime,x\n" + rows)
    m = ingest(spark, p, database=db)
    part = spark.table(f"{db}.{m['parts'][-1]}").select(
        "tpep_pickup_datetime", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    for f in [r.f for r in part.select("f").distinct().collect()]:
        ts = [r[0] for r in part.filter(F.col("f") == f).orderBy("r").select("tpep_pickup_datetime").collect()]
        assert ts == sorted(ts)
    assert spark.table(f"{db}.yellow_tripdata_2024_01").count() == 500


def test_compact_all_and_drop_published(spark, db, tmp_path):
    from tidemark import compact, drop_published
    p = write_file(tmp_path, "d.csv", "a\n1\n")
    ingest(spark, p, "dp", database=db)
    ingest(spark, p, "dp", database=db, if_exists="append")
    ingest(spark, p, "dp", database=db, if_exists="append")
    assert len(compact(spark, db, "dp")) == 1 and spark.table(f"{db}.dp").count() == 3
    drop_published(spark, db, "dp")
    assert not [r for r in spark.sql(f"SHOW TABLES IN {db}").collect() if r.tableName.startswith("dp")]
