"""Files that disagree: types over all footers, each landed file's own footer, datetime formats, stream reports."""

from __future__ import annotations

import itertools
import os
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import write_file
from tidemark import ingest
from tidemark.errors import BadDatetimeError, EmptyLoadError, IncompatibleTypesError, MissingColumnsError, MonthSpillError
from tidemark.functions.coerce import DATETIME_FORMATS, datetime_fits, fitting_formats, to_datetime
from tidemark.operators.conform import datetime_formats
from tidemark.operators.publish import published_parts, read_published
from tidemark.operators.schema import join_types, merged_target_schema
from tidemark.plans import queries as Q
from tidemark.sources import parquet as pq
from tidemark.sources.paths import FileFormat, table_name_from_url, table_name_from_url_col
from tidemark.streaming import landing_stream, stream_report
from tidemark.streaming.landing import add_up, batch_loader

D = T.DecimalType
KINDS = [T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), D(10, 2), D(12, 0), D(38, 0), D(38, 30),
         T.StringType(), T.BooleanType(), T.DateType(), T.TimestampNTZType(), T.TimestampType(), T.BinaryType()]


# ------------------------------------------------------------ type lattice --
@pytest.mark.parametrize("kinds, want", [
    ([T.LongType(), T.DoubleType()], T.DoubleType()), ([T.IntegerType(), T.FloatType()], T.DoubleType()),
    ([T.ShortType(), T.IntegerType(), T.LongType()], T.LongType()), ([D(10, 2), D(8, 4)], D(12, 4)), ([T.LongType(), D(10, 2)], D(21, 2)),
    ([D(38, 0), D(38, 30)], None), ([D(38, 0), D(38, 30), T.DoubleType()], T.DoubleType()), ([T.DateType(), T.TimestampNTZType()], T.TimestampNTZType()),
    ([T.DateType(), T.TimestampType()], None), ([T.StringType(), T.LongType()], None), ([T.BooleanType(), T.ShortType()], None),
    ([T.TimestampType(), T.TimestampNTZType()], None), ([T.FloatType()], T.FloatType())])
def test_join_of_types(kinds, want):
    assert all(join_types(list(p)) == want for p in itertools.permutations(kinds))


@given(st.lists(st.sampled_from(KINDS), min_size=1, max_size=5))
def test_join_is_the_least_and_free_of_order_and_repeats(kinds):
    wide = join_types(kinds)
    assert join_types(kinds[::-1] + kinds) == wide
    if wide is not None:
        assert join_types([*kinds, wide]) == wide


def test_merged_schema_names_the_files():
    a, b = T.StructType().add("x", "long").add("y", "string"), T.StructType().add("y", "string").add("x", "double")
    assert merged_target_schema([("a", a), ("b", b)]) == T.StructType().add("x", "double").add("y", "string")
    with pytest.raises(MissingColumnsError, match="b missing.*x"):
        merged_target_schema([("a", a), ("b", T.StructType().add("y", "string"))])
    with pytest.raises(MissingColumnsError, match="a missing.*z"):
        merged_target_schema([("a", a), ("b", T.StructType([*a.fields, T.StructField("z", T.LongType())]))])
    with pytest.raises(IncompatibleTypesError, match="y.*string in a; bigint in c"):
        merged_target_schema([("a", a), ("c", T.StructType().add("x", "long").add("y", "long"))])


def test_first_load_keeps_fractions_of_a_later_file(spark, db, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    spark.createDataFrame([(1, 10), (2, 20)], "id bigint, x bigint").write.parquet(a)
    spark.createDataFrame([(3, 1.5), (4, 2.5)], "id bigint, x double").write.parquet(b)
    ingest(spark, [a, b], "wide", database=db)
    assert spark.table(f"{db}.wide").schema["x"].dataType == T.DoubleType()
    assert sorted(spark.table(f"{db}.wide").collect()) == [(1, 10.0), (2, 20.0), (3, 1.5), (4, 2.5)]
    # a later load is conformed to the published type, as before
    spark.createDataFrame([(5, 7)], "id int, x int").write.parquet(str(tmp_path / "c.parquet"))
    ingest(spark, str(tmp_path / "c.parquet"), "wide", database=db, if_exists="append")
    assert (5, 7.0) in [tuple(r) for r in spark.table(f"{db}.wide").collect()]
    spark.createDataFrame([(5, "7")], "id int, x string").write.parquet(str(tmp_path / "s.parquet"))
    with pytest.raises(IncompatibleTypesError):
        ingest(spark, [a, str(tmp_path / "s.parquet")], "mixed", database=db)
    assert not spark.catalog.tableExists(f"{db}.mixed")


def test_decimals_of_several_scales(spark, db, tmp_path):
    paths = [str(tmp_path / f"{i}.parquet") for i in range(3)]
    for p, (text, kind) in zip(paths, [("1.5", "decimal(4,1)"), ("0.125", "decimal(3,3)"), ("123456", "int")]):
        spark.sql(f"SELECT CAST('{text}' AS {kind}) AS v").write.parquet(p)
    ingest(spark, paths, "dec", database=db)
    assert spark.table(f"{db}.dec").schema["v"].dataType == D(13, 3)
    assert sorted(str(r.v) for r in spark.table(f"{db}.dec").collect()) == ["0.125", "1.500", "123456.000"]


# ------------------------------------------------------------------ footers --
def _jobs(spark, run):
    group = f"footers-{id(run)}"
    spark.sparkContext.setJobGroup(group, "footers")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_footers_are_read_by_tasks(spark, tmp_path):
    folder = str(tmp_path / "many files.parquet")
    spark.range(120).repartition(60).write.parquet(folder)
    spark.range(5).selectExpr("id", "id + 0.5D AS v").repartition(1).write.mode("append").parquet(folder)
    files = pq.list_files(spark, folder)
    footers, jobs = _jobs(spark, lambda: pq._footers(spark, files))
    assert len(files) > 40 and sorted(footers.count(k) for k in set(footers)) == [1, len(files) - 1]
    assert jobs <= 6  # not one a file
    groups = pq.read_by_footer(spark, [folder])
    assert sorted(df.count() for _, df in groups) == [5, 120] and sorted(len(f) for f, _ in groups) == [1, len(files) - 1]
    tasks = pq.footer_prints(spark, files * 5)
    assert tasks.count() == len(files) * 5


def test_footers_of_a_store_that_arrow_does_not_open(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "d.parquet")
    spark.range(4).repartition(2).write.parquet(folder)
    spark.range(2).selectExpr("id", "1 AS v").write.mode("append").parquet(folder)
    monkeypatch.setattr(pq, "_footer_print", lambda uri: None)
    assert sorted(df.count() for _, df in pq.read_by_footer(spark, [folder])) == [2, 4]
    assert pq.footer_prints(spark, ["nowhere://x/y", "file:/no/such"]).where("footer is not null").count() == 0


# ------------------------------------------------------------ landed Parquet --
def _stream(spark, landing, t, db, ckpt, **kw):
    q = landing_stream(spark, str(landing), t, fmt=kw.pop("fmt", "parquet"), database=db, checkpoint=str(ckpt), **kw)
    try:
        q.awaitTermination()
    except Exception as e:  # noqa: BLE001 - the error that stopped the stream
        return e
    return q.exception()


def test_landed_file_without_a_column_fails_its_batch(spark, db, tmp_path):
    landing, ckpt = tmp_path / "in", tmp_path / "ck"
    spark.createDataFrame([(1, 10)], "id bigint, x bigint").write.parquet(str(landing))
    assert _stream(spark, landing, "lack", db, ckpt) is None
    spark.createDataFrame([(2,)], "id bigint").coalesce(1).write.mode("append").parquet(str(landing))
    assert "missing columns" in str(_stream(spark, landing, "lack", db, ckpt))
    assert spark.table(f"{db}.lack").collect() == [(1, 10)]
    assert "missing columns" in str(_stream(spark, landing, "lack", db, ckpt))  # and again: nothing was skipped


def test_landed_files_of_drifted_types_are_conformed_once(spark, db, tmp_path):
    landing, ckpt = tmp_path / "in", tmp_path / "ck"
    spark.createDataFrame([(1, 10)], "id bigint, x bigint").coalesce(1).write.parquet(str(landing))
    spark.createDataFrame([(1.5, 2)], "x double, id int").coalesce(1).write.mode("append").parquet(str(landing))
    assert _stream(spark, landing, "drift", db, ckpt, max_files_per_trigger=1) is None
    assert sorted(spark.table(f"{db}.drift").collect()) == [(1, 10.0), (2, 1.5)]
    spark.createDataFrame([("7", "N")], "id string, x string").coalesce(1).write.mode("append").parquet(str(landing))
    for _ in range(2):
        assert _stream(spark, landing, "drift", db, ckpt) is None
    assert sorted(spark.table(f"{db}.drift").collect(), key=str) == [(1, 10.0), (2, 1.5), (7, None)]
    load = batch_loader(db, "drift", str(ckpt), FileFormat.PARQUET, spark.table(f"{db}.drift").schema, base=str(landing))
    files = spark.createDataFrame([(f,) for f in pq.list_files(spark, str(landing))], "path string")
    load(files, 1)  # a batch that was published is not appended again
    assert spark.table(f"{db}.drift").count() == 3
    load(files, 9)
    assert spark.table(f"{db}.drift").count() == 6
    load(files.limit(0), 10)
    assert spark.table(f"{db}.drift").count() == 6


def test_first_landed_file_gives_the_order_of_columns(spark, db, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    for name, at, cols, row in (("z", 1_000, "id bigint, x bigint", (1, 10)), ("a", 2_000, "x double, id int", (1.5, 2)), ("m", 3_000, "x int, id int", (3, 3))):
        spark.createDataFrame([row], cols).coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*")).rename(landing / f"{name}.parquet")
        os.utime(landing / f"{name}.parquet", (at, at))
    assert _stream(spark, landing, "order_of", db, tmp_path / "ck", max_files_per_trigger=1) is None
    assert spark.table(f"{db}.order_of").dtypes == [("id", "bigint"), ("x", "double")]
    assert sorted(spark.table(f"{db}.order_of").collect()) == [(1, 10.0), (2, 1.5), (3, 3.0)]


def _land(spark, tmp_path, name, at, cols, rows=()):
    """One Parquet file, with rows or without, in the landing folder."""
    spark.createDataFrame(list(rows), cols).coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "in").mkdir(exist_ok=True)
    next((tmp_path / name).glob("part-*")).rename(tmp_path / "in" / f"{name}.parquet")
    os.utime(tmp_path / "in" / f"{name}.parquet", (at, at))


def test_landed_files_without_rows_publish_nothing(spark, db, tmp_path):
    landing, ckpt = tmp_path / "in", tmp_path / "ck"
    _land(spark, tmp_path, "a", 1_000, "id bigint, x bigint")
    _land(spark, tmp_path, "b", 2_000, "x double, id int", [(1.5, 2)])
    _land(spark, tmp_path, "c", 3_000, "x double, id int")
    _land(spark, tmp_path, "d", 4_000, "id bigint, x bigint", [(1, 10)])
    assert _stream(spark, landing, "rowless", db, ckpt, max_files_per_trigger=1) is None
    assert spark.table(f"{db}.rowless").dtypes == [("id", "bigint"), ("x", "double")]
    assert sorted(spark.table(f"{db}.rowless").collect()) == [(1, 10.0), (2, 1.5)]
    assert stream_report(spark, "rowless", db, str(ckpt))["totals"] == {"rowcount": 2, "batches": 2, "datetime_nulls": {}, "fraction_nulls": {}}
    _land(spark, tmp_path, "e", 5_000, "id bigint, x bigint")      # alone in its batch
    _land(spark, tmp_path, "f", 6_000, "id bigint")                # without a column too
    assert "missing columns" in str(_stream(spark, landing, "rowless", db, ckpt, max_files_per_trigger=1))
    assert sorted(spark.table(f"{db}.rowless").collect()) == [(1, 10.0), (2, 1.5)]
    tables = [r.tableName for r in spark.sql(f"SHOW TABLES IN {db} LIKE 'rowless__r_*'").collect()]
    assert sorted(tables) == sorted(published_parts(spark, db, "rowless"))     # no staged table is left


def test_first_stream_of_files_without_rows_fails(spark, db, tmp_path):
    landing, ckpt = tmp_path / "in", tmp_path / "ck"
    _land(spark, tmp_path, "a", 1_000, "id bigint, x bigint")
    _land(spark, tmp_path, "b", 2_000, "x double, id int")
    with pytest.raises(EmptyLoadError, match="no file in .* has rows"):
        _stream(spark, landing, "rowless", db, ckpt)
    assert not spark.catalog.tableExists(f"{db}.rowless")
    _land(spark, tmp_path, "c", 3_000, "id bigint, x bigint", [(1, 10)])
    assert _stream(spark, landing, "rowless", db, ckpt, max_files_per_trigger=1) is None
    assert spark.table(f"{db}.rowless").collect() == [(1, 10.0)]


def test_landed_partition_folders(spark, db, tmp_path):
    landing = tmp_path / "in"
    spark.range(6).selectExpr("id", "CAST(id % 2 AS INT) AS p").write.partitionBy("p").parquet(str(landing))
    assert _stream(spark, landing, "parted", db, tmp_path / "ck") is None
    assert sorted(spark.table(f"{db}.parted").collect()) == [(i, i % 2) for i in range(6)]


# ---------------------------------------------------------- datetime formats --
@pytest.mark.parametrize("text, fmt, want", [
    ("2024-01-05 10:07", "iso", "2024-01-05 10:07:00"), ("2024-01-05T10:07Z", "iso", "2024-01-05 10:07:00"),
    ("01/05/2024 10:00:00 AM", "month/day/year", "2024-01-05 10:00:00"), ("1/5/2024 12:00 am", "month/day/year", "2024-01-05 00:00:00"),
    ("1/5/2024 12:30:01 PM", "month/day/year", "2024-01-05 12:30:01"), ("12/31/2024 23:59", "month/day/year", "2024-12-31 23:59:00"),
    ("31/12/2024 23:59", "month/day/year", None), ("31/12/2024", "day/month/year", "2024-12-31 00:00:00"), ("1/5/2024 13:00 PM", "month/day/year", None), ("1/5/2024 24:00", "month/day/year", None),
    ("1/5/2024 0:10 AM", "month/day/year", None), ("5.1.2024 7:08:09.25", "day.month.year", "2024-01-05 07:08:09.250000"),
    ("2024/1/5 07:08", "year/month/day", "2024-01-05 07:08:00"), ("20240105", "yearmonthday", "2024-01-05 00:00:00"),
    ("02/30/2024", "month/day/year", None), ("1/5/24", "month/day/year", None), ("01-05-2024", "month-day-year", "2024-01-05 00:00:00")])
def test_datetime_text(spark, text, fmt, want):
    got = spark.createDataFrame([(text,)], "s string").select(to_datetime("s", fmt=fmt).cast("string")).first()[0]
    assert got == (want and want.rstrip("0").rstrip(".") if want and "." in want else want)


def test_column_format_is_the_one_that_fits_all(spark):
    g = random.Random(8)
    ways = ["%Y-%m-%d %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%d/%m/%Y %H:%M:%S", "%d.%m.%Y %H:%M", "soon"]
    rows = []
    for column in range(60):
        some = g.sample(ways, g.choice([1, 1, 2]))
        rows += [(column, (datetime(1990, 1, 1) + timedelta(minutes=g.randrange(10 ** 7))).strftime(g.choice(some))) for _ in range(g.randint(1, 6))]
    s = spark.createDataFrame(rows, "c int, s string")
    each = s.select("c", *[to_datetime("s", fmt=f).isNotNull().alias(f"f{i}") for i, f in enumerate(DATETIME_FORMATS)]).collect()
    for r in s.groupBy("c").agg(F.bit_and(datetime_fits("s")).alias("bits")).collect():
        own = [e for e in each if e.c == r.c]
        assert fitting_formats(r.bits) == [f for i, f in enumerate(DATETIME_FORMATS) if all(e[f"f{i}"] for e in own)]


def test_load_finds_the_format_of_a_column(spark, db, tmp_path):
    p = write_file(tmp_path, "us.csv", "pickup_datetime,dropoff_datetime,v\n1/31/2024 11:15 PM,2024-02-01 00:10,1\n2/1/2024 12:05 AM,NA,2\nN/A,2024-02-01 00:20:30,3\n")
    m = ingest(spark, p, "us", database=db)
    assert m["datetime_formats"] == {"pickup_datetime": "month/day/year"} and m["datetime_nulls"] == {} and m["datetime_ambiguous"] == {}
    assert sorted((r.v, str(r.pickup_datetime), str(r.dropoff_datetime)) for r in spark.table(f"{db}.us").collect()) == [
        (1, "2024-01-31 23:15:00", "2024-02-01 00:10:00"), (2, "2024-02-01 00:05:00", "None"), (3, "None", "2024-02-01 00:20:30")]
    assert len(published_parts(spark, db, "us")) == 1
    assert len([r for r in spark.sql(f"SHOW TABLES IN {db}").collect() if "us__r_" in r.tableName]) == 1  # the first staging is gone


def test_ambiguous_and_mixed_columns_are_told(spark, db, tmp_path):
    p = write_file(tmp_path, "amb.csv", "pickup_datetime,dropoff_datetime\n01/02/2024,31/01/2024\n03/04/2024,2024-01-05\n")
    m = ingest(spark, p, "amb", database=db)
    assert m["datetime_ambiguous"] == {"pickup_datetime": ["month/day/year", "day/month/year"]} and m["datetime_nulls"] == {"dropoff_datetime": 1}
    assert sorted(str(r[0])[:10] for r in spark.table(f"{db}.amb").collect()) == ["2024-01-02", "2024-03-04"]
    with pytest.raises(BadDatetimeError, match="dropoff"):
        ingest(spark, p, "amb2", database=db, fail_on_bad_datetimes=True)
    m = ingest(spark, p, "amb", database=db, datetime_formats={"pickup_datetime": "day/month/year"})
    assert m["datetime_ambiguous"] == {} and sorted(str(r[0])[:10] for r in spark.table(f"{db}.amb").collect()) == ["2024-02-01", "2024-04-03"]
    with pytest.raises(ValueError, match="unknown datetime formats"):
        ingest(spark, p, "amb", database=db, datetime_formats={"pickup_datetime": "year first"})


def test_format_report(spark):
    rows = [("01/02/2024", "soon", None), ("03/04/2024", "2024-01-05", None)]
    df = spark.createDataFrame(rows, "pickup_datetime string, dropoff_datetime string, lpep_pickup_datetime string").withColumn("lpep_dropoff_datetime", F.lit("1.2.2024"))
    target = T.StructType([T.StructField(c, T.TimestampNTZType()) for c in df.columns])
    assert {r.column_name: r.formats for r in datetime_formats(df, target).collect()} == {
        "pickup_datetime": ["month/day/year", "day/month/year"], "dropoff_datetime": [], "lpep_pickup_datetime": None,
        "lpep_dropoff_datetime": ["day.month.year"]}


def test_text_datetimes_in_parquet(spark, db, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.createDataFrame([("1/31/2024 11:15 PM", "20240201")], "pickup_datetime string, dropoff_datetime string").write.parquet(p)
    m = ingest(spark, p, "pq_dt", database=db)
    assert m["datetime_formats"] == {"pickup_datetime": "month/day/year", "dropoff_datetime": "yearmonthday"}
    assert spark.table(f"{db}.pq_dt").collect() == [("2024-01-31 23:15:00", "2024-02-01 00:00:00")]


# ------------------------------------------------------------ stream reports --
MONTH = T.StructType([T.StructField("id", T.LongType()), T.StructField("pickup_datetime", T.TimestampNTZType()), T.StructField("dropoff_datetime", T.TimestampNTZType())])


def _batches(spark, *days):
    return [spark.createDataFrame([(str(i), d, "2024-01-09") for i, d in enumerate(batch)], "id string, pickup_datetime string, dropoff_datetime string") for batch in days]


def test_report_adds_up_over_batches_and_replays(spark, db):
    t = "green_tripdata_2024_01"
    load = batch_loader(db, t, "ck", FileFormat.CSV, MONTH, max_outside_rows=1)
    a, b, c = _batches(spark, ["2024-01-01", "2024-02-01", "x"], ["2024-01-02", "NA"], ["2023-12-31 23:59:59", "soon"])
    c = c.withColumn("id", F.concat("id", F.lit(".5")))
    load(a, 0)
    assert stream_report(spark, t, db, "ck")["totals"]["exceeds"] is True  # 1 of 3 rows
    load(b, 1)
    load(b, 1)
    load = batch_loader(db, t, "ck", FileFormat.CSV, MONTH, max_outside_rows=1, compact_after=2)  # as after a restart
    load(c, 2)
    r = stream_report(spark, t, db, "ck")
    assert [x["batch_id"] for x in r["batches"]] == [0, 1, 2] and [x["rowcount"] for x in r["batches"]] == [3, 2, 2]
    assert [x["datetime_nulls"] for x in r["batches"]] == [{"pickup_datetime": 1}, {}, {"pickup_datetime": 1}]
    assert r["batches"][2]["fraction_nulls"] == {"id": 2}
    whole = spark.table(f"{db}.{t}").selectExpr("count(*)", "count_if(pickup_datetime is null)", "cast(min(pickup_datetime) as string)",
                                                "count_if(pickup_datetime < '2024-01-01' or pickup_datetime >= '2024-02-01')").first()
    total = r["totals"]
    assert (total["rowcount"], total["null_dt"], total["min_dt"], total["outside_month"]) == tuple(whole)
    assert (total["batches"], total["exceeds"], total["datetime_nulls"], total["fraction_nulls"]) == (3, True, {"pickup_datetime": 2}, {"id": 2})
    assert stream_report(spark, t, db, "another") == {"totals": {}, "batches": []}


def test_month_verdict_over_the_whole_stream(spark, db):
    t = "green_tripdata_2024_01"
    load = batch_loader(db, t, "ck", FileFormat.CSV, MONTH, max_outside_rows=2, max_outside_ratio=1.0, fail_on_outside_month=True, verdict_over="stream")
    one, two, three = _batches(spark, ["2024-02-01", "2024-01-01"], ["2024-02-02"], ["2024-02-03"])
    load(one, 0)
    load(two, 1)
    with pytest.raises(MonthSpillError, match="3 of 4"):
        load(three, 2)  # no batch exceeds by itself
    assert spark.table(f"{db}.{t}").count() == 3 and stream_report(spark, t, db, "ck")["totals"]["outside_month"] == 2


def test_stream_refuses_bad_datetimes(spark, db, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.csv").write_text("id,pickup_datetime,dropoff_datetime\n1,1/31/2024 11:15 PM,2024-01-01\n")
    assert _stream(spark, landing, "fmt", db, tmp_path / "ck", fmt="csv", datetime_formats={"pickup_datetime": "month/day/year"}, fail_on_bad_datetimes=True) is None
    assert str(spark.table(f"{db}.fmt").first()[1]) == "2024-01-31 23:15:00"
    assert "no datetime" in str(_stream(spark, landing, "strict", db, tmp_path / "ck2", fmt="csv", fail_on_bad_datetimes=True))
    assert not spark.catalog.tableExists(f"{db}.strict")


_counts = st.fixed_dictionaries({"rowcount": st.integers(0, 9), "min_dt": st.none() | st.sampled_from("abc"), "datetime_nulls": st.dictionaries(st.sampled_from("xy"), st.integers(1, 5))})


@given(_counts, _counts, _counts)
def test_counts_add_up_in_any_order(a, b, c):
    assert add_up(add_up(a, b), c) == add_up(a, add_up(b, c)) and add_up(a, b) == add_up(b, a) and add_up({}, a) == a


# ------------------------------------------------------------- one URL rule --
def test_url_rule_has_one_meaning(spark):
    parts = st.text(alphabet="ab-_./;=?#:%é ſSCVcsv.gzTP\n", max_size=18)
    urls: list[str] = ["http://h/p/a;v=1.csv", "s3a://b/k/x-y.TSV.GZ?q=/z.csv#f", "//h/a.csv", "a?b/c", "x://h", "/", "", "a.cſv", "http://h/p/a.csv;v=1"]

    @settings(max_examples=300, deadline=None)
    @given(st.sampled_from(["", "http://h", "s3a://b-c/", "/", "file:/"]), parts)
    def collect(head, tail):
        urls.append(head + tail)

    collect()
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", table_name_from_url_col("u")).collect()
    assert [(r[0], r[1]) for r in got] == [(u, table_name_from_url(u)) for u in urls]
    assert table_name_from_url("http://h/p/a;v=1.csv") == "a;v=1"


# -------------------------------------------------------------- row identity --
def test_equal_values_of_a_published_table_spread_over_the_sort(spark, db, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.range(8_000).selectExpr("TIMESTAMP_NTZ '2025-11-05 00:00:00' AS lpep_pickup_datetime", "IF(id % 2 = 0, 9.0D, id / 1000) AS trip_distance").repartition(4).write.parquet(p)
    ingest(spark, p, "trips", database=db)
    ingest(spark, p, "trips", database=db, if_exists="append")
    rows = read_published(spark, db, "trips")
    assert rows.select("trip_file", "trip_row").distinct().count() == rows.count() == 16_000
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        out = Q.longest_days(rows, "2025-11-01", "2025-12-01", 100.0)
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 16_000 / 8
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
