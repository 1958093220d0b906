"""Scans, header handling, format routing and names."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import write_file
from tidemark.errors import DuplicateColumnsError, MissingColumnsError
from tidemark.operators.conform import conform_text
from tidemark.sources import (
    check_delimiter, detect_format, detect_format_col, month_path, month_table, read_delimited,
    read_header, table_name_from_url, table_name_from_url_col,
)

S = T.StringType()


def test_header_trim_and_dups(spark, tmp_path):
    p = write_file(tmp_path, "h.csv", "a, b \n1,2\n")
    assert read_header(spark, p) == ["a", "b"]
    for i, head in enumerate(["a,a\n1,2\n", "a, a\n1,2\n"]):
        with pytest.raises(DuplicateColumnsError):
            read_header(spark, write_file(tmp_path, f"d{i}.csv", head))


def test_missing_extra_and_order(spark, tmp_path):
    p = write_file(tmp_path, "m.csv", "c,Airport_fee,a,extra\n3,x,1,9\n")
    (_, df), = read_delimited(spark, [p])
    ok = T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.LongType())])
    out = conform_text(df, ok)
    assert out.columns == ["a", "c"] and out.collect()[0] == (1, 3)
    bad = T.StructType([T.StructField("airport_fee", S)])
    with pytest.raises(MissingColumnsError, match="airport_fee"):
        conform_text(df, bad)


def test_ragged_rows(spark, tmp_path):
    p = write_file(tmp_path, "r.csv", "a,b,c\n1\n1,2,3,4,5\n")
    (_, df), = read_delimited(spark, [p])
    assert sorted(df.collect(), key=str) == sorted([("1", None, None), ("1", "2", "3")], key=str)


def test_quoting(spark, tmp_path):
    p = write_file(tmp_path, "q.csv", 'a,b,c\n"he said ""hi"", ok","line\nbreak",""\n')
    (_, df), = read_delimited(spark, [p])
    out = conform_text(df, T.StructType([T.StructField(n, S) for n in "abc"])).collect()
    assert out == [('he said "hi", ok', "line\nbreak", None)]


def test_tsv_gz_with_quoted_tab(spark, tmp_path):
    p = write_file(tmp_path, "t.tsv.gz", 'a\tb\n"x\ty"\t2\n')
    (_, df), = read_delimited(spark, [p], "tsv")
    assert df.collect() == [("x\ty", "2")]


def test_files_with_different_header_order(spark, tmp_path):
    p1 = write_file(tmp_path, "o1.csv", "a,b\n1,2\n")
    p2 = write_file(tmp_path, "o2.csv", "b,a\n20,10\n")
    groups = read_delimited(spark, [p1, p2])
    target = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    rows = set()
    for _, g in groups:
        rows |= set(conform_text(g, target).collect())
    assert rows == {(1, 2), (10, 20)}


def test_delimiter_check():
    assert check_delimiter(";") == ";"
    for bad in ["\n", "\r", "\t", "'", ",,", ""]:
        with pytest.raises(ValueError):
            check_delimiter(bad, "csv")


@pytest.mark.parametrize("name,fmt", [("A.CSV.GZ", "csv"), ("x.parquet.gz", "unknown"), ("x.json", "unknown"),
                                      ("x.tsv", "tsv"), ("x.Parquet", "parquet"), ("x.csv.bz2", "unknown")])
def test_format(spark, name, fmt):
    assert detect_format(name).value == fmt
    df = spark.createDataFrame([(name,)], "p string")
    assert df.select(detect_format_col("p")).first()[0] == fmt


def test_month_names():
    assert month_table("Green", 2024, 1) == "green_tripdata_2024_01"
    assert month_path("s3a://b/x/", "fhv", 2021, "3", "csv") == "s3a://b/x/fhv/fhv_tripdata_2021-03.csv.gz"
    with pytest.raises(ValueError):
        month_table("green", 2024, 13)
    with pytest.raises(ValueError):
        month_path("b", "green", 2024, 1, "tsv")
    with pytest.raises(ValueError):
        month_table("blue", 2024, 1)


@pytest.mark.parametrize("url,name", [
    ("https://h/x/Yellow_tripdata_2021-01.CSV.gz?x=1", "Yellow_tripdata_2021_01"),
    ("https://h/x/green_tripdata_2021-01.parquet/", "green_tripdata_2021_01"),
    ("https://h/x/a-b.tsv#frag", "a_b"),
    ("https://host", ""),
    ("/data/taxi_zone_lookup.csv", "taxi_zone_lookup"),
    ("file.csv.gz.bak", "file.csv.gz.bak"),
])
def test_table_name_from_url(spark, url, name):
    assert table_name_from_url(url) == name
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(table_name_from_url_col("u")).first()[0] == name


def test_folder_with_disagreeing_headers_fails(spark, tmp_path):
    d = tmp_path / "month"
    d.mkdir()
    (d / "part-0.csv").write_text("a,b\n1,2\n")
    (d / "part-1.csv").write_text("b,a\n20,10\n")
    (_, df), = read_delimited(spark, [str(d)])
    with pytest.raises(Exception, match="(?i)header|schema"):
        df.collect()


def test_folder_with_same_padded_headers(spark, tmp_path):
    d = tmp_path / "month2"
    d.mkdir()
    (d / "part-0.csv").write_text(" a , b\n1,2\n")
    (d / "part-1.csv").write_text(" a , b\n3,4\n")
    (names, df), = read_delimited(spark, [str(d)])
    assert names == ["a", "b"] and sorted(df.collect()) == [("1", "2"), ("3", "4")]


def test_encoding_and_split_plain_file(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes("name,n\ncaf\xe9,1\nna\xefve,2\n".encode("latin-1"))
    (_, df), = read_delimited(spark, [str(p)], encoding="ISO-8859-1", multi_line=False)
    assert sorted(df.collect()) == [("café", "1"), ("naïve", "2")]


def test_large_plain_file_splits_without_multiline(spark, tmp_path):
    p = tmp_path / "big.csv"
    p.write_text("a,b\n" + "".join(f"{i},{i * 2}\n" for i in range(200_000)))
    (_, one), = read_delimited(spark, [str(p)], multi_line=True)
    (_, many), = read_delimited(spark, [str(p)], multi_line=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        assert one.rdd.getNumPartitions() == 1
        assert many.rdd.getNumPartitions() > 1
        assert many.count() == one.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bom_and_crlf(spark, tmp_path):
    p = tmp_path / "bom.csv"
    p.write_bytes(b"\xef\xbb\xbfVendorID,b\r\n1,2\r\n3,4\r\n")
    (names, df), = read_delimited(spark, [str(p)])
    assert names == ["VendorID", "b"] and sorted(df.collect()) == [("1", "2"), ("3", "4")]
