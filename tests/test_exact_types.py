"""No digit, fraction or value is lost without a word."""

from decimal import Decimal

import pytest
from pyspark.sql import types as T

from conftest import write_file
from tidemark.functions.months import Month
from tidemark.operators.conform import conform_typed, integer_report
from tidemark.operators.schema import infer_text_schema
from tidemark.session import scratch_root


def _text(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


@pytest.mark.parametrize("values,kind", [
    (("1", "9223372036854775807", "-9223372036854775808"), T.LongType()),
    (("1", "9223372036854775808"), T.DecimalType(38, 0)),
    (("1", "9" * 38), T.DecimalType(38, 0)),
    (("1", "9" * 39), T.StringType()),
    (("1", "2.5"), T.DoubleType())])
def test_integers_keep_every_digit(spark, values, kind):
    assert infer_text_schema(_text(spark, *values)).fields[0].dataType == kind


def test_fractions_of_typed_sources(spark):
    target = T.StructType([T.StructField(c, T.LongType()) for c in ("d", "f")])
    df = spark.createDataFrame([(Decimal("7.75"), 1.5), (Decimal("8.00"), 2.0), (None, float("nan"))], "d decimal(9,2), f double")
    assert [tuple(r) for r in conform_typed(df, target).collect()] == [(None, None), (8, 2), (None, None)]
    assert {tuple(r) for r in integer_report(df, target, text=False).collect()} == {("d", 1, 7.75), ("f", 1, 1.5)}


def test_stream_types_do_not_depend_on_the_batch_size(spark, db, tmp_path):
    from tidemark.streaming import landing_stream
    got = []
    for n, per in enumerate((1, None)):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        write_file(folder, "a.csv", "v\n2\n3\n")
        write_file(folder, "b.csv", "v\n2.5\n7.25\n")
        q = landing_stream(spark, str(folder) + "/*.csv", f"batch_{n}", database=db, checkpoint=str(tmp_path / f"ck{n}"),
                           max_files_per_trigger=per)
        q.awaitTermination()
        got.append(sorted(r.v for r in spark.table(f"{db}.batch_{n}").collect()))
    assert got == [[2.0, 2.5, 3.0, 7.25]] * 2


def test_month_value():
    assert (Month.parse("2024_12").start.isoformat(), Month.parse("2024_12").end.isoformat()) == ("2024-12-01T00:00:00", "2025-01-01T00:00:00")


def test_no_private_scratch_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session())
