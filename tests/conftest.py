import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[4]").appName("tidemark-tests")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tidemark-wh-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # tests set their own checkpoint folder: none is configured here
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-ckpt-"))
    yield spark
    spark.stop()


@pytest.fixture()
def db(spark):
    import uuid
    name = "t_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {name}")
    return name


def write_file(tmp_path, name: str, text: str) -> str:
    import gzip
    p = tmp_path / name
    if name.lower().endswith(".gz"):
        with gzip.open(p, "wt", encoding="utf-8", newline="") as f:
            f.write(text)
    else:
        p.write_text(text, encoding="utf-8", newline="") if sys.version_info >= (3, 10) else p.write_text(text)
    return str(p)
