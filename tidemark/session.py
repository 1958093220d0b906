"""Session helpers: a tuned local/cluster session and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidemark") -> SparkSession:
    """Session with the settings every job here assumes.

    On a cluster, ``master`` stays None so spark-submit decides; the
    partition count is then left to AQE coalescing from the cluster default.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.ansi.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def has_persistent_catalog(spark: SparkSession) -> bool:
    """Does the current catalog outlive this application? Spark's own in-memory
    one does not; a Hive metastore or a configured catalog plugin does."""
    if spark.catalog.currentCatalog() != "spark_catalog":
        return True
    return (spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "hive"
            or spark.conf.get("spark.sql.catalog.spark_catalog", "builtin") != "builtin")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for run-scoped tables.

    Uses the folder the cluster names in ``spark.checkpoint.dir``. Where none
    is configured, a local master gets a private one; on a cluster that is an
    error, since executors would not see a folder of the driver's machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions have no SparkContext
        sc = None
    d = sc.getCheckpointDir() if sc is not None else None
    if d:
        return d.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if sc is not None:
            sc.setCheckpointDir(conf)
            return (sc.getCheckpointDir() or conf).rstrip("/")
        return conf.rstrip("/")
    master = sc.master if sc is not None else ""
    if not re.fullmatch(r"local(\[(\*|\d+)(,\s*\d+)?\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(local)
        return (sc.getCheckpointDir() or local).rstrip("/")
    return local


def scratch_path(spark: SparkSession, *parts: str, suffix: str = "") -> str:
    """A fresh, unique folder name under the shared scratch root."""
    return "/".join([scratch_root(spark), *parts, uuid.uuid4().hex[:12] + suffix])


def scratch_database(spark: SparkSession, name: str = "tidemark_scratch") -> str:
    """Catalog database located in the shared scratch folder."""
    if not spark.catalog.databaseExists(name):
        loc = scratch_root(spark) + f"/warehouse/{name}.db"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{loc}'")
    return name


def stable_root(spark: SparkSession) -> str:
    """A shared folder that is the same for every application: the configured
    ``spark.checkpoint.dir`` itself (Spark adds a per-application subfolder
    under it for checkpoints). Falls back to :func:`scratch_root` when unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    return conf.rstrip("/") if conf else scratch_root(spark)
