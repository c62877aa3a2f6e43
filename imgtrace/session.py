"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_base: str | None = None


def build_session(app: str = "imgtrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    defaults.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in defaults.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under `spark.checkpoint.dir`.

    The cluster names a shared folder there. Only in local mode (tests on one
    machine) is a temporary folder made where it names none.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _local_base
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a key-and-flag table (tens of bytes each) that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint, given only after counting that at most `max_rows` rows exist.

    A larger frame is returned as it is and joins by shuffle. Counting stops
    early, but the frame is evaluated once for it: pass cheap or stored frames.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
