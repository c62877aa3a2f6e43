"""Registration of queries and of the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir); `sql` is the same query for another engine."""

    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r6(c) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def ts_text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def i64(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
