"""Small helpers of the operators: columns by name, written tables, null-safe keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imgtrace.session import materialize, scratch_path, shuffle_partitions

__all__ = ["arrow", "checked_broadcast", "materialize", "number_within", "places", "scratch_path", "table", "take_columns"]

BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def take_columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; others, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; batches without rows are skipped."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a stored table, only after a bounded count shows that it is small."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def number_within(df: DataFrame, group: list[str], order: list[Column], salt: Column, out: str,
                  weight: Column | None = None) -> DataFrame:
    """Sum of `weight` (1: a row number from 0) over the rows before this one in its group.

    The order is (salt, order...). A window runs within (group, salt) only; one row
    per salt is ordered across the group, so no group meets in one task. Null keys
    are groups of their own. `df` is read twice: pass a stored table.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    df = df.withColumns({"__salt": salt, "__w": w})
    keys = [*group, "__salt"]
    sums = df.groupBy(*keys).agg(F.sum("__w").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__off", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select(
        *[F.col(c).alias(f"__r_{c}") for c in keys], "__off")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (
        df.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
        .join(sums, cond).withColumn(out, F.col("__off") + F.col("__in"))
        .drop("__salt", "__w", "__in", "__off", *[f"__r_{c}" for c in keys])
    )


def places(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with `idx`, the place from 0 within `group` in that order, and `m`, the size of the group.

    Neither a group nor a run of equal keys has to fit one task if `order` ends with a salt. Null keys of
    `group` aren't provided for. `rows` is a stored table.
    """
    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    dealt = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "places")
    part = F.shiftrightunsigned("__at", 33)
    runs = dealt.groupBy(*group, part.alias("__part")).agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__shift"),
                       F.sum("__n").over(whole).alias("m"))
    runs = checked_broadcast(materialize(runs, "runs"), 64)
    return dealt.withColumn("__part", part).join(runs, [*group, "__part"]).withColumn(
        "idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")
