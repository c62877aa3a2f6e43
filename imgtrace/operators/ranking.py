"""Ordered operators that never put a whole group into one task.

A window over one hot group would run in a single task. Here each group is cut
into segments along the ordering key; the window runs inside a segment and only
one summary row per segment is ordered across the group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_WIDTH = 1 << 20
QUANTILE_SEGMENTS = 1024


def _segment(key: str, width: int) -> Column:
    return F.floor(F.col(key) / F.lit(width)).cast("bigint")


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join by equal keys, null equal to null; the right side's keys go."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(right, same, "left").drop(*[f"_right_{c}" for c in on])


def previous_by_key_desc(df: DataFrame, group: list[str], key: str, value: str, out: str,
                         width: int = SEGMENT_WIDTH, running_min: bool = False) -> DataFrame:
    """`value` of the row before this one in (key desc, value desc) order.

    With `running_min`, the smallest `value` among all rows before this one.
    """
    seg = df.withColumn("_seg", _segment(key, width))
    inside = Window.partitionBy(*group, "_seg").orderBy(F.desc(key), F.desc(value))
    across = Window.partitionBy(*group).orderBy(F.desc("_seg"))
    if running_min:
        local = F.min(value).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        edge = F.min(value)
        carry = F.min("_edge").over(across.rowsBetween(Window.unboundedPreceding, -1))
        merged = F.least(F.col("_local"), F.col("_carry"))
    else:
        local = F.lag(value).over(inside)
        edge = F.min_by(value, F.struct(key, value))
        carry = F.lag("_edge").over(across)
        merged = F.coalesce(F.col("_local"), F.col("_carry"))
    edges = (
        seg.groupBy(*group, "_seg").agg(edge.alias("_edge"))
        .withColumn("_carry", carry).select(*group, "_seg", "_carry")
    )
    return (
        _null_safe_join(seg.withColumn("_local", local), edges, [*group, "_seg"])
        .withColumn(out, merged).drop("_seg", "_local", "_carry")
    )


def row_numbers(df: DataFrame, group: list[str], key: str, ties: list[str], out: str,
                width: int = SEGMENT_WIDTH) -> DataFrame:
    """1-based row number over (key, ties) within each group; `key` is integral."""
    seg = df.withColumn("_seg", _segment(key, width))
    across = Window.partitionBy(*group).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        seg.groupBy(*group, "_seg").agg(F.count("*").alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(across), F.lit(0)))
        .select(*group, "_seg", "_off")
    )
    inside = Window.partitionBy(*group, "_seg").orderBy(key, *ties)
    return (
        _null_safe_join(seg.withColumn("_row", F.row_number().over(inside)), offsets, [*group, "_seg"])
        .withColumn(out, F.col("_row") + F.col("_off")).drop("_seg", "_row", "_off")
    )


def segmented(counts: DataFrame, group: list[str], segments: int = QUANTILE_SEGMENTS) -> DataFrame:
    """Rows (group, _v: distinct values, _c: their counts) with `_seg`, a number that rises with _v, and `n`, the group's total.

    The splitters are order statistics of the group's distinct values, so segments are about equal however the values
    lie; an outlier takes no more than its place. They are looked up in two steps, each a short array per row.
    """
    fan = max(2, math.ceil(math.sqrt(segments)))
    cuts = [i / (fan * fan) for i in range(1, fan * fan)]
    found = counts.groupBy(*group).agg(
        F.percentile_approx("_v", cuts, 10 * fan * fan).alias("_cuts"), F.sum("_c").alias("n"))
    coarse = found.select(*group, "n", F.transform(
        F.sequence(F.lit(1), F.lit(fan - 1)), lambda k: F.element_at("_cuts", k * fan)).alias("_coarse"))
    fine = found.select(*group, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(fan - 1)), lambda k: F.slice("_cuts", k * fan + 1, fan - 1))).alias("_part", "_fine"))
    below = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col("_v")))
    first = _null_safe_join(counts, coarse, group).withColumn("_part", below("_coarse")).drop("_coarse")
    return _null_safe_join(first, fine, [*group, "_part"]).withColumn(
        "_seg", F.col("_part") * fan + below("_fine")).drop("_part", "_fine")


def ranked_values(df: DataFrame, group: list[str], value: str,
                  segments: int = QUANTILE_SEGMENTS) -> DataFrame:
    """Distinct values with their half-open 0-based rank span [lo, hi) and group size n.

    Equal values collapse before anything is ordered, so copies cost nothing.
    """
    within = group or ["_all"]
    counts = (
        df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0))
        .groupBy(*within, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    seg = segmented(counts, within, segments)
    across = Window.partitionBy(*within).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        seg.groupBy(*within, "_seg").agg(F.sum("_c").alias("_sc"))
        .withColumn("_off", F.coalesce(F.sum("_sc").over(across), F.lit(0)))
        .select(*within, "_seg", "_off")
    )
    inside = Window.partitionBy(*within, "_seg").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0)
    hi = F.sum("_c").over(inside)
    return (
        _null_safe_join(seg.withColumn("_cum", hi), offsets, [*within, "_seg"])
        .select(*group, F.col("_v").alias("value"), "n",
                (F.col("_off") + F.col("_cum") - F.col("_c")).alias("lo"),
                (F.col("_off") + F.col("_cum")).alias("hi"))
    )


def at_rank(rank: Column) -> Column:
    """Aggregate over `ranked_values`: the value whose span holds this 0-based rank."""
    return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("value")))


def quantile(q: float) -> Column:
    """Aggregate over `ranked_values`: linearly interpolated quantile."""
    pos = F.lit(float(q)) * (F.col("n") - 1)
    low, high = at_rank(F.floor(pos)), at_rank(F.ceil(pos))
    frac = F.max(pos - F.floor(pos))
    return low + (high - low) * frac
