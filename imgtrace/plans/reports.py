"""Summary reports over the crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.operators import ranges as G

SCOPE = G.SCOPE


def vectors_by_model(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("model_id").agg(F.count("*").alias("vectors"))


def crawl_summary(ranges: DataFrame, retries: DataFrame, state: DataFrame) -> DataFrame:
    """One row per scope: range and retry counts, watermarks (unknown ones are 0).

    Vectors per model are `vectors_by_model`, which is not tied to a scope.
    """
    r = ranges.groupBy(*SCOPE).agg(*[
        F.count_if(F.col("status") == s).alias(f"ranges_{s}")
        for s in ("completed", "running", "failed", "empty")])
    q = retries.groupBy(*SCOPE).agg(
        F.count_if(F.col("status") == "pending").alias("retry_pending"),
        F.count_if(F.col("status") == "dead").alias("retry_dead"))
    j = r.join(q, SCOPE, "full_outer").join(state, SCOPE, "full_outer")
    marks = [F.coalesce(c, F.lit(0)).alias(a) for c, a in
             (("high_watermark_id", "high_watermark"), ("backfill_before_id", "backfill_before"))]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in [*r.columns[2:], *q.columns[2:]]]
    return j.select(*SCOPE, *counts, *marks)


def progress(summary: DataFrame, stats: DataFrame, saved_per_second: float = 0.0) -> DataFrame:
    """Coverage, remaining ranges and phase per scope."""
    s = summary.join(stats.select(*SCOPE, "total", "empty"), SCOPE, "left")
    pct = G.coverage_pct(F.col("high_watermark"), F.col("backfill_before"))
    return s.select(
        *SCOPE, pct.alias("coverage_pct"),
        G.coverage_pct(F.col("high_watermark"), F.col("backfill_before"), clamp=False)
        .alias("swept_pct"),
        G.remaining_ranges(F.coalesce("total", F.lit(0)), F.col("ranges_completed"),
                           F.col("ranges_running"), F.col("ranges_empty"), F.col("ranges_failed"))
        .alias("remaining_ranges"),
        G.phase(F.col("ranges_running"), F.lit(saved_per_second), pct, F.col("ranges_failed"),
                F.col("retry_pending")).alias("phase"))


def jobs_report(ranges: DataFrame, retries: DataFrame, state: DataFrame, now) -> DataFrame:
    """Everything the operations page shows, one row per scope.

    The two lists inside are the scope's top-50 exhausted ranges and top-20 gaps.
    """
    stats = G.range_stats(ranges)
    summary = crawl_summary(ranges, retries, state)
    worst = G.exhausted_ranges(ranges).select(*SCOPE, F.struct(
        F.col("upper_id").alias("upper"), F.col("lower_id").alias("lower"), F.col("id").alias("id"),
        (F.col("upper_id") - F.col("lower_id") + 1).alias("count"), "attempts",
        F.substring(F.coalesce("last_error", F.lit("")), 1, 160).alias("error")).alias("item"))
    gaps = G.coverage_gaps(ranges).select(*SCOPE, F.struct("gap_from", "gap_to", "gap_size").alias("item"))
    newest_first = lambda df, name: df.groupBy(*SCOPE).agg(
        F.sort_array(F.collect_list("item"), asc=False).alias(name))
    listed = lambda c, df: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    worst, gaps = newest_first(worst, "failed_ranges"), newest_first(gaps, "gaps")
    return stats.join(
        summary.select(*SCOPE, "retry_pending", "retry_dead", "high_watermark", "backfill_before"),
        SCOPE, "left",
    ).join(G.stale_running(ranges, now), SCOPE, "left").join(worst, SCOPE, "left").join(gaps, SCOPE, "left").select(
        *[c for c in stats.columns], "retry_pending", "retry_dead", "high_watermark", "backfill_before", "stale_running",
        listed("failed_ranges", worst), listed("gaps", gaps))
