"""Node throughput, liveness and network paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.functions import rules as R
from imgtrace.operators.setdiff import as_ts

COUNTERS = ("downloaded", "embedded", "saved", "failed")


def _seconds(a: Column, b: Column) -> Column:
    """b - a in seconds, as double."""
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


SAMPLE = ("observed_at", *COUNTERS, "cpu_pct", "mem_mb")


def edges() -> list[Column]:
    """Aggregates for the earliest and the latest sample.

    One fixed-width aggregate per field keeps this a hash aggregate; picking
    whole structs would sort every sample first.
    """
    return [fn(c, "observed_at").alias(f"{end}_{c}")
            for end, fn in (("first", F.min_by), ("last", F.max_by)) for c in SAMPLE]


def edge(end: str) -> Column:
    return F.struct(*[F.col(f"{end}_{c}").alias(c) for c in SAMPLE])


def first_last_per_node(metrics: DataFrame) -> DataFrame:
    """Earliest and latest sample of each node: one pass, no self-join, map-side combined."""
    return metrics.groupBy("node_id").agg(*edges()).select(
        "node_id", edge("first").alias("first"), edge("last").alias("last"))


def fleet_summary(metrics: DataFrame, now, window_seconds: int) -> DataFrame:
    """Counter growth of each node over the window that ends at `now`."""
    edge = as_ts(now) - F.make_dt_interval(secs=F.lit(window_seconds))
    e = first_last_per_node(metrics.where(F.col("observed_at") > edge))
    return e.select("node_id", *deltas(F.col("first"), F.col("last")))


def deltas(first: Column, last: Column) -> list[Column]:
    grown = {c: F.greatest(last[c] - first[c], F.lit(0)) for c in COUNTERS}
    span = _seconds(first["observed_at"], last["observed_at"])
    return [
        *[grown[c].alias(c) for c in COUNTERS],
        F.when(span > 0, grown["saved"] / span).otherwise(F.lit(0.0)).alias("per_second"),
        F.coalesce(last["cpu_pct"], F.lit(0)).cast("float").alias("cpu_pct"),
        F.coalesce(last["mem_mb"], F.lit(0)).cast("float").alias("mem_mb"),
    ]


def fleet_total(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.sum("per_second"), F.lit(0.0)).alias("total_per_second"),
                       F.count("*").alias("nodes"))


def node_view(nodes: DataFrame, summary: DataFrame, now, timeout_seconds: int) -> DataFrame:
    """Effective status and recent throughput per node, by role and id."""
    edge = as_ts(now) - F.make_dt_interval(secs=F.lit(timeout_seconds))
    alive = (F.col("status") == "online") & (F.col("heartbeat_at") > edge)
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS}
    return (
        nodes.withColumn("effective_status", F.when(alive, "online").otherwise("offline"))
        .withColumn("last_seen_sec", _seconds(F.col("heartbeat_at"), as_ts(now)))
        .join(summary, "node_id", "left")
        .select("node_id", "role", "effective_status", "last_seen_sec", *zero.values(),
                *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("per_second", "cpu_pct", "mem_mb")])
        .orderBy("role", "node_id")
    )


def node_counts(view: DataFrame) -> DataFrame:
    return view.agg(F.count_if(F.col("effective_status") == "online").alias("online_nodes"),
                    F.count("*").alias("total_nodes"))


def best_paths(probes: DataFrame, now, max_age_seconds: int, node_id: str | None = None) -> DataFrame:
    """Fastest path that worked lately, per node and host; unknown latency comes last."""
    edge = as_ts(now) - F.make_dt_interval(secs=F.lit(max_age_seconds))
    ok = probes.where(F.col("ok") & (F.col("checked_at") > edge))
    if node_id is not None:
        ok = ok.where(F.col("node_id") == node_id)
    order = F.struct(F.col("latency_ms").isNull(), F.col("latency_ms"), F.col("mode"))
    return ok.groupBy("node_id", "host").agg(
        F.min_by(F.struct("mode", "latency_ms"), order).alias("best")
    ).select("node_id", "host", "best.mode", "best.latency_ms")


def prune_metrics(metrics: DataFrame, now, keep_seconds: int = 24 * 3600) -> DataFrame:
    edge = as_ts(now) - F.make_dt_interval(secs=F.lit(keep_seconds))
    return metrics.where(F.col("observed_at") >= edge)


def probe_summary(log: DataFrame) -> DataFrame:
    """Download attempts per concurrency step: rates, mean size, failure kinds.

    log(step, started_at, seconds, bytes, http_code, error).
    """
    failed = F.col("error").isNotNull()
    kind = F.when(failed, R.failure_kind(F.col("http_code"), F.col("error")))
    start = F.unix_micros("started_at") / F.lit(1e6)
    by_kind = log.groupBy("step", kind.alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.when(~failed, F.col("bytes"))).alias("bytes"),
        F.min(start).alias("t0"), F.max(start + F.col("seconds")).alias("t1"))
    text = F.when(F.col("kind").isNotNull(),
                  F.concat(F.col("kind"), F.lit(" "), F.col("n").cast("string")))
    agg = by_kind.groupBy("step").agg(
        F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0)).alias("ok"),
        F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        (F.max("t1") - F.min("t0")).alias("elapsed"),
        F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("kinds"))
    rate = lambda x: F.when(F.col("elapsed") > 0, x / F.col("elapsed")).otherwise(0.0)
    return agg.select(
        "step", "ok", "failed", rate(F.col("ok")).alias("per_second"),
        rate(F.col("bytes") / F.lit(float(R.MIB))).alias("mb_per_second"),
        F.floor(F.col("bytes") / F.greatest(F.col("ok"), F.lit(1))).alias("mean_bytes"),
        F.when(F.col("kinds") == "", "-").otherwise(F.col("kinds")).alias("failures"))
