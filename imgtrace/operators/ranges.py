"""Work ranges: coverage, backlog, planning and bulk repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.functions.rules import DEFAULT_RANGE_SIZE, MAX_ATTEMPTS, STALE_LEASE_MINUTES
from imgtrace.operators.ranking import SEGMENT_WIDTH, previous_by_key_desc, row_numbers
from imgtrace.operators.setdiff import as_ts

# --- fixed values ---------------------------------------------------------
RECLAIMED = "노드 임대 회수"
PHASE_RUNNING = "진행 중"
PHASE_DONE = "완료"
PHASE_WAITING = "대기"
DEFAULT_GAPS = 20
DEFAULT_EXHAUSTED = 50
# --------------------------------------------------------------------------

SCOPE = ["source_site", "scope_key"]
RANGE_KEY = [*SCOPE, "direction", "lower_id", "upper_id"]
_SLICES_PER_STEP = 1024
# Planned work is due from the start unless a time is given.
ALWAYS = "1970-01-01 00:00:00"


def _is(status: str) -> Column:
    return F.col("status") == status


def is_exhausted() -> Column:
    return _is("failed") & (F.col("attempts") >= MAX_ATTEMPTS)


def range_stats(ranges: DataFrame) -> DataFrame:
    """Counts and id totals per scope."""
    size = F.col("upper_id") - F.col("lower_id") + 1
    return (
        ranges.groupBy(*SCOPE).agg(
            F.count("*").alias("total"),
            *[F.count_if(_is(s)).alias(s) for s in ("completed", "running", "failed", "empty")],
            F.count_if(is_exhausted()).alias("exhausted"),
            F.coalesce(F.sum("saved_count"), F.lit(0)).cast("bigint").alias("saved"),
            F.coalesce(F.sum(F.when(_is("failed"), size)), F.lit(0)).alias("missing_ids"),
        )
        .withColumn("complete", (F.col("total") > 0) & (F.col("failed") == 0) & (F.col("running") == 0))
    )


def coverage_gaps(ranges: DataFrame, limit: int | None = DEFAULT_GAPS, strict: bool = False,
                  width: int = SEGMENT_WIDTH) -> DataFrame:
    """Id intervals no range covers, newest first.

    Compares each range with the one before it in descending upper order; with
    nested ranges that can report ids a wider range covers. `strict` compares
    with the lowest id reached so far instead. `limit` counts per scope.
    """
    prev = previous_by_key_desc(ranges.select(*SCOPE, "lower_id", "upper_id"), SCOPE, "upper_id",
                                "lower_id", "prev_lower", width, running_min=strict)
    gaps = prev.where(F.col("prev_lower") > F.col("upper_id") + 1).select(
        *SCOPE, (F.col("upper_id") + 1).alias("gap_from"), (F.col("prev_lower") - 1).alias("gap_to"))
    gaps = gaps.withColumn("gap_size", F.col("gap_to") - F.col("gap_from") + 1)
    if limit is None:
        return gaps
    return _newest_per_scope(gaps, limit if limit > 0 else DEFAULT_GAPS, "gap_from")


def exhausted_ranges(ranges: DataFrame, limit: int = DEFAULT_EXHAUSTED) -> DataFrame:
    """The newest `limit` ranges of each scope that have no attempt left."""
    return _newest_per_scope(ranges.where(is_exhausted()), limit, "upper_id", "lower_id")


def _newest_per_scope(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*SCOPE).orderBy(*[F.desc(k) for k in keys])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def _stale(now, minutes: int = STALE_LEASE_MINUTES) -> Column:
    return F.col("leased_at") < as_ts(now) - F.make_dt_interval(mins=F.lit(minutes))


def stale_running(ranges: DataFrame, now, minutes: int = STALE_LEASE_MINUTES) -> DataFrame:
    """Running ranges per scope whose lease is too old."""
    return ranges.groupBy(*SCOPE).agg(F.count_if(_is("running") & _stale(now, minutes)).alias("stale_running"))


def reusable_ranges(ranges: DataFrame, now, floor: int) -> DataFrame:
    """Backlog of ranges a worker may take, in taking order."""
    due = (_is("failed") & (F.col("ready_at") <= as_ts(now))) | (_is("running") & _stale(now))
    return ranges.where(
        (F.col("attempts") < MAX_ATTEMPTS) & (F.col("upper_id") >= floor) & due
    ).orderBy("attempts", "id")


def ready_retries(retries: DataFrame, now, floor: int, limit: int | None = None) -> DataFrame:
    due = (_is("pending") & (F.col("ready_at") <= as_ts(now))) | (_is("running") & _stale(now))
    out = retries.where(
        (F.col("attempts") < MAX_ATTEMPTS) & (F.col("source_post_id") >= floor) & due
    ).orderBy("ready_at", "id")
    return out if limit is None else out.limit(limit)


def _cut_down(df: DataFrame, low: str, high: str, size: int) -> DataFrame:
    """Slices of at most `size` ids from `high` down to `low`, in two steps.

    A huge interval first becomes blocks of 1024 slices, so no row ever holds
    more than 1024 array elements times its block count.
    """
    block = size * _SLICES_PER_STEP
    steps = df.where(F.col(high) >= F.col(low)).withColumn(
        "_top", F.explode(F.sequence(F.col(high), F.col(low), F.lit(-block).cast("bigint"))))
    floor = F.greatest(F.col("_top") - F.lit(block) + 1, F.col(low))
    return (
        steps.withColumn("slice_upper", F.explode(
            F.sequence(F.col("_top"), floor, F.lit(-size).cast("bigint"))))
        .withColumn("slice_lower", F.greatest(F.col("slice_upper") - size + 1, F.col(low)))
        .drop("_top")
    )


def _with_ids(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids after the largest one there is, in order of the range; without ids in `existing`, from 1."""
    last = F.coalesce(existing.select(F.max("id")).scalar(), F.lit(0)) if "id" in existing.columns else F.lit(0)
    numbered = row_numbers(fresh, [], "lower_id", [*SCOPE, "direction", "upper_id"], "_n")
    return numbered.withColumn("id", (F.col("_n") + last).cast("bigint")).drop("_n")


def _new_work(df: DataFrame) -> DataFrame:
    return df.select(
        *SCOPE, F.lit("backfill").alias("direction"), F.col("slice_lower").alias("lower_id"),
        F.col("slice_upper").alias("upper_id"), F.lit("failed").alias("status"),
        F.lit(0).alias("attempts"))


def plan_gap_ranges(gaps: DataFrame, existing: DataFrame, size: int, now=ALWAYS) -> DataFrame:
    """New work covering the gaps, cut from the top, due at `now`; slices already known are left out."""
    size = size if size >= 1 else DEFAULT_RANGE_SIZE
    planned = _new_work(_cut_down(gaps, "gap_from", "gap_to", size)).distinct()
    fresh = planned.join(existing.select(*RANGE_KEY), RANGE_KEY, "left_anti")
    return _with_ids(fresh, existing).withColumn("ready_at", as_ts(now)).withColumn(
        "leased_at", F.lit(None).cast("timestamp"))


def plan_backfill(state: DataFrame, floor: int, size: int) -> DataFrame:
    """The whole remaining backfill, cut downwards from the frontier to the floor."""
    span = state.where(F.col("backfill_before_id").isNotNull()).select(
        *SCOPE, F.lit(floor).cast("bigint").alias("_lo"),
        (F.col("backfill_before_id") - 1).alias("_hi"))
    return _cut_down(span, "_lo", "_hi", size).select(
        *SCOPE, F.col("slice_lower").alias("lower_id"), F.col("slice_upper").alias("upper_id"))


def split_at_floor(ranges: DataFrame, floor: int, now=ALWAYS) -> DataFrame:
    """Failed or running ranges across the floor keep their upper part.

    What lies below becomes new, never attempted work, due at `now`, unless it already exists.
    """
    across = (F.col("lower_id") < floor) & (F.col("upper_id") >= floor) & \
        F.col("status").isin("failed", "running")
    below = ranges.where(across).select(
        *SCOPE, "direction", "lower_id", F.lit(floor - 1).cast("bigint").alias("upper_id"),
        F.lit("failed").alias("status"), F.lit(0).alias("attempts"))
    fresh = below.distinct().join(ranges.select(*RANGE_KEY), RANGE_KEY, "left_anti")
    fresh = _with_ids(fresh, ranges).withColumn("ready_at", as_ts(now))
    fresh = fresh.select(*[c for c in fresh.columns if c in ranges.columns])
    kept = ranges.withColumn(
        "lower_id", F.when(across, F.lit(floor).cast("bigint")).otherwise(F.col("lower_id")))
    return kept.unionByName(fresh, allowMissingColumns=True)


def _rewrite(df: DataFrame, where: Column, **sets) -> DataFrame:
    """Set columns where the predicate holds; `touched` marks the rows."""
    df = df.withColumn("touched", F.coalesce(where, F.lit(False)))
    for name, value in sets.items():
        kind = df.schema[name].dataType
        value = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(name, F.when(F.col("touched"), value.cast(kind)).otherwise(F.col(name)))
    return df


def touched(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("touched").alias("affected"))


def reset_exhausted(ranges: DataFrame) -> DataFrame:
    return _rewrite(ranges, is_exhausted(), attempts=0, last_error=None, node_id=None)


def reset_range(ranges: DataFrame, range_id: int) -> DataFrame:
    return _rewrite(ranges, F.col("id") == range_id, attempts=0, last_error=None, node_id=None,
                    status="failed")


def retry_failed_ranges(ranges: DataFrame, now) -> DataFrame:
    return _rewrite(ranges, _is("failed"), attempts=0, ready_at=as_ts(now), last_error=None,
                    node_id=None, leased_at=None)


def retry_pending_queue(retries: DataFrame, now) -> DataFrame:
    tired = _is("dead") | (F.col("attempts") >= MAX_ATTEMPTS)
    return _rewrite(retries, F.col("status").isin("pending", "dead"),
                    attempts=F.when(tired, 0).otherwise(F.col("attempts")), ready_at=as_ts(now),
                    node_id=None, leased_at=None, last_error=None, status="pending")


def reset_retry_queue(retries: DataFrame, now) -> DataFrame:
    return _rewrite(retries, _is("dead") | (F.col("attempts") >= MAX_ATTEMPTS), attempts=0,
                    ready_at=as_ts(now), node_id=None, last_error=None, status="pending")


def reclaim_ranges(ranges: DataFrame, holders: DataFrame) -> DataFrame:
    """Running ranges held by `holders(node_id)` go back to failed; ready time stays."""
    return _reclaim(ranges, holders, status="failed", last_error=RECLAIMED)


def reclaim_retries(retries: DataFrame, holders: DataFrame) -> DataFrame:
    return _reclaim(retries, holders, status="pending", leased_at=None)


def _reclaim(work: DataFrame, holders: DataFrame, **sets) -> DataFrame:
    held = holders.select("node_id").distinct().withColumn("_held", F.lit(True))
    j = work.join(held, "node_id", "left")
    return _rewrite(j, _is("running") & F.col("_held"), node_id=None, **sets).drop("_held")


# --- progress -------------------------------------------------------------

def coverage_pct(high: Column, before: Column, clamp: bool = True) -> Column:
    """Share of ids already swept, in percent; unclamped as the command line prints it."""
    span = high - before
    if clamp:
        span = F.least(F.greatest(span, F.lit(0)), high)
    return F.when(F.coalesce(high, F.lit(0)) <= 0, F.lit(0.0)).otherwise(span / high * 100)


def remaining_ranges(total: Column, done: Column, active: Column, empty: Column,
                     failed: Column) -> Column:
    return F.greatest(F.lit(0), total - (done + active + empty + failed))


def phase(active: Column, per_second: Column, coverage: Column, failed: Column,
          retry: Column) -> Column:
    return (
        F.when((active > 0) | (per_second > 0), PHASE_RUNNING)
        .when((coverage >= 99.9) & (failed == 0) & (retry == 0), PHASE_DONE)
        .otherwise(PHASE_WAITING)
    )
