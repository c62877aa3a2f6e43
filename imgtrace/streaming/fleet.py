"""Fleet metrics as streams: windowed throughput and liveness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from imgtrace.operators.fleet import deltas, edge, edges

# --- fixed values ---------------------------------------------------------
BEAT_SECONDS = 30
TIMEOUT_SECONDS = 90
# --------------------------------------------------------------------------

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store (state spills to disk, not the heap)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def throughput_windows(metrics: DataFrame, window: str = "5 minutes",
                       lateness: str = "1 minute") -> DataFrame:
    """Counter growth per node and tumbling event-time window; batch or stream.

    Samples later than `lateness` behind the newest are dropped by the watermark.
    """
    if metrics.isStreaming:
        metrics = metrics.withWatermark("observed_at", lateness)
    e = metrics.groupBy(F.window("observed_at", window).alias("w"), "node_id").agg(*edges())
    return e.select(F.col("w.start").alias("window_start"), "node_id", *deltas(edge("first"), edge("last")))


class _Liveness(StatefulProcessor):
    """State: last beat (microseconds) and whether the node counts as online."""

    def __init__(self, timeout_seconds: int):
        self.timeout = timeout_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "last long, online boolean")

    def _get(self) -> tuple[int | None, bool]:
        return tuple(self.beat.get()) if self.beat.exists() else (None, False)

    def _rearm(self, last: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer((last + self.timeout) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = pd.concat([r["beat_us"] for r in rows]).sort_values()
        last, online = self._get()
        out = []
        for at in beats:
            at = int(at)
            if last is not None and at <= last:
                continue
            if online and at - last > self.timeout:
                out.append((key[0], last + self.timeout, "offline"))
                online = False
            if not online:
                out.append((key[0], at, "online"))
            last, online = at, True
        self.beat.update((last, online))
        self._rearm(last)
        yield pd.DataFrame(out, columns=["node_id", "at_us", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, online = self._get()
        due = last is not None and online and expiredTimerInfo.getExpiryTimeInMs() * 1000 > last + self.timeout
        if due:
            self.beat.update((last, False))
            yield pd.DataFrame([(key[0], last + self.timeout, "offline")],
                               columns=["node_id", "at_us", "status"])
        else:
            yield pd.DataFrame([], columns=["node_id", "at_us", "status"])

    def close(self) -> None:
        pass


def liveness_stream(beats: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS,
                    lateness: str = f"{BEAT_SECONDS} seconds") -> DataFrame:
    """beats(node_id, heartbeat_at) -> status changes (node_id, at_us, status).

    A node goes offline `timeout` after its last beat and online at its next one. Beats that lag the
    newest beat of any node by more than `lateness` are dropped; it should be a beat interval at least.
    """
    use_state_store(beats.sparkSession)
    timed = beats.withWatermark("heartbeat_at", lateness).select(
        "node_id", "heartbeat_at", F.unix_micros("heartbeat_at").alias("beat_us"))
    return timed.groupBy("node_id").transformWithStateInPandas(
        statefulProcessor=_Liveness(timeout_seconds),
        outputStructType=T.StructType([
            T.StructField("node_id", T.StringType()), T.StructField("at_us", T.LongType()),
            T.StructField("status", T.StringType())]),
        outputMode="Append", timeMode="EventTime")
