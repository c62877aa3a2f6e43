"""Coverage of work ranges as state: merged intervals that a stream of ranges keeps up to date.

Ids are cut into stripes, and each (site, scope, stripe) is a key of its own, so one busy scope is the work of many
tasks. A key's state maps the lower end of each merged interval to its upper end; touching and overlapping
ranges are one interval, so state grows with the gaps, not with the ranges. What changes is sent: +1 for an
interval that came to be, -1 for one that went. Added up, the changes are the intervals as they are now, and the
gaps between these, across stripes too, are the ids that no range covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from imgtrace.operators import ranges as G
from imgtrace.streaming.fleet import use_state_store

STRIPE = 1 << 20
CHANGES = "source_site string, scope_key string, stripe long, lower_id long, upper_id long, change int"


def merged(lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fewest intervals that cover the same whole numbers as these, in order."""
    if not len(lower):
        return lower, upper
    order = np.argsort(lower, kind="stable")
    lower, upper = lower[order], np.maximum.accumulate(upper[order])
    first = np.ones(len(lower), bool)
    first[1:] = lower[1:] > upper[:-1] + 1
    last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(lower) - 1]))
    return lower[first], upper[last]


class _Coverage(StatefulProcessor):
    """State: merged intervals of one stripe, lower end -> upper end."""

    def init(self, handle) -> None:
        self.intervals = handle.getMapState("intervals", "lower long", "upper long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = {int(k[0]): int(v[0]) for k, v in self.intervals.iterator()}
        lower, upper = (np.fromiter(x, np.int64, len(old)) for x in (old.keys(), old.values()))
        for part in rows:  # merged part by part: never more than state and one part at a time
            lower, upper = merged(np.concatenate((lower, part["lower_id"].to_numpy(np.int64))),
                                  np.concatenate((upper, part["upper_id"].to_numpy(np.int64))))
        new = dict(zip(lower.tolist(), upper.tolist(), strict=True))
        out = []
        for low, high in old.items():
            if new.get(low) != high:
                out.append((*key, low, high, -1))
                if low not in new:
                    self.intervals.removeKey((low,))
        for low, high in new.items():
            if old.get(low) != high:
                out.append((*key, low, high, 1))
                self.intervals.updateValue((low,), (high,))
        yield pd.DataFrame(out, columns=["source_site", "scope_key", "stripe", "lower_id", "upper_id", "change"])

    def close(self) -> None:
        pass


def striped(ranges: DataFrame, width: int = STRIPE) -> DataFrame:
    """Ranges (site, scope, lower_id, upper_id) cut at the borders of the stripes; empty and null ones go."""
    wide = F.lit(width).cast("bigint")
    number = lambda c: F.call_function("div", F.col(c) - F.pmod(F.col(c), wide), wide)
    cut = ranges.where("lower_id <= upper_id").select(
        *G.SCOPE, "lower_id", "upper_id", F.explode(F.sequence(number("lower_id"), number("upper_id"))).alias("stripe"))
    return cut.select(*G.SCOPE, "stripe", F.greatest("lower_id", F.col("stripe") * width).alias("lower_id"),
                      F.least("upper_id", (F.col("stripe") + 1) * width - 1).alias("upper_id"))


def coverage_stream(ranges: DataFrame, width: int = STRIPE) -> DataFrame:
    """A stream of ranges -> changes of its merged intervals."""
    use_state_store(ranges.sparkSession)
    return striped(ranges, width).groupBy(*G.SCOPE, "stripe").transformWithStateInPandas(
        statefulProcessor=_Coverage(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def covered(changes: DataFrame) -> DataFrame:
    """The intervals as they are after these changes."""
    now = changes.groupBy(*G.SCOPE, "stripe", "lower_id", "upper_id").agg(F.sum("change").alias("n"))
    return now.where("n > 0").select(*G.SCOPE, "lower_id", "upper_id")


def open_gaps(changes: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids between covered ones, as `ranges.coverage_gaps(strict=True)` has them, from the intervals alone."""
    return G.coverage_gaps(covered(changes), limit, strict=True)
