"""Merged coverage as state against the batch form."""

import random
import time

import numpy as np
import pytest

from imgtrace.operators import ranges as G
from imgtrace.registry import streams as R
from imgtrace.session import scratch_path
from imgtrace.streaming import coverage as C

SCHEMA = "source_site string, scope_key string, lower_id long, upper_id long"


def test_merged_intervals():
    rnd = random.Random(3)
    for n in (0, 1, 5, 40):
        rows = [(a := rnd.randint(-50, 200), a + rnd.randint(0, 9)) for _ in range(n)]
        lower, upper = C.merged(*(np.array([r[i] for r in rows], np.int64) for i in (0, 1)))
        ids = {x for a, b in rows for x in range(a, b + 1)}
        assert {x for a, b in zip(lower, upper) for x in range(a, b + 1)} == ids
        assert all(b + 1 < a for b, a in zip(upper[:-1], lower[1:]))


def batches():
    """Nested, touching, repeated and border-crossing ranges, in three arrivals; the last one closes gaps."""
    rnd = random.Random(8)
    out = []
    for part in range(3):
        rows = []
        for scope in ("a", "b"):
            for _ in range(40):
                low = rnd.randint(0, 3000)
                rows.append(("s", scope, low, low + rnd.choice([0, 1, 9, 30, 250 if part else 3])))
        out.append(rows + rows[:5] + [("s", "a", 10, 9), ("s", "b", None, 4), ("t", "a", -40 + part * 10, -31 + part * 10)])
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select("source_site", "scope_key", "gap_from", "gap_to").collect())


@pytest.mark.parametrize("width", [64, 1 << 20])
def test_stream_equals_the_batch_form(spark, width):
    path = scratch_path(spark, "ranges")
    for part in batches():
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    changes = R._drain(C.coverage_stream(stream, width), "coverage", "update").cache()
    every = spark.createDataFrame(sum(batches(), []), SCHEMA).where("lower_id <= upper_id")
    assert rows(C.open_gaps(changes)) == rows(G.coverage_gaps(every, None, strict=True))
    assert changes.where("change < 0").count() > 0
    covered = {(r[0], r[1], x) for r in C.covered(changes).collect() for x in range(r[2], r[3] + 1)}
    assert covered == {(r[0], r[1], x) for r in every.collect() for x in range(r[2], r[3] + 1)}
    assert C.covered(changes).count() <= every.count() * (1 if width > 64 else 9)
