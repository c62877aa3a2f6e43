"""Ranges, merges, set differences, quantiles on small literal tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtrace.operators import capacity as C
from imgtrace.operators import evaluate as E
from imgtrace.operators import fleet as L
from imgtrace.operators import merge as M
from imgtrace.operators import models as MO
from imgtrace.operators import ranges as G
from imgtrace.operators import ranking as K
from imgtrace.operators import setdiff as X

NOW = "2024-01-10 00:00:00"
RANGE = ("id long, source_site string, scope_key string, direction string, lower_id long, upper_id long, "
         "status string, attempts int, node_id string, leased_at timestamp, ready_at timestamp, "
         "saved_count int, last_error string")


def ranges(spark, rows):
    """rows: (lower, upper[, status[, attempts[, saved]]])"""
    t = dt.datetime(2024, 1, 1)
    full = []
    for i, r in enumerate(rows, 1):
        lo, hi, st, at, sv = (*r, *("completed", 0, 0)[len(r) - 2:])
        full.append((i, "s", "d", "backfill", lo, hi, st, at, "n1" if st == "running" else None, t, t, sv, None))
    return spark.createDataFrame(full, RANGE)


def test_range_stats(spark):
    r = ranges(spark, [(1, 10, "completed", 1, 8), (11, 20, "completed", 1, 9), (21, 30, "running", 1),
                       (31, 40, "empty", 1), (41, 50, "failed", 5), (51, 60, "failed", 2)])
    s = G.range_stats(r).first()
    assert (s.total, s.completed, s.running, s.empty, s.failed, s.exhausted, s.missing_ids, s.saved) == (
        6, 2, 1, 1, 2, 1, 20, 17)
    assert not s.complete
    assert G.range_stats(ranges(spark, [(1, 2)])).first().complete


def gaps(spark, rows, **kw):
    return [(g.gap_from, g.gap_to, g.gap_size) for g in G.coverage_gaps(ranges(spark, rows), **kw).collect()]


def test_coverage_gaps(spark):
    assert gaps(spark, [(1, 100), (200, 300)]) == [(101, 199, 99)]
    assert gaps(spark, [(1, 100), (101, 300)]) == []
    nested = [(1, 300), (200, 250), (1, 100)]
    assert gaps(spark, nested) == [(101, 199, 99)]
    assert gaps(spark, nested, strict=True) == []


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("strict", [False, True])
def test_segments_do_not_change_the_gaps(spark, width, strict):
    rng = np.random.default_rng(width)
    lo = rng.integers(1, 400, 60)
    rows = [(int(a), int(a + n)) for a, n in zip(lo, rng.integers(0, 9, 60))]
    got = sorted(gaps(spark, rows, limit=None, strict=strict, width=width))
    want, prev, reach = [], None, None
    for a, b in sorted(rows, key=lambda r: (-r[1], -r[0])):
        edge = reach if strict else prev
        if edge is not None and edge > b + 1:
            want.append((b + 1, edge - 1, edge - b - 1))
        prev, reach = a, a if reach is None else min(reach, a)
    assert got == sorted(want)


def test_plan_gap_ranges(spark):
    r = ranges(spark, [(26, 30)]).limit(0)
    g = spark.createDataFrame([("s", "d", 1, 25)], "source_site string, scope_key string, gap_from long, gap_to long")
    first = G.plan_gap_ranges(g, r, 10)
    got = sorted((x.lower_id, x.upper_id, x.status, x.attempts) for x in first.collect())
    assert got == [(1, 5, "failed", 0), (6, 15, "failed", 0), (16, 25, "failed", 0)]
    assert G.plan_gap_ranges(g, first, 10).count() == 0
    assert G.plan_gap_ranges(g, r, 0).count() == 1


def test_long_gap_is_cut_in_two_steps(spark):
    g = spark.createDataFrame([("s", "d", 1, 5000)], "source_site string, scope_key string, gap_from long, gap_to long")
    got = sorted((x.lower_id, x.upper_id) for x in G._cut_down(g, "gap_from", "gap_to", 2).select(
        F.col("slice_lower").alias("lower_id"), F.col("slice_upper").alias("upper_id")).collect())
    assert got == [(i, i + 1) for i in range(1, 5000, 2)]


def test_plan_backfill(spark):
    st = spark.createDataFrame([("s", "d", 100, 26), ("s", "e", 100, None), ("s", "f", 9, 3)],
                               "source_site string, scope_key string, high_watermark_id long, backfill_before_id long")
    got = sorted((r.scope_key, r.lower_id, r.upper_id) for r in G.plan_backfill(st, 5, 10).collect())
    assert got == [("d", 5, 5), ("d", 6, 15), ("d", 16, 25)]


def test_split_at_floor(spark):
    r = ranges(spark, [(901, 1000, "failed", 3), (1, 100, "failed", 1), (940, 960, "completed", 1)])
    got = sorted((x.lower_id, x.upper_id, x.status, x.attempts) for x in G.split_at_floor(r, 950).collect())
    assert got == [(1, 100, "failed", 1), (901, 949, "failed", 0), (940, 960, "completed", 1),
                   (950, 1000, "failed", 3)]


def test_reusable(spark):
    r = ranges(spark, [(1, 10, "failed", 4), (11, 20, "failed", 5), (21, 30, "running", 1), (31, 40, "completed", 0),
                       (41, 50, "failed", 0)])
    assert [x.id for x in G.reusable_ranges(r, NOW, 0).collect()] == [5, 3, 1]
    assert [x.id for x in G.reusable_ranges(r, NOW, 15).collect()] == [5, 3]
    assert G.reusable_ranges(r, "2023-12-31 00:00:00", 0).count() == 0


def test_rewrites_touch_only_their_columns(spark):
    r = ranges(spark, [(1, 10, "failed", 5), (11, 20, "failed", 1)])
    a = {x.id: x for x in G.reset_exhausted(r).collect()}
    assert a[1].attempts == 0 and a[1].touched and a[1].ready_at == dt.datetime(2024, 1, 1)
    assert a[2].attempts == 1 and not a[2].touched
    b = G.retry_failed_ranges(r, NOW).collect()
    assert all(x.ready_at == dt.datetime(2024, 1, 10) and x.leased_at is None for x in b)


def test_dead_leases_and_reclaim(spark):
    r = ranges(spark, [(1, 10, "running", 1), (11, 20, "completed", 1)])
    nodes = spark.createDataFrame([("n1", "online", dt.datetime(2024, 1, 9, 23, 59))],
                                  "node_id string, status string, heartbeat_at timestamp")
    assert X.dead_node_leases(r, nodes, NOW, 90).count() == 0
    dead = X.dead_node_leases(r, nodes, NOW, 30)
    assert [x.id for x in dead.collect()] == [1]
    back = {x.id: x for x in G.reclaim_ranges(r, dead).collect()}
    assert back[1].status == "failed" and back[1].node_id is None and back[1].last_error == G.RECLAIMED
    assert back[2].status == "completed" and back[2].last_error is None


def test_progress_rules(spark):
    rows = [(100, 0), (100, 25), (0, 0), (100, 150), (100, -50)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h long, b long").orderBy("i")
    got = [r[0] for r in df.select(G.coverage_pct(F.col("h"), F.col("b"))).collect()]
    assert got == [100, 75, 0, 0, 100]
    assert [r[0] for r in df.select(G.coverage_pct(F.col("h"), F.col("b"), clamp=False)).collect()][3:] == [-50, 150]
    ph = lambda a, s, c, f, q: df.limit(1).select(
        G.phase(F.lit(a), F.lit(s), F.lit(c), F.lit(f), F.lit(q))).first()[0]
    assert ph(1, 0.0, 0.0, 0, 0) == G.PHASE_RUNNING and ph(0, 0.5, 0.0, 0, 0) == G.PHASE_RUNNING
    assert ph(0, 0.0, 99.9, 0, 0) == G.PHASE_DONE and ph(0, 0.0, 99.9, 1, 0) == G.PHASE_WAITING


def test_complete_images_and_empty_model_list(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    v = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "image_id long, model_id string")
    assert [r.image_id for r in X.fully_indexed(images, v, ["a", "b"]).collect()] == [1]
    assert X.fully_indexed(images, v, []).count() == 3


def test_missing_page_cursor_survives_an_empty_page(spark):
    images = spark.createDataFrame([(i, "t") for i in range(1, 6)] + [(9, ""), (10, None)], "image_id long, thumb_path string")
    v = spark.createDataFrame([(1, "m"), (2, "m")], "image_id long, model_id string")
    missing, cursor = X.thumbs_missing_page(images, v, "m", 0, 2)
    assert missing.count() == 0 and cursor.first().cursor == 2
    assert sorted(r.image_id for r in X.thumbs_missing_vector(images, v, "m").collect()) == [3, 4, 5]


def test_validate_vectors(spark):
    active = [{"model_id": "a", "vector_size": 4}, {"model_id": "b", "vector_size": 2}]
    good = [1.0] * 4
    nan, inf = float("nan"), float("inf")
    items = spark.createDataFrame([(i,) for i in range(1, 8)], "item_id long")
    v = spark.createDataFrame([
        (1, "a", good), (1, "b", [1.0, 1.0]), (2, "a", good), (3, "a", [1.0]), (3, "b", [1.0, 1.0]),
        (4, "a", good), (4, "b", [1.0, nan]), (5, "a", [inf, 0.0, 0.0, 0.0]), (5, "b", [1.0]),
        (6, "a", good), (6, "b", [1.0, 1.0]), (6, "x", [1.0])], "item_id long, model_id string, vector array<float>")
    got = {r.item_id: (r.fault, r.fault_model, r.unregistered) for r in X.validate_vectors(items, v, active).collect()}
    assert got == {1: (None, None, 0), 2: (X.MISMATCH, "b", 0), 3: (X.MISMATCH, "a", 0),
                   4: (X.BAD_VECTOR, "b", 0), 5: (X.BAD_VECTOR, "a", 0), 6: (None, None, 1),
                   7: (X.MISMATCH, "a", 0)}


def test_no_active_model_is_an_error(spark):
    rep = spark.createDataFrame([("n", "a", 1)], "node_id string, model_id string, vector_size int")
    with pytest.raises(ValueError):
        X.verify_node_models([], rep)


def test_latest_arrival_wins_and_old_hash_survives(spark):
    old = spark.createDataFrame([(7, "s", 1, "r", "aa", "t.jpg", ["x"])],
                                "image_id long, source_site string, source_post_id long, rating string, phash string, "
                                "thumb_path string, tags array<string>").withColumn(
        "created_at", X.as_ts("2024-01-01")).withColumn("updated_at", X.as_ts("2024-01-01"))
    new = spark.createDataFrame([("s", 1, "early", "bb", "", ["y"], 1), ("s", 1, "", "", None, None, 2),
                                 ("s", 5, "q", "cc", "", ["z"], 1), ("r", 5, "q", "cc", "", ["z"], 1)],
                                "source_site string, source_post_id long, rating string, phash string, "
                                "thumb_path string, tags array<string>, arrival int")
    got = {(r.source_site, r.source_post_id): r for r in M.upsert_images(old, new, NOW).collect()}
    one = got["s", 1]
    assert (one.image_id, one.rating, one.phash, one.thumb_path, one.tags) == (7, None, "aa", "t.jpg", [])
    assert one.created_at == dt.datetime(2024, 1, 1) and one.updated_at == dt.datetime(2024, 1, 10)
    assert got["r", 5].image_id == 8 and got["s", 5].image_id == 9


def test_watermark_never_goes_back(spark):
    st = spark.createDataFrame([("s", "d", 100, 40)], "source_site string, scope_key string, "
                               "high_watermark_id long, backfill_before_id long")
    seen = spark.createDataFrame([("s", "d", 50)], "source_site string, scope_key string, post_id long")
    assert M.advance_watermark(st, seen).first().high_watermark_id == 100
    new = spark.createDataFrame([("s", "d", 120), ("s", "e", 7)], "source_site string, scope_key string, latest_id long")
    got = {r.scope_key: (r.high_watermark_id, r.backfill_before_id) for r in M.init_state(st, new).collect()}
    assert got == {"d": (120, 40), "e": (7, 7)}


def test_cache_keeps_vector_and_renews_hash(spark):
    cache = spark.createDataFrame([("h", "m", [1.0], "", 3, dt.datetime(2024, 1, 1))],
                                  "sha256 string, model_id string, vector array<float>, phash string, hits long, last_used_at timestamp")
    req = spark.createDataFrame([("h", "m")], "sha256 string, model_id string")
    from imgtrace.operators import search as S
    assert not S.cached_queries(req, cache).first().hit
    new = spark.createDataFrame([("h", "m", [2.0], "ff", 1)],
                                "sha256 string, model_id string, vector array<float>, phash string, arrival int")
    put = M.put_queries(cache, new, NOW)
    r = put.first()
    assert (r.vector, r.phash, r.hits) == ([1.0], "ff", 3)
    assert S.cached_queries(req, put).first().hit


def test_activating_a_model_rests_its_kind(spark):
    from imgtrace.schema import MODELS
    m = spark.createDataFrame([("a", "copy", 4, "cosine", 224, True), ("b", "semantic", 4, "cosine", 224, True)], MODELS)
    new = {"model_id": "c", "kind": "copy", "vector_size": 8, "distance": "dot", "input_size": 224, "active": True}
    out = M.upsert_model(M.upsert_model(m, new), new)
    assert {r.model_id: r.active for r in out.collect()} == {"a": False, "b": True, "c": True}
    pick = {r.kind: (r.model_id, r.is_primary) for r in M.active_model_per_kind(out).collect()}
    assert pick == {"copy": ("c", True), "semantic": ("b", False)}


def test_model_specs(spark):
    full = '{"id":"%s","kind":"%s","backend":"t","checkpoint":"c","vector_size":%s%s}'
    rows = [full % ("a", "copy", 768, ""), full % ("b", "other", 1, ""), full % ("c", "copy", 0, ""),
            full % ("d", "semantic", 1, ',"input_size":0'), '{"id":"e"}', full % ("f", "copy", 1, ""),
            full % ("f", "copy", 1, ""), "not json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, spec string")
    got = MO.parse_model_specs(df)
    assert [r.fault for r in got.orderBy("i").collect()] == [
        None, "kind", "vector_size", "input_size", "missing fields", "duplicate id", "duplicate id", "missing fields"]
    assert got.where("i = 0").first().input_size == 224
    assert MO.accept_specs(got.where("i = 0")).count() == 1
    with pytest.raises(ValueError):
        MO.accept_specs(got)
    with pytest.raises(ValueError):
        MO.accept_specs(got.limit(0))


def test_fleet_clamps_and_zero_span(spark):
    t = dt.datetime(2024, 1, 9, 23, 50)
    rows = [("a", t, 1, 1, 10, 0, 1.0, 1.0), ("a", t + dt.timedelta(seconds=100), 5, 5, 30, 0, None, None),
            ("b", t, 9, 9, 9, 9, 1.0, 1.0), ("c", t, 9, 9, 9, 9, 1.0, 1.0),
            ("c", t + dt.timedelta(seconds=10), 1, 1, 1, 1, 2.0, 2.0), ("d", t - dt.timedelta(days=1), 1, 1, 1, 1, 1.0, 1.0)]
    m = spark.createDataFrame(rows, "node_id string, observed_at timestamp, downloaded long, embedded long, saved long, "
                              "failed long, cpu_pct float, mem_mb float")
    got = {r.node_id: (r.saved, r.per_second, r.cpu_pct) for r in L.fleet_summary(m, NOW, 3600).collect()}
    assert got == {"a": (20, 0.2, 0.0), "b": (0, 0.0, 1.0), "c": (0, 0.0, 2.0)}


def test_best_path_prefers_known_latency(spark):
    t = dt.datetime(2024, 1, 9, 23, 59)
    rows = [("n", "h", "direct", True, None, t), ("n", "h", "proxy", True, 30, t), ("n", "h", "split", False, 1, t),
            ("n", "h", "old", True, 1, dt.datetime(2023, 1, 1)), ("n", "k", "direct", True, None, t)]
    p = spark.createDataFrame(rows, "node_id string, host string, mode string, ok boolean, latency_ms int, checked_at timestamp")
    got = {r.host: r.mode for r in L.best_paths(p, NOW, 3600, "n").collect()}
    assert got == {"h": "proxy", "k": "direct"}


@pytest.mark.parametrize("segments", [1, 3, 4096])
def test_quantiles_match_numpy(spark, segments):
    rng = np.random.default_rng(segments)
    data = {"a": rng.standard_normal(501), "b": np.repeat(-3.0, 40), "c": np.array([2.0]),
            "d": np.concatenate([np.zeros(300), rng.integers(0, 5, 30)])}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double")
    got = K.ranked_values(df, ["g"], "x", segments).groupBy("g").agg(
        *[K.quantile(q).alias(f"q{i}") for i, q in enumerate((0, 0.01, 0.5, 0.99, 0.999, 1.0))]).collect()
    for r in got:
        assert list(r)[1:] == pytest.approx(list(np.quantile(data[r.g], (0, 0.01, 0.5, 0.99, 0.999, 1.0))))


@pytest.mark.parametrize("far", [None, 1e12, -1e300])
def test_segments_are_even_whatever_the_values(spark, far):
    """Uniform, lognormal and clustered values, with one value far beyond them."""
    rng = np.random.default_rng(9)
    data = {"u": rng.random(4000), "l": rng.lognormal(0, 5, 4000), "c": np.concatenate([rng.random(3900) * 1e-9, rng.random(100)]), None: rng.random(50)}
    rows = [(g, float(x)) for g, xs in data.items() for x in np.unique(xs)] + ([(g, far) for g in data] if far else [])
    df = spark.createDataFrame(rows, "g string, _v double").withColumn("_c", F.lit(1))
    seg = K.segmented(df, ["g"], 64).groupBy("g", "_seg").agg(F.count("*").alias("k"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).toPandas()
    for g, part in seg.groupby("g", dropna=False):
        part = part.sort_values("_seg")
        assert (part["lo"].to_numpy()[1:] > part["hi"].to_numpy()[:-1]).all()
        if len(part) > 50:
            assert part["k"].max() <= 2 * part["k"].mean()
    assert seg["k"].sum() == len(rows) and len(seg[seg["g"] == "u"]) >= 60


@pytest.mark.parametrize("width", [1, 10, 1 << 20])
def test_row_numbers(spark, width):
    rng = np.random.default_rng(3)
    rows = [("g" if x % 3 else "h", int(x), i) for i, x in enumerate(rng.integers(-50, 50, 200))]
    df = spark.createDataFrame(rows, "g string, k long, i long")
    got = {r.i: r.n for r in K.row_numbers(df, ["g"], "k", ["i"], "n", width).collect()}
    for g in "gh":
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            assert got[i] == n


def test_score_separation(spark):
    real, fake = [0.9, 0.8, 0.7, 0.2], [0.1, 0.3, 0.5]
    rows = [("m", "real", x) for x in real] + [("m", "fake", x) for x in fake] + [("only", "real", 1.0)]
    df = spark.createDataFrame(rows, "method string, kind string, score double")
    o = {r.method: r.overlap for r in E.overlap(df).collect()}
    assert o == {"m": 0.25, "only": 1.0}
    s = {(r.method, r.target): (r.cut, r.recall) for r in E.separation(df).collect()}
    assert s["m", 1.0] == (0.5, 0.75) and s["only", 0.99] == (0.0, 0.0)
    assert s["m", 0.99][0] == pytest.approx(np.quantile(fake, 0.99))
    assert E.at_hash_threshold(df).count() == 0
    h = spark.createDataFrame([("h", "real", -3.0), ("h", "real", -9.0), ("h", "fake", -5.0), ("h", "fake", -20.0)],
                              "method string, kind string, score double")
    r = E.at_hash_threshold(h).first()
    assert (r.recall, r.leak) == (0.5, 0.5)


def test_sample_split(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = E.sample_split(df, "k", 5, 60, 30, 20).collect()
    parts = {p: {r.k for r in got if r.part == p} for p in ("gallery", "held_out")}
    assert len(parts["gallery"]) == 60 and len(parts["held_out"]) == 30
    probes = {r.k for r in got if r.is_probe}
    assert len(probes) == 20 and probes <= parts["gallery"] and not parts["gallery"] & parts["held_out"]
    again = E.sample_split(df.repartition(7), "k", 5, 60, 30, 20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_index_bytes(spark):
    for sizes, ram, disk in (((768,), 334, 104), ((512,), 302, 72), ((768, 512), 636, 176), ((0, -1), 0, 0)):
        m = spark.createDataFrame([(s,) for s in sizes], "vector_size int")
        r = m.agg(C.ram_per_image("graph").alias("g"), C.ram_per_image("flat").alias("f"),
                  C.disk_per_image().alias("d")).first()
        assert (r.g, r.f, r.d) == (ram, 0, disk)


def test_capacity_is_never_negative(spark):
    df = spark.createDataFrame([(0,), (160 << 20,), ((160 << 20) + 334,), (8 << 30,)], "b long")
    got = [r[0] for r in df.select(C.image_capacity(F.col("b"), F.lit(334))).collect()]
    assert got == [0, 0, 0, int(((8 << 30) - (160 << 20)) * 0.8 / 334)]


def test_size_profile_takes_the_upper_median(spark):
    df = spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "n long")
    r = C.size_profile(df, "n").first()
    assert (r.n, r.mean, r.median, r.min, r.max, r.bytes_at_10m) == (4, 2.5, 3.0, 1, 4, 2.5e7)
