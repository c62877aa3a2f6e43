"""End-to-end jobs: ingest, rebuild, re-embed, catalog files, streams."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from imgtrace import schema as S
from imgtrace.operators import setdiff as X
from imgtrace.plans import jobs as J
from imgtrace.registry import streams as R
from imgtrace.session import scratch_path
from imgtrace.sources import catalog as C
from imgtrace.sources import feed as A
from imgtrace.streaming import feed as SF
from imgtrace.streaming import fleet as SL

NOW = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def models(spark):
    return spark.createDataFrame([("a", "copy", 8, "cosine", 224, True), ("b", "semantic", 8, "cosine", 224, True)],
                                 S.MODELS)


def batch(spark, n, size=8, models=("a", "b")):
    ids = spark.range(1, n + 1).select(F.lit("s").alias("source_site"), F.col("id").alias("source_post_id"))
    items = ids.select("*", F.lit("ff").alias("phash"), F.lit(0).alias("arrival"))
    vec = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i - F.col("source_post_id")).cast("float"))
    v = ids.select("*", F.explode(F.array(*map(F.lit, models))).alias("model_id")).select(
        "source_site", "source_post_id", "model_id", vec.alias("vector"), F.lit(0).alias("arrival"))
    return items, v


def empty(spark):
    img = spark.createDataFrame([], "image_id long, source_site string, source_post_id long, phash string, "
                                "created_at timestamp, updated_at timestamp")
    return img, spark.createDataFrame([], S.IMAGE_VECTORS), spark.createDataFrame([], S.CODES)


def counts(df):
    return {r.model_id: r["count"] for r in df.groupBy("model_id").count().collect()}


def test_ingest_then_replay_then_rebuild(spark, models):
    items, v = batch(spark, 20)
    out = J.ingest_batch(items, v, *empty(spark), models, NOW)
    assert out["images"].count() == 20 and {r.image_id for r in out["images"].collect()} == set(range(1, 21))
    assert counts(out["image_vectors"]) == counts(out["codes"]) == {"a": 20, "b": 20}
    assert out["image_vectors"].where("indexed_at IS NULL").count() == 0
    again = J.ingest_batch(items, v, out["images"], out["image_vectors"], out["codes"], models, NOW)
    assert sorted(r.image_id for r in again["images"].collect()) == list(range(1, 21))
    assert counts(again["codes"]) == {"a": 20, "b": 20}
    pend = out["image_vectors"].where("image_id <= 12").withColumn("indexed_at", F.lit(None).cast("timestamp"))
    images = out["images"].select("*", *[F.lit("").alias(c) for c in ("canonical_url", "rating", "dhash")])
    re = J.rebuild_index(images, pend, spark.createDataFrame([], S.CODES), models, NOW)
    assert re["report"].first().rebuilt == 24 and counts(re["codes"]) == {"a": 12, "b": 12}
    assert J.pending_vectors(re["image_vectors"], "a").count() == 0


@pytest.mark.parametrize("kw", [{"size": 7}, {"models": ("a",)}, {"models": ("a", "b", "x")}])
def test_one_bad_item_refuses_the_batch(spark, models, kw):
    items, v = batch(spark, 3, **kw)
    with pytest.raises(J.BatchRefused):
        J.ingest_batch(items, v, *empty(spark), models, NOW)


def test_quota_refuses_the_whole_batch(spark, models):
    items, v = batch(spark, 5)
    with pytest.raises(J.IndexFull):
        J.ingest_batch(items, v, *empty(spark), models, NOW, max_indexed=4)
    assert J.ingest_batch(items, v, *empty(spark), models, NOW, max_indexed=5)["images"].count() == 5
    assert J.quota_allows(lambda: 10**9, 1, 0)
    assert J.quota_allows(lambda: 1 // 0, 1, 1)
    assert not J.quota_allows(lambda: 1, 1, 1)


def test_reembed_outcomes_and_resume(spark):
    images = spark.createDataFrame([(i, "t") for i in range(1, 6)] + [(6, "")], "image_id long, thumb_path string")
    _, vectors, codes = empty(spark)
    files = images.where("image_id <> 2")
    encoded = spark.createDataFrame([(1, [1.0, 2.0]), (3, [1.0]), (4, [float("nan"), 1.0])],
                                    "image_id long, vector array<float>")
    model = {"model_id": "m", "vector_size": 2}
    out = J.reembed(images, vectors, codes, model, encoded, files, NOW)
    got = {r.image_id: r.outcome for r in out["outcomes"].collect()}
    assert got == {1: "ok", 2: "missing", 3: "failed", 4: "failed", 5: "failed"}
    nxt = J.reembed(images, out["image_vectors"], out["codes"], model, encoded, files, NOW)
    assert {r.image_id for r in nxt["outcomes"].collect()} == {2, 3, 4, 5}


def test_catalog_checks_collections(spark, models):
    items, v = batch(spark, 4)
    out = J.ingest_batch(items, v, *empty(spark), models, NOW)
    path = scratch_path(spark, "catalog")
    C.write_catalog(out["images"], out["image_vectors"], path)
    t = C.open_catalog(spark, path, models)
    assert counts(t["codes"]) == {"a": 4, "b": 4}
    with pytest.raises(C.CollectionMismatch):
        C.open_catalog(spark, path, models.withColumn("vector_size", F.lit(9)))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        C.write_catalog(out["images"], out["image_vectors"], path)
    plan = t["codes"].where("model_id = 'a' AND image_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_id" in plan and "PushedFilters: [IsNotNull(image_id), EqualTo(image_id,3)]" in plan


def test_posts_paging(spark):
    p = spark.range(1, 501).select(F.col("id").alias("post_id"), F.array(F.lit("x")).alias("tags"))
    assert [r.post_id for r in A.posts_in_range(p, 5, 7).collect()] == [7, 6, 5]
    assert A.posts_in_range(p, 5, 7, ["y"]).count() == 0
    with pytest.raises(ValueError):
        A.posts_in_range(p, 7, 5)
    assert A.posts_after(p, 100, 9999).count() == 200 and A.posts_after(p, 498, 10).count() == 2
    assert A.latest_post_id(p).first().latest_id == 500
    assert A.latest_post_id(p.limit(0)).first().latest_id == 0


def _feed(spark, ids, path):
    base = spark.createDataFrame([], S.FEED_POST)
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select(
        "id", F.md5(F.col("id").cast("string")).alias("md5"),
        F.concat(F.lit("https://x/"), F.col("id").cast("string"), F.lit(".png")).alias("file_url"),
        F.lit(0).alias("score"))
    base.unionByName(rows, allowMissingColumns=True).coalesce(1).write.mode("append").json(path)


def test_feed_stream_over_several_batches(spark, sf):
    feed, path = scratch_path(spark, "feed"), scratch_path(spark, "catalog")
    check = scratch_path(spark, "checkpoint")
    sink = R._sink(spark, path)
    _feed(spark, range(1, 11), feed)
    sink.run(SF.read_feed_stream(spark, feed), check)
    time.sleep(0.01)
    _feed(spark, range(6, 16), feed)
    sink.run(SF.read_feed_stream(spark, feed), check)
    rep = sink.report().first()
    assert (rep.total, rep.saved, rep.existing) == (20, 15, 5)
    ids = [r.image_id for r in sink.table("images").collect()]
    assert sorted(ids) == list(range(1, 16))
    assert sink.current("images", ["source_site", "source_post_id"]).count() == 15
    assert sink.high_watermark().first().high_watermark_id == 15
    # The same batch once more, as after a lost driver: nothing changes.
    again = spark.read.schema(S.FEED_POST).json(feed).where("id > 5").dropDuplicates(["id"])
    sink(again, 1)
    assert sorted(r.image_id for r in sink.table("images").collect()) == list(range(1, 16))


def _state(sink):
    keys = {"images": ["source_site", "source_post_id"], "image_vectors": ["image_id", "model_id"], "codes": ["image_id", "model_id"]}
    return {t: sorted(map(repr, map(tuple, sink.current(t, k).collect()))) for t, k in keys.items()}


def test_compaction_keeps_answers_and_replays(spark, monkeypatch):
    feed, path, check = (scratch_path(spark, x) for x in ("feed", "catalog", "checkpoint"))
    sink = R._sink(spark, path)
    for low in (1, 6, 11):
        _feed(spark, range(low, low + 10), feed)
        sink.run(SF.read_feed_stream(spark, feed), check)
        time.sleep(0.01)
    before = _state(sink)
    with monkeypatch.context() as m:  # a compaction that dies changes nothing
        m.setattr(SF.M, "latest_per_key", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sink.compact()
    assert sink.version == 0 and _state(R._sink(spark, path)) == before
    assert sink.compact() == 1 and R._sink(spark, path).version == 1
    assert _state(sink) == before and sink.high_watermark().first().high_watermark_id == 20
    logged = {r["batch"] for r in spark.read.parquet(f"{path}/log-1/images").select("batch").distinct().collect()}
    assert logged == {2} and sink.report().first().total == 30
    plan = sink.table("image_vectors", ids=(3, 9))._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in x and "id_bucket" in x for x in plan.split("\n"))
    # the last batch once more, as after a lost driver, and then new posts and a second compaction
    again = spark.read.schema(S.FEED_POST).json(feed).where("id > 10").dropDuplicates(["id"])
    sink(again, 2)
    assert _state(sink) == before and sink.report().first().total == 30
    _feed(spark, range(18, 31), feed)
    sink.run(SF.read_feed_stream(spark, feed), check)
    rep = sink.report().first()
    assert (rep.total, rep.saved, rep.existing) == (43, 30, 13)
    assert sorted(r.image_id for r in sink.table("images").collect()) == list(range(1, 31))
    after = _state(sink)
    assert sink.compact() == 2 and _state(sink) == after and sink._last(99)[0] == 30


def test_repeats_in_flight_are_dropped(spark):
    feed, path = scratch_path(spark, "feed"), scratch_path(spark, "catalog")
    for ids in (range(1, 6), range(1, 6), range(4, 8)):
        _feed(spark, ids, feed)
    sink = R._sink(spark, path)
    sink.run(SF.without_repeats(SF.read_feed_stream(spark, feed)), scratch_path(spark, "checkpoint"))
    rep = sink.report().first()
    assert (rep.total, rep.saved, rep.existing) == (7, 7, 0)


def test_refused_batch_moves_no_watermark(spark):
    feed, path = scratch_path(spark, "feed"), scratch_path(spark, "catalog")
    _feed(spark, range(1, 11), feed)
    sink = R._sink(spark, path, max_indexed=9)
    check = scratch_path(spark, "checkpoint")
    sink.run(SF.read_feed_stream(spark, feed), check)
    assert sink.refused == [0] and sink.table("images").count() == 0 and sink.high_watermark().count() == 0
    later = R._sink(spark, path)
    later.run(SF.read_feed_stream(spark, feed), check)
    assert later.refused == [] and later.table("images").count() == 10


def _beats(spark, path, rows):
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(n, t0 + dt.timedelta(seconds=s)) for n, s in rows],
                          "node_id string, heartbeat_at timestamp").coalesce(1).write.mode("append").parquet(path)


def test_liveness_across_batches(spark):
    path = scratch_path(spark, "beats")
    _beats(spark, path, [("a", 0), ("b", 0), ("a", 60), ("a", 30)])
    time.sleep(1.1)
    _beats(spark, path, [("a", 120), ("b", 300), ("a", 150)])
    stream = spark.readStream.schema("node_id string, heartbeat_at timestamp").option(
        "maxFilesPerTrigger", 1).parquet(path)
    out = R._drain(SL.liveness_stream(stream, 90), "live")
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    got = sorted((r.node_id, (r.at_us - base) // 1_000_000, r.status) for r in out.collect())
    assert got == [("a", 0, "online"), ("a", 240, "offline"), ("b", 0, "online"), ("b", 90, "offline"),
                   ("b", 300, "online")]


def test_batches_are_reported_by_the_jobs_that_write_them(spark, sf):
    """Rows as the stored statuses give them, a run's ids go on without a look at the log, and a batch of known posts takes fewer jobs."""
    feed, path = scratch_path(spark, "feed"), scratch_path(spark, "catalog")
    sink = R._sink(spark, path)
    for ids in (range(1, 11), range(6, 16), range(1, 16)):
        _feed(spark, ids, feed)
        time.sleep(0.01)
    with R._state_sized(spark):
        sink.run(SF.read_feed_stream(spark, feed), scratch_path(spark, "checkpoint"))
    want = {r.batch: r.asDict() for r in sink.table("statuses").groupBy("batch").agg(*X.status_counts()).collect()}
    assert {r["batch"]: {k: v for k, v in r.items() if k != "run"} for r in sink.reports} == want and len(want) == 3
    assert sorted(r.image_id for r in sink.table("images").collect()) == list(range(1, 16)) and sink.stored is None
    assert sink.table("states").agg(F.max("seq"), F.max("last_image_id")).first()[:] == (3, 15)
    known = spark.read.schema(S.FEED_POST).json(feed)

    def jobs(feed, batch):
        spark.sparkContext.setJobGroup(f"batch {batch}", "counted")
        sink(feed, batch)
        spark.sparkContext.setJobGroup("others", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch {batch}"))

    fresh = scratch_path(spark, "feed")
    _feed(spark, range(16, 31), fresh)
    some, none = jobs(spark.read.schema(S.FEED_POST).json(fresh), 3), jobs(known, 4)
    print("jobs", some, none)
    assert none + 4 <= some and sink.reports[-1]["existing"] == 15 and sink.reports[-2]["saved"] == 15
    # A batch without any post writes empty parts.
    sink(known.where("id < 0"), 5)
    assert sink.reports[-1]["total"] == 0 and sink.table("images").count() == 15 + 15
