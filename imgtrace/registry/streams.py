"""Streaming jobs, each run to the end of its input over a benchmark table."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace.operators import fleet as L
from imgtrace.registry.base import query, r6, ts_text
from imgtrace.registry.derived_sql import ts_text as sql_ts
from imgtrace.registry.derived_sql import with_
from imgtrace.registry.sources import BASE_URL
from imgtrace.session import scratch_path
from imgtrace.sources import derived as D
from imgtrace.streaming import coverage as SC
from imgtrace.streaming import feed as SF
from imgtrace.streaming import fleet as SL


@contextmanager
def _state_sized(spark):
    """Micro-batches are small and state partitions stay fixed: let both follow the cores."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# --- feed -----------------------------------------------------------------

def encode_posts(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Encoder stand-in: vectors and hashes from the digest of the post's file.

    Posts with score 13 give a broken vector.
    """
    nibble = F.transform(
        F.sequence(F.lit(1), F.lit(32)),
        lambda i: (F.conv(F.substr("md5", i, F.lit(1)), 16, 10).cast("int") - 7.5).cast("float"))
    broken = F.transform("v", lambda x, i: F.when(
        (i == 0) & (F.col("score") == 13), F.lit(float("nan")).cast("float")).otherwise(x))
    v = posts.select("post_id", "score", nibble.alias("v"))
    rows = F.array(
        F.struct(F.lit("copy64").alias("model_id"), F.concat("v", F.reverse("v")).alias("vector")),
        F.struct(F.lit("sem32").alias("model_id"), broken.alias("vector")))
    marks = posts.select("post_id", F.substring("md5", 1, 16).alias("phash"),
                         F.substring("md5", 17, 16).alias("dhash"), F.lit("").alias("thumb_path"))
    return marks, v.withColumn("r", F.explode(rows)).select("post_id", "r.model_id", "r.vector")


def _feed_files(spark, sf, n_files: int) -> str:
    path = scratch_path(spark, "feed")
    D.feed(spark, sf).repartition(n_files, "id").write.json(path)
    return path


def _sink(spark, path, **options) -> SF.FeedSink:
    return SF.FeedSink(spark, path, D.models(spark), encode_posts, "2024-02-01 00:00:00", BASE_URL,
                       D.SITE, **options)


def _run(spark, feed_path, path, checkpoint=None, **options) -> SF.FeedSink:
    sink = _sink(spark, path, **options)
    with _state_sized(spark):
        sink.run(SF.read_feed_stream(spark, feed_path), checkpoint or scratch_path(spark, "checkpoint"))
    return sink


_STATUS = """CASE WHEN skip_reason <> '' THEN 'skipped' WHEN score = 13 THEN 'failed' ELSE {} END"""


@query("h1_catchup_stream", with_("checked_posts") + f"""
SELECT id AS post_id, {_STATUS.format("'saved'")} AS status,
  CASE WHEN skip_reason = '' AND score <> 13 THEN substr(md5, 1, 16) ELSE '' END AS phash,
  CASE WHEN skip_reason = '' AND score <> 13 THEN 2 ELSE 0 END::BIGINT AS vectors FROM checked_posts""")
def catchup(spark, sf):
    sink = _run(spark, _feed_files(spark, sf, 2), scratch_path(spark, "catalog"))
    images = sink.table("images").select(
        "image_id", F.col("source_post_id").alias("post_id"), "phash")
    n = sink.table("image_vectors").where(F.col("indexed_at").isNotNull()).groupBy("image_id").agg(
        F.count("*").alias("n"))
    return sink.table("statuses").join(images.join(n, "image_id", "left"), "post_id", "left").select(
        "post_id", "status", F.coalesce("phash", F.lit("")).alias("phash"),
        F.coalesce("n", F.lit(0)).alias("vectors"))


@query("h2_watermark_tracker", with_("checked_posts") + """
SELECT 'site0' AS source_site, 'default' AS scope_key, max(id) AS high_watermark_id FROM checked_posts""")
def watermark(spark, sf):
    return _run(spark, _feed_files(spark, sf, 1), scratch_path(spark, "catalog")).high_watermark()


@query("h5_idempotent_ingest", with_("checked_posts") + f"""
SELECT st AS status, count(*) AS posts, (SELECT count(*) FROM checked_posts WHERE skip_reason = '' AND score <> 13) AS images
FROM (SELECT {_STATUS.format("'existing'")} AS st FROM checked_posts) GROUP BY 1""")
def idempotent(spark, sf):
    """The whole feed again: everything good is already there, nothing is added."""
    feed_path, path = _feed_files(spark, sf, 1), scratch_path(spark, "catalog")
    _run(spark, feed_path, path)
    sink = _run(spark, feed_path, path)
    images = sink.table("images").select(F.count("*")).scalar()
    return sink.table("statuses").where(F.col("run") == sink.run_id).groupBy("status").agg(
        F.count("*").alias("posts")).withColumn("images", images)


_SAVED = "count(*) FILTER (skip_reason = '' AND score <> 13)"


@query("d14_reports_of_batches", with_("checked_posts") + f"""
SELECT 2::BIGINT AS batches, 2 * count(*) AS total, 2 * count(*) FILTER (skip_reason <> '') AS skipped, {_SAVED} AS existing,
  {_SAVED} AS saved, 2 * count(*) FILTER (skip_reason = '' AND score = 13) AS failed FROM checked_posts""")
def reports_of_batches(spark, sf):
    """What the jobs that wrote them observed of the batches, of the feed and of the whole feed again."""
    feed_path, path = _feed_files(spark, sf, 1), scratch_path(spark, "catalog")
    rows = [r for _ in range(2) for r in _run(spark, feed_path, path).reports]
    made = spark.createDataFrame(rows, "run string, batch long, total long, skipped long, existing long, saved long, failed long")
    return made.agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in ("total", "skipped", "existing", "saved", "failed")])


@query("h6_quota_guard", with_("checked_posts") + """
SELECT CASE WHEN count(*) > 100 THEN 0 ELSE count(*) END AS images, CASE WHEN count(*) > 100 THEN 0 ELSE 1 END AS marks
FROM checked_posts WHERE skip_reason = ''""")
def quota(spark, sf):
    """A batch that would overflow the limit is refused whole and moves no watermark."""
    sink = _run(spark, _feed_files(spark, sf, 1), scratch_path(spark, "catalog"), max_indexed=100)
    marks = sink.table("states").select(F.count("*").cast("int")).scalar()
    return sink.table("images").agg(F.count("*").alias("images")).withColumn("marks", marks)


@query("h6_refused_then_accepted", with_("checked_posts") + f"""
SELECT {_SAVED} AS images, count(*) AS statuses, max(id) AS high_watermark_id FROM checked_posts""")
def refused_then_accepted(spark, sf):
    """A refused batch is read again, and stored, once the limit is lifted."""
    feed_path, path, check = _feed_files(spark, sf, 1), scratch_path(spark, "catalog"), scratch_path(spark, "checkpoint")
    _run(spark, feed_path, path, check, max_indexed=1)
    sink = _run(spark, feed_path, path, check)
    return sink.table("images").agg(F.count("*").alias("images")).withColumn(
        "statuses", sink.table("statuses").select(F.count("*")).scalar()).withColumn(
        "high_watermark_id", sink.high_watermark().select("high_watermark_id").scalar())


@query("h5_new_checkpoint", with_("checked_posts") + f"""
SELECT {_SAVED} AS images, count(DISTINCT id) AS posts FROM checked_posts""")
def new_checkpoint(spark, sf):
    """Two feeds under checkpoints of their own: the second leaves the first one's batches alone."""
    path, posts = scratch_path(spark, "catalog"), D.feed(spark, sf)
    for part in (0, 1):
        feed_path = scratch_path(spark, "feed")
        posts.where(F.pmod("id", F.lit(2)) == part).repartition(2, "id").write.json(feed_path)
        sink = _run(spark, feed_path, path)
    return sink.table("images").agg(F.count("*").alias("images")).withColumn(
        "posts", sink.table("statuses").select(F.count_distinct("post_id")).scalar())


@query("h5_after_compaction", with_("checked_posts") + f"""
SELECT st AS status, count(*) AS posts, (SELECT count(*) FROM checked_posts WHERE skip_reason = '' AND score <> 13) AS images,
  (SELECT count(*) FROM checked_posts) AS first_run
FROM (SELECT {_STATUS.format("'existing'")} AS st FROM checked_posts) GROUP BY 1""")
def after_compaction(spark, sf):
    """The feed, a compaction, the feed again: all that is good is found in buckets and tail, and nothing is added."""
    feed_path, path = _feed_files(spark, sf, 2), scratch_path(spark, "catalog")
    first = _run(spark, feed_path, path)
    first.compact()
    sink = _run(spark, feed_path, path)
    images = sink.table("images").select(F.count("*")).scalar()
    seen = sink.table("statuses").where(F.col("run") == first.run_id).select(F.count("*")).scalar()
    return sink.table("statuses").where(F.col("run") == sink.run_id).groupBy("status").agg(
        F.count("*").alias("posts")).withColumns({"images": images, "first_run": seen})


@query("h5_in_flight_repeats", with_("checked_posts") + f"""
SELECT id AS post_id, {_STATUS.format("'saved'")} AS status, 1::BIGINT AS times FROM checked_posts""")
def in_flight(spark, sf):
    """Every post comes in three files; the stream lets the first one through."""
    feed_path, path = scratch_path(spark, "feed"), scratch_path(spark, "catalog")
    for _ in range(3):
        D.feed(spark, sf).repartition(1, "id").write.mode("append").json(feed_path)
    sink = _sink(spark, path)
    with _state_sized(spark):
        sink.run(SF.without_repeats(SF.read_feed_stream(spark, feed_path)), scratch_path(spark, "checkpoint"))
    return sink.table("statuses").groupBy("post_id").agg(
        F.min("status").alias("status"), F.count("*").alias("times")).select("post_id", "status", "times")


@query("h2_failures_are_queued", with_("checked_posts") + """
SELECT 'site0' AS source_site, 'default' AS scope_key, id AS source_post_id, 'pending' AS status, 0 AS attempts
FROM checked_posts WHERE skip_reason = '' AND score = 13""")
def failures_are_queued(spark, sf):
    sink = _run(spark, _feed_files(spark, sf, 1), scratch_path(spark, "catalog"))
    none = D.crawl_post_retries(spark, sf).limit(0)
    return sink.queue_failures(none).select("source_site", "scope_key", "source_post_id", "status", "attempts")


# --- coverage -------------------------------------------------------------

@query("e1_coverage_stream", with_("crawl_ranges", two=D.TWO_SCOPES_SQL) + """
SELECT scope_key, reached + 1 AS gap_from, lower_id - 1 AS gap_to, lower_id - reached - 1 AS gap_size FROM (
  SELECT *, max(upper_id) OVER (PARTITION BY source_site, scope_key ORDER BY lower_id, upper_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM two) WHERE lower_id > reached + 1""")
def coverage(spark, sf):
    """Ranges come in three files; gaps are read from the merged intervals that the stream keeps."""
    path = scratch_path(spark, "ranges")
    D.two_scopes(spark, sf).repartition(3, "id").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    changes = _drain(SC.coverage_stream(stream, 1 << 14), "coverage", "update")
    return SC.open_gaps(changes).select("scope_key", "gap_from", "gap_to", "gap_size")


# --- fleet ----------------------------------------------------------------

def _events(spark, sf) -> DataFrame:
    schema = D.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _node():
    return F.concat(F.lit("node"), (F.col("user_id") % 10).cast("string")).alias("node_id")


def _finish(writer) -> None:
    """Start, process everything available, stop."""
    writer = writer.trigger(availableNow=True)
    with _state_sized(SparkSession.getActiveSession()):
        query = writer.start()
    query.awaitTermination()


def _drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Stream -> table, once everything available is processed. A batch that comes again writes over its own part."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if mode == "append":
        writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    else:
        writer = df.writeStream.outputMode(mode).foreachBatch(
            lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
    _finish(writer.option("checkpointLocation", scratch_path(spark, "checkpoint")))
    return spark.read.schema(df.schema).parquet(path)


_GROWTH = """max(downloaded) - min(downloaded) AS downloaded, max(saved) - min(saved) AS saved,
  round(coalesce((max(saved) - min(saved)) / nullif((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 1e6, 0), 0), 6)
    AS per_second"""


@query("h3_throughput_stream", with_("node_metrics") + f"""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, observed_at), '%Y-%m-%d %H:%M:%S') AS window_start, node_id, {_GROWTH}
FROM node_metrics GROUP BY 1, 2, time_bucket(INTERVAL 1 HOUR, observed_at)
HAVING time_bucket(INTERVAL 1 HOUR, observed_at) + INTERVAL 1 HOUR
  <= (SELECT max(observed_at) FROM node_metrics) - INTERVAL 1 MINUTE""")
def throughput(spark, sf):
    e, n = _events(spark, sf), F.col("event_id")
    metrics = e.select(
        _node(), F.col("ts").cast("timestamp").alias("observed_at"), F.col("value").alias("cpu_pct"),
        F.col("value").alias("mem_mb"), (n * 3).alias("downloaded"), (n * 2).alias("embedded"),
        (n * 2 - F.floor(n / 50)).cast("bigint").alias("saved"), F.floor(n / 50).cast("bigint").alias("failed"))
    out = _drain(SL.throughput_windows(metrics, "1 hour"), "throughput")
    return out.select(ts_text("window_start").alias("window_start"), "node_id", "downloaded", "saved",
                      r6("per_second").alias("per_second"))


@query("h3_throughput_batch", with_("node_metrics") + f"""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, observed_at), '%Y-%m-%d %H:%M:%S') AS window_start, node_id, {_GROWTH}
FROM node_metrics GROUP BY 1, 2""")
def throughput_batch(spark, sf):
    """Batch twin of the stream: the open last windows are there too."""
    return SL.throughput_windows(D.node_metrics(spark, sf), "1 hour").select(
        ts_text("window_start").alias("window_start"), "node_id", "downloaded", "saved",
        r6("per_second").alias("per_second"))


@query("h4_liveness_stream", """
WITH beats AS (SELECT 'node' || (user_id % 10) AS node_id, epoch_us(ts) AS us FROM events),
seq AS (SELECT *, lag(us) OVER w AS prev, lead(us) OVER w AS next FROM beats WINDOW w AS (PARTITION BY node_id ORDER BY us))
SELECT node_id, us AS at_us, 'online' AS status FROM seq WHERE prev IS NULL OR us - prev > 14400000000
UNION ALL
SELECT node_id, us + 14400000000, 'offline' FROM seq
WHERE coalesce(next, (SELECT max(us) - 30000000 FROM beats)) - us > 14400000000""")
def liveness(spark, sf):
    beats = _events(spark, sf).select(_node(), F.col("ts").cast("timestamp").alias("heartbeat_at"))
    return _drain(SL.liveness_stream(beats, timeout_seconds=4 * 3600), "liveness")


@query("h7_prune_metrics", with_("node_metrics") + f"""
SELECT node_id, {sql_ts('observed_at')} AS observed_at, saved FROM node_metrics
WHERE observed_at >= TIMESTAMP '{D.EVENTS_NOW}' - INTERVAL 24 HOUR""")
def prune(spark, sf):
    return L.prune_metrics(D.node_metrics(spark, sf), D.EVENTS_NOW).select(
        "node_id", ts_text("observed_at").alias("observed_at"), "saved")
