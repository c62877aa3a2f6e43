"""Feed -> catalog as a stream.

Each micro-batch appends to tables partitioned by run and batch; a run is a stream
checkpoint, so a new checkpoint on an old catalog overwrites nothing. A replayed batch
overwrites its own partition only, and looks at other runs and its own earlier batches
only, so replays after a lost executor or driver change nothing. `seq` counts batches over
all runs: of several rows of a key the one with the largest `seq` is current.

`compact` begins a new version of the log: what no replay can touch any more goes, a row per key, to id buckets
(`base-v`), the rest (the last batch of each run) to the new log (`log-v`). Readers take buckets and tail;
folders of older versions are never listed again and can be removed at leisure.

What a batch did is observed by the jobs that write it (`reports`, the largest id given out), not counted by jobs of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imgtrace import schema as S
from imgtrace.functions import vectors as V
from imgtrace.operators import merge as M
from imgtrace.operators import setdiff as D
from imgtrace.plans import jobs as J
from imgtrace.session import broadcast_if_small
from imgtrace.sources import feed as feed_source
from imgtrace.sources.buckets import SPAN, bucket_of

_LOG_SCHEMAS = {
    "images": S.IMAGES,
    "image_vectors": S.IMAGE_VECTORS,
    "codes": S.CODES,
    "statuses": T.StructType([
        T.StructField("source_site", T.StringType()), T.StructField("post_id", T.LongType()),
        T.StructField("status", T.StringType())]),
    "states": T.StructType([
        T.StructField("source_site", T.StringType()), T.StructField("scope_key", T.StringType()),
        T.StructField("high_watermark_id", T.LongType()),
        T.StructField("last_image_id", T.LongType())]),
}

# What a row of a compacted table is known by; tables without a key keep all rows.
_KEYS = {"images": M.IMAGE_KEY, "image_vectors": ["image_id", "model_id"], "codes": ["image_id", "model_id"]}

# An encoder step: normalised posts to do -> (post_id, phash, dhash, thumb_path) and
# (post_id, model_id, vector).
Encode = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class IndexFull(RuntimeError):
    """A batch doesn't fit the catalog; nothing of it is committed, and it comes again."""


@dataclass
class FeedSink:
    """foreachBatch target. Call `run` on a stream of feed posts.

    `reports` has a row per batch of this object: its number and how many posts had each status. One writer at a time.
    """

    spark: SparkSession
    path: str
    models: DataFrame
    encode: Encode
    now: str
    base_url: str
    site: str
    scope: str = "default"
    max_indexed: int = 0
    run_id: str = "direct"
    refused: list[int] = field(default_factory=list)
    reports: list[dict] = field(default_factory=list)
    running: bool = False
    # (batch, largest id, seq) after the last batch stored in the run under way.
    stored: tuple | None = None

    def __post_init__(self):
        self.active = D.active_models(self.models)
        self.version = 0
        self.refresh()

    def refresh(self) -> None:
        """Look for a newer version of the log."""
        made = self._read("versions", T.StructType([T.StructField("version", T.LongType())]))
        self.version = made.agg(F.max("version")).first()[0] or 0

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _log(self) -> str:
        return f"log-{self.version}"

    def table(self, name: str, before: int | None = None, ids: tuple | None = None) -> DataFrame:
        """All rows, or those of other runs and earlier batches of this one; empty before the first batch.

        With `ids` (lowest and highest image id) only the buckets of these are read of what is compacted.
        """
        logged = T.StructType([
            *_LOG_SCHEMAS[name].fields, T.StructField("seq", T.LongType()),
            T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
        df = self._read(f"{self._log()}/{name}", logged)
        if self.version:
            bucketed = T.StructType([*logged.fields, *([T.StructField("id_bucket", T.LongType())] if name in _KEYS else [])])
            base = self._read(f"base-{self.version}/{name}", bucketed)
            if ids is not None and name in _KEYS:
                low, high = (bucket_of(F.lit(i).cast("bigint"), SPAN) for i in ids)
                base = base.where(F.col("id_bucket").between(low, high))
            df = df.unionByName(base.select(*logged.names))
        return df if before is None else df.where((F.col("run") != self.run_id) | (F.col("batch") < before))

    def compact(self) -> int:
        """Begin a new version of the log; returns its number. Not while a run is under way.

        A run's last batch may come again and has to find what was there before it, so it stays in the log. A
        compaction that died leaves the old version in force and is written over by the next.
        """
        self.refresh()
        ends = self.table("states").groupBy("run").agg(F.max("batch").alias("_end"))
        ends = broadcast_if_small(ends)
        new = self.version + 1
        for name in _LOG_SCHEMAS:
            rows = self.table(name).join(ends, "run", "left")
            may_come_again = F.col("batch") >= F.coalesce("_end", F.lit(-1))
            tail, old = rows.where(may_come_again).drop("_end"), rows.where(~may_come_again).drop("_end")
            tail.repartition("run", "batch").write.mode("overwrite").partitionBy("run", "batch").parquet(f"{self.path}/log-{new}/{name}")
            folder = f"{self.path}/base-{new}/{name}"
            if name in _KEYS:
                old = M.latest_per_key(old.withColumn("_at", F.col("seq")), _KEYS[name], "_at")
                old = old.withColumn("id_bucket", bucket_of("image_id", SPAN)).repartition("id_bucket")
                old.sortWithinPartitions("id_bucket", "image_id").write.mode("overwrite").partitionBy("id_bucket").parquet(folder)
            else:
                old.write.mode("overwrite").parquet(folder)
        self.spark.range(1).select(F.lit(new).cast("bigint").alias("version")).write.mode("append").parquet(f"{self.path}/versions")
        self.refresh()
        return self.version

    def _last(self, before: int) -> tuple[int, int]:
        """(largest image id given out so far, largest seq). Ids have no gaps, so the first is also the count.

        Read from the log, unless the batch before was stored in the run under way.
        """
        if self.stored and self.stored[0] == before - 1:
            return self.stored[1:]
        last = self.table("states", before).agg(F.max("last_image_id"), F.max("seq")).first()
        return last[0] or 0, last[1] or 0

    def current(self, name: str, keys: list[str]) -> DataFrame:
        """Latest row per key."""
        return M.latest_per_key(self.table(name).drop("run", "batch"), keys, "seq")

    def _part(self, name: str, batch: int) -> str:
        return f"{self.path}/{self._log()}/{name}/run={self.run_id}/batch={batch}"

    def _append(self, name: str, batch: int, seq: int, df: DataFrame, *metrics) -> dict:
        """Write a table's part; returns `metrics` of its rows.

        They are taken in the writing stage itself, where a task that is run again counts once.
        """
        cols = [f.name for f in _LOG_SCHEMAS[name].fields]
        rows = df.select(*cols, F.lit(seq).cast("bigint").alias("seq"))
        seen = Observation() if metrics else None
        if seen:
            rows = rows.observe(seen, *metrics)
        rows.write.mode("overwrite").parquet(self._part(name, batch))
        return seen.get if seen else {}

    def _append_none(self, name: str, batch: int, seq: int) -> None:
        """An empty part: it replaces what an earlier try of the batch may have left."""
        self._append(name, batch, seq, self.spark.createDataFrame([], _LOG_SCHEMAS[name]))

    def __call__(self, feed: DataFrame, batch: int) -> None:
        found = feed_source.with_download(feed_source.normalize_posts(feed, self.base_url, self.site))
        posts = M.latest_per_key(found.withColumn("_same", F.lit(0)), ["post_id"], "_same").select(*found.columns)
        posts = posts.persist()
        try:
            self._ingest(posts, batch)
        finally:
            posts.unpersist()

    def _ingest(self, posts: DataFrame, batch: int) -> None:
        ids = [m["model_id"] for m in self.active]
        keys = posts.select("source_site", F.col("post_id").alias("source_post_id"))
        # Catalog rows of this batch's posts only: the id bounds let parquet
        # statistics skip the row groups of other parts of the feed.
        low, high = keys.agg(F.min("source_post_id"), F.max("source_post_id")).first()
        seen = self.table("images", batch).where(F.col("source_post_id").between(low, high)).select(
            "image_id", *M.IMAGE_KEY, "phash", "dhash", "thumb_path", "created_at", "updated_at", "seq")
        old = M.latest_per_key(
            seen.join(broadcast_if_small(keys), M.IMAGE_KEY, "left_semi"), M.IMAGE_KEY, "seq").persist()
        low, high = old.agg(F.min("image_id"), F.max("image_id")).first()
        near = None if low is None else (low, high)
        have = self.table("image_vectors", batch, near).where(F.col("image_id").between(low, high)).select(
            "image_id", "model_id").join(old.select("image_id"), "image_id", "left_semi")
        done = D.fully_indexed(old, have, ids)
        todo = D.work_delta(posts, done).persist()
        try:
            if self.max_indexed > 0 and not J.quota_allows(
                    lambda: self._last(batch)[0], todo.count(), self.max_indexed):
                self.refused.append(batch)
                raise IndexFull(f"batch {batch} would exceed {self.max_indexed} pictures")
            self._store(posts, todo, done, old, batch)
        finally:
            todo.unpersist()
            old.unpersist()

    def _store(self, posts, todo, done, old, batch: int) -> None:
        last_image, last_seq = self._last(batch)
        seq = last_seq + 1
        marks, made = self.encode(todo)
        faults = D.validate_vectors(
            todo.select(F.col("post_id").alias("item_id")),
            made.withColumnRenamed("post_id", "item_id"), self.active)
        bad = faults.where(F.col("fault").isNotNull() | (F.col("unregistered") > 0)).select(
            F.col("item_id").alias("post_id"))
        report = self._append("statuses", batch, seq, D.post_status(posts, done, bad), *D.status_counts())
        top = last_image
        if report["saved"]:
            top = max(top, self._store_saved(todo, marks, made, old, batch, seq, last_image))
        else:
            for name in ("images", "codes", "image_vectors"):
                self._append_none(name, batch, seq)
        self._append("states", batch, seq, posts.groupBy("source_site").agg(
            F.max("post_id").alias("high_watermark_id")).select(
            "source_site", F.lit(self.scope).alias("scope_key"), "high_watermark_id",
            F.lit(top).cast("bigint").alias("last_image_id")))
        self.stored = (batch, top, seq) if self.running else None
        self.reports = [r for r in self.reports if (r["run"], r["batch"]) != (self.run_id, batch)]
        self.reports.append({"run": self.run_id, "batch": batch, **report})

    def _store_saved(self, todo, marks, made, old, batch: int, seq: int, last_image: int) -> int:
        """Write the pictures of a batch that passed; returns the largest id among them."""
        # Later steps need only to know which posts passed, so they read that back.
        passed = self.table("statuses").where(
            (F.col("run") == self.run_id) & (F.col("batch") == batch) & (F.col("status") == "saved")).select("post_id")
        items = todo.join(passed, "post_id", "left_semi").join(marks, "post_id").select(
            "source_site", F.col("post_id").alias("source_post_id"), "source_url", "canonical_url",
            F.col("large_url").alias("file_url"), "preview_url", "md5", "phash", "dhash", "width",
            "height", "file_size", "rating", "score", "tags", "artist_tags", "thumb_path",
            F.lit("stream").alias("indexed_by"), F.lit(0).alias("arrival"))
        changed = old.join(items.select(*M.IMAGE_KEY), M.IMAGE_KEY, "left_semi")
        last_id = F.lit(last_image).cast("bigint")
        top = self._append("images", batch, seq, M.upsert_images(changed, items, self.now, last_id=last_id),
                           F.max("image_id").alias("top"))["top"]
        written = self.spark.read.schema(S.IMAGES).parquet(self._part("images", batch))
        fresh = made.join(written.select("image_id", F.col("source_post_id").alias("post_id")),
                          "post_id")
        at = D.as_ts(self.now)
        # Codes before the mark: a crash in between leaves vectors pending for a rebuild.
        self._append("codes", batch, seq, fresh.select(
            "image_id", "model_id", V.encode_sign_bulk(F.col("vector")).alias("code")))
        self._append("image_vectors", batch, seq, fresh.select(
            "image_id", "model_id", "vector", at.alias("created_at"), at.alias("indexed_at")))
        return top or 0

    def high_watermark(self) -> DataFrame:
        """Largest post id of any committed batch; refused batches do not count."""
        return self.table("states").groupBy("source_site", "scope_key").agg(
            F.max("high_watermark_id").alias("high_watermark_id"))

    def queue_failures(self, retries: DataFrame) -> DataFrame:
        """`retries` with every post whose last status is a failure, waiting for its next attempt."""
        last = self.current("statuses", ["source_site", "post_id"]).where("status = 'failed'")
        return M.enqueue_retries(retries, last.select(
            "source_site", F.lit(self.scope).alias("scope_key"), F.col("post_id").alias("source_post_id")), self.now)

    def report(self) -> DataFrame:
        return D.batch_report(self.table("statuses"))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Process everything available, then stop.

        A refused batch ends the run before it is committed; the next run with this checkpoint reads it again.
        """
        self.run_id = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        self.refresh()
        self.running, self.stored = True, None
        q = (stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if not self.refused:
                raise
        finally:
            self.running, self.stored = False, None


def read_feed_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(S.FEED_POST).option("maxFilesPerTrigger", files_per_trigger)
        .json(path).where(F.coalesce("id", F.lit(0)) != 0)
    )


def without_repeats(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """The stream with the first row of each post id only, of those whose files were written within that time.

    State holds one id per post for that long and no more. A post that comes again later passes, and the sink finds it
    done. Only for a stream read from files, whose times are its clock.
    """
    timed = stream.withColumn("_arrived", F.col("_metadata.file_modification_time")).withWatermark("_arrived", within)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("_arrived")
