"""Catalog inputs derived, row by row and in full, from the benchmark tables.

No derivation samples or cuts its source table; attributes that decide whether
a vector or a thumbnail exists come from the row's own label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace import schema as S
from imgtrace.functions import posts as P
from imgtrace.functions import vectors as V

EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "1998-12-01 00:00:00"
SITE = "site0"
SCOPE = "default"
MODEL_ROWS = [
    ("copy64", "copy", 64, "cosine", 224, True),
    ("sem32", "semantic", 32, "cosine", 224, True),
    ("old64", "copy", 64, "cosine", 224, False),
]
DEGRADATION_STEPS = {"half": 0.01, "jpeg40": 0.02, "crop": 0.03, "bar": 0.04, "border": 0.06}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def sign_hash(v: Column) -> Column:
    """Hash stand-in: the sign bits of a 64-d vector as 16 hex digits."""
    return F.lower(F.lpad(F.hex(F.element_at(V.encode_sign(v), 1)), 16, "0"))


def gallery(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    vid, label = F.col("vec_id"), F.col("label")
    site = F.concat(F.lit("site"), (label % 3).cast("string"))
    post = vid * 7 + 1
    all_tags = F.array(*[F.lit(f"t{i}") for i in range(1, 16)])
    artists = F.array(F.concat(F.lit("artist"), label.cast("string")), F.lit("guest"))
    return e.select(
        (vid + 1).alias("image_id"),
        site.alias("source_site"),
        post.alias("source_post_id"),
        F.when(label == 4, "").otherwise(
            F.concat(F.lit("https://origin.example/"), vid.cast("string"))).alias("source_url"),
        F.concat(F.lit("https://"), site, F.lit(".example/posts/"), post.cast("string"))
        .alias("canonical_url"),
        F.concat(F.lit("ftp://cdn.example/"), vid.cast("string")).alias("preview_url"),
        F.when(label < 2, "g").when(label < 4, " Sensitive ").when(label < 6, "q")
        .when(label < 8, "odd").when(label < 9, "").alias("rating"),
        (vid % 50).cast("int").alias("score"),
        sign_hash(F.col("embedding")).alias("phash"),
        F.when(label == 1, "").when(label == 7, F.lit(None).cast("string"))
        .otherwise(P.thumb_path(site, post)).alias("thumb_path"),
        F.slice(all_tags, 1, (vid % 16).cast("int")).alias("tags"),
        F.slice(artists, 1, (label % 3).cast("int")).alias("artist_tags"),
        label.alias("label"),
        F.col("embedding").alias("embedding"),
    )


def image_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """copy64 exists unless label is 7; sem32 (first half) unless label is 2, 5 or 8."""
    e = table(spark, sf, "embeddings")
    label = F.col("label")
    per_model = F.array(
        F.struct(F.lit("copy64").alias("model_id"), F.col("embedding").alias("vector"),
                 (label != 7).alias("present")),
        F.struct(F.lit("sem32").alias("model_id"),
                 F.slice("embedding", 1, 32).alias("vector"),
                 (~label.isin(2, 5, 8)).alias("present")),
    )
    return (
        e.select((F.col("vec_id") + 1).alias("image_id"), label, F.explode(per_model).alias("m"))
        .where("m.present")
        .select(
            "image_id", "m.model_id", "m.vector",
            ts("2024-01-01 00:00:00").alias("created_at"),
            F.when(label != 3, ts("2024-01-01 00:00:00")).alias("indexed_at"),
        )
    )


def codes(spark: SparkSession, sf: str, model_id: str = "copy64") -> DataFrame:
    return image_vectors(spark, sf).where(F.col("model_id") == model_id).select(
        "image_id", "model_id", V.encode_sign(F.col("vector")).alias("code"))


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_ROWS, S.MODELS)


def vector_size(model_id: str) -> int:
    """The size the model table states."""
    return next(row[2] for row in MODEL_ROWS if row[0] == model_id)


def _shifted(step: Column) -> Column:
    return F.transform(
        F.col("embedding"),
        lambda x, i: (x.cast("double") + step * ((i * 7 + F.col("vec_id")) % 5 - 2)).cast("float"),
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector, slightly disturbed; the picture it came from is `answer_id`."""
    q = table(spark, sf, "embeddings").withColumn("vector", _shifted(F.lit(0.02)))
    return q.select(
        F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("answer_id"), "label",
        "vector", sign_hash(F.col("vector")).alias("phash"))


def degraded(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector under each of five disturbances; query_id = vec_id*8 + kind number."""
    kinds = F.array(*[
        F.struct(F.lit(n).alias("no"), F.lit(k).alias("kind"), F.lit(s).alias("step"))
        for n, (k, s) in enumerate(DEGRADATION_STEPS.items())
    ])
    d = table(spark, sf, "embeddings").withColumn("k", F.explode(kinds))
    d = d.withColumn("vector", _shifted(F.col("k.step")))
    return d.select(
        (F.col("vec_id") * 8 + F.col("k.no")).alias("query_id"),
        (F.col("vec_id") + 1).alias("answer_id"), F.col("k.kind").alias("degradation"), "label",
        "vector", sign_hash(F.col("vector")).alias("phash"))


def _scope(c: Column) -> list[Column]:
    """Site and scope as data of the row, like in a stored table; all rows share one."""
    zero = (c % 1).cast("string")
    return [F.concat(F.lit("site"), zero).alias("source_site"),
            F.regexp_replace(zero, "0", SCOPE).alias("scope_key")]


def crawl_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """One work range per order; orders of priority 1 leave a three-id gap above them."""
    o = table(spark, sf, "orders")
    key, st, pr = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    status = (
        F.when(st == "F", "completed")
        .when(pr.startswith("1") | pr.startswith("2"), "failed")
        .when(pr.startswith("3"), "running")
        .when(pr.startswith("4"), "empty")
        .otherwise("completed")
    )
    when = F.col("o_orderdate").cast("timestamp")
    return o.select(
        (key + 1).alias("id"), *_scope(key),
        F.lit("backfill").alias("direction"),
        (key * 10 + 1).alias("lower_id"),
        (key * 10 + F.when(pr.startswith("1"), 7).otherwise(10)).alias("upper_id"),
        status.alias("status"),
        (F.col("o_custkey") % 7).cast("int").alias("attempts"),
        F.when(status == "running",
               F.concat(F.lit("node"), (F.col("o_custkey") % 12).cast("string"))).alias("node_id"),
        when.alias("leased_at"), when.alias("ready_at"),
        F.when(status == "completed", F.col("o_custkey") % 11).otherwise(0).cast("int")
        .alias("saved_count"),
        F.when(status == "failed", F.concat(F.lit("HTTP "), (F.col("o_custkey") % 3 + 428)
                                            .cast("string"))).alias("last_error"),
    )


TWO_SCOPES_SQL = """
  SELECT * FROM crawl_ranges
  UNION ALL SELECT * REPLACE ('other' AS scope_key) FROM crawl_ranges WHERE id % 3 <> 0"""


def two_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """The ranges under one scope, and two thirds of them under another."""
    r = crawl_ranges(spark, sf)
    return r.unionByName(r.where("id % 3 != 0").withColumn("scope_key", F.lit("other")))


def crawl_post_retries(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    when = F.col("o_orderdate").cast("timestamp")
    status = (
        F.when(st == "P", "pending").when(st == "O", "running")
        .when(F.col("o_custkey") % 2 == 0, "dead").otherwise("succeeded")
    )
    return o.select(
        (F.col("o_orderkey") + 1).alias("id"), *_scope(F.col("o_orderkey")),
        F.col("o_orderkey").alias("source_post_id"),
        status.alias("status"), (F.col("o_custkey") % 7).cast("int").alias("attempts"),
        F.when(status == "running",
               F.concat(F.lit("node"), (F.col("o_custkey") % 12).cast("string"))).alias("node_id"),
        when.alias("ready_at"), when.alias("leased_at"),
        F.when(status == "dead", "gone").alias("last_error"),
    )


def crawl_states(spark: SparkSession, sf: str) -> DataFrame:
    """One row: everything up to the largest range is seen, down to a quarter of it."""
    return table(spark, sf, "orders").agg(
        (F.max("o_orderkey") * 10 + 10).alias("high_watermark_id"),
        F.floor((F.max("o_orderkey") * 10 + 10) / 4).cast("bigint").alias("backfill_before_id"),
    ).select(*_scope(F.col("high_watermark_id")), "high_watermark_id", "backfill_before_id")


def node_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One sample per event. event_id grows with ts, so it serves as the counter."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    return e.select(
        F.concat(F.lit("node"), (F.col("user_id") % 10).cast("string")).alias("node_id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.when(F.col("event_type") != "view", F.col("value").cast("float")).alias("cpu_pct"),
        (F.col("user_id") * 10).cast("float").alias("mem_mb"),
        (n * 3).alias("downloaded"), (n * 2).alias("embedded"),
        (n * 2 - F.floor(n / 50)).cast("bigint").alias("saved"),
        F.floor(n / 50).cast("bigint").alias("failed"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return node_metrics(spark, sf).groupBy("node_id").agg(
        F.max("observed_at").alias("heartbeat_at")
    ).select(
        "node_id",
        F.when(F.col("node_id") == "node0", "center").otherwise("worker").alias("role"),
        F.when(F.col("node_id") == "node3", "offline").otherwise("online").alias("status"),
        "heartbeat_at",
    )


def probe_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    u = F.col("user_id")
    return e.select(
        F.concat(F.lit("node"), (u % 10).cast("string")).alias("node_id"),
        F.col("event_type").alias("host"),
        F.when(u % 4 == 0, "direct").when(u % 4 == 1, "split").when(u % 4 == 2, "tunnel")
        .otherwise("proxy").alias("mode"),
        (F.col("value") > 20).alias("ok"),
        F.when(F.col("event_type") != "click", F.floor(F.col("value") * 10).cast("int"))
        .alias("latency_ms"),
        F.col("ts").cast("timestamp").alias("checked_at"),
        F.col("event_id").alias("seq"),
    )


def download_log(spark: SparkSession, sf: str) -> DataFrame:
    """One download attempt per event; concurrency step and outcome from the event."""
    e = table(spark, sf, "events")
    u, kind = F.col("user_id") % 6, F.col("event_type")
    return e.select(
        F.col("event_id").alias("attempt_id"),
        F.when(u == 0, 1).otherwise(F.call_function("shiftleft", F.lit(2), u.cast("int")))
        .alias("step"),
        F.floor(F.col("value") * 4096).cast("bigint").alias("bytes"),
        F.col("value").alias("seconds"),
        F.when(kind == "error", F.when(F.col("value") > 60, 503).otherwise(429)).alias("http_code"),
        F.when(kind == "error", "status")
        .when((kind == "click") & (F.col("value") > 90), "dial tcp: connection reset by peer")
        .when((kind == "click") & (F.col("value") > 80), "context deadline exceeded")
        .when((kind == "click") & (F.col("value") > 70), "lookup cdn: no such host")
        .when((kind == "click") & (F.col("value") > 60), "broken")
        .alias("error"),
    )


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """The post feed, one post per document (its text stands for the file)."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select(F.col("doc_id"), F.col("toxic"))
    d = d.join(lab, "doc_id", "left")
    pid = F.col("doc_id") + 1
    pid_s = pid.cast("string")
    lang, src = F.col("lang"), F.col("source")
    return d.select(
        pid.alias("id"), F.md5("text").alias("md5"),
        F.when(lang == "en", "").when(lang == "fr", F.concat(F.lit("https://cdn/"), pid_s, F.lit(".mp4")))
        .otherwise(F.concat(F.lit("https://cdn/"), pid_s, F.lit(".JPG?x=1#f"))).alias("large_file_url"),
        F.concat(F.lit("https://cdn/"), pid_s,
                 F.when(src.endswith("1"), ".webm").otherwise(".png")).alias("file_url"),
        F.concat(F.lit("https://cdn/"), pid_s,
                 F.when(src.endswith("1"), ".gif").otherwise(".jpeg")).alias("preview_file_url"),
        F.concat(F.lit("  https://origin/"), pid_s, F.lit(" ")).alias("source"),
        F.substring(lang, 1, 1).alias("rating"),
        (F.col("n_chars") % 100).cast("int").alias("score"),
        (F.col("n_chars") % 4000 + 1).cast("int").alias("image_width"),
        (F.col("n_chars") % 3000 + 1).cast("int").alias("image_height"),
        F.col("n_chars").alias("file_size"), F.lit("png").alias("file_ext"),
        F.when(lang == "de", "").otherwise(F.concat(F.lit(" "), lang, F.lit("  "), src, F.lit(" ")))
        .alias("tag_string"),
        src.alias("tag_string_artist"), lang.alias("tag_string_character"),
        F.concat(src, F.lit(" shared")).alias("tag_string_copyright"),
        F.concat(lang, F.lit(" shared")).alias("tag_string_general"), F.lit("").alias("tag_string_meta"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("is_deleted"),
        src.endswith("7").alias("is_banned"),
    )


def done_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Already stored vectors of feed posts: both models, one, or none, by language."""
    d = table(spark, sf, "documents")
    lang = F.col("lang")
    per_model = F.array(
        F.struct(F.lit("copy64").alias("model_id"), lang.isin("es", "fr").alias("present")),
        F.struct(F.lit("sem32").alias("model_id"), (lang == "es").alias("present")),
    )
    return d.select((F.col("doc_id") + 1).alias("image_id"), F.explode(per_model).alias("m")).where(
        "m.present").select("image_id", "m.model_id")


def done_images(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows of feed posts already seen (everything but English)."""
    d = table(spark, sf, "documents")
    return d.where(F.col("lang") != "en").select(
        (F.col("doc_id") + 1).alias("image_id"), F.lit(SITE).alias("source_site"),
        (F.col("doc_id") + 1).alias("source_post_id"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
