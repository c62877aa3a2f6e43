"""Landing feed of posts: read, normalise, slice by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace import schema as S
from imgtrace.functions import posts as P

MAX_PAGE = 200


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the fixed 20-field schema; posts without an id are dropped."""
    return spark.read.schema(S.FEED_POST).json(path).where(F.coalesce("id", F.lit(0)) != 0)


def normalize_posts(feed: DataFrame, base_url: str, site: str) -> DataFrame:
    """Feed rows -> the 18-column post projection, plus site and download URL."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return feed.select(
        F.col("id").alias("post_id"), text("md5").alias("md5"),
        text("rating").alias("rating"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("image_width", F.lit(0)).alias("width"),
        F.coalesce("image_height", F.lit(0)).alias("height"),
        F.coalesce("file_size", F.lit(0)).alias("file_size"),
        text("file_url").alias("file_url"), text("large_file_url").alias("large_url"),
        text("preview_file_url").alias("preview_url"),
        F.regexp_replace(text("source"), r"(?U)^\s+|\s+$", "").alias("source_url"),
        P.merged_tags(F.col("tag_string"), *[F.col(f"tag_string_{c}") for c in P.TAG_CATEGORIES])
        .alias("tags"),
        P.split_tags(F.col("tag_string_artist")).alias("artist_tags"),
        text("file_ext").alias("file_ext"), flag("is_deleted").alias("is_deleted"),
        flag("is_banned").alias("is_banned"),
        P.canonical_url(base_url, F.col("id")).alias("canonical_url"),
        F.lit(site).alias("source_site"),
    )


def with_download(posts: DataFrame) -> DataFrame:
    """Add the URL to fetch and the reason to skip ('' = process)."""
    url = P.download_url(F.col("large_url"), F.col("file_url"), F.col("preview_url"))
    return posts.withColumn("download_url", url).withColumn(
        "skip_reason",
        P.skip_reason(F.col("is_deleted"), F.col("is_banned"), F.col("download_url")))


def posts_in_range(posts: DataFrame, lower: int, upper: int, tags: list[str] | None = None) -> DataFrame:
    """Inclusive id interval, newest first; every given tag must be present."""
    if lower > upper:
        raise ValueError(f"range is upside down: {lower} > {upper}")
    out = posts.where(F.col("post_id").between(lower, upper))
    for t in tags or []:
        out = out.where(F.array_contains("tags", t))
    return out.orderBy(F.desc("post_id"))


def posts_after(posts: DataFrame, watermark: int, limit: int = MAX_PAGE) -> DataFrame:
    """The next page above the watermark, oldest first (a page is at most 200)."""
    page = MAX_PAGE if limit <= 0 or limit > MAX_PAGE else limit
    return posts.where(F.col("post_id") > watermark).orderBy("post_id").limit(page)


def latest_post_id(posts: DataFrame) -> DataFrame:
    return posts.agg(F.coalesce(F.max("post_id"), F.lit(0)).alias("latest_id"))


def post_by_id(posts: DataFrame, post_id: int) -> DataFrame:
    return posts.where(F.col("post_id") == post_id)
