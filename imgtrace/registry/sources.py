"""Sources, sinks, scans and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtrace.functions import posts as P
from imgtrace.functions import vectors as V
from imgtrace.registry.base import query
from imgtrace.registry.derived_sql import with_
from imgtrace.session import scratch_path
from imgtrace.sources import catalog as C
from imgtrace.sources import derived as D
from imgtrace.sources import feed as A

BASE_URL = "https://site0.example"


def posts(spark, sf):
    return A.with_download(A.normalize_posts(D.feed(spark, sf), BASE_URL, D.SITE))


@query("a1_read_posts", with_("feed") + """
SELECT id - 1 AS id, md5, large_file_url, file_url, file_size, tag_string, is_deleted, is_banned
FROM feed WHERE id - 1 <> 0""")
def read_posts(spark, sf):
    path = scratch_path(spark, "feed")
    D.feed(spark, sf).withColumn("id", F.col("id") - 1).write.json(path)
    return A.read_posts(spark, path).select(
        "id", "md5", "large_file_url", "file_url", "file_size", "tag_string", "is_deleted", "is_banned")


@query("a2_posts_in_range", with_("posts") + """
SELECT id AS post_id, md5, file_size FROM posts
WHERE id BETWEEN 1 AND (SELECT max(doc_id) + 1 FROM documents) AND list_contains(tags, lang)""")
def posts_in_range(spark, sf):
    return A.posts_in_range(posts(spark, sf), 1, 1 << 40).select("post_id", "md5", "file_size")


@query("a3_posts_after", with_("posts") + """
SELECT id AS post_id, md5 FROM posts WHERE id > 40 ORDER BY id LIMIT 200""")
def posts_after(spark, sf):
    return A.posts_after(posts(spark, sf), 40, 1000).select("post_id", "md5")


@query("a3_latest_post_id", with_("posts") + "SELECT max(id) AS latest_id FROM posts")
def latest(spark, sf):
    return A.latest_post_id(posts(spark, sf))


def _wire(spark, sf):
    """Encoded vectors; labels 4, 5 and 6 carry a wrong size, a cut text and garbage."""
    e = D.table(spark, sf, "embeddings")
    text = V.encode_wire(F.col("embedding"))
    size = F.when(F.col("label") == 4, 63).when(F.col("label") == 9, 0).otherwise(64)
    return e.withColumn("data", text).select(
        "vec_id", "embedding",
        F.when(F.col("label") == 5, F.lit("AAA="))
        .when(F.col("label") == 6, F.concat(F.lit("!"), F.col("data"))).otherwise(F.col("data"))
        .alias("data"), size.alias("size"))


@query("a4_decode_vectors", """
SELECT vec_id, CASE label WHEN 4 THEN 'size' WHEN 5 THEN 'length' WHEN 6 THEN 'base64' ELSE '' END AS reject,
  label NOT IN (4, 5, 6) AS same, CASE WHEN label IN (4, 5, 6) THEN 0 ELSE CAST(len(embedding) AS INTEGER) END AS n
FROM embeddings""")
def decode(spark, sf):
    d = _wire(spark, sf).withColumn("d", V.decode_wire(F.col("data"), F.col("size")))
    return d.select("vec_id", F.coalesce("d.reject", F.lit("")).alias("reject"),
                    F.coalesce(F.col("d.values") == F.col("embedding"), F.lit(False)).alias("same"),
                    F.coalesce(F.array_size("d.values"), F.lit(0)).alias("n"))


@query("a5_encode_vectors", """
SELECT vec_id, CAST(round(list_sum(embedding[1:1]), 6) AS DOUBLE) AS first_value, 344 AS n_chars, TRUE AS round_trip
FROM embeddings""")
def encode(spark, sf):
    e = D.table(spark, sf, "embeddings").withColumn("data", V.encode_wire(F.col("embedding")))
    back = V.decode_wire(F.col("data"), F.lit(64))
    return e.withColumn("back", back).select(
        "vec_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"),
        F.length("data").alias("n_chars"), (F.col("back.values") == F.col("embedding")).alias("round_trip"))


@query("a7_write_read_catalog", with_("gallery", "image_vectors") + """
SELECT model_id, count(*) AS vectors, count(DISTINCT source_site) AS sites, sum(image_id)::BIGINT AS id_sum
FROM image_vectors JOIN gallery USING (image_id) GROUP BY model_id""")
def write_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    C.write_catalog(D.gallery(spark, sf).drop("embedding", "label"), D.image_vectors(spark, sf), path)
    t = C.open_catalog(spark, path, D.models(spark))
    return (
        t["image_vectors"].join(t["codes"], ["image_id", "model_id"])
        .join(t["images"].select("image_id", "source_site"), "image_id")
        .groupBy("model_id").agg(
            F.count("*").alias("vectors"), F.countDistinct("source_site").alias("sites"),
            F.sum("image_id").alias("id_sum"))
    )


@query("a8_thumb_path", """
SELECT url, page_id,
  CASE WHEN trim(slug, '-') = '' THEN 'unknown' ELSE trim(slug, '-') END
    || printf('/%02x/%02x/%d.jpg', page_id & 255, (page_id >> 8) & 255, page_id) AS thumb_path
FROM (SELECT *, regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^a-z0-9_-]', '-', 'g') AS slug FROM pages)""")
def thumb_path(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select("url", "page_id", P.thumb_path(F.col("url"), F.col("page_id")).alias("thumb_path"))


@query("a9_count_points", with_("image_vectors") + """
SELECT model_id, count(*) AS points FROM image_vectors GROUP BY model_id""")
def count_points(spark, sf):
    return C.count_points(D.image_vectors(spark, sf))


@query("a9_count_images", with_("gallery") + "SELECT count(*) AS images FROM gallery")
def count_images(spark, sf):
    return C.count_images(D.gallery(spark, sf))


@query("a10_image_by_id", with_("gallery") + """
SELECT o.o_custkey AS image_id, g.source_post_id IS NOT NULL AS indexed, coalesce(thumb_path, '') <> '' AS has_thumb,
  count(*) AS orders
FROM orders o LEFT JOIN gallery g ON g.image_id = o.o_custkey GROUP BY ALL""")
def image_by_id(spark, sf):
    ids = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("image_id"))
    counts = ids.groupBy("image_id").agg(F.count("*").alias("orders"))
    return C.images_by_id(counts, D.gallery(spark, sf)).select(
        "image_id", "indexed", "has_thumb", "orders")


@query("a10_image_by_source", with_("gallery") + """
SELECT 'site' || (p_partkey % 3) AS source_site, p_partkey AS source_post_id, g.image_id IS NOT NULL AS indexed,
  coalesce(thumb_path, '') <> '' AS has_thumb
FROM part LEFT JOIN gallery g ON g.source_site = 'site' || (p_partkey % 3) AND g.source_post_id = p_partkey""")
def image_by_source(spark, sf):
    key = F.col("p_partkey")
    ids = D.table(spark, sf, "part").select(
        F.concat(F.lit("site"), (key % 3).cast("string")).alias("source_site"),
        key.alias("source_post_id"))
    return C.images_by_source(ids, D.gallery(spark, sf)).select(
        "source_site", "source_post_id", "indexed", "has_thumb")


@query("b3_normalize_post", with_("posts") + """
SELECT id AS post_id, md5, rating, score, width, height, file_size, file_url, large_file_url AS large_url,
  preview_file_url AS preview_url, clean_source AS source_url, array_to_string(tags, ' ') AS tags,
  source AS artist_tags, file_ext, is_deleted, is_banned, canonical_url, 'site0' AS source_site
FROM posts""")
def normalize(spark, sf):
    return A.normalize_posts(D.feed(spark, sf), BASE_URL, D.SITE).withColumn(
        "tags", F.array_join("tags", " ")).withColumn("artist_tags", F.array_join("artist_tags", " "))
