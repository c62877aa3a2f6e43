"""Projections, predicates and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtrace.functions import hashes as H
from imgtrace.functions import posts as P
from imgtrace.functions import rules as R
from imgtrace.functions import vectors as V
from imgtrace.operators import models as M
from imgtrace.operators import search as S
from imgtrace.registry.base import i64, query, r6
from imgtrace.registry.derived_sql import cosine, dot, hamming_hex, with_, word
from imgtrace.registry.sources import posts
from imgtrace.sources import derived as D


@query("b1_split_tags", """
SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def split_tags(spark, sf):
    d = D.table(spark, sf, "documents").withColumn("w", P.split_tags(F.col("text")))
    return d.select("doc_id", i64(F.size("w")).alias("n_words"),
                    F.md5(F.array_join("w", " ")).alias("words_md5"))


@query("b2_merged_tags", with_("posts") + "SELECT id, array_to_string(tags, ' ') AS tags FROM posts")
def merged_tags(spark, sf):
    tags = P.merged_tags(F.col("tag_string"), *[F.col(f"tag_string_{c}") for c in P.TAG_CATEGORIES])
    return D.feed(spark, sf).select("id", F.array_join(tags, " ").alias("tags"))


@query("b4_download_url", with_("posts") + "SELECT id AS post_id, download_url FROM posts")
def download_url(spark, sf):
    return posts(spark, sf).select("post_id", "download_url")


@query("b5_skip_reason", with_("checked_posts") + "SELECT id AS post_id, skip_reason FROM checked_posts")
def skip_reason(spark, sf):
    return posts(spark, sf).select("post_id", "skip_reason")


@query("b6_hamming_hex", with_("gallery", "queries") + f"""
SELECT q.query_id, CASE WHEN q.label IN (0, 2, 3) THEN -1 ELSE {hamming_hex('g.phash', 'q.phash')} END AS distance
FROM queries q JOIN gallery g ON g.image_id = q.answer_id""")
def hamming(spark, sf):
    q, g = D.queries(spark, sf), D.gallery(spark, sf).select(
        F.col("image_id").alias("answer_id"), F.col("phash").alias("other"))
    h, lab = F.col("phash"), F.col("label")
    odd = (
        F.when(lab == 0, "").when(lab == 1, F.upper(h))
        .when(lab == 2, F.concat(F.lit("zz"), F.substring(h, 3, 14)))
        .when(lab == 3, F.substring(h, 1, 14)).otherwise(h)
    )
    return q.join(g, "answer_id").select("query_id", F.coalesce(
        H.hamming_hex(F.col("other"), odd), F.lit(H.NOT_COMPARABLE)).alias("distance"))


@query("b7_hash_threshold", """
SELECT doc_id, CAST(n * 4 AS INTEGER) AS bits, CAST(greatest(1, n * 4 * 5 // 64) AS INTEGER) AS threshold
FROM (SELECT doc_id, length(repeat('f', CAST(n_chars % 70 AS INTEGER))) AS n FROM documents)""")
def hash_threshold(spark, sf):
    h = F.repeat(F.lit("f"), (F.col("n_chars") % 70).cast("int"))
    return D.table(spark, sf, "documents").withColumn("h", h).select(
        "doc_id", H.hash_bits(F.col("h")).alias("bits"),
        H.same_image_threshold(F.col("h")).alias("threshold"))


@query("b8_encode_sign", f"""
SELECT vec_id, {word('embedding', 1)} AS low_dims, {word('embedding', 33)} AS high_dims,
  CAST(len(embedding[1:32]) // 33 + 1 AS INTEGER) AS short_words
FROM embeddings""")
def encode_sign(spark, sf):
    e = D.table(spark, sf, "embeddings")
    w = F.element_at(V.encode_sign(F.col("embedding")), 1)
    return e.select(
        "vec_id", w.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low_dims"),
        F.shiftrightunsigned(w, 32).alias("high_dims"),
        F.size(V.encode_sign(F.slice("embedding", 1, 32))).alias("short_words"))


@query("b9_hamming_code", with_("queries") + """
SELECT query_id, CAST(list_sum([CASE WHEN (vector[i] > 0) <> (embedding[i] > 0) THEN 1 ELSE 0 END
                                for i in range(1, 65)]) AS INTEGER) AS distance
FROM queries JOIN embeddings ON vec_id = query_id""")
def hamming_code(spark, sf):
    q = D.queries(spark, sf)
    e = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    d = H.hamming_code(V.encode_sign(F.col("vector")), V.encode_sign(F.col("embedding")))
    return q.join(e, "query_id").select("query_id", d.alias("distance"))


@query("b10_normalize", f"""
SELECT vec_id, round(list_sum([CAST(w[i] AS DOUBLE) * i for i in range(1, 65)]), 4) AS weighted
FROM (SELECT vec_id, CASE WHEN n = 0 THEN v ELSE [CAST(CAST(x AS DOUBLE) * (1 / sqrt(n)) AS FLOAT) for x in v] END AS w
      FROM (SELECT vec_id, v, {dot('v', 'v')} AS n
            FROM (SELECT vec_id, [CAST(x * label AS FLOAT) for x in embedding] AS v FROM embeddings)))""")
def normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: (x * F.col("label")).cast("float"))
    e = D.table(spark, sf, "embeddings").withColumn("w", V.normalize(scaled))
    weighted = F.aggregate(
        F.transform("w", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(weighted, 4).alias("weighted"))


@query("b11_cosine", with_("queries") + f"""
SELECT query_id, CASE WHEN q.label = 0 THEN 0 ELSE round(CAST({cosine('vector', 'embedding')} AS DOUBLE), 6) END AS score
FROM queries q JOIN embeddings ON vec_id = query_id""")
def cosine_q(spark, sf):
    q = D.queries(spark, sf)
    v = F.when(F.col("label") == 0, F.transform("vector", lambda x: x * F.lit(0).cast("float"))).otherwise(
        F.col("vector"))
    e = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return q.withColumn("vector", v).join(e, "query_id").select(
        "query_id", r6(V.cosine(F.col("vector"), F.col("embedding"))).alias("score"))


@query("b12_dot", with_("queries") + f"""
SELECT query_id, round({dot('vector', 'embedding')}, 6) AS score
FROM queries JOIN embeddings ON vec_id = query_id""")
def dot_q(spark, sf):
    e = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return D.queries(spark, sf).join(e, "query_id").select(
        "query_id", r6(V.dot(F.col("vector"), F.col("embedding"))).alias("score"))


@query("b13_first_non_finite", """
SELECT vec_id, CASE WHEN label IN (2, 5, 8) THEN CAST(vec_id % 64 AS INTEGER) ELSE -1 END AS bad_at FROM embeddings""")
def first_non_finite(spark, sf):
    bad = (F.when(F.col("label") == 2, float("nan")).when(F.col("label") == 5, float("inf"))
           .when(F.col("label") == 8, float("-inf"))).cast("float")
    spoiled = F.transform("embedding", lambda x, i: F.when(
        bad.isNotNull() & (i == F.col("vec_id") % 64), bad).otherwise(x))
    return D.table(spark, sf, "embeddings").select(
        "vec_id", F.coalesce(V.first_non_finite(spoiled), F.lit(-1)).alias("bad_at"))


@query("b14_rating_label", with_("gallery") + """
SELECT image_id,
  CASE WHEN label < 2 THEN 'General' WHEN label < 4 THEN 'Sensitive' WHEN label < 6 THEN 'Questionable'
       WHEN label < 8 THEN 'odd' ELSE 'Unrated' END AS en,
  CASE WHEN label < 2 THEN '전체 이용가' WHEN label < 4 THEN '다소 민감' WHEN label < 6 THEN '선정적'
       WHEN label < 8 THEN 'odd' ELSE '등급 없음' END AS ko
FROM gallery""")
def rating_label(spark, sf):
    return D.gallery(spark, sf).select(
        "image_id", P.rating_label(F.col("rating"), "en").alias("en"),
        P.rating_label(F.col("rating"), "ko").alias("ko"))


@query("b15_post_label", with_("gallery") + """
SELECT image_id, source_site || ' #' || source_post_id
  || CASE WHEN len(artist_tags) > 0 THEN ' · ' || array_to_string(artist_tags, ', ') ELSE '' END AS label
FROM gallery""")
def post_label(spark, sf):
    return D.gallery(spark, sf).select("image_id", P.post_label(
        F.col("source_site"), F.col("source_post_id"), F.col("artist_tags")).alias("label"))


@query("b16_hit_view", with_("gallery") + """
SELECT image_id AS query_id, source_site, source_post_id,
  source_site || ' #' || source_post_id
    || CASE WHEN len(artist_tags) > 0 THEN ' · ' || array_to_string(artist_tags, ', ') ELSE '' END AS label,
  canonical_url || CASE WHEN source_url <> '' THEN ' ' || source_url ELSE '' END AS links,
  CASE WHEN label < 2 THEN 'General' WHEN label < 4 THEN 'Sensitive' WHEN label < 6 THEN 'Questionable'
       WHEN label < 8 THEN 'odd' ELSE 'Unrated' END AS rating,
  array_to_string(tags[1:12], ', ') || CASE WHEN len(tags) > 12 THEN ' and ' || (len(tags) - 12) || ' more' ELSE '' END
    AS tags
FROM gallery""")
def hit_view(spark, sf):
    g = D.gallery(spark, sf).drop("score", "label").select(
        "*", F.col("image_id").alias("query_id"), F.lit(1).alias("hit_rank"), F.lit(1.0).alias("score"),
        F.lit(0).alias("hash_distance"), F.lit(True).alias("exact"))
    return S.hit_view(g).select("query_id", "source_site", "source_post_id", "label",
                                F.array_join("links", " ").alias("links"), "rating", "tags")


@query("b17_payload", with_("gallery") + """
SELECT image_id, source_site, source_post_id, canonical_url, coalesce(rating, '') AS rating, phash, '' AS dhash
FROM gallery""")
def payload(spark, sf):
    g = D.gallery(spark, sf).withColumn("dhash", F.lit(None).cast("string"))
    return g.select(P.payload(g).alias("p")).select("p.*")


@query("b18_retry_backoff", with_("crawl_ranges") + """
SELECT id, CAST(CASE WHEN attempts <= 1 THEN 1 WHEN attempts >= 6 THEN 30 ELSE 1 << (attempts - 1) END AS INTEGER)
    AS range_minutes,
  CAST(1 << least(greatest(attempts, 1), 6) AS INTEGER) AS post_minutes,
  CAST(epoch(ready_at) + 60 * CASE WHEN attempts <= 1 THEN 1 WHEN attempts >= 6 THEN 30
       ELSE 1 << (attempts - 1) END AS BIGINT) AS ready_again
FROM crawl_ranges""")
def retry_backoff(spark, sf):
    m = R.range_backoff_minutes(F.col("attempts"))
    return D.crawl_ranges(spark, sf).select(
        "id", m.alias("range_minutes"), R.post_delay_minutes(F.col("attempts")).alias("post_minutes"),
        F.unix_seconds(F.col("ready_at") + R.minutes(m)).alias("ready_again"))


@query("b19_range_size_for", """
SELECT event_id, CAST(CASE WHEN r <= 0 THEN 1000 WHEN floor(r * 3600) < 100 THEN 100
  WHEN floor(r * 3600) > 4000 THEN 4000 ELSE floor(r * 3600) END AS BIGINT) AS size
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE value / 64 END AS r FROM events)""")
def range_size_for(spark, sf):
    rate = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value") / 64)
    return D.table(spark, sf, "events").select("event_id", R.range_size_for(rate, 1000).alias("size"))


@query("b20_range_size", with_("crawl_ranges") + """
SELECT id, upper_id - lower_id + 1 AS size FROM crawl_ranges""")
def range_size(spark, sf):
    return D.crawl_ranges(spark, sf).select(
        "id", R.range_size(F.col("lower_id"), F.col("upper_id")).alias("size"))


@query("b21_failure_kind", with_("download_log") + """
SELECT attempt_id, CASE WHEN http_code IS NOT NULL THEN 'HTTP ' || http_code
  WHEN error LIKE '%reset%' THEN '연결 끊김' WHEN error LIKE '%deadline%' THEN '시간 초과'
  WHEN error LIKE '%no such host%' THEN '이름 조회 실패' ELSE '기타' END AS kind
FROM download_log WHERE error IS NOT NULL""")
def failure_kind(spark, sf):
    log = D.download_log(spark, sf).where(F.col("error").isNotNull())
    return log.select("attempt_id", R.failure_kind(F.col("http_code"), F.col("error")).alias("kind"))


@query("b22_probe_verdict", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN '차단됨' WHEN event_type = 'error' THEN '실패'
    WHEN user_id % 7 * 100 + 100 >= 400 THEN '도달함 ' || (user_id % 7 * 100 + 100) ELSE '성공' END AS verdict,
  round(CASE WHEN floor(value * 4096) < 65536 OR event_type = 'view' THEN 0
        ELSE floor(value * 4096) / (value / 10) / 1048576 END, 6) AS mbps
FROM events""")
def probe_verdict(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind != "error", F.col("user_id") % 7 * 100 + 100)
    latency = F.when(kind == "view", 0.0).otherwise(F.col("value") / 10)
    return D.table(spark, sf, "events").select(
        "event_id", R.probe_verdict(kind == "signup", status).alias("verdict"),
        r6(R.throughput_mbps(F.floor(F.col("value") * 4096), latency)).alias("mbps"))


@query("b23_query_key", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def query_key(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", P.query_key(F.encode("text", "utf-8")).alias("sha256"))


@query("b24_parse_model_spec", """
SELECT p_partkey, CASE WHEN p_size = 7 THEN '' WHEN p_size <= 3 THEN p_brand ELSE 'm' || p_partkey END AS id,
  CASE WHEN p_size = 7 THEN 'missing fields' WHEN p_size = 8 THEN 'kind' WHEN p_size = 9 THEN 'vector_size'
    WHEN p_size = 10 THEN 'input_size' WHEN p_size <= 3 AND (count(*) OVER (PARTITION BY p_brand, p_size <= 3)) > 1
    THEN 'duplicate id' ELSE '' END AS fault,
  CASE WHEN p_size = 11 THEN 224 WHEN p_size = 10 THEN 0 ELSE p_size END AS input_size
FROM part""")
def parse_model_spec(spark, sf):
    s = F.col("p_size")
    spec = F.to_json(F.struct(
        F.when(s != 7, F.when(s <= 3, F.col("p_brand")).otherwise(
            F.concat(F.lit("m"), F.col("p_partkey").cast("string")))).alias("id"),
        F.when(s == 8, "other").otherwise("copy").alias("kind"), F.lit("cpu").alias("backend"),
        F.lit("weights").alias("checkpoint"), F.when(s == 9, 0).otherwise(s).alias("vector_size"),
        F.when(s != 11, F.when(s == 10, 0).otherwise(s)).alias("input_size")))
    raw = D.table(spark, sf, "part").select("p_partkey", spec.alias("spec"))
    return M.parse_model_specs(raw).select(
        "p_partkey", F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("fault", F.lit("")).alias("fault"), "input_size")


@query("b25_estimate_duration", """
SELECT event_id, CASE WHEN m IS NULL THEN '알 수 없음' WHEN m // 60 > 0 THEN (m // 60) || 'h' || (m % 60) || 'm0s'
  WHEN m > 0 THEN m || 'm0s' ELSE '0s' END AS estimate
FROM (SELECT event_id, CASE WHEN event_type <> 'error' AND user_id > 0
        THEN CAST(floor((floor(user_id * 40 / value) + 30) / 60) AS BIGINT) END AS m FROM events)""")
def estimate_duration(spark, sf):
    rate = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    return D.table(spark, sf, "events").select(
        "event_id", R.estimate_duration(F.col("user_id") * 40, rate).alias("estimate"))


@query("b26_distance_name", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'cosine' WHEN 'click' THEN 'cosine' WHEN 'error' THEN 'dot' ELSE '' END AS flat,
  CASE event_type WHEN 'error' THEN 'dot' WHEN 'purchase' THEN 'euclid' ELSE 'cosine' END AS graph
FROM events""")
def distance_name(spark, sf):
    k = F.col("event_type")
    raw = F.when(k == "view", "").when(k == "click", "Cosine").when(k == "error", "DOT").when(
        k == "purchase", "L2").otherwise("manhattan")
    return D.table(spark, sf, "events").select(
        "event_id", F.coalesce(R.distance_name(raw, "flat"), F.lit("")).alias("flat"),
        R.distance_name(raw, "graph").alias("graph"))
