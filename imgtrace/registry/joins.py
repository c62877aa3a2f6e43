"""Joins, set-difference checks and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtrace.functions import vectors as V
from imgtrace.operators import knn
from imgtrace.operators import merge as M
from imgtrace.operators import search as S
from imgtrace.operators import setdiff as X
from imgtrace.registry.base import query, r6, ts_text
from imgtrace.registry.derived_sql import cosine, hexword, with_
from imgtrace.registry.derived_sql import ts_text as sql_ts
from imgtrace.registry.sources import posts
from imgtrace.sources import derived as D

ACTIVE = ["copy64", "sem32"]

_WORDS = f"""
  SELECT image_id, {hexword('phash', 1)} AS hi, {hexword('phash', 9)} AS lo
  FROM gallery WHERE label <> 7"""
_QWORDS = f"SELECT query_id, {hexword('phash', 1)} AS hi, {hexword('phash', 9)} AS lo FROM queries"
COARSE = """
  SELECT * FROM (
    SELECT query_id, image_id, CAST(d AS INTEGER) AS distance,
           row_number() OVER (PARTITION BY query_id ORDER BY d, image_id) AS rank
    FROM (SELECT q.query_id, c.image_id, bit_count(xor(q.hi, c.hi)) + bit_count(xor(q.lo, c.lo)) AS d
          FROM qwords q, words c)) WHERE rank <= 100"""
KNN = {"words": _WORDS, "qwords": _QWORDS, "coarse": COARSE}


def coarse(spark, sf, limit=25):
    q = D.queries(spark, sf).select("query_id", V.encode_sign(F.col("vector")).alias("code"))
    return S.coarse_scan(q, D.codes(spark, sf), limit, width=V.code_words(D.vector_size("copy64")))


@query("c1_hydrate", with_("gallery", "queries", **KNN) + """
SELECT query_id, image_id, distance, source_site, source_post_id
FROM coarse JOIN gallery USING (image_id)""")
def hydrate(spark, sf):
    return S.hydrate(coarse(spark, sf), D.gallery(spark, sf)).select(
        "query_id", "image_id", "distance", "source_site", "source_post_id")


@query("c2_fetch_originals", with_("gallery", "queries", "image_vectors", **KNN) + """
SELECT query_id, image_id, CAST(len(vector) AS INTEGER) AS n FROM coarse JOIN image_vectors USING (image_id)
WHERE model_id = 'sem32'""")
def fetch_originals(spark, sf):
    return S.fetch_originals(coarse(spark, sf), D.image_vectors(spark, sf), "sem32").select(
        "query_id", "image_id", F.size("vector").alias("n"))


@query("c3_fully_indexed", with_("done_images", "done_vectors") + """
SELECT image_id, source_post_id FROM done_images i
WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('copy64'), ('sem32')) m(model_id)
  WHERE NOT EXISTS (SELECT 1 FROM done_vectors v WHERE v.image_id = i.image_id AND v.model_id = m.model_id))""")
def fully_indexed(spark, sf):
    return X.fully_indexed(D.done_images(spark, sf), D.done_vectors(spark, sf), ACTIVE).select(
        "image_id", "source_post_id")


@query("c3_fully_indexed_no_models", with_("done_images") + "SELECT image_id, source_post_id FROM done_images")
def fully_indexed_none(spark, sf):
    return X.fully_indexed(D.done_images(spark, sf), D.done_vectors(spark, sf), []).select(
        "image_id", "source_post_id")


@query("c4_vectors_missing", with_("gallery", "image_vectors") + """
SELECT image_id FROM gallery g WHERE NOT EXISTS (
  SELECT 1 FROM image_vectors v WHERE v.image_id = g.image_id AND model_id = 'sem32')""")
def vectors_missing(spark, sf):
    return X.vectors_missing(D.gallery(spark, sf).select("image_id"), D.image_vectors(spark, sf), "sem32")


_MISSING = """
SELECT image_id, thumb_path FROM gallery g WHERE coalesce(thumb_path, '') <> '' AND NOT EXISTS (
  SELECT 1 FROM image_vectors v WHERE v.image_id = g.image_id AND model_id = 'sem32')"""


@query("c5_thumbs_missing_vector", with_("gallery", "image_vectors") + _MISSING)
def thumbs_missing(spark, sf):
    return X.thumbs_missing_vector(D.gallery(spark, sf), D.image_vectors(spark, sf), "sem32").select(
        "image_id", "thumb_path")


@query("c5_thumbs_missing_page", with_("gallery", "image_vectors", page="""
  SELECT * FROM gallery WHERE coalesce(thumb_path, '') <> '' AND image_id > 20 ORDER BY image_id LIMIT 256""") + """
SELECT image_id, (SELECT max(image_id) FROM page) AS cursor FROM page p WHERE NOT EXISTS (
  SELECT 1 FROM image_vectors v WHERE v.image_id = p.image_id AND model_id = 'sem32')""")
def thumbs_missing_page(spark, sf):
    missing, cursor = X.thumbs_missing_page(
        D.gallery(spark, sf), D.image_vectors(spark, sf), "sem32", 20, 256)
    return missing.select("image_id", cursor.scalar().alias("cursor"))


_COUNTS = """
SELECT m.model_id, (SELECT count(*) FROM gallery g WHERE coalesce(thumb_path, '') <> '' AND NOT EXISTS (
    SELECT 1 FROM image_vectors v WHERE v.image_id = g.image_id AND v.model_id = m.model_id)) AS missing
FROM models m WHERE active"""


@query("c6_count_thumbs_missing", with_("gallery", "image_vectors", "models") + _COUNTS)
def count_missing(spark, sf):
    return X.missing_by_model(D.gallery(spark, sf), D.image_vectors(spark, sf), D.models(spark))


@query("c7_edge_join", with_("node_metrics") + f"""
SELECT b.node_id, {sql_ts('first_at')} AS first_at, {sql_ts('last_at')} AS last_at, f.saved AS first_saved,
  l.saved AS last_saved
FROM (SELECT node_id, min(observed_at) AS first_at, max(observed_at) AS last_at FROM node_metrics GROUP BY 1) b
JOIN node_metrics f ON f.node_id = b.node_id AND f.observed_at = first_at
JOIN node_metrics l ON l.node_id = b.node_id AND l.observed_at = last_at""")
def edge_join(spark, sf):
    from imgtrace.operators import fleet

    e = fleet.first_last_per_node(D.node_metrics(spark, sf))
    return e.select(
        "node_id", ts_text("first.observed_at").alias("first_at"), ts_text("last.observed_at").alias("last_at"),
        F.col("first.saved").alias("first_saved"), F.col("last.saved").alias("last_saved"))


def _reported(spark, sf):
    """Supplier as node: reports by nation; some lack a model, some have another size."""
    s = D.table(spark, sf, "supplier")
    n = F.col("s_nationkey")
    return s.withColumn("r", F.explode(F.array(
        F.struct(F.lit("copy64").alias("model_id"), F.when(n < 5, 32).otherwise(64).alias("vector_size")),
        F.struct(F.when(n >= 20, "extra").otherwise("sem32").alias("model_id"),
                 F.lit(32).alias("vector_size"))))).select(
        F.col("s_name").alias("node_id"), "r.model_id", "r.vector_size")


@query("c8_verify_node_models", """
SELECT s_name AS node_id, 'copy64' AS model_id, 64 AS want_size, 32 AS got_size FROM supplier WHERE s_nationkey < 5
UNION ALL SELECT s_name, 'sem32', 32, -1 FROM supplier WHERE s_nationkey >= 20""")
def verify_node_models(spark, sf):
    bad = X.verify_node_models(X.active_models(D.models(spark)), _reported(spark, sf))
    return bad.select("node_id", "model_id", "want_size", F.coalesce("got_size", F.lit(-1)).alias("got_size"))


@query("c9_dead_node_leases", with_("crawl_ranges", "nodes") + f"""
SELECT id, node_id FROM crawl_ranges WHERE status = 'running' AND node_id IS NOT NULL AND node_id NOT IN (
  SELECT node_id FROM nodes WHERE status = 'online'
    AND heartbeat_at > TIMESTAMP '{D.EVENTS_NOW}' - INTERVAL 2400 SECOND)""")
def dead_leases(spark, sf):
    return X.dead_node_leases(D.crawl_ranges(spark, sf), D.nodes(spark, sf), D.EVENTS_NOW, 2400).select(
        "id", "node_id")


@query("c10_rebuild_points", with_("gallery", "image_vectors") + """
SELECT v.image_id, model_id, coalesce(g.source_site, '') AS source_site, coalesce(g.source_post_id, 0) AS source_post_id,
  coalesce(g.phash, '') AS phash
FROM image_vectors v LEFT JOIN (SELECT * FROM gallery WHERE label <> 4) g ON g.image_id = v.image_id""")
def rebuild_points(spark, sf):
    images = D.gallery(spark, sf).where(F.col("label") != 4).withColumn("dhash", F.lit(""))
    return X.rebuild_points(D.image_vectors(spark, sf), images).select(
        "image_id", "model_id", "payload.source_site", "payload.source_post_id", "payload.phash")


def _items(spark, sf):
    """Every vector as an ingest item; faults by label."""
    e = D.table(spark, sf, "embeddings")
    lab = F.col("label")
    nan = F.transform("embedding", lambda x, i: F.when(i == 3, float("nan")).otherwise(x).cast("float"))
    rows = F.array(
        F.struct(F.lit("copy64").alias("model_id"), F.when(lab == 1, nan).otherwise(F.col("embedding"))
                 .alias("vector"), (lab != 0).alias("keep")),
        F.struct(F.lit("sem32").alias("model_id"),
                 F.slice("embedding", 1, F.when(lab == 2, 31).otherwise(32)).alias("vector"),
                 F.lit(True).alias("keep")),
        F.struct(F.lit("extra").alias("model_id"), F.slice("embedding", 1, 8).alias("vector"),
                 (lab == 3).alias("keep")))
    v = e.select(F.col("vec_id").alias("item_id"), F.explode(rows).alias("r")).where("r.keep")
    return e.select(F.col("vec_id").alias("item_id")), v.select("item_id", "r.model_id", "r.vector")


@query("c11_validate_vectors", """
SELECT vec_id AS item_id,
  CASE label WHEN 0 THEN 'model mismatch' WHEN 1 THEN 'bad vector' WHEN 2 THEN 'model mismatch' ELSE '' END AS fault,
  CASE label WHEN 0 THEN 'copy64' WHEN 1 THEN 'copy64' WHEN 2 THEN 'sem32' ELSE '' END AS fault_model,
  CASE label WHEN 3 THEN 1 ELSE 0 END::BIGINT AS unregistered FROM embeddings""")
def validate(spark, sf):
    items, vectors = _items(spark, sf)
    return X.validate_vectors(items, vectors, X.active_models(D.models(spark))).select(
        "item_id", F.coalesce("fault", F.lit("")).alias("fault"),
        F.coalesce("fault_model", F.lit("")).alias("fault_model"), "unregistered")


@query("c12_knn_join", with_("gallery", "queries", **KNN) + """
SELECT query_id, image_id, distance, rank FROM coarse WHERE rank <= 10""")
def knn_join(spark, sf):
    q = D.queries(spark, sf).select("query_id", V.encode_sign(F.col("vector")).alias("code"))
    return knn.nearest_codes(q, D.codes(spark, sf), 10).select(
        "query_id", "image_id", "distance", F.col("rank").cast("bigint").alias("rank"))


@query("c13_explain_missing", with_("crawl_ranges", "states", "done_images") + """
SELECT o_orderkey * 12 AS source_post_id, d.image_id IS NOT NULL AS indexed,
  CASE WHEN d.image_id IS NOT NULL THEN '' WHEN o_orderkey * 12 > high_watermark_id THEN 'newer'
    WHEN o_orderkey * 12 < backfill_before_id THEN 'not reached'
    WHEN (SELECT count(*) FROM crawl_ranges WHERE status = 'failed' AND attempts >= 5) > 0 THEN 'exhausted'
    ELSE 'deleted or unsupported' END AS reason
FROM orders CROSS JOIN states s LEFT JOIN done_images d ON d.source_post_id = o_orderkey * 12""")
def explain_missing(spark, sf):
    ids = D.table(spark, sf, "orders").select(
        F.lit(D.SITE).alias("source_site"), (F.col("o_orderkey") * 12).alias("source_post_id"))
    return X.explain_missing(ids, D.done_images(spark, sf), D.crawl_states(spark, sf),
                             D.crawl_ranges(spark, sf)).drop("source_site")


# --- upserts --------------------------------------------------------------

def _image_arrivals(spark, sf):
    """New feed state of every picture, each arriving twice; the later one counts."""
    g = D.gallery(spark, sf)
    again = F.explode(F.array(F.lit(1), F.lit(2)))
    lab = F.col("label")
    new = g.withColumn("arrival", again).select(
        "source_site", (F.col("source_post_id") + F.when(lab == 9, 1_000_000).otherwise(0))
        .alias("source_post_id"),
        F.when(lab == 6, "").otherwise("q").alias("rating"),
        (F.col("score") + F.col("arrival")).cast("int").alias("score"),
        F.when(lab == 2, "").otherwise("00000000000000ff").alias("phash"),
        F.lit("").alias("thumb_path"),
        F.when(lab == 5, F.lit(None)).otherwise(F.col("tags")).cast("array<string>").alias("tags"), "arrival")
    old = g.where(lab != 8).select(
        "image_id", "source_site", "source_post_id", F.nullif("rating", F.lit("")).alias("rating"), "score",
        "phash", F.nullif("thumb_path", F.lit("")).alias("thumb_path"), "tags",
        D.ts("2024-01-01 00:00:00").alias("created_at"), D.ts("2024-01-01 00:00:00").alias("updated_at"))
    return old, new


@query("c14_upsert_images", with_("gallery", merged="""
  SELECT coalesce(o.source_site, n.source_site) AS source_site, coalesce(o.source_post_id, n.source_post_id) AS source_post_id,
    o.image_id, CASE WHEN n.source_post_id IS NULL THEN nullif(o.rating, '') WHEN n.label = 6 THEN NULL ELSE 'q' END AS rating,
    CASE WHEN n.source_post_id IS NULL THEN o.score ELSE n.score + 2 END AS score,
    CASE WHEN n.source_post_id IS NULL OR n.label = 2 THEN o.phash ELSE '00000000000000ff' END AS phash,
    nullif(o.thumb_path, '') AS thumb_path,
    CASE WHEN n.source_post_id IS NULL THEN o.tags WHEN n.label = 5 THEN [] ELSE n.tags END AS tags,
    o.image_id IS NOT NULL AS is_old, n.source_post_id IS NOT NULL AS is_new
  FROM (SELECT * FROM gallery WHERE label <> 8) o
  FULL JOIN (SELECT * REPLACE (source_post_id + CASE WHEN label = 9 THEN 1000000 ELSE 0 END AS source_post_id) FROM gallery) n
    ON n.source_site = o.source_site AND n.source_post_id = o.source_post_id""") + """
SELECT source_site, source_post_id,
  CAST(coalesce(image_id, (SELECT max(image_id) FROM gallery WHERE label <> 8)
    + row_number() OVER (PARTITION BY is_old ORDER BY source_post_id, source_site)) AS BIGINT) AS image_id,
  coalesce(rating, '') AS rating, CAST(score AS INTEGER) AS score, coalesce(phash, '') AS phash,
  coalesce(thumb_path, '') AS thumb_path, array_to_string(tags, ' ') AS tags,
  CASE WHEN is_old THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END AS created_at,
  CASE WHEN is_new THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS updated_at
FROM merged""")
def upsert_images(spark, sf):
    old, new = _image_arrivals(spark, sf)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return M.upsert_images(old, new, "2024-02-01 00:00:00").select(
        "source_site", "source_post_id", "image_id", blank("rating"), "score", blank("phash"),
        blank("thumb_path"), F.array_join("tags", " ").alias("tags"),
        ts_text("created_at").alias("created_at"), ts_text("updated_at").alias("updated_at"))


def _merged_vectors(spark, sf):
    old = D.image_vectors(spark, sf)
    new = D.queries(spark, sf).where(F.col("label").isin(7, 8, 9)).select(
        F.col("answer_id").alias("image_id"), F.lit("copy64").alias("model_id"), "vector",
        F.lit(1).alias("arrival"))
    return M.upsert_vectors(old, new, "2024-02-01 00:00:00")


@query("c15_upsert_vectors", with_("image_vectors", "queries") + """
SELECT coalesce(o.image_id, n.image_id) AS image_id, coalesce(o.model_id, n.model_id) AS model_id,
  round(CAST(coalesce(n.vector, o.vector)[1] AS DOUBLE), 6) AS first_value,
  n.image_id IS NULL AND o.indexed_at IS NOT NULL AS indexed,
  CASE WHEN o.image_id IS NULL THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS created_at
FROM image_vectors o FULL JOIN (SELECT answer_id AS image_id, 'copy64' AS model_id, vector FROM queries
                                WHERE label IN (7, 8, 9)) n
  ON n.image_id = o.image_id AND n.model_id = o.model_id""")
def upsert_vectors(spark, sf):
    return _merged_vectors(spark, sf).select(
        "image_id", "model_id", r6(F.element_at("vector", 1)).alias("first_value"),
        F.col("indexed_at").isNotNull().alias("indexed"), ts_text("created_at").alias("created_at"))


@query("c16_mark_indexed", with_("gallery", "image_vectors") + """
SELECT image_id, model_id, CASE WHEN model_id = 'sem32' AND g.label IN (3, 4) THEN '2024-02-01 00:00:00'
  WHEN indexed_at IS NULL THEN '' ELSE '2024-01-01 00:00:00' END AS indexed_at
FROM image_vectors JOIN gallery g USING (image_id)""")
def mark_indexed(spark, sf):
    ids = D.gallery(spark, sf).where(F.col("label").isin(3, 4)).select("image_id")
    return M.mark_indexed(D.image_vectors(spark, sf), ids, ["sem32"], "2024-02-01 00:00:00").select(
        "image_id", "model_id", F.coalesce(ts_text("indexed_at"), F.lit("")).alias("indexed_at"))


@query("c17_upsert_model", with_("image_vectors") + """
SELECT m.model_id, m.active, coalesce(n, 0) AS vectors
FROM (VALUES ('copy64', FALSE), ('sem32', TRUE), ('old64', TRUE)) m(model_id, active)
LEFT JOIN (SELECT model_id, count(*) AS n FROM image_vectors GROUP BY 1) v ON v.model_id = m.model_id""")
def upsert_model(spark, sf):
    models = M.upsert_model(D.models(spark), {
        "model_id": "old64", "kind": "copy", "vector_size": 64, "distance": "cosine", "input_size": 224,
        "active": True})
    n = D.image_vectors(spark, sf).groupBy("model_id").agg(F.count("*").alias("n"))
    return models.join(n, "model_id", "left").select(
        "model_id", "active", F.coalesce("n", F.lit(0)).alias("vectors"))


def _cache(spark, sf):
    """Documents as past queries, keyed by the digest of their text."""
    d = D.table(spark, sf, "documents")
    sha = F.sha2("text", 256)
    entry = d.groupBy(sha.alias("sha256")).agg(F.min("doc_id").alias("first_doc"))
    return entry.select(
        "sha256", F.lit("copy64").alias("model_id"), F.array(F.col("first_doc").cast("float")).alias("vector"),
        F.when(F.col("first_doc") % 2 == 0, "00000000000000aa").otherwise("").alias("phash"),
        F.lit(0).cast("bigint").alias("hits"), D.ts("2024-01-01 00:00:00").alias("last_used_at"))


@query("c18_cache_put", """
SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, 0::BIGINT AS hits,
  CASE WHEN bool_or(lang = 'en') THEN '00000000000000bb' WHEN min(doc_id) % 2 = 0 THEN '00000000000000aa' ELSE '' END AS phash,
  CASE WHEN bool_or(lang = 'en') THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS last_used_at
FROM documents GROUP BY 1""")
def cache_put(spark, sf):
    new = D.table(spark, sf, "documents").where(F.col("lang") == "en").select(
        F.sha2("text", 256).alias("sha256"), F.lit("copy64").alias("model_id"),
        F.array(F.lit(-1.0).cast("float")).alias("vector"), F.lit("00000000000000bb").alias("phash"),
        F.col("doc_id").alias("arrival"))
    return M.put_queries(_cache(spark, sf), new, "2024-02-01 00:00:00").select(
        "sha256", F.element_at("vector", 1).cast("bigint").alias("first_doc"), "hits", "phash",
        ts_text("last_used_at").alias("last_used_at"))


@query("c18_cache_hit", """
SELECT sha256(text) AS sha256, CASE WHEN min(doc_id) % 2 = 0 THEN count(*) ELSE 0 END AS hits
FROM documents GROUP BY 1""")
def cache_hit(spark, sf):
    log = D.table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("sha256"), F.lit("copy64").alias("model_id"),
        D.ts("2024-01-02 00:00:00").alias("at"))
    return M.count_hits(_cache(spark, sf), log).select("sha256", "hits")


@query("c18_cached_queries", """
SELECT d.doc_id, (min(doc_id) OVER (PARTITION BY sha256(text))) % 2 = 0 AS hit FROM documents d""")
def cached_queries(spark, sf):
    req = D.table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.lit("copy64").alias("model_id"))
    return S.cached_queries(req, _cache(spark, sf)).select("doc_id", "hit")


@query("c19_enqueue_retries", with_("retries", ids="""
  SELECT DISTINCT l_partkey AS source_post_id FROM lineitem WHERE l_returnflag = 'R'""") + f"""
SELECT coalesce(o.source_post_id, i.source_post_id) AS source_post_id,
  CASE WHEN i.source_post_id IS NOT NULL AND coalesce(o.status, '') <> 'succeeded' THEN 'pending' ELSE o.status END AS status,
  coalesce(o.attempts, 0) AS attempts,
  CASE WHEN i.source_post_id IS NOT NULL AND coalesce(o.status, '') <> 'succeeded' THEN '1998-12-01 00:01:00'
    ELSE {sql_ts('o.ready_at')} END AS ready_at
FROM retries o FULL JOIN ids i ON i.source_post_id = o.source_post_id""")
def enqueue_retries(spark, sf):
    ids = D.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.lit(D.SITE).alias("source_site"), F.lit(D.SCOPE).alias("scope_key"),
        F.col("l_partkey").alias("source_post_id"))
    return M.enqueue_retries(D.crawl_post_retries(spark, sf), ids, D.ORDERS_NOW).select(
        "source_post_id", "status", "attempts", ts_text("ready_at").alias("ready_at"))


@query("c20_record_probe", with_("probe_log") + """
SELECT node_id, host, mode, ok, coalesce(latency_ms, -1) AS latency_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id, host, mode ORDER BY seq DESC) AS rn FROM probe_log) WHERE rn = 1""")
def record_probe(spark, sf):
    return M.record_probes(D.probe_log(spark, sf), "seq").select(
        "node_id", "host", "mode", "ok", F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms"))


@query("c20_record_metrics", with_("node_metrics") + """
SELECT node_id, count(*) AS samples, sum(saved)::BIGINT AS saved FROM node_metrics GROUP BY 1""")
def record_metrics(spark, sf):
    m = D.node_metrics(spark, sf)
    old = m.where(F.col("failed") > 0)
    return M.record_metrics(old, m.withColumn("saved", F.col("saved"))).groupBy("node_id").agg(
        F.count("*").alias("samples"), F.sum("saved").alias("saved"))


@query("c21_init_state", with_("crawl_ranges", "states") + """
SELECT 'site0' AS source_site, 'default' AS scope_key,
  greatest(max(s.high_watermark_id), max(r.upper_id) + 5) AS high_watermark_id,
  max(s.backfill_before_id) AS backfill_before_id FROM crawl_ranges r, states s""")
def init_state(spark, sf):
    new = D.crawl_ranges(spark, sf).select(
        "source_site", "scope_key", (F.col("upper_id") + 5).alias("latest_id"))
    return M.init_state(D.crawl_states(spark, sf), new)


@query("c21_advance_watermark", with_("posts", "states") + """
SELECT source_site, scope_key, greatest(high_watermark_id, (SELECT max(id) FROM posts)) AS high_watermark_id FROM states""")
def advance(spark, sf):
    seen = posts(spark, sf).withColumn("scope_key", F.lit(D.SCOPE))
    return M.advance_watermark(D.crawl_states(spark, sf), seen).select(
        "source_site", "scope_key", "high_watermark_id")
