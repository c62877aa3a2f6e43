"""Sort, limit, top-k and the search core."""

from __future__ import annotations

from pyspark.sql import functions as F

from imgtrace.functions import vectors as V
from imgtrace.operators import hashjoin as HJ
from imgtrace.operators import knn
from imgtrace.operators import ranges as G
from imgtrace.operators import search as S
from imgtrace.plans import evaluation, jobs
from imgtrace.registry.base import i64, query, r6
from imgtrace.registry.derived_sql import cosine, dot, hamming_hex, with_
from imgtrace.registry.joins import KNN, coarse
from imgtrace.sources import derived as D

RESCORED = f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS vector_rank FROM (
      SELECT c.query_id, c.image_id, {cosine('q.vector', 'v.vector')} AS score
      FROM coarse c JOIN queries q USING (query_id)
      JOIN image_vectors v ON v.image_id = c.image_id AND v.model_id = 'copy64')) WHERE vector_rank <= 25"""
HITS = f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC,
        CASE WHEN exact THEN hash_distance END, score DESC, vector_rank) AS hit_rank FROM (
      SELECT *, hash_distance <= 5 AS exact FROM (
        SELECT r.query_id, r.image_id, r.score, r.vector_rank, g.source_site, g.source_post_id,
          {hamming_hex('q.phash', 'g.phash')} AS hash_distance
        FROM rescored r JOIN gallery g USING (image_id) JOIN queries q USING (query_id)))) WHERE hit_rank <= 5"""
SEARCH = {**KNN, "rescored": RESCORED, "hits": HITS}
_ALL = with_("gallery", "queries", "image_vectors", **SEARCH)
PAIRS = f"""
  SELECT q.query_id, q.answer_id, e.vec_id + 1 AS image_id, CAST({dot('q.vector', 'e.embedding')} AS FLOAT) AS score
  FROM {{}} q, embeddings e"""


@query("e4_topk_per_query", with_("gallery", "queries", **KNN) + """
SELECT query_id, image_id, distance, rank FROM coarse WHERE rank <= 7""")
def topk(spark, sf):
    return knn.topk_per_query(coarse(spark, sf).drop("rank"), 7, "distance", "image_id").select(
        "query_id", "image_id", "distance", i64("rank").alias("rank"))


@query("f1_coarse_scan", with_("gallery", "queries", **KNN) + """
SELECT query_id, image_id, distance, rank FROM coarse""")
def coarse_scan(spark, sf):
    return coarse(spark, sf).select("query_id", "image_id", "distance", i64("rank").alias("rank"))


@query("f2_rescore", _ALL + """
SELECT query_id, image_id, round(CAST(score AS DOUBLE), 6) AS score, vector_rank FROM rescored""")
def rescore(spark, sf):
    cands = S.fetch_originals(coarse(spark, sf), D.image_vectors(spark, sf), "copy64")
    return S.rescore(cands, D.queries(spark, sf), 25).select(
        "query_id", "image_id", r6("score").alias("score"), i64("vector_rank").alias("vector_rank"))


@query("f3_rerank", _ALL + """
SELECT query_id, bool_or(exact AND hit_rank = 1) AS exact_match, count(*) AS hits FROM hits GROUP BY query_id""")
def rerank(spark, sf):
    hits = _search(spark, sf)
    first = S.exact_match(hits)
    return hits.groupBy("query_id").agg(F.count("*").alias("hits")).join(first, "query_id")


def _search(spark, sf):
    return S.search(D.queries(spark, sf), D.codes(spark, sf), D.image_vectors(spark, sf),
                    D.gallery(spark, sf), "copy64", vector_size=D.vector_size("copy64"))


SEARCH_SQL = _ALL + """
SELECT query_id, hit_rank, image_id, source_site, source_post_id, round(CAST(score AS DOUBLE), 6) AS score,
  hash_distance, exact FROM hits"""


@query("f8_search", SEARCH_SQL)
def search(spark, sf):
    return _search(spark, sf).select(
        "query_id", i64("hit_rank").alias("hit_rank"), "image_id", "source_site", "source_post_id",
        r6("score").alias("score"), "hash_distance", "exact")


@query("f8_mixed_sizes", _ALL + """
SELECT query_id, hit_rank, image_id FROM hits""")
def mixed_sizes(spark, sf):
    """Queries of a wrong size among the others have no hits and cost nobody else theirs."""
    q = D.queries(spark, sf)
    odd = q.where("query_id % 10 = 0").withColumn("query_id", -F.col("query_id") - 1).withColumn(
        "vector", F.concat("vector", F.slice("vector", 1, 8)))
    return S.search(q.unionByName(odd), D.codes(spark, sf), D.image_vectors(spark, sf), D.gallery(spark, sf), "copy64",
                    vector_size=D.vector_size("copy64")).select("query_id", i64("hit_rank").alias("hit_rank"), "image_id")


@query("f4_exhausted_two_scopes", with_("crawl_ranges", two=D.TWO_SCOPES_SQL) + """
SELECT scope_key, id FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY upper_id DESC) AS r
  FROM two WHERE status = 'failed' AND attempts >= 5) WHERE r <= 50""")
def exhausted_two(spark, sf):
    return G.exhausted_ranges(D.two_scopes(spark, sf)).select("scope_key", "id")


@query("f4_exhausted_ranges", with_("crawl_ranges") + """
SELECT id, lower_id, upper_id, attempts FROM crawl_ranges WHERE status = 'failed' AND attempts >= 5
ORDER BY upper_id DESC LIMIT 50""")
def exhausted(spark, sf):
    return G.exhausted_ranges(D.crawl_ranges(spark, sf)).select("id", "lower_id", "upper_id", "attempts")


@query("f5_pending_vectors", with_("image_vectors") + """
SELECT image_id, model_id FROM image_vectors WHERE indexed_at IS NULL AND model_id = 'copy64'""")
def pending(spark, sf):
    return jobs.pending_vectors(D.image_vectors(spark, sf), "copy64").select("image_id", "model_id")


@query("f6_reusable_ranges", with_("crawl_ranges") + f"""
SELECT id, lower_id, upper_id, attempts, status FROM crawl_ranges WHERE attempts < 5 AND upper_id >= 5000 AND (
  (status = 'failed' AND ready_at <= TIMESTAMP '{D.ORDERS_NOW}')
  OR (status = 'running' AND leased_at < TIMESTAMP '{D.ORDERS_NOW}' - INTERVAL 30 MINUTE))""")
def reusable(spark, sf):
    return G.reusable_ranges(D.crawl_ranges(spark, sf), D.ORDERS_NOW, 5000).select(
        "id", "lower_id", "upper_id", "attempts", "status")


@query("f7_ready_retries", with_("retries") + f"""
SELECT id, source_post_id, attempts FROM retries WHERE attempts < 5 AND source_post_id >= 500 AND (
  (status = 'pending' AND ready_at <= TIMESTAMP '{D.ORDERS_NOW}')
  OR (status = 'running' AND leased_at < TIMESTAMP '{D.ORDERS_NOW}' - INTERVAL 30 MINUTE))""")
def ready_retries(spark, sf):
    return G.ready_retries(D.crawl_post_retries(spark, sf), D.ORDERS_NOW, 500).select(
        "id", "source_post_id", "attempts")


@query("f9_search_exact", with_("queries", pairs=f"""
  SELECT q.query_id, e.vec_id + 1 AS image_id, {cosine('q.vector', 'e.embedding')} AS score
  FROM queries q, embeddings e""") + """
SELECT query_id, image_id, round(CAST(score AS DOUBLE), 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM pairs) WHERE rank <= 5""")
def search_exact(spark, sf):
    return knn.nearest_vectors(D.queries(spark, sf), all_vectors(spark, sf), 5, width=D.vector_size("copy64")).select(
        "query_id", "image_id", r6("score").alias("score"), i64("rank").alias("rank"))


@query("f9_search_exact_euclid", with_("queries", pairs="""
  SELECT q.query_id, e.vec_id + 1 AS image_id,
    CAST(list_distance(CAST(q.vector AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS FLOAT) AS score
  FROM queries q, embeddings e""") + """
SELECT query_id, image_id, round(CAST(score AS DOUBLE), 5) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, image_id) AS rank FROM pairs) WHERE rank <= 3""")
def search_euclid(spark, sf):
    return knn.nearest_vectors(D.queries(spark, sf), all_vectors(spark, sf), 3, metric="euclid").select(
        "query_id", "image_id", F.round(F.col("score").cast("double"), 5).alias("score"))


def all_vectors(spark, sf):
    g = D.gallery(spark, sf)
    return g.select("image_id", F.col("embedding").alias("vector"), "phash", "label")


_HASH_PAIRS = f"""
  SELECT q.query_id, g.image_id, {hamming_hex('q.phash', 'g.phash')} AS distance FROM queries q, gallery g"""


@query("f10_hash_search", with_("gallery", "queries", pairs=_HASH_PAIRS) + """
SELECT query_id, image_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS rank FROM pairs) WHERE rank = 1""")
def hash_search(spark, sf):
    return S.hash_search(D.queries(spark, sf), D.gallery(spark, sf)).select(
        "query_id", "image_id", "distance")


@query("f10_hash_join", with_("gallery", "queries", pairs=_HASH_PAIRS) + """
SELECT query_id, count(*) AS matches, arg_min(image_id, (distance, image_id)) AS image_id, min(distance) AS distance
FROM pairs WHERE distance <= 5 GROUP BY query_id""")
def hash_join(spark, sf):
    """Pictures within five bits by bands of distinct hashes."""
    return HJ.hash_matches(D.queries(spark, sf), D.gallery(spark, sf))


@query("f10_same_pictures", with_("gallery", pairs=f"""
  SELECT a.image_id, b.image_id AS other, {hamming_hex('a.phash', 'b.phash')} AS d FROM gallery a, gallery b
  WHERE a.image_id <> b.image_id""") + """
SELECT image_id, count(*) FILTER (d <= 20) AS links, coalesce(arg_min(other, (d, other)) FILTER (d <= 20), -1) AS nearest,
  coalesce(min(d) FILTER (d <= 20), -1) AS distance FROM pairs GROUP BY image_id""")
def same_pictures(spark, sf):
    """The gallery against itself at twenty bits, where these hashes have neighbours."""
    return HJ.same_pictures(D.gallery(spark, sf), 20).fillna(-1, ["nearest", "distance"])


@query("f10_hash_search_near", with_("gallery", "queries", pairs=_HASH_PAIRS) + """
SELECT query_id, image_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS rank FROM pairs) WHERE rank = 1""")
def hash_search_near(spark, sf):
    """The join first; only what it leaves is scanned."""
    return HJ.hash_search_near(D.queries(spark, sf), D.gallery(spark, sf))


@query("f11_two_step_scores", with_("gallery", "queries", pairs=f"""
  SELECT q.query_id, g.image_id, {cosine('q.vector', 'g.embedding')} AS score,
    {hamming_hex('q.phash', 'g.phash')} AS distance FROM queries q, gallery g""") + """
SELECT query_id, CAST(-min(distance) AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank FROM pairs)
WHERE rank <= 20 GROUP BY 1""")
def two_step(spark, sf):
    return S.two_step_scores(D.queries(spark, sf), all_vectors(spark, sf), 20, width=D.vector_size("copy64"))


@query("e3_rank_of", with_("degraded", pairs=PAIRS.format("degraded")) + """
SELECT p.query_id, count(*) FILTER (p.score >= o.score AND p.image_id <> p.answer_id) AS rank
FROM pairs p JOIN (SELECT query_id, score FROM pairs WHERE image_id = answer_id) o USING (query_id) GROUP BY 1""")
def rank_of(spark, sf):
    return evaluation.vector_ranks(D.degraded(spark, sf), all_vectors(spark, sf), D.vector_size("copy64"))


@query("e3_rank_of_hash", with_("gallery", "degraded", pairs=f"""
  SELECT q.query_id, q.answer_id, g.image_id, {hamming_hex('q.phash', 'g.phash')} AS d FROM degraded q, gallery g""") + """
SELECT p.query_id, count(*) FILTER (p.d <= o.d AND p.image_id <> p.answer_id) AS rank
FROM pairs p JOIN (SELECT query_id, d FROM pairs WHERE image_id = answer_id) o USING (query_id) GROUP BY 1""")
def rank_of_hash(spark, sf):
    return evaluation.hash_ranks(D.degraded(spark, sf), D.gallery(spark, sf))
