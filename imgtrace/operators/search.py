"""Two-stage picture search: coarse code scan, cosine rescore, hash re-rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imgtrace.functions import hashes as H
from imgtrace.functions import posts as P
from imgtrace.functions import vectors as V
from imgtrace.operators import knn
from imgtrace.sources.buckets import bucket_of

# --- fixed values ---------------------------------------------------------
OVERSAMPLE = 4
MIN_COARSE = 40
DEFAULT_LIMIT = 5
DEFAULT_CANDIDATES = 25
# --------------------------------------------------------------------------

# Candidate rows (ids and a distance, about 24 bytes each) that may be broadcast.
MAX_SHIPPED_CANDIDATES = 1_000_000


@F.arrow_udf(T.FloatType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    x = a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1).astype(np.float64)
    y = b.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(norms == 0, 0.0, np.einsum("ij,ij->i", x, y) / norms)
    return pa.array(score.astype(np.float32))


def coarse_want(limit: int) -> int:
    return max(OVERSAMPLE * limit, MIN_COARSE)


def effective_candidates(limit: int, candidates: int) -> int:
    return limit * 4 if candidates < limit else candidates


def small_enough(shipped: knn.Shipped | None, rows_per_query: int) -> bool:
    """True when the candidate rows provably stay within the broadcast limit."""
    return shipped is not None and len(shipped) * rows_per_query <= MAX_SHIPPED_CANDIDATES


def _ship(df: DataFrame, proven: bool) -> DataFrame:
    return F.broadcast(df) if proven else df


def coarse_scan(queries: DataFrame, codes: DataFrame, limit: int,
                max_shipped: int = knn.MAX_SHIPPED_QUERIES,
                shipped: knn.Shipped | None = None, width: int | None = None) -> DataFrame:
    """queries(query_id, code) x codes(image_id, code) -> the nearest codes per query, each picture once."""
    near = knn.nearest_codes(queries, codes, coarse_want(limit), max_shipped=max_shipped,
                             shipped=shipped, width=width)
    once = Window.partitionBy("query_id", "image_id").orderBy("rank")
    return near.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")


def by_id(table: DataFrame, ids: DataFrame, proven: bool, span: int | None) -> DataFrame:
    """Join a stored table with few rows (image_id, ...).

    With a proven small side the table is not shuffled. Where it lies in buckets of `span` ids (`sources.buckets`), the
    bucket is a join key, too: it is a partition column, so only the buckets of these ids are read.
    """
    if span is None:
        return table.join(_ship(ids, proven), "image_id")
    # the bounds are no news for the rows, but tell the planner that this side picks some of them
    few = ids.where(F.col("image_id") > F.lit(-1 << 63)).withColumn("id_bucket", bucket_of("image_id", span))
    return table.join(_ship(few, proven), ["id_bucket", "image_id"]).drop("id_bucket")


def fetch_originals(cands: DataFrame, vectors: DataFrame, model_id: str,
                    proven: bool = False, span: int | None = None) -> DataFrame:
    """Stored vectors of the candidates; ids without one vanish. `span` as in `by_id`."""
    columns = ["image_id", "vector"] + (["id_bucket"] if span else [])
    of_model = vectors.where(F.col("model_id") == model_id).select(*columns)
    return by_id(of_model, cands, proven, span)


def rescore(cands: DataFrame, queries: DataFrame, limit: int, proven: bool = False) -> DataFrame:
    """Cosine on the originals; wrong sizes dropped; score desc, id asc, cut to limit."""
    q = queries.select("query_id", F.col("vector").alias("query_vector"))
    scored = (
        cands.join(_ship(q, proven), "query_id")
        .where(F.size("vector") == F.size("query_vector"))
        .select("query_id", "image_id", _cosine("query_vector", "vector").alias("score"))
    )
    return knn.topk_per_query(scored, limit, F.desc("score"), "image_id", rank="vector_rank")


def hydrate(hits: DataFrame, images: DataFrame, proven: bool = False, span: int | None = None) -> DataFrame:
    """Attach catalog columns; hits without a catalog row vanish. `span` as in `by_id`.

    The catalog's own post score is kept as `post_score`.
    """
    if "score" in images.columns:
        images = images.withColumnRenamed("score", "post_score")
    return by_id(images, hits, proven, span)


def rerank(hits: DataFrame, query_hashes: DataFrame, limit: int, proven: bool = False) -> DataFrame:
    """Bring hash-equal pictures to the front, then cut to `limit`.

    hits(query_id, image_id, score, vector_rank, phash, ...). Exact hits first,
    nearest hash first among them, then score; the rest keep their vector order.
    """
    qh = query_hashes.select("query_id", F.col("phash").alias("query_phash"))
    d = F.coalesce(H.hamming_hex(F.col("query_phash"), F.col("phash")), F.lit(H.NOT_COMPARABLE))
    joined = (
        hits.join(_ship(qh, proven), "query_id", "left")
        .withColumn("hash_distance", d)
        .withColumn("exact", (F.col("hash_distance") >= 0)
                    & (F.col("hash_distance") <= H.same_image_threshold(F.col("query_phash"))))
    )
    w = Window.partitionBy("query_id").orderBy(
        F.desc("exact"), F.when(F.col("exact"), F.col("hash_distance")), F.desc("score"),
        "vector_rank")
    return (
        joined.withColumn("hit_rank", F.row_number().over(w))
        .where(F.col("hit_rank") <= limit).drop("query_phash")
    )


def exact_match(hits: DataFrame) -> DataFrame:
    """Per query: is the first hit an exact one?"""
    return hits.where(F.col("hit_rank") == 1).select("query_id", F.col("exact").alias("exact_match"))


def search(queries: DataFrame, codes: DataFrame, vectors: DataFrame, images: DataFrame,
           model_id: str, limit: int = DEFAULT_LIMIT, candidates: int = DEFAULT_CANDIDATES,
           max_shipped: int = knn.MAX_SHIPPED_QUERIES, vector_size: int | None = None,
           span: int | None = None) -> DataFrame:
    """queries(query_id, vector, phash[, code]) -> at most `limit` ranked hits per query.

    A query of another size than the model's codes has no hits. Codes of other models are left out
    where the table says whose they are. `vector_size` is the model's, as its table has it; without it a pass over
    the codes finds their width. `span` says that the tables lie in buckets of so many ids (`by_id`).
    """
    if "model_id" in codes.columns:
        codes = codes.where(F.col("model_id") == model_id)
    candidates = effective_candidates(limit, candidates)
    if "code" not in queries.columns:
        queries = queries.withColumn("code", V.encode_sign(F.col("vector")))
    width = V.code_words(vector_size) if vector_size else knn.stored_width(codes, "code")
    shipped = knn.ship(queries, "code", max_shipped, width=width)
    proven = small_enough(shipped, coarse_want(candidates))
    cands = coarse_scan(queries, codes, candidates, max_shipped, shipped, width).select(
        "query_id", "image_id")
    originals = fetch_originals(cands, vectors, model_id, proven, span)
    scored = rescore(originals, queries, candidates, proven)
    hits = hydrate(scored, images, proven, span)
    return rerank(hits, queries, limit, proven)


def hit_view(hits: DataFrame) -> DataFrame:
    """Public projection of a hit: shortened tags, only usable links."""
    links = P.http_links(F.col("canonical_url"), F.col("source_url"), F.col("preview_url"))
    return hits.select(
        "query_id", "hit_rank", "source_site", "source_post_id",
        P.post_label(F.col("source_site"), F.col("source_post_id"), F.col("artist_tags"))
        .alias("label"),
        links.alias("links"), P.rating_label(F.col("rating")).alias("rating"),
        P.visible_tags(F.col("tags")).alias("tags"), "score", "hash_distance", "exact")


def hash_search(queries: DataFrame, gallery: DataFrame, k: int = 1,
                max_shipped: int = knn.MAX_SHIPPED_QUERIES) -> DataFrame:
    """Nearest pictures by perceptual hash alone: (query_id, phash) x (image_id, phash)."""
    word = F.array(H.hash_to_long(F.col("phash")))
    ok = H.hash_to_long(F.col("phash")).isNotNull()
    return knn.nearest_codes(
        queries.where(ok).select("query_id", word.alias("code")),
        gallery.where(ok).select("image_id", word.alias("code")), k, max_shipped=max_shipped, width=1)


def two_step_scores(queries: DataFrame, gallery: DataFrame, topk: int,
                    max_shipped: int = knn.MAX_SHIPPED_QUERIES, width: int | None = None) -> DataFrame:
    """Vector top-k, then the smallest hash distance inside it; score is its negative."""
    width = width or knn.stored_width(gallery, "vector")
    shipped = knn.ship(queries, "vector", max_shipped, width=width)
    near = knn.nearest_vectors(queries, gallery, topk, max_shipped=max_shipped, shipped=shipped, width=width)
    pairs = _hash_pairs(near.select("query_id", "image_id"), queries, gallery, small_enough(shipped, topk))
    return pairs.groupBy("query_id").agg((-F.min("distance")).cast("double").alias("score"))


def _hash_pairs(near: DataFrame, queries: DataFrame, gallery: DataFrame, proven: bool) -> DataFrame:
    """near(query_id, image_id, ...) with the hash distance of each pair."""
    g = gallery.select("image_id", F.col("phash").alias("image_phash"))
    pairs = g.join(_ship(near, proven), "image_id").join(
        _ship(queries.select("query_id", F.col("phash").alias("query_phash")), proven), "query_id")
    return pairs.withColumn("distance", H.hamming_hex(F.col("query_phash"), F.col("image_phash")))


def vector_and_two_step_scores(queries: DataFrame, gallery: DataFrame, topk: int,
                               max_shipped: int = knn.MAX_SHIPPED_QUERIES, width: int | None = None) -> DataFrame:
    """(query_id, vector, two_step): the best inner product and `two_step_scores`, from one scan of the gallery."""
    width = width or knn.stored_width(gallery, "vector")
    shipped = knn.ship(queries, "vector", max_shipped, width=width)
    near = knn.nearest_and_best_dot(queries, gallery, topk, max_shipped=max_shipped, shipped=shipped, width=width)
    pairs = _hash_pairs(near.select("query_id", "image_id", "measure", "score"), queries, gallery,
                        small_enough(shipped, topk + 1))
    of = lambda measure, c: F.when(F.col("measure") == measure, F.col(c))
    return pairs.groupBy("query_id").agg(
        F.max(of("dot", "score")).cast("double").alias("vector"),
        (-F.min(of("cosine", "distance"))).cast("double").alias("two_step"))


def cached_queries(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Join requests to the query cache; an entry without a hash counts as a miss."""
    usable = cache.where(F.coalesce(F.col("phash"), F.lit("")) != "")
    return requests.join(usable, ["sha256", "model_id"], "left").withColumn(
        "hit", F.col("phash").isNotNull())
