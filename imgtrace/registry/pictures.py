"""Per-picture jobs and evaluation, on pictures derived from the vector table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.functions import vectors as V
from imgtrace.operators import evaluate as E
from imgtrace.operators import masks as K
from imgtrace.operators import pixels as X
from imgtrace.operators import search as S
from imgtrace.operators import setdiff
from imgtrace.plans import bucket_jobs, evaluation, jobs
from imgtrace.registry import pixel_sql as Q
from imgtrace.registry.base import i64, query, r6, ts_text
from imgtrace.registry.derived_sql import dot, hamming_hex, with_
from imgtrace.registry.joins import KNN, coarse
from imgtrace.registry.reports import REPORT_SQL, _SCORED, round5, scores
from imgtrace.registry.search import SEARCH_SQL, all_vectors
from imgtrace.session import materialize, scratch_path
from imgtrace.sources import buckets as B
from imgtrace.sources import derived as D
from imgtrace.sources import pictures as A

WIDTH, HEIGHT = 120, 96


def pictures(spark, sf, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spread the (small) vectors over the cores before they grow into pixels."""
    v = all_vectors(spark, sf).repartition(spark.sparkContext.defaultParallelism, "image_id")
    return X.pictures_from_vectors(v, WIDTH, HEIGHT, keep=keep)


def _bitmap(pixels: bytes, width: int, height: int) -> bytes:
    """24-bit bitmap file; rows bottom-up, padded to four bytes."""
    rows = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width * 3)[::-1]
    rows = np.pad(rows, ((0, 0), (0, -width * 3 % 4)))
    size = rows.size
    head = b"BM" + np.array([54 + size, 0, 54, 40, width, height], "<u4").tobytes()
    head += np.array([1, 24], "<u2").tobytes() + np.array([0, size, 2835, 2835, 0, 0], "<u4").tobytes()
    return head + rows.tobytes()


def _write_files(df: DataFrame, folder: str) -> None:
    """One file per picture, in whatever store the folder's address names; pictures of label 6 are cut short."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for i, p, w, h, label in zip(pdf["image_id"], pdf["pixels"], pdf["width"], pdf["height"],
                                         pdf["label"]):
                data = _bitmap(p, w, h)
                with store.open_output_stream(f"{root}/{i}.bmp") as f:
                    f.write(data[:20] if label == 6 else data)
            yield pd.DataFrame({"n": [len(pdf)]})

    df.mapInPandas(run, "n long").agg(F.sum("n")).collect()


@query("a6_read_images", f"""
SELECT vec_id + 1 AS image_id, CASE WHEN label = 6 THEN 20 ELSE 54 + {WIDTH * HEIGHT * 3} END AS length,
  CASE WHEN label = 6 THEN 0 ELSE {WIDTH} END AS width, CASE WHEN label = 6 THEN 0 ELSE {HEIGHT} END AS height,
  CASE WHEN label = 6 THEN 'undecodable' ELSE '' END AS reject, label <> 6 AS same
FROM embeddings""")
def read_images(spark, sf):
    folder = scratch_path(spark, "pictures")
    _write_files(pictures(spark, sf, ("label",)), folder)
    # pictures become digests where they are read or made, none is shuffled
    back = A.read_images(spark, folder).select(
        F.regexp_extract("path", r"(\d+)\.bmp$", 1).cast("bigint").alias("image_id"),
        "length", "width", "height", "reject", F.md5("pixels").alias("found"))
    j = back.join(pictures(spark, sf).select("image_id", F.md5("pixels").alias("want")), "image_id")
    good = F.col("reject").isNull()
    return j.select(
        "image_id", F.col("length").cast("int").alias("length"),
        F.when(good, F.col("width")).otherwise(0).alias("width"),
        F.when(good, F.col("height")).otherwise(0).alias("height"),
        F.coalesce("reject", F.lit("")).alias("reject"),
        F.coalesce(F.col("found") == F.col("want"), F.lit(False)).alias("same"))


def grey_pictures(spark, sf) -> DataFrame:
    v = all_vectors(spark, sf).repartition(spark.sparkContext.defaultParallelism, "image_id")
    return X.pictures_from_vectors(v, Q.WIDTH, Q.HEIGHT, color=False)


def _prepared(spark, sf) -> DataFrame:
    return X.prepare_pixels(grey_pictures(spark, sf))


@query("i1_prepare_pixels", with_(**Q.HASHED, p=Q.hex_md5("pic"), h=Q.hex_md5("hashed", Q.GREY_BYTE)) + f"""
SELECT image_id, {Q.WIDTH} AS width, {Q.HEIGHT} AS height, {Q.WIDTH} AS prep_width, {Q.HASH_WIDTH} AS hash_width,
  {Q.HASH_HEIGHT} AS hash_height, p.md5 AS prep_md5, h.md5 AS hash_md5 FROM p JOIN h USING (image_id)""")
def prepare_pixels(spark, sf):
    return _prepared(spark, sf).select(
        "image_id", "width", "height", "prep_width", "hash_width", "hash_height",
        F.md5(F.hex("prep_pixels")).alias("prep_md5"), F.md5(F.hex("hash_pixels")).alias("hash_md5"))


@query("i2_phash", with_(**Q.PHASH) + Q.PHASH_SQL)
def phash(spark, sf):
    return X.phash(_prepared(spark, sf))


@query("i3_dhash", with_(**Q.DHASH) + Q.DHASH_SQL)
def dhash(spark, sf):
    return X.dhash(_prepared(spark, sf))


ENCODERS = [X.BlockEncoder("copy64", 64), X.BlockEncoder("sem32", 32)]


@query("i4_embed", with_(**Q.EMBED) + Q.EMBED_SQL)
def embed(spark, sf):
    v = X.embed(_prepared(spark, sf), ENCODERS)
    weighted = F.aggregate(
        F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("image_id", "model_id", F.size("vector").alias("n"), F.round(weighted, 3).alias("weighted"))


@query("i5_degrade", with_(**Q.DEGRADE) + Q.DEGRADE_SQL)
def degrade(spark, sf):
    return X.degrade(grey_pictures(spark, sf)).select(
        "image_id", "degradation", "width", "height", F.md5(F.hex("pixels")).alias("pixels_md5"))


@query("i6_sample_split", """
WITH k AS (SELECT doc_id, CAST('0x' || substr(md5(doc_id || ':7'), 1, 13) AS BIGINT) AS k,
             CAST('0x' || substr(md5(doc_id || ':8'), 1, 13) AS BIGINT) AS k2,
             (SELECT count(*) FROM documents) AS n FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY k, doc_id) AS shuffle_no FROM k)
SELECT doc_id, shuffle_no, CASE WHEN shuffle_no <= n // 2 THEN 'gallery' ELSE 'held_out' END AS part,
  shuffle_no <= n // 2 AND row_number() OVER (PARTITION BY shuffle_no <= n // 2 ORDER BY k2, doc_id) <= n // 4 AS is_probe
FROM s WHERE shuffle_no <= n // 2 + n - n // 2""")
def sample_split(spark, sf):
    """Half of all documents as gallery, the other half held out, a quarter as probes."""
    d = D.table(spark, sf, "documents").select("doc_id")
    n = d.count()
    return E.sample_split(d, "doc_id", 7, n // 2, n - n // 2, n // 4)


# --- maintenance jobs -----------------------------------------------------

def _catalog(spark, sf):
    v = D.image_vectors(spark, sf)
    codes = jobs.to_codes(v.where(F.col("indexed_at").isNotNull()))
    return D.gallery(spark, sf).withColumn("dhash", F.lit("")), v, codes


@query("j1_rebuild_index", with_("image_vectors") + """
SELECT model_id, count(*) AS codes, 0::BIGINT AS pending, count(*) FILTER (indexed_at IS NULL) AS points
FROM image_vectors GROUP BY model_id""")
def rebuild_index(spark, sf):
    images, vectors, codes = _catalog(spark, sf)
    out = jobs.rebuild_index(images, vectors, codes, D.models(spark), "2024-02-01 00:00:00")
    pending = out["image_vectors"].groupBy("model_id").agg(
        F.count_if(F.col("indexed_at").isNull()).alias("pending"))
    points = out["points"].groupBy("model_id").agg(F.count("*").alias("points"))
    return (
        out["codes"].groupBy("model_id").agg(F.count("*").alias("codes"))
        .join(pending, "model_id").join(points, "model_id", "left")
    )


@query("j2_reembed", with_("gallery", "image_vectors") + """
SELECT image_id, CASE WHEN label = 5 THEN 'missing' WHEN label = 2 THEN 'failed' ELSE 'ok' END AS outcome
FROM gallery g WHERE coalesce(thumb_path, '') <> '' AND NOT EXISTS (
  SELECT 1 FROM image_vectors v WHERE v.image_id = g.image_id AND model_id = 'sem32')""")
def reembed(spark, sf):
    """Files of label 5 are gone; those of label 2 encode to something not finite."""
    return _reembed(spark, sf)["outcomes"]


def _reembed(spark, sf):
    images, vectors, codes = _catalog(spark, sf)
    lab = F.col("label")
    encoded = images.select("image_id", F.transform(
        F.slice("embedding", 1, 32),
        lambda x: F.when(lab == 2, float("nan")).otherwise(x).cast("float")).alias("vector"))
    return jobs.reembed(images, vectors, codes, {"model_id": "sem32", "vector_size": 32}, encoded,
                        images.where(lab != 5), "2024-02-01 00:00:00")


@query("j2_reembed_result", with_("image_vectors") + """
SELECT 'sem32' AS model_id, count(*) FILTER (model_id = 'sem32')
    + (SELECT count(*) FROM embeddings WHERE label = 8) AS vectors,
  count(*) FILTER (model_id = 'sem32' AND indexed_at IS NULL) AS pending FROM image_vectors""")
def reembed_result(spark, sf):
    v = _reembed(spark, sf)["image_vectors"].where(F.col("model_id") == "sem32")
    return v.groupBy("model_id").agg(
        F.count("*").alias("vectors"), F.count_if(F.col("indexed_at").isNull()).alias("pending"))


@query("j3_reembed_dry_run", with_("gallery", "image_vectors", "models") + """
SELECT m.model_id, (SELECT count(*) FROM gallery g WHERE coalesce(thumb_path, '') <> '' AND NOT EXISTS (
    SELECT 1 FROM image_vectors v WHERE v.image_id = g.image_id AND v.model_id = m.model_id)) AS missing
FROM models m WHERE active""")
def reembed_dry_run(spark, sf):
    return setdiff.missing_by_model(D.gallery(spark, sf), D.image_vectors(spark, sf), D.models(spark))


ITEM_COLUMNS = ["source_site", "source_post_id", "source_url", "canonical_url", "rating", "score", "phash",
                "thumb_path", "tags", "artist_tags"]


def _arrivals(g):
    """A batch of these pictures: items, and the vectors of both active models."""
    rows = F.array(
        F.struct(F.lit("copy64").alias("model_id"), F.col("embedding").alias("vector")),
        F.struct(F.lit("sem32").alias("model_id"), F.slice("embedding", 1, 32).alias("vector")))
    made = g.select("source_site", "source_post_id", F.explode(rows).alias("r")).select(
        "source_site", "source_post_id", "r.model_id", "r.vector", F.lit(0).alias("arrival"))
    return g.select(*ITEM_COLUMNS, "label", F.lit(0).alias("arrival")), made


@query("j4_ingest_batch", with_("gallery") + """
SELECT model_id, (SELECT count(*) FROM gallery) AS images, count(*) AS vectors, count(*) AS codes, count(*) AS indexed,
  sum(source_post_id)::BIGINT AS post_sum
FROM gallery, (VALUES ('copy64'), ('sem32')) m(model_id) GROUP BY model_id""")
def ingest_batch(spark, sf):
    """The whole gallery arrives at a catalog that knows the pictures of labels 0 to 4."""
    g = D.gallery(spark, sf)
    cols = ITEM_COLUMNS
    items, made = _arrivals(g)
    items = items.drop("label")
    at = D.ts("2024-01-01 00:00:00")
    known = g.where(F.col("label") < 5)
    old = known.select("image_id", *cols, at.alias("created_at"), at.alias("updated_at"))
    vectors = D.image_vectors(spark, sf).join(known.select("image_id"), "image_id", "left_semi")
    out = jobs.ingest_batch(items, made, old, vectors, jobs.to_codes(vectors), D.models(spark),
                            "2024-02-01 00:00:00")
    images = out["images"]
    n = images.select(F.count("*")).scalar()
    v = out["image_vectors"].join(images.select("image_id", "source_post_id"), "image_id").groupBy(
        "model_id").agg(F.count("*").alias("vectors"), F.count("indexed_at").alias("indexed"),
                        F.sum("source_post_id").alias("post_sum"))
    c = out["codes"].groupBy("model_id").agg(F.count("*").alias("codes"))
    return v.join(c, "model_id").withColumn("images", n)


# --- the same jobs on a bucketed catalog ------------------------------------

#: Ids of a bucket here, so that the smallest tables have several.
SPAN = 128


def _stored(spark, sf):
    images, vectors, codes = _catalog(spark, sf)
    at = D.ts("2024-01-01 00:00:00")
    images = images.withColumns({"created_at": at, "updated_at": at}).drop("embedding")
    return B.create(images, vectors, scratch_path(spark, "buckets"), codes, SPAN, 16)


@query("f8_search_buckets", SEARCH_SQL)
def search_buckets(spark, sf):
    """Search over a stored catalog: originals and catalog rows come from the buckets of the candidates only."""
    b = _stored(spark, sf)
    codes = jobs.to_codes(b.table("image_vectors"))
    hits = S.search(D.queries(spark, sf), codes, b.table("image_vectors"), b.table("images"), "copy64",
                    vector_size=D.vector_size("copy64"), span=b.span)
    return hits.select("query_id", i64("hit_rank").alias("hit_rank"), "image_id", "source_site", "source_post_id",
                       r6("score").alias("score"), "hash_distance", "exact")


@query("c1_hydrate_buckets", with_("gallery", "queries", **KNN) + """
SELECT query_id, image_id, distance, source_site, source_post_id
FROM coarse JOIN gallery USING (image_id)""")
def hydrate_buckets(spark, sf):
    b = _stored(spark, sf)
    return S.hydrate(coarse(spark, sf), b.table("images"), span=b.span).select(
        "query_id", "image_id", "distance", "source_site", "source_post_id")


@query("c2_fetch_buckets", with_("gallery", "queries", "image_vectors", **KNN) + """
SELECT query_id, image_id, CAST(len(vector) AS INTEGER) AS n FROM coarse JOIN image_vectors USING (image_id)
WHERE model_id = 'sem32'""")
def fetch_buckets(spark, sf):
    b = _stored(spark, sf)
    return S.fetch_originals(coarse(spark, sf), b.table("image_vectors"), "sem32", span=b.span).select(
        "query_id", "image_id", F.size("vector").alias("n"))


@query("c16_mark_buckets", with_("gallery", "image_vectors") + """
SELECT image_id, model_id, CASE WHEN model_id = 'sem32' AND g.label IN (3, 4) THEN '2024-02-01 00:00:00'
  WHEN indexed_at IS NULL THEN '' ELSE '2024-01-01 00:00:00' END AS indexed_at
FROM image_vectors JOIN gallery g USING (image_id)""")
def mark_buckets(spark, sf):
    b = _stored(spark, sf)
    ids = D.gallery(spark, sf).where(F.col("label").isin(3, 4)).select("image_id")
    bucket_jobs.mark_indexed(b, ids, ["sem32"], "2024-02-01 00:00:00")
    return b.table("image_vectors").select("image_id", "model_id", F.coalesce(ts_text("indexed_at"), F.lit("")).alias("indexed_at"))


@query("j1_rebuild_buckets", with_("image_vectors") + """
SELECT model_id, count(*) AS codes, 0::BIGINT AS pending FROM image_vectors GROUP BY model_id""")
def rebuild_buckets(spark, sf):
    b = _stored(spark, sf)
    bucket_jobs.rebuild_index(b, D.models(spark), "2024-02-01 00:00:00")
    pending = b.table("image_vectors").groupBy("model_id").agg(F.count_if(F.col("indexed_at").isNull()).alias("pending"))
    return b.table("codes").groupBy("model_id").agg(F.count("*").alias("codes")).join(pending, "model_id")


@query("j2_reembed_buckets", with_("gallery", "image_vectors") + """
SELECT image_id, CASE WHEN label = 5 THEN 'missing' WHEN label = 2 THEN 'failed' ELSE 'ok' END AS outcome
FROM gallery g WHERE coalesce(thumb_path, '') <> '' AND NOT EXISTS (
  SELECT 1 FROM image_vectors v WHERE v.image_id = g.image_id AND model_id = 'sem32')""")
def reembed_buckets(spark, sf):
    """As j2_reembed, two buckets a round."""
    half = lambda files: files.select("image_id", F.transform(
        F.slice("embedding", 1, 32),
        lambda x: F.when(F.col("label") == 2, float("nan")).otherwise(x).cast("float")).alias("vector"))
    files = D.gallery(spark, sf).where(F.col("label") != 5).select("image_id", "label", "embedding")
    return bucket_jobs.reembed(_stored(spark, sf), {"model_id": "sem32", "vector_size": 32}, half, files,
                               "2024-02-01 00:00:00", buckets_per_round=2)


def _late_arrivals(spark, sf):
    """The stored catalog after pictures of labels 2 and 7, which lacked a vector, have come again."""
    b = _stored(spark, sf)
    again = D.gallery(spark, sf).where(F.col("label").isin(2, 7))
    bucket_jobs.ingest_batch(b, *_arrivals(again), D.models(spark), "2024-02-01 00:00:00")
    return b


@query("c3_fully_indexed_masks", with_("gallery") + """
SELECT image_id, label NOT IN (5, 8) AS both_models, label NOT IN (5, 8) AS sem_only, TRUE AS copy_indexed FROM gallery""")
def fully_indexed_masks(spark, sf):
    """By masks, after an upsert; then with one model at rest; and which copy vectors the index has."""
    b = _late_arrivals(spark, sf)
    bucket_jobs.rebuild_index(b, D.models(spark), "2024-03-01 00:00:00")
    images, masks, slots = b.table("images"), b.table("image_masks"), b.slots()
    flag = lambda ids, name: ids.select("image_id").withColumn(name, F.lit(True))
    out = images.select("image_id", "label")
    for name, found in (
            ("both_models", K.fully_indexed(images, masks, slots, ["copy64", "sem32"])),
            ("sem_only", K.fully_indexed(images, masks, slots, ["sem32"])),
            ("copy_indexed", masks.where(K.has_all("indexed", K.bits(slots, ["copy64"]))))):
        out = out.join(flag(found, name), "image_id", "left").fillna(False, [name])
    return out.drop("label")


@query("d19_audit_masks", with_("gallery") + """
SELECT 'copy64' AS model_id, count(*) AS vectors, count(*) FILTER (label = 3) AS pending FROM gallery
UNION ALL SELECT 'sem32', count(*) FILTER (label NOT IN (5, 8)), count(*) FILTER (label = 3) FROM gallery""")
def audit_masks(spark, sf):
    b = _late_arrivals(spark, sf)
    return K.audit(b.table("image_masks"), b.slots(), D.models(spark))


@query("j3_dry_run_masks", with_("gallery") + """
SELECT 'copy64' AS model_id, 0::BIGINT AS missing
UNION ALL SELECT 'sem32', count(*) FILTER (coalesce(thumb_path, '') <> '' AND label IN (5, 8)) FROM gallery""")
def dry_run_masks(spark, sf):
    b = _late_arrivals(spark, sf)
    return K.missing_by_model(b.table("images"), b.table("image_masks"), b.slots(), D.models(spark))


@query("j4_ingest_buckets", with_("gallery", "image_vectors") + """
SELECT model_id, image_id, source_post_id, label = 6 AS arrived, CASE WHEN label = 6 THEN '2024-02-01 00:00:00'
    ELSE '2024-01-01 00:00:00' END AS updated_at,
  CASE WHEN label = 6 THEN '2024-02-01 00:00:00' WHEN indexed_at IS NULL THEN '' ELSE '2024-01-01 00:00:00' END AS indexed_at,
  '2024-01-01 00:00:00' AS created_at
FROM image_vectors JOIN gallery USING (image_id)""")
def ingest_buckets(spark, sf):
    """The pictures of label 6 arrive again; the others are neither read nor written but for their buckets."""
    b = _stored(spark, sf)
    again = D.gallery(spark, sf).where(F.col("label") == 6)
    bucket_jobs.ingest_batch(b, *_arrivals(again), D.models(spark), "2024-02-01 00:00:00")
    images = b.table("images").select("image_id", "source_post_id", F.col("label").eqNullSafe(F.lit(6)).alias("arrived"), ts_text("updated_at").alias("updated_at"))
    return b.table("image_vectors").join(images, "image_id").select(
        "model_id", "image_id", "source_post_id", "arrived", "updated_at",
        F.coalesce(ts_text("indexed_at"), F.lit("")).alias("indexed_at"), ts_text("created_at").alias("created_at"))


def _eval_sql(method: str, pairs: str) -> str:
    return f"""
SELECT '{method}' AS method, coalesce(degradation, '전체') AS degradation, count(*) AS queries,
  round(avg(CASE WHEN rank < 1 THEN 100.0::DOUBLE ELSE 0 END), 6) AS top1_pct,
  round(avg(CASE WHEN rank < 5 THEN 100.0::DOUBLE ELSE 0 END), 6) AS top5_pct
FROM (SELECT p.query_id, any_value(p.degradation) AS degradation,
        count(*) FILTER (p.score >= o.score AND p.image_id <> p.answer_id) AS rank
      FROM {pairs} p JOIN (SELECT query_id, score FROM {pairs} WHERE image_id = answer_id) o USING (query_id) GROUP BY 1)
GROUP BY ROLLUP (degradation)"""


def _pairs_sql(score: str) -> str:
    return (f"SELECT q.query_id, q.answer_id, q.degradation, g.image_id, {score} AS score "
            "FROM degraded q, gallery g")


@query("j5_evaluate_models", with_(
    "gallery", "degraded",
    hp=_pairs_sql(f"-{hamming_hex('q.phash', 'g.phash')}"),
    vp=_pairs_sql(f"CAST({dot('q.vector', 'g.embedding')} AS FLOAT)"),
    sp=_pairs_sql(f"CAST({dot('q.vector[1:32]', 'g.embedding[1:32]')} AS FLOAT)"),
) + "UNION ALL".join([_eval_sql("phash", "hp"), _eval_sql("copy64", "vp"), _eval_sql("sem32", "sp")]))
def evaluate_models(spark, sf):
    q, g = D.degraded(spark, sf), all_vectors(spark, sf)
    half = lambda df: df.withColumn("vector", F.slice("vector", 1, 32))
    out = evaluation.evaluate_models({"copy64": (q, g), "sem32": (half(q), half(g))}, (q, g),
                                     {m: D.vector_size(m) for m in ("copy64", "sem32")})
    return out.withColumn("top1_pct", r6("top1_pct")).withColumn("top5_pct", r6("top5_pct"))


@query("j5_evaluate_pictures")
def evaluate_pictures(spark, sf):
    """The same from pixels: damage, prepare, hash, embed, rank. Only hashes and vectors are stored."""
    kinds = F.array(*[F.lit(k) for k in X.DEGRADATIONS])
    found = materialize(X.signatures(pictures(spark, sf), ENCODERS), "signatures")
    g = found.where("degradation IS NULL")
    q = found.where("degradation IS NOT NULL").withColumns({
        "query_id": F.col("image_id") * 8 + F.array_position(kinds, F.col("degradation")) - 1,
        "answer_id": F.col("image_id")})

    def of(model):
        vector = F.col(model).alias("vector")
        return q.select("query_id", "answer_id", "degradation", vector), g.select("image_id", vector)

    return evaluation.evaluate_models({e.model_id: of(e.model_id) for e in ENCODERS}, (
        q.select("query_id", "answer_id", "degradation", "phash"), g.select("image_id", "phash")),
        {e.model_id: e.size for e in ENCODERS})


@query("j6_evaluate_threshold", _SCORED + f"""
SELECT r.*, round(overlap, 6) AS overlap, round(cut, 5) AS cut99, round(recall99, 6) AS recall99
FROM ({REPORT_SQL}) r
JOIN (SELECT s.method, avg(CASE WHEN score <= top THEN 1.0::DOUBLE ELSE 0 END) AS overlap,
        avg(CASE WHEN score >= cut THEN 1.0::DOUBLE ELSE 0 END) AS recall99, any_value(cut) AS cut
      FROM scores s JOIN (SELECT method, max(score) AS top, quantile_cont(score, 0.99) AS cut
                          FROM scores WHERE kind = 'fake' GROUP BY 1) f ON f.method = s.method
      WHERE s.kind = 'real' GROUP BY s.method) o ON o.method = r.method""")
def evaluate_threshold(spark, sf):
    t = evaluation.evaluate_threshold(scores(spark, sf))
    first = F.element_at("separation", 1)
    t = t.withColumn("cut99", first["cut"]).withColumn("recall99", r6(first["recall"])).withColumn(
        "overlap", r6("overlap")).drop("separation", "recall", "leak")
    return round5(t, *[c for c in t.columns if c not in ("method", "overlap", "recall99")])
