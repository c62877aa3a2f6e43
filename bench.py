"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from imgtrace import registry, schema  # noqa: E402
from imgtrace.operators import knn  # noqa: E402
from imgtrace.plans import jobs  # noqa: E402
from imgtrace.session import build_session, scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "f8_search", "f1_coarse_scan", "f9_search_exact", "f10_hash_search", "e3_rank_of",
    "d9_retrieval_eval", "d12_separation", "b3_normalize_post", "c3_fully_indexed",
    "c5_thumbs_missing_vector", "c14_upsert_images", "d1_range_stats", "d4_fleet_summary",
    "d8_jobs_report", "e1_coverage_gaps", "g1_plan_gap_ranges", "g6_work_delta", "j4_ingest_batch",
    "i2_phash", "h3_throughput_stream",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def copies(spark, n: int):
    """Every embedding n times, under new ids."""
    e = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding")
    return e.repartition(4 * int(CPUS), "vec_id").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "image_id", F.col("vec_id") * n + F.col("copy") + 1)


def wide_scan(spark) -> tuple[float, float]:
    """All embeddings as queries against a million 768-bit codes; (seconds, pairs per second)."""
    words = F.array(*[F.xxhash64("vec_id", "copy", F.lit(i)) for i in range(12)])
    gallery = copies(spark, 500).select("image_id", words.alias("code"))
    path = scratch_path(spark, "bench-codes")
    gallery.write.parquet(path)
    gallery = spark.read.parquet(path)
    queries = gallery.where("image_id % 500 = 1").select(F.col("image_id").alias("query_id"), "code")
    start = time.perf_counter()
    knn.nearest_codes(queries, gallery, 100).write.format("noop").mode("overwrite").save()
    spent = time.perf_counter() - start
    return spent, queries.count() * gallery.count() / spent


def bulk_ingest(spark) -> tuple[float, float]:
    """One batch of fifty copies of every embedding, two 8-d vectors each; (seconds, images per second)."""
    src = copies(spark, 50)
    items = src.select(F.lit("s").alias("source_site"), F.col("image_id").alias("source_post_id"),
                       F.lit("00000000000000ff").alias("phash"), F.lit(0).alias("arrival"))
    made = src.select(
        F.lit("s").alias("source_site"), F.col("image_id").alias("source_post_id"),
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model_id"),
        F.slice("embedding", 1, 8).alias("vector"), F.lit(0).alias("arrival"))
    models = spark.createDataFrame([("a", "copy", 8, "cosine", 224, True),
                                    ("b", "semantic", 8, "cosine", 224, True)], schema.MODELS)
    images = spark.createDataFrame([], "image_id long, source_site string, source_post_id long, "
                                       "phash string, created_at timestamp, updated_at timestamp")
    start = time.perf_counter()
    out = jobs.ingest_batch(items, made, images, spark.createDataFrame([], schema.IMAGE_VECTORS),
                            spark.createDataFrame([], schema.CODES), models, "2024-01-01 00:00:00")
    for name in ("image_vectors", "codes"):
        out[name].write.parquet(scratch_path(spark, "bench-" + name))
    spent = time.perf_counter() - start
    return spent, items.count() / spent


def main() -> None:
    spark = build_session("imgtrace-bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS,
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)
    gallery = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    rates = {}
    if "f1_coarse_scan" in took:
        rates["coarse_pairs_per_sec"] = round(gallery * gallery / took["f1_coarse_scan"])
    if "f8_search" in took:
        rates["searches_per_sec"] = round(gallery / took["f8_search"], 1)
    if names is HEADLINE:
        took["wide_scan_1m_codes"], rates["wide_scan_pairs_per_sec"] = (round(x, 3) for x in wide_scan(spark))
        took["bulk_ingest"], rates["ingest_images_per_sec"] = (round(x, 3) for x in bulk_ingest(spark))
    if "i2_phash" in took:
        rates["phash_images_per_sec"] = round(gallery / took["i2_phash"], 1)
    print(json.dumps({
        "metric": "headline queries, best of %d" % RUNS, "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
