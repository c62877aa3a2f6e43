"""Bucketed catalog: pruned lookups, buckets left alone, replays and jobs that died."""

import os

import pytest
from pyspark.sql import functions as F

from imgtrace.operators import masks as K
from imgtrace.operators import merge as M
from imgtrace.operators import search as S
from imgtrace.operators import setdiff as X
from imgtrace.plans import bucket_jobs as BJ
from imgtrace.plans import jobs
from imgtrace.session import scratch_path
from imgtrace.sources import buckets as B
from imgtrace.sources import derived as D

NOW, LATER = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
SPAN = 10


def catalog(spark, n=60):
    """Pictures 1..n of site a, posts 100 + id; copy64 vectors for all, sem32 for odd ones; ids of 5 aren't indexed."""
    at = D.ts(NOW)
    ids = spark.range(1, n + 1).withColumnRenamed("id", "image_id")
    images = ids.select(
        "image_id", F.lit("a").alias("source_site"), (F.col("image_id") + 100).alias("source_post_id"),
        F.lit("r").alias("rating"), F.lit("00000000000000ff").alias("phash"), F.lit("").alias("dhash"), F.lit("t").alias("thumb_path"),
        F.array(F.lit("tag")).alias("tags"), at.alias("created_at"), at.alias("updated_at"))
    vector = lambda d: F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: ((F.col("image_id") * i) % 7 - 3).cast("float"))
    indexed = F.when(F.col("image_id") % 5 != 0, at).alias("indexed_at")
    of = lambda m, d, rows: rows.select("image_id", F.lit(m).alias("model_id"), vector(d).alias("vector"), at.alias("created_at"), indexed)
    vectors = of("copy64", 64, ids).unionByName(of("sem32", 32, ids.where("image_id % 2 = 1")))
    return B.create(images, vectors, scratch_path(spark, "test-buckets"), None, SPAN, 4)


def files(b, name):
    """Data files of a table by partition folder."""
    out = {}
    for folder, _, found in os.walk(f"{b.path}/{name}"):
        for f in found:
            if f.endswith(".parquet"):
                out.setdefault(os.path.relpath(folder, f"{b.path}/{name}"), set()).add(f)
    return out


def batch(spark, posts, value=1.0, thumb=None):
    items = spark.createDataFrame(
        [("a", p, "q", None, None, thumb, ["new"], 0) for p in posts],
        "source_site string, source_post_id long, rating string, phash string, dhash string, thumb_path string, tags array<string>, arrival int")
    made = [("a", p, m, [value] * d, 0) for p in posts for m, d in (("copy64", 64), ("sem32", 32))]
    return items, spark.createDataFrame(made, "source_site string, source_post_id long, model_id string, vector array<float>, arrival int")


def rows(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


IMAGE = ("image_id", "source_site", "source_post_id", "rating", "phash", "thumb_path", "tags", "created_at", "updated_at")
VECTOR = ("image_id", "model_id", "vector", "created_at", "indexed_at")


def test_a_batch_touches_its_buckets_only(spark):
    b = catalog(spark)
    before = {t: files(b, t) for t in B.PARTITIONS}
    got = BJ.ingest_batch(b, *batch(spark, [123, 125, 900]), D.models(spark), LATER)
    assert got["images"] == [(2,), (6,)] and got["image_vectors"] == [(m, k) for m in ("copy64", "sem32") for k in (2, 6)]
    for t in ("images", "image_vectors", "codes"):
        after = files(b, t)
        changed = {p for p in after if after[p] != before[t].get(p)}
        assert changed == {p for p in after if p.endswith(("id_bucket=2", "id_bucket=6"))}, t
    assert all(v <= files(b, "image_keys")[p] for p, v in before["image_keys"].items())
    assert rows(b.table("images").where("source_post_id in (123, 900, 124)"), "image_id", "rating", "phash", "thumb_path") == sorted(map(repr, [
        (23, "q", "00000000000000ff", "t"), (24, "r", "00000000000000ff", "t"), (61, "q", None, None)]))
    assert b.last_id() == 61 and b.table("image_keys").count() == 61


def test_batch_equals_the_whole_table_job(spark):
    b = catalog(spark)
    old = {t: spark.createDataFrame(b.table(t).drop("id_bucket").collect(), b.table(t).drop("id_bucket").schema)
           for t in ("images", "image_vectors", "codes")}
    items, made = batch(spark, [101, 130, 131, 160, 500, 400], 2.0, "new thumb")
    items = items.unionByName(items.withColumn("arrival", F.lit(1)).withColumn("rating", F.lit("last")))
    want = jobs.ingest_batch(items, made, old["images"], old["image_vectors"], old["codes"], D.models(spark), LATER)
    BJ.ingest_batch(b, items, made, D.models(spark), LATER)
    assert rows(b.table("images"), *IMAGE) == rows(want["images"], *IMAGE)
    assert rows(b.table("image_vectors"), *VECTOR) == rows(want["image_vectors"], *VECTOR)
    assert rows(b.table("codes"), "image_id", "model_id", "code") == rows(want["codes"], "image_id", "model_id", "code")


def test_a_batch_that_comes_again_changes_nothing(spark):
    b = catalog(spark)
    arrival = batch(spark, [111, 700, 701])
    BJ.ingest_batch(b, *arrival, D.models(spark), LATER)
    first = [rows(b.table("images"), *IMAGE), rows(b.table("image_vectors"), *VECTOR), rows(b.table("image_keys"), "source_post_id", "image_id")]
    BJ.ingest_batch(b, *arrival, D.models(spark), LATER)
    assert first == [rows(b.table("images"), *IMAGE), rows(b.table("image_vectors"), *VECTOR), rows(b.table("image_keys"), "source_post_id", "image_id")]


@pytest.mark.parametrize("step", ["write_images", "write_vectors"])
def test_a_job_that_died_runs_again(spark, step, monkeypatch):
    whole, b = catalog(spark), catalog(spark)
    arrival = batch(spark, [111, 700, 701])
    BJ.ingest_batch(whole, *arrival, D.models(spark), LATER)

    def die(*_):
        raise RuntimeError("died")

    monkeypatch.setattr(BJ, step, die)
    with pytest.raises(RuntimeError):
        BJ.ingest_batch(b, *arrival, D.models(spark), LATER)
    monkeypatch.undo()
    BJ.ingest_batch(b, *arrival, D.models(spark), LATER)
    for t, columns in (("images", IMAGE), ("image_vectors", VECTOR), ("codes", ("image_id", "model_id", "code"))):
        assert rows(b.table(t), *columns) == rows(whole.table(t), *columns)


def test_refused_batches_change_nothing(spark):
    b = catalog(spark)
    before = {t: files(b, t) for t in B.PARTITIONS}
    items, made = batch(spark, [900])
    with pytest.raises(jobs.IndexFull):
        BJ.ingest_batch(b, items, made, D.models(spark), LATER, max_indexed=60)
    with pytest.raises(jobs.BatchRefused):
        BJ.ingest_batch(b, items, made.where("model_id = 'copy64'"), D.models(spark), LATER)
    assert {t: files(b, t) for t in B.PARTITIONS} == before


def test_marks_and_rebuilds_by_bucket(spark):
    b = catalog(spark)
    before = files(b, "image_vectors")
    ids = spark.createDataFrame([(5,), (15,), (16,), (999,)], "image_id long")
    assert BJ.mark_indexed(b, ids, ["sem32"], LATER) == [("sem32", 0), ("sem32", 1)]
    after = files(b, "image_vectors")
    assert {p for p in after if after[p] != before[p]} == {"model_id=sem32/id_bucket=0", "model_id=sem32/id_bucket=1"}
    t = b.table("image_vectors")
    assert t.where(f"indexed_at = '{LATER}'").count() == 2 and t.count() == 90
    out = BJ.rebuild_index(b, D.models(spark), LATER)
    assert out["rebuilt"] == 16 and b.table("image_vectors").where("indexed_at is null").count() == 0
    assert b.table("codes").count() == 88  # 5 and 15 were marked without a code
    again = files(b, "image_vectors")
    assert BJ.rebuild_index(b, D.models(spark), LATER) == {"rebuilt": 0, "buckets": []} and files(b, "image_vectors") == again


def test_reembed_goes_on_where_it_stopped(spark):
    b = catalog(spark)
    rounds = []

    def encode(given):
        ids = sorted(r["image_id"] for r in given.collect())
        rounds.append(ids)
        if len(rounds) == 3:
            raise RuntimeError("died")
        value = F.when(F.col("image_id") == 4, float("nan")).otherwise(1.0).cast("float")
        return given.select("image_id", F.array_repeat(value, 32).alias("vector"))

    pictures = b.table("images").where("image_id <> 8").select("image_id")
    sem = {"model_id": "sem32", "vector_size": 32}
    with pytest.raises(RuntimeError):
        BJ.reembed(b, sem, encode, pictures, LATER, buckets_per_round=2)
    assert b.table("image_vectors").where("model_id = 'sem32'").count() == 30 + 17  # ids up to 39 but for 4 and 8
    out = {r["image_id"]: r["outcome"] for r in BJ.reembed(b, sem, encode, pictures, LATER, buckets_per_round=2).collect()}
    assert out == {4: "failed", 8: "missing", **{i: "ok" for i in range(40, 61, 2)}}
    t = b.table("image_vectors").where("model_id = 'sem32'")
    assert t.count() == 58 and t.select("image_id").distinct().count() == 58
    assert b.table("codes").where("model_id = 'sem32'").join(t, "image_id").count() == 24 + 28


def scans(plan):
    return [line for line in plan.split("\n") if "FileScan" in line or "Scan parquet" in line]


def test_lookups_read_the_buckets_of_their_ids(spark):
    b = catalog(spark)
    cands = spark.createDataFrame([(1, 3), (1, 55), (2, 999)], "query_id long, image_id long")
    for out in (S.fetch_originals(cands, b.table("image_vectors"), "copy64", True, b.span), S.hydrate(cands, b.table("images"), True, b.span)):
        assert sorted((r["query_id"], r["image_id"]) for r in out.collect()) == [(1, 3), (1, 55)]
        text = out._jdf.queryExecution().executedPlan().toString()
        assert any("dynamicpruning" in x.lower() and "id_bucket" in x for x in scans(text)), text
    whole = S.fetch_originals(cands, b.table("image_vectors").drop("id_bucket"), "copy64", True)
    assert rows(whole, "query_id", "image_id", "vector") == rows(
        S.fetch_originals(cands, b.table("image_vectors"), "copy64", False, b.span), "query_id", "image_id", "vector")


def test_search_over_buckets_prunes_both_tables(spark):
    b = catalog(spark)
    queries = b.table("image_vectors").where("model_id = 'copy64' and image_id in (7, 33)").select(
        F.col("image_id").alias("query_id"), "vector", F.lit("00000000000000ff").alias("phash"))
    args = (b.table("codes"), b.table("image_vectors"), b.table("images"), "copy64")
    hits = S.search(queries, *args, vector_size=64, span=b.span)
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert sum("dynamicpruning" in x.lower() for x in scans(text)) >= 2
    plain = S.search(queries, *(t.drop("id_bucket") for t in args[:3]), "copy64")
    columns = ("query_id", "hit_rank", "image_id", "score", "hash_distance")
    assert rows(hits, *columns) == rows(plain, *columns) and hits.count() == 10


def test_open_again_and_ids_below_zero(spark):
    b = catalog(spark, 12)
    assert B.open_buckets(spark, b.path) == b
    with pytest.raises(Exception):
        B.create(b.table("images").drop("id_bucket"), b.table("image_vectors").drop("id_bucket"), b.path)
    got = spark.createDataFrame([(-25,), (-3,), (0,), (9,), (10,)], "image_id long").select(B.bucket_of("image_id", 10)).collect()
    assert [r[0] for r in got] == [-2, 0, 0, 0, 1]
    assert M.IMAGE_KEY == B.IMAGE_KEY


def check_masks(b, models):
    """Masks equal the grouping of all vectors, and their answers those of the whole-table operators."""
    v = b.table("image_vectors").drop("id_bucket")
    slots = b.slots()
    assert rows(b.table("image_masks"), "image_id", "have", "indexed") == rows(B.masks_of(v, slots), "image_id", "have", "indexed")
    images = b.table("images")
    for ids in ([], ["copy64"], ["sem32"], ["copy64", "sem32"], ["copy64", "none"]):
        want = X.fully_indexed(images, v, ids) if "none" not in ids else images.limit(0)
        assert rows(K.fully_indexed(images, b.table("image_masks"), slots, ids), "image_id") == rows(want, "image_id")
    assert rows(K.missing_by_model(images, b.table("image_masks"), slots, models), "model_id", "missing") == rows(
        X.missing_by_model(images, v, models), "model_id", "missing")
    want = v.join(models.where("active"), "model_id").groupBy("model_id").agg(
        F.count("*").alias("vectors"), F.count_if(F.col("indexed_at").isNull()).alias("pending"))
    assert rows(K.audit(b.table("image_masks"), slots, models), "model_id", "vectors", "pending") == rows(want, "model_id", "vectors", "pending")


def test_masks_follow_every_write(spark):
    b, models = catalog(spark), D.models(spark)
    assert b.slots() == {"copy64": 0, "sem32": 1}
    check_masks(b, models)
    BJ.ingest_batch(b, *batch(spark, [104, 110, 900]), models, LATER)
    check_masks(b, models)
    BJ.mark_indexed(b, spark.createDataFrame([(5,), (15,)], "image_id long"), ["sem32"], LATER)
    check_masks(b, models)
    resting = M.upsert_model(models, {"model_id": "old64", "kind": "copy", "vector_size": 64, "distance": "cosine", "input_size": 224, "active": True})
    fresh = spark.createDataFrame([(2, "old64", [1.0] * 64, 0), (61, "old64", [2.0] * 64, 0)], "image_id long, model_id string, vector array<float>, arrival int")
    BJ.write_vectors(b, fresh, [], LATER)
    assert b.slots() == {"copy64": 0, "sem32": 1, "old64": 2}
    check_masks(b, resting)
    BJ.rebuild_index(b, resting, LATER)
    check_masks(b, resting)
    check_masks(b, models.withColumn("active", F.lit(False)))


def test_too_many_models_are_refused(spark):
    b = catalog(spark, 3)
    with pytest.raises(ValueError):
        b.slots([f"m{i}" for i in range(B.MAX_SLOTS)])
    assert K.bits(b.slots(), ["sem32", "sem32"]) == 2 and K.bits(b.slots(), ["x"]) is None


def test_many_small_buckets_share_a_round():
    assert list(BJ._rounds([1, 2, 3], 2)) == [[1, 2], [3]]
    many = list(BJ._rounds(list(range(782)), 2))
    assert len(many) <= BJ.MAX_ROUNDS and [b for some in many for b in some] == list(range(782))
