"""What is missing, what is complete, what disagrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.functions import posts as P
from imgtrace.functions import vectors as V
from imgtrace.functions.rules import MAX_ATTEMPTS

# --- fixed values ---------------------------------------------------------
MISMATCH = "model mismatch"
BAD_VECTOR = "bad vector"
WHY_NEWER = "newer"
WHY_NOT_REACHED = "not reached"
WHY_EXHAUSTED = "exhausted"
WHY_GONE = "deleted or unsupported"
# --------------------------------------------------------------------------

# One active model per kind, so the active list stays at the number of kinds.
MAX_ACTIVE_MODELS = 62


def active_models(models: DataFrame) -> list:
    """The active model rows, in id order. Fetched, after checking there are few."""
    rows = models.where("active").orderBy("model_id").take(MAX_ACTIVE_MODELS + 1)
    if len(rows) > MAX_ACTIVE_MODELS:
        raise ValueError("more active models than kinds allow")
    return rows


def as_ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def complete_images(vectors: DataFrame, model_ids: list[str]) -> DataFrame:
    """Image ids that have a vector of every listed model (one shuffle, combined map-side)."""
    bit = F.lit(0).cast("bigint")
    for i, m in enumerate(model_ids):
        bit = F.when(F.col("model_id") == m, F.lit(1 << i).cast("bigint")).otherwise(bit)
    full = (1 << len(model_ids)) - 1
    return (
        vectors.where(F.col("model_id").isin(*model_ids))
        .groupBy("image_id").agg(F.bit_or(bit).alias("have"))
        .where(F.col("have") == full).select("image_id")
    )


def fully_indexed(images: DataFrame, vectors: DataFrame, model_ids: list[str]) -> DataFrame:
    """Images that are done. With no models listed, a catalog row is enough."""
    if not model_ids:
        return images
    return images.join(complete_images(vectors, model_ids), "image_id", "left_semi")


def vectors_missing(ids: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    have = vectors.where(F.col("model_id") == model_id).select("image_id")
    return ids.join(have, "image_id", "left_anti")


def with_thumb(images: DataFrame) -> DataFrame:
    return images.where(F.coalesce(F.col("thumb_path"), F.lit("")) != "")


def thumbs_missing_vector(images: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """All images with a thumbnail but no vector of this model."""
    return vectors_missing(with_thumb(images), vectors, model_id)


def thumbs_missing_page(images: DataFrame, vectors: DataFrame, model_id: str, after: int,
                        limit: int) -> tuple[DataFrame, DataFrame]:
    """One bounded page of the above, and its cursor.

    The cursor is the last id of the page before the vectors are taken out, so
    an empty page does not mean the end.
    """
    page = with_thumb(images).where(F.col("image_id") > after).orderBy("image_id").limit(limit)
    cursor = page.agg(F.max("image_id").alias("cursor"))
    return vectors_missing(page, vectors, model_id), cursor


def missing_by_model(images: DataFrame, vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Per active model: how many thumbnails lack its vector. One pass for all models."""
    ids = [m["model_id"] for m in active_models(models)]
    thumbs = with_thumb(images).select("image_id")
    have = (
        vectors.where(F.col("model_id").isin(*ids)).join(thumbs, "image_id", "left_semi")
        .groupBy("model_id").agg(F.count("*").alias("have"))
    )
    total = thumbs.agg(F.count("*")).scalar()
    return models.where("active").select("model_id").join(have, "model_id", "left").select(
        "model_id", (total - F.coalesce("have", F.lit(0))).alias("missing"))


def verify_node_models(active: list, reported: DataFrame) -> DataFrame:
    """Per node, the active models it lacks or has in another size. No row = all good."""
    if not active:
        raise ValueError("no active embedding model is registered")
    sizes = [
        F.max(F.when(F.col("model_id") == m["model_id"], F.col("vector_size"))).alias(f"s{i}")
        for i, m in enumerate(active)
    ]
    faults = F.array(*[
        F.when(
            F.col(f"s{i}").isNull() | (F.col(f"s{i}") != m["vector_size"]),
            F.struct(F.lit(m["model_id"]).alias("model_id"),
                     F.lit(m["vector_size"]).alias("want_size"), F.col(f"s{i}").alias("got_size")))
        for i, m in enumerate(active)
    ])
    return (
        reported.groupBy("node_id").agg(*sizes)
        .select("node_id", F.explode(F.array_compact(faults)).alias("f"))
        .select("node_id", "f.*")
    )


def replace_node_models(old: DataFrame, reported: DataFrame) -> DataFrame:
    """A reporting node's earlier set is replaced as a whole."""
    nodes = reported.select("node_id").distinct()
    return old.join(nodes, "node_id", "left_anti").unionByName(reported)


def validate_vectors(items: DataFrame, vectors: DataFrame, active: list) -> DataFrame:
    """items(item_id) + vectors(item_id, model_id, vector) -> first fault per item.

    Adds `fault` (NULL = valid), `fault_model`, and `unregistered`, which counts
    vectors of models outside `active` (ignored here, refused by ingest).
    """
    ids = [m["model_id"] for m in active]
    slim = vectors.select(
        "item_id", "model_id", F.size("vector").alias("n"),
        V.first_non_finite(F.col("vector")).alias("bad"))
    aggs = [F.count_if(~F.col("model_id").isin(*ids)).alias("unregistered")]
    for i, m in enumerate(active):
        mine = F.col("model_id") == m["model_id"]
        # Two plain maxima keep this a hash aggregate; (item, model) is unique.
        aggs += [F.max(F.when(mine, F.col("n"))).alias(f"n{i}"),
                 F.max(F.when(mine, F.col("bad"))).alias(f"bad{i}")]
    fault, model = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(active))):
        wrong = F.col(f"n{i}").isNull() | (F.col(f"n{i}") != m["vector_size"])
        broken = F.col(f"bad{i}").isNotNull()
        fault = F.when(wrong, MISMATCH).when(broken, BAD_VECTOR).otherwise(fault)
        model = F.when(wrong | broken, m["model_id"]).otherwise(model)
    return items.join(slim.groupBy("item_id").agg(*aggs), "item_id", "left").select(
        "item_id", fault.alias("fault"), model.alias("fault_model"),
        F.coalesce("unregistered", F.lit(0)).alias("unregistered"))


def live_nodes(nodes: DataFrame, now, timeout_seconds: int) -> DataFrame:
    edge = as_ts(now) - F.make_dt_interval(secs=F.lit(timeout_seconds))
    return nodes.where((F.col("status") == "online") & (F.col("heartbeat_at") > edge))


def dead_node_leases(work: DataFrame, nodes: DataFrame, now, timeout_seconds: int) -> DataFrame:
    """Running items whose node is not alive; items without a node are left alone."""
    held = work.where((F.col("status") == "running") & F.col("node_id").isNotNull())
    return held.join(live_nodes(nodes, now, timeout_seconds).select("node_id"), "node_id", "left_anti")


def rebuild_points(pending: DataFrame, images: DataFrame) -> DataFrame:
    """Pending vectors with their payload; a missing catalog row gives the default one."""
    meta = images.select("image_id", "source_site", "source_post_id", "canonical_url", "rating",
                         "phash", "dhash")
    joined = pending.join(meta, "image_id", "left")
    return joined.select("image_id", "model_id", "vector", P.payload(joined).alias("payload"))


def explain_missing(ids: DataFrame, images: DataFrame, state: DataFrame, ranges: DataFrame) -> DataFrame:
    """Why a post is (not) in the catalog; the first reason that fits.

    Watermarks and exhausted ranges are those of the post's site, and of its scope where `ids` names one.
    """
    key = [c for c in ("source_site", "scope_key") if c in ids.columns]
    marks = state.groupBy(*key).agg(F.max("high_watermark_id").alias("_high"), F.max("backfill_before_id").alias("_before"))
    spent = ranges.groupBy(*key).agg(
        F.count_if((F.col("status") == "failed") & (F.col("attempts") >= MAX_ATTEMPTS)).alias("_exhausted"))
    ids = ids.join(marks, key, "left").join(spent, key, "left")
    high, before, exhausted = (F.coalesce(c, F.lit(0)) for c in ("_high", "_before", "_exhausted"))
    have = images.select("source_site", "source_post_id", "image_id")
    reason = (
        F.when(F.col("image_id").isNotNull(), "")
        .when(F.col("source_post_id") > high, WHY_NEWER)
        .when(F.col("source_post_id") < before, WHY_NOT_REACHED)
        .when(exhausted > 0, WHY_EXHAUSTED)
        .otherwise(WHY_GONE)
    )
    return ids.join(have, ["source_site", "source_post_id"], "left").select(
        *key, "source_post_id", F.col("image_id").isNotNull().alias("indexed"),
        reason.alias("reason"))


def work_delta(posts: DataFrame, done: DataFrame) -> DataFrame:
    """Posts left to do: not skipped, not already fully indexed."""
    todo = posts.where(F.col("skip_reason") == "")
    keys = done.select("source_site", F.col("source_post_id").alias("post_id"))
    return todo.join(keys, ["source_site", "post_id"], "left_anti")


def post_status(posts: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """One status per post of a batch: skipped, existing, failed or saved."""
    d = done.select("source_site", F.col("source_post_id").alias("post_id"),
                    F.lit(True).alias("is_done"))
    f = failed.select("post_id", F.lit(True).alias("is_failed"))
    status = (
        F.when(F.col("skip_reason") != "", "skipped").when(F.col("is_done"), "existing")
        .when(F.col("is_failed"), "failed").otherwise("saved")
    )
    return (
        posts.join(d, ["source_site", "post_id"], "left").join(f, "post_id", "left")
        .withColumn("status", status).drop("is_done", "is_failed")
    )


def batch_report(statuses: DataFrame) -> DataFrame:
    """Total / skipped / existing / saved / failed of a batch, in one row."""
    return statuses.agg(*status_counts())


def status_counts() -> list[Column]:
    """The aggregates of `batch_report`; a writing job can observe them as well."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return [F.count("*").alias("total"), of("skipped"), of("existing"), of("saved"), of("failed")]
