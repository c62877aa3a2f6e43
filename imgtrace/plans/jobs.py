"""Maintenance and ingest jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.functions import vectors as V
from imgtrace.operators import merge as M
from imgtrace.operators import setdiff as D
from imgtrace.session import materialize


class IndexFull(RuntimeError):
    """The catalog has no room for the whole batch."""


class BatchRefused(ValueError):
    """A batch holds an item that does not fit the active models."""


def pending_vectors(vectors: DataFrame, model_id: str, limit: int | None = None) -> DataFrame:
    out = vectors.where((F.col("model_id") == model_id) & F.col("indexed_at").isNull())
    return out if limit is None else out.orderBy("image_id").limit(limit)


def to_codes(vectors: DataFrame) -> DataFrame:
    return vectors.select("image_id", "model_id", V.encode_sign_bulk(F.col("vector")).alias("code"))


def replace_codes(codes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Codes are keyed by (model, image), so a re-encoded picture leaves no stale code."""
    keys = ["image_id", "model_id"]
    return M.split_touched(codes, fresh, keys)[1].unionByName(fresh)


def rebuild_index(images: DataFrame, vectors: DataFrame, codes: DataFrame, models: DataFrame,
                  now) -> dict[str, DataFrame]:
    """Index all pending vectors of the active models.

    Returns points (with payload), the new codes, the marked vectors and the count.
    """
    ids = [m["model_id"] for m in D.active_models(models)]
    pending = vectors.where(F.col("model_id").isin(*ids) & F.col("indexed_at").isNull())
    points = D.rebuild_points(pending, images)
    marked = vectors.withColumn("indexed_at", F.when(
        F.col("model_id").isin(*ids) & F.col("indexed_at").isNull(), D.as_ts(now))
        .otherwise(F.col("indexed_at")))
    return {
        "points": points,
        "codes": replace_codes(codes, to_codes(pending)),
        "image_vectors": marked,
        "report": pending.agg(F.count("*").alias("rebuilt")),
    }


def quota_allows(count_stored: Callable[[], int], incoming: int, max_indexed: int) -> bool:
    """False when the whole batch would not fit. No limit, or a failing count, accepts."""
    if max_indexed <= 0:
        return True
    try:
        stored = count_stored()
    except Exception:
        return True
    return stored + incoming <= max_indexed


def check_batch(items: DataFrame, vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Faulty items of a batch; an empty result lets the batch in."""
    v = D.validate_vectors(items, vectors, D.active_models(models))
    return v.where(F.col("fault").isNotNull() | (F.col("unregistered") > 0))


def admit(items: DataFrame, item_vectors: DataFrame, models: DataFrame, count_stored: Callable[[], int], max_indexed: int) -> None:
    """Raise if the batch would overflow the catalog or holds an item that doesn't fit the active models."""
    if max_indexed > 0:
        # Exact only up to the first row that would not fit; nothing is collected.
        incoming = items.select(*M.IMAGE_KEY).limit(max_indexed + 1).count()
        if not quota_allows(count_stored, incoming, max_indexed):
            raise IndexFull(f"{incoming} more pictures exceed {max_indexed}")
    item_id = F.concat_ws("#", *M.IMAGE_KEY)
    keyed = item_vectors.withColumn("item_id", item_id)
    bad = check_batch(items.select(item_id.alias("item_id")).distinct(), keyed, models).take(1)
    if bad:
        raise BatchRefused(str(bad[0].asDict()))


def ingest_batch(items: DataFrame, item_vectors: DataFrame, images: DataFrame, vectors: DataFrame,
                 codes: DataFrame, models: DataFrame, now, max_indexed: int = 0) -> dict[str, DataFrame]:
    """All-or-nothing ingest: quota, validation, images, vectors, codes, mark.

    items: catalog columns plus `arrival`, keyed by (site, post);
    item_vectors: (site, post, model_id, vector, arrival).
    """
    admit(items, item_vectors, models, images.count, max_indexed)
    new_images = materialize(M.upsert_images(images, items, now), "images")
    ids = new_images.select("image_id", *M.IMAGE_KEY)
    fresh = materialize(
        item_vectors.join(ids, M.IMAGE_KEY).select("image_id", "model_id", "vector", "arrival"),
        "vectors")
    active = [m["model_id"] for m in D.active_models(models)]
    stored = M.upsert_vectors(vectors, fresh, now)
    latest = M.latest_per_key(fresh, ["image_id", "model_id"], "arrival")
    return {
        "images": new_images,
        "image_vectors": M.mark_indexed(stored, fresh, active, now),
        "codes": replace_codes(codes, to_codes(latest)),
    }


def reembed(images: DataFrame, vectors: DataFrame, codes: DataFrame, model: dict,
            encoded: DataFrame, files: DataFrame, now) -> dict[str, DataFrame]:
    """Give every thumbnail the model's vector.

    `files(image_id)` are the thumbnails found on disk, `encoded(image_id, vector)`
    what the encoder made of them. Outcome per picture: ok, missing (file gone)
    or failed (no vector, wrong size, not finite). The anti-join makes a second
    run pick up only what is still missing.
    """
    todo = D.thumbs_missing_vector(images, vectors, model["model_id"]).select("image_id")
    found = files.select("image_id", F.lit(True).alias("_file"))
    j = todo.join(found, "image_id", "left").join(
        encoded.select("image_id", "vector"), "image_id", "left")
    good = (F.size("vector") == model["vector_size"]) & V.first_non_finite(F.col("vector")).isNull()
    outcome = (
        F.when(F.col("_file").isNull(), "missing")
        .when(F.coalesce(good, F.lit(False)), "ok").otherwise("failed")
    )
    # Stored once: the encoder must not run again for every table derived from it.
    outcomes = materialize(j.select("image_id", "vector", outcome.alias("outcome")), "reembed")
    ok = outcomes.where(F.col("outcome") == "ok").select(
        "image_id", F.lit(model["model_id"]).alias("model_id"), "vector", F.lit(0).alias("arrival"))
    stored = M.upsert_vectors(vectors, ok, now)
    return {
        "image_vectors": M.mark_indexed(stored, ok, [model["model_id"]], now),
        "codes": replace_codes(codes, to_codes(ok)),
        "outcomes": outcomes.select("image_id", "outcome"),
        "report": outcomes.groupBy("outcome").agg(F.count("*").alias("n")),
    }
