"""Maintenance and ingest jobs on a bucketed catalog: the same results as `jobs`, written bucket by bucket.

Effects come in an order in which a job that died can simply run again: ids first, then images, then codes, then
vectors with their mark. A code without a vector is never an answer, and what isn't marked is pending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.functions import vectors as V
from imgtrace.operators import merge as M
from imgtrace.operators import setdiff as D
from imgtrace.operators.ranking import row_numbers
from imgtrace.plans import jobs
from imgtrace.session import broadcast_if_small, materialize
from imgtrace.sources.buckets import IMAGE_KEY, Buckets, masks_of

VECTOR_KEY = ["image_id", "model_id"]


def _numbered(catalog: Buckets, items: DataFrame) -> DataFrame:
    """(site, post, image_id) of every item; posts without an id get the next ones, in (post, site) order, for good."""
    keys = items.select(*IMAGE_KEY).distinct()
    known = materialize(catalog.find_ids(keys), "known-ids")
    new = keys.join(broadcast_if_small(known.select(*IMAGE_KEY)), IMAGE_KEY, "left_anti").withColumn("_all", F.lit(0))
    new = row_numbers(new, ["_all"], "source_post_id", ["source_site"], "_rn")
    new = materialize(new.select(*IMAGE_KEY, (F.col("_rn") + catalog.last_id()).cast("bigint").alias("image_id")), "new-ids")
    catalog.add_ids(new)
    return known.unionByName(new)


def write_images(catalog: Buckets, items: DataFrame, ids: DataFrame, now) -> list[tuple]:
    """Upsert items (catalog columns and `arrival`) whose ids are known; returns the buckets written."""
    ids = catalog.with_id_bucket(ids)
    old = catalog.in_buckets("images", catalog.touched("images", ids))
    slim = old.select("id_bucket", "image_id", *[c for c in ("created_at", *M.KEEP_IF_NEW_EMPTY) if c in old.columns])
    # an id whose picture was never written (a job that died) is an old row without values
    stored = broadcast_if_small(ids).join(slim, ["id_bucket", "image_id"], "left").drop("id_bucket")
    changed = M.upsert_images(stored, items, now, last_id=F.lit(0).cast("bigint"))
    changed = changed.withColumn("created_at", F.coalesce("created_at", D.as_ts(now)))
    return catalog.replace("images", materialize(changed, "changed-images"), ["image_id"])


def write_vectors(catalog: Buckets, fresh: DataFrame, active: list[str], now) -> list[tuple]:
    """Upsert vectors (image_id, model_id, vector, arrival; a stored table) and codes, the active models' marked; the buckets written."""
    latest = catalog.with_id_bucket(M.latest_per_key(fresh, VECTOR_KEY, "arrival"))
    latest = materialize(latest.drop("id_bucket"), "latest-vectors")
    catalog.replace("codes", materialize(jobs.to_codes(latest), "changed-codes"), VECTOR_KEY)
    keys = catalog.with_id_bucket(latest)
    old = catalog.in_buckets("image_vectors", catalog.touched("image_vectors", keys)).select(
        "id_bucket", *VECTOR_KEY, F.col("created_at").alias("_created"))
    at = D.as_ts(now)
    indexed = F.when(F.col("model_id").isin(*active), at) if active else F.lit(None).cast("timestamp")
    changed = keys.join(old, ["id_bucket", *VECTOR_KEY], "left").select(
        *VECTOR_KEY, "vector", F.coalesce("_created", at).alias("created_at"), indexed.alias("indexed_at"))
    return _replace_vectors(catalog, materialize(changed, "changed-vectors"))


def _replace_vectors(catalog: Buckets, changed: DataFrame) -> list[tuple]:
    """Put stored vector rows in place and keep their images' masks; a mask that a job that died left behind is mended when it runs again."""
    touched = catalog.replace("image_vectors", changed, VECTOR_KEY)
    new = catalog.with_id_bucket(masks_of(changed, catalog.slots([m for m, _ in touched]))).withColumnsRenamed(
        {"have": "_have", "indexed": "_indexed"})
    new = materialize(new, "new-masks")
    old = catalog.in_buckets("image_masks", catalog.touched("image_masks", new))
    j = new.join(old, ["id_bucket", "image_id"], "left")
    was = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    masks = j.select(
        "image_id", was("have").bitwiseOR(F.col("_have")).alias("have"),
        was("indexed").bitwiseAND(F.bitwise_not("_have")).bitwiseOR(F.col("_indexed")).alias("indexed"))
    catalog.replace("image_masks", materialize(masks, "changed-masks"), ["image_id"])
    return touched


def ingest_batch(catalog: Buckets, items: DataFrame, item_vectors: DataFrame, models: DataFrame, now,
                 max_indexed: int = 0) -> dict[str, list[tuple]]:
    """All-or-nothing ingest of a batch (see `jobs.ingest_batch`); returns the buckets written of each table."""
    jobs.admit(items, item_vectors, models, lambda: catalog.table("image_keys").count(), max_indexed)
    items, item_vectors = materialize(items, "items"), materialize(item_vectors, "item-vectors")
    ids = materialize(_numbered(catalog, items), "ids")
    active = [m["model_id"] for m in D.active_models(models)]
    images = write_images(catalog, items, ids, now)
    fresh = item_vectors.join(broadcast_if_small(ids), IMAGE_KEY).select(*VECTOR_KEY, "vector", "arrival")
    return {"images": images, "image_vectors": write_vectors(catalog, fresh, active, now)}


def mark_indexed(catalog: Buckets, ids: DataFrame, model_ids: list[str], now) -> list[tuple]:
    """Set indexed_at of these pictures' vectors under these models; returns the buckets written."""
    ids = catalog.with_id_bucket(ids.select("image_id").distinct())
    of_models = F.explode(F.array(*[F.lit(m) for m in model_ids]).cast("array<string>"))
    wanted = ids.select("id_bucket").distinct().withColumn("model_id", of_models)
    stored = catalog.in_buckets("image_vectors", catalog.touched("image_vectors", wanted))
    hit = stored.join(broadcast_if_small(ids), ["id_bucket", "image_id"], "left_semi").drop("id_bucket")
    return _replace_vectors(catalog, materialize(hit.withColumn("indexed_at", D.as_ts(now)), "marked"))


def rebuild_index(catalog: Buckets, models: DataFrame, now) -> dict:
    """Index all pending vectors of the active models. Buckets without any are found by one narrow column and left alone."""
    active = [m["model_id"] for m in D.active_models(models)]
    pending = catalog.table("image_vectors").where(F.col("model_id").isin(*active) & F.col("indexed_at").isNull())
    touched = catalog.touched("image_vectors", pending)
    todo = catalog.in_buckets("image_vectors", touched).where(F.col("indexed_at").isNull()).drop("id_bucket")
    todo = materialize(todo, "pending")
    catalog.replace("codes", materialize(jobs.to_codes(todo), "changed-codes"), VECTOR_KEY)
    _replace_vectors(catalog, materialize(todo.withColumn("indexed_at", D.as_ts(now)), "marked"))
    return {"rebuilt": todo.count(), "buckets": touched}


#: Most rounds of a job: every round lists and reads the catalog anew, so small buckets share one.
MAX_ROUNDS = 8


def _rounds(buckets: list, size: int) -> Iterator[list]:
    """Runs of `size` buckets, or of more where these would be more than MAX_ROUNDS."""
    size = max(size, -(-len(buckets) // MAX_ROUNDS))
    for lo in range(0, len(buckets), size):
        yield buckets[lo:lo + size]


def reembed(catalog: Buckets, model: dict, encode: Callable[[DataFrame], DataFrame], files: DataFrame, now,
            buckets_per_round: int = 64) -> DataFrame:
    """Give every thumbnail the model's vector, at least `buckets_per_round` buckets at a time; (image_id, outcome) as `jobs.reembed` has it.

    `encode` makes (image_id, vector) of the rows of `files` (image_id, ...) it is given. Each round is written
    before the next begins, so a job that died goes on with what is still missing.
    """
    todo = D.thumbs_missing_vector(catalog.table("images"), catalog.table("image_vectors"), model["model_id"])
    todo = materialize(catalog.with_id_bucket(todo.select("image_id")), "todo")
    outcomes = None
    for some in _rounds([b for (b,) in catalog.touched("images", todo)], buckets_per_round):
        part = todo.where(F.col("id_bucket").isin(some)).select("image_id")
        given = files.join(broadcast_if_small(part), "image_id", "left_semi")
        found = given.select("image_id", F.lit(True).alias("_file"))
        j = part.join(found, "image_id", "left").join(encode(given).select("image_id", "vector"), "image_id", "left")
        good = (F.size("vector") == model["vector_size"]) & V.first_non_finite(F.col("vector")).isNull()
        outcome = F.when(F.col("_file").isNull(), "missing").when(F.coalesce(good, F.lit(False)), "ok").otherwise("failed")
        done = materialize(j.select("image_id", "vector", outcome.alias("outcome")), "reembed")
        ok = done.where("outcome = 'ok'").select(
            "image_id", F.lit(model["model_id"]).alias("model_id"), "vector", F.lit(0).alias("arrival"))
        write_vectors(catalog, ok, [model["model_id"]], now)
        done = done.select("image_id", "outcome")
        outcomes = done if outcomes is None else outcomes.unionByName(done)
    return todo.select("image_id", F.lit("").alias("outcome")).limit(0) if outcomes is None else outcomes
