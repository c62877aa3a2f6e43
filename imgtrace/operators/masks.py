"""What is complete and what is missing, by masks kept beside the images.

A mask (image_id, have, indexed) has a bit per model: is there a vector, and is it in the index? The bucketed catalog
changes it with every write of vectors, so these questions scan two numbers per image where grouping all
vectors would shuffle them. An image without vectors has no mask. Models are (un)registered without touching
masks: a question names the models it is about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.operators.setdiff import active_models, with_thumb


def bits(slots: dict[str, int], model_ids: list[str]) -> int | None:
    """The mask of these models; None if one of them has never had a vector."""
    if any(m not in slots for m in model_ids):
        return None
    return sum(1 << slots[m] for m in set(model_ids))


def has_all(column: str, mask: int | None) -> Column:
    if mask is None:
        return F.lit(False)
    return F.coalesce(F.col(column), F.lit(0)).bitwiseAND(F.lit(mask).cast("bigint")) == F.lit(mask).cast("bigint")


def fully_indexed(images: DataFrame, masks: DataFrame, slots: dict[str, int], model_ids: list[str]) -> DataFrame:
    """Images with a vector of every listed model; with none listed, all."""
    if not model_ids:
        return images
    done = masks.where(has_all("have", bits(slots, model_ids)))
    keys = ["id_bucket", "image_id"] if "id_bucket" in images.columns and "id_bucket" in masks.columns else ["image_id"]
    return images.join(done.select(*keys), keys, "left_semi")


def missing_by_model(images: DataFrame, masks: DataFrame, slots: dict[str, int], models: DataFrame) -> DataFrame:
    """(model_id, missing): thumbnails without the vector of each active model."""
    have = with_thumb(images).select("image_id").join(masks.select("image_id", "have"), "image_id", "left")
    return _per_model(have, models, ["missing"], lambda m: [~has_all("have", bits(slots, [m]))])


def audit(masks: DataFrame, slots: dict[str, int], models: DataFrame) -> DataFrame:
    """(model_id, vectors, pending) of each active model."""
    def counted(m):
        own = bits(slots, [m])
        return [has_all("have", own), has_all("have", own) & ~has_all("indexed", own)]

    return _per_model(masks, models, ["vectors", "pending"], counted)


def _per_model(rows: DataFrame, models: DataFrame, names: list[str], counted) -> DataFrame:
    """One pass over `rows` that counts for all active models at once (there is one per kind)."""
    active = [m["model_id"] for m in active_models(models)]
    of = lambda m: F.struct(F.lit(m).alias("model_id"), *[F.count_if(c).alias(n) for n, c in zip(names, counted(m), strict=True)])
    if not active:
        return models.where("false").select("model_id", *[F.lit(0).cast("bigint").alias(n) for n in names])
    return rows.agg(F.array(*[of(m) for m in active]).alias("r")).select(F.explode("r").alias("r")).select("r.*")
