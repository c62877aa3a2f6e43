"""Catalog tables on parquet: write, open, count, look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace.functions import vectors as V
from imgtrace.session import shuffle_partitions


class CollectionMismatch(ValueError):
    """Stored collection and requested model disagree on size or distance."""


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_by: str | None = None) -> None:
    """Write a new version; an existing path is never overwritten.

    Rows are dealt by range of (partition, sort key), so a large partition value is
    spread over tasks and each file holds id bounds of its own, by which lookups prune.
    """
    if partition_by and sort_by:
        df = df.repartitionByRange(shuffle_partitions(df.sparkSession), *partition_by, sort_by)
        df = df.sortWithinPartitions(*partition_by, sort_by)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_catalog(images: DataFrame, vectors: DataFrame, path: str, models: DataFrame | None = None) -> None:
    """images by site; vectors and their sign codes by model; one model table beside them.

    `models` gives each model's distance (cosine where it names none). A model with a distance that
    sign codes can't stand for, or with vectors of several sizes, is refused before anything is written.
    """
    spark = images.sparkSession
    sizes = vectors.groupBy("model_id").agg(
        F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("vector_size"))
    if models is not None:
        sizes = sizes.join(models.select("model_id", "distance"), "model_id", "left")
    else:
        sizes = sizes.withColumn("distance", F.lit(None).cast("string"))
    sizes = sizes.withColumn("distance", F.coalesce("distance", F.lit("cosine")))
    wrong = sizes.where((F.col("least") != F.col("vector_size")) | ~F.col("distance").isin("cosine", "dot")).take(1)
    if wrong:
        raise CollectionMismatch(str(wrong[0].asDict()))
    write_table(images, f"{path}/images", ["source_site"], "image_id")
    write_table(vectors, f"{path}/image_vectors", ["model_id"], "image_id")
    stored = spark.read.parquet(f"{path}/image_vectors")
    write_table(
        stored.select("image_id", "model_id", V.encode_sign_bulk(F.col("vector")).alias("code")),
        f"{path}/codes", ["model_id"], "image_id")
    sizes.drop("least").coalesce(1).write.mode("errorifexists").parquet(f"{path}/collections")


def collection_conflicts(collections: DataFrame, models: DataFrame) -> DataFrame:
    """Stored collections whose size or distance differs from the registered model."""
    m = models.select("model_id", F.col("vector_size").alias("want_size"),
                      F.col("distance").alias("want_distance"))
    return collections.join(m, "model_id").where(
        (F.col("vector_size") != F.col("want_size")) | (F.col("distance") != F.col("want_distance")))


def open_catalog(spark: SparkSession, path: str, models: DataFrame) -> dict[str, DataFrame]:
    """Open the tables; raises when a collection no longer matches its model."""
    bad = collection_conflicts(spark.read.parquet(f"{path}/collections"), models).take(1)
    if bad:
        raise CollectionMismatch(str(bad[0].asDict()))
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("images", "image_vectors", "codes")}


def count_points(codes: DataFrame) -> DataFrame:
    return codes.groupBy("model_id").agg(F.count("*").alias("points"))


def count_images(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("images"))


def images_by_id(ids: DataFrame, images: DataFrame) -> DataFrame:
    """Batch lookup by image id; unknown ids stay, marked as not indexed."""
    return _view(ids.join(images, "image_id", "left"), F.col("source_post_id").isNotNull())


def images_by_source(ids: DataFrame, images: DataFrame) -> DataFrame:
    """Batch lookup by (site, post); unknown posts stay, marked as not indexed."""
    return _view(ids.join(images, ["source_site", "source_post_id"], "left"),
                 F.col("image_id").isNotNull())


def _view(joined: DataFrame, found) -> DataFrame:
    return joined.withColumn("indexed", found).withColumn(
        "has_thumb", F.coalesce(F.col("thumb_path"), F.lit("")) != "").drop("thumb_path")
