"""How big the index gets and how much fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.operators import ranking as K

# --- fixed values ---------------------------------------------------------
GRAPH_BYTES_PER_POINT = 238
GRAPH_BASE_BYTES = 160 << 20
CAPACITY_SAFETY = 0.8
CODE_ID_BYTES = 8
EXTRAPOLATE_TO = 10_000_000
# --------------------------------------------------------------------------


def ram_per_image(kind: str) -> Column:
    """Aggregate over models(vector_size): resident bytes of one picture."""
    if kind == "flat":
        return F.lit(0).cast("bigint")
    size = F.col("vector_size")
    each = F.floor(size / 8) + GRAPH_BYTES_PER_POINT
    return F.coalesce(F.sum(F.when(size > 0, each)), F.lit(0)).cast("bigint")


def disk_per_image() -> Column:
    """Aggregate over models(vector_size): code file bytes of one picture."""
    size = F.col("vector_size")
    each = F.ceil(size / 8) + CODE_ID_BYTES
    return F.coalesce(F.sum(F.when(size > 0, each)), F.lit(0)).cast("bigint")


def index_size(models: DataFrame, images: DataFrame) -> DataFrame:
    """Bytes per picture and in all, for the flat and the graph kind of index."""
    n = images.select(F.count("*")).scalar()
    per = models.agg(ram_per_image("flat").alias("flat_ram"), disk_per_image().alias("flat_disk"),
                     ram_per_image("graph").alias("graph_ram")).withColumn("images", n)
    return per.select(
        "images", "flat_ram", "flat_disk", "graph_ram",
        (F.col("flat_disk") * F.col("images")).alias("flat_disk_total"),
        (F.col("graph_ram") * F.col("images")).alias("graph_ram_total"))


def image_capacity(budget_bytes: Column, per_image: Column) -> Column:
    """Pictures that fit into a memory budget of the graph index; never negative."""
    usable = budget_bytes - GRAPH_BASE_BYTES
    fit = F.floor(usable * F.lit(CAPACITY_SAFETY) / per_image).cast("bigint")
    return F.when((per_image > 0) & (usable > 0), fit).otherwise(F.lit(0).cast("bigint"))


def reembed_room(models: DataFrame, images: DataFrame, max_indexed: int) -> DataFrame:
    """Would the catalog still fit the budget set for `max_indexed` pictures? All models count."""
    n = images.select(F.count("*")).scalar()
    per = models.agg(ram_per_image("graph").alias("per_image")).withColumn("images", n)
    budget = F.lit(max_indexed) * F.col("per_image")
    return per.select(
        "images", "per_image", budget.alias("budget"),
        (F.col("images") * F.col("per_image")).alias("need"),
        (F.lit(max_indexed <= 0) | (F.col("per_image") <= 0)
         | (F.col("images") * F.col("per_image") <= budget)).alias("fits"))


def size_profile(df: DataFrame, value: str) -> DataFrame:
    """n, mean, upper median, min, max and the total for ten million pictures."""
    plain = df.where(F.col(value).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    median = K.ranked_values(df, [], value).select(K.at_rank(F.floor(F.col("n") / 2))).scalar()
    return plain.select("n", "mean", median.alias("median"), "min", "max",
                        (F.col("mean") * EXTRAPOLATE_TO).alias("bytes_at_10m"))


def index_audit(models: DataFrame, vectors: DataFrame, codes: DataFrame) -> DataFrame:
    """Per active model: vectors stored, points in the index, vectors still pending."""
    v = vectors.groupBy("model_id").agg(
        F.count("*").alias("vectors"), F.count_if(F.col("indexed_at").isNull()).alias("pending"))
    c = codes.groupBy("model_id").agg(F.count("*").alias("points"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return (
        models.where("active").select("model_id").join(v, "model_id", "left")
        .join(c, "model_id", "left").select("model_id", zero("vectors"), zero("points"), zero("pending"))
    )
