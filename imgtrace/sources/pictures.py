"""Picture files -> pixel table (Spark's own decoder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
MAX_FILE_BYTES = 32 << 20
MAX_PIXELS = 64_000_000
# --------------------------------------------------------------------------


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, length, width, height, channels, pixels, reject).

    Files over the size limit are known from the listing alone and never opened; all others are decoded where
    they are read. `reject` is 'too large', 'undecodable' or 'too many pixels', else NULL; pixels are row-major
    B, G, R[, A] bytes as the decoder gives them.
    """
    files = lambda kind: spark.read.format(kind).option("recursiveFileLookup", "true").load(path)
    large = files("binaryFile").where(F.col("length") > MAX_FILE_BYTES).select("path", "length")
    decoded = files("image").where(F.col("_metadata.file_size") <= MAX_FILE_BYTES).select(
        F.col("image.origin").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
    n_pixels = F.col("width").cast("bigint") * F.col("height")
    reject = (
        F.when(F.col("length") > MAX_FILE_BYTES, "too large")
        .when(F.coalesce(F.col("height"), F.lit(-1)) <= 0, "undecodable")
        .when(n_pixels > MAX_PIXELS, "too many pixels")
    )
    return (
        decoded.unionByName(large, allowMissingColumns=True)
        .withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).withColumn("reject", reject)
        .withColumn("pixels", F.when(F.col("reject").isNull(), F.col("pixels")))
    )
