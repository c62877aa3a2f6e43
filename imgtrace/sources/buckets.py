"""A catalog in buckets of ids: lookups read the buckets they need, writes replace only those they touch.

    images         id_bucket=             rows in order of image_id
    image_vectors  model_id=/id_bucket=   "
    codes          model_id=/id_bucket=   "
    image_masks    id_bucket=             (image_id, have, indexed): a bit per model, see `operators.masks`
    image_keys     key_bucket=            (source_site, source_post_id, image_id), append only
    model_slots    (model_id, slot): whose bit is which, append only
    layout         one row: span, key_buckets

A bucket is `span` consecutive ids, so new pictures fill the last one, and the rows of a picture lie in buckets of one
number in all tables. Ids are given out by appending to `image_keys`; that is the first effect of an ingest, so
a batch that comes again finds the ids it was given. `key_bucket` is a hash of (site, post).

Replacing a bucket is Spark's dynamic partition overwrite: new files are staged while the old ones are read, and
take their place when all of them are there. Frames opened before a write are stale after it: open tables anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace.functions import vectors as V
from imgtrace.session import broadcast_if_small

SPAN = 1 << 16
KEY_BUCKETS = 256
IMAGE_KEY = ["source_site", "source_post_id"]
PARTITIONS = {"images": ["id_bucket"], "image_vectors": ["model_id", "id_bucket"], "codes": ["model_id", "id_bucket"],
              "image_masks": ["id_bucket"], "image_keys": ["key_bucket"]}
#: Bits of a mask that can stand for models.
MAX_SLOTS = 62


SLOTS = "model_id string, slot int"


def bucket_of(image_id: Column | str, span: int) -> Column:
    return F.call_function("div", F.col(image_id) if isinstance(image_id, str) else image_id, F.lit(span).cast("bigint"))


@dataclass(frozen=True)
class Buckets:
    """A bucketed catalog at a path."""

    spark: SparkSession
    path: str
    span: int
    key_buckets: int

    def table(self, name: str) -> DataFrame:
        """The table as it is now, with its bucket columns."""
        return self.spark.read.parquet(f"{self.path}/{name}")

    def with_id_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("id_bucket", bucket_of("image_id", self.span))

    def with_key_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("key_bucket", F.pmod(F.xxhash64(*IMAGE_KEY), F.lit(self.key_buckets)).cast("bigint"))

    def put(self, name: str, rows: DataFrame, mode: str) -> None:
        """Write rows by bucket, one sorted file each."""
        parts = PARTITIONS[name]
        order = "image_id"
        dealt = rows.repartition(*parts).sortWithinPartitions(*parts, order)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{name}")

    # --- reading ---

    def in_buckets(self, name: str, touched: list[tuple]) -> DataFrame:
        """The rows of these buckets; each entry has a value for each partition column of the table."""
        parts = PARTITIONS[name]
        t = self.table(name)
        if len(parts) == 1:
            return t.where(F.col(parts[0]).isin([b for (b,) in touched]))
        by_model: dict[str, list[int]] = {}
        for model, bucket in touched:
            by_model.setdefault(model, []).append(bucket)
        some = F.lit(False)
        for model, of_model in by_model.items():
            some = some | ((F.col("model_id") == model) & F.col("id_bucket").isin(of_model))
        return t.where(some)

    def touched(self, name: str, rows: DataFrame) -> list[tuple]:
        """The distinct buckets of some rows: at most as many entries as the table has buckets."""
        parts = PARTITIONS[name]
        return sorted(tuple(r) for r in rows.select(*parts).distinct().collect())

    def last_id(self) -> int:
        """The largest id given out, by the footers of the images and one bucket of them."""
        images = self.table("images")
        last = images.agg(F.max("id_bucket")).first()[0]
        if last is None:
            return 0
        return images.where(F.col("id_bucket") == last).agg(F.max("image_id")).first()[0]

    def find_ids(self, keys: DataFrame) -> DataFrame:
        """(source_site, source_post_id, image_id) of those keys that have an id; reads the key buckets of the batch."""
        keys = self.with_key_bucket(keys.select(*IMAGE_KEY).distinct())
        known = self.in_buckets("image_keys", self.touched("image_keys", keys))
        return known.join(broadcast_if_small(keys), ["key_bucket", *IMAGE_KEY], "left_semi").select(*IMAGE_KEY, "image_id")

    def slots(self, model_ids: list[str] = ()) -> dict[str, int]:
        """The bit of each model; models without one get the next."""
        known = {r["model_id"]: r["slot"] for r in self.table("model_slots").take(MAX_SLOTS + 1)}
        new = [m for m in dict.fromkeys(model_ids) if m not in known]
        if len(known) + len(new) > MAX_SLOTS:
            raise ValueError(f"more than {MAX_SLOTS} models")
        if new:
            added = [(m, len(known) + i) for i, m in enumerate(new)]
            self.spark.createDataFrame(added, SLOTS).coalesce(1).write.mode("append").parquet(f"{self.path}/model_slots")
            known |= dict(added)
        return known

    # --- writing ---

    def add_ids(self, rows: DataFrame) -> None:
        """Give out ids: rows (source_site, source_post_id, image_id)."""
        self.put("image_keys", self.with_key_bucket(rows.select(*IMAGE_KEY, "image_id")), "append")

    def replace(self, name: str, changed: DataFrame, key: list[str]) -> list[tuple]:
        """Put stored rows `changed` in place of those with the same key; only their buckets are read and written.

        Returns these buckets. `changed` has the table's columns but for the bucket (one that it lacks is null in its
        rows) and is read several times.
        """
        changed = self.with_id_bucket(changed)
        touched = self.touched(name, changed)
        if touched:
            old = self.in_buckets(name, touched)
            rest = old.join(broadcast_if_small(changed.select("id_bucket", *key)), ["id_bucket", *key], "left_anti")
            self.put(name, rest.unionByName(changed, allowMissingColumns=True), "overwrite")
        return touched


def masks_of(vectors: DataFrame, slots: dict[str, int]) -> DataFrame:
    """(image_id, have, indexed) of vector rows (image_id, model_id, indexed_at): the bits of the models they have, and have indexed."""
    bit = F.lit(0).cast("bigint")
    for model, slot in slots.items():
        bit = F.when(F.col("model_id") == model, F.lit(1 << slot).cast("bigint")).otherwise(bit)
    return vectors.groupBy("image_id").agg(
        F.bit_or(bit).alias("have"),
        F.bit_or(F.when(F.col("indexed_at").isNotNull(), bit).otherwise(F.lit(0).cast("bigint"))).alias("indexed"))


def create(images: DataFrame, vectors: DataFrame, path: str, codes: DataFrame | None = None,
           span: int = SPAN, key_buckets: int = KEY_BUCKETS) -> Buckets:
    """Write a catalog; codes are made from the indexed vectors unless given. An existing path is refused."""
    spark = images.sparkSession
    b = Buckets(spark, path, span, key_buckets)
    b.put("images", b.with_id_bucket(images), "errorifexists")
    b.put("image_vectors", b.with_id_bucket(vectors), "errorifexists")
    if codes is None:
        codes = b.table("image_vectors").where("indexed_at IS NOT NULL").select(
            "image_id", "model_id", V.encode_sign_bulk(F.col("vector")).alias("code"))
    b.put("codes", b.with_id_bucket(codes.select("image_id", "model_id", "code")), "errorifexists")
    b.put("image_keys", b.with_key_bucket(b.table("images").select(*IMAGE_KEY, "image_id")), "errorifexists")
    spark.createDataFrame([], SLOTS).write.parquet(f"{path}/model_slots")
    stored = b.table("image_vectors")
    slots = b.slots([r["model_id"] for r in stored.select("model_id").distinct().orderBy("model_id").take(MAX_SLOTS + 1)])
    b.put("image_masks", b.with_id_bucket(masks_of(stored, slots)), "errorifexists")
    spark.range(1).select(F.lit(span).alias("span"), F.lit(key_buckets).alias("key_buckets")).coalesce(1).write.parquet(f"{path}/layout")
    return b


def open_buckets(spark: SparkSession, path: str) -> Buckets:
    row = spark.read.parquet(f"{path}/layout").first()
    return Buckets(spark, path, row["span"], row["key_buckets"])
