"""Upserts as pure transforms: old rows + new rows -> merged rows.

New rows are first reduced to one per key with a map-side combined aggregate, so
repeated keys cannot pile up. For the two big tables (images, vectors) untouched
old rows then pass straight through: when the batch of new keys is counted to be
small it is broadcast, and the stored table is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.operators.ranking import row_numbers
from imgtrace.operators.setdiff import as_ts
from imgtrace.session import broadcast_if_small

IMAGE_KEY = ["source_site", "source_post_id"]
KEEP_IF_NEW_EMPTY = ("phash", "dhash", "thumb_path")


def latest_per_key(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Last arrival wins, of equal ones that with the largest content digest; the arrival column is dropped."""
    rest = [c for c in df.columns if c not in keys and c != arrival]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(arrival), F.xxhash64(*rest))).alias("_r")).select(*keys, "_r.*")


def merge(old: DataFrame, new: DataFrame, keys: list[str],
          rules: dict[str, Callable[[Column, Column, Column, Column], Column]],
          how: str = "full_outer") -> DataFrame:
    """Join and reduce by key. A rule gets (old value, new value, old exists, new exists)."""
    def side(df, name):
        return df.select(*keys, F.struct(F.lit(1).alias("_x"), *[
            c for c in df.columns if c not in keys]).alias(name))

    j = side(old, "_o").join(side(new, "_n"), keys, how)
    has_old, has_new = F.col("_o._x").isNotNull(), F.col("_n._x").isNotNull()
    null = F.lit(None)
    cols = []
    for name, rule in rules.items():
        o = F.col(f"_o.{name}") if name in old.columns else null
        n = F.col(f"_n.{name}") if name in new.columns else null
        cols.append(rule(o, n, has_old, has_new).alias(name))
    return j.select(*keys, *cols)


def split_touched(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Old rows whose key is in `new`, and all others."""
    touched_keys = broadcast_if_small(new.select(*keys))
    return old.join(touched_keys, keys, "left_semi"), old.join(touched_keys, keys, "left_anti")


def take_new(o, n, has_o, has_n):
    return F.when(has_n, n).otherwise(o)


def keep_old(o, n, has_o, has_n):
    return F.when(has_o, o).otherwise(n)


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def upsert_images(old: DataFrame, new: DataFrame, now, arrival: str = "arrival",
                  last_id: Column | None = None) -> DataFrame:
    """Catalog upsert on (site, post).

    New values win, except that an empty new hash or thumbnail keeps the old
    one; id and creation time survive. New posts get ids after the largest old
    id, in (post, site) order. With `last_id` naming that largest id, `old` is
    taken to hold only rows that `new` changes, and only changed rows come back.
    """
    at = as_ts(now)
    fresh = latest_per_key(new, IMAGE_KEY, arrival)
    texts = [f.name for f in fresh.schema if f.dataType.simpleString() == "string"
             and f.name not in IMAGE_KEY]
    arrays = [f.name for f in fresh.schema if f.dataType.simpleString().startswith("array")]
    fresh = fresh.select(*[
        _blank_to_null(F.col(c)).alias(c) if c in texts
        else F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c in arrays
        else F.col(c) for c in fresh.columns])
    rules = {"image_id": lambda o, n, ho, hn: o.cast("bigint")}
    for c in fresh.columns:
        if c in IMAGE_KEY or c in ("image_id", "created_at", "updated_at"):
            continue
        if c in KEEP_IF_NEW_EMPTY:
            rules[c] = lambda o, n, ho, hn: F.coalesce(n, o)
        else:
            rules[c] = take_new
    rules["created_at"] = lambda o, n, ho, hn: F.when(ho, o).otherwise(at)
    rules["updated_at"] = lambda o, n, ho, hn: F.when(hn, at).otherwise(o)
    touched, untouched = (old, None) if last_id is not None else split_touched(old, fresh, IMAGE_KEY)
    # Only what the rules read is taken from the touched rows.
    slim = touched.select(*IMAGE_KEY, *[c for c in ("image_id", "created_at", *KEEP_IF_NEW_EMPTY)
                                        if c in touched.columns])
    merged = merge(slim, fresh, IMAGE_KEY, rules, "right_outer")
    top = last_id if last_id is not None else old.select(F.max("image_id")).scalar()
    top = F.coalesce(top, F.lit(0))
    added = row_numbers(
        merged.where(F.col("image_id").isNull()).withColumn("_all", F.lit(0)),
        ["_all"], "source_post_id", ["source_site"], "_rn")
    added = added.withColumn("image_id", (F.col("_rn") + top).cast("bigint")).drop("_rn", "_all")
    out = merged.where(F.col("image_id").isNotNull()).unionByName(added)
    return out if untouched is None else untouched.select(*merged.columns).unionByName(out)


def upsert_vectors(old: DataFrame, new: DataFrame, now, arrival: str = "arrival") -> DataFrame:
    """A written vector is pending again; its first creation time stays."""
    key = ["image_id", "model_id"]
    fresh = latest_per_key(new, key, arrival)
    none = F.lit(None).cast("timestamp")
    touched, untouched = split_touched(old, fresh, key)
    merged = merge(touched.select(*key, "created_at"), fresh, key, {
        "vector": take_new,
        "created_at": lambda o, n, ho, hn: F.when(ho, o).otherwise(as_ts(now)),
        "indexed_at": lambda o, n, ho, hn: none,
    }, "right_outer")
    return untouched.select(*merged.columns).unionByName(merged)


def mark_indexed(vectors: DataFrame, ids: DataFrame, model_ids: list[str], now) -> DataFrame:
    """Set indexed_at for the given images under the given models."""
    hit = broadcast_if_small(ids.select("image_id").distinct().withColumn("_hit", F.lit(True)))
    of_model = F.col("model_id").isin(*model_ids) if model_ids else F.lit(False)
    return (
        vectors.join(hit, "image_id", "left")
        .withColumn("indexed_at", F.when(F.col("_hit") & of_model, as_ts(now))
                    .otherwise(F.col("indexed_at")))
        .drop("_hit")
    )


def upsert_model(models: DataFrame, model: dict) -> DataFrame:
    """Register or change one model; activating it rests the others of its kind."""
    row = models.sparkSession.createDataFrame([model], models.schema)
    others = models.where(F.col("model_id") != model["model_id"])
    if model["active"]:
        others = others.withColumn(
            "active", F.when(F.col("kind") == model["kind"], False).otherwise(F.col("active")))
    return others.unionByName(row)


def put_queries(cache: DataFrame, new: DataFrame, now, arrival: str = "arrival") -> DataFrame:
    """Query-cache put: a known entry only renews its hash and last use."""
    key = ["sha256", "model_id"]
    fresh = latest_per_key(new, key, arrival)
    return merge(cache, fresh, key, {
        "vector": keep_old,
        "phash": take_new,
        "hits": lambda o, n, ho, hn: F.when(ho, o).otherwise(0).cast("bigint"),
        "last_used_at": lambda o, n, ho, hn: F.when(hn, as_ts(now)).otherwise(o),
    })


def count_hits(cache: DataFrame, log: DataFrame) -> DataFrame:
    """Add the hits of a request log(sha256, model_id, at) to usable cache entries."""
    used = log.groupBy("sha256", "model_id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    usable = F.coalesce(F.col("phash"), F.lit("")) != ""
    n = F.when(usable, F.coalesce("_n", F.lit(0))).otherwise(0)
    return (
        cache.join(used, ["sha256", "model_id"], "left")
        .withColumn("hits", F.col("hits") + n)
        .withColumn("last_used_at", F.when(n > 0, F.greatest("last_used_at", "_at"))
                    .otherwise(F.col("last_used_at")))
        .drop("_n", "_at")
    )


def enqueue_retries(old: DataFrame, ids: DataFrame, now, delay_seconds: int = 60) -> DataFrame:
    """Failed posts wait for a retry; one that already succeeded is left alone."""
    due = as_ts(now) + F.make_dt_interval(secs=F.lit(delay_seconds))
    key = ["source_site", "scope_key", "source_post_id"]
    open_again = lambda o, ho, hn: hn & (~ho | (o != "succeeded"))
    j = (
        old.withColumn("_o", F.lit(True))
        .join(ids.select(*key).distinct().withColumn("_n", F.lit(True)), key, "full_outer")
    )
    again = open_again(F.col("status"), F.col("_o").isNotNull(), F.col("_n").isNotNull())
    return (
        j.withColumn("_again", again)
        .withColumn("ready_at", F.when(F.col("_again"), due).otherwise(F.col("ready_at")))
        .withColumn("status", F.when(F.col("_again"), "pending").otherwise(F.col("status")))
        .withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        .drop("_o", "_n", "_again")
    )


def record_probes(log: DataFrame, arrival: str) -> DataFrame:
    """Last probe per (node, host, mode)."""
    return latest_per_key(log, ["node_id", "host", "mode"], arrival)


def record_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Samples already present for (node, time) stay; of repeated new ones that with the largest digest.

    Only the old samples of the new ones' times and nodes are looked at.
    """
    key = ["node_id", "observed_at"]
    once = latest_per_key(new.withColumn("_same", F.lit(0)), key, "_same")
    low, high = once.select(F.min("observed_at")).scalar(), once.select(F.max("observed_at")).scalar()
    near = old.where(F.col("observed_at").between(low, high)).select(*key)
    return old.unionByName(once.join(near, key, "left_anti"))


def init_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """new(site, scope, latest_id): the frontier is set once, the high mark only rises."""
    n = new.groupBy("source_site", "scope_key").agg(F.max("latest_id").alias("high_watermark_id"))
    n = n.withColumn("backfill_before_id", F.col("high_watermark_id"))
    return merge(old, n, ["source_site", "scope_key"], {
        "high_watermark_id": lambda o, w, ho, hn: F.when(
            hn, F.greatest(F.coalesce(o, F.lit(0)), w)).otherwise(o),
        "backfill_before_id": lambda o, w, ho, hn: F.coalesce(o, w),
    })


def advance_watermark(state: DataFrame, seen: DataFrame) -> DataFrame:
    """Raise the high mark to the largest seen id; it never goes back."""
    n = seen.groupBy("source_site", "scope_key").agg(F.max("post_id").alias("_seen"))
    return (
        state.join(n, ["source_site", "scope_key"], "left")
        .withColumn("high_watermark_id",
                    F.when(F.col("_seen").isNotNull(),
                           F.greatest(F.coalesce("high_watermark_id", F.lit(0)), "_seen"))
                    .otherwise(F.col("high_watermark_id")))
        .drop("_seen")
    )


def active_model_per_kind(models: DataFrame) -> DataFrame:
    """One active model per kind, and which one search uses (copy before any other)."""
    per_kind = Window.partitionBy("kind").orderBy("model_id")
    act = models.where("active").withColumn("_rn", F.row_number().over(per_kind)).where("_rn = 1")
    first = act.select(F.min_by("model_id", F.struct(F.when(F.col("kind") == "copy", 0).otherwise(1),
                                                     F.col("model_id")))).scalar()
    return act.select("kind", "model_id", (F.col("model_id") == first).alias("is_primary"))
