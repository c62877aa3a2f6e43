"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document expects `target / source_size` copies. Within a source the expected
copies are summed up in order; with an offset added, a document is emitted
once for each whole number its stretch of the sum crosses. Expected copies are whole
multiples of 2^-20, so sums are exact and the same on every run. The order goes by
size, so each run of documents of like size comes as often as it should, within one:
whatever the offset, the words taken miss the target by less than the longest document.
Of 64 offsets evenly apart from a random one on, a source takes the one nearest its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .queries import query
from .tables import checked_broadcast, materialize, places, table

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), (3, 2), 2, "mix"
UNIT_BITS, OFFSETS = 20, 64


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
                   most: int = MOST) -> DataFrame:
    """(source, rank, source_size, target, expected): one row per source; `rank` is its place by code point.

    `weights` repeat over the sources by code point, null last. The targets sum to
    share[0] / share[1] of all words, and none is above `most` times its source: a source whose
    part would be larger stops there and the others share the rest by weight, until
    none is above. That level is found in closed form: with the sources sorted by
    size / weight, the first few stop, and what is left is shared by the others.
    `expected` is the number of copies per document, in units of 2^-UNIT_BITS.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = per.withColumn("__rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("__weight", weight.cast("long"))
    by_fill = everything.orderBy(F.col("source_size") / F.col("__weight"), "__rank")
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.select(
        "*", F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("__stopped"),
        (F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(upto), F.lit(0))).alias("__open"),
        F.sum("source_size").over(everything).alias("__all"))
    # level if the sources before this one have stopped; the first source that isn't above it sets it
    level = (F.col("__all") * share[0] / share[1] - F.col("__stopped") * most) / F.col("__open")
    filled = filled.withColumn("__level", level).withColumn(
        "__fits", F.col("__level") * F.col("__weight") <= F.col("source_size") * most)
    filled = filled.withColumn("__final", F.first(F.when(F.col("__fits"), F.col("__level")), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    top = (F.col("source_size") * most).cast("double")
    target = F.coalesce(F.least(top, F.col("__final") * F.col("__weight")), top)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << UNIT_BITS)))
    return filled.withColumn("target", target).select(
        "source", F.col("__rank").alias("rank"), "source_size", "target", F.coalesce(expected, F.lit(0)).cast("long").alias("expected"))


def offset(source: str, seed: str = SEED) -> Column:
    """The source's first offset: 20 bits of a digest of the seed and its name."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(source), F.lit("\0")))
    return F.conv(F.substring(F.md5(text), 1, UNIT_BITS // 4), 16, 10).cast("long")


def copies(sized: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """`sized` (doc_id, source, size, tie, row) with its source's source_size and target, and the `copies` to emit.

    All documents of a source expect the same, so the sum before one is its place times that. Places
    come from one sort in ranges over all sources; a hot source spreads over as many tasks as it fills.
    Both tables are stored, `row` is different in each row and settles what equal rows get.
    """
    per = targets.withColumnRenamed("source", "__source").withColumn("__offset", offset("__source", seed))
    joined = sized.join(checked_broadcast(per, 128), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = places(joined, ["rank"], ["size", "doc_id", "tie", "row"])
    chosen = materialize(nearest_offsets(placed), "mix-offsets")
    placed = placed.drop("__offset").join(checked_broadcast(chosen, 16), "rank")
    return placed.select("doc_id", "source", "size", "row", "source_size", "target", crossed(F.col("__offset")).alias("copies"))


def crossed(offset: Column) -> Column:
    before = F.col("idx") * F.col("expected") + offset
    return F.shiftright(before + F.col("expected"), UNIT_BITS) - F.shiftright(before, UNIT_BITS)


def nearest_offsets(placed: DataFrame) -> DataFrame:
    """(rank, __offset): of OFFSETS offsets evenly apart from the source's first one on, the one whose words are nearest its target.

    One pass over (rank, idx, expected, size, target, __offset) that adds up the words of every offset; of equals the first is taken.
    """
    tried = [(F.col("__offset") + i * ((1 << UNIT_BITS) // OFFSETS)) % (1 << UNIT_BITS) for i in range(OFFSETS)]
    words = placed.groupBy("rank", "target", "__offset").agg(*[F.sum(crossed(o) * F.col("size")).alias(f"w{i}") for i, o in enumerate(tried)])
    misses = F.array(*[F.struct(F.abs(F.col(f"w{i}") - F.col("target")).alias("miss"), F.lit(i).alias("i"), o.alias("offset"))
                       for i, o in enumerate(tried)])
    return words.select("rank", F.array_min(misses)["offset"].alias("__offset"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of `docs`.

    A null or empty text has size 0 and is taken as often as others of its source; it adds no
    words. A null source is a source of its own; a source without words has target 0 and is not
    taken. Repeated rows and equal sizes each have their own stretch. Texts of any length count whole. An empty
    table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count().alias("size"), F.lit(0).alias("tie"), F.monotonically_increasing_id().alias("row"))
    sized = materialize(rows, "mix-sizes")
    return copies(sized, materialize(source_targets(sized), "mix-targets")).drop("row")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, in its own columns.

    Nulls, ties, empty texts and repeated rows as in `mix`; texts of any length count whole. Of an empty table nothing is taken.
    """
    stored = materialize(docs.select(F.struct("*").alias("doc"), word_count().alias("size"), F.xxhash64("text").alias("tie"),
                                     F.monotonically_increasing_id().alias("row")), "mix-documents")
    sized = stored.select("doc.doc_id", "doc.source", "size", "tie", "row")
    taken = copies(sized, materialize(source_targets(sized), "mix-targets")).where("copies > 0").select("row", "copies")
    return stored.join(taken, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
filled AS (SELECT *, coalesce(sum(source_size) OVER o, 0)::DOUBLE AS stopped,
                  (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS open_w, (sum(source_size) OVER ())::DOUBLE AS everything
           FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, (everything * 3 / 2 - stopped * 2) / open_w AS level FROM filled),
final AS (SELECT min_by(level, source_size::DOUBLE / w + 1e-12 * r) AS level FROM levelled WHERE level * w <= source_size * 2),
targets AS (SELECT source, source_size,
                   coalesce(least(source_size * 2.0::DOUBLE, (SELECT level FROM final) * w), source_size * 2.0::DOUBLE) AS target
            FROM levelled),
expected AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 1048576)::BIGINT ELSE 0 END AS step,
                    ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 5))::BIGINT AS start FROM targets),
placed AS (SELECT s.doc_id, s.source, s.size, e.source_size, e.target, e.step,
                  (row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) - 1) * e.step AS sums, e.start
           FROM sized s JOIN expected e ON s.source IS NOT DISTINCT FROM e.source),
tried AS (SELECT source, i, (start + i * 16384) % 1048576 AS pos,
                 abs(sum((((sums + step + (start + i * 16384) % 1048576) >> 20) - ((sums + (start + i * 16384) % 1048576) >> 20)) * size) - target) AS off
          FROM placed, range(64) t(i) GROUP BY source, i, start, target),
chosen AS (SELECT source, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, i) AS r FROM tried) WHERE r = 1)
SELECT doc_id, size, source_size, target, (((sums + step + pos) >> 20) - ((sums + pos) >> 20)) * size AS taken
FROM placed p JOIN chosen c ON p.source IS NOT DISTINCT FROM c.source
"""


@query("op4_mix_sources", SQL)
def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
