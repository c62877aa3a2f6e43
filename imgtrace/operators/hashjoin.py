"""Near-duplicate join of perceptual hashes by multi-index hashing.

Two 64-bit words that differ in at most t bits, cut into m bands with radii r_1..r_m that add up to
t - m + 1, agree in some band j to within r_j bits (otherwise they would differ in t + 1 places). So it is enough
to look each band of a query up in the same band of the gallery, with every change of up to r_j of its bits.

* Both sides are joined as *distinct* words. A word that a third of all pictures share is one row, and what it
  matches is one row per distinct word; pictures come back as counts and smallest ids, or by membership.
* A few wide bands mean short buckets and many changed keys, many narrow ones the opposite. The
  plan is chosen by the expected number of rows for the number of distinct words.
* A pair that several bands find is kept in the first of them only, by looking at the words: no distinct.
* At many bits (20 of 64) bands exclude little: a word's rows in the join grow with the table, as its pairs do. Where comparing it
  with every word is less work, counts and nearest pictures come from a scan of the distinct words (`knn.words_within`).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgtrace.functions import hashes as H
from imgtrace.session import materialize

WORD = 64
#: Most changed keys of one band; wider radii are never planned.
MAX_KEYS = 4096
#: Words that a scan compares in the time that the join takes for a row.
COMPARED = 100


@dataclass(frozen=True)
class Band:
    """Bits `low`..`low + width - 1` of a word, looked up with up to `radius` of them changed."""

    low: int
    width: int
    radius: int

    @property
    def keys(self) -> int:
        return sum(comb(self.width, r) for r in range(self.radius + 1))

    def of(self, word: Column) -> Column:
        shifted = F.shiftrightunsigned(word, self.low)
        return shifted if self.width == WORD else shifted.bitwiseAND(F.lit((1 << self.width) - 1))

    def changes(self) -> list[int]:
        """The bit masks that a key is changed by."""
        return [_signed(sum(1 << b for b in bits))
                for r in range(self.radius + 1) for bits in combinations(range(self.width), r)]


def _signed(n: int) -> int:
    return n - (1 << WORD) if n >> (WORD - 1) else n


def bands(bits: int, m: int) -> list[Band]:
    """`m` bands over a word that find every pair within `bits`; the wider bands have the smaller radii."""
    sure, extra = divmod(bits - m + 1, m)
    wide, low, out = WORD % m, 0, []
    for j in range(m):
        width = WORD // m + (j < wide)
        out.append(Band(low, width, sure + (j >= m - extra)))
        low += width
    return out


def rows_per_word(plan_: list[Band], words: int) -> float:
    """A query key costs a row and meets the words of one bucket; a gallery word costs a row per band."""
    return sum(x.keys * (1 + words / 2.0 ** x.width) + 1 for x in plan_)


def plan(bits: int, words: int) -> list[Band]:
    """The bands with the least expected work for `words` distinct words on either side."""
    if not 0 <= bits < WORD:
        raise ValueError(f"bits must be within 0..{WORD - 1}")
    options = [b for b in (bands(bits, m) for m in range(1, bits + 2)) if all(x.keys <= MAX_KEYS for x in b)]
    return min(options, key=lambda b: rows_per_word(b, words))


def distinct_words(pictures: DataFrame, id_column: str) -> DataFrame:
    """(word, n, least): the distinct hashes of rows (id, phash), how many have each and the smallest id; others have no word."""
    return (
        pictures.select(H.hash_to_long(F.col("phash")).alias("word"), F.col(id_column).alias("id"))
        .where("word IS NOT NULL")
        .groupBy("word").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    )


def _looked_up(words: DataFrame, plan_: list[Band], changed: bool) -> DataFrame:
    """(band, key, word): one row per band, and for `changed` one per key to look at."""
    def keys(b: Band) -> Column:
        own = b.of(F.col("word"))
        return F.transform(F.lit(b.changes()), lambda m: own.bitwiseXOR(m)) if changed and b.radius else F.array(own)

    rows = F.array(*[F.struct(F.lit(j).alias("band"), keys(b).alias("keys")) for j, b in enumerate(plan_)])
    return words.select("word", F.explode(rows).alias("r")).select(
        F.col("r.band").alias("band"), F.explode("r.keys").alias("key"), "word")


def _earlier_band(plan_: list[Band], band: Column, differ: Column) -> Column:
    """Does a band before this one find the pair, too?"""
    hit = F.lit(False)
    for j, b in enumerate(plan_[:-1]):
        hit = hit | ((band > j) & (F.bit_count(b.of(differ)) <= b.radius))
    return hit


def near_words(left: DataFrame, right: DataFrame, bits: int, words: int | None = None) -> DataFrame:
    """(left_word, right_word, distance) of all pairs of distinct words (word) within `bits`, each once.

    `words`: about how many there are on a side; counted if not given. Both sides are read several times.
    """
    p = plan(bits, right.count() if words is None else words)
    a = _looked_up(left.select("word"), p, True).withColumnRenamed("word", "left_word")
    b = _looked_up(right.select("word"), p, False).withColumnRenamed("word", "right_word")
    differ = F.col("left_word").bitwiseXOR(F.col("right_word"))
    return (
        a.join(b, ["band", "key"])
        .where((F.bit_count(differ) <= bits) & ~_earlier_band(p, F.col("band"), differ))
        .select("left_word", "right_word", F.bit_count(differ).alias("distance"))
    )


def matches_per_word(left: DataFrame, right: DataFrame, bits: int, others: bool = False) -> DataFrame:
    """(word, matches, b: (distance, least)) of left(word) x right(word, n, least), as `knn.words_within` has it; by bands where that is less work."""
    from imgtrace.operators import knn

    words = right.count()
    if COMPARED * rows_per_word(plan(bits, words), words) > words:
        return knn.words_within(left, right, bits, others)
    near = near_words(left, right, bits, words)
    if others:
        near = near.where("left_word <> right_word")
    stored = right.select(F.col("word").alias("right_word"), "n", "least")
    return near.join(stored, "right_word").groupBy(F.col("left_word").alias("word")).agg(
        F.sum("n").alias("matches"), F.min(F.struct("distance", "least")).alias("b"))


def hash_matches(queries: DataFrame, gallery: DataFrame, bits: int = H.SAME_IMAGE_BITS_PER_64) -> DataFrame:
    """queries(query_id, phash) x gallery(image_id, phash) -> query_id, matches, image_id, distance.

    `matches`: gallery pictures within `bits`; the nearest of them and its distance, ties by id. Queries without a match
    or a 16-digit hash aren't listed. Equal hashes on either side are looked up once.
    """
    best = matches_per_word(distinct_words(queries, "query_id"), distinct_words(gallery, "image_id"), bits)
    word = H.hash_to_long(F.col("phash"))
    return queries.select("query_id", word.alias("word")).join(best, "word").select(
        "query_id", "matches", F.col("b.least").alias("image_id"), F.col("b.distance").alias("distance"))


def matching_pictures(queries: DataFrame, gallery: DataFrame, bits: int = H.SAME_IMAGE_BITS_PER_64) -> DataFrame:
    """(query_id, image_id, distance): `hash_matches` with every match as a row of its own.

    As large as its answer: a common hash is listed for every query near it.
    """
    near = near_words(distinct_words(queries, "query_id"), distinct_words(gallery, "image_id"), bits)
    q = queries.select("query_id", H.hash_to_long(F.col("phash")).alias("left_word"))
    g = gallery.select("image_id", H.hash_to_long(F.col("phash")).alias("right_word"))
    return near.join(q, "left_word").join(g, "right_word").select("query_id", "image_id", "distance")


def same_pictures(gallery: DataFrame, bits: int = H.SAME_IMAGE_BITS_PER_64) -> DataFrame:
    """(image_id, links, nearest, distance) of every picture with a hash: how many others are within `bits`, and the nearest.

    The self-join that finds reposts. Pictures with one hash link through it; `nearest` is the smallest other id at the
    least distance, null without links.
    """
    stored = materialize(distinct_words(gallery, "image_id"), "hash-words")
    own = gallery.select("image_id", H.hash_to_long(F.col("phash")).alias("word")).where("word IS NOT NULL")
    # of an equal hash the smallest id is nearest for all but itself, for which it is the second smallest
    second = own.join(stored.select("word", "least"), "word").where("image_id <> least").groupBy("word").agg(
        F.min("image_id").alias("second"))
    best = matches_per_word(stored, stored, bits, others=True).withColumnRenamed("matches", "others")
    known = stored.join(second, "word", "left").join(best, "word", "left")
    same = F.when(F.col("image_id") == F.col("least"), F.col("second")).otherwise(F.col("least"))
    return own.join(known, "word").select(
        "image_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        F.coalesce(same, F.col("b.least")).alias("nearest"),
        F.when(same.isNotNull(), F.lit(0)).otherwise(F.col("b.distance")).alias("distance"))


def hash_search_near(queries: DataFrame, gallery: DataFrame, bits: int = H.SAME_IMAGE_BITS_PER_64) -> DataFrame:
    """(query_id, image_id, distance): the nearest picture by hash, as `search.hash_search` has it with k = 1.

    Most queries are settled by the join. Only the words of the others are scanned, against distinct words, so the scan
    is as small as what no picture resembles.
    """
    from imgtrace.operators import knn

    stored = distinct_words(gallery, "image_id")
    near = hash_matches(queries, gallery, bits).select("query_id", "image_id", "distance")
    word = H.hash_to_long(F.col("phash"))
    left = queries.where(word.isNotNull()).join(near.select("query_id"), "query_id", "left_anti")
    far = knn.nearest_codes(left.select("query_id", F.array(word).alias("code")),
                            stored.select(F.col("least").alias("image_id"), F.array("word").alias("code")), 1, width=1)
    return near.unionByName(far.select("query_id", "image_id", "distance"))
