"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are turned into the axes of their principal components, largest first, so that the leading
dimensions hold as much of every product as they can. For unit vectors x, y and any number k of them

    x . y  <=  x[:k] . y[:k] + |x[k:]| |y[k:]|,

so a pair whose right side stays under the threshold is done after k dimensions.

* Equal vectors are one class with a count. Classes are numbered by their first component and cut into tiles of
  at most `TILE` rows. Two linked unit vectors are at most sqrt(2 - 2 * threshold) apart, hence
  also along the first component: a tile meets the tiles in that reach only, a run of tile numbers.
* Two tiles meet in a unit of work of bounded size. Blocks whose boxes over the leading components are too far apart
  are skipped. Of the others one product gives leading dimensions plus bound for all pairs at once (the suffix norm
  is one more dimension); what is left takes more dimensions pair by pair, and the cosine of the original
  vectors, in double precision, decides.
* A unit never returns its pairs. It returns how many links each class has there and a forest of what they
  join, at most a row per class. Counts are added up and forests joined by a components job over all units.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import components
from .queries import query
from .tables import checked_broadcast, materialize, places, table, take_columns

THRESHOLD = 0.9
#: Most rows of a tile; rows below which a tile isn't cut further for the sake of more tasks.
TILE, SMALL = 1 << 16, 1 << 11
#: Components in a tile's box; rows of one side and of the other that are multiplied at once.
BOX, ROWS, COLUMNS = 8, 512, 8192
#: Parts of the dimensions after which a pair may be given up.
STOPS = (3 / 8, 5 / 8)
#: Rounding margin of products of single precision, and of those that are computed again in one fixed order.
MARGIN, CLOSE = 1e-4, 1e-9


# --- vectors ---------------------------------------------------------------------------------

def usable(v: str) -> Column:
    """Is the vector not null, empty or zero, and are all its components finite?"""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # first scaled, so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def rotation(classes: DataFrame, width: int) -> np.ndarray:
    """The principal axes of all vectors as columns, largest first. Sums are joined task by task, width x width numbers each."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                x = units(matrix(batch.column(0).slice(lo, 8192), width))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(batches):
        total = np.zeros(width * width)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = classes.select("v").mapInArrow(products, "m binary")
    m = parts.repartition(16).mapInArrow(added, "m binary").repartition(1).mapInArrow(added, "m binary").first()["m"]
    return np.ascontiguousarray(np.linalg.eigh(np.frombuffer(m).reshape(width, width))[1][:, ::-1])


def projected(classes: DataFrame, axes: np.ndarray) -> DataFrame:
    """`classes` (node, n, v) with `lead`, the first components of each unit vector."""
    sent = classes.sparkSession.sparkContext.broadcast(axes[:, :BOX].copy())

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lead = units(matrix(batch.column(2), len(axes))) @ sent.value
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1) * lead.shape[1], pa.int32()), pa.array(lead.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "lead"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("node", "n", "v").mapInArrow(run, f"node long, n long, v {kind}, lead array<double>")


# --- a unit of work --------------------------------------------------------------------------

class Side:
    """One tile in a unit: original unit vectors, the turned ones, suffix norms, boxes of blocks."""

    def __init__(self, v: np.ndarray, axes: np.ndarray, stops: list[int]):
        self.x = units(v)
        turned = self.x @ axes
        self.turned = turned.astype(np.float32)
        self.tails = [np.sqrt((turned[:, k:] ** 2).sum(1)).astype(np.float32) for k in stops]
        self.first = np.concatenate((self.turned[:, :stops[0]], self.tails[0][:, None]), 1)
        self.lead = turned[:, :BOX]

    def __len__(self) -> int:
        return len(self.x)

    def box(self, lo: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.lead[lo:lo + size]
        return part.min(0), part.max(0)


def linked_pairs(a: Side, b: Side, same: bool, stops: list[int], threshold: float):
    """Arrays (i, j) of pairs with cosine >= threshold, block by block; within one tile each pair once, i < j."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + MARGIN
    low = np.float32(threshold - MARGIN)
    for p in range(0, len(a), ROWS):
        a_low, a_high = a.box(p, ROWS)
        for q in range(p // COLUMNS * COLUMNS if same else 0, len(b), COLUMNS):
            b_low, b_high = b.box(q, COLUMNS)
            apart = np.maximum(0, np.maximum(a_low - b_high, b_low - a_high))
            if (apart * apart).sum() > reach * reach:
                continue
            bound = a.first[p:p + ROWS] @ b.first[q:q + COLUMNS].T
            i, j = np.nonzero(bound >= low)
            if same:
                ok = i + p < j + q
                i, j = i[ok], j[ok]
            if 10 * len(i) > bound.size:  # a dense block: all its cosines in one product
                cosine = (a.x[p:p + ROWS] @ b.x[q:q + COLUMNS].T)[i, j]
                keep = cosine >= threshold - CLOSE
                i, j, cosine = i[keep] + p, j[keep] + q, cosine[keep]
                yield _settled(a, b, i, j, cosine, threshold)
                continue
            dots = bound[i, j] - a.tails[0][i + p] * b.tails[0][j + q]
            for lo in range(0, len(i), 1 << 16):
                yield _pair_by_pair(a, b, i[lo:lo + (1 << 16)] + p, j[lo:lo + (1 << 16)] + q, dots[lo:lo + (1 << 16)], stops, threshold)


def _pair_by_pair(a: Side, b: Side, i: np.ndarray, j: np.ndarray, dots: np.ndarray, stops: list[int], threshold: float):
    for n in range(1, len(stops)):
        more = slice(stops[n - 1], stops[n])
        dots = dots + np.einsum("ij,ij->i", a.turned[i, more], b.turned[j, more])
        ok = dots + a.tails[n][i] * b.tails[n][j] >= threshold - MARGIN
        i, j, dots = i[ok], j[ok], dots[ok]
    return _settled(a, b, i, j, (a.x[i] * b.x[j]).sum(1), threshold)


def _settled(a: Side, b: Side, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, threshold: float):
    """Pairs at or above the threshold; what is within rounding of it is summed once more, with no rounding between."""
    for k in np.flatnonzero(np.abs(cosine - threshold) < CLOSE).tolist():
        x, y = a.x[i[k]], b.x[j[k]]
        cosine[k] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))
    ok = cosine >= threshold
    return i[ok], j[ok]


class Forest:
    """Sets of numbers 0..n-1, joined pair by pair in arrays; every set is known by its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = self.up[i], self.up[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


def compared(node, n, side, v: np.ndarray, axes: np.ndarray, threshold: float) -> pa.RecordBatch:
    """(node, links, root) of the classes that have a link in this unit; `side` 0 comes first, a tile alone meets itself."""
    width = len(axes)
    stops = sorted({max(1, min(width, round(width * s))) for s in STOPS})
    cut = int((side == 0).sum())
    a = Side(v[:cut], axes, stops)
    same = cut == len(v)
    b = a if same else Side(v[cut:], axes, stops)
    shift = 0 if same else cut
    links, forest = np.zeros(len(v), np.int64), Forest(len(v))
    for i, j in linked_pairs(a, b, same, stops, threshold):
        j = j + shift
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        forest.join(i, j)
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[forest.up[hit]])], ["node", "links", "root"])


def in_units(rows: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """`compared` for each unit of rows (unit, side, node, n, v)."""
    sent = rows.sparkSession.sparkContext.broadcast(axes)

    def done(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(waiting).combine_chunks()
        node, n, side = (t[c].to_numpy() for c in ("node", "n", "side"))
        return compared(node, n, side, matrix(t["v"].combine_chunks(), len(sent.value)), sent.value, threshold)

    def run(batches):
        unit, waiting = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(u)) + 1).tolist(), len(u)]
            for lo, hi in zip(cuts, cuts[1:]):
                if u[lo] != unit and waiting:
                    yield done(waiting)
                    waiting = []
                unit = u[lo]
                waiting.append(batch.slice(lo, hi - lo))
        if waiting:
            yield done(waiting)

    return rows.sortWithinPartitions("unit", "side").mapInArrow(run, "node long, links long, root long")


# --- the operator ----------------------------------------------------------------------------

def tile_count(n: int, cores: int, tile: int = TILE) -> int:
    """Tiles of `n` classes: none too large, and if there are rows for it enough units for all cores."""
    return max(1, math.ceil(n / tile), min(math.ceil(n / SMALL), math.ceil(math.sqrt(4 * cores))))


def links_of_width(classes: DataFrame, width: int, threshold: float, tile: int = TILE) -> DataFrame:
    """(node, links, root), a row per class and unit in which it has links, of classes (node, n, v) of one width (a stored table)."""
    spark = classes.sparkSession
    axes = rotation(classes, width)
    lead = projected(classes, axes).withColumn("__one", F.lit(0))
    lead = lead.withColumns({"__key": F.col("lead")[0]})
    tiles = tile_count(classes.count(), spark.sparkContext.defaultParallelism, tile)
    put = places(materialize(lead, "tile-lead"), ["__one"], ["__key", "node"]).select(
        "node", "n", "v", "__key", F.expr(f"idx * {tiles} div m").alias("tile"))
    put = materialize(put, "tile-rows")
    # one row per tile, which stands for up to TILE vectors
    ends = put.groupBy("tile").agg(F.min("__key").alias("low"), F.max("__key").alias("high")).orderBy("tile").toPandas()
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + MARGIN
    low, high, number = (ends[c].to_numpy() for c in ("low", "high", "tile"))
    last = number[np.searchsorted(low, high + reach, "right") - 1] if len(ends) else number
    first = number[np.searchsorted(high, low - reach, "left")] if len(ends) else number
    partners = spark.createDataFrame(
        [tuple(map(int, x)) for x in zip(number, first, last)], "tile long, first long, last long")
    met = put.drop("__key").join(F.broadcast(partners), "tile")
    as_first = met.withColumn("q", F.explode(F.sequence("tile", "last"))).select(
        (F.col("tile") * tiles + F.col("q")).alias("unit"), F.lit(0).alias("side"), "node", "n", "v")
    as_second = met.where("first < tile").withColumn("p", F.explode(F.sequence(F.col("first"), F.col("tile") - 1))).select(
        (F.col("p") * tiles + F.col("tile")).alias("unit"), F.lit(1).alias("side"), "node", "n", "v")
    # one number after another for the units, so that no two of them share a partition while others are empty
    p, q = F.expr(f"unit div {tiles}"), F.expr(f"unit % {tiles}")
    slots = min(tiles * (tiles + 1) // 2, 100_000)
    slot = F.pmod(p * tiles - F.expr("unit div {0} * (unit div {0} - 1) div 2".format(tiles)) + q - p, F.lit(slots)).cast("int")
    rows = as_first.unionByName(as_second).withColumn("slot", slot)
    return in_units(rows.repartitionById(slots, "slot").drop("slot"), axes, threshold)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding; a stored table).

    A vector that is null, empty or zero or holds a null or non-finite component has no links; vectors of different
    lengths have no cosine and aren't linked. Every row is a vector of its own: equal ones link with each other, and rows
    that share a vec_id are linked only by their vectors, though their component is known by that id. A null
    vec_id links as others do and names a component only if all ids in it are null. Of an empty table there are no rows.
    Lengths are taken one after another (there is one per model).
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = take_columns(vectors, vec_id="long", embedding=kind).withColumnRenamed("embedding", "v")
    rows = rows.select("vec_id", F.when(usable("v"), F.col("v")).alias("v"))
    rows = materialize(rows.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}), "tile-vectors")
    classes = rows.where("v IS NOT NULL").groupBy("h", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "tile-classes")
    found = None
    for r in classes.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy("w").collect():
        part = links_of_width(classes.where(F.size("v") == r["w"]).select("node", "n", "v"), r["w"], threshold, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "tile-links")
    label = materialize(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "tile-components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "h", "h2", "rep", "n").join(links, "node", "left").join(
        label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select(
        "h", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    known = checked_broadcast(materialize(known, "tile-known"), 64)
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h")).alias("h"), "h2").join(known, ["h", "h2"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))


@query("op12_pca_tiles", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (WITH RECURSIVE r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id AND r.c < l.b) SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN r ON r.id = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id""")
def op12_pca_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "embeddings"))
