"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut in halves and each half is quantised by its own centroids, so a
vector's cell is a pair of centroids. A query visits cells in order of the summed
distance of its halves to the two centroids, taken from a heap, until the cells visited
hold `reach` vectors; those are ranked by exact cosine. Centroids are fitted on a bounded
sample; every vector is indexed.

Vectors are dealt by cell, in blocks of bounded size, and so are the queries that visit
the cell: one block of vectors and one of queries meet in one matrix product, of which the
best few per query go on. Nothing is paired row by row, and equal vectors, however many,
fill more blocks of their cell.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imgtrace.session import shuffle_partitions

from .queries import query
from .tables import materialize, table, take_columns

#: Sample the centroids are fitted on, rounds of fitting, and centroids per half.
FIT_ROWS, ROUNDS, CENTROIDS = 20_000, 12, 32
#: Share of the vectors a query visits.
SHARE = 0.6
#: Rounding margin of a block's products against the exact scores.
CLOSE = 1e-12
VECTORS, QUERIES = 4096, 1024
TOP = 5


# --- vectors ---------------------------------------------------------------------------------

def usable(vectors: DataFrame) -> DataFrame:
    """(id, v) of the vectors that are not null or zero and have finite components only."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def units(v: np.ndarray) -> np.ndarray:
    largest = np.abs(v).max(1, keepdims=True)  # first scaled, so that no square overflows or vanishes
    v = v / largest
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def width_of(vectors: DataFrame) -> int:
    """The most frequent length; vectors of other lengths have no cosine with these."""
    top = vectors.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    return top["w"] if top else 0


# --- centroids -------------------------------------------------------------------------------

def k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(5))
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        for i in range(len(c)):
            mine = x[near == i]
            if len(mine):
                c[i] = mine.mean(0)
    return c


def fit(vectors: DataFrame, rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the two halves, from at most `rows` vectors chosen by a hash of their ids."""
    n = vectors.count()
    part = vectors
    if n > rows:
        part = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * rows / n)))
    got = part.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow()
    x = units(matrix(got["v"].combine_chunks()))
    half = x.shape[1] // 2
    return k_means(x[:, :half], centroids, ROUNDS), k_means(x[:, half:], centroids, ROUNDS)


def half_distances(x: np.ndarray, centroids: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    half = centroids[0].shape[1]
    return [((c * c).sum(1)[None, :] - 2 * p @ c.T) for p, c in zip((x[:, :half], x[:, half:]), centroids, strict=True)]


def cells_of(vectors: DataFrame, centroids) -> DataFrame:
    """(cell, id, v)."""

    def run(batches):
        for batch in batches:
            a, b = half_distances(units(matrix(batch.column(1))), centroids)
            cell = a.argmin(1) * b.shape[1] + b.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", "id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "cell long, id long, v array<double>")


def visit(near: np.ndarray, far: np.ndarray, sizes: np.ndarray, reach: int) -> list[int]:
    """Cells by summed distance until they hold `reach` vectors (the multi-sequence traversal).

    `near`, `far`: distances to the centroids of the halves; `sizes`: vectors per cell.
    """
    p, q = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    heap, out, held = [(near[p[0]] + far[q[0]], 0, 0)], [], 0
    done = np.zeros((len(p) + 1, len(q) + 1), bool)
    while heap and held < reach:
        _, i, j = heapq.heappop(heap)
        done[i, j] = True
        cell = int(p[i]) * len(q) + int(q[j])
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        # a pair comes up once both pairs before it have been taken
        if i + 1 < len(p) and (j == 0 or done[i + 1, j - 1]):
            heapq.heappush(heap, (near[p[i + 1]] + far[q[j]], i + 1, j))
        if j + 1 < len(q) and (i == 0 or done[i - 1, j + 1]):
            heapq.heappush(heap, (near[p[i]] + far[q[j + 1]], i, j + 1))
    return out


def visits(queries: DataFrame, centroids, sizes: np.ndarray, reach: int) -> DataFrame:
    """(cell, id, v): a row per query and cell it visits."""

    def run(batches):
        for batch in batches:
            ids, at = batch.column(0), matrix(batch.column(1))
            for lo in range(0, len(at), 256):
                a, b = half_distances(units(at[lo:lo + 256]), centroids)
                found = [visit(x, y, sizes, reach) for x, y in zip(a, b, strict=True)]
                row = np.repeat(np.arange(lo, lo + len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for f in found for c in f], pa.int64()), ids.take(pa.array(row)), batch.column(1).take(pa.array(row))],
                    ["cell", "id", "v"])

    return queries.select("id", "v").mapInArrow(run, "cell long, id long, v array<double>")


# --- search ----------------------------------------------------------------------------------

def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all scores that may be among the row's first `k` ids: none below the k-th id's best by more than CLOSE.

    An id may have many places, equal scores may be many; however many, all of them are looked at.
    """
    rows, places = [], []
    for r in range(len(scores)):
        line, take = scores[r], 4 * k
        while True:
            edge = np.partition(line, len(line) - take)[len(line) - take] if take < len(line) else -np.inf
            some = np.flatnonzero((line >= edge) & np.isfinite(line))
            some = some[np.argsort(-line[some], kind="stable")]
            first = np.sort(np.unique(ids[some], return_index=True)[1])
            if len(first) >= k:
                least = line[some[first[k - 1]]] - CLOSE
                if least > edge or take >= len(line):
                    some = some[line[some] >= least]
                    break
            elif take >= len(line):
                break
            take *= 4
        rows.append(np.full(len(some), r))
        places.append(some)
    return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, int), np.zeros(0, int))


def blocks_of(rows: DataFrame, size: int, name: str) -> DataFrame:
    """`rows` (cell, id, v) with the number of a block of about `size` rows of its cell, and how many there are."""
    n = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))
    return rows.join(F.broadcast(n), "cell").withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"{name}s")).cast("int"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP, share: float = SHARE, centroids: int = CENTROIDS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the `k` nearest found, by cosine.

    `vectors` and `queries` have vec_id and embedding. Null, zero and non-finite vectors, null ids and
    vectors of another length than most take no part. A query's own id is no candidate. Equal scores go
    by id; of rows with the same id the best counts, and equal rows count once. Without candidates a query has no rows;
    an empty table gives none.
    """
    spark = vectors.sparkSession
    good, asked = usable(vectors), usable(queries)
    w = width_of(good)
    good, asked = (x.where(F.size("v") == w) for x in (good, asked))
    schema = "query_id long, vec_id long, score double"
    if not w:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = fit(good, centroids=centroids)
    held = materialize(cells_of(good.select("id", "v").dropDuplicates(), fitted), "index-cells")
    counts = held.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    sizes = np.zeros(len(fitted[0]) * len(fitted[1]), np.int64)
    sizes[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    reach = int(np.ceil(share * sizes.sum()))
    going = materialize(visits(asked, fitted, sizes, reach), "index-visits")

    # every block of a cell's vectors meets every block of its queries
    stock, calls = blocks_of(held, VECTORS, "p"), blocks_of(going, QUERIES, "q")
    stock = stock.join(F.broadcast(calls.select("cell", "qs").distinct()), "cell").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    calls = calls.join(F.broadcast(stock.select("cell", "ps").distinct()), "cell").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        ids, asks = some["id"].to_numpy(), others["id"].to_numpy()
        v, a = units(matrix(some["v"].combine_chunks())), units(matrix(others["v"].combine_chunks()))
        rows: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(a), 128):
            scores = a[lo:lo + 128] @ v.T
            own = asks[lo:lo + 128]
            scores[own[:, None] == ids[None, :]] = -np.inf
            r, c = best(scores, ids, k)
            exact = (a[lo:lo + 128][r] * v[c]).sum(1)
            # of an id's places the best one; what ties beyond the k-th id stays for the ranks to settle
            order = np.lexsort((-exact, ids[c], r))
            r, c, exact = r[order], c[order], exact[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (ids[c[1:]] != ids[c[:-1]])
            for out, x in zip(rows, (own[r[new]], ids[c[new]], exact[new]), strict=True):
                out.append(x)
        return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score"), rows, strict=True)})

    parts = shuffle_partitions(spark)
    keys = ["cell", "p", "q"]
    met = stock.select(*keys, "id", "v").repartition(parts, *keys).groupBy(*keys).cogroup(
        calls.select(*keys, "id", "v").repartition(parts, *keys).groupBy(*keys)).applyInArrow(meet, schema)
    one = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op3_multi_index")
def op3_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = take_columns(table(spark, sf, "embeddings"), vec_id="long", embedding="array<double>")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
