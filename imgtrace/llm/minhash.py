"""MinHash near-dedup with tensored banding, candidates confirmed on full shingle sets.

A text gets minimum hashes in small collections of two. A table key combines a pair of
collections, so at similarity 0.85 66 tables of four hashes each come from 12 collections,
24 hashes instead of 264. Two sets of that similarity miss each other in all tables only if
at most one collection agrees, which has probability 7e-6; at 0.9 it is 2e-7. For other
similarities `Plan` takes as many collections as keep that below 1e-5 (15 at 0.8: 6e-6).

1. Sketch: each text once; equal sets collapse to one class at once (exact copies
   never meet as pairs).
2. Star round: a table key with several classes links each to one hub, the class
   that meets most others; the links are confirmed on full sets and joined up.
3. Cross rounds: whatever still shares a key without being connected is compared in
   blocks of bounded size by set sizes and by a finer sketch, 2048 hashes of two bits,
   which a pair of the similarity asked for fails with probability 1e-7. A pair is looked at in
   the first table in which it meets. At first each class passes on the few others that
   look nearest; most classes that have a link are connected by these. For the classes
   that still are not, all pairs are passed on. What is passed on is confirmed on full sets.

After that every pair that shares a key is either connected or refuted.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .queries import query
from imgtrace.session import shuffle_partitions

from .tables import checked_broadcast, materialize, table, take_columns
from .words import blocks, each_text, find_words, hash_words, mix, signed

SHINGLE, PERCENT = 3, 85
#: Hashes of a collection, and two-bit hashes of the finer sketch.
EACH, FINE = 2, 2048
#: Probabilities with which a pair as similar as asked for may miss all tables, or have too few equal hashes.
MISSED, TOO_FEW = 1e-5, 2e-6
#: Nearest others of a class that are tried before all pairs.
TRIED = 4
#: Classes of one key that a task compares with as many others at a time.
BLOCK = 1024

_rng = np.random.Generator(np.random.PCG64(77))
_ODD = _rng.integers(1, 1 << 63, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE = _rng.integers(1, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.concatenate((_ODD, _rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
_MORE = np.uint64(0xD6E8FEB86659FD93)


class Plan:
    """Sizes of the sketches for pairs of `percent` similarity or more.

    `collections`: as few as leave at most one equal with probability below MISSED. `least_equal`: of
    all hashes, such a pair agrees in fewer with probability below TOO_FEW (11 of 24 at 0.85, 1e-6).
    `most_differ`: of FINE two-bit hashes; 230 are expected to differ at 0.85, with a deviation of 14.3,
    and 5.5 deviations more may.
    """

    def __init__(self, percent: int):
        same = percent / 100
        both, m = same ** EACH, 2
        while (1 - both) ** m + m * both * (1 - both) ** (m - 1) > MISSED:
            m += 1
        self.percent, self.collections, self.hashes = percent, m, m * EACH
        self.tables = list(combinations(range(m), 2))
        self.least_equal, below = 0, 0.0
        while (below := below + comb(self.hashes, self.least_equal) * same ** self.least_equal
               * (1 - same) ** (self.hashes - self.least_equal)) <= TOO_FEW:
            self.least_equal += 1
        differs = (1 - same) * 0.75
        self.most_differ = int(FINE * differs + 5.5 * (FINE * differs * (1 - differs)) ** 0.5)


# --- shingle sets ----------------------------------------------------------------------------

def shingle_sets(texts: pa.Array, width: int = SHINGLE):
    """(first row, past last row, shingles, offsets): the distinct shingles of each text, sorted.

    Fewer words than `width` are one shingle; no words, none.
    """
    for lo, hi, data, offsets in blocks(texts):
        starts, lengths, per = find_words(data, offsets)
        h = hash_words(data, starts, lengths)
        at = each_text(per)
        made = []
        if len(h) >= width:
            full = h[: len(h) - width + 1] * _PLACE[0]
            for i in range(1, width):
                full = full + h[i: len(h) - width + 1 + i] * _PLACE[i]
            full = mix(full)
        sizes = np.zeros(hi - lo, np.int64)
        for i in range(hi - lo):
            n = at[i + 1] - at[i]
            if n >= width:
                x = full[at[i]: at[i + 1] - width + 1]
                x.sort()
            elif n:
                x = mix((h[at[i]:at[i + 1]] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                continue
            sizes[i] = len(x)
            made.append(x)
        x = np.concatenate(made) if made else np.zeros(0, np.uint64)
        ends = each_text(sizes)
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        new[ends[:-1][ends[:-1] < len(x)]] = True
        yield lo, hi, x[new], np.concatenate(([0], np.cumsum(new)))[ends]


def digests(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Two numbers for each of the sets that begin at `heads`."""
    return np.stack((np.add.reduceat(mix(x), heads), np.add.reduceat(mix(x + _MORE), heads)))


def sketches(docs: DataFrame, hashes: int, width: int = SHINGLE) -> DataFrame:
    """(doc_id, tag, n_shingles, d1, d2: digest of the set, sketch: minimum hashes) of rows (doc_id, tag, text)."""

    def run(batches):
        for batch in batches:
            for lo, hi, x, at in shingle_sets(batch.column(2), width):
                n = np.diff(at)
                full = np.flatnonzero(n)
                heads = at[:-1][full]
                mins = np.zeros((hi - lo, hashes), "<u4")
                d = np.zeros((2, hi - lo), np.uint64)
                if len(full):
                    for k in range(hashes):
                        y = x * _ODD[k]
                        y ^= y >> np.uint64(32)
                        y *= _MORE
                        mins[full, k] = np.minimum.reduceat(y, heads) >> np.uint64(32)
                    d[:, full] = digests(x, heads)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), pa.array(n), pa.array(signed(d[0])), pa.array(signed(d[1])),
                     pa.array([r.tobytes() for r in mins], pa.binary())], ["doc_id", "tag", "n_shingles", "d1", "d2", "sketch"])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, n_shingles long, d1 long, d2 long, sketch binary")


def unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def collections(mins: np.ndarray) -> np.ndarray:
    m = mins.astype(np.uint64).reshape(len(mins), mins.shape[1] // EACH, EACH)
    out = np.zeros(m.shape[:2], np.uint64)
    for i in range(EACH):
        out = mix(out * _MORE + m[:, :, i] + np.uint64(i + 1))
    return out


def table_keys(classes: DataFrame, plan: Plan) -> DataFrame:
    """(key, t, id): one row per class and table."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo in range(0, len(ids), 2048):
                c = collections(unpack(batch.column(1).slice(lo, 2048)))
                keys = np.stack([mix(c[:, i] * _PLACE[0] + c[:, j] * _PLACE[1] + np.uint64(t)) for t, (i, j) in enumerate(plan.tables)])
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys.reshape(-1))), pa.array(np.repeat(np.arange(len(plan.tables), dtype=np.int32), n)),
                     pa.array(np.tile(ids[lo:lo + n], len(plan.tables)))], ["key", "t", "id"])

    return classes.select("id", "sketch").mapInArrow(run, "key long, t int, id long")


# --- components ------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(id, component: smallest id reachable) for the ids of undirected edges (a, b).

    Alternates large-star and small-star steps until nothing changes: every step is a
    grouped minimum and a join, and the number of rounds grows with the logarithm of the
    number of ids. Each round is a written table.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        linked = both.join(low, "u")
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else (
            linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        return out.where("a != b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = materialize(edges.select("a", "b").where("a != b").distinct(), "links")
    was = None
    while (now := state(e)) != was:
        was = now
        e = materialize(star(star(e, True), False), "links")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


# --- confirmation ----------------------------------------------------------------------------

def stored_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, shingles: sorted 64-bit numbers) of classes (id, rep: a doc_id that has the set, d1, d2, n_shingles)."""

    def run(batches):
        for batch in batches:
            for lo, hi, x, at in shingle_sets(batch.column(0), width):
                n = np.diff(at)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                d1, d2 = digests(x, at[:-1][full])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(d1)), pa.array(signed(d2)), pa.array(n[full]),
                     pa.array([x[at[i]:at[i + 1]].tobytes() for i in full.tolist()], pa.binary())], ["d1", "d2", "n_shingles", "shingles"])

    reps = checked_broadcast(materialize(classes.select("rep").distinct(), "reps"), 16)
    wanted = docs.select("text", "doc_id").join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = wanted.mapInArrow(run, "d1 long, d2 long, n_shingles long, shingles binary")
    by = ["d1", "d2", "n_shingles"]
    return sets.join(checked_broadcast(classes.select(*by, "id"), 40), by).dropDuplicates(["id"]).select("id", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if percent * max(len(p), len(q)) > 100 * min(len(p), len(q)):
                    continue
                z = np.concatenate((p, q))
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
                ok[i] = 100 * both >= percent * (len(z) - both)
            yield batch.select([0, 1]).filter(pa.array(ok))

    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _may_link(n, mins, i, j, plan) -> np.ndarray:
    sizes = plan.percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])
    out = np.flatnonzero(sizes)
    return out[(mins[i[out]] == mins[j[out]]).sum(1) >= plan.least_equal]


def _first_table(eq: np.ndarray) -> np.ndarray:
    """The first table in which pairs with these equal collections meet; at least two are equal."""
    one = eq.argmax(1)
    rest = eq.copy()
    rest[np.arange(len(eq)), one] = False
    two = rest.argmax(1)
    return one * eq.shape[1] - one * (one + 1) // 2 + two - one - 1


def fine_sketches(sets: DataFrame) -> DataFrame:
    """(id, fine): two bits of each of FINE minimum hashes of the sets (id, shingles)."""

    def run(batches):
        for batch in batches:
            made = []
            for raw in batch.column(1):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                low = np.empty(FINE, np.uint64)
                for lo in range(0, FINE, 64):
                    y = x[None, :] * _FINE[lo:lo + 64, None]
                    y ^= y >> np.uint64(32)
                    y *= _MORE
                    low[lo:lo + 64] = y.min(1)
                two = ((low ^ (low >> np.uint64(17))) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
                made.append((two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "fine"])

    return sets.select("id", "shingles").mapInArrow(run, "id long, fine binary")


def pairs_of(rows: pa.Table, plan: Plan, nearest: bool):
    """The pairs (a, b, by how much their sketches differ) of one group of `cross_pairs`, in batches."""
    own, t, ids = rows["__own"].to_numpy(), rows["t"][0].as_py(), rows["id"].to_numpy()
    comp, n = rows["component"].to_numpy(), rows["n_shingles"].to_numpy()
    c = collections(unpack(rows["sketch"].combine_chunks()))
    fine = np.frombuffer(b"".join(rows["fine"].to_pylist()), np.uint64).reshape(len(ids), -1)
    p, q = rows["p"][0].as_py(), rows["q"][0].as_py()
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    # pairs within the largest component need no look: one side is always outside it
    names, sizes = np.unique(comp, return_counts=True)
    main = comp == names[sizes.argmax()]
    sides = [(left[~main[left]], right, p == q)] + ([(right[~main[right]], left[main[left]], False)] if p != q else [])
    for some, others, within in sides:
        for lo in range(0, len(some), 64):
            i, j = np.meshgrid(some[lo:lo + 64], others, indexing="ij")
            i, j = i.ravel(), j.ravel()
            ok = comp[i] != comp[j]
            if within:
                ok &= main[j] | (i < j)
            ok &= plan.percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])
            i, j = i[ok], j[ok]
            eq = c[i] == c[j]
            ok = eq.sum(1) > 1
            ok[ok] = _first_table(eq[ok]) == t
            i, j = i[ok], j[ok]
            x = fine[i] ^ fine[j]
            differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1).astype(np.int64)
            ok = np.flatnonzero(differ <= plan.most_differ)
            if nearest and len(ok):  # the nearest of each i in this group
                ok = ok[np.lexsort((ids[j[ok]], differ[ok], i[ok]))]
                ok = ok[np.concatenate(([True], i[ok][1:] != i[ok][:-1]))]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[ok]]), pa.array(ids[j[ok]]), pa.array(differ[ok])], ["a", "b", "differ"])


def cross_pairs(members: DataFrame, plan: Plan, nearest: bool) -> DataFrame:
    """Pairs (a, b, differ) of different components that share a key and may link, each in one order and once.

    `nearest`: of each class outside its key's largest component only the nearest other in each group.

    `members`: key, t, id, component, n_shingles, sketch, fine, n (rows of the key). A key with more than
    BLOCK rows is cut into blocks, and each two blocks meet in a group of their own.
    """
    cut = members.withColumn("__cuts", F.ceil(F.col("n") / BLOCK).cast("int"))
    cut = cut.withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__cuts")).cast("int"))
    cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1)))
    cut = cut.select("key", F.least("__own", "__other").alias("p"), F.greatest("__own", "__other").alias("q"), "__own",
                     "t", "id", "component", "n_shingles", "sketch", "fine")

    def run(batches):
        """Groups are runs of rows in key order, of at most two blocks; the last run of a batch waits for the next."""
        rest: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                rest.append(batch)
            if not rest:
                continue
            rows = pa.Table.from_batches(rest)
            key = np.stack([rows[x].to_numpy() for x in ("key", "p", "q")])
            heads = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [rows.num_rows])).tolist()
            if batch is not None:
                rest = rows.slice(heads[-2]).combine_chunks().to_batches()
                heads.pop()
            for lo, hi in zip(heads[:-1], heads[1:], strict=True):
                if hi - lo > 1:
                    yield from pairs_of(rows.slice(lo, hi - lo), plan, nearest)

    by = ["key", "p", "q"]
    parts = shuffle_partitions(members.sparkSession)  # little data, much work: not to be merged into few tasks
    return cut.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long, differ long")


def _with_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


# --- the operator ----------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (a stored table).

    A null, empty or blank text has no shingles and is linked with nothing. Rows that share a doc_id are one document:
    each one's text has links of its own, and these count together. Rows without a doc_id are documents of their
    own; a component's id is the smallest doc_id in it, and null if it has none, in which case one of its rows is kept.
    Exact copies are linked if they have a word. Texts of any length enter whole. An empty table gives no rows.
    """
    texts = take_columns(docs, doc_id="long", text="string").withColumn("tag", F.lit(None).cast("long"))
    return grouped(texts, width, percent).drop("tag")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """`near_duplicates` of rows (doc_id, tag, text), with `tag`."""
    plan = Plan(percent)
    sk = materialize(sketches(docs, plan.hashes, width).withColumn("id", F.monotonically_increasing_id()), "sketches")
    full = sk.where("n_shingles > 0")
    groups = full.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(
        full.select("id", F.col("doc_id").alias("rep"), "d1", "d2", "n_shingles", "sketch").join(
            groups.select(F.col("rep").alias("id")), "id", "left_semi"), "classes")
    copies = full.join(groups.where("n > 1").select("d1", "d2", "n_shingles", "rep"), ["d1", "d2", "n_shingles"]).select(
        F.col("id").alias("a"), F.col("rep").alias("b")).where("a != b")

    keys = table_keys(classes, plan)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keys.join(shared, "key"), "members")
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("h")).select("key", F.col("h.id").alias("hub"))
    star = members.join(hubs, "key").where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    star = materialize(sieved(star, classes, plan), "star-pairs")
    met = materialize(classes.drop("sketch").join(members.select("id").distinct(), "id", "left_semi"), "met")
    sets = materialize(stored_sets(docs, met, width), "sets")
    links = materialize(confirmed(star, sets, percent), "star-links")
    label = materialize(components(links), "star-components")

    def still_open(rows: DataFrame, label: DataFrame) -> DataFrame:
        """The rows of keys whose classes are in several components, with `component`."""
        known = rows.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        return materialize(known.join(mixed.select("key"), "key"), "open-members")

    def untested(pairs: DataFrame, *tested: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        for t in tested:
            pairs = pairs.join(t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        return materialize(pairs.distinct(), "cross-pairs")

    def joined_up(label: DataFrame, *links: DataFrame) -> DataFrame:
        out = label.select(F.col("id").alias("a"), F.col("component").alias("b"))
        for x in links:
            out = out.unionByName(x)
        return components(out)

    open_ = still_open(members, label)
    fine = materialize(fine_sketches(sets.join(open_.select("id").distinct(), "id", "left_semi")), "fine-sketches")
    sketched = lambda rows: rows.join(classes.select("id", "n_shingles", "sketch"), "id").join(fine, "id")
    few = Window.partitionBy("a").orderBy("differ", "b")
    near = cross_pairs(sketched(open_), plan, True).withColumn("__r", F.row_number().over(few)).where(F.col("__r") <= TRIED)
    near = untested(near, star)
    label = materialize(joined_up(label, confirmed(near, sets, percent)), "near-components")
    open_ = still_open(open_.drop("component"), label)
    cross = untested(cross_pairs(sketched(open_), plan, False), star, near)
    again = confirmed(cross, sets, percent)
    shared_id = full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    same = full.join(shared_id.select("doc_id", "b"), "doc_id").select(F.col("id").alias("a"), "b").where("a != b")
    final = joined_up(label, again, copies, same)
    rows = materialize(sk.select("doc_id", "tag", "id", "n_shingles").join(final, "id", "left"), "labels")
    least = rows.where("component IS NOT NULL").groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.min("id").alias("first"))
    rows = rows.join(checked_broadcast(materialize(least, "components"), 32), "component", "left")
    alone = F.col("component").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = alone | F.when(F.col("component_id").isNull(), F.col("id") == F.col("first")).otherwise(
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "tag")


def sieved(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            m = np.concatenate((unpack(batch.column(4)), unpack(batch.column(5))))
            i = np.arange(len(na))
            keep = _may_link(np.concatenate((na, nb)), m, i, i + len(na), plan)
            yield batch.select([0, 1]).take(pa.array(keep))

    side = lambda c: classes.select(F.col("id").alias(c), F.col("n_shingles").alias("n" + c), F.col("sketch").alias("s" + c))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps: those of each component's smallest doc_id, or one row if it has no doc_id.

    What holds for nulls, repeated ids, empty and long texts there holds here. An empty table stays empty.
    """
    nameless = materialize(docs.where("doc_id IS NULL").withColumn("__tag", F.monotonically_increasing_id()), "nameless")
    rest = docs.where("doc_id IS NOT NULL")
    texts = take_columns(rest, doc_id="long", text="string").withColumn("tag", F.lit(None).cast("long")).unionByName(
        take_columns(nameless, doc_id="long", text="string", __tag="long").withColumnRenamed("__tag", "tag"))
    gone = materialize(grouped(texts, width, percent).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("tag").alias("__gone_tag")), "gone")
    ids = gone.where("__gone IS NOT NULL").select("__gone").distinct()
    tags = gone.where("__gone IS NULL").select("__gone_tag")
    return rest.join(ids, F.col("doc_id") == F.col("__gone"), "left_anti").unionByName(
        nameless.join(tags, F.col("__tag") == F.col("__gone_tag"), "left_anti").drop("__tag"))


@query("op8_minhash_dedup")
def op8_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))
