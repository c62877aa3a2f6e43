"""Line dedup over a reversible index: exact reference counts behind sharded cuckoo filters.

The index holds three tables:

* `postings` (doc_id, k1, k2): one row per document and distinct long line;
* `counts` (k1, k2, n_docs, last_doc): exact reference counts, one row per line key;
* `filters` (shard, filter): per shard of the key space a cuckoo filter of the
  keys that are held by at least `min_docs` documents.

A filter takes two bytes a key, against twenty-four in the exact table, and a key
can leave it again. It answers "no" for nearly every line, which then never moves;
whatever it answers "maybe" is settled by the exact counts, so results are exact.
`insert` and `delete` change counts by what the batch holds; only keys that cross
the limit touch their shard's filter. `delete(insert(index, docs), docs)` gives
the same answers as `index`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query
from .tables import materialize, table, take_columns
from .words import WHITE

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys a shard is made for, and bytes of all filters up to which they are sent to every task.
SHARD_KEYS, SENT_BYTES = 1 << 18, 64 << 20
SLOTS, KICKS = 4, 500
NO_DOC = -(1 << 63)

POSTING = "doc_id long, k1 long, k2 long"
COUNT = "k1 long, k2 long, n_docs long, last_doc long"


# --- cuckoo filter ---------------------------------------------------------------------------

class Cuckoo:
    """16-bit fingerprints in buckets of four, two buckets a key; keys are (k1, k2) pairs.

    A key that finds no place doubles the table: `add` needs the keys again for
    that, so it returns False and the caller rebuilds from the exact table.
    """

    def __init__(self, buckets: int):
        self.mask = buckets - 1
        self.cells = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85))))))

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        cells = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS)
        out = cls(4)
        out.mask, out.cells = len(cells) - 1, cells.copy()
        return out

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def _print(self, k2):
        return (k2.astype(np.uint64) % np.uint64(65535)).astype(np.int64) + 1

    def _hop(self, prints):
        return (prints * 0x5BD1E995) >> 7

    def places(self, k1, k2):
        """(fingerprint, bucket, other bucket) of keys."""
        p = self._print(k2)
        a = (k1.astype(np.uint64) >> np.uint64(20)).astype(np.int64) & self.mask
        return p, a, a ^ (self._hop(p) & self.mask)

    def has(self, k1, k2):
        p, a, b = self.places(k1, k2)
        p = p.astype(np.uint16)[:, None]
        return (self.cells[a] == p).any(1) | (self.cells[b] == p).any(1)

    def add(self, k1, k2) -> bool:
        turn = 0
        for p, a, b in zip(*(x.tolist() for x in self.places(k1, k2)), strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.cells[at] == 0)
                if len(free):
                    self.cells[at, free[0]] = p
                    break
            else:
                for _ in range(KICKS):
                    turn += 1
                    at, slot = b, turn % SLOTS
                    p, self.cells[at, slot] = int(self.cells[at, slot]), p
                    b = at ^ (self._hop(p) & self.mask)
                    free = np.flatnonzero(self.cells[b] == 0)
                    if len(free):
                        self.cells[b, free[0]] = p
                        break
                else:
                    return False
        return True

    def remove(self, k1, k2) -> None:
        """Of keys that were added; others would take another key's fingerprint away."""
        for p, a, b in zip(*(x.tolist() for x in self.places(k1, k2)), strict=True):
            for at in (a, b):
                there = np.flatnonzero(self.cells[at] == p)
                if len(there):
                    self.cells[at, there[0]] = 0
                    break


def cuckoo_of(k1, k2) -> Cuckoo:
    size = len(k1)
    while True:
        out = Cuckoo.sized(size)
        if out.add(k1, k2):
            return out
        size = max(size * 2, SLOTS)


# --- lines -----------------------------------------------------------------------------------

def line_key(line: bytes) -> bytes | None:
    """16-byte digest of a line's key, None if the key is short."""
    key = line.strip(WHITE)
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def text_bytes(texts: pa.Array):
    for t in texts.cast(pa.large_binary()):
        yield t.as_py() or b""


def postings(docs: DataFrame) -> DataFrame:
    """One row per document and distinct long line of it; a null doc_id counts as the smallest."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                for key in {line_key(x) for x in text.split(b"\n")} - {None}:
                    ids.append(NO_DOC if doc is None else doc)
                    keys.append(key)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], ["doc_id", "k1", "k2"])

    return take_columns(docs, doc_id="long", text="string").mapInArrow(run, POSTING)


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """A filter per shard; a shard holds about SHARD_KEYS keys, whatever the corpus."""

    def one(got: pa.Table) -> pa.Table:
        f = cuckoo_of(got["k1"].to_numpy(), got["k2"].to_numpy())
        return pa.table({"shard": got["shard"][:1], "filter": pa.array([f.dump()], pa.binary())})

    keyed = keys.select(F.pmod("k1", F.lit(shards)).alias("shard"), "k1", "k2")
    return keyed.groupBy("shard").applyInArrow(one, "shard long, filter binary")


@dataclass
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS

    @property
    def hot(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)


def build(docs: DataFrame, min_docs: int = MIN_DOCS) -> LineIndex:
    held = materialize(postings(docs), "line-postings")
    counts = materialize(counted(held), "line-counts")
    hot = counts.where(F.col("n_docs") >= min_docs)
    shards = shards_for(hot.count())
    return LineIndex(held, counts, materialize(build_filters(hot, shards), "line-filters"), shards, min_docs)


def _updated(index: LineIndex, held: DataFrame, counts: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over new postings and counts; filters change by the keys of `touched` that cross the limit."""
    was = index.counts.join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", F.col("n_docs").alias("__was"))
    now = counts.join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", "n_docs")
    crossed = (
        now.join(was, ["k1", "k2"], "full").select(
            "k1", "k2", (F.coalesce("n_docs", F.lit(0)) >= index.min_docs).alias("on"),
            (F.coalesce("__was", F.lit(0)) >= index.min_docs).alias("off"))
        .where(F.col("on") != F.col("off"))
        .select(F.pmod("k1", F.lit(index.shards)).alias("shard"), "k1", "k2", "on")
    )

    def change(old: pa.Table, new: pa.Table) -> pa.Table:
        shard = (new if new.num_rows else old)["shard"][0].as_py()
        raw = old["filter"][0].as_py() if old.num_rows else None
        on = np.array(new["on"].to_pylist(), bool)
        k1, k2 = new["k1"].to_numpy(), new["k2"].to_numpy()
        f = Cuckoo.load(raw) if raw else Cuckoo.sized(len(on) + SLOTS)
        f.remove(k1[~on], k2[~on])
        full = not f.add(k1[on], k2[on])
        return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([None if full else f.dump()], pa.binary())})

    filters = materialize(
        index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(change, "shard long, filter binary"),
        "line-filters")
    out = LineIndex(held, counts, filters, index.shards, index.min_docs)
    hot = out.hot.count()
    if hot > 2 * SHARD_KEYS * out.shards:
        out.shards = shards_for(hot)
        out.filters = materialize(build_filters(out.hot, out.shards), "line-filters")
    elif filters.where("filter is null").limit(1).count():  # full shards are made anew from the exact table
        again = filters.where("filter is null").select("shard")
        keys = out.hot.withColumn("shard", F.pmod("k1", F.lit(out.shards))).join(again, "shard", "left_semi")
        out.filters = materialize(
            filters.where("filter is not null").unionByName(build_filters(keys, out.shards)), "line-filters")
    return out


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Add documents; a document that is there already must be deleted first."""
    new = materialize(postings(docs), "line-postings")
    touched = counted(new)
    counts = materialize(
        index.counts.unionByName(touched).groupBy("k1", "k2")
        .agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")), "line-counts")
    return _updated(index, index.postings.unionByName(new), counts, touched.select("k1", "k2"))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Take documents (by `doc_id`) out again; ids that aren't there change nothing."""
    gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id")).distinct()
    touched = materialize(
        index.postings.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct(), "line-touched")
    held = materialize(index.postings.join(gone, "doc_id", "left_anti"), "line-postings")
    counts = materialize(
        index.counts.join(touched, ["k1", "k2"], "left_anti")
        .unionByName(counted(held.join(touched, ["k1", "k2"], "left_semi"))), "line-counts")
    return _updated(index, held, counts, touched)


# --- dedup -----------------------------------------------------------------------------------

def maybe_hot(index: LineIndex, held: DataFrame) -> DataFrame:
    """Postings that pass their shard's filter; all of them where the filters are too large to send."""
    size = index.filters.select(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
    if size > SENT_BYTES:
        return held
    raw = {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()}
    sent, shards = held.sparkSession.sparkContext.broadcast(raw), index.shards

    def run(batches):
        filters = {s: Cuckoo.load(f) for s, f in sent.value.items()}
        for batch in batches:
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            keep, shard = np.zeros(len(k1), bool), np.mod(k1, shards)
            for s in np.unique(shard):
                if int(s) in filters:
                    mine = shard == s
                    keep[mine] = filters[int(s)].has(k1[mine], k2[mine])
            yield batch.filter(pa.array(keep))

    return held.mapInArrow(run, POSTING)


def dropped_keys(index: LineIndex, held: DataFrame) -> DataFrame:
    """(doc_id, drop: the key digests whose lines this document loses)."""
    hot = index.hot.select("k1", "k2", "last_doc")
    return (
        maybe_hot(index, held).join(hot, ["k1", "k2"]).where("doc_id < last_doc")
        .select("doc_id", F.struct("k1", "k2").alias("k")).distinct()
        .groupBy("doc_id").agg(F.collect_list("k").alias("drop"))
    )


def drop_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """`docs` with `text` without lost lines, and `n_lines`, `n_dropped`.

    Each row is a document. Null and empty texts are one empty line; repeated rows
    each count, and rows that share the largest doc_id of a key all keep it. A null
    doc_id is below all others. A null text stays null. Other columns are carried.
    """
    own = index is None
    index = index or build(docs)
    held = index.postings if own else materialize(postings(docs), "line-postings")
    drops = dropped_keys(index, held).withColumnRenamed("doc_id", "__doc").withColumnRenamed("drop", "__drop")
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)))
    joined = keyed.join(drops, F.col("__id") == F.col("__doc"), "left").drop("__id", "__doc")
    out = "struct<text:string,n_lines:bigint,n_dropped:bigint>"

    @F.arrow_udf(out)
    def cut(text: pa.Array, drop: pa.Array) -> pa.Array:
        texts, lines, lost = [], [], []
        for t, d in zip(text, drop, strict=True):
            t = t.as_py()
            parts = (t or "").split("\n")
            lines.append(len(parts))
            if d.is_valid:
                gone = {np.array([x["k1"], x["k2"]], np.int64).tobytes() for x in d.as_py()}
                kept = [x for x in parts if line_key(x.encode()) not in gone]
                texts.append("\n".join(kept))
                lost.append(len(parts) - len(kept))
            else:
                texts.append(t)
                lost.append(0)
        return pa.StructArray.from_arrays(
            [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(lost, pa.int64())], ["text", "n_lines", "n_dropped"])

    made = joined.withColumn("__cut", cut(F.col("text"), F.col("__drop")))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")], "__cut.*")


SQL = r"""
WITH lines AS (
  SELECT d.doc_id, t.i, d.parts[t.i] AS line,
         translate(regexp_replace(d.parts[t.i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(generate_series(1, len(d.parts))) AS i) t),
hot AS (SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40
        GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id < h.last_doc AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = drop_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
