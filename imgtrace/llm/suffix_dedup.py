"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of `LENGTH` bytes that also starts earlier, so of all
suffixes only the first `LENGTH` bytes count. A full suffix array would be many times the
corpus. It is never made: suffixes are dealt into buckets that can be sorted one at a time.

* Bucket of a suffix: the hash of the smallest `GRAM`-byte gram among those in its first
  `LENGTH` bytes. Equal strings share it, at the same place. About 3 bytes in a hundred
  are such grams ("anchors"), each for a run of neighbouring suffixes.
* An anchor that occurs once proves that no suffix of its bucket repeats. Only buckets of
  anchors that occur again are built, from the stretch of text around each occurrence.
* A bucket is sorted by its suffixes' first `COVER` bytes. What then still ties, the long
  repeats, is told apart by ranks of a difference-cover sample of the block: any two
  suffixes have a shift below `COVER` at which both stand on sample places, whose
  ranks, made once per block, stand for the next 2 * `COVER` bytes.
* Buckets of very frequent anchors never meet in one task: their stretches are compared
  whole by digest. Tasks add up, for each digest, its earliest place; a stretch that is a copy is
  cut in its document's own task, so that nothing is written per copy and no text of it travels. Of each distinct
  stretch only the first is compared further, in pieces of up to `PIECE` neighbouring suffixes. All that
  stand at the same places before the anchor share 101 - `PIECE` bytes, whose hash is the bucket of the piece. Where such
  a bucket is very frequent again, its suffixes go on one by one to buckets of their own.

Exact copies of whole documents are settled by digest before all this.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query
from .tables import checked_broadcast, materialize, table, take_columns
from .words import blocks, each_text, mix, signed

LENGTH, GRAM = 100, 40
COVER, PLACES = 31, (0, 1, 3, 8, 12, 18)
#: Occurrences from which an anchor's bucket is taken apart, and bytes a block of buckets has, about.
FREQUENT, BLOCK = 2048, 1 << 20
#: Suffixes of a piece of a stretch of a frequent anchor, at most.
PIECE = 16
FIRST = -(1 << 63)

_rng = np.random.Generator(np.random.PCG64(4242))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


# --- anchors ---------------------------------------------------------------------------------

def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n + n // 4 + 1024, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = made[0], made[1]
    return _powers


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from each place on."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)))
    return mix((sums[width:] - sums[:-width]) * down[:len(data) - width + 1])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of `width` neighbouring values, by doubling."""
    reach, low = 1, values
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[:len(values) - width + 1], low[width - reach:]) if reach < width else low


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(text, hash, place of the gram, first suffix, past last suffix): one row per anchor of a block of texts."""
    h = rolling(data, GRAM)
    if len(data) < LENGTH:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z, z
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (smallest(ranked, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(at))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(at)]
    inside = starts + LENGTH <= offsets[1:][text]
    starts, at, text = starts[inside], at[inside], text[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(at)])) - 1 if len(head) else head
    return text[head], h[at[head]], at[head], starts[head], starts[tail] + 1


def scanned(docs: DataFrame) -> DataFrame:
    """(key, d, n_bytes, sha, doc_id, anchors, times) per row; key: doc_id with null first; d: digest of the text.

    `anchors` are distinct, `times` says how often each occurs: a periodic text has few.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                text, h, _, _, _ = anchors(data, offsets)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                times = np.diff(np.concatenate((head, [len(h)])))
                ends = pa.array(np.searchsorted(text[head], np.arange(hi - lo + 1)), pa.int32())
                sha = [hashlib.sha256(data[offsets[i]:offsets[i + 1]]).digest() for i in range(hi - lo)]
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.fill_null(FIRST), pa.array([int.from_bytes(s[:8], "little", signed=True) for s in sha]),
                     pa.array(np.diff(offsets)), pa.array([s.hex() for s in sha]), ids,
                     pa.ListArray.from_arrays(ends, pa.array(signed(h[head]))),
                     pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))],
                    ["key", "d", "n_bytes", "sha", "doc_id", "anchors", "times"])

    return take_columns(docs, doc_id="long", text="string").mapInArrow(
        run, "key long, d long, n_bytes long, sha string, doc_id long, anchors array<long>, times array<int>")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(key, d, h, frequent) of the anchors (h, times, key, d) that occur at least twice.

    Rows stream past in order of h; less than FREQUENT of them wait for their run to end.
    """

    def out(part: pa.RecordBatch, frequent: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("key", "d", "h")), pa.array(np.full(part.num_rows, frequent))], ["key", "d", "h", "frequent"])

    def run(batches):
        wait: list[pa.RecordBatch] = []  # rows of the run that isn't over
        held, last = 0, None

        def close():
            nonlocal wait, held
            if held > 1:
                yield from (out(w, held >= FREQUENT) for w in wait)
            wait, held = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            h, times = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            heads = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)])).tolist()
            sizes = np.add.reduceat(times.astype(np.int64), heads[:-1])
            if h[0] != last:
                yield from close()
            last = h[-1]
            if len(heads) > 2:  # the first run ends here
                wait.append(batch.slice(0, heads[1]))
                held += int(sizes[0])
                yield from close()
                size = np.repeat(sizes[1:-1], np.diff(heads[1:-1]))
                part = batch.slice(heads[1], heads[-2] - heads[1])
                for frequent in (False, True):
                    yield out(part.filter(pa.array((size > 1) & ((size >= FREQUENT) == frequent))), frequent)
            wait.append(batch.slice(heads[-2]))
            held += int(sizes[-1])
            if held >= FREQUENT:
                yield from (out(w, True) for w in wait)
                wait = []
        yield from close()

    return rows.repartition("h").sortWithinPartitions("h").select("h", "times", "key", "d").mapInArrow(
        run, "key long, d long, h long, frequent boolean")


# --- buckets ---------------------------------------------------------------------------------

STRETCH = "k long, key long, d long, start long, suffixes int, stretch binary"
#: Digests that a task adds up before it passes them on, and most of them that are sent to all tasks.
HELD, SENT = 200_000, 1_000_000


def chosen_stretches(texts: pa.Array, wanted: list):
    """(row, anchor, start, suffixes, stretch, place of the anchor in it) of the anchors in each row's list of wanted ones."""
    for lo, hi, data, offsets in blocks(texts):
        text, h, at, first, past = anchors(data, offsets)
        h = signed(h)
        bounds = np.searchsorted(text, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            if wanted[lo + i]:
                some = np.flatnonzero(np.isin(h[bounds[i]:bounds[i + 1]], wanted[lo + i])) + bounds[i]
                for k, place, start, end in zip(*(c[some].tolist() for c in (h, at, first, past)), strict=True):
                    yield lo + i, k, start - int(offsets[i]), end - start, data[start:end + LENGTH - 1].tobytes(), place - start


def stretches(held: DataFrame) -> DataFrame:
    """The text around each occurrence of a rare repeated anchor of (key, d, text, rare); k: its bucket."""

    def run(batches):
        for batch in batches:
            keys, ds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols: tuple[list, ...] = ([], [], [], [], [], [])

            def full():
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.int32(), pa.binary()), strict=True)],
                    ["k", "key", "d", "start", "suffixes", "stretch"])

            for row, k, start, n, piece, _ in chosen_stretches(batch.column(2), batch.column(3).to_pylist()):
                for c, v in zip(cols, (k, keys[row], ds[row], start, n, piece), strict=True):
                    c.append(v)
                if len(cols[0]) >= 20_000:
                    yield full()
                    cols = ([], [], [], [], [], [])
            yield full()

    return held.select("key", "d", "text", "rare").mapInArrow(run, STRETCH)


def stretch_digest(anchor: int, piece: bytes) -> tuple[int, int]:
    raw = hashlib.blake2b(piece + anchor.to_bytes(8, "little", signed=True), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def frequent_digests(held: DataFrame) -> DataFrame:
    """(g, g2, key, start): the earliest place of each distinct stretch of frequent anchors that occurs in several places."""

    def run(batches):
        seen: dict[tuple[int, int], list] = {}

        def out():
            rows = [(*g, *v) for g, v in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["g", "g2", "key", "start", "times"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, k, start, _, piece, _ in chosen_stretches(batch.column(1), batch.column(2).to_pylist()):
                v = seen.setdefault(stretch_digest(k, piece), [keys[row], start, 0])
                if (keys[row], start) < (v[0], v[1]):
                    v[:2] = keys[row], start
                v[2] += 1
            if len(seen) > HELD:
                yield out()
        yield out()

    part = held.where("size(frequent) > 0").select("key", "text", "frequent").mapInArrow(run, "g long, g2 long, key long, start long, times long")
    first = part.groupBy("g", "g2").agg(F.min(F.struct("key", "start")).alias("f"), F.sum("times").alias("times"))
    return first.where("times > 1").select("g", "g2", "f.key", "f.start")


class Copies:
    """Which stretches are copies of an earlier one: by digests sent to the tasks, or, if they are too many, by lists per document."""

    def __init__(self, held: DataFrame, firsts: DataFrame):
        self.sent = None
        few = firsts.limit(SENT + 1).count() <= SENT
        if few:
            t = firsts.toArrow()
            order = np.lexsort((t["g2"].to_numpy(), t["g"].to_numpy()))
            self.sent = held.sparkSession.sparkContext.broadcast([t[c].to_numpy()[order] for c in ("g", "g2", "key", "start")])
            self.held = held.withColumn("copies", F.lit(None).cast("array<long>"))
        else:
            self.held = held.join(self.lists(held, firsts), ["key", "d"], "left")

    @staticmethod
    def lists(held: DataFrame, firsts: DataFrame) -> DataFrame:
        """(key, d, copies: starts of the stretches that are copies)."""

        def run(batches):
            for batch in batches:
                keys, ds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(*stretch_digest(k, piece), keys[row], ds[row], start)
                        for row, k, start, _, piece, _ in chosen_stretches(batch.column(2), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["g", "g2", "key", "d", "start"])

        places = held.where("size(frequent) > 0").select("key", "d", "text", "frequent").mapInArrow(
            run, "g long, g2 long, key long, d long, start long")
        known = firsts.select("g", "g2", F.struct("key", "start").alias("first"))
        return places.join(known, ["g", "g2"]).where(F.col("first") < F.struct("key", "start")).groupBy("key", "d").agg(
            F.collect_set("start").alias("copies"))

    @staticmethod
    def is_copy(sent, copies: set | None, key: int, k: int, start: int, piece: bytes) -> bool:
        if sent is None:
            return copies is not None and start in copies
        g, g2 = stretch_digest(k, piece)
        at, end = np.searchsorted(sent[0], [g, g + 1] if g < (1 << 63) - 1 else [g, g]).tolist()
        for i in range(at, max(end, min(at + 1, len(sent[0])))):
            if sent[0][i] == g and sent[1][i] == g2:
                return (int(sent[2][i]), int(sent[3][i])) < (key, start)
        return False

    def pieces(self) -> DataFrame:
        """The stretches that are no copies, in pieces; k: hash of the bytes that every suffix at the places of a piece has."""
        sent = self.sent

        def run(batches):
            for batch in batches:
                keys, ds, copies = (batch.column(c).to_pylist() for c in (0, 1, 4))
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                sets: dict[int, set | None] = {}
                for row, k, start, n, stretch, place in chosen_stretches(batch.column(2), batch.column(3).to_pylist()):
                    own = sets.setdefault(row, None if copies[row] is None else set(copies[row]))
                    if Copies.is_copy(sent.value if sent else None, own, keys[row], k, start, stretch):
                        continue
                    for lo, hi, bucket in cut_stretch(stretch, n, place):
                        for c, v in zip(cols, (bucket, keys[row], ds[row], start + lo, hi - lo, stretch[lo:hi + LENGTH - 1]), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.int32(), pa.binary()), strict=True)],
                    ["k", "key", "d", "start", "suffixes", "stretch"])

        return self.held.where("size(frequent) > 0").select("key", "d", "text", "frequent", "copies").mapInArrow(run, STRETCH)


def cut_stretch(stretch: bytes, suffixes: int, place: int) -> list[tuple[int, int, int]]:
    """(first suffix, past last suffix, bucket) of each piece of a stretch whose anchor stands at `place`.

    Pieces are counted from the anchor on back, so equal suffixes are in pieces of the same number, and have its bytes.
    """
    out = []
    h = rolling(np.frombuffer(stretch, np.uint8), LENGTH + 1 - PIECE)
    for number in range((place - suffixes + 1) // PIECE, place // PIECE + 1):
        last = place - number * PIECE
        bucket = mix(h[last:last + 1] + np.uint64(number + 1))
        out.append((max(0, last - PIECE + 1), min(suffixes, last + 1), int(signed(bucket)[0])))
    return out


def suffixes(pieces: DataFrame) -> DataFrame:
    """(key, d, lo, k, k2) of each suffix of some pieces."""

    def run(batches):
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for key, d, start, n, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "d", "start", "suffixes", "stretch")), strict=True):
                data = np.frombuffer(piece, np.uint8)
                made = (np.full(n, key), np.full(n, d), np.arange(start, start + n), signed(rolling(data, LENGTH)),
                        signed(mix(rolling(data[::-1], LENGTH)[::-1])))
                for c, v in zip(cols, made, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols], ["key", "d", "lo", "k", "k2"])

    return pieces.mapInArrow(run, "key long, d long, lo long, k long, k2 long")


def cover_shifts() -> np.ndarray:
    """For residues a, b: the least shift that puts both on cover places."""
    out = np.full((COVER, COVER), -1)
    for s in reversed(range(COVER)):
        on = np.isin((np.arange(COVER) + s) % COVER, PLACES)
        out[np.ix_(on, on)] = s
    return out


SHIFTS = cover_shifts()


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, bytes past the end 0."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(data)].astype(np.uint64)
    return out


def ranked(columns: list[np.ndarray]) -> np.ndarray:
    """Rank of each row among the distinct rows, in lexicographic order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeats(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which suffixes have an equal first LENGTH bytes as an earlier one of their bucket.

    `starts` are in order of (bucket, occurrence); every suffix has LENGTH bytes in `data`.
    """
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    word = big_endian_words(data)
    head = (0, 8, 16, COVER - 8)
    # buckets sorted by their first COVER bytes, eight at a time, only where they still tie
    tie = bucket.astype(np.int64)
    live = np.arange(len(starts))
    for shift in head:
        tie = ranked([tie, word[starts[live] + shift]])
        many = np.bincount(tie)[tie] > 1
        live, tie = live[many], tie[many]
        if not len(live):
            return out
    # ranks of the cover sample of this block: COVER bytes, then twice as many
    places = np.flatnonzero(np.isin(np.arange(len(data) - COVER) % COVER, PLACES))
    rank = np.full(len(data) + COVER, -1, np.int64)
    rank[places] = ranked([word[places + s] for s in head])
    twice = np.full(len(data), -1, np.int64)
    full = places[rank[places + COVER] >= 0]
    twice[full] = ranked([rank[full], rank[full + COVER]])
    tail = (2 * COVER, 2 * COVER + 8, 2 * COVER + 16, 2 * COVER + 24, LENGTH - 8)
    # ties: each suffix against the first of its tie; what differs ties on among itself
    order = np.lexsort((live, tie))
    live, tie = live[order], tie[order]
    while len(live):
        new = np.ones(len(tie), bool)
        new[1:] = tie[1:] != tie[:-1]
        pivot = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        i, j = starts[live], starts[pivot]
        s = SHIFTS[i % COVER, j % COVER]
        equal = twice[i + s] == twice[j + s]
        for t in tail:
            equal &= word[i + t] == word[j + t]
        out[live[equal & ~new]] = True
        live, tie = live[~equal], tie[~equal]
    return out


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """(key, d, lo, hi): repeated bytes lo..hi-1 of a document.

    Rows come in order of (bucket, document, start), so the first of equal strings is the earliest. A
    bucket has less than FREQUENT rows; several make a block.
    """

    def run(batches):
        made: tuple[list, ...] = ([], [], [], [])
        groups: list[list[tuple]] = []  # distinct stretches of each waiting bucket
        size = 0

        def say(*row) -> None:
            for c, v in zip(made, row, strict=True):
                c.append(v)

        def flush():
            nonlocal groups, size, made
            kept = [r for g in groups if len(g) > 1 for r in g]
            number = [i for i, g in enumerate(groups) if len(g) > 1 for _ in g]
            if kept:
                at = each_text(np.array([len(r[5]) for r in kept]))
                per = np.array([r[4] for r in kept])
                begin = each_text(per)
                starts = np.arange(begin[-1]) - np.repeat(begin[:-1], per) + np.repeat(at[:-1], per)
                hit = repeats(np.frombuffer(b"".join(r[5] for r in kept), np.uint8), starts, np.repeat(np.array(number), per))
                for i, r in enumerate(kept):
                    own = np.flatnonzero(hit[begin[i]:begin[i + 1]])
                    if len(own):
                        say(r[1], r[2], r[3] + int(own[0]), r[3] + int(own[-1]) + LENGTH)
            groups, size = [], 0
            done, made = made, ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done], ["key", "d", "lo", "hi"])

        bucket, seen, group, before = None, {}, [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, key, d, start, n, piece = row
                if k != bucket:
                    if len(group) > 1:
                        groups.append(group)
                        size += sum(len(r[5]) for r in group)
                    bucket, seen, group, before = k, {}, [], None
                if (key, start) == before and (piece in seen):
                    continue  # the same row of the table again
                before = (key, start)
                if piece in seen:
                    say(key, d, start, start + n - 1 + LENGTH)
                else:
                    seen[piece] = True
                    group.append(row)
                if size >= BLOCK or len(made[0]) > 50_000:
                    yield flush()
        if len(group) > 1:
            groups.append(group)
        yield flush()

    rows = rows.repartition("k").sortWithinPartitions("k", "key", "start")
    return rows.mapInArrow(run, "key long, d long, lo long, hi long")


def sorted_suffixes(rows: DataFrame) -> DataFrame:
    """(key, d, lo, hi) of the suffixes (key, d, lo, k, k2) that equal an earlier one."""

    def run(batches):
        last, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, k2, key, lo = (batch.column(c).to_numpy() for c in ("k", "k2", "key", "lo"))
            same = np.zeros(len(k), bool)
            same[1:] = (k[1:] == k[:-1]) & (k2[1:] == k2[:-1])
            again = np.zeros(len(k), bool)
            again[1:] = (key[1:] == key[:-1]) & (lo[1:] == lo[:-1])
            if last is not None:
                same[0] = last == (k[0], k2[0])
                again[0] = before == (key[0], lo[0])
            last, before = (k[-1], k2[-1]), (key[-1], lo[-1])
            hit = pa.array(same & ~again)
            part = batch.filter(hit)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("d"), part.column("lo"), pa.array(lo[same & ~again] + LENGTH)], ["key", "d", "lo", "hi"])

    rows = rows.select("key", "d", "lo", "k", "k2").repartition("k").sortWithinPartitions("k", "k2", "key", "lo")
    return rows.mapInArrow(run, "key long, d long, lo long, hi long")


# --- the operator ----------------------------------------------------------------------------

def keyed(docs: DataFrame) -> DataFrame:
    """(key, d, text) of each row, as `scanned` has them."""
    texts = take_columns(docs, doc_id="long", text="string").select(
        F.coalesce("doc_id", F.lit(FIRST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    low = F.concat(*[F.substring(sha, 15 - 2 * i, 2) for i in range(8)])
    return texts.withColumn("d", F.conv(low, 16, -10).cast("long"))


def without(texts: DataFrame, sent) -> DataFrame:
    """(key, d, n_removed, n_spans, kept, kept_sha256) of the rows (key, d, text, frequent, copies, spans: (lo, hi) that may overlap) that lose bytes."""

    def run(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            keys, ds, wanted, copies, spans = (batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5))
            gone = [[(s["lo"], s["hi"]) for s in x or ()] for x in spans]
            sets: dict[int, set | None] = {}
            for row, k, start, n, piece, _ in chosen_stretches(batch.column(2), wanted):
                own = sets.setdefault(row, None if copies[row] is None else set(copies[row]))
                if Copies.is_copy(sent.value if sent else None, own, keys[row], k, start, piece):
                    gone[row].append((start, start + n - 1 + LENGTH))
            for row, text in enumerate(batch.column(2)):
                if not gone[row]:
                    continue
                data, out, end, runs, removed = text.as_buffer().to_pybytes(), [], 0, 0, 0
                for i, (lo, hi) in enumerate(sorted(gone[row])):
                    if lo > end or i == 0:
                        out.append(data[end:lo])
                        runs, removed, end = runs + 1, removed + hi - lo, hi
                    elif hi > end:
                        removed, end = removed + hi - end, hi
                kept = b"".join([*out, data[end:]])
                for c, v in zip(rows, (keys[row], ds[row], removed, runs, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            types = (*[pa.int64()] * 4, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)],
                                             ["key", "d", "n_removed", "n_spans", "kept", "kept_sha256"])

    return texts.select("key", "d", "text", "frequent", "copies", "spans").mapInArrow(
        run, "key long, d long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and `kept` for every row of `docs` (a stored table).

    `kept` is the remaining bytes where some but not all were removed, else null. A null or empty text has
    no bytes. A null doc_id comes before all others. Rows that share a doc_id are the same document: equal
    places in them are not earlier than each other, so repeated rows get equal results. Texts of any length are taken
    whole; one of under LENGTH bytes loses nothing. An empty table gives no rows.
    """
    scan = materialize(scanned(docs), "suffix-scan")
    first = scan.groupBy("sha").agg(F.min("key").alias("__first"), F.count("*").alias("__n"))
    copied = materialize(first.where("__n > 1").drop("__n"), "suffix-copies")
    scan = scan.join(checked_broadcast(copied, 120), "sha", "left").withColumn(
        "copy", F.coalesce(F.col("key") > F.col("__first"), F.lit(False))).drop("__first")
    each = F.explode(F.arrays_zip("anchors", "times")).alias("z")
    alone = scan.where(~F.col("copy")).select(each, "key", "d").select(
        F.col("z.anchors").alias("h"), F.col("z.times").alias("times"), "key", "d")
    hits = repeated_anchors(alone).groupBy("key", "d").agg(
        F.collect_set(F.when(F.col("frequent"), F.col("h"))).alias("frequent"),
        F.collect_set(F.when(~F.col("frequent"), F.col("h"))).alias("rare"))
    held = materialize(keyed(docs).join(hits, ["key", "d"]), "suffix-texts")
    copies = Copies(held, materialize(frequent_digests(held), "suffix-digests"))
    pieces = materialize(copies.pieces(), "suffix-pieces")
    crowded = materialize(pieces.groupBy("k").count().where(F.col("count") >= FREQUENT).select("k"), "suffix-crowded")
    crowded = checked_broadcast(crowded, 40)
    few = stretches(held).unionByName(pieces.join(crowded, "k", "left_anti"))
    spans = sorted_buckets(few).unionByName(sorted_suffixes(suffixes(pieces.join(crowded, "k", "left_semi"))))
    lists = spans.groupBy("key", "d").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    changed = without(copies.held.join(lists, ["key", "d"], "left"), copies.sent).dropDuplicates(["key", "d"])

    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    either = lambda whole, part, other: F.when(gone, F.lit(whole)).otherwise(F.coalesce(F.col(part), other))
    return scan.drop("anchors", "times").join(changed, ["key", "d"], "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        either(1, "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        either(hashlib.sha256(b"").hexdigest(), "kept_sha256", F.col("sha")).alias("kept_sha256"),
        F.when(~gone, F.col("kept")).alias("kept"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return cut(table(spark, sf, "documents")).drop("kept")
