"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Documents are tokenised where they lie. Only documents longer than a sequence are
cut; what is packed is then a length from 1 to the capacity, so the whole instance
is a histogram of at most `capacity` numbers, however large the corpus. The packing
is planned on that histogram: first sets that provably dominate every alternative are
fixed for good, then best fit, longest first, places what is left. A plan is a short
list of runs ("the next `count` pieces of this length go to consecutive sequences at
this offset"); pieces are numbered within their length on the executors and look up
their run. No text, and no row per document, passes the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query
from .tables import materialize, number_within, table, take_columns

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that a window holds, about.
SEGMENT_ROWS = 4096


# --- tokens ----------------------------------------------------------------------------------

def encoder(name: str = TOKENIZER):
    """texts -> ids of the tokenizer file `name`.json, without special tokens added.

    The rank file of the same vocabulary gives the same ids several times faster. It is used
    for texts of plain Latin characters; any text with the end marker, unusual white space or
    characters whose class the two libraries' Unicode tables might see differently goes
    through the tokenizer file itself.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = re.compile("[\t\n\r -~\xa1-\xac\xae-ȗ‘-„†-•…€]*")

    def encode(text: str) -> list[int]:
        if "<|" not in text and plain.fullmatch(text):
            return fast.encode_ordinary(text)
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of each document: its ids, then `end`, cut from the back into `capacity` ids.

    A null or empty text is the end id alone. The first piece may be shorter than the others.
    """

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                at = 0
                for piece, stop in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    for column, v in zip(rows, (doc, piece, at, stop - at, zlib.crc32(ids[at:stop])), strict=True):
                        column.append(v)
                    at = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return take_columns(docs, doc_id="long", text="string").mapInArrow(run, PIECE)


# --- plan ------------------------------------------------------------------------------------

def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed sets with how often, what is left) of a histogram of lengths.

    The set {j, k} of a longest piece j and the longest piece k that fits beside it dominates
    every other set with j if any set that could stand in k's place is no longer than k: it
    could be moved to where k would have been. That holds if k fills the sequence, if no two
    pieces fit beside j, or if no three do and no two that do are longer than k.
    """
    left = {w: n for w, n in counts.items() if n}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*sets: int, times: int) -> None:
        fixed.append((sets, times))
        for w in sets:
            left[w] -= times
            if not left[w]:
                del left[w]

    for w in sorted(left, reverse=True):  # pairs that fill a sequence
        if w == capacity:
            take(w, times=left[w])
        elif w in left and 2 * w > capacity and capacity - w in left:
            take(w, capacity - w, times=min(left[w], left[capacity - w]))
    half = left.get(capacity // 2, 0) // 2 if capacity % 2 == 0 else 0
    if half:
        take(capacity // 2, capacity // 2, times=half)
    while left:
        j = max(left)
        room = capacity - j
        own = lambda w, j=j: left.get(w, 0) - (w == j)  # noqa: E731  pieces besides one j
        lengths = sorted(w for w in left if own(w) > 0 and w <= room)
        if not lengths:
            take(j, times=left[j])
            continue
        k = lengths[-1]
        smallest = [w for w in lengths[:3] for _ in range(min(3, own(w)))][:3]
        two = len(smallest) > 1 and sum(smallest[:2]) <= room
        if k == room or not two:
            ok = True
        elif len(smallest) > 2 and sum(smallest) <= room:
            ok = False
        else:
            best, lo, hi = 0, 0, len(lengths) - 1
            while lo <= hi:
                total = lengths[lo] + lengths[hi]
                if total > room:
                    hi -= 1
                else:
                    if lo < hi or own(lengths[lo]) > 1:
                        best = max(best, total)
                    lo += 1
            ok = best <= k
        if not ok:
            break
        # no set with k fits, so all pairs of this kind can be fixed at once
        if j == k:
            pairs = left[j] // 2
            fixed.append(((j, j), pairs))
            left[j] -= 2 * pairs
            if not left[j]:
                del left[j]
        else:
            take(j, k, times=min(left[j], left[k]))
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, of a histogram: (lengths in a sequence, how many such sequences)."""
    open_: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, lengths: list[int], times: int) -> None:
        if times:
            if not open_[room]:
                rooms.insert(bisect_right(rooms, room), room)
            open_[room].append((lengths, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_right(rooms, w - 1)
            if at == len(rooms):  # new sequences, each filled while this length fits
                each = capacity // w
                put(capacity - each * w, [w] * each, n // each)
                put(capacity - n % each * w, [w] * (n % each), int(n % each > 0))
                break
            room = rooms[at]
            lengths, times = open_[room].pop()
            if not open_[room]:
                del rooms[at]
            each = room // w
            full = min(times, n // each)
            put(room - each * w, lengths + [w] * each, full)
            n -= full * each
            rest = times - full
            if rest and n:
                part = min(n, each)
                put(room - part * w, lengths + [w] * part, 1)
                n -= part
                rest -= 1
            put(room, lengths, rest)
    return [x for sets in open_.values() for x in sets]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Per length its runs, as rows (first number, first sequence, offset), by number."""
    fixed, left = reduce_by_dominance(counts, capacity)
    runs, used, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for w in lengths:
            runs[w].append((used[w], sequence, offset))
            used[w] += times
            offset += w
        sequence += times
    return {w: np.array(r, np.int64) for w, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (a stored table with doc_id, piece, length, ids_crc32) with sequence_id and offset.

    Equal pieces may stand anywhere; every other tie is broken by id, piece and content.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    salts = max(1, sum(counts.values()) // SEGMENT_ROWS)
    numbered = number_within(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")],
                             F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)), "__number")

    def run(batches):
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["__number"].to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for w in np.unique(length):
                mine, runs = np.flatnonzero(length == w), sent.value[int(w)]
                at = np.searchsorted(runs[:, 0], number[mine], "right") - 1
                sequence[mine] = runs[at, 1] + number[mine] - runs[at, 0]
                offset[mine] = runs[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return numbered.select(*names, "__number").mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The token pieces of every row of `docs` with their places, in as few sequences as found.

    A null or empty text is its end token alone. Texts of any length are tokenized whole; only those of more than
    `capacity` tokens are cut. Repeated rows, and rows that share a doc_id or have none, are documents of their own.
    An empty table gives no rows.
    """
    return pack(materialize(token_pieces(docs, capacity), "pack-pieces"), capacity)


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))
