"""Audit of how the sources of a language differ in their terms, with length-bucketed packing of the terms.

Counting is done inside the tasks, on the bytes of the Arrow column:

* terms of at most 8 bytes become one number of 64 bits, of at most 16 bytes two, big-endian and filled up with zeros,
  so that numbers are in the order of the bytes; they are sorted by radix, 16 bits a pass, and equal
  ones are counted as runs. As the sort is stable, a run lists its documents in order and their number comes along;
* longer terms go to buckets by length (17 to 32 bytes, to 64, ...), each sorted by its bytes and counted the same way.

A task adds its short counts up in arrays of at most `HELD` entries before it passes them on, so a frequent
term leaves it once per source. One shuffle by (lang, term) then gives the counts of the sources and, as a
window in the same partitions, those of the language. Sources are compared in pairs of blocks of `SOURCES` and in
slices of the kept terms: a unit of that is bounded, whatever the number of sources, terms or documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .queries import query
from .tables import checked_broadcast, materialize, places, table, take_columns
from .words import blocks, each_text

#: A kept term's least number of documents of its language; terms listed per source; what is added to each count.
LEAST_DOCS, LISTED, ADDED, SCALE = 30, 50, 5, 1_000_000_000
#: Bytes of text a task packs at once, entries it holds, sources of a block, and rows of a slice of terms, about.
TEXT_BYTES, HELD, SOURCES, SLICE = 4 << 20, 1 << 20, 256, 200_000

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Keeps the first n bytes of a big-endian number.
KEEP = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)
COUNTED = "lang string, source string, term string, n long, docs long"


# --- counting in a task ----------------------------------------------------------------------

def find_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the maximal runs of letters; none crosses a text's end."""
    edge = np.zeros(len(data) + 1, bool)
    inside = LETTER[data]
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    # a run over the end of texts is cut there
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[inside[inner] & inside[inner - 1]]
    starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of at most 8 * `words` bytes as that many numbers. `data` goes on for 8 * words bytes after the last start."""
    every = np.ndarray((len(data) - 7,), ">u8", data.data, strides=(1,))
    return [every[starts + 8 * i].astype(np.uint64) & KEEP[np.clip(lengths - 8 * i, 0, 8)] for i in range(words)]


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by these numbers, the first one most significant."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def heads_of(keys: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def run_counts(words: list[np.ndarray], group: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """[*words, group, n, docs]: each term of each group, how often it occurs and in how many texts; rows are in text order."""
    order = radix_order([*words, group])
    words, group, text = [w[order] for w in words], group[order], text[order]
    return _summed(words, group, text)


def _summed(words, group, text):
    new = heads_of([*words, group])
    head = np.flatnonzero(new)
    if not len(head):
        return [*words, group, np.zeros(0, np.int64), np.zeros(0, np.int64)]
    fresh = new.copy()
    fresh[1:] |= text[1:] != text[:-1]
    return [*(w[head] for w in words), group[head], np.diff(np.concatenate((head, [len(new)]))),
            np.add.reduceat(fresh.astype(np.int64), head)]


def long_counts(data: np.ndarray, starts, lengths, group, text):
    """(terms, group, n, docs) of terms over 16 bytes, bucket by bucket."""
    bucket = np.frexp((lengths - 1).astype(np.float64))[1]
    for b in np.unique(bucket).tolist():
        at = np.flatnonzero(bucket == b)
        width = int(lengths[at].max())
        rows = max(1, TEXT_BYTES // width)
        for lo in range(0, len(at), rows):
            some = at[lo:lo + rows]
            place = np.arange(width)
            made = data[np.minimum(starts[some][:, None] + place, len(data) - 1)]
            made[place >= lengths[some][:, None]] = 0
            terms = np.ascontiguousarray(made).view(f"S{width}").ravel()
            order = np.lexsort((group[some], terms)) if width <= 64 else np.array(
                sorted(range(len(some)), key=lambda i: (terms[i], group[some[i]])), np.int64)
            yield _summed([terms[order]], group[some][order], text[some][order])


class Counts:
    """Counts of terms of one or two numbers, added up until there are too many."""

    def __init__(self, words: int):
        self.words, self.parts, self.held = words, [], 0

    def add(self, part: list[np.ndarray]):
        """What has to be passed on now, if anything."""
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > HELD:
            whole = self.whole()
            self.parts, self.held = [whole], len(whole[0])
            if self.held > HELD // 2:
                self.parts, self.held = [], 0
                yield whole

    def whole(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        keys = columns[:self.words + 1]
        order = radix_order(keys)
        keys = [k[order] for k in keys]
        head = np.flatnonzero(heads_of(keys))
        return [*(k[head] for k in keys), *(np.add.reduceat(c[order], head) for c in columns[-2:])]

    def rest(self):
        if self.held:
            yield self.whole()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (lang, source, text), counted within tasks: a term may come from several."""

    def run(batches):
        numbers: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        held = {1: Counts(1), 2: Counts(2)}

        def out(terms: pa.Array, part: list[np.ndarray]) -> pa.RecordBatch:
            used, at = np.unique(part[-3].astype(np.int64), return_inverse=True)
            lang, source = (pa.array([names[i][k] for i in used.tolist()], pa.string()).take(pa.array(at)) for k in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(part[-2]), pa.array(part[-1])],
                                              ["lang", "source", "term", "n", "docs"])

        def short(part: list[np.ndarray]) -> pa.RecordBatch:
            width = 8 * (len(part) - 3)
            raw = np.stack(part[:-3], 1).astype(">u8").tobytes()
            return out(pa.array(np.frombuffer(raw, f"S{width}"), pa.binary()).cast(pa.string()), part)

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source = (batch.column(c).fill_null("") for c in (0, 1))
            pair = pc.dictionary_encode(pc.binary_join_element_wise(pc.cast(pc.utf8_length(lang), pa.string()), pc.binary_join_element_wise(lang, source, ""), ":"))
            first = pc.index_in(pair.dictionary, pair.dictionary.take(pair.indices)).to_numpy(zero_copy_only=False)
            own = np.zeros(len(pair.dictionary), np.uint64)
            for i, row in enumerate(first.tolist()):
                key = (lang[row].as_py(), source[row].as_py())
                own[i] = numbers.setdefault(key, len(numbers))
                if len(names) < len(numbers):
                    names.append(key)
            group_of = own[pair.indices.to_numpy(zero_copy_only=False)]
            for lo, hi, data, offsets in blocks(batch.column(2), TEXT_BYTES):
                data = np.concatenate((LOWER[data], np.zeros(24, np.uint8)))
                starts, lengths, text = find_terms(data[:len(data) - 24], offsets)
                group = group_of[lo:hi][text]
                for words in (1, 2):
                    at = np.flatnonzero((lengths > 8 * (words - 1)) & (lengths <= 8 * words))
                    if len(at):
                        part = run_counts(packed(data, starts[at], lengths[at], words), group[at], text[at])
                        for whole in held[words].add(part):
                            yield short(whole)
                at = np.flatnonzero(lengths > 16)
                if len(at):
                    for part in long_counts(data, starts[at], lengths[at], group[at], text[at]):
                        yield out(pa.array(part[0].tolist(), pa.binary()).cast(pa.string()), part)
        for words in (1, 2):
            for whole in held[words].rest():
                yield short(whole)

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTED)


# --- comparison ------------------------------------------------------------------------------

def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)) in whole numbers of any size; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    number = lambda n: F.lit(n).cast(f"decimal({len(str(n))},0)")
    over = F.nullif(whole(total) + number(ADDED) * whole(terms), F.lit(0))
    exact = F.call_function("div", number(SCALE) * (whole(count) + number(ADDED)), over)
    return exact.cast("long") + 1


def unit_differences(rows: pa.Table) -> pa.Table:
    """(lang, s, t, value) for each two sources of two blocks, over the terms of one slice.

    rows: lang, b1, b2, slice, block, s, term, p, base, v. A row without a term names a source and, as `base`, its p of a
    term that it hasn't got. The first slice adds what the lang's `v` terms would give if no source had any.
    """
    lang, b1, b2, part = (rows[c][0].as_py() for c in ("lang", "b1", "b2", "slice"))
    v = rows["v"][0].as_py()
    s, block, base, p = (rows[c].to_numpy() for c in ("s", "block", "base", "p"))
    term = rows["term"].combine_chunks().dictionary_encode()
    term = term.chunk(0) if isinstance(term, pa.ChunkedArray) else term
    code = term.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    named = code < 0

    def side(b):
        mine = named & (block == b)
        order = np.argsort(s[mine])
        return s[mine][order], base[mine][order]

    (s1, a1), (s2, a2) = side(b1), side(b2)
    empty = np.abs(a1[:, None] - a2[None, :])
    total = empty * v if part == 0 else np.zeros_like(empty)
    has = np.flatnonzero(~named)
    has = has[np.argsort(code[has], kind="stable")]
    chunk = 4096
    for lo in range(0, len(term.dictionary), chunk):
        at = has[np.searchsorted(code[has], lo):np.searchsorted(code[has], lo + chunk)]
        n = min(chunk, len(term.dictionary) - lo)
        m1, m2 = np.repeat(a1[None, :], n, 0), np.repeat(a2[None, :], n, 0)
        for b, sources, m in ((b1, s1, m1), (b2, s2, m2)):
            mine = at[block[at] == b]
            m[code[mine] - lo, np.searchsorted(sources, s[mine])] = p[mine]
        for i in range(len(s1)):
            total[i] += np.abs(m1[:, i, None] - m2).sum(0) - n * empty[i]
    i, j = np.nonzero(s1[:, None] < s2[None, :] if b1 == b2 else np.ones(empty.shape, bool))
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "s": pa.array(s1[i], pa.int64()), "t": pa.array(s2[j], pa.int64()),
                     "value": pa.array(total[i, j], pa.int64())})


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, s, t, value) for each two sources s < t of each lang; counts (lang, s, term, p), groups (lang, s, m, base, v, slices)."""
    blocks_of = F.expr(f"(m + {SOURCES - 1}) div {SOURCES}")
    block = F.expr(f"s div {SOURCES}")
    named = groups.select("lang", "s", "base", "v", "m", "slices", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    kept = counts.join(checked_broadcast(groups, 64), ["lang", "s"]).select(
        "lang", "s", "base", "v", "m", "slices", "term", "p", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"))
    rows = named.unionByName(kept).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks_of - 1)))
    rows = rows.select("lang", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "slice",
                       "block", "s", "term", "p", "base", "v")
    part = rows.groupBy("lang", "b1", "b2", "slice").applyInArrow(unit_differences, "lang string, s long, t long, value long")
    return part.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of each language are apart, and by which terms.

    Part `pair`: every other source of the language by the sum of differences over the kept terms. Part `term`: the
    source's terms above the language's share, up to rank `listed`. A null text, lang or source is an empty one. A row is
    a document, whatever its doc_id; repeated rows count each time. A text of any length is counted whole, by
    bytes. Equal values rank by the UTF-8 bytes of the item. A language with one source has no pairs, one
    without kept terms has pairs of value 0. An empty table gives no rows.
    """
    rows = take_columns(docs, lang="string", source="string", text="string").fillna("")
    counted = count_terms(rows).repartition("lang", "term")  # once; what follows is in these partitions
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")
    counts = counted.withColumns({"docs": F.sum("docs").over(every), "total": F.sum("n").over(every),
                                  "once": F.row_number().over(every.orderBy("source")) == 1})
    counts = materialize(counts.where(F.col("docs") >= least_docs).drop("docs"), "terms-kept")

    per_lang = counts.groupBy("lang").agg(F.count(F.when(F.col("once"), 1)).alias("v"), F.sum("n").alias("lang_n"), F.count("*").alias("rows"))
    per_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("docs")), "terms-groups")
    groups = places(groups, ["lang"], ["source"]).select("lang", "source", F.col("idx").alias("s"), "m")
    groups = groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["v", "lang_n", "group_n", "rows"])
    base = F.coalesce(share(F.lit(0).cast("long"), F.col("group_n"), F.col("v")), F.lit(0))
    groups = materialize(groups.select("lang", "source", "s", "m", "v", "lang_n", "group_n", base.alias("base"), F.greatest(
        F.lit(1), F.expr(f"(rows + {SLICE - 1}) div {SLICE}")).cast("long").alias("slices")), "terms-groups")

    known = counts.join(checked_broadcast(groups, 128), ["lang", "source"])
    p = share(F.col("n"), F.col("group_n"), F.col("v"))
    q = share(F.col("total"), F.col("lang_n"), F.col("v"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= listed)

    pairs = pair_values(known.select("lang", "s", "term", p.alias("p")), groups.select("lang", "s", "m", "base", "v", "slices"))
    both = pairs.select("lang", "value", F.explode(F.array(
        F.struct(F.col("s").alias("s"), F.col("t").alias("t")), F.struct(F.col("t").alias("s"), F.col("s").alias("t")))).alias("z"))
    names = checked_broadcast(groups.select("lang", "s", "source"), 64)
    both = both.select("lang", "value", F.col("z.s").alias("s"), F.col("z.t").alias("t")).join(names, ["lang", "s"]).drop("s")
    both = both.join(names.select("lang", F.col("s").alias("t"), F.col("source").alias("item")), ["lang", "t"])
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


@query("op13_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(sum(n), 0) AS group_n
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (group_n + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v)::HUGEINT AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.lang = a.lang AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, (p - q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INTEGER AS rank
FROM p WHERE n > 0 AND p > q QUALIFY rank <= 50""")
def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return audit(table(spark, sf, "documents"))
