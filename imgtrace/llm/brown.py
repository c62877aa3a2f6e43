"""Brown class-based bigram scores: P(word | before) = P(class | class before) * P(word | class).

Every training word has a class from its own contexts, and classes grow with the vocabulary: as many as its
cube root. Exchange clustering starts from the most frequent words, `PER_CLASS` for each class: each word in turn moves
to the class where the likelihood of the class bigrams is largest, until few move. Every other word makes
one such move against the classes found, by the classes that stand before and after it in all texts.
Only words that training never saw go by their length: they count as unseen words of
the class that most words seen once of that length belong to.

The classes of the most frequent words (`CORE`, a bound) travel to the tasks; all others are looked up by a
join, so the vocabulary is never in one place, and results don't depend on `CORE`. Words are known by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import held_out
from .queries import query
from .tables import materialize, table
from .words import blocks, each_text, find_words, hash_words, signed

CORE, PER_CLASS, SHAPES = 1 << 18, 16, 4
SWEEPS, HALF, PULL = 8, 0.5, 50.0
#: Words worked on at once and rows combined at once, in a task.
STEP, PENDING = 1 << 14, 1 << 20


def class_count(vocabulary: int) -> int:
    """Classes of a vocabulary; the end of a text is one more."""
    return max(2, round(vocabulary ** (1 / 3)))


# --- tokens ----------------------------------------------------------------------------------

def shape(lengths: np.ndarray) -> np.ndarray:
    return np.minimum((lengths - 1) // 4, SHAPES - 1)


class Index:
    """Open addressing over distinct 64-bit hashes; `find` gives their numbers, -1 for others."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            _, one = np.unique(slot[left], return_index=True)
            one = left[one]
            one = one[self.at[slot[one]] < 0]
            self.keys[slot[one]], self.at[slot[one]] = keys[one], one
            left = left[self.at[slot[left]] != left]
            slot[left] = (slot[left] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> self.shift).astype(np.int64)
        out = self.at[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            got = self.at[slot[wrong]]
            out[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[slot[wrong]] != h[wrong])]
        return out


def tokens(texts: pa.Array):
    """(first row, past last row, word hashes, shapes, words per text) in bounded blocks."""
    for lo, hi, data, offsets in blocks(texts):
        starts, lengths, per = find_words(data, offsets)
        yield lo, hi, hash_words(data, starts, lengths), shape(lengths), per


def with_ends(values: np.ndarray, per: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(values with one `end` after each text's, the places of the words)."""
    place = np.arange(len(values)) + np.repeat(np.arange(len(per)), per)
    out = np.full(len(values) + len(per), end, np.int64)
    out[place] = values
    return out, place


def before(values: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; the end of the last text stands before a first word."""
    return np.concatenate(([end], values[:-1]))


# --- counts ----------------------------------------------------------------------------------

def word_counts(train: DataFrame) -> DataFrame:
    """(h, shape, n) of all words of `train`."""

    def run(batches):
        for batch in batches:
            for _, _, h, s, _ in tokens(batch.column(0)):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(s[first].astype(np.int32)), pa.array(n)], ["h", "shape", "n"])

    rows = train.mapInArrow(run, "h long, shape int, n long")
    return rows.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, count) of the words above the least count that at most `most` words reach, most frequent first."""
    steps = words.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words")).collect()
    limit, seen = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        seen += r["words"]
        if seen > most:
            break
        limit = r["step"]
    rows = words.where(F.floor(F.log2("n") * 16) >= (1 << 30 if limit is None else limit)).select("h", "class", "n").toArrow()
    h, classes, n = (rows[c].to_numpy() for c in ("h", "class", "n"))
    order = np.lexsort((h, -n))
    return h[order].view(np.uint64), classes[order].astype(np.int64), n[order]


def combined(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one, with the sum of their `n`."""
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.ones(len(n), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new)
    return [c[heads] for c in columns], np.add.reduceat(n, heads) if len(heads) else n


def gathered(train: DataFrame, count, schema: str) -> DataFrame:
    """Rows that `count(h, shapes, per)` gives for a block of texts as columns of int64, with their number `n`, added up task by task in
    buffers of about `PENDING` rows. They are rows of parts: the same one comes from many tasks."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        kept, rows = [], 0

        def flush():
            got, n = combined([np.concatenate(c) for c in list(zip(*kept))[:-1]], np.concatenate([k[-1] for k in kept]))
            return [*got, n]

        def out(columns):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "n"])

        for batch in batches:
            for _, _, h, s, per in tokens(batch.column(0)):
                columns = count(h, s, per)
                got, n = combined(columns, np.ones(len(columns[0]), np.int64))
                kept.append([*got, n])
                rows += len(n)
                if rows > PENDING:
                    kept = [flush()]
                    rows = len(kept[0][0])
                    if rows > PENDING // 2:
                        yield out(kept[0])
                        kept, rows = [], 0
        if rows:
            yield out(flush())

    return train.mapInArrow(run, schema + ", n long")


def square(rows: DataFrame, a: str, b: str, size: int) -> np.ndarray:
    """The (a, b) table of sums of `n`, `size` x `size`, which bounds what is fetched."""
    got = rows.groupBy(a, b).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size))
    out[got[a].to_numpy(), got[b].to_numpy()] = got["n"].to_numpy()
    return out


# --- classes ---------------------------------------------------------------------------------

def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(n: np.ndarray, left: np.ndarray, right: np.ndarray, own: float) -> np.ndarray:
    """Likelihood gained by putting a word into each class.

    `n`: class bigrams without the word; `left`/`right`: the word's neighbours by class; `own`: how often it follows itself.
    """
    k = len(n)
    rows = (xlogx(n + right[None, :]) - xlogx(n)).sum(1)
    cols = (xlogx(n + left[:, None]) - xlogx(n)).sum(0)
    d = np.arange(k)
    cell = n[d, d]
    both = xlogx(cell + left + right + own) + xlogx(cell) - xlogx(cell + right) - xlogx(cell + left)
    out, into = n.sum(1) + left, n.sum(0) + right  # the word's neighbours count there wherever it goes
    return rows + cols + both - xlogx(out + right.sum() + own) + xlogx(out) - xlogx(into + left.sum() + own) + xlogx(into)


def exchange(bigrams: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each word, class bigrams), from a start with the most frequent words alone. Rows past `words` (other words, ends) keep classes of their own."""
    fixed = len(bigrams) - words
    k = classes + fixed
    own = np.concatenate((np.minimum(np.arange(words), classes - 1), classes + np.arange(fixed)))
    hot = np.eye(k)[own]
    right, left = bigrams @ hot, bigrams.T @ hot
    n = hot.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            c, self_ = own[w], bigrams[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[c] -= self_
            l[c] -= self_
            n[c] -= r
            n[:, c] -= l
            n[c, c] -= self_
            d = int(gains(n, l, r, self_)[:classes].argmax())
            n[d] += r
            n[:, d] += l
            n[d, d] += self_
            if d != c:
                own[w] = d
                right[:, c] -= bigrams[:, w]
                right[:, d] += bigrams[:, w]
                left[:, c] -= bigrams[w]
                left[:, d] += bigrams[w]
                moved += 1
        if moved * 100 <= words:
            break
    return own[:words], n


def contexts(train: DataFrame, index, clusters: np.ndarray, k: int) -> DataFrame:
    """(h, cell, n) of every word that isn't in `index`: how often it stands between which classes.

    A cell is (shape * k + class before) * k + class after; the last two of the `k` classes are other words and ends.
    """

    def count(h, s, per):
        at, place = with_ends(index.value.find(h), per, -2)
        c = np.full(len(at), k - 2)
        c[at >= 0] = clusters[at[at >= 0]]
        c[at == -2] = k - 1
        mine = at[place] < 0
        p = place[mine]
        return [signed(h[mine]), (s[mine] * k + before(c, k - 1)[p]) * k + c[p + 1]]

    return gathered(train, count, "h long, cell long")


def many_gains(n: np.ndarray, left: np.ndarray, right: np.ndarray, classes: int) -> np.ndarray:
    """`gains` of many words (a row of `left` and `right` each), for the first `classes` classes.

    The work follows the neighbours a word has, and equal numbers of one neighbour class are worked out once.
    """
    def changes(table, seen):  # table: (all, classes)
        w, j = np.nonzero(seen)
        x = seen[w, j].astype(np.int64)
        u, back = np.unique(j * (x.max() + 1) + x, return_inverse=True)
        uj, ux = np.divmod(u, x.max() + 1)
        each = xlogx(table[uj] + ux[:, None]) - xlogx(table[uj])
        return np.add.reduceat(each[back], np.searchsorted(w, np.arange(len(seen))))

    total = changes(n[:classes].T, right) + changes(n[:, :classes], left)
    l, r = left[:, :classes], right[:, :classes]
    w, d = np.nonzero((l > 0) & (r > 0))
    cell, lw, rw = n[d, d], l[w, d], r[w, d]
    total[w, d] += xlogx(cell + lw + rw) + xlogx(cell) - xlogx(cell + rw) - xlogx(cell + lw)
    out, into = n.sum(1)[:classes] + l, n.sum(0)[:classes] + r
    return total - xlogx(out + right.sum(1, keepdims=True)) + xlogx(out) - xlogx(into + left.sum(1, keepdims=True)) + xlogx(into)


def choose(seen: DataFrame, n: np.ndarray, classes: int) -> DataFrame:
    """(h, shape, class, n) of the words of `contexts`, each in the class where it gains most."""
    k = len(n)

    def settle(h, cell, times):
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        word = np.repeat(np.arange(len(heads)), np.diff(np.concatenate((heads, [len(h)]))))
        table = lambda c: np.bincount(word * k + c, times, len(heads) * k).reshape(len(heads), k)
        best = many_gains(n, table(cell // k % k), table(cell % k), classes).argmax(1)
        return pa.RecordBatch.from_arrays(
            [pa.array(h[heads]), pa.array((cell[heads] // (k * k)).astype(np.int32)), pa.array(best.astype(np.int32)), pa.array(np.add.reduceat(times, heads))],
            ["h", "shape", "class", "n"])

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate((a, c.to_numpy(zero_copy_only=False))) for a, c in zip(rest, batch.columns, strict=True)]
            ends = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1  # where a word is complete
            lo = 0
            while len(ends) and lo < ends[-1]:
                hi = int(ends[max(np.searchsorted(ends, lo + STEP, "right") - 1, np.searchsorted(ends, lo, "right"))])
                yield settle(*(a[lo:hi] for a in now))
                lo = hi
            rest = [a[lo:] for a in now]
        if len(rest[0]):
            yield settle(*rest)

    whole = seen.repartition("h").groupBy("h", "cell").agg(F.sum("n").alias("n")).sortWithinPartitions("h")
    return whole.mapInArrow(run, "h long, shape int, class int, n long")


def transitions(train: DataFrame, words: DataFrame, index, core: np.ndarray, end: int) -> np.ndarray:
    """How often each class follows each, of all tokens; words outside `index` get their classes by two joins."""

    def count(h, s, per):
        at, place = with_ends(index.value.find(h), per, -2)
        c, key = np.full(len(at), end), np.zeros(len(at), np.int64)
        c[at >= 0] = core[at[at >= 0]]
        c[at == -1] = -1
        key[place] = np.where(at[place] < 0, signed(h), 0)
        return [before(c, end), before(key, 0), c, key]

    rows = gathered(train, count, "a long, ha long, b long, hb long")
    rows = materialize(rows.groupBy("a", "ha", "b", "hb").agg(F.sum("n").alias("n")), "brown-bigrams")

    def classed(rows, c, key):
        known = words.select(F.col("h").alias(key), F.col("class").cast("long").alias("__c"))
        found = rows.where(F.col(c) < 0).join(known, key).withColumn(c, F.col("__c")).drop("__c")
        return rows.where(F.col(c) >= 0).unionByName(found).withColumn(key, F.lit(0).cast("long")).groupBy("a", "ha", "b", "hb").agg(F.sum("n").alias("n"))

    return square(classed(classed(rows, "a", "ha"), "b", "hb"), "a", "b", end + 1)


# --- model -----------------------------------------------------------------------------------

@dataclass
class Model:
    """`words`: (h, shape, class, n) of every training word. The arrays are bounded by CORE and the number of classes."""

    words: DataFrame
    keys: np.ndarray
    n: np.ndarray
    classes: np.ndarray
    log_next: np.ndarray
    class_total: np.ndarray
    class_words: np.ndarray
    unseen: np.ndarray
    train_tokens: int
    vocabulary: int
    ends: int

    @property
    def end(self) -> int:
        """The class of the end of a text, the last one."""
        return len(self.log_next) - 1

    def base_log(self, n):
        return np.log10((n + HALF) / (self.train_tokens + HALF * (self.vocabulary + 1)))

    def emission_log(self, n, c):
        return np.log10((n + HALF) / (self.class_total[c] + HALF * (self.class_words[c] + 1)))


def learn(train: DataFrame) -> Model:
    """A model of all texts of `train`; a null text is an empty one. Without any text no word is known and all classes are empty."""
    spark, train = train.sparkSession, train.select(F.col("text").cast("string").alias("text"))
    counts = materialize(word_counts(train), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    classes = class_count(total[1])
    first = counts.orderBy(F.desc("n"), "h").limit(PER_CLASS * classes).toArrow()
    keys = first["h"].to_numpy().view(np.uint64)
    index = spark.sparkContext.broadcast(Index(keys))

    top = len(keys)
    other, end = top, top + 1

    def bigrams(h, s, per):
        at = index.value.find(h)
        at[at < 0] = other
        at, _ = with_ends(at, per, end)
        return [before(at, end), at]

    pairs = square(gathered(train, bigrams, "a long, b long"), "a", "b", top + 2)
    clusters, n_class = exchange(pairs, top, classes)
    chosen = choose(contexts(train, index, clusters, classes + 2), n_class, classes)
    fixed = pa.table({"h": first["h"], "shape": first["shape"], "class": pa.array(clusters.astype(np.int32)), "n": first["n"]})
    words = materialize(chosen.unionByName(spark.createDataFrame(fixed, chosen.schema)), "brown-words")

    keys, core, n = frequent(words, CORE)
    moves = transitions(train, words, spark.sparkContext.broadcast(Index(keys)), core, classes)
    into = moves.sum(0)
    share = (into + HALF) / (into.sum() + HALF * (classes + 1))
    log_next = np.log10((moves + PULL * share) / (moves.sum(1, keepdims=True) + PULL))
    held, once = np.zeros(classes + 1, np.int64), np.zeros((SHAPES, classes), np.int64)
    for r in words.groupBy("class", "shape").agg(F.count("*").alias("words"), F.count_if(F.col("n") == 1).alias("once")).collect():
        held[r["class"]] += r["words"]
        once[r["shape"], r["class"]] += r["once"]
    held[classes] = int(ends > 0)
    return Model(words, keys, n, core, log_next, into, held, once.argmax(1), total[0] + ends, total[1] + int(ends > 0), ends)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words and one end; a null or empty text is the end alone. Each row is scored by
    itself, so repeated rows and null ids do no harm. Other columns are carried, those of
    these names replaced.
    """
    spark = docs.sparkSession
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in (*made, "text")]
    bare = Model(None, *[getattr(model, f) for f in list(Model.__dataclass_fields__)[1:]])
    sent = spark.sparkContext.broadcast((bare, Index(model.keys)))
    local = ("struct<n_tokens:bigint,n_known:bigint,base:double,own:double,"
             "rare:array<bigint>,left:array<int>,right:array<int>,kind:array<int>>")

    @F.pandas_udf(local)
    def first_part(text):
        """Sums over what stands between known words, and the other words with the classes beside them (-1: another such word)."""
        import pandas as pd

        m, index = sent.value
        core_base = m.base_log(m.n)
        core_own = m.emission_log(m.n, m.classes)
        end_base = m.base_log(m.ends)
        end_own = m.emission_log(m.ends, m.end)
        out = []
        for _, _, h, s, per in tokens(pa.Array.from_pandas(text, type=pa.large_string())):
            at = index.find(h)
            known = at >= 0
            mine = np.full(len(h), -1)
            mine[known] = m.classes[at[known]]
            c, place = with_ends(mine, per, m.end)
            prior = before(c, m.end)
            base, own = np.full(len(c), end_base), np.where((c >= 0) & (prior >= 0), m.log_next[prior, c], 0.0)
            own_words = np.zeros(len(h))
            base_words = np.zeros(len(h))
            base_words[known], own_words[known] = core_base[at[known]], core_own[at[known]]
            base[place] = base_words
            own[place] += own_words
            heads = np.cumsum(per + 1) - per - 1
            own[heads + per] += end_own
            sums = np.add.reduceat(np.stack((base, own)), heads, axis=1)
            rare = np.flatnonzero(~known)
            p = place[rare]
            parts = signed(h[rare]), prior[p].astype(np.int32), c[p + 1].astype(np.int32), s[rare].astype(np.int32)
            cut = np.searchsorted(rare, each_text(per))
            for i in range(len(per)):
                a, b = cut[i], cut[i + 1]
                out.append((int(per[i]) + 1, int(per[i] - (b - a)) + int(m.ends > 0), sums[0, i], sums[1, i], *[x[a:b] for x in parts]))
        return pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "own", "rare", "left", "right", "kind"])

    @F.pandas_udf("struct<known:bigint,base:double,own:double>")
    def second_part(rare, left, right, kind, found, classes, counts):
        """The same sums for the other words; `found`: those that training saw, with class and count."""
        import pandas as pd

        m, _ = sent.value
        out = []
        for h, l, r, s, f, fc, fn in zip(rare, left, right, kind, found, classes, counts, strict=True):
            c, n = m.unseen[s], np.zeros(len(h), np.int64)
            if f is not None and len(f):
                order = np.argsort(f)
                at = order[np.minimum(np.searchsorted(f, h, sorter=order), len(f) - 1)]
                hit = f[at] == h
                c, n = np.where(hit, fc[at], c), np.where(hit, fn[at], 0)
            l = np.where(l < 0, before(c, m.end), l)
            after = np.where(r < 0, 0.0, m.log_next[c, np.maximum(r, 0)])  # -1: the next one's own part
            out.append((int((n > 0).sum()), m.base_log(n).sum(), (m.log_next[l, c] + after + m.emission_log(n, c)).sum()))
        return pd.DataFrame(out, columns=["known", "base", "own"])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias("__row"), F.col("text").cast("string").alias("__text"))
    part = materialize(rows.withColumn("__p", first_part("__text")).drop("__text"), "brown-parts")
    rare = part.select("__row", F.explode(F.array_distinct("__p.rare")).alias("h"))
    found = rare.join(model.words.select("h", "class", "n"), "h").groupBy("__row").agg(F.collect_list(F.struct("h", "class", "n")).alias("__f"))
    some = F.size("__p.rare") > 0
    more = part.where(some).select("__row", "__p").join(found, "__row", "left").select("__row", second_part(
        *[F.col(f"__p.{c}") for c in ("rare", "left", "right", "kind")], *[F.col(f"__f.{c}") for c in ("h", "class", "n")]).alias("__q"))
    whole = part.select(*[F.col(f"`{c}`") for c in kept], "__row", *[F.col(f"__p.{c}").alias(f"__{c}") for c in ("n_tokens", "n_known", "base", "own")])
    whole = whole.join(more, "__row", "left")
    zero = lambda c: F.coalesce(F.col(f"__q.{c}"), F.lit(0))
    return whole.select(
        *[F.col(f"`{c}`") for c in kept], F.col("__n_tokens").alias("n_tokens"), (F.col("__n_known") + zero("known")).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("__base") + zero("base")).alias("base_score"),
        (F.col("__own") + zero("own")).alias("score"))


@query("op1_brown_scores")
def op1_brown_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 1))
    return score(docs, learn(docs.where("NOT held_out")))
