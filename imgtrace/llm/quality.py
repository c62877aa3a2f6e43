"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a condition on a document that rejects it. On a bounded sample each rule's cost
(seconds a document) and selectivity (share rejected) are measured; the rules then run in
order of rejections per cost inside one CASE expression, which stops at the first that
rejects. The order decides what is spent, never what is kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query
from .tables import materialize, table

#: Documents the costs are estimated on, about.
SAMPLE_ROWS = 2000
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Symbols a word; mean characters a word; repeated lines in a hundred lines with a word.
MOST_SYMBOLS, SHORT_WORDS, LONG_WORDS, MOST_DUP_LINES = 1.0, 2.0, 20.0, 60
#: In a hundred lines with a word those that begin with a bullet, those that end with an ellipsis; words in a hundred with a letter, at least.
MOST_BULLETS, MOST_ELLIPSES, LEAST_LETTERED = 90, 30, 50
#: Occurrences of the most frequent word in a hundred words, 50 or more.
MOST_ONE_WORD = 50

WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
BULLET = r"^[\x20\x09-\x0D]*[-*\x{2022}\x{2023}\x{25CF}\x{25E6}]"
ELLIPSIS = r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$"
LETTER = r"\p{L}"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- features --------------------------------------------------------------------------------

def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)).cast("long")


def full_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def n_dup_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line, of the list of lines with a word."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_like(items: Column, pattern: str) -> Column:
    return F.size(F.filter(items, lambda x: x.rlike(pattern))).cast("long")


def n_middle_word(word_list: Column) -> Column:
    """Occurrences of the middle one of the sorted words; a word that makes more than half of them is that one."""
    middle = F.get(F.sort_array(word_list), F.floor(F.size(word_list) / 2).cast("int"))
    return let(middle, lambda m: F.size(F.filter(word_list, lambda x: x == m))).cast("long")


def n_repeat_words(word_list: Column) -> Column:
    """Words inside three-word windows that occur twice or more; windows are compared by a 64-bit hash.

    Texts without such a window are told apart by a hash set. For the others the windows are
    sorted with their places, those equal to a neighbour are kept, and each covers three words or as
    many as there are to the next.
    """
    def covered(places: Column) -> Column:
        gaps = F.aggregate(
            F.sequence(F.lit(0), F.size(places) - 2), F.lit(0),
            lambda acc, i: acc + F.least(F.lit(3), F.get(places, i + 1) - F.get(places, i)))
        return F.when(F.size(places) > 1, gaps + 3).otherwise(0)

    def places(ordered: Column) -> Column:
        same = lambda e, o: F.coalesce(F.get(ordered, o)["h"] == e["h"], F.lit(False))
        kept = F.filter(ordered, lambda e, i: same(e, i - 1) | same(e, i + 1))
        return F.sort_array(F.transform(kept, lambda e: e["i"]))

    def repeated(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(ordered, lambda o: let(places(o), covered)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(word_list, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), repeated))).cast("long")


# --- cascade ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def features(text: str = "text") -> dict[str, Column]:
    """The lists that rules look at, made once a row: `__w`, the words, and `__l`, the lines with a word."""
    return {"__w": words(F.col(text)), "__l": full_lines(F.col(text))}


#: Rules of the base; their numbers are wanted of every document.
BASE = ("few_words", "repeated_words")


def rules(text: str = "text") -> list[Rule]:
    """Rules over a table that has the columns of `features`."""
    t, w, lines = F.col(text), F.col("__w"), F.col("__l")
    n, n_lines = F.size(w), F.size(lines)
    chars = F.length(F.array_join(w, ""))
    return [
        Rule("few_words", n < LEAST_WORDS),
        Rule("repeated_words", n_repeat_words(w) * 100 > n * MOST_REPEATED),
        Rule("symbols", n_symbols(t) > n * MOST_SYMBOLS),
        Rule("word_length", (chars < n * SHORT_WORDS) | (chars > n * LONG_WORDS)),
        Rule("repeated_lines", n_dup_lines(lines) * 100 > n_lines * MOST_DUP_LINES),
        Rule("bullets", n_like(lines, BULLET) * 100 > n_lines * MOST_BULLETS),
        Rule("ellipses", n_like(lines, ELLIPSIS) * 100 > n_lines * MOST_ELLIPSES),
        Rule("letters", n_like(w, LETTER) * 100 < n * LEAST_LETTERED),
        Rule("one_word", n_middle_word(w) * 100 > n * MOST_ONE_WORD),
    ]


def estimate(docs: DataFrame, which: list[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) on a stored random sample of about `rows` documents."""
    share = min(1.0, rows / max(1, docs.count()))
    sample = materialize(docs.sample(share, 7).withColumns(features()), "quality-sample")
    n = max(1, sample.count())

    def run(condition: Column) -> tuple[float, int]:
        start = time.perf_counter()
        hits = sample.agg(F.count_if(F.coalesce(condition, F.lit(False)))).first()[0]
        return time.perf_counter() - start, hits

    run(F.lit(True))
    base = run(F.octet_length(F.col("text")) < 0)[0]  # what reading alone takes
    out = []
    for rule in which:
        spent, hits = run(rule.rejects)
        out.append((rule.name, max(spent - base, 1e-4) / n, hits / n))
    return out


def in_order(which: list[Rule], found: list[tuple[str, float, float]]) -> list[Rule]:
    """Most rejections per cost first; equal ones by cost, then by name."""
    rank = {name: (-share / cost, cost, name) for name, cost, share in found}
    return sorted(which, key=lambda r: rank[r.name])


def cascade(ordered: list[Rule]) -> Column:
    """The first rule that rejects the document, null if none does; later rules aren't evaluated."""
    out = F.when(F.coalesce(ordered[0].rejects, F.lit(False)), F.lit(ordered[0].name))
    for rule in ordered[1:]:
        out = out.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return out


def passing(docs: DataFrame, which: list[Rule] | None = None) -> DataFrame:
    """The rows of `docs` that no rule rejects.

    A null or empty text has no words and is rejected by `few_words`. Equal rows get equal
    verdicts; an empty table gives an empty one. Other columns are carried.
    """
    which = which or rules()
    ordered = in_order(which, estimate(docs.select("text"), which))
    return docs.withColumns(features()).where(cascade(ordered).isNull()).drop(*features())


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l) AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len([x FOR x IN l IF regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}\x{2023}\x{25CF}\x{25E6}]')]) AS n_bullets,
             len([x FOR x IN l IF regexp_matches(x, '(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$')]) AS n_ellipses,
             len([x FOR x IN w IF regexp_matches(x, '\pL')]) AS n_lettered,
             coalesce(list_max(map_values(list_histogram(w))), 0) AS n_most
      FROM d LEFT JOIN rep ON d.doc_id IS NOT DISTINCT FROM rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols > n_words * 1.0) AND NOT (word_chars < n_words * 2.0 OR word_chars > n_words * 20.0)
         AND NOT (n_dup_lines * 100 > n_lines * 60) AND NOT (n_bullets * 100 > n_lines * 90) AND NOT (n_ellipses * 100 > n_lines * 30)
         AND NOT (n_lettered * 100 < n_words * 50) AND NOT (n_most * 100 > n_words * 50) AS kept
FROM b
"""


@query("op9_quality_cascade", SQL)
def op9_quality_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    which = rules()
    ordered = in_order(which, estimate(docs.select("text"), which))
    t, w, lines = F.col("text"), F.col("__w"), F.col("__l")
    numbers = {
        "n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(lines), "n_repeat_words": n_repeat_words(w)}
    rows = docs.withColumns(features()).select("doc_id", w, lines, *[c.alias(name) for name, c in numbers.items()])
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    # what the contract has computed of every document is not computed again by a rule
    known = {
        "symbols": F.col("n_symbols") > F.col("n_words") * MOST_SYMBOLS,
        "word_length": (F.col("word_chars") < F.col("n_words") * SHORT_WORDS) | (F.col("word_chars") > F.col("n_words") * LONG_WORDS),
        "repeated_lines": F.col("n_dup_lines") * 100 > F.size(lines) * MOST_DUP_LINES}
    later = [Rule(r.name, known.get(r.name, r.rejects)) for r in ordered if r.name not in BASE]
    return rows.withColumn("base_failed", base).withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(cascade(later).isNull())).drop("__w", "__l")
