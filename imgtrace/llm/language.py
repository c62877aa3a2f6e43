"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3 together, the
blended spectrum) that both contain at all, over the geometric mean of how many each
contains. N-grams are numbered by a hash into 2^14 cells. A bounded sample of labelled
texts is fitted: landmarks chosen from it span the kernel (Nyström), and one ridge
regression per language, against all others, is solved in that span. Fitting sees
2 KiB of presence bits per text; every text is then scored whole, by one product of a
batch's presence matrix with the landmarks and one with the regressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .queries import query
from .tables import table, take_columns
from .words import blocks

CELLS, LENGTHS = 1 << 14, (1, 2, 3)
#: Bounds of the fit: labelled rows a language, landmarks a language, languages' landmarks in all.
FIT_ROWS, LANDMARKS, MAX_LANDMARKS = 512, 32, 512
RIDGE, NO_LANGUAGE = 1e-3, "und"
#: Documents scored at a time, at most.
ROWS = 256
#: Below this every regression finds the text clearly unlike its language.
LEAST_SCORE = 0.3

_symbols: np.ndarray | None = None


def symbols() -> np.ndarray:
    """Per code point of the basic plane: 0 no letter, 1 digit, else a number of the lower-case letter."""
    global _symbols
    if _symbols is None:
        out = np.zeros(1 << 16, np.uint8)
        for cp in range(1 << 16):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[cp] = 2 + (low if low < 128 else low * 40503 >> 4) % 254
            elif c.isdigit():
                out[cp] = 1
        _symbols = out
    return _symbols


def presence(texts: pa.Array):
    """(first row, past last row, 0/1 matrix of texts and cells, has a letter) in bounded blocks."""
    lut = symbols()
    for lo, hi, data, offsets in blocks(texts):
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        sym = lut[np.minimum(cps, 0xFFFF)].astype(np.uint32)
        for at in np.flatnonzero(cps > 0xFFFF):
            sym[at] = 2 + cps[at] % 254 if chr(cps[at]).isalpha() else 0
        for first in range(0, hi - lo, ROWS):
            n = min(ROWS, hi - lo - first)
            at = heads[first:first + n + 1]
            s = sym[at[0]:at[-1]]
            row = np.repeat(np.arange(n), np.diff(at))
            out = np.zeros((n, CELLS), np.uint8)
            code = s
            for k in LENGTHS:
                if k > 1:
                    code = (code[:-1] << np.uint32(8)) | s[k - 1:]
                if not len(code):
                    break
                own = row[:len(code)] if k == 1 else row[:len(code)][row[:len(code)] == row[k - 1:]]
                c = code if k == 1 else code[row[:len(code)] == row[k - 1:]]
                cell = ((c + np.uint32(k << 26)) * np.uint32(2654435761)) >> np.uint32(32 - 14)
                out.reshape(-1)[own * CELLS + cell] = 1
            letter = np.bincount(row[s > 1], minlength=n) > 0
            yield lo + first, lo + first + n, out, letter


def held_out(key: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == which, F.lit(False))


# --- fit -------------------------------------------------------------------------------------

def sample_bits(labelled: DataFrame, rows: int = FIT_ROWS) -> list:
    """At most `rows` rows a language, chosen by a hash, as (lang, packed presence)."""
    labelled = take_columns(labelled, doc_id="long", text="string", lang="string").where("text IS NOT NULL AND lang IS NOT NULL")
    n = labelled.groupBy("lang").agg(F.count("*").alias("__n"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    # about twice the rows of a language pass the first cut, so that the window sees a bounded number
    some = labelled.join(F.broadcast(n), "lang").withColumn("__at", place).where(F.col("__at") * F.col("__n") <= 2 * rows)
    w = Window.partitionBy("lang").orderBy("__at", "text")
    picked = some.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= rows).select("lang", "text")

    def run(batches):
        for batch in batches:
            for lo, hi, p, letter in presence(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in np.packbits(p, axis=1)], pa.binary()),
                     pa.array(letter)], ["lang", "bits", "letter"])

    return picked.mapInArrow(run, "lang string, bits binary, letter boolean").where("letter").orderBy("lang", "bits").collect()


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, landmarks' presence over root of their size, weights with a last row for the constant)."""
    got = sample_bits(labelled, rows)
    langs = sorted({r["lang"] for r in got})
    if not got:
        return [], np.zeros((CELLS, 0), np.float32), np.zeros((1, 0), np.float32)
    p = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in got]), axis=1).astype(np.float32)
    p /= np.sqrt(p.sum(1, keepdims=True))
    lang = np.array([langs.index(r["lang"]) for r in got])
    each = max(1, min(LANDMARKS, MAX_LANDMARKS // len(langs)))
    marks = np.concatenate([np.flatnonzero(lang == k)[:: max(1, (lang == k).sum() // each)][:each] for k in range(len(langs))])
    kernel = (p @ p[marks].T).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[marks])
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    z = np.concatenate((kernel @ root, np.ones((len(p), 1))), axis=1)
    weight = np.sqrt(len(p) / (len(langs) * np.bincount(lang)))[lang, None]  # languages count alike
    y = np.where(lang[:, None] == np.arange(len(langs)), 1.0, -1.0)
    zw = z * weight
    solved = np.linalg.solve(zw.T @ zw + RIDGE * len(p) * np.eye(z.shape[1]), zw.T @ (y * weight))
    weights = np.concatenate((root @ solved[:-1], solved[-1:])).astype(np.float32)
    return langs, np.ascontiguousarray(p[marks].T), weights


# --- scoring ---------------------------------------------------------------------------------

def guesser(spark: SparkSession, model):
    """A function of a text column: struct of lang_pred and score."""
    langs, marks, weights = model
    sent = spark.sparkContext.broadcast((marks, weights))
    names = pa.array([*langs, NO_LANGUAGE])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(text: pa.Array) -> pa.Array:
        g, w = sent.value
        best, top = np.full(len(text), len(langs)), np.zeros(len(text))
        for lo, hi, p, letter in presence(text):
            if len(langs):
                k = (p.astype(np.float32) @ g) / np.sqrt(np.maximum(1, p.sum(1, dtype=np.int64)))[:, None]
                f = k @ w[:-1] + w[-1]
                best[lo:hi] = np.where(letter, f.argmax(1), len(langs))
                top[lo:hi] = np.where(letter, np.clip((f.max(1) + 1) / 2, 0, 1), 0)
        return pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(top)], ["lang_pred", "score"])

    return guess


def predict(docs: DataFrame, model) -> DataFrame:
    """`docs` with lang_pred and score (0 to 1; 0.5 is the regression's zero).

    A null text, an empty one and one without letters is `und` with score 0. Nothing but `text`
    is looked at, whole at any length; repeated rows get the same answer, and of equal scores the first language by name
    wins. Other columns are carried. An empty table gives no rows; without labelled rows all is `und`.
    """
    made = docs.withColumn("__guess", guesser(docs.sparkSession, model)(F.col("text").cast("string")))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], "__guess.*")


def train(docs: DataFrame, parts: int = 3, which: int = 1):
    return fit(docs.where(~held_out(F.col("doc_id"), parts, which)))


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of `docs` in a learned language; texts without letters or like none of them go.

    Null and empty texts go, repeated rows share their fate, texts of any length are looked at whole. Where no row has
    a language to learn, or in an empty table, nothing stays.
    """
    made = docs.withColumn("__guess", guesser(docs.sparkSession, train(docs))(F.col("text").cast("string")))
    sure = (F.col("__guess.lang_pred") != NO_LANGUAGE) & (F.col("__guess.score") >= LEAST_SCORE)
    return made.where(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return predict(rows, train(docs)).select("doc_id", "held_out", "lang_pred", "score")
