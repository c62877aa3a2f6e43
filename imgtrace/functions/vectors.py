"""Vector rules. Dot products accumulate in double; scores are float32."""

from __future__ import annotations

import base64
import binascii

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BITS = 64


def code_words(vector_size: int) -> int:
    """Words of a code of that many dimensions."""
    return -(-vector_size // WORD_BITS)


def encode_sign(v: Column) -> Column:
    """One bit per dimension (set iff strictly positive), 64 dims per word, low bit first."""

    def bit(x: Column, i: Column) -> Column:
        return F.when(
            (x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
        ).otherwise(F.lit(0).cast("bigint"))

    def word(w: Column) -> Column:
        dims = F.slice(v, w * WORD_BITS + 1, WORD_BITS)
        return F.aggregate(
            F.transform(dims, bit),
            F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(b),
        )

    last = F.floor((F.size(v) - 1) / WORD_BITS).cast("int")
    return F.transform(F.sequence(F.lit(0), last), word)


def encode_sign_bulk(v: Column) -> Column:
    """`encode_sign` for whole tables: bits are packed for a batch at a time."""

    @F.arrow_udf("array<bigint>")
    def pack(vectors: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        words = -(-lengths // WORD_BITS)
        ends = np.concatenate(([0], np.cumsum(words)))
        start = np.cumsum(lengths) - lengths
        bits = np.zeros(int(ends[-1]) * WORD_BITS, bool)
        place = np.arange(len(flat)) - np.repeat(start, lengths) + np.repeat(ends[:-1] * WORD_BITS, lengths)
        with np.errstate(invalid="ignore"):
            bits[place] = flat > 0
        packed = np.packbits(bits, bitorder="little").view("<i8")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(packed), mask=vectors.is_null())

    return pack(v)


def _sum_of(v: Column, each) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + each(x))


def _sq(x: Column) -> Column:
    return x.cast("double") * x.cast("double")


def squared_norm(v: Column) -> Column:
    return _sum_of(v, _sq)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def normalize(v: Column) -> Column:
    """L2-normalise; zero, infinite and NaN sums leave the vector unchanged."""

    def scaled(norm2: Column) -> Column:
        broken = (norm2 == 0) | F.isnan(norm2) | (norm2 == F.lit(float("inf")))
        inverse = F.lit(1.0) / F.sqrt(norm2)
        return F.when(broken, v).otherwise(F.element_at(F.transform(
            F.array(inverse), lambda by: F.transform(v, lambda x: (x.cast("double") * by).cast("float"))), 1))

    # one-element arrays bind the norm and its inverse, so that neither is computed per element
    return F.element_at(F.transform(F.array(squared_norm(v)), scaled), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine as float32; 0 when a norm is 0; a dimension mismatch raises."""
    na, nb = squared_norm(a), squared_norm(b)
    score = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        dot(a, b) / (F.sqrt(na) * F.sqrt(nb))
    )
    mismatch = F.raise_error(
        F.concat(F.lit("vector sizes differ: "), F.size(a).cast("string"),
                 F.lit(" and "), F.size(b).cast("string"))
    ).cast("float")
    return F.when(F.size(a) != F.size(b), mismatch).otherwise(score.cast("float"))


def first_non_finite(v: Column) -> Column:
    """0-based index of the first NaN or infinity, NULL if all are finite."""
    inf = F.lit(float("inf")).cast("float")
    bad = F.transform(v, lambda x: F.isnan(x) | (F.abs(x) == inf))
    at = F.array_position(bad, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


_DECODED = T.StructType([
    T.StructField("values", T.ArrayType(T.FloatType())),
    T.StructField("reject", T.StringType()),
])


def decode_wire(data: Column, size: Column) -> Column:
    """base64 of little-endian float32 -> struct(values, reject). Arrow batches.

    `reject` is NULL for a good row, else 'base64', 'length' (not a multiple of
    4 bytes) or 'size' (declared size > 0 differs from the actual one).
    """

    @F.pandas_udf(_DECODED)
    def decode(raw: pd.Series, want: pd.Series) -> pd.DataFrame:
        values, reject = [], []
        for text, declared in zip(raw, want):
            try:
                blob = base64.b64decode(text or "", validate=True)
            except (binascii.Error, ValueError):
                values.append(None)
                reject.append("base64")
                continue
            if len(blob) % 4:
                values.append(None)
                reject.append("length")
                continue
            arr = np.frombuffer(blob, dtype="<f4")
            bad = pd.notna(declared) and declared > 0 and declared != arr.size
            values.append(None if bad else arr)
            reject.append("size" if bad else None)
        return pd.DataFrame({"values": values, "reject": reject})

    return decode(data, size)


def encode_wire(v: Column) -> Column:
    """Inverse of `decode_wire`: float array -> base64 text. Arrow batches."""

    @F.pandas_udf(T.StringType())
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(
            lambda x: None if x is None
            else base64.b64encode(np.asarray(x, dtype="<f4").tobytes()).decode("ascii")
        )

    return encode(v)
