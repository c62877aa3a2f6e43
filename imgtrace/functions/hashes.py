"""Perceptual-hash and binary-code arithmetic (all code-generated or HOF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
SAME_IMAGE_BITS_PER_64 = 5
NOT_COMPARABLE = -1
# --------------------------------------------------------------------------

_HEX = r"^[0-9a-fA-F]+\z"


def hash_to_long(h: Column) -> Column:
    """16 hex digits as a signed 64-bit word; anything else is NULL."""
    return F.when(h.rlike(r"^[0-9a-fA-F]{16}\z"), F.conv(h, 16, -10).cast("bigint"))


def _comparable(a: Column, b: Column) -> Column:
    return (
        (F.length(a) == F.length(b))
        & (F.length(a) % 2 == 0)
        & a.rlike(_HEX)
        & b.rlike(_HEX)
    )


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two equally long hex hashes; NULL where not comparable."""

    def word(h: Column, i: Column) -> Column:
        return F.conv(F.substr(h, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint")

    one = F.bit_count(word(a, F.lit(0)).bitwiseXOR(word(b, F.lit(0))))
    many = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.length(a) - 1) / 16).cast("int")),
        F.lit(0),
        lambda acc, i: acc + F.bit_count(word(a, i).bitwiseXOR(word(b, i))),
    )
    return F.when(
        F.coalesce(_comparable(a, b), F.lit(False)),
        F.when(F.length(a) <= 16, one).otherwise(many),
    )


def hash_bits(h: Column) -> Column:
    return F.length(h) * 4


def same_image_threshold(h: Column) -> Column:
    """Largest distance that still means 'the same picture': 5 bits per 64, at least 1."""
    return F.greatest(F.lit(1), F.floor(hash_bits(h) * SAME_IMAGE_BITS_PER_64 / 64).cast("int"))


def hamming_code(a: Column, b: Column) -> Column:
    """Differing bits of two codes held as arrays of 64-bit words."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda acc, x: acc + x,
    )

