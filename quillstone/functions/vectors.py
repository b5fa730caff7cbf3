"""Vectors as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, empty vectors and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), F.try_divide(dot(a, b), norms)).otherwise(0.0)


def bounded_cosine(a: Column, b: Column) -> Column:
    """One minus the cosine distance, clamped."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def hash_slot(token: Column, dims: int) -> tuple[Column, Column]:
    """(index, sign) of a token in a hash embedding: the SHA-256's first four bytes mod dims; +1 if its fifth byte is even."""
    h = F.sha2(token.cast("binary"), 256)
    index = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims).cast("int")
    return index, F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def hash_embedding(tokens: Column, dims: int) -> Column:
    """The signed counts of a text's tokens by slot, with unit length; zeros without tokens."""
    def slot(i):
        return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.when(hash_slot(t, dims)[0] == i, hash_slot(t, dims)[1]).otherwise(0.0))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), slot)
    norm = F.sqrt(dot(raw, raw))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
