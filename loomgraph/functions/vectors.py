"""Vector functions on arrays, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, different lengths, or a norm below 1e-9."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (F.sqrt(dot(a, a)) >= 1e-9) & (F.sqrt(dot(b, b)) >= 1e-9)
    return F.when(fit, dot(a, b) / norm).otherwise(0.0)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a text's SHA-256; zeros for a blank one.

    Component i reads the hex digits from 2i (mod 64) up to, not including, 2i + 4 (mod 64) + 4;
    digits beyond the end are missing, none at all counts as 0.
    """
    digest = F.sha2(text, 256)
    values = []
    for i in range(dim):
        start, end = (2 * i) % 64, (2 * i + 4) % 64 + 4
        digits = F.substring(digest, start + 1, end - start) if end > start else F.lit("0")
        values.append((F.conv(digits, 16, 10).cast("long") % 10000) / 5000 - 1)
    raw = F.array(*values)
    norm = F.sqrt(dot(raw, raw))
    unit = F.transform(raw, lambda x: F.when(norm > 1e-9, x / norm).otherwise(x))
    return F.when(F.regexp_replace(text, r"\s+", "") == "", F.array(*[F.lit(0.0)] * dim)).otherwise(unit)
