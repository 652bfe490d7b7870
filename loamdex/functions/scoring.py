"""The numbers behind rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of the ranking function, of rank fusion, and the weights of (lexical, semantic) ranks by query shape.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_OFFSET, DEPTH = 60, 100
WEIGHTS = {"IDENTIFIER": (1.0, 0.002), "NATURAL_LANGUAGE": (1.0, 1.0)}


def idf(rows: Column, with_phrase: Column) -> Column:
    """Inverse document frequency, with a small positive value where it is not positive."""
    raw = F.log((rows - with_phrase + 0.5) / (with_phrase + 0.5))
    return F.when(raw > 0, raw).otherwise(LEAST_IDF)


def idf_value(rows: int, with_phrase: int) -> float:
    """``idf`` of plain numbers."""
    return max(math.log((rows - with_phrase + 0.5) / (with_phrase + 0.5)), 0.0) or LEAST_IDF


def bm25_part(weight: Column, frequency: Column, length: Column, mean_length: Column) -> Column:
    """One phrase's share of a score; lower is better. Columns or arrays."""
    return -weight * (frequency * (K1 + 1)) / (frequency + K1 * (1 - B + B * length / mean_length))


def rrf(lexical: Column, semantic: Column, shape: Column) -> Column:
    """Reciprocal rank fusion of two ranks from 1, of which one may be null; higher is better."""

    def share(rank: Column, side: int) -> Column:
        weight = F.when(shape == "IDENTIFIER", WEIGHTS["IDENTIFIER"][side]).otherwise(WEIGHTS["NATURAL_LANGUAGE"][side])
        return F.coalesce(weight / (rank + RRF_OFFSET), F.lit(0.0))

    return share(lexical, 0) + share(semantic, 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity within [-1, 1]; null for vectors without direction or of other lengths."""
    raw = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    known = (F.size(a) == F.size(b)) & raw.isNotNull() & ~F.isnan(raw)  # greatest and least pass over nulls
    return F.when(known, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))
