"""Vector scalars: cosine, 8-bit quantization, set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one is all zero."""

    def of(s: Column) -> Column:
        return let(norm(s["a"]) * norm(s["b"]), lambda n: F.when(n > 0, dot(s["a"], s["b"]) / n).otherwise(F.lit(0.0)))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), of))


def quantize(v: Column) -> Column:
    """(scale, q): the largest absolute value, and each element as v / scale * 127, halves rounded up."""

    def of(s: Column) -> Column:
        q = F.transform(s["v"], lambda x: F.floor(x / s["scale"] * 127 + 0.5).cast("tinyint"))
        return F.struct(s["scale"].cast("float").alias("scale"), q.alias("q"))

    top = F.greatest(F.array_max(v), -F.array_min(v))
    return let(F.struct(v.alias("v"), F.when(top > 0, top).otherwise(F.lit(1.0)).cast("double").alias("scale")), of)


def dequantize(scale: Column, q: Column) -> Column:
    """The unit vector that q stands for; all zero stays so."""

    def of(s: Column) -> Column:
        return F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])

    raw = F.transform(q, lambda x: x.cast("double") / 127 * scale)
    return F.when(q.isNotNull(), let(raw, lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), of)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def unit_similarity(va: Column, vb: Column, ta: Column, tb: Column) -> Column:
    """Cosine of vectors of equal length, else the Jaccard similarity of the token sets."""
    both = va.isNotNull() & vb.isNotNull() & (F.size(va) == F.size(vb)) & (F.size(va) > 0)
    return F.when(both, cosine(va, vb)).otherwise(jaccard(F.array_distinct(ta), F.array_distinct(tb)))
