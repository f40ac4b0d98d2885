"""Column expressions over ``array<double>`` vectors (JVM-side, no Python).

These are the SQL-visible forms of normalise / dot / cosine.  They are used
where pairs already exist as rows (candidate pairs, fused vectors); the
all-pairs search uses the blocked numpy scorer in ``operators.score``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Norm floor of the L2 normalisation: a zero vector becomes a zero vector and
# scores 0 instead of NaN.
NORM_EPS = 1e-12
# Binary digits of a score that count for its rank (about 12 decimal digits).
KEY_BITS = 40


def as_double_array(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; arrays of unequal length fail (zip pads with null)."""
    a, b = as_double_array(a), as_double_array(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2norm(a: Column | str) -> Column:
    a = as_double_array(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def normalize(a: Column | str) -> Column:
    """V1: ``x / max(||x||, 1e-12)`` element-wise."""
    a = as_double_array(a)
    n = F.greatest(l2norm(a), F.lit(NORM_EPS))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    """V2 with ``do_norm=True``: dot of the clamped-normalised vectors."""
    return dot(a, b) / (F.greatest(l2norm(a), F.lit(NORM_EPS)) * F.greatest(l2norm(b), F.lit(NORM_EPS)))


def similarity(a: Column | str, b: Column | str, do_norm: bool = True) -> Column:
    """V2 + V3: cosine (or plain dot) with NaN mapped to -1."""
    s = cosine(a, b) if do_norm else dot(a, b)
    return nan_to_minus_one(s)


def nan_to_minus_one(score: Column) -> Column:
    """V3: a NaN score ranks as -1 (Spark would otherwise sort NaN above all)."""
    return F.nanvl(score, F.lit(-1.0))


def sort_key(score: Column | str) -> Column:
    """Score to rank by: rounded to ``KEY_BITS`` binary digits of its own magnitude.

    Equal vectors then tie whatever order their products were summed in, and
    products of any scale keep their order.
    """
    s = F.col(score) if isinstance(score, str) else score
    exponent = F.greatest(F.floor(F.log2(F.abs(s))), F.lit(-900))
    scale = F.pow(F.lit(2.0), F.lit(KEY_BITS) - exponent)
    return F.when(s == 0, F.lit(0.0)).when(F.abs(s) == F.lit(float("inf")), s).otherwise(F.rint(s * scale) / scale)


def vector_add(a: Column | str, b: Column | str) -> Column:
    """V5: element-wise sum (late fusion)."""
    return F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x + y)
