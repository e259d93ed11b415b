"""Vector math on ARRAY columns, kept in the JVM with higher-order functions.

Vectors arrive as ARRAY<FLOAT>; everything is computed in DOUBLE.  Division
never raises under ANSI mode: a zero divisor gives NULL (``try_divide``) or the
reference's floor of 1e-8 (``safe_div``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def vsum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(vsum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when either vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sq_dist(a, b, w=None) -> Column:
    """Squared Euclidean distance, optionally weighted per dimension."""
    if w is None:
        return vsum(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)))
    z = F.arrays_zip(_c(a).alias("x"), _c(b).alias("y"), _c(w).alias("w"))
    return vsum(F.transform(z, lambda s: s["w"].cast("double") * F.pow(s["x"].cast("double") - s["y"].cast("double"), 2)))


def l2_dist(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def safe_div(n, d, eps: float = 1e-8) -> Column:
    """n / d with any d <= eps replaced by eps."""
    d = _c(d)
    return _c(n) / F.when(d > F.lit(eps), d).otherwise(F.lit(eps))


def vscale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x.cast("double") * s)


def let(value, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: inside a lambda over an array, an
    expression of the row would be computed again for every entry."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(a) -> Column:
    """Numerically stable softmax of an array."""
    e = let(as_double(a), lambda a: let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m))))
    return let(e, lambda e: let(vsum(e), lambda s: F.transform(e, lambda x: x / s)))


def masked_softmax(a, mask) -> Column:
    """Softmax over entries whose mask is non-zero; an all-zero mask gives zeros.

    Masked entries are zeroed before the max is taken, as in the reference.
    """
    mask = as_double(mask)
    mv = F.zip_with(as_double(a), mask, lambda x, m: x * m)
    ex = let(mv, lambda mv: let(F.array_max(mv), lambda top: F.zip_with(mv, mask, lambda x, m: F.exp(x - top) * m)))
    return let(ex, lambda ex: let(vsum(ex), lambda s: F.transform(ex, lambda x: x / F.when(s == 0, F.lit(1.0)).otherwise(s))))


def log_softmax(a) -> Column:
    def of(a):
        lse = let(F.array_max(a), lambda m: m + F.log(vsum(F.transform(a, lambda x: F.exp(x - m)))))
        return let(lse, lambda z: F.transform(a, lambda x: x - z))
    return let(as_double(a), of)


def nonzero_log_softmax(a) -> Column:
    """Log-softmax over the non-zero entries; zero entries get -inf-like NULL-free
    values of ``ln(1e-45)`` added first, as the reference's masked form."""
    a = as_double(a)
    shifted = F.transform(a, lambda x: F.when(x != 0, x).otherwise(x + F.log(F.lit(1e-45))))
    return log_softmax(shifted)


def one_hot(y, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == _c(y)).cast("int"))


def fuse(a, b) -> Column:
    """[a; b; |a-b|; a*b].  A cast of arrays that hold doubles already costs nothing."""
    a, b = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))
