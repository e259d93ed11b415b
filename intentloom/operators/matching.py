"""Head/token matching of a pair of matrices, computed inside the row.

Each side is ``ARRAY<ARRAY<FLOAT>>`` (heads or tokens x d).  The pairwise
cosine matrix is computed once per pair (``with_alignment``), and every score
below reads it: attentive means, maxima and soft alignment are nested array
functions over that matrix and the transposed other side.  No explode, no
shuffle; the work is pairs x heads^2 x d.  Cosines divide by
``max(norm product, 1e-8)`` as the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentloom.functions import vectors as V

EPS = 1e-8


def _cos(a, b) -> Column:
    return V.let(a, lambda a: V.let(b, lambda b: V.safe_div(V.dot(a, b), V.norm(a) * V.norm(b), EPS)))


def _mean(arr) -> Column:
    return V.vsum(arr) / F.size(arr)


def with_norms(M) -> Column:
    """Rows of a matrix paired with their L2 norms (computed once per row)."""
    return F.transform(M, lambda r: F.struct(V.as_double(r).alias("v"), V.norm(r).alias("n")))


def cos_matrix_normed(An, Bn) -> Column:
    """att[i][j] from ``with_norms`` matrices: each norm is computed once, not
    once per pair of rows."""
    return F.transform(An, lambda a: F.transform(
        Bn, lambda b: V.safe_div(V.dot(a["v"], b["v"]), a["n"] * b["n"], EPS)))


def transpose(M) -> Column:
    """Columns of a rectangular matrix as rows."""
    first = F.element_at(M, 1)
    return F.transform(F.sequence(F.lit(1), F.size(first)),
                       lambda k: F.transform(M, lambda row: F.element_at(row, k).cast("double")))


def with_alignment(df: DataFrame, A: str = "A", B: str = "B") -> DataFrame:
    """Add ``att`` (cosine matrix A x B), ``attT`` and ``Bt`` (B transposed)."""
    df = df.withColumn("__An", with_norms(A)).withColumn("__Bn", with_norms(B))
    df = df.withColumn("att", cos_matrix_normed("__An", "__Bn")).drop("__An", "__Bn")
    return df.withColumn("attT", transpose("att")).withColumn("Bt", transpose(B))


def maxsim(att: str = "att") -> Column:
    """Mean over rows of the best cosine in the row (use ``attT`` for
    the other side's view)."""
    return _mean(F.transform(att, lambda r: F.array_max(r)))


def _seen(x, w) -> Column:
    """A vector under a perspective: weighted per dimension (no weights: as it is)."""
    return x if w is None else F.zip_with(x, w, lambda p, q: p.cast("double") * q)


def maxpool(A, B, w) -> Column:
    """X20 (max-pool, one perspective w): mean over i of the best cos(w * A_i, w * B_j)."""
    rows = lambda m: F.transform(m, lambda r: _seen(r, w))
    return V.let(with_norms(rows(B)), lambda bn: _mean(F.transform(cos_matrix_normed(with_norms(rows(A)), bn), F.array_max)))


def soft_align(A: str = "A", att: str = "att", Bt: str = "Bt", w=None) -> Column:
    """For each row A_i, the attentive mean of B
    (``sum_j att_ij B_j / max(sum_j att_ij, eps)``), compared with A_i by
    cosine; averaged over i.  ``w`` weighs both sides of the comparison (X20)."""
    # each attention row's sum is computed once, next to the row, not once
    # per output element
    z = F.arrays_zip(F.col(A).alias("a"), F.col(att).alias("r"), F.transform(att, lambda r: V.vsum(r)).alias("t"))

    def one(e):
        h = F.transform(Bt, lambda col: V.safe_div(V.dot(e["r"], col), e["t"], EPS))
        return _cos(_seen(e["a"], w), _seen(h, w))
    return V.vsum(F.transform(z, one)) / F.size(A)


def max_attentive(A: str = "A", att: str = "att", Bt: str = "Bt", w=None) -> Column:
    """X20 (max-attentive): per A_i the element-wise max over j of
    ``att_ij * B_j``, compared with A_i by cosine under the perspective w; averaged."""
    def one(a, r):
        m = F.transform(Bt, lambda col: F.array_max(F.zip_with(r, col, lambda t, x: t * x)))
        return _cos(_seen(a, w), _seen(m, w))
    return _mean(F.zip_with(A, att, one))


def headwise(A, B, w) -> Column:
    """X20 (head-wise, one perspective w): mean over heads i of
    cos(w * A_i, w * B_i) (diagonal only)."""
    return _mean(F.zip_with(A, B, lambda a, b: _cos(_seen(a, w), _seen(b, w))))


def row_sums(A) -> Column:
    """Sum of each row (the per-head mass the divergence compares)."""
    return F.transform(A, lambda a: V.vsum(a))


def kl_divergence(p_scores, q_scores) -> Column:
    """KL(p || q) with p = masked softmax of ``p_scores`` and
    log q = masked log-softmax of ``q_scores`` (mask = non-zero entries);
    0 * ln 0 counts as 0."""
    p = V.masked_softmax(p_scores, F.transform(p_scores, lambda x: (x != 0).cast("int")))
    lq = V.nonzero_log_softmax(q_scores)
    return V.vsum(F.zip_with(p, lq, lambda a, b: F.when(a > 0, a * (F.log(a) - b)).otherwise(F.lit(0.0))))
