"""Embedding whitening by Jacobi-Davidson: leading components of a covariance that is never formed.

The data stay distributed.  The only operation on them is the centred product ``V B`` of the covariance with a few
columns: each task centres its rows, adds up ``X^T (X B)``, and the d rows of that are summed per dimension
with a map-side combine.  On the driver lie d x (a few times k) numbers, bounded by dimension and components.

* *Rayleigh-Ritz.*  The covariance restricted to the search space gives Ritz values and vectors, best first.
* *Locking.*  A Ritz pair whose residual is at double precision (``8 sqrt(d) eps`` times the largest value) is locked:
  it stays in the space, gets no further correction, and all others are corrected orthogonally to it.
* *Correction.*  For each open pair, ``(I-UU^T)(V - theta I)(I-UU^T) t = -r`` is solved roughly by MINRES.  The open
  pairs run their own MINRES side by side, so that a step is one pass over the data for all of them.  The
  corrections extend the space; it is restarted with its best Ritz vectors when it gets large.

The loop ends when every wanted pair is locked, or the space is the whole space (then Rayleigh-Ritz is exact).

Vectors are judged on a grid: ``x = floor(scale * c) + shift`` as long.  The fit list holds each distinct x vector once; n and the sums
S are exact, and rows are centred as ``(n x - S) / n`` from exact long differences.

Defined results: rows whose vector is null or holds null or non-finite entries drop out, as do vectors of another length than
most (ties: the longer) and empty ones; other nulls stay as they are; repeated rows are each returned; components whose value is
below 1e-11 of the largest count as no variance and are not returned (one row, equal rows: no components, no rows); a
component's largest entry is positive; equal values may give any basis of theirs; empty tables give no rows; extra columns play no
part.  ``deviation`` is exact; where it would not fit a long, OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentloom.llm.common import stored

_EPS = float(np.finfo(float).eps)
_LEAST = 1e-11  # values below this share of the largest are no variance
_ROWS = 4096  # rows centred at a time


def gridded(vector: Column, scale: float, shift: int) -> Column:
    """``floor(scale * c) + shift`` of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("long"))


def usable(vector: Column) -> Column:
    """No null vector, no null and no non-finite entry."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, d)


def _totals(d: int):
    """Rows of longs -> their number (index d) and the sum per dimension."""
    def run(batches):
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b.column("x"), d)
            n, total = n + len(x), [t + s for t, s in zip(total, x.sum(0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1)), pa.array([*total, n], pa.int64())], names=["i", "v"])
    return run


class Centred:
    """The centred rows of a fit list, as an operator: every method is one distributed pass."""

    def __init__(self, fit: DataFrame, d: int):
        self.fit, self.d = fit, d
        sums = {r.i: r.v for r in fit.mapInArrow(_totals(d), "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        self.n = sums.get(d, 0)
        self.sums = np.array([sums.get(i, 0) for i in range(d)], np.int64)

    def rows(self, b: pa.RecordBatch):
        """The centred rows of a batch, some at a time."""
        x = _matrix(b.column("x"), self.d)
        for i in range(0, len(x), _ROWS):
            yield (self.n * x[i:i + _ROWS] - self.sums) / self.n

    def _summed(self, height: int, width: int, part) -> np.ndarray:
        """The sum over all tasks of ``part(rows)``, a ``height`` x ``width`` matrix of doubles."""
        data = _Rows(self.n, self.sums, self.d)

        def run(batches):
            acc = np.zeros((height, width))
            for b in batches:
                for x in data.rows(b):
                    acc += part(x)
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int64()), *(pa.array(acc[:, j]) for j in range(width))], names=["i", *(f"v{j}" for j in range(width))])

        cols = [f"v{j}" for j in range(width)]
        out = np.zeros((height, width))
        for r in self.fit.mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in cols)).groupBy("i").agg(*(F.sum(c).alias(c) for c in cols)).collect():
            out[r.i] = r[1:]
        return out / self.n

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``block``."""
        return self._summed(self.d, block.shape[1], lambda x: x.T @ (x @ block))

    def variances(self) -> np.ndarray:
        return self._summed(self.d, 1, lambda x: np.square(x).sum(0)[:, None])[:, 0]

    def identity_error(self, to: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the rows' images under ``to``, minus the identity."""
        k = to.shape[1]
        mean = self._summed(k, 1, lambda x: (x @ to).sum(0)[:, None])[:, 0]
        return float(np.abs(self._summed(k, k, lambda x: (x @ to - mean).T @ (x @ to - mean)) - np.eye(k)).max())


class _Rows:
    """What a task needs to centre rows (and no session)."""

    rows = Centred.rows

    def __init__(self, n: int, sums: np.ndarray, d: int):
        self.n, self.sums, self.d = n, sums, d


def minres(product, rhs: np.ndarray, most: int, share: float) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, until each residual is ``share`` of its right side
    or after ``most`` steps.  ``product(block, columns)`` applies the systems of ``columns``, all in one call."""
    m = rhs.shape[1]
    phi = np.linalg.norm(rhs, axis=0)  # the residuals, signed
    goal = share * phi
    v = rhs / np.where(phi > 0, phi, 1)
    v_old, w, w_old, x = (np.zeros_like(rhs) for _ in range(4))
    beta, s, s_old, c, c_old = np.zeros(m), np.zeros(m), np.zeros(m), np.ones(m), np.ones(m)
    for _ in range(most):
        j = np.flatnonzero(np.abs(phi) > goal)
        if not len(j):
            break
        p = product(v[:, j], j)
        a = (v[:, j] * p).sum(0)
        p = p - v[:, j] * a - v_old[:, j] * beta[j]  # Lanczos
        b = np.linalg.norm(p, axis=0)
        far, near = s_old[j] * beta[j], c_old[j] * beta[j]  # the new column under the last two rotations
        over, pivot = c[j] * near + s[j] * a, c[j] * a - s[j] * near
        r = np.hypot(pivot, b)
        r = np.where(r > 0, r, np.inf)
        way = (v[:, j] - w_old[:, j] * far - w[:, j] * over) / r
        c_old[j], s_old[j], c[j], s[j] = c[j], s[j], pivot / r, b / r
        w_old[:, j], w[:, j] = w[:, j], way
        x[:, j] += way * (c[j] * phi[j])
        phi[j] *= -s[j]
        v_old[:, j], v[:, j], beta[j] = v[:, j], p / np.where(b > 0, b, 1), b
    return x


def _extend(space: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The columns of ``more``, made orthonormal to ``space`` and each other; those that lie within it go."""
    base = space
    for t in more.T:
        if base.shape[1] == len(base):
            break
        if size := np.linalg.norm(t):
            t = t / size
            for _ in range(3):
                t = t - base @ (base.T @ t)
            if (size := np.linalg.norm(t)) > 1e-10:
                t = t / size
                t = t - base @ (base.T @ t)
                base = np.column_stack([base, t / np.linalg.norm(t)])
    return base[:, space.shape[1]:]


def jacobi_davidson(product, d: int, k: int, spare: int = 16, inner: int = 12, share: float = 0.1, most: int = 200, seed: int = 13):
    """The ``k`` largest eigenvalues (falling) and unit eigenvectors of the symmetric ``product`` of size ``d``."""
    k, start = min(k, d), min(d, k + spare)
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, start)))[0]
    image = product(space)
    for _ in range(most):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        u, au = space @ turn[:, :k], image @ turn[:, :k]
        residual = au - u * theta[:k]
        open_ = np.flatnonzero(np.linalg.norm(residual, axis=0) > 8 * np.sqrt(d) * _EPS * max(theta[0], 0))
        if not len(open_) or space.shape[1] == d:
            return theta[:k], u
        outside = lambda t: t - u @ (u.T @ t)  # noqa: E731, B023
        shifted = lambda t, j: outside(product(outside(t)) - t * theta[open_[j]])  # noqa: E731, B023
        more = minres(shifted, -outside(residual[:, open_]), inner, share)
        if space.shape[1] + more.shape[1] > start + 2 * k:
            space, image = space @ turn[:, :start], image @ turn[:, :start]
        more = _extend(space, outside(more))
        if not more.shape[1]:  # corrections vanish only at the limit of the arithmetic
            return theta[:k], u
        space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])
    raise RuntimeError("residuals did not reach double precision")


def _project(n: int, sums: np.ndarray, to: np.ndarray, d: int):
    """Rows of x vectors -> their deviation and images, as one array per row."""
    data = _Rows(n, sums, d)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), d)
            far = np.abs(n * x - sums).max(1, initial=0).astype(float)
            if len(x) and float(far.max()) ** 2 * d < 2.0 ** 62:
                deviation = pa.array(np.square(n * x - sums).sum(1))
            else:  # exact by Python's integers
                deviation = pa.array([sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x], pa.int64())
            image = np.concatenate([c @ to for c in data.rows(b)]) if len(x) else np.zeros((0, to.shape[1]))
            image = pa.FixedSizeListArray.from_arrays(pa.array(image.ravel()), to.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, image], names=["vec_id", "deviation", "image"])
    return run


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64, shift: int = 1_000_000) -> DataFrame:
    """Per usable row of ``vectors(vec_id, embedding)`` and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable(F.col("embedding")))
    rows = rows.select("vec_id", gridded(F.col("embedding"), scale, shift).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    rows = rows.filter(F.size("x") == d)
    centred = Centred(stored(rows.select("x").distinct(), "fit-list"), d)
    value, vector = jacobi_davidson(centred.product, d, components)
    some = value > _LEAST * max(value[0], 0)
    if not some.any() or value[0] <= 0:
        return spark.createDataFrame([], schema)
    value, vector = value[some], vector[:, some]
    vector = vector * np.where(np.take_along_axis(vector, np.abs(vector).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
    to = vector / np.sqrt(value)
    explained, error = value / centred.variances().sum(), centred.identity_error(to)
    image = rows.mapInArrow(_project(centred.n, centred.sums, to, d), "vec_id long, deviation long, image array<double>")
    per = F.arrays_zip(F.col("image").alias("w"), F.lit([float(e) for e in explained]).alias("e"))
    return image.select("vec_id", "deviation", F.posexplode(per).alias("i", "c")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(centred.n).cast("long").alias("n"), "deviation",
        F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), F.lit(error).alias("identity_error"))
