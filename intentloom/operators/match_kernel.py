"""Head/token matching as a batch kernel: the scores of ``matching`` (X18, X19, X20) from batched matrix products.

The matrices of an Arrow batch lie flat in memory; pairs of one shape are taken together, their cosine matrices
are one batched product, and every score is an array operation over the batch.  Results are those of the column
expressions in ``matching`` (which stay for plans that must not leave the JVM), at many times their speed.  A task holds one
Arrow batch and works on at most ``_CHUNK`` bytes of it at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

EPS = 1e-8
_CHUNK = 8 << 20


def _over(x, d):
    """x / d, with divisors of EPS or less replaced by EPS."""
    return x / np.where(d > EPS, d, EPS)


def _cosines(a, b):
    """Cosines of all rows: (n, r, d) x (n, s, d) -> (n, r, s)."""
    na, nb = np.linalg.norm(a, axis=2), np.linalg.norm(b, axis=2)
    return _over(a @ b.transpose(0, 2, 1), na[:, :, None] * nb[:, None, :])


def _alike(a, b):
    """Cosines row by row: (n, r, d) x (n, r, d) -> (n, r)."""
    return _over((a * b).sum(2), np.linalg.norm(a, axis=2) * np.linalg.norm(b, axis=2))


def _maxsim_s(a, b, att, w):
    return att.max(2).mean(1)


def _maxsim_q(a, b, att, w):
    return att.max(1).mean(1)


def _maxpool(a, b, att, w):
    return _cosines(a * w, b * w).max(2).mean(1)


def _headwise(a, b, att, w):
    return _alike(a * w, b * w).mean(1)


def _soft_align(a, b, att, w):
    return _alike(a * w, _over(att @ b, att.sum(2)[:, :, None]) * w).mean(1)


def _max_attentive(a, b, att, w):
    best = att[:, :, 0, None] * b[:, None, 0, :]
    for j in range(1, b.shape[1]):
        np.maximum(best, att[:, :, j, None] * b[:, None, j, :], out=best)
    return _alike(a * w, best * w).mean(1)


SCORES = {"maxsim_s": _maxsim_s, "maxsim_q": _maxsim_q, "maxpool": _maxpool, "headwise": _headwise, "soft_align": _soft_align, "max_attentive": _max_attentive}


def _flat(col: pa.Array):
    """``(values, rows per matrix, values per matrix, where each matrix begins)`` of a column of matrices."""
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    at = np.asarray(col.offsets, np.int64)
    inner = col.values
    cells = np.asarray(inner.offsets, np.int64)
    begin, end = cells[at[:-1]], cells[at[1:]]
    return inner.values.to_numpy(zero_copy_only=False), np.where(valid, np.diff(at), 0), end - begin, begin


def match_scores(pairs: DataFrame, keys: Sequence[str], scores: dict[str, tuple], a: str = "A", b: str = "B") -> DataFrame:
    """``keys`` and one column per entry ``name: (score, weights)`` of ``scores``, a score of ``SCORES`` for each pair of
    matrices; ``weights`` (None: ones) see every dimension of both sides.  Null and empty matrices, and pairs whose widths
    differ, have null scores; headwise scores need equally many rows."""
    schema = T.StructType([pairs.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in scores])

    def run(batches):
        for batch in batches:
            av, ar, an, a0 = _flat(batch.column(a))
            bv, br, bn, b0 = _flat(batch.column(b))
            out = {n: np.full(batch.num_rows, np.nan) for n in scores}
            shapes = np.stack([ar, an, br, bn], 1)
            for ra, na, rb, nb in np.unique(shapes, axis=0).tolist():
                if not (ra and rb and na and na % ra == 0 and nb % rb == 0 and na // ra == nb // rb):
                    continue
                d, rows = na // ra, np.flatnonzero((shapes == (ra, na, rb, nb)).all(1))
                step = max(1, _CHUNK // (8 * d * max(ra, rb) * 4))
                for i in range(0, len(rows), step):
                    some = rows[i:i + step]
                    x = av[a0[some][:, None] + np.arange(na)].astype(float).reshape(-1, ra, d)
                    y = bv[b0[some][:, None] + np.arange(nb)].astype(float).reshape(-1, rb, d)
                    att = _cosines(x, y)
                    for name, (score, weights) in scores.items():
                        if score != "headwise" or ra == rb:
                            out[name][some] = SCORES[score](x, y, att, 1.0 if weights is None else np.asarray(weights, float))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(v, mask=np.isnan(v)) for v in out.values())], names=[*keys, *scores])

    return pairs.select(*keys, a, b).mapInArrow(run, schema)
