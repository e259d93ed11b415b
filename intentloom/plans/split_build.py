"""Few-shot split construction end to end.

canonical utterances -> label list (before dedup, as the reference) -> novel
label draw -> dedup (last label wins) -> one seeded rank per class -> all parts
and all K in one pass.  Shuffles: dedup by text (partial aggregate first), the
per-class rank (bucketed, skew-safe); the label tables are label-sized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from intentloom.functions.order import DEFAULT_SEED
from intentloom.operators import labels as L
from intentloom.operators import split as S
from intentloom.operators.joins import counted
from intentloom.session import materialize


def roles_of(utts: DataFrame, pct: int | None = 33, m: int | None = None,
             seed: int = DEFAULT_SEED) -> DataFrame:
    return L.choose_novel(L.distinct_labels(utts), pct=pct, m=m, seed=seed)


def build(utts: DataFrame, pct: int | None = 33, m: int | None = None, shots=(1, 5),
          num: int = 2, den: int = 3, seed: int = DEFAULT_SEED,
          materialized: bool = False, columns=None) -> tuple[DataFrame, DataFrame]:
    """Return ``(split, roles)``; ``split`` has columns
    uid, utterance, label, ord, role, part, k.

    ``materialized=True`` writes the split once to the shared checkpoint
    folder (for plans where several branches read it); ``columns`` keeps only
    those columns (e.g. no texts when only keys and labels are read)."""
    # the label table is counted once; that count bounds every label-sized
    # broadcast below (label ids, roles, labels x buckets) without more jobs
    roles, n_labels = counted(roles_of(utts, pct, m, seed))
    dedup = L.dedup_last_wins(utts, ids=L.label_ids(roles), n_labels=n_labels)
    sp = S.split_sets(dedup, roles, shots=shots, num=num, den=den, seed=seed, n_labels=n_labels)
    if columns is not None:
        sp = sp.select(*columns)
    return (materialize(sp) if materialized else sp), roles
