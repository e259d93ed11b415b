"""Seeded, partition-independent random order.

Random order is ``md5(concat_ws('|', seed, salt, key...))`` with the key as the
tie-break.  The same text hashes to the same hex digest in any engine, so every
sample drawn with it can be replayed by plain SQL, and it does not change when
the data is repartitioned or a task is retried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 30


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seeded_key(*keys, salt: str, seed: int = DEFAULT_SEED) -> Column:
    """32-hex-digit order key for the given key columns."""
    parts = [F.lit(str(seed)), F.lit(salt)] + [_c(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(text_col, width_hex: int = 8) -> Column:
    """First ``width_hex`` hex digits of md5 as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(_c(text_col).cast("string")), 1, width_hex), 16, 10).cast("bigint")


def hex_to_int(hex_col, width_hex: int = 8) -> Column:
    """Integer value of the first ``width_hex`` digits of an existing hex key."""
    return F.conv(F.substring(_c(hex_col), 1, width_hex), 16, 10).cast("bigint")
