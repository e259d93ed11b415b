"""Text and token-sequence expressions (built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intentloom.functions.order import hash_int

# Special token ids of the BERT-style vocabulary the reference's
# encoders use ([PAD]=0, [UNK]=100, [CLS]=101, [SEP]=102).
PAD_ID = 0
UNK_ID = 100
CLS_ID = 101
SEP_ID = 102
# Hashed word ids start after the special ids.
HASH_ID_BASE = 1000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_label(label) -> Column:
    """'+' and '_' become blanks (label names shown to an encoder)."""
    return F.translate(_c(label), "+_", "  ")


def strip(text) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def blank_tokens(text) -> Column:
    """Strip, then split on single blanks; doubled blanks give empty tokens."""
    return F.split(strip(text), " ")


def token_count(text) -> Column:
    return F.size(blank_tokens(text))


def hashed_ids(tokens, vocab: int = 30000) -> Column:
    """Stable word ids without a vocabulary table: HASH_ID_BASE + md5 bucket."""
    return F.transform(_c(tokens), lambda t: (F.lit(HASH_ID_BASE) + hash_int(t) % F.lit(vocab)).cast("int"))


def pad_cut(ids, n: int, value: int = 0) -> Column:
    """Post-pad with ``value`` or cut to exactly ``n`` entries."""
    return F.slice(F.concat(_c(ids), F.array_repeat(F.lit(value).cast("int"), n)), 1, n)


def attention_mask(ids) -> Column:
    return F.transform(_c(ids), lambda x: (x > 0).cast("int"))


def pair_encode(sent_ids, label_ids, max_len: int = 64,
                cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """``[CLS] sentence [SEP] label [SEP]`` cut/padded to max_len.

    The sentence is cut at its end so both parts fit
    (``keep = max_len - 3 - len(label)``, floored at 0).  Returns a struct of
    input_ids, token_type_ids (0 for the sentence part, 1 after, padded with 1),
    mask and the unpadded length.
    """
    s, lab = _c(sent_ids), _c(label_ids)
    keep = F.greatest(F.lit(max_len - 3) - F.size(lab), F.lit(0))
    s_cut = F.when(F.size(s) + F.size(lab) > F.lit(max_len - 3), F.slice(s, 1, keep)).otherwise(s)
    full = F.concat(F.array(F.lit(cls_id)), s_cut, F.array(F.lit(sep_id)), lab, F.array(F.lit(sep_id)))
    types = F.concat(F.array_repeat(F.lit(0), F.size(s_cut) + 2), F.array_repeat(F.lit(1), F.size(lab) + 1))
    ids = pad_cut(full, max_len, 0)
    return F.struct(
        ids.alias("input_ids"),
        pad_cut(types, max_len, 1).alias("token_type_ids"),
        attention_mask(ids).alias("mask"),
        F.least(F.size(full), F.lit(max_len)).alias("len"),
    )


def tail_encode(ids, max_len: int = 48, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """Single-sentence encoding that keeps the *last* tokens.

    Keeps the last ``max_len - 2`` ids and wraps them in [CLS] ... [SEP], so the
    closing marker is never cut off, then pads to max_len.
    """
    a = _c(ids)
    n = F.lit(max_len - 2)
    tail = F.when(F.size(a) > n, F.slice(a, -(max_len - 2), max_len - 2)).otherwise(a)
    full = F.concat(F.array(F.lit(cls_id)), tail, F.array(F.lit(sep_id)))
    return pad_cut(full, max_len, 0)
