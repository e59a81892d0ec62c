"""Native numeric column expressions: scaling, normalization, label lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .text import col_


def minmax(x, lo, hi, guard: bool = True) -> Column:
    """``(x - lo) / (hi - lo)``; 0 for a zero range when ``guard`` (the
    router variant has no guard, and yields NULL instead of raising)."""
    x, lo, hi = col_(x), col_(lo), col_(hi)
    scaled = F.try_divide((x - lo).cast("double"), (hi - lo).cast("double"))
    if not guard:
        return scaled
    return F.when(hi == lo, F.lit(0.0)).otherwise(scaled)


def normalize_metric(score, metric: str, lo, hi) -> Column:
    """rouge* scale linearly; bart, bleu, bert, bleurt, logprobs scale
    ``ln(x + s)`` with ``s = |min| + 1`` (``+ 2`` for bleu).  Zero range -> 0.0."""
    score, lo, hi = col_(score), col_(lo), col_(hi)
    if metric in config.LOG_METRICS:
        shift = F.abs(lo) + F.lit(2.0 if metric == "bleu" else 1.0)
        s, a, b = F.ln(score + shift), F.ln(lo + shift), F.ln(hi + shift)
        return F.when(a == b, F.lit(0.0)).otherwise((s - a) / (b - a))
    return F.when(hi == lo, F.lit(0.0)).otherwise((score - lo) / (hi - lo))


def pick_by_label(label, values) -> Column:
    """``values[label - 1]`` for a 1-based model label."""
    return F.element_at(F.array(*[col_(v) for v in values]), col_(label).cast("int"))


def compute_units(label) -> Column:
    """Label 1, 2, 3 -> 1.0, 3.12, 12.0 compute units."""
    return F.element_at(F.array(*[F.lit(float(u)) for u in config.COMPUTE_UNITS]), col_(label).cast("int"))


def argmax_label(*probs) -> Column:
    """1-based position of the first maximum."""
    arr = F.array(*[col_(p) for p in probs])
    return F.array_position(arr, F.array_max(arr)).cast("int")


def category_name(category_no) -> Column:
    """Category number -> name, unknown -> NULL."""
    m = F.create_map(*[x for k, v in config.CATEGORY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, col_(category_no).cast("int"))


def category_weight(category) -> Column:
    """Category name -> weight, unknown or NULL -> 0.03."""
    m = F.create_map(*[x for k, v in config.CATEGORY_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, col_(category)), F.lit(config.DEFAULT_CATEGORY_WEIGHT))
