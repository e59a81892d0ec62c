"""Routers and their evaluation.

A routed table has ``evaluation_model_label`` (ground truth), ``routed_to``
and the three ``avg_normalized_score_t5_*`` columns.  ``scorecard`` turns
any number of routed grid cells into one metrics row per cell with a single
``groupBy(grid keys)`` of algebraic aggregates; compute units come from the
routed counts (``n_base * 1.0 + n_large * 3.12 + n_xl * 12.0``), so they do
not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import argmax_label, pick_by_label
from . import rowindex

SCORE_COLS = [f"avg_normalized_score_{m}" for m in config.MODELS]
PROBA_COLS = ["proba_base", "proba_large", "proba_xl"]


def route_constant(df: DataFrame, label: int) -> DataFrame:
    """Q1 (always XL = 3) and Q2 (always base = 1)."""
    return df.withColumn("routed_to", F.lit(int(label)))


def route_by_thresholds(column, low, high) -> Column:
    """Q3/Q4: ``> high`` -> 3, ``> low`` -> 2, else 1."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c > F.lit(high), F.lit(3)).when(c > F.lit(low), F.lit(2)).otherwise(F.lit(1))


def route_by_quantiles(df: DataFrame, column: str, settings=config.QUANTILE_SETTINGS,
                       thresholds_from: DataFrame | None = None) -> DataFrame:
    """Q3 (length) / Q4 (complexity) over the quantile grid: one row per
    (query, setting); thresholds are exact quantiles of ``thresholds_from``
    (default ``df``), a handful of scalars."""
    src = thresholds_from if thresholds_from is not None else df
    qv = rowindex.exact_quantiles(src, column, sorted({q for s in settings for q in s[:2]}))
    cells = []
    for lo_q, mid_q, hi_q in settings:
        lo, hi = qv[lo_q], qv[mid_q]
        cells.append(F.struct(F.lit(f"{round(lo_q * 100)}-{round(mid_q * 100)}-{round(hi_q * 100)}").alias("setting"),
                              F.lit(float(lo)).alias("low_threshold"), F.lit(float(hi)).alias("high_threshold")))
    g = df.select("*", F.inline(F.array(*cells)))
    return g.withColumn("routed_to", route_by_thresholds(column, F.col("low_threshold"), F.col("high_threshold")))


def route_by_confidence(probs=PROBA_COLS, threshold=None) -> Column:
    """Q5: arg-max label (first maximum, R4) when ``max(p) >= threshold``, else XL."""
    p = [F.col(c) for c in probs]
    t = F.col("prob_threshold") if threshold is None else F.lit(float(threshold))
    return F.when(F.greatest(*p) < t, F.lit(3)).otherwise(argmax_label(*p))


def with_confidence_grid(df: DataFrame, thresholds=config.PROBABILITY_THRESHOLDS) -> DataFrame:
    """F7 (probability axis): fan each row out over the thresholds (generator) and route."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    return df.withColumn("prob_threshold", F.explode(grid)).withColumn("routed_to", route_by_confidence())


def join_predictions(test: DataFrame, predictions: DataFrame, key="id") -> DataFrame:
    """Left join test rows with predictions.  Call ``unmatched_predictions``
    to get the rows without a prediction (the study's post-merge guard)."""
    return test.join(predictions, key, "left")


def unmatched_predictions(test: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    return test.join(predictions.select(key), key, "left_anti")


def _sums(label, routed, n, score_gt, score_router, score_xl) -> dict:
    """Aggregates of a scorecard; every row stands for ``n`` queries with the given score sums."""
    at = lambda c, v: F.sum(F.when(c == v, n).otherwise(F.lit(0)))
    return {"n": F.sum(n), "n_base": at(routed, 1), "n_large": at(routed, 2), "n_xl": at(routed, 3),
            "gt_base": at(label, 1), "gt_large": at(label, 2), "gt_xl": at(label, 3),
            "n_correct": F.sum(F.when(label == routed, n).otherwise(F.lit(0))),
            "_s_gt": F.sum(score_gt), "_s_router": F.sum(score_router), "_s_xl": F.sum(score_xl)}


def _metrics(sums: DataFrame, keys) -> DataFrame:
    u = config.COMPUTE_UNITS
    n = F.col("n").cast("double")
    avg_gt, avg_r, avg_xl = F.col("_s_gt") / n, F.col("_s_router") / n, F.col("_s_xl") / n
    cu_router = F.col("n_base") * F.lit(u[0]) + F.col("n_large") * F.lit(u[1]) + F.col("n_xl") * F.lit(u[2])
    cu_gt = F.col("gt_base") * F.lit(u[0]) + F.col("gt_large") * F.lit(u[1]) + F.col("gt_xl") * F.lit(u[2])
    cu_xl = n * F.lit(u[2])
    return sums.select(
        *keys, F.col("n").cast("bigint").alias("n"),
        F.col("n_base").cast("bigint").alias("n_base"), F.col("n_large").cast("bigint").alias("n_large"),
        F.col("n_xl").cast("bigint").alias("n_xl"),
        (F.col("n_correct") / n * F.lit(100.0)).alias("routing_accuracy"),
        (F.try_divide(avg_r - avg_gt, avg_gt) * F.lit(100.0)).alias("quality_loss_gt"),
        (F.try_divide(avg_r - avg_xl, avg_xl) * F.lit(100.0)).alias("quality_loss_xl"),
        cu_router.alias("compute_units"),
        (F.try_divide(cu_gt - cu_router, cu_gt) * F.lit(100.0)).alias("compute_savings_gt"),
        (F.try_divide(cu_xl - cu_router, cu_xl) * F.lit(100.0)).alias("compute_savings_xl"))


def scorecard(routed: DataFrame, keys=(), label: str = "evaluation_model_label", routed_col: str = "routed_to",
              score_cols=SCORE_COLS) -> DataFrame:
    """E6 = D9 + E1 + E2 + E3 per grid cell (``keys``)."""
    y, r = F.col(label), F.col(routed_col)
    sums = _sums(y, r, F.lit(1), pick_by_label(y, score_cols), pick_by_label(r, score_cols), F.col(score_cols[2]))
    return _metrics(routed.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()]), list(keys))


def confidence_scorecard(df: DataFrame, keys=(), thresholds=config.PROBABILITY_THRESHOLDS, label: str = "evaluation_model_label",
                         probs=PROBA_COLS, score_cols=SCORE_COLS) -> DataFrame:
    """the scorecard of ``keys`` x ``thresholds`` from one row per query and key.

    One aggregate by (keys, arg-max, label, probability bucket) counts queries and
    sums scores; a bucket is the number of thresholds that the largest
    probability reaches, so the cuts are exact.  Every grid cell then sums
    a few of those rows (at most 11 x 9 per key)."""
    cuts = sorted(float(t) for t in thresholds)
    p = [F.col(c) for c in probs]
    top = F.greatest(*p)
    reach = F.coalesce(sum((F.when(top >= F.lit(t), 1).otherwise(0) for t in cuts), F.lit(0)), F.lit(0))
    y, a, xl = F.col(label), F.col("_argmax"), F.col(score_cols[2])
    cells = (df.withColumn("_argmax", argmax_label(*p)).groupBy(*keys, "_argmax", label, reach.alias("_reach"))
             .agg(F.count(F.lit(1)).alias("_n"), F.sum(pick_by_label(y, score_cols)).alias("_gt"),
                  F.sum(pick_by_label(a, score_cols)).alias("_top"), F.sum(xl).alias("_xl")))
    grid = F.array(*[F.struct(F.lit(t).alias("prob_threshold"), F.lit(i + 1).alias("_needs")) for i, t in enumerate(cuts)])
    g = cells.select("*", F.inline(grid))
    sure = F.col("_reach") >= F.col("_needs")
    routed = F.when(sure, a).otherwise(F.lit(3))
    sums = _sums(y, routed, F.col("_n"), F.col("_gt"), F.when(sure, F.col("_top")).otherwise(F.col("_xl")), F.col("_xl"))
    return _metrics(g.groupBy(*keys, "prob_threshold").agg(*[v.alias(k) for k, v in sums.items()]), [*keys, "prob_threshold"])


def classification_report(df: DataFrame, keys=(), label: str = "evaluation_model_label",
                          pred: str = "routed_to", name=lambda c: c.cast("string")) -> DataFrame:
    """Precision, recall, F1 and support per class over the union of true
    and predicted labels (0 on zero division), plus macro / weighted averages
    and accuracy rows (``class`` = 'macro avg' / 'weighted avg' / 'accuracy').

    One pass: each row contributes to its true class and its predicted class;
    the few class rows of a key become an array (bounded by the label set) from
    which class and summary rows are written together."""
    y, p = F.col(label), F.col(pred)
    both = F.array(F.struct(y.alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.coalesce((y == p).cast("int"), F.lit(0)).alias("tp")),
                   F.struct(p.cast(df.schema[label].dataType).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))
    per = (df.select(*keys, F.inline(both)).where(F.col("cls").isNotNull()).groupBy(*keys, "cls")
             .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp")))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumns({"precision": prec, "recall": rec})
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      F.lit(2.0) * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    support = F.col("support").cast("bigint")
    n = F.sum("support").cast("double")

    def line(kind, precision, recall, f1):
        none = F.lit(None).cast("double")
        return F.struct(F.lit(kind).alias("class"), F.coalesce(precision, none).alias("precision"), F.coalesce(recall, none).alias("recall"),
                        f1.alias("f1"), F.sum("support").cast("bigint").alias("support"))

    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / n
    rows = F.concat(
        F.collect_list(F.struct(name(F.col("cls")).alias("class"), "precision", "recall", "f1", support.alias("support"))),
        F.array(line("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
                line("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
                line("accuracy", F.lit(None), F.lit(None), F.sum("tp") / n)))
    return per.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.inline("_rows"))


def regression_metrics(df: DataFrame, y: str, p: str, keys=()) -> DataFrame:
    """E5: MSE, MAE and R^2 (``1 - SSE / SST``, SST from sums, one pass)."""
    e = F.col(y) - F.col(p)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                              F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_var"))
    return g.select(*keys, "mse", "mae",
                    (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))).alias("r2"))


def avg_max_probability(df: DataFrame, probs=PROBA_COLS, keys=()) -> DataFrame:
    """Mean of the row-wise maximum probability."""
    return df.groupBy(*keys).agg(F.avg(F.greatest(*[F.col(c) for c in probs])).alias("avg_max_proba"))
