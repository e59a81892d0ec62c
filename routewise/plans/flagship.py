"""Flagship plan: the confidence-routing sweep of the performance-based router.

documents -> queries -> features + complexity (S1-S10)           (per row)
fx_label_input -> wide per query -> discrepancies (S17)           (groupBy id)
join on id (narrow rows)
B6 exact 80th-percentile filter, B7 ordered 90/10 split            (order statistics)
L2 labels for 7 discrepancy thresholds (generator, one pass)
C5 join each threshold's own router probabilities by (id, threshold)
F7 / E6 one aggregate by (threshold, arg-max, label, probability bucket), then 70 cells
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import category_weight
from ..operators import features as FT
from ..operators import labels as LB
from ..operators import routing as RT
from ..operators import rowindex as RI
from ..operators.scores import with_discrepancies
from ..session import materialize
from ..sources import fixtures as FX

LABEL_VALUES = ["avg_normalized_score", "trash_count", "query_repetition_count", "rt_avg", "length_avg"]


def label_inputs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = LB.to_wide(FX.fx_label_input(spark, sf_dir), LABEL_VALUES)
    return with_discrepancies(wide)


def router_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query: complexity, query length and the wide label inputs."""
    feats = FT.query_feature_table(FX.fx_queries(spark, sf_dir), FX.KEYWORDS).select(
        "id", "doc_id", "query_chars_count", "query_complexity_score")
    return feats.join(label_inputs_wide(spark, sf_dir), "id")


def split_marks(spark: SparkSession, sf_dir: str, cfg: config.SplitConfig = config.SplitConfig()) -> DataFrame:
    """The router base with ``is_kept`` (complexity filter) and ``is_train`` (ordered split of the kept rows)."""
    base = RI.with_place(router_base(spark, sf_dir))
    top = RI.exact_quantile(base, "query_complexity_score", cfg.exclude_percentile / 100.0)
    kept = F.col("query_complexity_score") <= F.lit(top)
    filtered = base.where(kept)
    k = RI.python_round(filtered.count() * cfg.train_ratio)
    train = RI.among_first(filtered, "doc_id", [k])[k]
    return base.withColumns({"is_kept": F.coalesce(kept, F.lit(False)), "is_train": F.coalesce(kept, F.lit(False)) & train}).drop(RI.PLACE)


def test_split(spark: SparkSession, sf_dir: str, cfg: config.SplitConfig = config.SplitConfig()):
    """(filtered, train, test) after the complexity filter and the ordered split."""
    marked = split_marks(spark, sf_dir, cfg)
    filtered = marked.where("is_kept")
    return (filtered.drop("is_kept", "is_train"), filtered.where("is_train").drop("is_kept", "is_train"),
            filtered.where("NOT is_train").drop("is_kept", "is_train"))


def calculated_complexity(spark: SparkSession, sf_dir: str, predicted: DataFrame | None = None) -> DataFrame:
    """Complexity of the test rows scaled by the train rows' ranges (a zero range scales to 0, as in
    Step 6): ``id, query_complexity_score, calculated_complexity_score``.  The category of the test
    rows is given, or ``predicted(id, predicted_category)``; its weight follows from it."""
    _, train, test = test_split(spark, sf_dir)
    # written once: both sides of the split read them, and the texts would be read again for each
    feats = materialize(FT.with_category(FT.with_query_features(FT.with_query(FX.fx_queries(spark, sf_dir)), FX.KEYWORDS)).select(
        "id", "category", *FT.FEATURES))
    tr = materialize(feats.join(train.select("id"), "id"))
    te = feats.join(test.select("id", "query_complexity_score"), "id")
    if predicted is not None:
        te = te.join(predicted, "id").withColumn("category", F.col("predicted_category"))
        te = te.withColumn("category_weight", category_weight("category"))
    return FT.with_complexity(te, stats_from=tr, name="calculated_complexity_score").select(
        "id", "query_complexity_score", "calculated_complexity_score")


def routing_sweep(spark: SparkSession, sf_dir: str, cfg: config.SweepConfig = config.SweepConfig()) -> DataFrame:
    _, _, test = test_split(spark, sf_dir, cfg.split)
    return sweep(test, FX.fx_proba(spark, sf_dir), cfg)


def sweep(test: DataFrame, predictions: DataFrame, cfg: config.SweepConfig = config.SweepConfig()) -> DataFrame:
    """The 7 x 10 grid over test rows and ``predictions(id, t_threshold, proba_*)``."""
    labelled = LB.with_label_sweep(test, cfg.discrepancy_thresholds)
    joined = RT.join_predictions(labelled, predictions.select("id", "t_threshold", *RT.PROBA_COLS), ["id", "t_threshold"])
    card = RT.confidence_scorecard(joined, ("t_threshold",), cfg.probability_thresholds)
    return card.select("t_threshold", "prob_threshold", "n", "n_base", "n_large", "n_xl",
                       *[F.round(c, 6).alias(c) for c in ("routing_accuracy", "quality_loss_gt", "quality_loss_xl",
                                                          "compute_units", "compute_savings_gt", "compute_savings_xl")])
