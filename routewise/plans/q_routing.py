"""Queries for filters, splits, routers and their evaluation
(B6, B7, B11, B12, C5, D2, D9-D11, Q1-Q6, E1-E6, F7, F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import argmax_label, compute_units, pick_by_label
from ..operators import features as FT
from ..operators import labels as LB
from ..operators import routing as RT
from ..operators import rowindex as RI
from ..sources import fixtures as FX
from . import sqlfrag as Q
from .catalog import register
from .flagship import calculated_complexity, routing_sweep, split_marks, test_split

_BASE = (Q.FIXTURE_SQL.rstrip() + Q.QUERY_FEATURES_CTE + Q.label_wide_cte() + """,
base AS (SELECT fc.id, fc.doc_id, fc.query_chars_count, fc.query_complexity_score, lw.* EXCLUDE (id)
         FROM fc JOIN lw USING (id))""" + Q.split_ctes())
_P_ROWS = [f"({p!r}e0)" for p in config.PROBABILITY_THRESHOLDS]
_TEST0 = f""",
test0 AS (SELECT *, {Q.label_number()}::INTEGER AS evaluation_model_label
          FROM (SELECT test.*, {Q.label_case('0e0')} AS label_case FROM test) z)"""
_SWEEP = _BASE + ",\n" + Q.grid_values("dtg", "t_threshold, dt", Q.DT_ROWS) + ",\n" + Q.grid_values(
    "pg", "prob_threshold", _P_ROWS) + f""",
lab AS (SELECT *, {Q.label_number()}::INTEGER AS evaluation_model_label
        FROM (SELECT test.*, dtg.*, {Q.label_case('dt')} AS label_case FROM test CROSS JOIN dtg) z),
pj AS (SELECT lab.*, p.proba_base, p.proba_large, p.proba_xl FROM lab LEFT JOIN fx_proba p USING (id, t_threshold)),
routed AS (SELECT pj.*, pg.prob_threshold,
             CASE WHEN greatest(proba_base, proba_large, proba_xl) < prob_threshold THEN 3 ELSE {Q.ARGMAX} END AS routed_to
           FROM pj CROSS JOIN pg)
"""


def _r6(c):
    return F.round(c, 6).alias(c)


def _test0(spark, sf_dir):
    _, _, test = test_split(spark, sf_dir)
    return LB.with_label(test, 0.0)


def _proba0(spark, sf_dir):
    """The predictions trained for discrepancy threshold 0."""
    return FX.fx_proba(spark, sf_dir).where("t_threshold = 't0'").select("id", *RT.PROBA_COLS)


@register("F7_confidence_sweep", sql=_SWEEP + Q.scorecard("routed", ("t_threshold", "prob_threshold")))
def f7(spark, sf_dir):
    return routing_sweep(spark, sf_dir)


@register("F8_sweep_table", sql=_SWEEP + f"""
SELECT t_threshold, prob_threshold, quality_loss_gt, quality_loss_xl, compute_savings_gt, compute_savings_xl,
       routing_accuracy FROM ({Q.scorecard("routed", ("t_threshold", "prob_threshold"))}) s""")
def f8(spark, sf_dir):
    return routing_sweep(spark, sf_dir).select("t_threshold", "prob_threshold", "quality_loss_gt", "quality_loss_xl",
                                               "compute_savings_gt", "compute_savings_xl", "routing_accuracy")


@register("D9_routed_counts", sql=_SWEEP + f"""
SELECT t_threshold, prob_threshold, n_base, n_large, n_xl FROM ({Q.scorecard("routed", ("t_threshold", "prob_threshold"))}) s""")
def d9(spark, sf_dir):
    return routing_sweep(spark, sf_dir).select("t_threshold", "prob_threshold", "n_base", "n_large", "n_xl")


@register("E1_routing_accuracy", sql=_SWEEP + f"""
SELECT t_threshold, prob_threshold, routing_accuracy FROM ({Q.scorecard("routed", ("t_threshold", "prob_threshold"))}) s""")
def e1(spark, sf_dir):
    return routing_sweep(spark, sf_dir).select("t_threshold", "prob_threshold", "routing_accuracy")


@register("E2_quality_loss", sql=_SWEEP + f"""
SELECT t_threshold, prob_threshold, quality_loss_gt, quality_loss_xl
FROM ({Q.scorecard("routed", ("t_threshold", "prob_threshold"))}) s""")
def e2(spark, sf_dir):
    return routing_sweep(spark, sf_dir).select("t_threshold", "prob_threshold", "quality_loss_gt", "quality_loss_xl")


@register("E3_compute_savings", sql=_SWEEP + f"""
SELECT t_threshold, prob_threshold, compute_units, compute_savings_gt, compute_savings_xl
FROM ({Q.scorecard("routed", ("t_threshold", "prob_threshold"))}) s""")
def e3(spark, sf_dir):
    return routing_sweep(spark, sf_dir).select("t_threshold", "prob_threshold", "compute_units",
                                               "compute_savings_gt", "compute_savings_xl")


@register("B6_quantile_filter", sql=_BASE + "\nSELECT id, query_complexity_score FROM filt")
def b6(spark, sf_dir):
    filtered, _, _ = test_split(spark, sf_dir)
    return filtered.select("id", "query_complexity_score")


@register("B7_ordered_split", sql=_BASE + """
SELECT id, true AS is_train FROM train UNION ALL SELECT id, false AS is_train FROM test""")
def b7(spark, sf_dir):
    return split_marks(spark, sf_dir).where("is_kept").select("id", "is_train")


@register("D10_row_counts", sql=_BASE + """
SELECT (SELECT count(*) FROM base)::BIGINT AS n_total, ((SELECT count(*) FROM base) - (SELECT count(*) FROM filt))::BIGINT AS n_removed,
       (SELECT count(*) FROM train)::BIGINT AS n_train, (SELECT count(*) FROM test)::BIGINT AS n_test""")
def d10(spark, sf_dir):
    m = split_marks(spark, sf_dir)
    return m.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(~F.col("is_kept")).alias("n_removed"),
                 F.count_if("is_train").alias("n_train"), F.count_if(F.col("is_kept") & ~F.col("is_train")).alias("n_test"))


_QS = [0.1, 0.25, 0.33, 0.5, 0.66, 0.8, 0.9]


@register("D2_exact_quantiles", sql=Q.FIXTURE_SQL.rstrip() + Q.QUERY_FEATURES_CTE + "\n" + "\nUNION ALL ".join(
    f"SELECT {q!r}e0 AS q, round(quantile_cont(query_complexity_score, {q!r}e0), 6) AS value FROM fc" for q in _QS))
def d2(spark, sf_dir):
    from ..session import materialize
    feats = materialize(FT.query_feature_table(FX.fx_queries(spark, sf_dir), FX.KEYWORDS).select("id", "query_complexity_score"))
    qv = RI.exact_quantiles(feats, "query_complexity_score", _QS)
    rows = [(q, round(qv[q], 6)) for q in _QS]
    return spark.createDataFrame(rows, "q double, value double")


@register("Q1_always_xl", sql=_BASE + _TEST0 + ",\nr AS (SELECT *, 3 AS routed_to FROM test0)\n" + Q.scorecard("r"))
def q1(spark, sf_dir):
    return RT.scorecard(RT.route_constant(_test0(spark, sf_dir), 3)).select(
        "n", "n_base", "n_large", "n_xl", *[_r6(c) for c in RT_METRICS])


@register("Q2_always_base", sql=_BASE + _TEST0 + ",\nr AS (SELECT *, 1 AS routed_to FROM test0)\n" + Q.scorecard("r"))
def q2(spark, sf_dir):
    return RT.scorecard(RT.route_constant(_test0(spark, sf_dir), 1)).select(
        "n", "n_base", "n_large", "n_xl", *[_r6(c) for c in RT_METRICS])


RT_METRICS = ("routing_accuracy", "quality_loss_gt", "quality_loss_xl", "compute_units", "compute_savings_gt",
              "compute_savings_xl")
_SET_ROWS = [f"('{round(a * 100)}-{round(b * 100)}-{round(c * 100)}', {a!r}e0, {b!r}e0)" for a, b, c in
             config.QUANTILE_SETTINGS]


def _quantile_router_sql(column: str) -> str:
    return _BASE + _TEST0 + f""",
th AS ({" UNION ALL ".join(
        f"SELECT '{round(a * 100)}-{round(b * 100)}-{round(c * 100)}' AS setting, quantile_cont({column}, {a!r}e0) "
        f"AS low_threshold, quantile_cont({column}, {b!r}e0) AS high_threshold FROM test0"
        for a, b, c in config.QUANTILE_SETTINGS)}),
r AS (SELECT test0.*, th.setting, CASE WHEN {column} > high_threshold THEN 3 WHEN {column} > low_threshold THEN 2 ELSE 1 END
        AS routed_to FROM test0 CROSS JOIN th)
""" + Q.scorecard("r", ("setting",))


def _quantile_router(spark, sf_dir, column):
    t = _test0(spark, sf_dir)
    from ..session import materialize
    t = materialize(t)
    routed = RT.route_by_quantiles(t, column)
    return RT.scorecard(routed, ("setting",)).select("setting", "n", "n_base", "n_large", "n_xl",
                                                       *[_r6(c) for c in RT_METRICS])


@register("Q3_length_quantile_router", sql=_quantile_router_sql("query_chars_count"))
def q3(spark, sf_dir):
    return _quantile_router(spark, sf_dir, "query_chars_count")


_CALC = f""",
calc AS (SELECT test.id, {Q.complexity('', 'trs', 'f', Q.category_name('f.category_no'))} AS calculated_complexity_score
         FROM test JOIN ff f USING (id), trs)"""
_TRAIN_STATS = """,
trs AS (SELECT min(f.query_chars_count) AS cmin, max(f.query_chars_count) AS cmax, min(query_words_count) AS wmin,
          max(query_words_count) AS wmax, min(query_unique_word_count) AS umin, max(query_unique_word_count) AS umax,
          min(query_special_tokens_count) AS smin, max(query_special_tokens_count) AS smax, min(query_keywords_count) AS kmin,
          max(query_keywords_count) AS kmax, min(query_readability_score) AS rmin, 20e0 AS rmax
        FROM train JOIN ff f USING (id))"""


@register("Q4_complexity_quantile_router", sql=_quantile_router_sql("calculated_complexity_score").replace(
    _TEST0, _TRAIN_STATS + _CALC + _TEST0.replace("FROM test)", "FROM test JOIN calc USING (id))").replace("SELECT test.*,", "SELECT test.*, calculated_complexity_score,")))
def q4(spark, sf_dir):
    """Routes on the calculated complexity, joined by id; a test row without one is an error."""
    from ..session import materialize
    calc = materialize(calculated_complexity(spark, sf_dir))
    t = materialize(RT.join_predictions(_test0(spark, sf_dir), calc.select("id", "calculated_complexity_score")))
    missing = t.where(F.col("calculated_complexity_score").isNull()).count()
    if missing:
        raise ValueError(f"{missing} test rows have no calculated complexity")
    return RT.scorecard(RT.route_by_quantiles(t, "calculated_complexity_score"), ("setting",)).select(
        "setting", "n", "n_base", "n_large", "n_xl", *[_r6(c) for c in RT_METRICS])


@register("Q5_confidence_router", sql=_BASE + _TEST0 + ",\n" + Q.grid_values("pg", "prob_threshold", _P_ROWS) + f""",
r AS (SELECT t.*, pg.prob_threshold,
        CASE WHEN greatest(proba_base, proba_large, proba_xl) < prob_threshold THEN 3 ELSE {Q.ARGMAX} END AS routed_to
      FROM (SELECT test0.*, p.proba_base, p.proba_large, p.proba_xl FROM test0 LEFT JOIN (SELECT * FROM fx_proba WHERE t_threshold = 't0') p USING (id)) t
      CROSS JOIN pg)
SELECT id, prob_threshold, routed_to FROM r""")
def q5(spark, sf_dir):
    t = RT.join_predictions(_test0(spark, sf_dir), _proba0(spark, sf_dir))
    return RT.with_confidence_grid(t).select("id", "prob_threshold", "routed_to")


@register("Q6_predicted_label_router", sql=_BASE + _TEST0 + f""",
r AS (SELECT t.*, {Q.ARGMAX} AS routed_to
      FROM (SELECT test0.*, p.proba_base, p.proba_large, p.proba_xl FROM test0 LEFT JOIN (SELECT * FROM fx_proba WHERE t_threshold = 't0') p USING (id)) t)
""" + Q.scorecard("r"))
def q6(spark, sf_dir):
    t = RT.join_predictions(_test0(spark, sf_dir), _proba0(spark, sf_dir))
    t = t.withColumn("routed_to", argmax_label(*RT.PROBA_COLS))
    return RT.scorecard(t).select("n", "n_base", "n_large", "n_xl", *[_r6(c) for c in RT_METRICS])


@register("R4_argmax_label", sql=Q.FIXTURE_SQL.rstrip() + f"\nSELECT id, t_threshold, {Q.ARGMAX} AS predicted_model_label FROM fx_proba")
def r4(spark, sf_dir):
    p = FX.fx_proba(spark, sf_dir)
    return p.select("id", "t_threshold", argmax_label(*RT.PROBA_COLS).alias("predicted_model_label"))


@register("E4_classification_report", sql=_SWEEP + """,
cls AS (SELECT t_threshold, c AS cls,
          count(*) FILTER (WHERE evaluation_model_label = c) AS support,
          count(*) FILTER (WHERE routed_to = c) AS predicted,
          count(*) FILTER (WHERE evaluation_model_label = c AND routed_to = c) AS tp
        FROM (SELECT * FROM routed WHERE prob_threshold = 0.1e0) r,
             (SELECT DISTINCT t_threshold AS tt, c FROM (SELECT t_threshold, evaluation_model_label AS c FROM routed
                UNION SELECT t_threshold, routed_to FROM routed) u) cc
        WHERE cc.tt = r.t_threshold GROUP BY t_threshold, c),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0e0 END AS precision,
                 CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0e0 END AS recall FROM cls),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM pr)
SELECT t_threshold, cls::VARCHAR AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support::BIGINT AS support FROM f
UNION ALL SELECT t_threshold, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       sum(support)::BIGINT FROM f GROUP BY t_threshold
UNION ALL SELECT t_threshold, 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT
       FROM f GROUP BY t_threshold
UNION ALL SELECT t_threshold, 'accuracy', NULL, NULL, round(sum(tp) / sum(support)::DOUBLE, 6), sum(support)::BIGINT
       FROM f GROUP BY t_threshold""")
def e4(spark, sf_dir):
    """Per discrepancy threshold: true label vs the router's arg-max prediction."""
    _, _, test = test_split(spark, sf_dir)
    lab = LB.with_label_sweep(test)
    p = FX.fx_proba(spark, sf_dir).select("id", "t_threshold", *RT.PROBA_COLS)
    routed = RT.join_predictions(lab, p, ["id", "t_threshold"]).withColumn("routed_to", argmax_label(*RT.PROBA_COLS))
    rep = RT.classification_report(routed, keys=("t_threshold",))
    return rep.select("t_threshold", "class", _r6("precision"), _r6("recall"), _r6("f1"), "support")


@register("E5_regression_metrics", sql=_BASE + """,
trs AS (SELECT min(query_chars_count) AS cmin, max(query_chars_count) AS cmax FROM train)
SELECT round(avg((query_complexity_score - p) * (query_complexity_score - p)), 6) AS mse,
       round(avg(abs(query_complexity_score - p)), 6) AS mae,
       round(1e0 - sum((query_complexity_score - p) * (query_complexity_score - p))
             / (var_pop(query_complexity_score) * count(*)), 6) AS r2
FROM (SELECT test.*, query_complexity_score * 0.5e0 + (query_chars_count - cmin)::DOUBLE / (cmax - cmin)::DOUBLE AS p
      FROM test, trs) z""")
def e5(spark, sf_dir):
    """E5 on a prediction that uses train-split statistics (the K11 pattern)."""
    _, train, test = test_split(spark, sf_dir)
    st = train.agg(F.min("query_chars_count").alias("a"), F.max("query_chars_count").alias("b")).first()
    a, b = F.lit(st["a"]), F.lit(st["b"])
    pred = test.withColumn("p", F.col("query_complexity_score") * F.lit(0.5)
                           + (F.col("query_chars_count") - a).cast("double") / (b - a).cast("double"))
    m = RT.regression_metrics(pred, "query_complexity_score", "p")
    return m.select(_r6("mse"), _r6("mae"), _r6("r2"))


@register("D11_avg_max_probability", sql=_BASE + """
SELECT t_threshold, round(avg(greatest(proba_base, proba_large, proba_xl)), 6) AS avg_max_proba
FROM test JOIN fx_proba p USING (id) GROUP BY t_threshold""")
def d11(spark, sf_dir):
    """Per discrepancy threshold, as published."""
    _, _, test = test_split(spark, sf_dir)
    t = test.select("id").join(FX.fx_proba(spark, sf_dir).select("id", "t_threshold", *RT.PROBA_COLS), "id")
    return RT.avg_max_probability(t, keys=("t_threshold",)).select("t_threshold", _r6("avg_max_proba"))


@register("B11_label_score_pick", sql=_BASE + _TEST0 + f"""
SELECT id, evaluation_model_label, round({Q.pick('evaluation_model_label', Q.SCORE_COLS)}, 6) AS label_score FROM test0""")
def b11(spark, sf_dir):
    t = _test0(spark, sf_dir)
    return t.select("id", "evaluation_model_label",
                    F.round(pick_by_label("evaluation_model_label", RT.SCORE_COLS), 6).alias("label_score"))


@register("B12_compute_units", sql=_BASE + _TEST0 + f"""
SELECT id, {Q.compute_units('evaluation_model_label')} AS compute_units FROM test0""")
def b12(spark, sf_dir):
    t = _test0(spark, sf_dir)
    return t.select("id", compute_units("evaluation_model_label").alias("compute_units"))


@register("C5_prediction_join", sql=_BASE + """
SELECT count(*)::BIGINT AS n_test, count(p.id)::BIGINT AS n_matched, (count(*) - count(p.id))::BIGINT AS n_unmatched
FROM test LEFT JOIN (SELECT id FROM fx_proba WHERE t_threshold = 't0' AND doc_id % 37 <> 0) p USING (id)""")
def c5(spark, sf_dir):
    """C5 with predictions missing for some ids: the unmatched guard counts them."""
    _, _, test = test_split(spark, sf_dir)
    preds = FX.fx_proba(spark, sf_dir).where((F.col("t_threshold") == "t0") & (F.col("doc_id") % 37 != 0)).select("id", F.lit(1).alias("_m"))
    j = RT.join_predictions(test.select("id"), preds)
    n_unmatched = RT.unmatched_predictions(test.select("id"), preds).count()
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("n_test"), F.count("_m").cast("bigint").alias("n_matched"),
                 F.lit(n_unmatched).cast("bigint").alias("n_unmatched"))


@register("E4_quality_report", sql="""
WITH r AS (SELECT l.quality AS y, CASE WHEN d.text LIKE '% | %' OR d.text LIKE '%!! %' THEN 0 ELSE 1 END AS p
           FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT c, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE p = c) AS predicted,
             count(*) FILTER (WHERE y = c AND p = c) AS tp FROM r, (SELECT y AS c FROM r UNION SELECT p FROM r) u GROUP BY c),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0e0 END AS precision,
                 CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0e0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM pr)
SELECT c::VARCHAR AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM f""")
def e4_quality(spark, sf_dir):
    """The report over the given labels: quality against a rule on the whole text."""
    from ..sources.tables import load
    text = F.col("text")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.when(text.contains(" | ") | text.contains("!! "), 0).otherwise(1).alias("p"))
    rows = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    return RT.classification_report(rows, (), "y", "p").select("class", _r6("precision"), _r6("recall"), _r6("f1"), "support")
