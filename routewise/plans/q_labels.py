"""Queries for discrepancies, labels and their distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import labels as LB
from . import sqlfrag as Q
from .catalog import register
from .flagship import label_inputs_wide, router_base

_WIDE = Q.FIXTURE_SQL.rstrip() + Q.label_wide_cte()
_GRID = ",\n" + Q.grid_values("dtg", "t_threshold, dt", Q.DT_ROWS)


@register("S17_discrepancies", sql=_WIDE + """
SELECT id, discrepancy_base_vs_large, discrepancy_large_vs_xl, discrepancy_base_vs_xl FROM lw""")
def s17(spark, sf_dir):
    return label_inputs_wide(spark, sf_dir).select("id", "discrepancy_base_vs_large", "discrepancy_large_vs_xl",
                                                    "discrepancy_base_vs_xl")


@register("F2_fan_in_models", sql=_WIDE + """
SELECT id, r_t5_base_trash_count, r_t5_large_trash_count, r_t5_xl_trash_count,
       rt_t5_base_avg, rt_t5_large_avg, rt_t5_xl_avg FROM lw""")
def f2(spark, sf_dir):
    return label_inputs_wide(spark, sf_dir).select(
        "id", "r_t5_base_trash_count", "r_t5_large_trash_count", "r_t5_xl_trash_count",
        "rt_t5_base_avg", "rt_t5_large_avg", "rt_t5_xl_avg")


@register("L1_label_cases", sql=_WIDE + f"""
SELECT id, label_case, {Q.label_number()}::INTEGER AS evaluation_model_label
FROM (SELECT id, {Q.label_case('(-0.03e0)')} AS label_case FROM lw) z""")
def l1(spark, sf_dir):
    return LB.with_label(label_inputs_wide(spark, sf_dir), -0.03).select("id", "label_case", "evaluation_model_label")


@register("L2_label_sweep", sql=_WIDE + _GRID + f"""
SELECT id, t_threshold, label_case, {Q.label_number()}::INTEGER AS evaluation_model_label
FROM (SELECT id, t_threshold, {Q.label_case('dt')} AS label_case FROM lw CROSS JOIN dtg) z""")
def l2(spark, sf_dir):
    return LB.with_label_sweep(label_inputs_wide(spark, sf_dir)).select(
        "id", "t_threshold", "label_case", "evaluation_model_label")


@register("D7_case_distribution", sql=_WIDE + _GRID + f"""
SELECT t_threshold, label_case, count(*)::BIGINT AS n
FROM (SELECT t_threshold, {Q.label_case('dt')} AS label_case FROM lw CROSS JOIN dtg) z GROUP BY ALL""")
def d7(spark, sf_dir):
    return LB.case_distribution(LB.with_label_sweep(label_inputs_wide(spark, sf_dir)))


@register("D8_label_distribution", sql=Q.FIXTURE_SQL.rstrip() + Q.QUERY_FEATURES_CTE + Q.label_wide_cte() + f"""
SELECT evaluation_model_label, count(*)::BIGINT AS n, round(avg(query_complexity_score), 6) AS avg_value,
       round(median(query_complexity_score), 6) AS median_value
FROM (SELECT fc.query_complexity_score, {Q.label_number()}::INTEGER AS evaluation_model_label
      FROM (SELECT id, {Q.label_case('0e0')} AS label_case FROM lw) z JOIN fc USING (id)) y
GROUP BY evaluation_model_label""")
def d8(spark, sf_dir):
    from ..session import materialize
    base = materialize(LB.with_label(router_base(spark, sf_dir), 0.0))
    d = LB.label_distribution(base)
    return d.select("evaluation_model_label", F.col("n").cast("bigint").alias("n"),
                    F.round("avg_value", 6).alias("avg_value"), F.round("median_value", 6).alias("median_value"))
