"""Queries for the remaining inventory rows: B13, C6, C8, R1, R2, R5, S18."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import features as FT
from ..operators import labels as LB
from ..operators import models as MD
from ..operators import rowindex as RI
from ..operators import routing as RT
from ..sources import fixtures as FX
from . import sqlfrag as Q
from .catalog import register
from .flagship import test_split
from .q_routing import _BASE, _TEST0


@register("B13_present_metrics", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT id, model, count(score)::BIGINT AS n_present, count(DISTINCT metric) FILTER (WHERE score IS NOT NULL)::BIGINT
       AS n_metrics_present FROM fx_scores GROUP BY id, model""")
def b13(spark, sf_dir):
    """Values are used only when present: non-null scores and metrics per (id, model)."""
    s = FX.fx_scores(spark, sf_dir)
    return s.groupBy("id", "model").agg(
        F.count("score").cast("bigint").alias("n_present"),
        F.count_distinct(F.when(F.col("score").isNotNull(), F.col("metric"))).cast("bigint").alias("n_metrics_present"))


@register("C6_label_restore", sql=_BASE + _TEST0 + f"""
SELECT t.id, t.evaluation_model_label, {Q.ARGMAX} AS predicted_model_label
FROM test0 t JOIN (SELECT * FROM fx_proba WHERE t_threshold = 't0') p USING (id)""")
def c6(spark, sf_dir):
    """Predictions re-attached to the actual labels by id (the study does it by position)."""
    _, _, test = test_split(spark, sf_dir)
    lab = LB.with_label(test, 0.0).select("id", "evaluation_model_label")
    p = FX.fx_proba(spark, sf_dir).where("t_threshold = 't0'")
    pred = p.select("id", RT.argmax_label(*RT.PROBA_COLS).alias("predicted_model_label"))
    return lab.join(pred, "id")


_FILES = [(LB.threshold_name(t), f"evaluation_model_{LB.threshold_name(t)}_p80_rf_nest200",
           f"labels_dt{t:g}_tt3_rt3") for t in config.DISCREPANCY_THRESHOLDS]


_C8_SQL = (Q.FIXTURE_SQL.rstrip() + Q.label_wide_cte() + ",\n"
           + Q.grid_values("files", "t_threshold, model_name, dataset_name", [f"('{a}', '{b}', '{c}')" for a, b, c in _FILES])
           + ",\n" + Q.grid_values("dtg", "t_threshold, dt", Q.DT_ROWS) + f""",
lab AS (SELECT t_threshold, {Q.label_number()}::INTEGER AS evaluation_model_label
        FROM (SELECT t_threshold, {Q.label_case('dt')} AS label_case FROM lw CROSS JOIN dtg) z)
SELECT t_threshold, model_name, dataset_name, count(*) FILTER (WHERE evaluation_model_label = 3)::BIGINT AS n_xl
FROM files JOIN lab USING (t_threshold) GROUP BY ALL""")


@register("C8_parameter_pairing", sql=_C8_SQL)
def c8(spark, sf_dir):
    """Model and dataset names paired by threshold key (not by list position), joined to the label sweep."""
    from .flagship import label_inputs_wide
    files = spark.createDataFrame(_FILES, "t_threshold string, model_name string, dataset_name string")
    lab = LB.with_label_sweep(label_inputs_wide(spark, sf_dir))
    counts = lab.groupBy("t_threshold").agg(F.count_if(F.col("evaluation_model_label") == 3).cast("bigint").alias("n_xl"))
    return F.broadcast(files).join(counts, "t_threshold")


@register("R1_row_number", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT id, row_number() OVER (ORDER BY doc_id)::BIGINT AS row_no FROM fx_queries""")
def r1(spark, sf_dir):
    """Distributed row position (range partitions, offsets, ranks within partitions)."""
    q = FX.fx_queries(spark, sf_dir)
    return RI.with_row_number(q.select("id", "doc_id"), "doc_id", "row_no").select("id", F.col("row_no").cast("bigint"))


@register("R2_first_rows", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT id FROM fx_queries ORDER BY doc_id LIMIT 500""")
def r2(spark, sf_dir):
    """``head(n)`` in file order (a top-k by position; the limit is the feature)."""
    return RI.first_rows(FX.fx_queries(spark, sf_dir).select("id", "doc_id"), "doc_id", 500).select("id")


@register("R5_top_k_vocabulary", sql=Q.FIXTURE_SQL.rstrip() + Q.QUERY_FEATURES_CTE + f""",
toks AS (SELECT id, unnest(regexp_extract_all(lower(query), '{MD.TOKEN}')) AS term FROM fq),
tf AS (SELECT id, term, count(*) AS cnt FROM toks GROUP BY id, term)
SELECT term, sum(cnt)::BIGINT AS total, count(*)::BIGINT AS df FROM tf GROUP BY term
ORDER BY total DESC, term ASC LIMIT 500""")
def r5(spark, sf_dir):
    """The k most frequent terms (ties by term): a bounded top-k."""
    v = MD.heavy_terms(FT.with_query(FX.fx_queries(spark, sf_dir)), "query", 500)
    return v.select("term", F.col("total").cast("bigint"), F.col("df").cast("bigint"))


@register("S18_json_get_default", sql=Q.FIXTURE_SQL.rstrip() + """,
avgs AS (SELECT id, model, metric, sum(score) / 10e0 AS a FROM fx_scores GROUP BY id, model, metric)
SELECT id, model, round(coalesce(max(a) FILTER (WHERE metric = 'bart'), 0e0), 6) AS bart,
       round(coalesce(max(a) FILTER (WHERE metric = 'logprobs'), 0e0), 6) AS logprobs
FROM avgs GROUP BY id, model""")
def s18(spark, sf_dir):
    """Scores kept as a JSON object per (id, model) with absent keys, parsed
    back and read with a default: ``scores.get(metric, 0)``."""
    from ..operators.scores import score_averages
    a = score_averages(FX.fx_scores(spark, sf_dir), keep_absent=False)
    js = a.groupBy("id", "model").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "avg_score"))))
                                      .alias("scores_avg"))
    m = F.from_json("scores_avg", "map<string,double>")
    return js.select("id", "model",
                     F.round(F.coalesce(F.try_element_at(m, F.lit("bart")), F.lit(0.0)), 6).alias("bart"),
                     F.round(F.coalesce(F.try_element_at(m, F.lit("logprobs")), F.lit(0.0)), 6).alias("logprobs"))
