"""Queries for leaderboard tables (G1-G4) over the sampled candidates' scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import leaderboard as LBD
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import rawrows as RR
from ..sources.jsonl import CANDIDATE_SCHEMA
from . import sqlfrag as Q
from .catalog import register
from .flagship import label_inputs_wide

_MEANS = Q.FIXTURE_SQL.rstrip() + """,
means AS (SELECT model, metric, avg(score) AS mean_score FROM fx_scores GROUP BY model, metric),
best AS (SELECT metric, model AS best_model, mean_score AS best_mean FROM means
         QUALIFY row_number() OVER (PARTITION BY metric ORDER BY mean_score DESC, model ASC) = 1)"""


def _r6(c):
    return F.round(c, 6).alias(c)


@register("G1_metric_means", sql=_MEANS + "\nSELECT model, metric, round(mean_score, 6) AS mean_score FROM means")
def g1(spark, sf_dir):
    return LBD.metric_means(FX.fx_scores(spark, sf_dir)).select("model", "metric", _r6("mean_score"))


@register("G1_candidate_means_by_split", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT split, model, metric, round(avg(score), 6) AS mean_score
FROM (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM fx_scores) s
GROUP BY split, model, metric""")
def g1_split(spark, sf_dir):
    """From the raw rows: the candidate array is exploded and averaged per split."""
    rows = FX.fx_candidates(spark, sf_dir).withColumn("candidates", F.col("candidates").cast(CANDIDATE_SCHEMA["candidates"].dataType))
    m = LBD.metric_means(LBD.candidate_scores(rows), by=("split",))
    return m.select("split", "model", "metric", _r6("mean_score"))


@register("G2_best_model", sql=_MEANS + "\nSELECT metric, best_model, round(best_mean, 6) AS best_mean FROM best")
def g2(spark, sf_dir):
    b = LBD.best_models(LBD.metric_means(FX.fx_scores(spark, sf_dir)))
    return b.select("metric", "best_model", _r6("best_mean"))


@register("G3_oracle_gap", sql=_MEANS + """,
orc AS (SELECT metric, avg(bc) AS oracle_mean FROM (SELECT id, metric, max(score) AS bc FROM fx_scores GROUP BY id, metric) z
        GROUP BY metric)
SELECT metric, round(oracle_mean, 6) AS oracle_mean, round(oracle_mean - best_mean, 6) AS gap FROM orc JOIN best USING (metric)""")
def g3(spark, sf_dir):
    s = FX.fx_scores(spark, sf_dir)
    o = LBD.oracle_scores(s, LBD.best_models(LBD.metric_means(s)))
    return o.select("metric", _r6("oracle_mean"), _r6("gap"))


def _outcome_sql(a: str, b: str) -> str:
    va, vb = f"avg_normalized_score_{a}", f"avg_normalized_score_{b}"
    return (f"CASE WHEN {va} > {vb} THEN 'A is better' WHEN {va} < {vb} THEN 'B is better' "
            f"WHEN {va} >= 0.5e0 THEN 'Same good' ELSE 'Same bad' END")


_PAIRS = [(a, b) for i, a in enumerate(config.MODELS) for b in config.MODELS[i + 1:]]


@register("G4_pairwise_win_rates", sql=Q.FIXTURE_SQL.rstrip() + Q.label_wide_cte() + """,
kv AS (""" + "\nUNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, {_outcome_sql(a, b)} AS outcome FROM lw JOIN fx_queries USING (id) WHERE doc_id % 13 <> 0"
                                  for a, b in _PAIRS) + """)
SELECT model_a, model_b, count(*)::BIGINT AS n,
       round(avg(CASE WHEN outcome = 'A is better' THEN 1e0 ELSE 0e0 END), 6) AS a_win_rate,
       round(avg(CASE WHEN outcome = 'B is better' THEN 1e0 ELSE 0e0 END), 6) AS b_win_rate,
       round(avg(CASE WHEN outcome = 'Same good' THEN 1e0 ELSE 0e0 END), 6) AS same_good_rate,
       round(avg(CASE WHEN outcome = 'Same bad' THEN 1e0 ELSE 0e0 END), 6) AS same_bad_rate
FROM kv GROUP BY model_a, model_b""")
def g4(spark, sf_dir):
    """Every thirteenth row carries no comparisons (NULL), as raw rows may."""
    cmp = LBD.encode_comparisons(label_inputs_wide(spark, sf_dir), list(config.MODELS))
    number = F.substring_index("id", "/", -1).cast("bigint")
    cmp = cmp.withColumn("cmp_results", F.when(number % 13 != 0, F.col("cmp_results")))
    r = LBD.pairwise_win_rates(cmp)
    return r.select("model_a", "model_b", "n", *[_r6(c) for c in ("a_win_rate", "b_win_rate", "same_good_rate",
                                                                   "same_bad_rate")])


def _raw_rows(spark, sf_dir):
    """Raw source lines written to the shared folder: absent scores have no key, every thirteenth row has no
    comparisons.  Narrow rows are joined; the candidates are built behind the join."""
    cmp = LBD.encode_comparisons(label_inputs_wide(spark, sf_dir), list(config.MODELS))
    number = F.substring_index("id", "/", -1).cast("bigint")
    cmp = cmp.withColumn("cmp_results", F.when(number % 13 != 0, F.col("cmp_results")))
    q = FX.fx_queries(spark, sf_dir).select("doc_id", "id")
    # as many tasks as read the queries: joined rows are narrow, the lines made of them are not
    rows = FX.with_candidates(q.join(cmp, "id").repartition(q.rdd.getNumPartitions()))
    rows = rows.withColumn("candidates", F.transform(
        "candidates", lambda c: c.withField("scores", F.map_filter(c["scores"], lambda k, v: v.isNotNull()))))
    path = scratch_path(spark, "raw-lines")
    RR.write_lines(rows.select("id", "split", "candidates", "cmp_results"), path)
    return RR.read_lines(spark, path)


@register("G1_raw_lines", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT split, model, metric, count(score)::BIGINT AS n, round(avg(score), 6) AS mean_score
FROM (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM fx_scores) s
WHERE score IS NOT NULL GROUP BY split, model, metric""")
def g1_raw(spark, sf_dir):
    """Metric means per split from raw JSON lines, whatever keys their score objects hold."""
    s = RR.candidate_scores(_raw_rows(spark, sf_dir))
    return s.groupBy("split", "model", "metric").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@register("G4_raw_lines", sql=Q.FIXTURE_SQL.rstrip() + Q.label_wide_cte() + """,
kv AS (""" + "\nUNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, {_outcome_sql(a, b)} AS outcome FROM lw JOIN fx_queries USING (id) WHERE doc_id % 13 <> 0"
                                  for a, b in _PAIRS) + """)
SELECT model_a, model_b, count(*)::BIGINT AS n,
       round(avg(CASE WHEN outcome = 'A is better' THEN 1e0 ELSE 0e0 END), 6) AS a_win_rate,
       round(avg(CASE WHEN outcome = 'B is better' THEN 1e0 ELSE 0e0 END), 6) AS b_win_rate
FROM kv GROUP BY model_a, model_b""")
def g4_raw(spark, sf_dir):
    """Pairwise win rates from raw JSON lines, with and without comparisons."""
    r = LBD.win_rates(RR.comparisons(_raw_rows(spark, sf_dir)))
    return r.select("model_a", "model_b", "n", _r6("a_win_rate"), _r6("b_win_rate"))


@register("S18_raw_lines", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT id, model, round(sum(CASE WHEN metric = 'bart' THEN coalesce(score, 0e0) ELSE 0e0 END), 6) AS bart,
       round(sum(CASE WHEN metric = 'bleu' THEN coalesce(score, -1e0) ELSE 0e0 END), 6) AS bleu
FROM fx_scores GROUP BY id, model""")
def s18_raw(spark, sf_dir):
    """Scores by key with a default where a candidate's score object lacks it, summed per model."""
    c = RR.candidates(_raw_rows(spark, sf_dir), ("id",))
    return c.groupBy("id", "model").agg(F.round(F.sum(RR.score_or_default("scores", "bart")), 6).alias("bart"),
                                        F.round(F.sum(RR.score_or_default("scores", "bleu", -1.0)), 6).alias("bleu"))
