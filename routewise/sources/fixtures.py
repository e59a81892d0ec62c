"""Deterministic study tables derived from the driver's ``documents`` table.

The study's own inputs (queries, sampled responses, metric scores, runtimes,
router probabilities) are not shipped, so they are derived row by row from
``documents``; their size grows with it.  The Spark builders fan rows out with
``inline`` over small literal arrays (a generator, no join) and use the same
expression text as the SQL CTE prefix ``FIXTURE_SQL`` that the DuckDB oracle
uses, so both engines see identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from .tables import load

# Metric ranges and multipliers of the synthetic score fixture.
FX_METRICS = [("bart", -6e0, -1e0, 13), ("rouge1", 0e0, 9e-1, 17), ("rouge2", 0e0, 7e-1, 19),
              ("rougeL", 0e0, 8e-1, 23), ("rougeLsum", 0e0, 8e-1, 29), ("bleu", 0e0, 1e2, 31),
              ("bert", -2e-1, 1e0, 37), ("bleurt", -2e0, 1e0, 41), ("logprobs", -1.2e1, -1e0, 43)]

# Exponent literals keep the values DOUBLE in both engines (a plain 0.9 is DECIMAL).
_FX_METRICS_SQL = ("('bart',-6e0,-1e0,13), ('rouge1',0e0,9e-1,17), ('rouge2',0e0,7e-1,19), ('rougeL',0e0,8e-1,23), "
                   "('rougeLsum',0e0,8e-1,29), ('bleu',0e0,1e2,31), ('bert',-2e-1,1e0,37), ('bleurt',-2e0,1e0,41), "
                   "('logprobs',-1.2e1,-1e0,43)")

# A query is a whole document: its first line is the instruction and all that
# follows the input; every tenth has only an input, two of ten only an instruction.
_FIRST_LINE = "split_part(text, chr(10), 1)"
_REST = "CASE WHEN contains(text, chr(10)) THEN regexp_replace(text, '^[^\\n]*\\n', '') ELSE '' END"
_Q_INSTRUCTION = f"CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 IN (1, 2) THEN text ELSE {_FIRST_LINE} END"
_Q_BODY = f"CASE WHEN doc_id % 10 = 0 THEN text WHEN doc_id % 10 IN (1, 2) THEN '' ELSE {_REST} END"
_Q_INPUT = f"""CASE WHEN doc_id % 10 IN (1, 2) THEN ''
         WHEN doc_id % 13 = 0 THEN concat({_Q_BODY}, ' see https://example.org/p/', CAST(doc_id AS VARCHAR(20)))
         WHEN doc_id % 17 = 0 THEN concat({_Q_BODY}, ' ![fig](img.png)')
         ELSE {_Q_BODY} END"""
_R_RESPONSE = """CASE WHEN (doc_id + 3*m + i) % 29 = 0 THEN ''
         WHEN (doc_id + 5*m + i) % 31 = 0 THEN '   '
         WHEN (doc_id + m) % 23 = 0 THEN instruction
         WHEN (doc_id + m) % 19 = 0 AND i <= 5 THEN repeat('na ', 150)
         ELSE replace(output, chr(96 + 3*m + i), 'z') END"""
_S_SCORE = """CASE WHEN (doc_id + 3*m + i) % 29 = 0 OR (doc_id + 5*m + i) % 31 = 0 THEN NULL
         WHEN doc_id % 43 = 0 AND m = 2 AND metric IN ('bart', 'logprobs') THEN NULL
         ELSE lo + (hi - lo) * ((doc_id*mult + 31*m + 17*i) % 997) / 996e0 END"""
_RT = "CAST(100*m*m + (doc_id*37) % 1500 AS DOUBLE)"
_L_SCORE = """CASE WHEN doc_id % 19 = 0 THEN 5000 WHEN doc_id % 7 = 3 THEN 4980 + 60*m - 15*m*m
         ELSE 5000 + ((doc_id*(101*m+7)) % 121 - 60) * 10 + (m - 2)*150 END / 1e4"""
_L_TRASH = "CASE WHEN doc_id % 41 = 0 OR (doc_id*(m+4) + m) % 11 = 0 THEN 4 ELSE doc_id % 3 END"
_L_REP = "CASE WHEN (doc_id + m) % 9 = 0 THEN 5 ELSE 0 END"
_L_RT = "CAST(100*m*m + (doc_id*37*m) % 900 AS DOUBLE)"
_L_LEN = "CAST(10 + (doc_id*m*13) % 60 AS DOUBLE)"
# One prediction table per discrepancy threshold (k = 0..6).
_P_A = "(1 + (doc_id*17 + 5*k) % 50)/1e0"
_P_B = "(1 + (doc_id*23 + 7*k) % 60)/1e0"
_P_C = "(1 + (doc_id*31 + 11*k) % 140)/1e0"
_THRESHOLDS = [(k, f"t{t:g}") for k, t in enumerate(config.DISCREPANCY_THRESHOLDS)]

# Text pairs: every conversation turn is a reference, its variants are the candidates.
_TURN_KEY = "(conv_id * 100 + turn)"
_PAIR_CANDIDATE = f"""CASE WHEN ({_TURN_KEY} + 3*m + i) % 29 = 0 THEN ''
         WHEN ({_TURN_KEY} + 5*m + i) % 31 = 0 THEN '   '
         ELSE replace(text, chr(96 + 3*m + i), 'z') END"""

_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"

#: Words that occur in the driver texts, for keyword features (the study's own list never does there).
KEYWORDS = ["the", "and", "of", "que", "und"]

FIXTURE_SQL = f"""WITH fx_queries AS (
  SELECT doc_id, concat('doc/', CAST(doc_id AS VARCHAR(20))) AS id,
    {_Q_INSTRUCTION} AS instruction,
    {_Q_INPUT} AS input,
    text AS output, 1 + doc_id % 15 AS category_no
  FROM documents),
fx_models AS (SELECT * FROM (VALUES (1,'t5_base'),(2,'t5_large'),(3,'t5_xl')) AS m(m, model)),
fx_slots AS (SELECT * FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS s(i)),
fx_responses AS (
  SELECT id, model, i AS resp_no, {_R_RESPONSE} AS response
  FROM fx_queries tq CROSS JOIN fx_models tm CROSS JOIN fx_slots ts),
fx_metrics AS (SELECT * FROM (VALUES {_FX_METRICS_SQL}) AS k(metric, lo, hi, mult)),
fx_scores AS (
  SELECT doc_id, id, model, i AS resp_no, metric, {_S_SCORE} AS score
  FROM fx_queries tq CROSS JOIN fx_models tm CROSS JOIN fx_slots ts CROSS JOIN fx_metrics tk),
fx_runtimes AS (
  SELECT id, model, {_RT} AS rt_avg
  FROM fx_queries tq CROSS JOIN fx_models tm),
fx_label_input AS (
  SELECT id, doc_id, m, model,
    {_L_SCORE} AS avg_normalized_score,
    {_L_TRASH} AS trash_count,
    {_L_REP} AS query_repetition_count,
    {_L_RT} AS rt_avg,
    {_L_LEN} AS length_avg
  FROM fx_queries tq CROSS JOIN fx_models tm),
fx_thresholds AS (SELECT * FROM (VALUES {", ".join(f"({k},'{n}')" for k, n in _THRESHOLDS)}) AS h(k, t_threshold)),
fx_proba AS (
  SELECT id, doc_id, t_threshold, a/(a+b+c) AS proba_base, b/(a+b+c) AS proba_large, c/(a+b+c) AS proba_xl FROM (
   SELECT id, doc_id, t_threshold, {_P_A} AS a, {_P_B} AS b, {_P_C} AS c FROM fx_queries CROSS JOIN fx_thresholds) z),
fx_pairs AS (
  SELECT concat('conv/', CAST(conv_id AS VARCHAR(20)), '/', CAST(turn AS VARCHAR(20))) AS id, model, i AS resp_no,
    {_PAIR_CANDIDATE} AS candidate, text AS reference
  FROM conversations CROSS JOIN fx_models CROSS JOIN fx_slots)
"""


def _models_col():
    return F.array(*[F.struct(F.lit(i + 1).alias("m"), F.lit(name).alias("model"))
                     for i, name in enumerate(config.MODELS)])


def _slots_col():
    return F.array(*[F.struct(F.lit(i).alias("i")) for i in range(1, config.RESPONSES_PER_MODEL + 1)])


def _metrics_col():
    return F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                              F.lit(mu).alias("mult")) for n, lo, hi, mu in FX_METRICS])


def fx_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction queries over the whole texts: ``doc_id, id, instruction, input, output, category_no``.

    Rows stay where the scan put them: whole texts are never shuffled.  All
    rows fanned out of one query leave one partition, so the partial
    aggregation by id collapses them before the (narrow) exchange."""
    return queries_from_documents(spread(load(spark, sf_dir, "documents").select("doc_id", "text")))


#: Rows of a dealt-out partition: a document or turn becomes 30 responses or pairs, so a task should hold few.
SPREAD_ROWS = 5_000
#: Dealt-out partitions per core of the cluster at most.
_MOST_PER_CORE = 32


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan whose tasks would end unevenly, dealt round-robin; results do not depend on it.

    A split of a file may hold no row group or several, so not the number of partitions but
    their rows decide (one aggregate over the footers): the scan stays as it is where its largest
    partition is at most half of a core's share."""
    par = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    r = parts.agg(F.sum("count").alias("rows"), F.max("count").alias("largest")).first()
    rows, largest = r["rows"] or 0, r["largest"] or 0
    if df.rdd.getNumPartitions() >= par and 2 * par * largest <= rows:
        return df
    return df.repartition(max(par, min(-(-rows // SPREAD_ROWS), _MOST_PER_CORE * par)))


def queries_from_documents(d: DataFrame) -> DataFrame:
    """The per-row projection behind ``fx_queries`` (also usable on a stream)."""
    return d.select(
        "doc_id",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"),
        F.expr(_Q_INSTRUCTION).alias("instruction"),
        F.expr(_Q_INPUT).alias("input"),
        F.col("text").alias("output"),
        (F.lit(1) + F.col("doc_id") % 15).alias("category_no"))


def _per_model(q: DataFrame) -> DataFrame:
    return q.select("*", F.inline(_models_col()))


def fx_responses(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Long responses ``id, model, resp_no, response`` (10 per query and model)."""
    q = fx_queries(spark, sf_dir)
    r = _per_model(q).select("*", F.inline(_slots_col()))
    cols = ["id", "model", F.col("i").alias("resp_no"), F.expr(_R_RESPONSE).alias("response")]
    if with_text:
        cols += ["doc_id", "instruction", "input", "output", "category_no"]
    return r.select(*cols)


def fx_responses_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query with a column ``r_<model>_<i>`` per response."""
    q = fx_queries(spark, sf_dir)
    at = lambda m, i: F.expr(re.sub(r"\bi\b", str(i), re.sub(r"\bm\b", str(m), _R_RESPONSE)))
    return q.select("id", *[at(m, i).alias(f"r_{name}_{i}") for m, name in enumerate(config.MODELS, 1)
                            for i in range(1, config.RESPONSES_PER_MODEL + 1)])


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric scores ``doc_id, id, model, resp_no, metric, score`` (a complete grid)."""
    q = fx_queries(spark, sf_dir).select("doc_id", "id")
    s = _per_model(q).select("*", F.inline(_slots_col())).select("*", F.inline(_metrics_col()))
    return s.select("doc_id", "id", "model", F.col("i").alias("resp_no"), "metric", F.expr(_S_SCORE).alias("score"))


def fx_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx_queries(spark, sf_dir).select("doc_id", "id")
    return _per_model(q).select("id", "model", F.expr(_RT).alias("rt_avg"))


def fx_label_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (query, model) summaries that hit all nine labelling cases."""
    q = fx_queries(spark, sf_dir).select("doc_id", "id")
    return _per_model(q).select(
        "id", "doc_id", "m", "model",
        F.expr(_L_SCORE).alias("avg_normalized_score"),
        F.expr(_L_TRASH).alias("trash_count"),
        F.expr(_L_REP).alias("query_repetition_count"),
        F.expr(_L_RT).alias("rt_avg"),
        F.expr(_L_LEN).alias("length_avg"))


def fx_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router class probabilities per query and discrepancy threshold."""
    return proba_from_queries(fx_queries(spark, sf_dir).select("doc_id", "id"))


def proba_columns(k: int | None = None) -> dict:
    """Router probability columns computed from ``doc_id`` and the threshold's
    number ``k`` (a column, or a fixed number, e.g. on a stream)."""
    fixed = (lambda e: e) if k is None else (lambda e: e.replace("*k)", f"*{int(k)})"))
    a, b, c = (F.expr(fixed(e)) for e in (_P_A, _P_B, _P_C))
    tot = a + b + c
    return {"proba_base": a / tot, "proba_large": b / tot, "proba_xl": c / tot}


def proba_from_queries(q: DataFrame) -> DataFrame:
    """``id, doc_id, t_threshold, proba_*``: one row per query and threshold."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("t_threshold")) for k, n in _THRESHOLDS])
    return q.select("id", "doc_id", F.inline(grid)).select("id", "doc_id", "t_threshold",
                                                           *[v.alias(n) for n, v in proba_columns().items()])


def fx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs ``id, model, resp_no, candidate, reference``: 30 variants of every conversation turn."""
    c = spread(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    p = _per_model(c).select("*", F.inline(_slots_col()))
    return p.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"),
                    "model", F.col("i").alias("resp_no"), F.expr(_PAIR_CANDIDATE).alias("candidate"),
                    F.col("text").alias("reference"))


def with_candidates(q: DataFrame) -> DataFrame:
    """The raw rows' ``candidates`` of queries with a ``doc_id``: per response its model, decoding method
    and score map (30 responses of 9 metrics), and their ``split``; built in the row, so that nothing is grouped."""
    names = {"m": "s.m", "i": "s.i", "metric": "k.metric", "lo": "k.lo", "hi": "k.hi", "mult": "k.mult"}
    score = re.sub(rf"\b({'|'.join(names)})\b", lambda w: names[w[0]], _S_SCORE)
    slots = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(name).alias("model"), F.lit(i).alias("i"))
                      for m, name in enumerate(config.MODELS, 1) for i in range(1, config.RESPONSES_PER_MODEL + 1)])
    each = F.expr(f"""transform(_slots, s -> struct('sampling' AS decoding_method, s.model AS model, '' AS text,
        map_from_entries(transform(_metrics, k -> struct(k.metric AS metric, {score} AS score))) AS scores))""")
    return q.withColumns({"_slots": slots, "_metrics": _metrics_col()}).withColumns({"split": F.expr(_SPLIT), "candidates": each}).drop("_slots", "_metrics")


def fx_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw source rows ``id, split, candidates``."""
    q = fx_queries(spark, sf_dir).select("doc_id", "id")
    return with_candidates(q).select("id", "split", "candidates")
