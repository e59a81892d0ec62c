"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.numeric import category_name
from ..operators import labels as LB
from ..operators import routing as RT
from ..operators import rowindex as RI
from ..session import materialize, scratch_path
from ..sources import batches as BT
from ..sources import fixtures as FX
from ..sources import jsonl as JL
from ..sources import reports as RP
from ..sources import templates as TP
from . import sqlfrag as Q
from .catalog import register
from .flagship import router_base, routing_sweep, split_marks, sweep
from .q_routing import _BASE, _SWEEP


def _written_queries(spark, sf_dir):
    q = FX.fx_queries(spark, sf_dir)
    out = q.select("id", "instruction", "input", "output", category_name("category_no").alias("category"))
    path = scratch_path(spark, "jsonl")
    JL.write_jsonl(out, path)
    return path


@register("A1_jsonl_scan", sql=Q.FIXTURE_SQL.rstrip() + f"""
SELECT id, instruction, input, output, {Q.category_name('category_no')} AS category FROM fx_queries""")
def a1(spark, sf_dir):
    """Write the query table as JSON lines, read it back with an explicit schema."""
    path = _written_queries(spark, sf_dir)
    schema = T.StructType([*JL.SOURCE_QUERY_SCHEMA.fields, T.StructField("category", T.StringType())])
    return JL.read_jsonl(spark, path, schema)


@register("A2_jsonl_sink", sql=Q.FIXTURE_SQL.rstrip() + f"""
SELECT id, {Q.category_name('category_no')} IS NULL AS has_explicit_null, 5::BIGINT AS n_fields FROM fx_queries""")
def a2(spark, sf_dir):
    """The written lines keep NULL fields as explicit ``null`` (5 keys on every line)."""
    path = _written_queries(spark, sf_dir)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.id").alias("id"),
                        F.col("value").contains('"category":null').alias("has_explicit_null"),
                        F.size(F.json_object_keys("value")).cast("bigint").alias("n_fields"))


@register("A4_row_range", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY doc_id) AS rn FROM fx_queries) z WHERE rn BETWEEN 101 AND 330""")
def a4(spark, sf_dir):
    """Rows [100, 330) by position (``doc_id`` order)."""
    return RI.row_range(FX.fx_queries(spark, sf_dir).select("id", "doc_id"), "doc_id", 100, 230).select("id")


_BATCH_SQL = Q.FIXTURE_SQL.rstrip() + f""",
pos AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS row_no FROM fx_queries),
lines AS (SELECT ((row_no - 1) // {config.PROMPT_BATCH_SIZE})::BIGINT AS batch_no, row_no,
                 to_json({{'id': id, 'instruction': instruction, 'input': input, 'output': output}})::VARCHAR AS line FROM pos),
batches AS (SELECT batch_no, count(*)::BIGINT AS n_rows,
                   concat({Q.lit(config.CATEGORY_PROMPT + chr(10))}, string_agg(line, chr(10) ORDER BY row_no)) AS prompt
            FROM lines GROUP BY batch_no)"""


@register("A5_prompt_batches", sql=_BATCH_SQL + "\nSELECT batch_no, n_rows, prompt FROM batches")
def a5(spark, sf_dir):
    q = FX.fx_queries(spark, sf_dir)
    return BT.prompt_batches(q, key="doc_id")


_REPLY_OBJECT = r"""CASE WHEN doc_id % 50 = 7 THEN concat('{"id":"', id, '","category":}')
  WHEN doc_id % 20 = 3 THEN concat('{"id":"', id, '","note":"braces } in { strings, \\"quoted\\" } and \\\\","category":', CAST(category_no AS VARCHAR(9)), '}')
  WHEN doc_id % 20 = 9 THEN concat('{"id":"', id, '","why":{"words":{"n":1},"s":"}"},"category":', CAST(category_no AS VARCHAR(9)), '}')
  ELSE concat('{"id":"', id, '","category":', CAST(category_no AS VARCHAR(9)), '}') END"""


@register("A6_reply_parser", sql=Q.FIXTURE_SQL.rstrip() + rf""",
rep AS (SELECT doc_id // {config.PROMPT_BATCH_SIZE} AS batch_no,
               concat('Here are the categories: ', string_agg({_REPLY_OBJECT}, ', ' ORDER BY doc_id), ' Thanks.') AS reply FROM fx_queries GROUP BY 1),
piece AS (SELECT batch_no, unnest(p) AS piece, generate_subscripts(p, 1) AS no
          FROM (SELECT batch_no, regexp_extract_all(reply, '\\.|["{{}}]|[^"{{}}\\]+') AS p FROM rep) z),
quoted AS (SELECT *, sum(CASE WHEN piece = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY batch_no ORDER BY no) % 2 = 1 AS in_string FROM piece),
deep AS (SELECT *, sum(CASE WHEN in_string THEN 0 WHEN piece = '{{' THEN 1 WHEN piece = '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY batch_no ORDER BY no) AS depth FROM quoted),
numbered AS (SELECT *, sum(CASE WHEN piece = '{{' AND NOT in_string AND depth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_no ORDER BY no) AS obj_no FROM deep),
objs AS (SELECT batch_no, obj_no, string_agg(piece, '' ORDER BY no) AS obj FROM numbered
         WHERE depth > 0 OR (piece = '}}' AND NOT in_string) GROUP BY batch_no, obj_no)
SELECT batch_no, obj, id, category, coalesce(id IS NOT NULL AND category IS NOT NULL, false) AS is_valid FROM (
  SELECT batch_no, obj,
         CASE WHEN json_valid(obj) THEN nullif(regexp_extract(obj, '"id":"([^"]*)"', 1), '') END AS id,
         CASE WHEN json_valid(obj) THEN TRY_CAST(regexp_extract(obj, '"category":(-?[0-9]+)', 1) AS INTEGER) END AS category
  FROM objs) z""")
def a6(spark, sf_dir):
    """Replies built per request batch from the queries, parsed back into rows.  Some objects hold
    braces and quotes in strings, some nested objects; every 50th is malformed and stays as a reject."""
    q = FX.fx_queries(spark, sf_dir)
    rep = (q.groupBy(F.floor(F.col("doc_id") / config.PROMPT_BATCH_SIZE).cast("bigint").alias("batch_no"))
             .agg(F.array_sort(F.collect_list(F.struct("doc_id", F.expr(_REPLY_OBJECT.replace("\\", "\\\\")).alias("o")))).alias("objs"))
             .select("batch_no", F.concat(F.lit("Here are the categories: "),
                                         F.array_join(F.transform("objs", lambda x: x["o"]), ", "),
                                         F.lit(" Thanks.")).alias("reply")))
    return BT.parse_category_replies(rep).select("batch_no", "obj", "id", "category", "is_valid")


_A8_SQL = _SWEEP + f""",
card AS ({Q.scorecard("routed", ("t_threshold", "prob_threshold"))}),
body AS (SELECT t_threshold, (round(prob_threshold * 10)::INTEGER * 100 + k + 10) AS line_no, line FROM (
   SELECT t_threshold, prob_threshold, unnest(range(0, 10)) AS k, unnest([
     printf('Evaluating Probability Threshold: %.1f', prob_threshold),
     printf('Quality Loss compared to GT: %.2f%%', round(quality_loss_gt, 2)),
     printf('Quality Loss compared to XL: %.2f%%', round(quality_loss_xl, 2)),
     printf('Compute Savings compared to GT: %.2f%%', round(compute_savings_gt, 2)),
     printf('Compute Savings compared to XL: %.2f%%', round(compute_savings_xl, 2)),
     printf('Routing Accuracy: %.2f%%', round(routing_accuracy, 2)),
     printf('Total Compute Units Used: %.2f CUs', round(compute_units, 2)),
     printf('Number of queries routed to Base: %d', n_base),
     printf('Number of queries routed to Large: %d', n_large),
     printf('Number of queries routed to XL: %d', n_xl)]) AS line FROM card) z)
SELECT t_threshold, 0 AS line_no, printf('--- Evaluating Model for t-threshold: %s ---', t_threshold) AS line
FROM (SELECT DISTINCT t_threshold FROM card) h
UNION ALL SELECT t_threshold, line_no, line FROM body
UNION ALL SELECT t_threshold, unnest([1, 2, 3]), unnest(['Filtered out the top 20% most complex queries.',
    printf('Final split: %d queries for training, %d queries for testing.', (SELECT count(*) FROM train), (SELECT count(*) FROM test)),
    printf('Average Maximum Probability per Query: %.4f', round(avg(greatest(proba_base, proba_large, proba_xl)) + 1e-9, 4))]) FROM pj GROUP BY t_threshold"""


@register("A8_sweep_report", sql=_A8_SQL)
def a8(spark, sf_dir):
    """The sweep report with its head: filter, split sizes and the average largest probability per threshold."""
    marked = materialize(split_marks(spark, sf_dir))
    test = marked.where("is_kept AND NOT is_train").drop("is_kept", "is_train")
    proba = FX.fx_proba(spark, sf_dir).select("id", "t_threshold", *RT.PROBA_COLS)
    avg_max = RT.avg_max_probability(test.select("id").join(proba, "id"), keys=("t_threshold",))
    return (RP.render_sweep_report(sweep(test, proba))
            .unionByName(RP.render_sweep_head(avg_max, RP.split_sizes(marked))))


@register("A8_testing_report", sql=_SWEEP + f""",
top AS (SELECT t_threshold, evaluation_model_label AS y, {Q.ARGMAX} AS p FROM pj),
cls AS (SELECT t.t_threshold, c AS cls, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE p = c) AS predicted,
          count(*) FILTER (WHERE y = c AND p = c) AS tp
        FROM top t JOIN (SELECT t_threshold, y AS c FROM top UNION SELECT t_threshold, p FROM top) u USING (t_threshold) GROUP BY t.t_threshold, c),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0e0 END AS pc,
              CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0e0 END AS rc FROM cls),
f AS (SELECT *, CASE WHEN pc + rc > 0 THEN 2e0 * pc * rc / (pc + rc) ELSE 0e0 END AS f1 FROM pr),
acc AS (SELECT t_threshold, avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END) AS a, count(*) AS n FROM top GROUP BY t_threshold)
SELECT t_threshold, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS line_no, unnest([printf('--- Testing Model for t-threshold: %s ---', t_threshold),
    'Filtered out the top 20% most complex queries.',
    printf('Total queries removed: %d. Remaining for training/testing: %d.', (SELECT count(*) FROM base) - (SELECT count(*) FROM filt), (SELECT count(*) FROM filt)),
    printf('Final split: %d queries for training, %d queries for testing.', (SELECT count(*) FROM train), (SELECT count(*) FROM test)),
    printf('Loaded %d queries for testing.', (SELECT count(*) FROM test)), 'EVALUATION MODEL EVALUATION',
    printf('Model Label Prediction Accuracy: %.2f%%', round(a * 100 + 1e-9, 2)), 'Classification Report:']) AS line FROM acc
UNION ALL SELECT t_threshold, 7 + row_number() OVER (PARTITION BY t_threshold ORDER BY cls),
    printf('%d %.2f %.2f %.2f %d', cls, round(pc + 1e-9, 2), round(rc + 1e-9, 2), round(f1 + 1e-9, 2), support) FROM f
UNION ALL SELECT t_threshold, 8 + (SELECT count(*) FROM f g WHERE g.t_threshold = acc.t_threshold), printf('accuracy %.2f %d', round(a + 1e-9, 2), n) FROM acc
UNION ALL SELECT t_threshold, 9 + count(*), printf('macro avg %.2f %.2f %.2f %d', round(avg(pc) + 1e-9, 2), round(avg(rc) + 1e-9, 2), round(avg(f1) + 1e-9, 2), sum(support)::BIGINT)
  FROM f GROUP BY t_threshold
UNION ALL SELECT t_threshold, 10 + count(*), printf('weighted avg %.2f %.2f %.2f %d', round(sum(pc * support) / sum(support) + 1e-9, 2),
    round(sum(rc * support) / sum(support) + 1e-9, 2), round(sum(f1 * support) / sum(support) + 1e-9, 2), sum(support)::BIGINT) FROM f GROUP BY t_threshold""")
def a8_testing(spark, sf_dir):
    """The testing report per discrepancy threshold: sizes, label accuracy and the class report of the arg-max labels."""
    marked = materialize(split_marks(spark, sf_dir))
    test = marked.where("is_kept AND NOT is_train").drop("is_kept", "is_train")
    proba = FX.fx_proba(spark, sf_dir).select("id", "t_threshold", *RT.PROBA_COLS)
    joined = RT.join_predictions(LB.with_label_sweep(test), proba, ["id", "t_threshold"])
    top = joined.select("t_threshold", "evaluation_model_label", RT.argmax_label(*RT.PROBA_COLS).alias("routed_to"))
    return RP.render_testing_report(RT.classification_report(top, ("t_threshold",)), RP.split_sizes(marked))


@register("A8_case_ids", sql=_BASE + ",\n" + Q.grid_values("dtg", "t_threshold, dt", Q.DT_ROWS) + f"""
SELECT t_threshold, {Q.label_case('dt')} AS label_case, id FROM base CROSS JOIN dtg""")
def a8_case_ids(spark, sf_dir):
    """The query ids of every labelling case: the table that goes with the case report (its lists are not
    gathered into lines, since a case may hold a third of all queries)."""
    return LB.with_label_sweep(router_base(spark, sf_dir)).select("t_threshold", "label_case", "id")


@register("A7_report_parser", sql=_SWEEP + f""",
card AS ({Q.scorecard("routed", ("t_threshold", "prob_threshold"))})
SELECT t_threshold, prob_threshold, n_base, n_large, n_xl, round(compute_units, 2) AS compute_units FROM card""")
def a7(spark, sf_dir):
    """The sweep report written as text files, read back as plain lines and parsed;
    thresholds come from the header lines."""
    path = scratch_path(spark, "report")
    RP.write_report(RP.render_sweep_report(routing_sweep(spark, sf_dir)), path)
    parsed = RP.parse_sweep_report(RP.read_report(spark, path))
    return parsed.select("t_threshold", "prob_threshold", "n_base", "n_large", "n_xl", "compute_units")


@register("A8_case_report", sql=_BASE + ",\n" + Q.grid_values("dtg", "t_threshold, dt", Q.DT_ROWS) + f""",
lab AS (SELECT *, {Q.label_number()}::INTEGER AS label FROM (
  SELECT base.query_complexity_score, t_threshold, {Q.label_case('dt')} AS label_case FROM base CROSS JOIN dtg) z),
lines AS (
  SELECT t_threshold AS report, 0 AS part, 0 AS o, 0 AS k, printf('%s: %d', label_case, count(*)) AS line FROM lab GROUP BY t_threshold, label_case
  UNION ALL SELECT DISTINCT t_threshold, 1, 0, 0, 'Total Label Counts and Complexity Scores:' FROM lab
  UNION ALL SELECT t_threshold, 2, label, unnest([0, 1, 2]), unnest([printf('Label %d: %d', label, count(*)),
     printf('Average complexity score: %.4f', round(avg(query_complexity_score) + 1e-9, 4)),
     printf('Median complexity score: %.4f', round(median(query_complexity_score) + 1e-9, 4))]) FROM lab GROUP BY t_threshold, label)
SELECT report, (row_number() OVER (PARTITION BY report ORDER BY part, o, k, line))::INTEGER AS line_no, line FROM lines""")
def a8_cases(spark, sf_dir):
    """The labelling report per discrepancy threshold: cases, then label counts with mean and median complexity."""
    lab = materialize(LB.with_label_sweep(router_base(spark, sf_dir)).select(
        "t_threshold", "label_case", "evaluation_model_label", "query_complexity_score"))
    stats = lab.groupBy("t_threshold", "evaluation_model_label").agg(F.count(F.lit(1)).alias("n"), F.avg("query_complexity_score").alias("avg_value"))
    name = F.concat_ws("|", "t_threshold", F.col("evaluation_model_label").cast("string"))
    meds = RI.grouped_quantiles(lab, name, "query_complexity_score", [0.5])  # one row per threshold and label
    med = spark.createDataFrame([(*g.split("|"), v) for (g, _), v in meds.items()], "t_threshold string, l string, median_value double")
    med = med.select("t_threshold", F.col("l").cast("int").alias("evaluation_model_label"), "median_value")
    return RP.render_case_report(LB.case_distribution(lab), stats.join(F.broadcast(med), ["t_threshold", "evaluation_model_label"]))


@register("A9_feature_template", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT id, '' AS instruction, '' AS input, '' AS query, '' AS category, '' AS output,
       0::BIGINT AS query_chars_count, 0::BIGINT AS query_words_count, 0::BIGINT AS query_unique_word_count,
       0::BIGINT AS query_special_tokens_count, 0::BIGINT AS query_keywords_count, 0::BIGINT AS query_contains_url,
       0e0 AS query_readability_score, 0e0 AS query_complexity_score FROM fx_queries""")
def a9(spark, sf_dir):
    return TP.feature_template(FX.fx_queries(spark, sf_dir).select("id"))


@register("A9_response_template", sql=Q.FIXTURE_SQL.rstrip() + """
SELECT id, 30::BIGINT AS n_responses, 30::BIGINT AS n_score_maps, 270::BIGINT AS n_zero_scores, 0e0 AS rt_sum FROM fx_queries""")
def a9_response(spark, sf_dir):
    """The wide response template: 30 empty responses, 30 score maps of nine zeros, three runtimes."""
    t = TP.response_template(FX.fx_queries(spark, sf_dir).select("id"))
    resp = [c for c in t.columns if c.startswith("r_")]
    maps = [c for c in t.columns if c.startswith("scores_")]
    empty = sum((F.when(F.col(c) == "", 1).otherwise(0) for c in resp), F.lit(0))
    zeros = sum((F.size(F.filter(F.map_values(c), lambda x: x == 0.0)) for c in maps), F.lit(0))
    return t.select("id", empty.cast("bigint").alias("n_responses"), F.lit(len(maps)).cast("bigint").alias("n_score_maps"),
                    zeros.cast("bigint").alias("n_zero_scores"),
                    sum((F.col(f"rt_{m}_avg") for m in config.MODELS), F.lit(0.0)).alias("rt_sum"))
