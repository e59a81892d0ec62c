"""Queries for text-pair metrics (B9, B10, M1-M7): candidate = variant of a
conversation turn, reference = the turn; M6 pairs consecutive embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators import textmetrics as TM
from ..sources import fixtures as FX
from ..sources.tables import load
from . import sqlfrag as Q
from .catalog import register

KEYS = ["id", "model", "resp_no"]


def pairs(spark, sf_dir):
    """30 variants of every conversation turn, each paired with the turn."""
    return FX.fx_pairs(spark, sf_dir)


_BLEU_P = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_PAIRS = Q.FIXTURE_SQL.rstrip() + f""",
pairs AS (SELECT *, (NOT {Q.blank('candidate')} AND {Q.has('reference')}) AS ok FROM fx_pairs)"""


def _overlap_sql(tok_c: str, tok_r: str, orders) -> str:
    per = ", ".join(f"coalesce(sum(least(cc, rc)) FILTER (WHERE n = {n}), 0) AS c{n}" for n in orders)
    vals = ", ".join(f"({n})" for n in orders)
    gram = "unnest(list_transform(range(1, len({t}) - n + 2), lambda i: array_to_string(list_slice({t}, i, i + n - 1), chr(1))))"
    return f""",
toks AS (SELECT id, model, resp_no, ok, CASE WHEN ok THEN {tok_c} ELSE []::VARCHAR[] END AS c,
                CASE WHEN ok THEN {tok_r} ELSE []::VARCHAR[] END AS r FROM pairs),
grams AS (SELECT id, model, resp_no, 0 AS side, n, {gram.format(t='c')} AS g FROM toks, (VALUES {vals}) o(n)
          UNION ALL
          SELECT id, model, resp_no, 1 AS side, n, {gram.format(t='r')} AS g FROM toks, (VALUES {vals}) o(n)),
cnt AS (SELECT id, model, resp_no, n, g, count(*) FILTER (WHERE side = 0) AS cc, count(*) FILTER (WHERE side = 1) AS rc
        FROM grams GROUP BY id, model, resp_no, n, g),
per AS (SELECT id, model, resp_no, {per} FROM cnt GROUP BY id, model, resp_no),
ov AS (SELECT t.id, t.model, t.resp_no, t.ok, len(t.c) AS len_c, len(t.r) AS len_r,
              {", ".join(f"coalesce(per.c{n}, 0) AS c{n}" for n in orders)}
       FROM toks t LEFT JOIN per USING (id, model, resp_no))"""


def _bleu_sql() -> str:
    ps, z = [], []
    for n in (1, 2, 3, 4):
        z.append(f"(CASE WHEN c{n} = 0 THEN 1 ELSE 0 END)")
        zn = " + ".join(z)
        ps.append(f"ln(CASE WHEN c{n} = 0 THEN 100e0 / (pow(2e0, {zn}) * (len_c - {n - 1})::DOUBLE) "
                  f"ELSE 100e0 * c{n} / (len_c - {n - 1})::DOUBLE END)")
    return (f"CASE WHEN NOT ok THEN NULL WHEN len_c < 4 OR c1 + c2 + c3 + c4 = 0 THEN 0e0 ELSE "
            f"(CASE WHEN len_c >= len_r THEN 1e0 ELSE exp(1e0 - len_r::DOUBLE / len_c::DOUBLE) END) * "
            f"exp(({' + '.join(ps)}) / 4e0) END")


def _rouge_sql(n: int) -> str:
    prec = f"(c{n}::DOUBLE / greatest(greatest(len_c - {n - 1}, 0), 1))"
    rec = f"(c{n}::DOUBLE / greatest(greatest(len_r - {n - 1}, 0), 1))"
    return (f"CASE WHEN NOT ok THEN NULL WHEN {prec} + {rec} > 0 THEN 2e0 * {prec} * {rec} / ({prec} + {rec}) "
            "ELSE 0e0 END")


@register("M1_bleu", sql=_PAIRS + _overlap_sql(f"regexp_extract_all(candidate, '{_BLEU_P}')",
                                              f"regexp_extract_all(reference, '{_BLEU_P}')", (1, 2, 3, 4)) + f"""
SELECT id, model, resp_no, round({_bleu_sql()}, 6) AS bleu FROM ov""")
def m1(spark, sf_dir):
    b = TM.pair_metrics(pairs(spark, sf_dir), KEYS, ["bleu"])
    return b.select(*KEYS, F.round("bleu", 6).alias("bleu"))


@register("M2_M3_rouge_n", sql=_PAIRS + _overlap_sql("regexp_extract_all(lower(candidate), '[a-z0-9]+')",
                                                   "regexp_extract_all(lower(reference), '[a-z0-9]+')", (1, 2)) + f"""
SELECT id, model, resp_no, round({_rouge_sql(1)}, 6) AS rouge1, round({_rouge_sql(2)}, 6) AS rouge2 FROM ov""")
def m23(spark, sf_dir):
    r = TM.pair_metrics(pairs(spark, sf_dir), KEYS, ["rouge1", "rouge2"])
    return r.select(*KEYS, F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@register("M4_M5_rouge_l")
def m45(spark, sf_dir):
    """ROUGE-L and ROUGE-Lsum (LCS in Arrow batches; rows-only check + property tests)."""
    r = TM.pair_metrics(pairs(spark, sf_dir), KEYS, ["rougeL", "rougeLsum"])
    return r.select(*KEYS, F.round("rougeL", 6).alias("rougeL"), F.round("rougeLsum", 6).alias("rougeLsum"))


@register("M4_M5_turn_pairs", sql=f"""
WITH RECURSIVE p AS (
  SELECT b.conv_id, b.turn, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS c, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS r,
         NOT {Q.blank('b.text')} AND {Q.has('a.text')} AS ok, NOT contains(a.text || b.text, chr(10)) AS one_line
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
dp AS (
  SELECT conv_id, turn, 0 AS i, list_transform(range(0, len(c) + 1), lambda x: 0::BIGINT) AS row FROM p WHERE ok
  UNION ALL
  SELECT dp.conv_id, dp.turn, i + 1,
    list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(c) + 1),
      lambda j: [greatest(row[j + 1], row[j] + CASE WHEN c[j] = r[i + 1] THEN 1 ELSE 0 END)])),
      lambda x, y: list_append(x, greatest(x[len(x)], y[1])))
  FROM dp JOIN p ON p.conv_id = dp.conv_id AND p.turn = dp.turn WHERE i < len(r)),
l AS (SELECT p.*, dp.row[len(dp.row)]::DOUBLE AS lcs FROM p JOIN dp USING (conv_id, turn) WHERE dp.i = len(p.r)),
f AS (SELECT conv_id, turn, one_line, CASE WHEN lcs = 0 THEN 0e0 ELSE 2e0 * (lcs / len(c)) * (lcs / len(r)) / (lcs / len(c) + lcs / len(r)) END AS f FROM l)
SELECT conv_id, turn, round(f.f, 6) AS "rougeL", CASE WHEN f.one_line THEN round(f.f, 6) END AS rougelsum_one_line
FROM p LEFT JOIN f USING (conv_id, turn)""")
def m45_turns(spark, sf_dir):
    """ROUGE-L of every turn against the one before it; ROUGE-Lsum where both are one line (there it equals ROUGE-L)."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    p = c.withColumnRenamed("text", "candidate").join(before, ["conv_id", "turn"])
    p = p.withColumn("one_line", ~F.concat("reference", "candidate").contains("\n"))
    r = TM.pair_metrics(p, ["conv_id", "turn", "one_line"], ["rougeL", "rougeLsum"])
    return r.select("conv_id", "turn", F.round("rougeL", 6).alias("rougeL"),
                    F.when(F.col("one_line"), F.round("rougeLsum", 6)).alias("rougelsum_one_line"))


@register("M6_embedding_cosine", sql="""
SELECT a.vec_id, b.vec_id AS next_vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
       AS bert FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m6(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_vec_id"),
                   F.col("embedding").alias("next_embedding"))
    return e.join(nxt, "vec_id").select("vec_id", "next_vec_id",
                                        F.round(TM.cosine("embedding", "next_embedding"), 6).alias("bert"))


@register("M7_pluggable_scorer", sql=_PAIRS + """
SELECT id, model, resp_no, CASE WHEN ok THEN round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0e0
         ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END, 6) END AS jaccard
FROM (SELECT *, list_distinct(regexp_extract_all(lower(candidate), '[a-z0-9]+')) AS a,
             list_distinct(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS b FROM pairs) z""")
def m7(spark, sf_dir):
    s = TM.score_pairs(pairs(spark, sf_dir), KEYS, TM.jaccard_scorer_factory, "jaccard")
    return s.select(*KEYS, F.round("jaccard", 6).alias("jaccard"))


_JACCARD_SQL = """round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0e0
         ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END, 6)"""


@register("B9_mask_guard", sql=_PAIRS + f"""
SELECT id, model, resp_no, CASE WHEN ok AND NOT masked THEN {_JACCARD_SQL} END AS jaccard
FROM (SELECT *, contains(c, '<mask>') OR contains(coalesce(reference, ''), '<mask>') AS masked,
             list_distinct(regexp_extract_all(lower(c), '[a-z0-9]+')) AS a,
             list_distinct(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS b
      FROM (SELECT *, CASE WHEN resp_no = 7 THEN concat(candidate, ' <mask>') ELSE candidate END AS c FROM pairs) y) z""")
def b9(spark, sf_dir):
    """A masked pair gets a NULL score and never reaches the scorer."""
    p = pairs(spark, sf_dir)
    cand = F.when(F.col("resp_no") == 7, F.concat("candidate", F.lit(" <mask>"))).otherwise(F.col("candidate"))
    s = TM.score_pairs(p.withColumn("candidate", cand), KEYS, TM.jaccard_scorer_factory, "jaccard", guard_masks=True)
    return s.select(*KEYS, F.round("jaccard", 6).alias("jaccard"))


@register("B10_scoring_gate", sql=_PAIRS + "\nSELECT id, model, resp_no, ok FROM pairs")
def b10(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select(*KEYS, TM.scoring_gate("candidate", "reference").alias("ok"))
