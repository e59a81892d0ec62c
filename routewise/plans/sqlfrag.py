"""DuckDB SQL fragments mirroring ``routewise.functions`` for the oracle queries.

DuckDB uses RE2: no ``(?U)`` flag (it means "ungreedy" there), ASCII ``\\s``.
The driver tables contain no non-ASCII whitespace, so the two agree on them.
"""

from __future__ import annotations

from .. import config
from ..sources.fixtures import FIXTURE_SQL, KEYWORDS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nz(t: str) -> str:
    return f"coalesce({t}, '')"


def has(t: str) -> str:
    return f"(coalesce({t}, '') <> '')"


def strip(t: str) -> str:
    return rf"regexp_replace(coalesce({t}, ''), '^\s+|\s+$', '', 'g')"


def blank(t: str) -> str:
    return f"({strip(t)} = '')"


def words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({t}, ''), '\s+'), lambda w: w <> '')"


def remove_urls(t: str) -> str:
    return rf"regexp_replace(coalesce({t}, ''), '!\[.*?\]\(.*?\)|https?://\S+', '', 'g')"


def special_count(t: str) -> str:
    chars = lit("".join(config.SPECIAL_TOKENS))
    return f"(length({nz(t)}) - length(translate({nz(t)}, {chars}, '')))"


def keyword_count(instr: str, inp: str, keywords=KEYWORDS) -> str:
    kws = ", ".join(lit(k) for k in keywords)
    src = f"lower(CASE WHEN {has(instr)} THEN {nz(instr)} ELSE {nz(inp)} END)"
    return rf"len(list_filter(regexp_split_to_array({src}, '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda t: t IN ({kws})))"


def contains_url(t: str) -> str:
    return f"(CASE WHEN regexp_matches({nz(t)}, 'https?://') THEN 1 ELSE 0 END)"


def readability(t: str) -> str:
    clean = remove_urls(t)
    w = words(clean)
    nw = f"len({w})::DOUBLE"
    ns = f"greatest(1, len(regexp_extract_all({clean}, '[.!?]+')))::DOUBLE"
    syl = (f"list_sum(list_transform({w}, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')))))"
           "::DOUBLE")
    return (f"(CASE WHEN len({w}) > 0 THEN 0.39e0 * ({nw} / {ns}) + 11.8e0 * ({syl} / {nw}) - 15.59e0 "
            "ELSE 0e0 END)")


def build_query(i: str, x: str) -> str:
    return (f"(CASE WHEN {has(i)} AND {has(x)} THEN concat('Instruction: ', {i}, ' Input: ', {x}) "
            f"WHEN {has(i)} THEN concat('Instruction: ', {i}) ELSE concat('Input: ', {nz(x)}) END)")


def category_name(c: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in config.CATEGORY_NAMES.items())
    return f"(CASE {c} {whens} END)"


def category_weight(c: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {float(v)!r}e0" if "e" not in repr(float(v)) else f"WHEN {lit(k)} THEN {v}"
                     for k, v in config.CATEGORY_WEIGHTS.items())
    return f"coalesce(CASE {c} {whens} END, {config.DEFAULT_CATEGORY_WEIGHT!r}e0)"


def redundancy(t: str) -> str:
    w = words(t)
    n = f"len({w})::DOUBLE"
    word_level = f"(({n} - len(list_distinct({w}))) / {n})"
    per_word = f"list_transform({w}, lambda q: (length(q) - list_unique(string_split(q, '')))::DOUBLE / length(q))"
    char_level = f"(list_reduce(list_prepend(0e0, {per_word}), lambda a, b: a + b) / {n})"
    return f"(CASE WHEN {blank(t)} THEN 1e0 ELSE greatest({word_level}, {char_level}) END)"


def minmax(x: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} = {lo} THEN 0e0 ELSE ({x} - {lo})::DOUBLE / ({hi} - {lo})::DOUBLE END)"


def compute_units(label: str) -> str:
    u = config.COMPUTE_UNITS
    return f"(CASE {label} WHEN 1 THEN {u[0]!r}e0 WHEN 2 THEN {u[1]!r}e0 ELSE {u[2]!r}e0 END)"


def with_fixtures(body: str) -> str:
    """Prefix the fixture CTEs; ``body`` continues the WITH list (starts with ``,``) or is a SELECT."""
    return FIXTURE_SQL.rstrip() + "\n" + body.strip()


def complexity(prefix: str, stats: str, row: str, category: str) -> str:
    """S10 over feature columns of ``row`` and the ranges in ``stats``; a zero range scales to 0."""
    r, t = (f"{x}." if x else "" for x in (row, stats))
    scaled = lambda c, k: minmax(f"{r}{c}", f"{t}{k}min", f"{t}{k}max")
    return f"""round(
         2.5e0 * {category_weight(category)}
         + 1.0e0 * (({scaled('query_chars_count', 'c')} + {scaled('query_words_count', 'w')}) / 2.0e0)
         + 0.4e0 * {scaled('query_unique_word_count', 'u')}
         + 1.2e0 * {minmax(f'least({r}query_readability_score, {t}rmax)', f'{t}rmin', f'{t}rmax')}
         + 0.9e0 * {scaled('query_special_tokens_count', 's')}
         + 1.5e0 * {scaled('query_keywords_count', 'k')}
         + 1.0e0 * {r}query_contains_url, 4)"""


def _bad(m: str) -> str:
    return f"r_t5_{m}_trash_count >= 3"


def _repeats(m: str) -> str:
    return f"r_t5_{m}_query_repetition_count >= 3"


def _cheap(small: str, big: str) -> str:
    return (f"rt_t5_{small}_avg <= rt_t5_{big}_avg * 1.5e0 AND r_t5_{small}_length_avg <= r_t5_{big}_length_avg * 1.5e0")


def label_case(dt: str) -> str:
    """The labelling rules, written for the oracle alone as a tree of nested
    decisions (which model fails, which gap opens, which cheaper model is close enough)."""
    bl, lx, bx = "discrepancy_base_vs_large", "discrepancy_large_vs_xl", "discrepancy_base_vs_xl"
    base_wins = f"NOT ({_bad('base')}) AND {bl} >= 0 AND {bx} >= 0 AND NOT ({_repeats('base')})"
    mid = (f"CASE WHEN {bl} >= {dt} AND NOT ({_repeats('base')}) THEN "
           f"CASE WHEN {_cheap('base', 'large')} THEN 'case_5' ELSE 'case_default' END ELSE 'case_6' END")
    top = (f"CASE WHEN {bx} >= {dt} THEN CASE WHEN {_cheap('base', 'xl')} THEN 'case_7' ELSE 'case_default' END "
           f"WHEN {lx} >= {dt} THEN CASE WHEN {_cheap('large', 'xl')} THEN 'case_8' ELSE 'case_default' END ELSE 'case_default' END")
    return f"""(CASE WHEN {_bad('xl')} OR {_bad('large')} THEN
    CASE WHEN {_bad('base')} AND {_bad('large')} AND {_bad('xl')} THEN 'case_1' ELSE 'case_2' END
  ELSE CASE
    WHEN {bl} = 0 AND {lx} = 0 AND {bx} = 0 AND NOT ({_bad('base')}) THEN 'case_3'
    WHEN {base_wins} THEN 'case_4'
    WHEN {_bad('base')} OR NOT ({bl} < 0) THEN 'case_default'
    WHEN {lx} >= 0 THEN CASE WHEN {_repeats('large')} THEN 'case_default' ELSE {mid} END
    WHEN {_repeats('xl')} OR {_repeats('large')} OR {_repeats('base')} THEN 'case_default'
    ELSE {top} END END)"""


def label_number(case_col: str = "label_case") -> str:
    """Model label of a case, for the oracle."""
    return (f"(CASE WHEN {case_col} IN ('case_3', 'case_4', 'case_5', 'case_7') THEN 1 "
            f"WHEN {case_col} IN ('case_6', 'case_8') THEN 2 ELSE 3 END)")


def _double(t: float) -> str:
    return f"({t!r}e0)" if "e" not in repr(t) else f"({t!r})"


#: Rows (name, value) of the discrepancy thresholds.
DT_ROWS = [f"('t{t:g}', {_double(t)})" for t in config.DISCREPANCY_THRESHOLDS]

QUERY_FEATURES_CTE = f""",
fq AS (SELECT doc_id, id, instruction, input, output, category_no,
              {build_query('instruction', 'input')} AS query,
              {category_name('category_no')} AS category FROM fx_queries),
ff AS (SELECT *,
         length(query)::BIGINT AS query_chars_count,
         len({words('query')})::BIGINT AS query_words_count,
         len(list_distinct({words('query')}))::BIGINT AS query_unique_word_count,
         {readability('query')} AS query_readability_score,
         {special_count('query')}::BIGINT AS query_special_tokens_count,
         {keyword_count('instruction', 'input')}::BIGINT AS query_keywords_count,
         {contains_url('query')}::BIGINT AS query_contains_url
       FROM fq),
fstats AS (SELECT min(query_chars_count) AS cmin, max(query_chars_count) AS cmax,
                  min(query_words_count) AS wmin, max(query_words_count) AS wmax,
                  min(query_unique_word_count) AS umin, max(query_unique_word_count) AS umax,
                  min(query_special_tokens_count) AS smin, max(query_special_tokens_count) AS smax,
                  min(query_keywords_count) AS kmin, max(query_keywords_count) AS kmax,
                  min(query_readability_score) AS rmin, 20e0 AS rmax FROM ff),
fc AS (SELECT ff.*, {complexity('', '', '', 'category')} AS query_complexity_score
       FROM ff CROSS JOIN fstats)"""


def pick(label: str, cols) -> str:
    return f"(CASE {label} WHEN 1 THEN {cols[0]} WHEN 2 THEN {cols[1]} WHEN 3 THEN {cols[2]} END)"


SCORE_COLS = [f"avg_normalized_score_{m}" for m in config.MODELS]


def scorecard(src: str, keys=(), label: str = "evaluation_model_label", routed: str = "routed_to") -> str:
    """SQL twin of ``operators.routing.scorecard`` (values rounded to 6)."""
    k = ", ".join(keys)
    kk = (k + ", ") if k else ""
    u = config.COMPUTE_UNITS
    return f"""SELECT {kk}n::BIGINT AS n, n_base::BIGINT AS n_base, n_large::BIGINT AS n_large, n_xl::BIGINT AS n_xl,
  round(n_correct / n::DOUBLE * 100e0, 6) AS routing_accuracy,
  round((s_router / n::DOUBLE - s_gt / n::DOUBLE) / (s_gt / n::DOUBLE) * 100e0, 6) AS quality_loss_gt,
  round((s_router / n::DOUBLE - s_xl / n::DOUBLE) / (s_xl / n::DOUBLE) * 100e0, 6) AS quality_loss_xl,
  round(n_base * {u[0]!r}e0 + n_large * {u[1]!r}e0 + n_xl * {u[2]!r}e0, 6) AS compute_units,
  round(((gt_base * {u[0]!r}e0 + gt_large * {u[1]!r}e0 + gt_xl * {u[2]!r}e0) - (n_base * {u[0]!r}e0 + n_large * {u[1]!r}e0 + n_xl * {u[2]!r}e0))
        / (gt_base * {u[0]!r}e0 + gt_large * {u[1]!r}e0 + gt_xl * {u[2]!r}e0) * 100e0, 6) AS compute_savings_gt,
  round((n::DOUBLE * {u[2]!r}e0 - (n_base * {u[0]!r}e0 + n_large * {u[1]!r}e0 + n_xl * {u[2]!r}e0)) / (n::DOUBLE * {u[2]!r}e0) * 100e0, 6)
        AS compute_savings_xl
FROM (SELECT {kk}count(*) AS n,
        count(*) FILTER (WHERE {routed} = 1) AS n_base, count(*) FILTER (WHERE {routed} = 2) AS n_large,
        count(*) FILTER (WHERE {routed} = 3) AS n_xl,
        count(*) FILTER (WHERE {label} = 1) AS gt_base, count(*) FILTER (WHERE {label} = 2) AS gt_large,
        count(*) FILTER (WHERE {label} = 3) AS gt_xl,
        count(*) FILTER (WHERE {label} = {routed}) AS n_correct,
        sum({pick(label, SCORE_COLS)}) AS s_gt, sum({pick(routed, SCORE_COLS)}) AS s_router,
        sum({SCORE_COLS[2]}) AS s_xl
      FROM {src} {"GROUP BY " + k if k else ""}) agg"""


ARGMAX = "(CASE WHEN proba_base >= proba_large AND proba_base >= proba_xl THEN 1 WHEN proba_large >= proba_xl THEN 2 ELSE 3 END)"


def label_wide_cte(src: str = "fx_label_input") -> str:
    """Pivot of the per-model label inputs to the study's wide names + discrepancies."""
    cols = []
    for m in config.MODELS:
        cols += [f"max(CASE WHEN model = '{m}' THEN avg_normalized_score END) AS avg_normalized_score_{m}",
                 f"max(CASE WHEN model = '{m}' THEN trash_count END) AS r_{m}_trash_count",
                 f"max(CASE WHEN model = '{m}' THEN query_repetition_count END) AS r_{m}_query_repetition_count",
                 f"max(CASE WHEN model = '{m}' THEN rt_avg END) AS rt_{m}_avg",
                 f"max(CASE WHEN model = '{m}' THEN length_avg END) AS r_{m}_length_avg"]
    return f""",
lw0 AS (SELECT id, {", ".join(cols)} FROM {src} GROUP BY id),
lw AS (SELECT *, round(avg_normalized_score_t5_base - avg_normalized_score_t5_large, 4) AS discrepancy_base_vs_large,
              round(avg_normalized_score_t5_large - avg_normalized_score_t5_xl, 4) AS discrepancy_large_vs_xl,
              round(avg_normalized_score_t5_base - avg_normalized_score_t5_xl, 4) AS discrepancy_base_vs_xl FROM lw0)"""


def split_ctes(base: str = "base", pct: float = 80.0, ratio: float = 0.9, key: str = "doc_id") -> str:
    """B6 quantile filter + B7 ordered split (``filt``, ``train``, ``test``)."""
    return f""",
thr AS (SELECT quantile_cont(query_complexity_score, {pct / 100!r}e0) AS t FROM {base}),
filt AS (SELECT {base}.* FROM {base}, thr WHERE query_complexity_score <= t),
ranked AS (SELECT *, row_number() OVER (ORDER BY {key}) AS rn, count(*) OVER () AS n_filt FROM filt),
train AS (SELECT * EXCLUDE (rn, n_filt) FROM ranked WHERE rn <= round_even(n_filt * {ratio!r}e0, 0)),
test AS (SELECT * EXCLUDE (rn, n_filt) FROM ranked WHERE rn > round_even(n_filt * {ratio!r}e0, 0))"""


def grid_values(name: str, cols: str, rows) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) AS g({cols}))"
