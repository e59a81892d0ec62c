"""Queries for sources A3, projections B1-B5, text features S1-S10 and D1, D12, D13."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import features as FT
from ..sources import fixtures as FX
from ..sources.tables import load
from . import sqlfrag as Q
from .catalog import register


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _feature_table(spark, sf_dir):
    return FT.query_feature_table(FX.fx_queries(spark, sf_dir), FX.KEYWORDS)


@register("A3_parquet_scan", sql="SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 1000")
def a3(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").where(F.col("n_chars") > 1000)


@register("B1_projection", sql=Q.with_fixtures("SELECT id, instruction, input FROM fx_queries"))
def b1(spark, sf_dir):
    return FX.fx_queries(spark, sf_dir).drop("output", "category_no", "doc_id", "not_a_column")


@register("B2_query_construction", sql=Q.with_fixtures(
    f"SELECT id, {Q.build_query('instruction', 'input')} AS query FROM fx_queries"))
def b2(spark, sf_dir):
    return FT.with_query(FX.fx_queries(spark, sf_dir)).select("id", "query")


@register("B3_category_lookup", sql=Q.with_fixtures(
    f"SELECT id, category_no, {Q.category_name('category_no')} AS category FROM fx_queries"))
def b3(spark, sf_dir):
    return FT.with_category(FX.fx_queries(spark, sf_dir)).select("id", "category_no", "category")


@register("B4_category_weight", sql=Q.with_fixtures(
    f"SELECT id, {Q.category_weight(Q.category_name('category_no'))} AS category_weight FROM fx_queries"))
def b4(spark, sf_dir):
    return FT.with_category(FX.fx_queries(spark, sf_dir)).select("id", "category_weight")


@register("B5_float_columns", sql=Q.with_fixtures(
    "SELECT id, category_no::DOUBLE AS category_no, doc_id::DOUBLE AS doc_id FROM fx_queries"))
def b5(spark, sf_dir):
    q = FX.fx_queries(spark, sf_dir).select("id", "category_no", "doc_id")
    return FT.ensure_float_columns(q, ["category_no", "doc_id", "absent_column"])


def _feature_query(name, col, sql_expr, is_double=False):
    sql_val = f"round({sql_expr}, 6)" if is_double else f"({sql_expr})::BIGINT"
    sql = Q.with_fixtures(Q.QUERY_FEATURES_CTE + f"\nSELECT id, {sql_val} AS {col} FROM fq")

    @register(name, sql=sql)
    def _q(spark, sf_dir):
        df = FT.with_query_features(FT.with_query(FX.fx_queries(spark, sf_dir)), FX.KEYWORDS)
        return df.select("id", r6(col).alias(col) if is_double else F.col(col))
    return _q


_feature_query("S1_query_chars_count", "query_chars_count", "length(query)")
_feature_query("S2_query_words_count", "query_words_count", f"len({Q.words('query')})")
_feature_query("S3_query_unique_word_count", "query_unique_word_count", f"len(list_distinct({Q.words('query')}))")
_feature_query("S5_query_readability_score", "query_readability_score", Q.readability("query"), is_double=True)
_feature_query("S6_query_special_tokens_count", "query_special_tokens_count", Q.special_count("query"))
_feature_query("S7_query_keywords_count", "query_keywords_count", Q.keyword_count("instruction", "input"))
_feature_query("S8_query_contains_url", "query_contains_url", Q.contains_url("query"))


@register("S4_remove_urls", sql=Q.with_fixtures(
    Q.QUERY_FEATURES_CTE + f"\nSELECT id, {Q.remove_urls('query')} AS clean_query, "
    f"length({Q.remove_urls('query')})::BIGINT AS clean_chars FROM fq"))
def s4(spark, sf_dir):
    from ..functions.text import remove_urls
    df = FT.with_query(FX.fx_queries(spark, sf_dir))
    clean = remove_urls("query")
    return df.select("id", clean.alias("clean_query"), F.length(clean).cast("bigint").alias("clean_chars"))


@register("S7b_study_keywords", sql=Q.with_fixtures(
    f"SELECT id, {Q.keyword_count('instruction', 'input', config.KEYWORDS)}::BIGINT AS query_keywords_count FROM fx_queries"))
def s7b(spark, sf_dir):
    """S7 with the study's own list, which the invented driver texts never hold."""
    from ..functions.text import keyword_count
    q = FX.fx_queries(spark, sf_dir)
    return q.select("id", keyword_count("instruction", "input").cast("bigint").alias("query_keywords_count"))


@register("S4_S8_page_urls", sql=f"""
SELECT page_id, {Q.contains_url('url')}::BIGINT AS contains_url, length({Q.remove_urls("concat('see ', url, ' for more')")})::BIGINT AS clean_chars
FROM pages""")
def s4_pages(spark, sf_dir):
    """URL detection and removal on the real page addresses."""
    from ..functions.text import contains_url, remove_urls
    clean = remove_urls(F.concat(F.lit("see "), F.col("url"), F.lit(" for more")))
    return load(spark, sf_dir, "pages").select("page_id", contains_url("url").cast("bigint").alias("contains_url"),
                                               F.length(clean).cast("bigint").alias("clean_chars"))


_D1_SQL = Q.with_fixtures(Q.QUERY_FEATURES_CTE + """
SELECT cmin AS query_chars_count_min, cmax AS query_chars_count_max, wmin AS query_words_count_min,
       wmax AS query_words_count_max, umin AS query_unique_word_count_min, umax AS query_unique_word_count_max,
       smin AS query_special_tokens_count_min, smax AS query_special_tokens_count_max,
       kmin AS query_keywords_count_min, kmax AS query_keywords_count_max,
       round(rmin, 6) AS query_readability_score_min, rmax AS query_readability_score_max FROM fstats""")


@register("D1_feature_ranges", sql=_D1_SQL)
def d1(spark, sf_dir):
    df = FT.with_query_features(FT.with_query(FX.fx_queries(spark, sf_dir)), FX.KEYWORDS)
    st = FT.feature_stats(df)
    return st.withColumn("query_readability_score_min", r6("query_readability_score_min"))


@register("S9_minmax_scaling", sql=Q.with_fixtures(Q.QUERY_FEATURES_CTE + f"""
SELECT id, round({Q.minmax('query_chars_count', 'cmin', 'cmax')}, 6) AS chars_scaled,
       round({Q.minmax('query_keywords_count', 'kmin', 'kmax')}, 6) AS keywords_scaled
FROM ff CROSS JOIN fstats"""))
def s9(spark, sf_dir):
    from ..functions.numeric import minmax
    df = FT.with_query_features(FT.with_query(FX.fx_queries(spark, sf_dir)), FX.KEYWORDS)
    st = FT.feature_stats(df)
    row = st.first()
    s = {c: F.lit(row[c]) for c in ("query_chars_count_min", "query_chars_count_max",
                                     "query_keywords_count_min", "query_keywords_count_max")}
    return df.select("id",
                     r6(minmax("query_chars_count", s["query_chars_count_min"], s["query_chars_count_max"])).alias("chars_scaled"),
                     r6(minmax("query_keywords_count", s["query_keywords_count_min"],
                               s["query_keywords_count_max"])).alias("keywords_scaled"))


@register("S10_complexity_score", sql=Q.with_fixtures(Q.QUERY_FEATURES_CTE + """
SELECT id, category, query_chars_count, query_words_count, query_unique_word_count,
       round(query_readability_score, 6) AS query_readability_score, query_special_tokens_count,
       query_keywords_count, query_contains_url, query_complexity_score FROM fc"""))
def s10(spark, sf_dir):
    df = _feature_table(spark, sf_dir)
    return df.select("id", "category", "query_chars_count", "query_words_count", "query_unique_word_count",
                     r6("query_readability_score").alias("query_readability_score"), "query_special_tokens_count",
                     "query_keywords_count", "query_contains_url", "query_complexity_score")


@register("D12_complexity_range", sql=Q.with_fixtures(Q.QUERY_FEATURES_CTE + """
SELECT min(query_complexity_score) AS min_complexity, max(query_complexity_score) AS max_complexity FROM fc"""))
def d12(spark, sf_dir):
    df = _feature_table(spark, sf_dir)
    return df.agg(F.min("query_complexity_score").alias("min_complexity"),
                  F.max("query_complexity_score").alias("max_complexity"))


@register("D13_distinct_words", sql=Q.with_fixtures(
    f"SELECT id, len(list_distinct({Q.words('output')}))::BIGINT AS distinct_words, "
    f"len({Q.words('output')})::BIGINT AS words FROM fx_queries"))
def d13(spark, sf_dir):
    from ..functions.text import words
    q = FX.fx_queries(spark, sf_dir)
    return q.select("id", F.size(F.array_distinct(words("output"))).cast("bigint").alias("distinct_words"),
                    F.size(words("output")).cast("bigint").alias("words"))
