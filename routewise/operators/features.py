"""Query features and the complexity score.

Per-row work is native projections (no shuffle).  The two-pass pattern
"global min/max, then scale every row" runs the statistics as one global
aggregate (partial per task, one row out), fetches that single row and
inlines the values as literals: no join, no per-row lookup.  For streams,
pass a fixed ``dict`` of statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import numeric as N
from ..functions import text as T

FEATURES = ("query_chars_count", "query_words_count", "query_unique_word_count", "query_readability_score",
            "query_special_tokens_count", "query_keywords_count", "query_contains_url")

RANGE_FEATURES = ("query_chars_count", "query_words_count", "query_unique_word_count",
                  "query_special_tokens_count", "query_keywords_count")


def with_query(df: DataFrame, instruction: str = "instruction", input_: str = "input") -> DataFrame:
    """B2: the query text."""
    return df.withColumn("query", T.build_query(instruction, input_))


def with_category(df: DataFrame, category_no: str = "category_no") -> DataFrame:
    """B3 + B4: category name (unknown -> NULL) and its weight (unknown -> 0.03)."""
    return (df.withColumn("category", N.category_name(category_no))
              .withColumn("category_weight", N.category_weight("category")))


def with_query_features(df: DataFrame, keywords=None) -> DataFrame:
    """S1-S8 on ``query`` (S7 on instruction / input).

    The word array is computed once in its own projection (Catalyst keeps a
    non-cheap expression that is used several times un-inlined)."""
    q = F.col("query")
    df = df.withColumn("__w", T.words(q))
    out = df.withColumns({
        "query_chars_count": T.char_count(q).cast("bigint"),
        "query_words_count": F.size("__w").cast("bigint"),
        "query_unique_word_count": F.size(F.array_distinct("__w")).cast("bigint"),
        "query_readability_score": T.readability_grade(q),
        "query_special_tokens_count": T.special_token_count(q).cast("bigint"),
        "query_keywords_count": T.keyword_count("instruction", "input", keywords).cast("bigint"),
        "query_contains_url": T.contains_url(q).cast("bigint"),
    })
    return out.drop("__w")


def feature_stats(df: DataFrame) -> DataFrame:
    """One row of min/max per range feature; readability max is fixed at 20."""
    aggs = []
    for f in RANGE_FEATURES:
        aggs += [F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max")]
    aggs += [F.min("query_readability_score").alias("query_readability_score_min"),
             F.lit(config.READABILITY_CAP).alias("query_readability_score_max")]
    return df.agg(*aggs)


def _stat_columns(stats) -> dict[str, Column]:
    """Statistics as literals: a fixed ``dict``, or the single row of a stats
    aggregate fetched once (one small job; the row size is fixed)."""
    if not isinstance(stats, dict):
        stats = stats.first().asDict()
    return {k: F.lit(v) for k, v in stats.items()}


def with_complexity(df: DataFrame, stats_from: DataFrame | dict | None = None, guard: bool = True,
                    name: str = "query_complexity_score") -> DataFrame:
    """Weighted complexity score rounded to 4 places.

    ``stats_from``: the table whose min/max scale the features (default: ``df``
    itself, Step 6), the train split (router variant, ``guard=False``), or a
    fixed ``dict`` (streaming)."""
    if stats_from is None or isinstance(stats_from, DataFrame):
        s = _stat_columns(feature_stats(stats_from if stats_from is not None else df))
    else:
        s = _stat_columns(stats_from)

    def sc(f: str, x=None) -> Column:
        return N.minmax(x if x is not None else F.col(f), s[f"{f}_min"], s[f"{f}_max"], guard)

    w = config.FEATURE_WEIGHTS
    read = F.least(F.col("query_readability_score"), s["query_readability_score_max"])
    length = (sc("query_chars_count") + sc("query_words_count")) / F.lit(2.0)
    score = (F.lit(w["category"]) * N.category_weight("category")
             + F.lit(w["length"]) * length
             + F.lit(w["unique"]) * sc("query_unique_word_count")
             + F.lit(w["readability"]) * sc("query_readability_score", read)
             + F.lit(w["special_tokens"]) * sc("query_special_tokens_count")
             + F.lit(w["keywords"]) * sc("query_keywords_count")
             + F.lit(w["url_presence"]) * F.col("query_contains_url"))
    return df.withColumn(name, F.round(score, 4))


def query_feature_table(queries: DataFrame, keywords=None, materialize_features: bool = True) -> DataFrame:
    """Steps 5-6: query text, category, S1-S8 and the complexity score.

    The feature table is read twice (global min/max, then every row), so it is
    materialized once in the shared checkpoint folder before the statistics
    pass instead of re-running the text expressions."""
    df = with_category(with_query(queries))
    df = with_query_features(df, keywords)
    if materialize_features:
        from ..session import materialize
        df = materialize(df)
    return with_complexity(df)


def ensure_float_columns(df: DataFrame, columns) -> DataFrame:
    """Cast the listed columns to double where present."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns if c in df.columns})
