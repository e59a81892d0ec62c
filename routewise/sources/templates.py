"""Typed template rows (default values) for features and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config


def feature_template(ids: DataFrame) -> DataFrame:
    """One row per id with the study's feature defaults ("" text, 0 counts)."""
    return ids.select(
        "id", *[F.lit("").alias(c) for c in ("instruction", "input", "query", "category", "output")],
        *[F.lit(0).cast("bigint").alias(c) for c in ("query_chars_count", "query_words_count",
                                                      "query_unique_word_count", "query_special_tokens_count",
                                                      "query_keywords_count", "query_contains_url")],
        *[F.lit(0.0).alias(c) for c in ("query_readability_score", "query_complexity_score")])


def response_template(ids: DataFrame, n: int = config.RESPONSES_PER_MODEL) -> DataFrame:
    """One wide row per id: ten empty responses with zero scores per model, and its mean runtime."""
    zero = F.map_from_arrays(F.array(*[F.lit(m) for m in config.METRICS]), F.array(*[F.lit(0.0) for _ in config.METRICS]))
    cols = []
    for m in config.MODELS:
        for i in range(1, n + 1):
            cols += [F.lit("").alias(f"r_{m}_{i}"), zero.alias(f"scores_{m}_{i}")]
        cols.append(F.lit(0.0).alias(f"rt_{m}_avg"))
    return ids.select("id", *cols)


def score_template(ids: DataFrame, n: int = config.RESPONSES_PER_MODEL) -> DataFrame:
    """Long score template: every (id, model, response, metric) with default 0.0."""
    models = F.array(*[F.lit(m) for m in config.MODELS])
    slots = F.sequence(F.lit(1), F.lit(n))
    metrics = F.array(*[F.lit(m) for m in config.METRICS])
    return (ids.select("id", F.explode(models).alias("model"))
               .select("*", F.explode(slots).alias("resp_no"))
               .select("*", F.explode(metrics).alias("metric"))
               .withColumn("score", F.lit(0.0)))
