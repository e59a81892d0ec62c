"""Dataset leaderboard tables (G1-G4): metric means per model, best model,
oracle (best candidate per example) and pairwise comparison win rates.

Every grouping is by (model, metric) or (id, metric) with algebraic
aggregates; the per-model tables are bounded by models x metrics, so their
ranking window is tiny."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("A is better", "B is better", "Same good", "Same bad")


def candidate_scores(rows: DataFrame, keys=("id", "split")) -> DataFrame:
    """Source rows with ``candidates`` exploded to ``keys, model, metric, score`` (one row per candidate and metric)."""
    one = rows.select(*keys, F.explode("candidates").alias("c"))
    return one.select(*keys, F.col("c.model").alias("model"), F.explode("c.scores").alias("metric", "score"))


def metric_means(scores: DataFrame, by=()) -> DataFrame:
    """G1: mean score per (model, metric) and ``by`` (e.g. the split) over all candidates (NULL skipped)."""
    return scores.groupBy(*by, "model", "metric").agg(F.avg("score").alias("mean_score"))


def best_models(means: DataFrame) -> DataFrame:
    """Per metric the model with the highest mean (ties: smallest name)."""
    w = Window.partitionBy("metric").orderBy(F.desc("mean_score"), F.asc("model"))
    return (means.withColumn("_r", F.row_number().over(w)).where("_r = 1")
                 .select("metric", F.col("model").alias("best_model"), F.col("mean_score").alias("best_mean")))


def oracle_scores(scores: DataFrame, best: DataFrame) -> DataFrame:
    """Mean over examples of the best candidate's score, and its gap to the best model."""
    per_example = scores.groupBy("id", "metric").agg(F.max("score").alias("best_candidate"))
    oracle = per_example.groupBy("metric").agg(F.avg("best_candidate").alias("oracle_mean"))
    return oracle.join(F.broadcast(best), "metric").select(
        "metric", "oracle_mean", (F.col("oracle_mean") - F.col("best_mean")).alias("gap"))


def encode_comparisons(wide: DataFrame, models, value_fmt: str = "avg_normalized_score_{m}") -> DataFrame:
    """Pairwise outcome map per example as the JSON string the raw rows carry
    (``"A,B" -> "A is better" | "B is better" | "Same good" | "Same bad"``)."""
    entries = []
    for i, a in enumerate(models):
        for b in models[i + 1:]:
            va, vb = F.col(value_fmt.format(m=a)), F.col(value_fmt.format(m=b))
            out = (F.when(va > vb, F.lit(OUTCOMES[0])).when(va < vb, F.lit(OUTCOMES[1]))
                    .when(va >= F.lit(0.5), F.lit(OUTCOMES[2])).otherwise(F.lit(OUTCOMES[3])))
            entries += [F.lit(f"{a},{b}"), out]
    return wide.select("id", F.to_json(F.create_map(*entries)).alias("cmp_results"))


def pairwise_win_rates(cmp: DataFrame, col: str = "cmp_results") -> DataFrame:
    """Decode the JSON map and aggregate outcome rates per model pair (rows without comparisons count nowhere)."""
    kv = cmp.select(F.explode(F.from_json(F.col(col), "map<string,string>")).alias("pair", "outcome"))
    parts = F.split("pair", ",")
    return win_rates(kv.select(parts.getItem(0).alias("model_a"), parts.getItem(1).alias("model_b"), "outcome"))


def win_rates(compared: DataFrame) -> DataFrame:
    """Outcome rates per model pair of ``compared(model_a, model_b, outcome)``."""
    return (compared.groupBy("model_a", "model_b")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 *[F.avg((F.col("outcome") == o).cast("double")).alias(name)
                   for o, name in zip(OUTCOMES, ("a_win_rate", "b_win_rate", "same_good_rate", "same_bad_rate"))]))
