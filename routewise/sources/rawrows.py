"""Raw source rows as JSON lines, read through VARIANT columns.

A raw row carries its sampled ``candidates`` (per response the model and an object of
metric scores) and its pairwise comparisons ``cmp_results`` (an object, or an object
written as a string).  Keys come and go: a score that was never computed has no key, a
row may have no comparisons at all, a later metric appears without notice.  A fixed
struct or map type would have to name or convert them all; VARIANT keeps every line as
it is and takes values by path, with a default where a key is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per row; NULL fields and NULL map values are left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row`` (VARIANT) of every line; a line that is no JSON keeps a NULL ``row`` and its text in ``rejected``."""
    raw = spark.read.text(path).select("value", F.try_parse_json("value").alias("row"))
    return raw.select("row", F.when(F.col("row").isNull(), F.col("value")).alias("rejected"))


def value_at(v, path: str, type_: str = "string") -> Column:
    """The value under a path, NULL where the key is absent or of another type."""
    return F.try_variant_get(v, path, type_)


def score_or_default(scores, metric, default: float = 0.0) -> Column:
    """``scores.get(metric, default)`` on a VARIANT object; a JSON null counts as absent."""
    path = f"$['{metric}']"
    return F.coalesce(F.try_variant_get(scores, path, "double"), F.lit(float(default)))


def candidates(rows: DataFrame, keys=("id", "split")) -> DataFrame:
    """``keys, resp_no, model, scores`` (VARIANT): one row per candidate of every line."""
    each = rows.select(*[value_at("row", f"$.{k}").alias(k) for k in keys],
                       F.posexplode(F.try_variant_get("row", "$.candidates", "array<variant>")).alias("resp_no", "c"))
    return each.select(*keys, "resp_no", value_at("c", "$.model").alias("model"), F.try_variant_get("c", "$.scores", "variant").alias("scores"))


def candidate_scores(rows: DataFrame, keys=("id", "split")) -> DataFrame:
    """``keys, model, metric, score``: one row per candidate and metric key that its scores hold."""
    c = candidates(rows, keys)
    kv = c.select(*keys, "model", F.explode(F.try_variant_get("scores", "$", "map<string,variant>")).alias("metric", "v"))
    return kv.select(*keys, "model", "metric", F.try_variant_get("v", "$", "double").alias("score"))


def comparisons(rows: DataFrame) -> DataFrame:
    """``id, model_a, model_b, outcome`` of every compared pair; rows without comparisons give none."""
    as_text = F.try_parse_json(value_at("row", "$.cmp_results"))
    as_object = F.try_variant_get("row", "$.cmp_results", "map<string,string>")
    pairs = F.coalesce(F.try_variant_get(as_text, "$", "map<string,string>"), as_object)
    kv = rows.select(value_at("row", "$.id").alias("id"), F.explode(pairs).alias("pair", "outcome"))
    names = F.split("pair", ",")
    return kv.select("id", names.getItem(0).alias("model_a"), names.getItem(1).alias("model_b"), "outcome")
