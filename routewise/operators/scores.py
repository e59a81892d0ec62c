"""Score merge, averages, ranges, normalization and discrepancies.

Scores are long: ``(id, model, resp_no, metric, score)``, a complete grid as
produced by the template + merge (C1); a NULL score means "not scored".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numeric import normalize_metric

SCORE_KEY = ["id", "model", "resp_no", "metric"]


def merge_scores(template: DataFrame, files: DataFrame, key=SCORE_KEY, default: float = 0.0, last_values=None) -> DataFrame:
    """Overwrite template defaults with score-file rows of the same key.

    ``files`` has ``key + [score, row_idx]``; for duplicate keys the row with
    the highest ``row_idx`` (the last line) wins, NULL included.  Keys only in
    the files are dropped.  One union + one aggregate (``max_by`` is a
    partial-aggregatable function, so a hot key costs one row per map task).
    ``last_values``: all values that the template has in the last key column (e.g. the
    metrics), if known; then one row holds all of them while it is exchanged.
    """
    lines = score_lines(template, key, default).unionByName(score_lines(files, key))
    return merge_lines(lines, key) if last_values is None else _merge_wide(lines, list(key), last_values)


def _merge_aggregates(score: Column, line: Column, template: Column) -> list[Column]:
    """Of the lines of one key: in the template?, last line number, its score, the default."""
    return [F.bool_or(template), F.max(line), F.max_by(score, line), F.max(F.when(template, score))]


def _merge_wide(lines: DataFrame, key: list, last_values) -> DataFrame:
    """C1 grouped by all but the last key column, with the aggregates of each of its values side by side."""
    *keys, last = key
    names, aggs = ("in_template", "last", "file", "default"), []
    for k, v in enumerate(last_values):
        here = F.col(last) == F.lit(v)
        cols = _merge_aggregates(F.when(here, F.col("score")), F.when(here, F.col("line")), here & F.col("line").isNull())
        aggs += [c.alias(f"_{n}_{k}") for n, c in zip(names, cols)]
    each = F.array(*[F.struct(F.lit(v).alias(last), *[F.col(f"_{n}_{k}").alias(f"_{n}") for n in names]) for k, v in enumerate(last_values)])
    g = lines.groupBy(*keys).agg(*aggs).select(*keys, F.inline(each))
    return g.where("_in_template").select(*key, F.when(F.col("_last").isNotNull(), F.col("_file")).otherwise(F.col("_default")).alias("score"))


def score_lines(rows: DataFrame, key=SCORE_KEY, default: float | None = None) -> DataFrame:
    """Template rows (with ``default``) or score-file rows as lines of one table: ``key, score, line`` (no line: template)."""
    if default is None:
        return rows.select(*key, F.col("score").cast("double").alias("score"), F.coalesce(F.col("row_idx").cast("bigint"), F.lit(-2**63)).alias("line"))
    return rows.select(*key, F.lit(default).cast("double").alias("score"), F.lit(None).cast("bigint").alias("line"))


def merge_lines(lines: DataFrame, key=SCORE_KEY) -> DataFrame:
    """C1 over one table of template and file lines: one aggregate, of plain numbers alone, so that
    it hashes its keys (a struct as aggregate would have all lines sorted before and behind the exchange)."""
    template = F.col("line").isNull()
    names = ("_in_template", "_last", "_file", "_default")
    g = lines.groupBy(*key).agg(*[c.alias(n) for n, c in zip(names, _merge_aggregates(F.col("score"), F.col("line"), template))])
    return (g.where("_in_template")
             .select(*key, F.when(F.col("_last").isNotNull(), F.col("_file"))
                     .otherwise(F.col("_default")).alias("score")))


def score_averages(scores: DataFrame, n: int = config.RESPONSES_PER_MODEL, keep_absent: bool = True) -> DataFrame:
    """``sum(non-null scores) / n`` per (id, model, metric); NULL = absent
    (every score NULL).  ``keep_absent=False`` drops absent metrics."""
    avg = scores.groupBy("id", "model", "metric").agg((F.sum("score") / F.lit(float(n))).alias("avg_score"))
    return avg if keep_absent else avg.where(F.col("avg_score").isNotNull())


def metric_ranges(avgs: DataFrame, metrics=config.METRICS) -> DataFrame:
    """D3: one row, ``<metric>_min`` / ``<metric>_max`` over all models; an
    absent metric counts as 0 (the grid is complete, absent = NULL)."""
    v = F.coalesce(F.col("avg_score"), F.lit(0.0))
    aggs = []
    for m in metrics:
        sel = F.when(F.col("metric") == m, v)
        aggs += [F.min(sel).alias(f"{m}_min"), F.max(sel).alias(f"{m}_max")]
    return avgs.agg(*aggs)


def normalized_scores(avgs: DataFrame, ranges: DataFrame | None = None, metrics=config.METRICS) -> DataFrame:
    """Normalized average per (id, model, metric).  The 18 range values
    come from one global aggregate (a single row, fetched once) and enter the
    projection as literals, not as a join."""
    ranges = ranges if ranges is not None else metric_ranges(avgs, metrics)
    r = {k: F.lit(v) for k, v in ranges.first().asDict().items()}
    expr: Column | None = None
    for m in metrics:
        branch = normalize_metric(F.col("avg_score"), m, r[f"{m}_min"], r[f"{m}_max"])
        expr = F.when(F.col("metric") == m, branch) if expr is None else expr.when(F.col("metric") == m, branch)
    return avgs.withColumn("norm_score", F.when(F.col("avg_score").isNotNull(), expr))


def avg_normalized(norm: DataFrame, n_metrics: int = len(config.METRICS)) -> DataFrame:
    """``round(sum(present normalized metrics) / 9, 4)`` per (id, model); no metric -> 0.0."""
    return norm.groupBy("id", "model").agg(
        F.round(F.coalesce(F.sum("norm_score"), F.lit(0.0)) / F.lit(float(n_metrics)), 4).alias("avg_normalized_score"))


def discrepancies(per_model: DataFrame, value: str = "avg_normalized_score") -> DataFrame:
    """Pivot the three models and take rounded differences
    (negative = the smaller model is worse)."""
    wide = per_model.groupBy("id").agg(*[F.max(F.when(F.col("model") == m, F.col(value))).alias(f"{value}_{m}")
                                         for m in config.MODELS])
    return with_discrepancies(wide, value)


def with_discrepancies(wide: DataFrame, value: str = "avg_normalized_score") -> DataFrame:
    b, l, x = (F.col(f"{value}_{m}") for m in config.MODELS)
    return wide.withColumns({
        "discrepancy_base_vs_large": F.round(b - l, 4),
        "discrepancy_large_vs_xl": F.round(l - x, 4),
        "discrepancy_base_vs_xl": F.round(b - x, 4),
    })


def id_alignment_mismatches(a: DataFrame, b: DataFrame, key: str = "row_idx") -> DataFrame:
    """Rows whose id differs (or is missing) at the same position; the
    caller raises when the count is non-zero (``assert_aligned``)."""
    j = a.select(key, F.col("id").alias("id_a")).join(b.select(key, F.col("id").alias("id_b")), key, "full_outer")
    return j.where(~F.col("id_a").eqNullSafe(F.col("id_b")))


def assert_aligned(a: DataFrame, b: DataFrame, key: str = "row_idx") -> None:
    n = id_alignment_mismatches(a, b, key).count()
    if n:
        raise ValueError(f"model tables are not aligned: {n} positions differ")
