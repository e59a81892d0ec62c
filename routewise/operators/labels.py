"""Ground-truth "cheapest adequate model" labels.

The nine-case ordered decision list is one SQL ``CASE`` expression over the
wide per-query row; the same text runs in Spark (``F.expr``) and in the DuckDB
oracle.  First match wins; the inner conditions of cases 5 and 7 have no
else branch, so a failed speed/length check falls through to the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..config import LabelThresholds
from . import rowindex

CASE_LABELS = {"case_1": 3, "case_2": 3, "case_3": 1, "case_4": 1, "case_5": 1, "case_6": 2,
               "case_7": 1, "case_8": 2, "case_default": 3}


def _num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def case_sql(dt: str | float = 0.0, th: LabelThresholds = LabelThresholds()) -> str:
    """The decision list as SQL text; ``dt`` may be a literal or a column name."""
    dt = dt if isinstance(dt, str) else f"({_num(dt)})"
    tt, rt, b, lb = th.trash_count, th.repetition_count, _num(th.runtime_buffer), _num(th.length_buffer)
    T = {m: f"r_t5_{m}_trash_count" for m in config.MODEL_SHORT}
    R = {m: f"r_t5_{m}_query_repetition_count" for m in config.MODEL_SHORT}
    RT = {m: f"rt_t5_{m}_avg" for m in config.MODEL_SHORT}
    LN = {m: f"r_t5_{m}_length_avg" for m in config.MODEL_SHORT}
    d12, d23, d13 = "discrepancy_base_vs_large", "discrepancy_large_vs_xl", "discrepancy_base_vs_xl"
    g5 = (f"{T['base']} < {tt} AND {T['large']} < {tt} AND {T['xl']} < {tt} AND {d12} < 0 AND {d23} >= 0 "
          f"AND {R['large']} < {rt}")
    g7 = (f"{T['xl']} < {tt} AND {T['large']} < {tt} AND {T['base']} < {tt} AND {d23} < 0 AND {d12} < 0 "
          f"AND {R['xl']} < {rt} AND {R['large']} < {rt} AND {R['base']} < {rt}")
    close5 = f"{d12} >= {dt} AND {R['base']} < {rt}"
    return f"""CASE
  WHEN {T['base']} >= {tt} AND {T['large']} >= {tt} AND {T['xl']} >= {tt} THEN 'case_1'
  WHEN {T['xl']} >= {tt} OR {T['large']} >= {tt} THEN 'case_2'
  WHEN {d12} = 0 AND {d23} = 0 AND {d13} = 0 AND {T['base']} < {tt} THEN 'case_3'
  WHEN {T['base']} < {tt} AND {d12} >= 0 AND {d13} >= 0 AND {R['base']} < {rt} THEN 'case_4'
  WHEN ({g5}) AND ({close5}) AND {RT['base']} <= {RT['large']} * {b} AND {LN['base']} <= {LN['large']} * {lb} THEN 'case_5'
  WHEN ({g5}) AND NOT ({close5}) THEN 'case_6'
  WHEN ({g5}) THEN 'case_default'
  WHEN ({g7}) AND {d13} >= {dt} AND {RT['base']} <= {RT['xl']} * {b} AND {LN['base']} <= {LN['xl']} * {lb} THEN 'case_7'
  WHEN ({g7}) AND NOT ({d13} >= {dt}) AND {d23} >= {dt} AND {RT['large']} <= {RT['xl']} * {b} AND {LN['large']} <= {LN['xl']} * {lb} THEN 'case_8'
  ELSE 'case_default' END"""


def label_sql(case_col: str = "label_case") -> str:
    whens = " ".join(f"WHEN '{c}' THEN {lbl}" for c, lbl in CASE_LABELS.items())
    return f"(CASE {case_col} {whens} END)"


def with_label(wide: DataFrame, dt: float = 0.0, th: LabelThresholds = LabelThresholds()) -> DataFrame:
    """L1: ``label_case`` and ``evaluation_model_label`` for one threshold."""
    return (wide.withColumn("label_case", F.expr(case_sql(dt, th)))
                .withColumn("evaluation_model_label", F.expr(label_sql()).cast("int")))


def threshold_name(dt: float) -> str:
    """File-name style of a discrepancy threshold: ``t0``, ``t-0.005``."""
    return f"t{dt:g}"


def with_label_sweep(wide: DataFrame, thresholds=config.DISCREPANCY_THRESHOLDS,
                     th: LabelThresholds = LabelThresholds()) -> DataFrame:
    """L2: one row per (query, threshold) from a single pass: the thresholds
    are a literal array fanned out by ``inline`` (a generator, not a join)."""
    grid = F.array(*[F.struct(F.lit(threshold_name(t)).alias("t_threshold"), F.lit(float(t)).alias("dt"))
                     for t in thresholds])
    return (wide.select("*", F.inline(grid))
                .withColumn("label_case", F.expr(case_sql("dt", th)))
                .withColumn("evaluation_model_label", F.expr(label_sql()).cast("int")))


def to_wide(per_model: DataFrame, values, key: str = "id") -> DataFrame:
    """Pivot (id, model) rows to the study's wide names, e.g. ``trash_count`` ->
    ``r_t5_base_trash_count``; one aggregate with explicit model values."""
    names = {"trash_count": "r_{m}_trash_count", "query_repetition_count": "r_{m}_query_repetition_count",
             "rt_avg": "rt_{m}_avg", "length_avg": "r_{m}_length_avg", "redundancy_avg": "r_{m}_redundancy_avg",
             "avg_normalized_score": "avg_normalized_score_{m}"}
    aggs = [F.max(F.when(F.col("model") == m, F.col(v))).alias(names.get(v, v + "_{m}").format(m=m))
            for v in values for m in config.MODELS]
    return per_model.groupBy(key).agg(*aggs)


def case_distribution(labelled: DataFrame, by=("t_threshold",)) -> DataFrame:
    """Count per labelling case; the id list stays a (case, id) table."""
    return labelled.groupBy(*by, "label_case").agg(F.count(F.lit(1)).alias("n"))


def label_distribution(labelled: DataFrame, value: str = "query_complexity_score", label: str = "evaluation_model_label") -> DataFrame:
    """Count, mean and median of ``value`` per label, ordered by label.

    The median is exact: grouped order statistics (two scans), so
    no group's values are sorted or mapped in a single task; the median table
    has one row per label (bounded by the label set) and is broadcast."""
    stats = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"))
    meds = rowindex.grouped_quantiles(labelled, label, value, [0.5])
    spark = labelled.sparkSession
    med_df = spark.createDataFrame([(g if g is None else int(g), float(v)) for (g, _), v in meds.items()],
                                   "_label int, median_value double")
    # null-safe: rows without a label form a group of their own
    return (stats.join(F.broadcast(med_df), stats[label].eqNullSafe(med_df["_label"]), "left").drop("_label").orderBy(label))
