"""Text reports of the routing sweep and their parser.

A8 renders one report per discrepancy threshold as numbered lines (a tidy
``(t_threshold, line_no, line)`` table that ``write.text`` can store).  A7
reads such lines back: the current probability-threshold header is carried
forward with ``last(..., ignorenulls)`` over a window partitioned by report,
numbers are pulled out with ``regexp_extract``, and one row per grid cell
comes out of a single aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Metric line labels of the evaluation report, in report order.
REPORT_LINES = [
    ("quality_loss_gt", "Quality Loss compared to GT: {}%"),
    ("quality_loss_xl", "Quality Loss compared to XL: {}%"),
    ("compute_savings_gt", "Compute Savings compared to GT: {}%"),
    ("compute_savings_xl", "Compute Savings compared to XL: {}%"),
    ("routing_accuracy", "Routing Accuracy: {}%"),
    ("compute_units", "Total Compute Units Used: {} CUs"),
]
COUNT_LINES = [
    ("n_base", "Number of queries routed to Base: {}"),
    ("n_large", "Number of queries routed to Large: {}"),
    ("n_xl", "Number of queries routed to XL: {}"),
]
HEADER = "--- Evaluating Model for t-threshold: {} ---"
PROB_HEADER = "Evaluating Probability Threshold: {}"


FILTERED = "Filtered out the top {}% most complex queries."
REMOVED = "Total queries removed: {}. Remaining for training/testing: {}."
SPLIT = "Final split: {} queries for training, {} queries for testing."
AVG_MAX = "Average Maximum Probability per Query: {}"
TEST_HEADER = "--- Testing Model for t-threshold: {} ---"
LOADED = "Loaded {} queries for testing."
TEST_TITLE = "EVALUATION MODEL EVALUATION"
LABEL_ACCURACY = "Model Label Prediction Accuracy: {}%"
CLASS_TITLE = "Classification Report:"


@dataclass(frozen=True)
class SplitSizes:
    """Rows removed by the complexity filter, and train and test rows of the rest."""

    n_removed: int
    n_train: int
    n_test: int
    percent_removed: int = 20


def split_sizes(marked: DataFrame, percent_removed: int = 20) -> SplitSizes:
    """Sizes of a table with ``is_kept`` and ``is_train`` (one aggregate)."""
    r = marked.agg(F.count_if(~F.col("is_kept")).alias("a"), F.count_if(F.col("is_train")).alias("b"),
                   F.count_if(F.col("is_kept") & ~F.col("is_train")).alias("c")).first()
    return SplitSizes(r["a"], r["b"], r["c"], percent_removed)


def render_sweep_head(avg_max: DataFrame, sizes: SplitSizes) -> DataFrame:
    """What the sweep report says before its cells, per row of ``avg_max(t_threshold, avg_max_proba)``."""
    lines = F.array(F.lit(FILTERED.format(sizes.percent_removed)), F.lit(SPLIT.format(sizes.n_train, sizes.n_test)),
                    # ties of the last place are rounded up whatever the double below them
                    F.format_string(AVG_MAX.replace("{}", "%.4f"), F.round(F.col("avg_max_proba") + 1e-9, 4)))
    return avg_max.select("t_threshold", F.posexplode(lines).alias("k", "line")).select("t_threshold", (F.col("k") + 1).alias("line_no"), "line")


def render_testing_report(classes: DataFrame, sizes: SplitSizes) -> DataFrame:
    """``(t_threshold, line_no, line)`` of the testing report from ``classes(t_threshold, class,
    precision, recall, f1, support)`` with its summary rows (E4): sizes, label accuracy, then one line per class."""
    two = lambda c: F.round(F.col(c) + 1e-9, 2)
    acc = classes.where(F.col("class") == "accuracy").select("t_threshold", "f1")
    head = F.array(F.format_string(TEST_HEADER.replace("{}", "%s"), "t_threshold"), F.lit(FILTERED.format(sizes.percent_removed)),
                   F.lit(REMOVED.format(sizes.n_removed, sizes.n_train + sizes.n_test)), F.lit(SPLIT.format(sizes.n_train, sizes.n_test)),
                   F.lit(LOADED.format(sizes.n_test)), F.lit(TEST_TITLE),
                   F.format_string(LABEL_ACCURACY.replace("%", "%%").replace("{}", "%.2f"), F.round(F.col("f1") * 100 + 1e-9, 2)), F.lit(CLASS_TITLE))
    top = acc.select("t_threshold", F.posexplode(head).alias("line_no", "line"))
    order = F.when(F.col("class") == "accuracy", 1).when(F.col("class") == "macro avg", 2).when(F.col("class") == "weighted avg", 3).otherwise(0)
    text = F.when(F.col("class") == "accuracy", F.format_string("%s %.2f %d", "class", two("f1"), "support")).otherwise(
        F.format_string("%s %.2f %.2f %.2f %d", "class", two("precision"), two("recall"), two("f1"), "support"))
    place = Window.partitionBy("t_threshold").orderBy(order, "class")  # a line per class
    body = classes.select("t_threshold", (F.row_number().over(place) + 7).alias("line_no"), text.alias("line"))
    return top.unionByName(body)


def render_sweep_report(card: DataFrame) -> DataFrame:
    """Sweep rows -> ``(t_threshold, line_no, line)``; numbers with 2 decimals."""
    lines = [F.format_string(PROB_HEADER.replace("{}", "%.1f"), F.col("prob_threshold"))]
    lines += [F.format_string(tpl.replace("%", "%%").replace("{}", "%.2f"), F.round(F.col(c), 2)) for c, tpl in REPORT_LINES]
    lines += [F.format_string(tpl.replace("{}", "%d"), F.col(c)) for c, tpl in COUNT_LINES]
    per_cell = card.select("t_threshold", "prob_threshold", F.posexplode(F.array(*lines)).alias("k", "line"))
    body = per_cell.select("t_threshold", (F.round(F.col("prob_threshold") * 10).cast("int") * 100 + F.col("k") + 10)
                           .alias("line_no"), "line")
    heads = card.select("t_threshold").distinct().select(
        "t_threshold", F.lit(0).alias("line_no"), F.format_string(HEADER.replace("{}", "%s"), "t_threshold").alias("line"))
    return heads.unionByName(body)


def write_report(lines: DataFrame, path: str, report: str = "t_threshold") -> None:
    """One text file per report, lines in order (a report is a few dozen lines)."""
    (lines.withColumn("__r", F.col(report)).repartition("__r").sortWithinPartitions("__r", "line_no")
          .select("__r", "line").write.mode("overwrite").partitionBy("__r").text(path))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Report files as ``(report, line_no, line)``: whole files, so their lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report"), "value")
    return files.select("report", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("line <> ''")


def render_case_report(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """``(report, line_no, line)`` of the labelling report: count per case (the id
    lists stay a table), then count, mean and median complexity per label."""
    head = cases.select(F.col("t_threshold").alias("report"), F.lit(0).cast("bigint").alias("_o"), F.lit(0).alias("_k"),
                        F.format_string("%s: %d", "label_case", "n").alias("line"), F.lit(0).alias("_part"))
    mid = cases.select(F.col("t_threshold").alias("report")).distinct().select(
        "report", F.lit(0).cast("bigint").alias("_o"), F.lit(0).alias("_k"), F.lit("Total Label Counts and Complexity Scores:").alias("line"),
        F.lit(1).alias("_part"))
    texts = F.array(F.format_string("Label %d: %d", "evaluation_model_label", "n"),
                    # ties of the last place are rounded up whatever the double below them
                    F.format_string("Average complexity score: %.4f", F.round(F.col("avg_value") + 1e-9, 4)),
                    F.format_string("Median complexity score: %.4f", F.round(F.col("median_value") + 1e-9, 4)))
    tail = labels.select(F.col("t_threshold").alias("report"), F.col("evaluation_model_label").cast("bigint").alias("_o"),
                         F.posexplode(texts).alias("_k", "line")).withColumn("_part", F.lit(2))
    every = head.unionByName(mid).unionByName(tail)
    place = Window.partitionBy("report").orderBy("_part", "_o", "_k", "line")
    return every.select("report", F.row_number().over(place).alias("line_no"), "line")


def parse_sweep_report(lines: DataFrame) -> DataFrame:
    """Report lines ``(report, line_no, line)`` -> one row per (t_threshold, prob_threshold);
    both thresholds come from the header lines alone."""
    num = r"(-?[0-9]+(?:\.[0-9]+)?)"
    w = Window.partitionBy("report").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    t = F.nullif(F.regexp_extract("line", r"^--- Evaluating Model for t-threshold: (\S+) ---$", 1), F.lit(""))
    p = F.nullif(F.regexp_extract("line", r"^Evaluating Probability Threshold: " + num + "$", 1), F.lit(""))
    filled = (lines.withColumn("t_cur", F.last(t, ignorenulls=True).over(w))
                   .withColumn("p_cur", F.last(p, ignorenulls=True).over(w)))
    aggs = []
    for c, tpl in REPORT_LINES + COUNT_LINES:
        prefix = tpl.split("{}")[0]
        val = F.regexp_extract("line", "^" + prefix.replace("(", r"\(").replace(")", r"\)") + num, 1)
        aggs.append(F.max(F.when(F.col("line").startswith(prefix), val)).alias(c))
    g = filled.where(F.col("p_cur").isNotNull()).groupBy(F.col("t_cur").alias("t_threshold"),
                                                          F.col("p_cur").cast("double").alias("prob_threshold")).agg(*aggs)
    casts = {c: F.col(c).cast("double") for c, _ in REPORT_LINES}
    casts.update({c: F.col(c).cast("bigint") for c, _ in COUNT_LINES})
    return g.withColumns(casts)
