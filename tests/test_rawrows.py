"""Raw JSON lines through VARIANT columns."""

import json

from pyspark.sql import functions as F

from routewise.operators import leaderboard as LBD
from routewise.session import scratch_path
from routewise.sources import rawrows as RR

ROWS = [
    {"id": "a", "split": "train", "candidates": [
        {"model": "m1", "scores": {"bart": -1.5, "new metric": 3, "it's": 2}}, {"model": "m2", "scores": {"bart": None}}, {"model": "m1"}],
     "cmp_results": json.dumps({"m1,m2": "A is better"})},
    {"id": "b", "split": "test", "candidates": [], "cmp_results": {"m1,m2": "B is better", "m1,m3": "Same good"}},
    {"id": "c", "candidates": [{"model": "m1", "scores": {"bart": "text", "nested": {"x": 1}}}], "cmp_results": None},
    {"id": "d", "extra": [1, {"y": None}], "cmp_results": "no json"},
    {},
]


def _lines(spark):
    path = scratch_path(spark, "raw-test")
    spark.createDataFrame([(json.dumps(r),) for r in ROWS] + [("{broken",), ("",), ("3",)], "value string").coalesce(1).write.text(path)
    return RR.read_lines(spark, path)


def test_raw_lines_are_kept_as_they_are(spark):
    rows = _lines(spark)
    assert rows.count() == len(ROWS) + 3
    assert {r["rejected"] for r in rows.where("row is null").collect()} == {"{broken", ""}


def test_candidate_scores_take_whatever_keys_there_are(spark):
    got = sorted(map(tuple, RR.candidate_scores(_lines(spark)).collect()), key=str)
    assert got == sorted([("a", "train", "m1", "bart", -1.5), ("a", "train", "m1", "new metric", 3.0), ("a", "train", "m1", "it's", 2.0),
                          ("a", "train", "m2", "bart", None), ("c", None, "m1", "bart", None), ("c", None, "m1", "nested", None)], key=str)


def test_scores_by_key_with_a_default(spark):
    c = RR.candidates(_lines(spark), ("id",))
    got = [tuple(r) for r in c.select("id", "resp_no", RR.score_or_default("scores", "bart").alias("b"),
                                      RR.score_or_default("scores", "new metric", 7.0).alias("n")).orderBy("id", "resp_no").collect()]
    assert got == [("a", 0, -1.5, 3.0), ("a", 1, 0.0, 7.0), ("a", 2, 0.0, 7.0), ("c", 0, 0.0, 7.0)]


def test_comparisons_as_text_or_object(spark):
    got = sorted(map(tuple, RR.comparisons(_lines(spark)).collect()))
    assert got == [("a", "m1", "m2", "A is better"), ("b", "m1", "m2", "B is better"), ("b", "m1", "m3", "Same good")]
    rates = {(r["model_a"], r["model_b"]): r["n"] for r in LBD.win_rates(RR.comparisons(_lines(spark))).collect()}
    assert rates == {("m1", "m2"): 2, ("m1", "m3"): 1}


def test_raw_lines_plan_is_native(spark):
    p = RR.candidate_scores(_lines(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p and "Exchange" not in p
    assert RR.candidate_scores(_lines(spark).where(F.lit(False))).count() == 0
