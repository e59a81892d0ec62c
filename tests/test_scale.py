"""Steps whose work must stay in proportion to the input, whatever its layout."""

import random
import re

import pytest
from pyspark.sql import functions as F

from routewise.functions import text as T
from routewise.functions import wordstats as W
from routewise.operators import models as MD
from routewise.operators import responses as RS
from routewise.operators import scores as SC
from routewise.operators import textmetrics as TM
from routewise.session import scratch_path
from routewise.sources import fixtures as FX

SPACES = "".join(c for c in map(chr, range(0x3100)) if re.match(f"[{W.WHITE_SPACE}]", c))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark):
    """Many splits, but all rows lie in the one that holds the row group."""
    path = scratch_path(spark, "one-group")
    spark.range(4_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [n for n in FX.spread(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert sum(sizes) == 4_000 and max(sizes) <= 1.2 * 4_000 / spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_even_scans_stay_where_they_are(spark):
    par = spark.sparkContext.defaultParallelism
    path = scratch_path(spark, "even")
    spark.range(1_000, numPartitions=4 * par).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Exchange" not in plan(FX.spread(spark.read.parquet(path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert FX.spread(spark.read.parquet(path).where("id < 0")).count() == 0


def test_strip_and_blank_without_a_pattern_over_the_text(spark):
    rng = random.Random(5)
    texts = [None, "", *SPACES, "\x1c", "​", *("".join(rng.choice(SPACES + "\x1c​aß\U0001f600") for _ in range(rng.randint(1, 9))) for _ in range(500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.ustrip("t").alias("s"), T.is_blank("t").alias("b"))
    assert "regexp" not in plan(df)
    strip = re.compile(f"\\A[{W.WHITE_SPACE}]+|[{W.WHITE_SPACE}]+\\Z")
    for r in df.collect():
        want = strip.sub("", r["t"] or "")
        assert (r["s"], r["b"]) == (want, want == "")


def test_score_merge_hashes_its_lines(spark):
    tpl = spark.createDataFrame([("a", "m", 1, "x"), ("b", "m", 1, "x"), ("c", "m", 1, "x")], "id string, model string, resp_no int, metric string")
    files = spark.createDataFrame([("a", "m", 1, "x", 1.0, 1), ("a", "m", 1, "x", None, 2), ("b", "m", 1, "x", None, 1), ("b", "m", 1, "x", 2.0, None),
                                   ("d", "m", 1, "x", 3.0, 1)], "id string, model string, resp_no int, metric string, score double, row_idx bigint")
    m = SC.merge_scores(tpl, files)
    assert "SortAggregate" not in plan(m)
    assert {r["id"]: r["score"] for r in m.collect()} == {"a": None, "b": None, "c": 0.0}


def test_wide_score_merge_gives_the_same_lines(spark):
    rng = random.Random(8)
    pick = lambda: (rng.choice([None, "a", "b", "c"]), rng.choice("mn"), rng.randint(1, 2), rng.choice("xyz"))
    key = "id string, model string, resp_no int, metric string"
    tpl = spark.createDataFrame([k for k in (pick() for _ in range(40)) if k[3] != "z"], key)
    lines = [(*pick(), rng.choice([None, 0.0, -1.5, 2.0]), i if i % 9 else None) for i in range(60)]
    files = spark.createDataFrame([r for r in lines if r[5] is not None], key + ", score double, row_idx bigint")
    a, b = SC.merge_scores(tpl, files), SC.merge_scores(tpl, files, last_values=["x", "y"])
    assert "SortAggregate" not in plan(b) and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_candidates_are_built_in_the_row(spark):
    q = spark.createDataFrame([(1, "doc/1"), (43, "doc/43"), (43, "doc/43"), (None, None)], "doc_id bigint, id string")
    c = FX.with_candidates(q)
    assert "Exchange" not in plan(c) and "Aggregate" not in plan(c)
    got = c.select("doc_id", "split", F.explode("candidates").alias("c")).select("doc_id", "split", "c.model", F.explode("c.scores").alias("metric", "score"))
    want = FX._per_model(q).select("*", F.inline(FX._slots_col())).select("*", F.inline(FX._metrics_col())).select(
        "doc_id", F.expr(FX._SPLIT).alias("split"), "model", "metric", F.expr(FX._S_SCORE).alias("score"))
    assert got.count() == 4 * 270 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def _plain_lcs(ref, cand):
    table = [[0] * (len(cand) + 1) for _ in range(len(ref) + 1)]
    for i, x in enumerate(ref):
        for j, y in enumerate(cand):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(ref), len(cand), []
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            i, j, out = i - 1, j - 1, [i - 1, *out]
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_lcs_with_known_masks_takes_the_same_path():
    rng = random.Random(3)
    for _ in range(3_000):
        ref, cand = ([rng.choice("abcdef"[:rng.randint(1, 6)]) for _ in range(rng.randint(0, 10))] for _ in range(2))
        want = _plain_lcs(ref, cand)
        assert TM.lcs_indices(ref, cand) == TM.lcs_indices(ref, cand, TM._masks(cand)) == want
        assert TM.lcs_length(ref, cand) == TM.lcs_length(ref, cand, TM._masks(ref)) == len(want)


def test_lengths_are_counted_alone(spark):
    texts = [None, "", " ", "a b  a", "x\x1cy z", "é ü​ö", "\x1d \x1e"]
    df = spark.createDataFrame([(f"q{i}", "m", 1, t) for i, t in enumerate(texts)], "id string, model string, resp_no int, response string")
    full, alone = (RS.response_rows(df, with_redundancy=w).select("id", "length", "is_blank") for w in (True, False))
    assert sorted(full.collect()) == sorted(alone.collect()) and "redundancy" not in RS.response_rows(df, with_redundancy=False).columns
    got = df.select(W.word_stats("response").alias("w")).select("w.*").collect()
    assert [(r["length"], r["distinct"]) for r in got] == [(0, 0), (0, 0), (0, 0), (3, 2), (2, 2), (2, 2), (2, 2)]
    assert got[3]["repeated"] == 0.0 and got[4]["repeated"] == pytest.approx(0.0)


def test_forest_rows_are_tokenized_once(spark):
    rows = spark.createDataFrame([(f"r{i}", f"word{i % 3} other", float(i), i % 3 + 1) for i in range(60)], "id string, query string, x double, evaluation_model_label int")
    f = MD.router_features(rows, "query", ["x"], 20)
    assert "UDF" not in plan(f.rows) and f.rows.count() == 60 and "query" not in f.rows.columns
    cfg = MD.ForestConfig(num_trees=3, max_depth=3)
    a = MD.fit_router_forest(f, f.rows, cfg=cfg).transform(rows).select("id", "proba_xl").collect()
    assert sorted(a) == sorted(MD.fit_label_router(rows, "query", ["x"], k=20, cfg=cfg).transform(rows).select("id", "proba_xl").collect())
