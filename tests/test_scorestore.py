"""The bucketed score store and the vocabulary by heavy hitters."""

import random

import pytest
from pyspark.sql import functions as F

from routewise import config
from routewise.operators import models as MD
from routewise.operators import scores as SC
from routewise.sources import scorestore as ST


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    """A template, score files with later lines and file-only ids, and a hot id holding a third of the file rows."""
    rng = random.Random(5)
    template = [(f"q{i}", m, r, k) for i in range(40) for m in config.MODELS for r in (1, 2) for k in ("bart", "bleu")]
    lines = [(*rng.choice(template), rng.choice([None, rng.random()]), n) for n in range(900)]
    lines += [("q7", "t5_base", 1, "bart", float(n), 10_000 + n) for n in range(450)] + [("gone", "t5_xl", 1, "bleu", 1.0, 5), (None, "t5_xl", 1, "bleu", 1.0, 6)]
    t = spark.createDataFrame(template, "id string, model string, resp_no int, metric string")
    f = spark.createDataFrame(lines, "id string, model string, resp_no int, metric string, score double, row_idx long").repartition(5)
    return t, f


def test_store_moves_no_rows(spark, tables):
    avg = ST.merged_averages(ST.score_store(*tables, buckets=6))
    assert "Exchange" not in _plan(avg)
    plain = SC.score_averages(SC.merge_scores(*tables))
    assert "Exchange" in _plan(plain)
    key = ["id", "model", "metric"]
    rows = lambda df: sorted(map(tuple, df.select(*key, F.round("avg_score", 9)).collect()), key=str)
    assert rows(avg) == rows(plain) and avg.count() == 40 * 3 * 2


def test_store_merges_models_side_by_side(spark, tables):
    t, _ = tables
    parts = [ST.write_bucketed(t.where(F.col("model") == m).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("id") != f"q{i}"), "part", 6)
             for i, m in enumerate(config.MODELS)]
    wide = ST.by_model(parts, ["n"])
    assert "Exchange" not in _plan(wide) and "SortMergeJoin" in _plan(wide)
    assert sorted(r["id"] for r in wide.collect()) == sorted(f"q{i}" for i in range(3, 40))
    assert wide.columns == ["id", *[f"n_{m}" for m in config.MODELS]]


def test_store_takes_later_files(spark, tables):
    t, f = tables
    more = spark.createDataFrame([("q3", "t5_xl", 2, "bleu", 9.0, 20_000), ("q7", "t5_base", 1, "bart", None, 20_001)], f.schema)
    store = ST.append_scores(ST.score_store(t, f, buckets=6), more)
    merged = SC.merge_lines(store)
    assert "Exchange" not in _plan(merged)
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, SC.merge_scores(t, f.unionByName(more)).collect()), key=str)


def test_store_edges(spark, tables):
    t, f = tables
    none = ST.merged_averages(ST.score_store(t.limit(0), f.limit(0), buckets=3))
    assert none.count() == 0
    assert ST.drop_names(spark) > 0 and ST.drop_names(spark) == 0


def _texts(spark, n_terms, seed=0):
    rng = random.Random(seed)
    terms = [f"t{i}" for i in range(n_terms)]
    weight = [1 / (i + 1) for i in range(n_terms)]
    rows = [(i, " ".join(rng.choices(terms, weight, k=rng.randint(0, 60)))) for i in range(400)] + [(400, None), (401, "")]
    return spark.createDataFrame(rows, "id long, text string").repartition(5)


def _vocabulary(docs, k):
    return [tuple(r) for r in MD.vocabulary(MD.term_counts(docs, "id", "text"), k).select("term", "total", "df").collect()]


@pytest.mark.parametrize("k,tracked", [(5, None), (5, 400), (20, 64), (3000, None)])
def test_heavy_terms_equal_the_vocabulary(spark, k, tracked):
    """Proven by the summary's bound, by a summary of all terms, and by the fallback."""
    docs = _texts(spark, 2500)
    got = [tuple(r) for r in MD.heavy_terms(docs, "text", k, tracked).select("term", "total", "df").collect()]
    assert got == _vocabulary(docs, k)


def test_heavy_terms_read_all_terms_only_when_unproven(spark, monkeypatch):
    """With a clear head the summary decides; where all terms occur alike it cannot."""
    kept = []
    monkeypatch.setattr(MD, "materialize", lambda df, plain=MD.materialize: kept.append(plain(df)) or kept[-1])
    docs = _texts(spark, 2500)
    assert "LogicalRDD" in MD.heavy_terms(docs, "text", 3, 2048)._jdf.queryExecution().logical().toString()
    flat = spark.range(3000).select(F.col("id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    df = MD.heavy_terms(flat, "text", 4, 64)
    assert "LogicalRDD" not in df._jdf.queryExecution().logical().toString() and [r["term"] for r in df.collect()] == ["w0", "w1", "w10", "w100"]
    assert MD.heavy_terms(docs.limit(0), "text", 5).count() == 0
