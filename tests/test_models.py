"""Encoders and router models."""

import pytest
from pyspark.sql import functions as F

from routewise.operators import models as MD
from routewise.operators import routing as RT

CFG = MD.ForestConfig(num_trees=10, max_depth=5)


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that follow the text and a number; a feature without spread."""
    data = [(f"r{i}", ["cheap short words", "middling phrase here", "very costly prose"][i % 3] + f" w{i % 7}", float(i % 3) + (i % 5) / 100, 4.0, i % 3 + 1)
            for i in range(120)]
    return spark.createDataFrame(data, "id string, query string, x double, flat double, evaluation_model_label int").cache()


def test_label_router_learns_and_survives_saving(spark, rows, tmp_path):
    router = MD.fit_label_router(rows, "query", ["x", "flat"], k=50, cfg=CFG)
    pred = router.transform(rows).cache()
    assert pred.where("predicted_model_label = evaluation_model_label").count() >= 114  # a floor far above chance
    total = sum((F.col(c) for c in RT.PROBA_COLS), F.lit(0.0))
    assert pred.where((F.abs(total - 1) > 1e-9) | (F.least(*RT.PROBA_COLS) < 0)).count() == 0
    router.save(str(tmp_path / "router"))
    again = MD.load_router(spark, str(tmp_path / "router")).transform(rows)
    a, b = ({r["id"]: r["predicted_model_label"] for r in d.select("id", "predicted_model_label").collect()} for d in (pred, again))
    assert a == b


def test_forest_as_a_table_gives_the_models_predictions(spark, rows):
    """Nodes walked by joins: the same probabilities for every row, also for rows of unknown words and a forest of one leaf."""
    from routewise.operators import foresttable as FTB
    router = MD.fit_label_router(rows, "query", ["x", "flat"], k=50, cfg=CFG)
    more = rows.unionByName(rows.limit(5).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("unknown words").alias("query"), F.lit(-9.0).alias("x"), "flat", "evaluation_model_label"))
    scored = router.transform(more).cache()
    leaf = MD.fit_label_router(rows.withColumn("evaluation_model_label", F.lit(2)), "query", ["flat"], k=50, cfg=MD.ForestConfig(3, 2))
    nodes = FTB.forest_nodes(router.forest.stages[-1], "a").unionByName(FTB.forest_nodes(leaf.forest.stages[-1], "b"))
    assert nodes.where("forest = 'a' and feature is null and left is not null").count() == 0 and nodes.where("forest = 'b'").count() == 3
    both = F.explode(F.array(F.lit("a"), F.lit("b")))
    got = FTB.walk(FTB.sparse_values(scored).withColumn("forest", both), nodes, scored.select("id").withColumn("forest", both)).collect()
    want = {r["id"]: [r[c] for c in RT.PROBA_COLS] for r in scored.collect()}
    assert len(got) == 2 * len(want)
    for r in got:
        assert r["probability"] == (pytest.approx(want[r["id"]], abs=1e-12) if r["forest"] == "a" else [0.0, 1.0])


def test_shared_text_encoder_gives_the_same_router(rows):
    tfidf = MD.fit_tfidf(rows, "query", 50)
    a, b = (MD.fit_label_router(rows, "query", ["x"], k=50, cfg=CFG, tfidf=t).transform(rows).select("id", "proba_xl").collect() for t in (tfidf, None))
    assert sorted(a) == sorted(b)


def test_category_classifier_and_complexity_forest(rows):
    tfidf = MD.fit_tfidf(rows, "query", 50)
    t = tfidf.transform(rows).withColumn("category_idx", (F.col("evaluation_model_label") - 1).cast("double"))
    got = MD.category_classifier(120, features="tfidf").fit(t).transform(t)
    assert got.where("prediction = category_idx").count() >= 114
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.withColumn("query_complexity_score", F.col("x") * 2))
    m = RT.regression_metrics(MD.complexity_forest().fit(v).transform(v), "query_complexity_score", "prediction").first()
    assert m["r2"] > 0.9


def test_class_weights_with_a_null_label(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "y int")
    got = sorted((r["y"] or 0, r["w"]) for r in MD.with_class_weights(df, "y", "w").collect())
    assert got == [(0, None), (1, pytest.approx(4 / 6)), (1, pytest.approx(4 / 6)), (1, pytest.approx(4 / 6)), (2, 2.0)]


def test_label_distribution_with_a_null_label(spark):
    from routewise.operators.labels import label_distribution
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (None, 8.0)], "evaluation_model_label int, query_complexity_score double")
    got = {r["evaluation_model_label"]: (r["n"], r["median_value"]) for r in label_distribution(df).collect()}
    assert got == {1: (2, 3.0), None: (1, 8.0)}


def test_confidence_scorecard_equals_the_row_wise_sweep(spark):
    import random
    rng = random.Random(2)
    data = []
    for i in range(300):
        p = [rng.choice([0.1, 0.2, 0.3, 0.5, 0.6, 1.0]) for _ in range(3)]
        data.append((f"t{i % 2}", rng.randint(1, 3), *p, rng.random(), rng.random(), rng.random()))
    data.append(("t0", 1, None, None, None, 0.5, 0.5, 0.5))  # no prediction
    df = spark.createDataFrame(data, "t_threshold string, evaluation_model_label int, proba_base double, proba_large double, proba_xl double, "
                                     + ", ".join(f"{c} double" for c in RT.SCORE_COLS))
    df = df.where("proba_xl IS NOT NULL")
    keys = ["t_threshold", "prob_threshold"]
    slow = RT.scorecard(RT.with_confidence_grid(df), keys).orderBy(*keys).collect()
    fast = RT.confidence_scorecard(df, ["t_threshold"]).orderBy(*keys).collect()
    assert len(slow) == len(fast) == 20
    for a, b in zip(slow, fast):
        assert a.asDict() == pytest.approx(b.asDict())


def test_queries_fit_the_whole_forest_and_return_its_results(spark, monkeypatch):
    """The fits are run small here; what the queries ask for is the operator's default."""
    from routewise.plans import q_models as Q
    asked, real = [], MD.label_forest
    monkeypatch.setattr(MD, "label_forest", lambda *a, cfg=MD.ForestConfig(), **k: asked.append(cfg) or real(*a, cfg=CFG, **k))
    rows = Q.k7_predictions(spark, "/root/testdata/sf0.001").collect()
    assert len({r["t_threshold"] for r in rows}) == 7 and len(rows) == len({(r["id"], r["t_threshold"]) for r in rows})
    for r in rows:
        p = [r[c] for c in RT.PROBA_COLS]
        assert sum(p) == pytest.approx(1, abs=1e-5) and min(p) >= 0 and r["predicted_model_label"] in (1, 2, 3)
    walked = Q.k7(spark, "/root/testdata/sf0.001").collect()  # no forest is fitted anew
    assert len(walked) == len(rows) and all(r["walk_agrees"] and r["sums_to_one"] for r in walked)
    assert Q.a10(spark, "/root/testdata/sf0.001").first()["n"] == len(rows) // 7
    assert asked == [MD.ForestConfig()] * 8


def test_historical_scorecard_is_accurate(spark):
    from routewise.plans import q_models as Q
    r = Q.k12_scorecard(spark, "/root/testdata/sf0.01").first()
    assert r["n_base"] + r["n_large"] + r["n_xl"] == r["n"] == 80
    assert r["routing_accuracy"] >= 75
