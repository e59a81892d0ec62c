"""Exact order statistics, quantiles, splits and row numbers against numpy/pandas."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from routewise.operators import rowindex as RI


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    v = np.round(rng.exponential(2.0, 5000), 2)  # many ties
    v[:1700] = 1.25  # a hot value holding a third of the rows
    pdf = pd.DataFrame({"row_idx": rng.permutation(5000).astype("int64"), "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_order_statistics_with_narrowing(values):
    pdf, df = values
    ks = [1, 17, 1700, 1701, 2500, 4999, 5000]
    got = RI.order_statistics(df, "v", ks, buckets=8, finish_rows=50)
    srt = np.sort(pdf["v"].to_numpy())
    assert {k: got[k] for k in ks} == {k: srt[k - 1] for k in ks}


@pytest.mark.parametrize("column", ["skewed", "odd", "even", "long"])
def test_order_statistics_read_the_table_twice(spark, column):
    """Whatever the values, two scans: one for the sketch, one around its ranges."""
    rng = np.random.default_rng(3)
    n = 20_000
    v = {"skewed": np.where(rng.random(n) < 0.4, 3.0, rng.pareto(0.3, n)), "odd": np.where(rng.random(n) < 0.3, np.inf, -1 / rng.random(n)),
         "even": rng.random(n), "long": rng.integers(-2**62, 2**62, n)}[column]
    v = [x.item() for x in v] + ([float("nan"), float("-inf")] if column == "odd" else [])
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame([(x,) for x in v], "v " + ("long" if column == "long" else "double")).repartition(4)
    ks = [1, 2, 777, n // 2, n // 2 + 1, int(n * 0.8), n - 1, n]
    got = RI.order_statistics(df.mapInPandas(seen, df.schema), "v", ks, finish_rows=100)
    srt = sorted(v, key=lambda x: (x != x, x))
    assert {k: got[k] for k in ks} == {k: srt[k - 1] for k in ks} and read.value == 2 * len(v)


def test_order_statistics_beyond_the_sketch(spark, values, monkeypatch):
    """Ranges that do not hold the ranks: narrowing finds them."""
    pdf, df = values
    monkeypatch.setattr(RI, "_sketch_ranges", lambda summary, ranks, sizes, k: {g: [(-5.0, -4.0)] for g, _ in ranks})
    srt = np.sort(pdf["v"].to_numpy())
    got = RI.order_statistics(df, "v", [3, 2500, 4990], buckets=8, finish_rows=50)
    assert {k: got[k] for k in got} == {k: srt[k - 1] for k in (3, 2500, 4990)}


@pytest.mark.parametrize("q", [0.0, 0.2, 0.33, 0.5, 0.8, 1.0])
def test_exact_quantile_matches_pandas(values, q):
    pdf, df = values
    assert RI.exact_quantile(df, "v", q) == pytest.approx(pdf["v"].quantile(q), abs=1e-12)


def test_published_quantile_example(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double")
    assert RI.exact_quantile(df, "v", 0.8) == pytest.approx(5.2)


def test_grouped_quantiles(values):
    pdf, df = values
    g = df.withColumn("g", (F.col("row_idx") % 3).cast("int"))
    got = RI.grouped_quantiles(g, "g", "v", [0.5, 0.9])
    pg = pdf.assign(g=pdf.row_idx % 3)
    for (gv, q), v in got.items():
        assert v == pytest.approx(pg[pg.g == gv]["v"].quantile(q))


def test_quantile_filter_keeps_ties(values):
    pdf, df = values
    thr = pdf["v"].quantile(0.8)
    assert df.where(F.col("v") <= RI.exact_quantile(df, "v", 0.8)).count() == int((pdf["v"] <= thr).sum())


def test_ordered_split(values):
    pdf, df = values
    train, test = RI.ordered_split(df, "row_idx", 0.9)
    assert train.count() == round(5000 * 0.9)
    assert train.agg(F.max("row_idx")).first()[0] < test.agg(F.min("row_idx")).first()[0]


def test_row_number_multi_bucket(values):
    pdf, df = values
    got = RI.with_row_number(df, "row_idx", rows_per_partition=300).select("row_idx", "row_no").toPandas()
    assert (got.sort_values("row_idx")["row_no"].to_numpy() == np.arange(1, 5001)).all()


def test_row_range(values):
    pdf, df = values
    got = sorted(r["row_idx"] for r in RI.row_range(df, "row_idx", 100, 50).collect())
    assert got == sorted(pdf["row_idx"])[100:150]


@pytest.fixture(scope="module")
def tied(spark):
    """Keys with NULLs, long ties and repeated rows."""
    keys = [None] * 7 + [3] * 40 + [1] * 5 + [2] + [9] * 20
    return keys, spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "row_idx long, x int").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 4, 7, 8, 12, 13, 30, 53, 72, 73, 100])
def test_first_rows_are_exact_with_ties_and_nulls(tied, n):
    keys, df = tied
    got = sorted(-1 if r["row_idx"] is None else r["row_idx"] for r in RI.first_rows(df, "row_idx", n).collect())
    assert got == sorted(-1 if k is None else k for k in keys)[:n]


def test_row_range_and_split_with_ties_and_nulls(tied):
    keys, df = tied
    want = sorted(-1 if k is None else k for k in keys)
    got = sorted(-1 if r["row_idx"] is None else r["row_idx"] for r in RI.row_range(df, "row_idx", 5, 30).collect())
    assert got == want[5:35]
    for ratio in (0.0, 0.05, 0.5, 0.9, 1.0):
        train, test = RI.ordered_split(df, "row_idx", ratio)
        a, b = train.count(), test.count()
        assert a == round(len(keys) * ratio) and a + b == len(keys)


def test_row_number_with_ties_and_nulls(tied):
    keys, df = tied
    rows = sorted((r["row_no"], -1 if r["row_idx"] is None else r["row_idx"]) for r in RI.with_row_number(df, "row_idx", rows_per_partition=5).collect())
    assert [n for n, _ in rows] == list(range(1, len(keys) + 1))
    assert [k for _, k in rows] == sorted(-1 if k is None else k for k in keys)


def test_order_statistics_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    v = [-inf, -inf, -1e308, -1.0, 0.0, 1e-300, 2e-300, 5.0, 1e308, inf, nan, nan] + [7.0] * 30
    df = spark.createDataFrame([(x,) for x in v], "v double")
    want = sorted(v, key=lambda x: (x != x, x))
    got = RI.order_statistics(df, "v", range(1, len(v) + 1), buckets=4, finish_rows=2)
    assert all(got[k] == want[k - 1] or (got[k] != got[k] and want[k - 1] != want[k - 1]) for k in got)


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(RI, "MAX_GROUPS", 5)
    with pytest.raises(ValueError):
        RI.grouped_quantiles(spark.range(20).selectExpr("id AS g", "id AS v"), "g", "v", [0.5])


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_idx long")
    assert RI.first_rows(df, "row_idx", 3).count() == 0
    assert [t.count() for t in RI.ordered_split(df)] == [0, 0]
    assert RI.with_row_number(df, "row_idx").count() == 0


@pytest.mark.parametrize("rows_per_partition", [3, 40, 10**6])
def test_row_number_splits_a_hot_key(spark, rows_per_partition):
    """A key holding half of all rows is ranked in several ranges; positions are complete and in order."""
    keys = [7] * 300 + list(range(-100, 100)) + [None] * 60 + [2**62, -2**62, 2**62 + 1]
    df = spark.createDataFrame([(k, f"r{i}") for i, k in enumerate(keys)], "row_idx long, name string").repartition(5)
    got = RI.with_row_number(df, "row_idx", rows_per_partition=rows_per_partition, keep_range=True).collect()
    assert sorted(r["row_no"] for r in got) == list(range(1, len(keys) + 1))
    in_order = [r["row_idx"] for r in sorted(got, key=lambda r: r["row_no"])]
    assert in_order == sorted(keys, key=lambda k: (k is not None, k or 0))
    if rows_per_partition == 40:
        of = {}
        for r in got:
            of.setdefault(r["__part"], []).append(r["row_idx"])
        assert max(map(len, of.values())) < 150 and sum(7 in x for x in of.values()) > 3 and sum(None in x for x in of.values()) > 1


def test_prompt_batches_move_texts_once(spark):
    """Batches of three over ranges of a few rows: equal to plain chunks; whole rows cross one exchange and are not checkpointed."""
    from routewise.sources import batches as BT
    rows = [(i // 3, f"q{i:03d}", "say", "x" * 50, "y") for i in range(100)]
    df = spark.createDataFrame(rows, "row_idx long, id string, instruction string, input string, output string").repartition(3)
    got = sorted(BT.prompt_batches(df, size=3, template="T").select("batch_no", "n_rows", "prompt").collect())
    assert [r["batch_no"] for r in got] == list(range(34)) and [r["n_rows"] for r in got] == [3] * 33 + [1]
    ids = [x for r in got for x in re.findall('"id":"(q[0-9]+)"', r["prompt"])]
    assert [int(x[1:]) // 3 for x in ids] == [i // 3 for i in range(100)] and len(set(ids)) == 100
    out = BT.prompt_batches(df, size=3)
    out.collect()
    p = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [x for x in p.splitlines() if "Exchange hashpartitioning(__part" in x]
    assert sum("ReusedExchange" not in x for x in moved) == 1 and sum("ReusedExchange" in x for x in moved) == 1
