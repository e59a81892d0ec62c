"""Registered queries against their DuckDB oracles at sf0.001 (the driver runs
all of them at sf0.01; ``tools/oracle_check.py`` does the same locally)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from routewise.sources.tables import TABLES
from tests.conftest import SF001

SAMPLE = ["A3_parquet_scan", "B2_query_construction", "S5_query_readability_score", "S7_query_keywords_count",
          "S10_complexity_score", "S11_redundancy", "D5_response_averages", "D6_trash_repetition_counts",
          "D3_metric_ranges", "S16_avg_normalized_score", "C1_score_merge", "L1_label_cases", "L2_label_sweep",
          "F7_confidence_sweep", "D2_exact_quantiles", "Q3_length_quantile_router", "E4_classification_report",
          "M1_bleu", "M2_M3_rouge_n", "K1_tfidf", "A5_prompt_batches", "G4_pairwise_win_rates"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_a_unique_name():
    names = list(E.queries())
    assert len(names) == len(set(names)) and set(E.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    res = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(d_cols, res.fetchall())
