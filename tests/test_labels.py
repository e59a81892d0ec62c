"""The nine-case decision list, one hand-made row per case plus fall-throughs."""

import pytest

from routewise.config import LabelThresholds
from routewise.operators.labels import with_label

COLS = ["id", "r_t5_base_trash_count", "r_t5_large_trash_count", "r_t5_xl_trash_count",
        "r_t5_base_query_repetition_count", "r_t5_large_query_repetition_count", "r_t5_xl_query_repetition_count",
        "discrepancy_base_vs_large", "discrepancy_large_vs_xl", "discrepancy_base_vs_xl",
        "rt_t5_base_avg", "rt_t5_large_avg", "rt_t5_xl_avg", "r_t5_base_length_avg", "r_t5_large_length_avg",
        "r_t5_xl_length_avg"]
SCHEMA = ", ".join(f"{c} {'string' if c == 'id' else ('int' if 'count' in c else 'double')}" for c in COLS)

# (id, trash b/l/x, rep b/l/x, d12, d23, d13, rt b/l/x, len b/l/x, expected case, label)
CASES = [
    ("c1", 3, 3, 3, 0, 0, 0, 0.0, 0.0, 0.0, 1, 1, 1, 1, 1, 1, "case_1", 3),
    ("c2", 0, 3, 0, 0, 0, 0, 0.0, 0.0, 0.0, 1, 1, 1, 1, 1, 1, "case_2", 3),
    ("c3", 2, 0, 0, 5, 0, 0, 0.0, 0.0, 0.0, 1, 1, 1, 1, 1, 1, "case_3", 1),
    ("c4", 0, 0, 0, 0, 0, 0, 0.01, -0.02, 0.0, 1, 1, 1, 1, 1, 1, "case_4", 1),
    ("c5", 0, 0, 0, 0, 0, 0, -0.01, 0.01, 0.0, 100, 100, 1, 10, 10, 1, "case_5", 1),
    ("c6", 0, 0, 0, 0, 0, 0, -0.05, 0.01, -0.04, 1, 1, 1, 1, 1, 1, "case_6", 2),
    ("c7", 0, 0, 0, 0, 0, 0, -0.01, -0.01, -0.02, 100, 100, 100, 10, 10, 10, "case_7", 1),
    ("c8", 0, 0, 0, 0, 0, 0, -0.04, -0.01, -0.05, 100, 100, 100, 10, 10, 10, "case_8", 2),
    ("c9", 0, 0, 0, 0, 0, 0, -0.04, -0.04, -0.08, 1, 1, 1, 1, 1, 1, "case_default", 3),
    # fall-throughs: case 5 with a slow base; case 7 with a long base; G7 with d23 < dt
    ("f5", 0, 0, 0, 0, 0, 0, -0.01, 0.01, 0.0, 1000, 100, 1, 10, 10, 1, "case_default", 3),
    ("f7", 0, 0, 0, 0, 0, 0, -0.01, -0.01, -0.02, 100, 100, 100, 100, 10, 10, "case_default", 3),
    ("f8", 0, 0, 0, 0, 0, 0, -0.04, -0.04, -0.05, 1, 1, 1, 1, 1, 1, "case_default", 3),
]


def _row(c):
    return tuple(v if i < 7 else float(v) for i, v in enumerate(c[:16]))


@pytest.mark.parametrize("dt", [-0.03])
def test_cases(spark, dt):
    df = spark.createDataFrame([_row(c) for c in CASES], SCHEMA)
    got = {r["id"]: (r["label_case"], r["evaluation_model_label"])
           for r in with_label(df, dt, LabelThresholds(discrepancy=dt)).collect()}
    for c in CASES:
        assert got[c[0]] == (c[16], c[17]), c[0]


def test_dt_zero_disables_close_cases(spark):
    rows = [_row(c) for c in CASES if c[0] in ("c5", "c7", "c8")]
    got = {r["id"]: r["label_case"] for r in with_label(spark.createDataFrame(rows, SCHEMA), 0.0).collect()}
    assert got["c5"] == "case_6" and got["c7"] == "case_default" and got["c8"] == "case_default"


def test_fixture_case_counts(spark):
    """FIXTURES.md: case counts of fx_label_input at dt = -0.03 (sf0.01)."""
    from routewise.plans.flagship import label_inputs_wide
    from routewise.operators.labels import case_distribution, with_label_sweep
    wide = label_inputs_wide(spark, "/root/testdata/sf0.01")
    d = case_distribution(with_label_sweep(wide, [-0.03]))
    got = {r["label_case"]: r["n"] for r in d.collect()}
    assert got == {"case_1": 25, "case_2": 178, "case_3": 37, "case_4": 109, "case_5": 59, "case_6": 140,
                   "case_7": 34, "case_8": 33, "case_default": 385}
