"""Golden arithmetic: routed counts and class supports of the published
evaluation reproduce its compute units and savings (E3) for all 70 cells."""

import pytest
from pyspark.sql import functions as F

from routewise.operators.routing import scorecard

# Published supports per discrepancy threshold (labels 1, 2, 3) and routed counts
SUPPORTS = {
    't0': (552, 754, 2694),
    't-0.005': (630, 804, 2566),
    't-0.01': (727, 845, 2428),
    't-0.015': (826, 896, 2278),
    't-0.02': (951, 913, 2136),
    't-0.025': (1074, 905, 2021),
    't-0.03': (1189, 897, 1914),
}
# (threshold, p, savings vs GT %, savings vs XL %, compute units, routed base, large, xl)
CELLS = [
    ('t0', 0.1, -23.35, 9.46, 43459.92, 198, 266, 3536),
    ('t0', 0.2, -23.35, 9.46, 43459.92, 198, 266, 3536),
    ('t0', 0.3, -23.35, 9.46, 43459.92, 198, 266, 3536),
    ('t0', 0.4, -24.33, 8.74, 43804.24, 178, 252, 3570),
    ('t0', 0.5, -26.85, 6.89, 44693.4, 123, 220, 3657),
    ('t0', 0.6, -29.12, 5.23, 45490.72, 82, 181, 3737),
    ('t0', 0.7, -31.86, 3.21, 46459.28, 44, 119, 3837),
    ('t0', 0.8, -34.56, 1.23, 47408.36, 11, 53, 3936),
    ('t0', 0.9, -35.43, 0.59, 47716.24, 4, 27, 3969),
    ('t0', 1.0, -36.19, 0.04, 47982.24, 0, 2, 3998),
    ('t-0.005', 0.1, -23.4, 12.77, 41870.2, 307, 310, 3383),
    ('t-0.005', 0.2, -23.4, 12.77, 41870.2, 307, 310, 3383),
    ('t-0.005', 0.3, -23.4, 12.77, 41870.2, 307, 310, 3383),
    ('t-0.005', 0.4, -24.88, 11.73, 42371.44, 280, 287, 3433),
    ('t-0.005', 0.5, -29.68, 8.33, 44000.52, 165, 246, 3589),
    ('t-0.005', 0.6, -33.08, 5.93, 45155.68, 106, 189, 3705),
    ('t-0.005', 0.7, -36.02, 3.85, 46151.28, 72, 119, 3809),
    ('t-0.005', 0.8, -39.65, 1.28, 47384.24, 14, 52, 3934),
    ('t-0.005', 0.9, -40.62, 0.6, 47712.0, 6, 25, 3969),
    ('t-0.005', 1.0, -41.47, 0.0, 48000.0, 0, 0, 4000),
    ('t-0.01', 0.1, -24.53, 15.69, 40471.08, 435, 309, 3256),
    ('t-0.01', 0.2, -24.53, 15.69, 40471.08, 435, 309, 3256),
    ('t-0.01', 0.3, -24.53, 15.69, 40471.08, 435, 309, 3256),
    ('t-0.01', 0.4, -26.14, 14.6, 40993.92, 402, 291, 3307),
    ('t-0.01', 0.5, -32.63, 10.2, 43104.88, 244, 249, 3507),
    ('t-0.01', 0.6, -37.63, 6.82, 44728.4, 140, 195, 3665),
    ('t-0.01', 0.7, -40.99, 4.54, 45820.08, 90, 134, 3776),
    ('t-0.01', 0.8, -45.19, 1.7, 47185.44, 24, 62, 3914),
    ('t-0.01', 0.9, -46.69, 0.68, 47674.36, 7, 28, 3965),
    ('t-0.01', 1.0, -47.67, 0.02, 47991.12, 0, 1, 3999),
    ('t-0.015', 0.1, -24.61, 19.63, 38576.16, 600, 318, 3082),
    ('t-0.015', 0.2, -24.61, 19.63, 38576.16, 600, 318, 3082),
    ('t-0.015', 0.3, -24.61, 19.63, 38576.16, 600, 318, 3082),
    ('t-0.015', 0.4, -26.29, 18.55, 39094.76, 569, 298, 3133),
    ('t-0.015', 0.5, -34.87, 13.01, 41753.6, 362, 255, 3383),
    ('t-0.015', 0.6, -42.59, 8.03, 44143.28, 194, 194, 3612),
    ('t-0.015', 0.7, -47.2, 5.06, 45569.2, 112, 135, 3753),
    ('t-0.015', 0.8, -51.71, 2.15, 46967.16, 39, 68, 3893),
    ('t-0.015', 0.9, -53.91, 0.73, 47648.12, 11, 26, 3963),
    ('t-0.015', 1.0, -55.02, 0.02, 47991.12, 0, 1, 3999),
    ('t-0.02', 0.1, -24.46, 23.69, 36629.28, 756, 344, 2900),
    ('t-0.02', 0.2, -24.46, 23.69, 36629.28, 756, 344, 2900),
    ('t-0.02', 0.3, -24.46, 23.69, 36629.28, 756, 344, 2900),
    ('t-0.02', 0.4, -26.55, 22.4, 37246.48, 712, 329, 2959),
    ('t-0.02', 0.5, -38.12, 15.31, 40652.0, 446, 275, 3279),
    ('t-0.02', 0.6, -47.14, 9.78, 43304.88, 246, 224, 3530),
    ('t-0.02', 0.7, -53.46, 5.91, 45165.24, 135, 152, 3713),
    ('t-0.02', 0.8, -59.23, 2.37, 46863.92, 50, 66, 3884),
    ('t-0.02', 0.9, -61.87, 0.75, 47641.76, 14, 23, 3963),
    ('t-0.02', 1.0, -63.0, 0.06, 47973.36, 0, 3, 3997),
    ('t-0.025', 0.1, -22.3, 28.28, 34426.48, 928, 379, 2693),
    ('t-0.025', 0.2, -22.3, 28.28, 34426.48, 928, 379, 2693),
    ('t-0.025', 0.3, -22.3, 28.28, 34426.48, 928, 379, 2693),
    ('t-0.025', 0.4, -25.0, 26.69, 35187.48, 879, 354, 2767),
    ('t-0.025', 0.5, -39.45, 18.22, 39253.8, 561, 290, 3149),
    ('t-0.025', 0.6, -51.41, 11.2, 42622.48, 304, 229, 3467),
    ('t-0.025', 0.7, -57.99, 7.34, 44474.88, 180, 174, 3646),
    ('t-0.025', 0.8, -65.99, 2.66, 46725.16, 61, 68, 3871),
    ('t-0.025', 0.9, -69.04, 0.87, 47584.24, 16, 27, 3957),
    ('t-0.025', 1.0, -70.49, 0.02, 47991.12, 0, 1, 3999),
    ('t-0.03', 0.1, -19.13, 33.1, 32112.76, 1123, 398, 2479),
    ('t-0.03', 0.2, -19.13, 33.1, 32112.76, 1123, 398, 2479),
    ('t-0.03', 0.3, -19.13, 33.1, 32112.76, 1123, 398, 2479),
    ('t-0.03', 0.4, -22.12, 31.42, 32918.56, 1078, 363, 2559),
    ('t-0.03', 0.5, -37.79, 22.62, 37143.52, 748, 296, 2956),
    ('t-0.03', 0.6, -55.17, 12.86, 41826.24, 378, 227, 3395),
    ('t-0.03', 0.7, -63.3, 8.29, 44019.24, 219, 177, 3604),
    ('t-0.03', 0.8, -71.88, 3.48, 46330.48, 88, 79, 3833),
    ('t-0.03', 0.9, -75.96, 1.19, 47429.84, 26, 32, 3942),
    ('t-0.03', 1.0, -77.94, 0.07, 47964.48, 0, 4, 3996),
]

def _routed_rows(t, p, sup, routed):
    # Any pairing of true and routed labels gives the same compute units.
    truth = [1] * sup[0] + [2] * sup[1] + [3] * sup[2]
    pred = [1] * routed[0] + [2] * routed[1] + [3] * routed[2]
    assert len(truth) == len(pred)
    return [(t, p, y, r, 0.5, 0.5, 0.5) for y, r in zip(truth, pred)]


def test_all_70_cells(spark):
    rows = []
    for t, p, _, _, _, b, l, x in CELLS:
        rows += _routed_rows(t, p, SUPPORTS[t], (b, l, x))
    df = spark.createDataFrame(rows, "t_threshold string, prob_threshold double, evaluation_model_label int, "
                                     "routed_to int, avg_normalized_score_t5_base double, "
                                     "avg_normalized_score_t5_large double, avg_normalized_score_t5_xl double")
    got = {(r["t_threshold"], round(r["prob_threshold"], 1)): r
           for r in scorecard(df, ("t_threshold", "prob_threshold")).collect()}
    assert len(got) == 70
    for t, p, sav_gt, sav_xl, cu, b, l, x in CELLS:
        r = got[(t, p)]
        assert (r["n_base"], r["n_large"], r["n_xl"]) == (b, l, x)
        assert round(r["compute_units"], 2) == pytest.approx(cu, abs=1e-6)
        assert round(r["compute_savings_gt"], 2) == pytest.approx(sav_gt, abs=1e-6)
        assert round(r["compute_savings_xl"], 2) == pytest.approx(sav_xl, abs=1e-6)


def test_split_size_published():
    from routewise.operators.rowindex import python_round
    assert python_round(40004 * 0.9) == 36004
    assert 40004 - python_round(40004 * 0.9) == 4000
