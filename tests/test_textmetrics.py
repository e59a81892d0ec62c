"""Text metric properties and the LCS kernels against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routewise.operators import textmetrics as TM


def lcs_brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


@given(st.lists(st.sampled_from("abcde"), max_size=70), st.lists(st.sampled_from("abcde"), max_size=70))
@settings(max_examples=200, deadline=None)
def test_lcs_length(a, b):
    assert TM.lcs_length(a, b) == lcs_brute(a, b)
    assert len(TM.lcs_indices(a, b)) == lcs_brute(a, b)


def test_rouge_lsum_single_sentence_equals_rouge_l():
    c, r = ["the", "cat", "sat", "on", "mat"], ["the", "cat", "is", "on", "the", "mat"]
    assert TM.rouge_lsum([c], [r]) == pytest.approx(TM.rouge_l(c, r))


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("p1", "the quick brown fox jumps", "the quick brown fox jumps"),
            ("p2", "the quick brown fox", "a slow red dog walks home"),
            ("p3", "   ", "reference text"),
            ("p4", "short", ""),
            ("p5", "one two three four five six", "one two three four five six seven eight"),
            ("p6", "Line one here.\nAnd line two there.", "line two there\nline one here")]
    return spark.createDataFrame(rows, "pid string, candidate string, reference string")


def test_bleu_identity_and_gate(pairs):
    got = {r["pid"]: r["bleu"] for r in TM.pair_metrics(pairs, ["pid"], ["bleu"]).collect()}
    assert got["p1"] == pytest.approx(100.0)
    assert got["p3"] is None and got["p4"] is None
    assert got["p2"] == 0.0
    assert 0 < got["p5"] < 100  # brevity penalty


def test_rouge_properties(pairs):
    n = {r["pid"]: r for r in TM.pair_metrics(pairs, ["pid"], ["rouge1", "rouge2"]).collect()}
    l = {r["pid"]: r for r in TM.pair_metrics(pairs, ["pid"], ["rougeL", "rougeLsum"]).collect()}
    assert n["p1"]["rouge1"] == pytest.approx(1.0) and l["p1"]["rougeL"] == pytest.approx(1.0)
    for pid in ("p1", "p2", "p5", "p6"):
        assert l[pid]["rougeL"] <= n[pid]["rouge1"] + 1e-12
    assert l["p6"]["rougeLsum"] >= l["p6"]["rougeL"]
    assert n["p3"]["rouge1"] is None and l["p3"]["rougeL"] is None


def test_pluggable_scorer_isolates_errors(pairs):
    def factory():
        def score(c, r):
            if any("fox" in x for x in c) and len(c) > 1:
                raise RuntimeError("batch failure")
            if any("fox" in x for x in c):
                raise RuntimeError("row failure")
            return [1.0] * len(c)
        return score
    got = {r["pid"]: r["s"] for r in TM.score_pairs(pairs, ["pid"], factory, "s", batch_size=8).collect()}
    assert got["p1"] is None and got["p2"] is None and got["p3"] is None and got["p5"] == 1.0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    got = [r["c"] for r in df.select(TM.cosine("a", "b").alias("c")).collect()]
    assert got[0] == pytest.approx(0.0) and got[1] == pytest.approx(1.0)


@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=30),
       st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_single_line_lsum_shortcut_is_exact(a, b):
    c, r = " ".join(a), " ".join(b)
    fast = TM.pair_scores(c, TM._Reference(r, ["rougeL", "rougeLsum"]), ["rougeL", "rougeLsum"])
    slow = TM.rouge_lsum([TM._TOK.findall(c)], [TM._TOK.findall(r)])
    assert fast[1] == pytest.approx(slow) and fast[0] == pytest.approx(TM.rouge_l(TM._TOK.findall(c), TM._TOK.findall(r)))


def test_rouge_l_query_matches_brute_force(spark):
    """M4/M5 have no SQL oracle: check the registered query against a plain
    Python computation over every pair of the sf0.001 fixture."""
    import re

    import __spark_entry__ as E
    from routewise.plans.q_textmetrics import pairs
    from tests.conftest import SF001
    got = {(r["id"], r["model"], r["resp_no"]): (r["rougeL"], r["rougeLsum"])
           for r in E.queries()["M4_M5_rouge_l"](spark, SF001).collect()}
    tok = re.compile("[a-z0-9]+")

    def f(p, r):
        return 2 * p * r / (p + r) if p + r > 0 else 0.0

    n = 0
    for row in pairs(spark, SF001).toPandas().itertuples():
        key = (row.id, row.model, row.resp_no)
        if not (row.candidate or "").strip() or not row.reference:
            assert got[key] == (None, None)
            continue
        c, r = tok.findall(row.candidate.lower()), tok.findall(row.reference.lower())
        lcs = lcs_brute(c, r)
        exp_l = f(lcs / len(c), lcs / len(r)) if c and r else 0.0
        exp_s = TM.rouge_lsum([tok.findall(x) for x in row.candidate.lower().split("\n")],
                              [tok.findall(x) for x in row.reference.lower().split("\n")])
        assert got[key][0] == pytest.approx(exp_l, abs=6e-7) and got[key][1] == pytest.approx(exp_s, abs=6e-7)
        n += 1
    assert n > 1000


def _table_indices(ref, cand):
    """The full table and the same tie rule."""
    t = [[0] * (len(cand) + 1) for _ in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(cand) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if ref[i - 1] == cand[j - 1] else max(t[i - 1][j], t[i][j - 1])
    i, j, out = len(ref), len(cand), []
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_lcs_indices_equal_the_full_table(a, b):
    assert TM.lcs_indices(a, b) == _table_indices(a, b)


def test_long_lines_are_quick():
    import time
    import random
    rng = random.Random(1)
    a, b = ([rng.choice("abcdefgh") for _ in range(3000)] for _ in range(2))
    t = time.time()
    assert len(TM.lcs_indices(a, b)) == TM.lcs_length(a, b)
    assert time.time() - t < 5


def test_masked_pairs_never_reach_the_scorer(spark):
    rows = [("a", "x <mask> y", "x"), ("b", "x", "x <mask>"), ("c", "x", "x"), ("d", " ", "x")]
    df = spark.createDataFrame(rows, "k string, candidate string, reference string")

    def factory():
        def score(c, r):
            assert not any("<mask>" in t for t in [*c, *r])
            return [1.0] * len(c)
        return score
    got = {r["k"]: r["s"] for r in TM.score_pairs(df, ["k"], factory, "s", guard_masks=True).collect()}
    assert got == {"a": None, "b": None, "c": 1.0, "d": None}
