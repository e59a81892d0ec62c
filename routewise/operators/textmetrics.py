"""Candidate-vs-reference text metrics.

A pair stays one row from beginning to end: BLEU, ROUGE-1/2 and
ROUGE-L/Lsum of a batch of pairs come from one Arrow-batched function that
tokenizes each text once (a reference shared by neighbouring pairs only once
for all of them), so nothing is exploded and nothing is shuffled.

* BLEU and ROUGE-N clip n-gram counts (M1-M3).
* ROUGE-L uses a bit-parallel longest common subsequence; ROUGE-Lsum keeps
  one integer of bits per reference word and walks them back (M4, M5).
* The neural scores (bart, bleurt, logprobs) are a pluggable per-pair scorer
  run with ``mapInPandas`` (M7); the scorer is built once per partition.
* "bert" (M6) is the cosine similarity of two embedding arrays.

Definitions (our stated versions; library tokenizers are not reproduced):
BLEU tokens are runs of letters/digits/underscore or single other non-space
characters; BLEU-4 with brevity penalty and exponential smoothing (the k-th
zero-match order gets ``1 / (2^k * total)``), 0 when the candidate has fewer
than 4 tokens or no match at all (Papineni et al. 2002).  ROUGE tokens are
lowercase ``[a-z0-9]+`` runs; F = 2PR / (P + R) (Lin 2004).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_text, is_blank, nz

# The UDF / mapInPandas code of this module runs in Python workers: ship it by
# value so executors do not need the package installed.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import by name
    pass

ROUGE_TOKEN = r"[a-z0-9]+"
_TOK = re.compile(ROUGE_TOKEN)
# \w are letters, numbers and the underscore; white space is ASCII, as in the SQL engines' patterns
_BLEU_TOK = re.compile(r"\w+|[^\w \t\n\f\r]")
METRICS = ("bleu", "rouge1", "rouge2", "rougeL", "rougeLsum")


def scoring_gate(candidate, reference) -> Column:
    """Score only a valid candidate against a non-empty reference."""
    return ~is_blank(candidate) & has_text(reference)


def mask_guard(candidate, reference) -> Column:
    """A ``<mask>`` token on either side makes the (bart) score NULL."""
    return nz(candidate).contains("<mask>") | nz(reference).contains("<mask>")


def _grams(tokens: list, n: int) -> Counter:
    return Counter(tokens) if n == 1 else Counter(zip(*(tokens[i:] for i in range(n))))


def _matches(cand: Counter, ref: Counter) -> int:
    """Clipped n-gram matches."""
    if len(ref) < len(cand):
        cand, ref = ref, cand
    return sum(min(k, ref[g]) for g, k in cand.items() if g in ref)


def bleu(cand: list, ref: list, ref_grams: list | None = None, top: int = 4) -> float:
    """M1 (0..100) of two token lists; ``ref_grams``: the reference's counts of order 1..top, if known."""
    if len(cand) < top:
        return 0.0
    ref_grams = ref_grams or [_grams(ref, n) for n in range(1, top + 1)]
    total, zeros, logs = 0, 0, 0.0
    for n in range(1, top + 1):
        hit, of = _matches(_grams(cand, n), ref_grams[n - 1]), len(cand) - n + 1
        total += hit
        zeros += not hit
        logs += math.log(100.0 * hit / of if hit else 100.0 / (2.0 ** zeros * of))
    if not total:
        return 0.0
    brevity = 1.0 if len(cand) >= len(ref) else math.exp(1.0 - len(ref) / len(cand))
    return brevity * math.exp(logs / top)


def rouge_n(cand: list, ref: list, n: int, ref_grams: Counter | None = None) -> float:
    """M2/M3: ROUGE-N F-measure."""
    hit = _matches(_grams(cand, n), ref_grams if ref_grams is not None else _grams(ref, n))
    return _f(hit / max(len(cand) - n + 1, 1), hit / max(len(ref) - n + 1, 1))


# ---------------------------------------------------------------------------
# LCS-based ROUGE (Arrow-batched pandas UDFs)
# ---------------------------------------------------------------------------

def _masks(tokens) -> dict:
    """Per token the bits of its places."""
    masks: dict = {}
    bit = 1
    for t in tokens:
        masks[t] = masks.get(t, 0) | bit
        bit <<= 1
    return masks


def lcs_length(a, b, masks: dict | None = None) -> int:
    """Bit-parallel LCS length (Allison-Dix / Crochemore et al. 2001); ``masks``: those of ``a``, if known."""
    if len(a) == 0 or len(b) == 0:
        return 0
    if a == b:
        return len(a)
    full = (1 << len(a)) - 1
    v = full
    # a token that ``a`` lacks leaves the row as it is
    for m in filter(None, map((masks or _masks(a)).get, b)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_indices(ref, cand, masks: dict | None = None) -> list:
    """Indices into ``ref`` of one LCS: a row of bits per reference token (zeros mark
    where the table grows along ``cand``), then backtracking over the rows.

    A reference token that ``cand`` lacks has the row before it and is passed by, so only
    the others have rows.  ``masks``: those of ``cand``, if known."""
    if ref == cand:
        return list(range(len(ref)))
    masks = masks or _masks(cand)
    at = [i for i, t in enumerate(ref) if t in masks]
    full = (1 << len(cand)) - 1
    v, rows = full, [full]
    for i in at:
        u = v & masks[ref[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # ``left``: the table's value at (i, j); a step without a match keeps it
    i, j, out, left = len(at), len(cand), [], len(cand) - v.bit_count()
    while left:
        if ref[at[i - 1]] == cand[j - 1]:
            out.append(at[i - 1])
            i -= 1
            j -= 1
            left -= 1
        elif j - (rows[i - 1] & ((1 << j) - 1)).bit_count() < left:
            j -= 1
        else:
            i -= 1
    out.reverse()
    return out


def _f(prec: float, rec: float) -> float:
    return 2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0


def rouge_l(cand, ref, masks: dict | None = None) -> float:
    """ROUGE-L; ``masks``: those of ``ref``, if known."""
    if len(cand) == 0 or len(ref) == 0:
        return 0.0
    lcs = lcs_length(list(ref), list(cand), masks)
    return _f(lcs / len(cand), lcs / len(ref))


def rouge_lsum(cand_sents, ref_sents) -> float:
    """Summary-level LCS: union of per-sentence LCS hits, clipped by token counts."""
    ref_sents = [list(s) for s in ref_sents if len(s)]
    cand_sents = [list(s) for s in cand_sents if len(s)]
    m = sum(len(s) for s in ref_sents)
    n = sum(len(s) for s in cand_sents)
    if m == 0 or n == 0:
        return 0.0
    cnt_r, cnt_c = Counter(), Counter()
    for s in ref_sents:
        cnt_r.update(s)
    for s in cand_sents:
        cnt_c.update(s)
    hits = 0
    cand_masks = [_masks(c) for c in cand_sents]
    for r in ref_sents:
        union = sorted({i for c, k in zip(cand_sents, cand_masks) for i in lcs_indices(r, c, k)})
        for i in union:
            tok = r[i]
            if cnt_c[tok] > 0 and cnt_r[tok] > 0:
                hits += 1
                cnt_c[tok] -= 1
                cnt_r[tok] -= 1
    return _f(hits / n, hits / m)


class _Reference:
    """A reference's tokens and n-gram counts, made once for all its candidates."""

    def __init__(self, text: str, metrics):
        self.text = text
        self.low = text.lower()
        if "bleu" in metrics:
            self.words = _BLEU_TOK.findall(text)
            self.grams = [_grams(self.words, n) for n in range(1, 5)]
        self.tokens = _TOK.findall(self.low)
        if "rougeL" in metrics or "rougeLsum" in metrics:
            self.masks = _masks(self.tokens)
        if "rougeLsum" in metrics:
            self.lines = [_TOK.findall(x) for x in self.low.split("\n")]
        self.counts = {n: _grams(self.tokens, n) for n, name in ((1, "rouge1"), (2, "rouge2")) if name in metrics}


def pair_scores(candidate: str, ref: _Reference, metrics) -> list:
    """The asked metrics of one pair."""
    out: dict = {}
    if "bleu" in metrics:
        out["bleu"] = bleu(_BLEU_TOK.findall(candidate), ref.words, ref.grams)
    low = candidate.lower()
    tokens = _TOK.findall(low)
    for n in ref.counts:
        out[f"rouge{n}"] = rouge_n(tokens, ref.tokens, n, ref.counts[n])
    if "rougeL" in metrics or "rougeLsum" in metrics:
        out["rougeL"] = out["rougeLsum"] = rouge_l(tokens, ref.tokens, ref.masks)
        # one sentence each: the union LCS is the LCS itself, and every LCS token
        # is within both token counts, so ROUGE-Lsum equals ROUGE-L exactly
        if "rougeLsum" in metrics and ("\n" in low or "\n" in ref.low):
            out["rougeLsum"] = rouge_lsum([_TOK.findall(x) for x in low.split("\n")], ref.lines)
    return [out[m] for m in metrics]


def pair_metrics(pairs: DataFrame, keys, metrics=METRICS, candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """M1-M5 of every pair in one pass; NULL where the gate fails."""
    metrics = list(metrics)
    out = T.StructType([T.StructField(m, T.DoubleType()) for m in metrics])

    @F.pandas_udf(out)
    def score(cand: pd.Series, ref: pd.Series) -> pd.DataFrame:
        last, rows = None, []
        for c, r in zip(cand, ref):
            if c is None or r is None:
                rows.append([None] * len(metrics))
                continue
            if last is None or last.text != r:
                last = _Reference(r, metrics)
            rows.append(pair_scores(c, last, metrics))
        return pd.DataFrame(rows, columns=metrics, dtype="float64")

    gate = scoring_gate(candidate, reference)
    r = pairs.select(*keys, score(F.when(gate, F.col(candidate)), F.when(gate, F.col(reference))).alias("_r"))
    return r.select(*keys, *[F.col(f"_r.{m}").alias(m) for m in metrics])


# ---------------------------------------------------------------------------
# Embedding cosine (M6) and pluggable scorers (M7)
# ---------------------------------------------------------------------------

def cosine(a, b) -> Column:
    """M6: cosine similarity of two numeric arrays (NULL when a norm is 0)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                            lambda acc, x: acc + x))
    nb = F.sqrt(F.aggregate(F.transform(b, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                            lambda acc, x: acc + x))
    return F.try_divide(dot, na * nb)


def score_pairs(pairs: DataFrame, keys, scorer_factory, metric: str, candidate: str = "candidate",
                reference: str = "reference", batch_size: int = 256, guard_masks: bool = False) -> DataFrame:
    """M7: run a per-pair scorer over Arrow batches.

    ``scorer_factory()`` is called once per partition (model load amortized)
    and returns ``f(list[str], list[str]) -> list[float | None]``.  Pairs failing
    the gate (B10) get NULL, and with ``guard_masks`` pairs with a ``<mask>`` token
    too (B9; the scorer never sees them); a scorer error on one pair gives NULL for that
    pair only."""
    keys = list(keys)
    ok = scoring_gate(candidate, reference)
    if guard_masks:
        ok = ok & ~mask_guard(candidate, reference)
    src = pairs.select(*keys, candidate, reference, ok.alias("_ok"))
    out_schema = T.StructType([f for f in src.schema.fields if f.name in keys] + [T.StructField(metric, T.DoubleType())])

    def run(it):
        scorer = scorer_factory()
        for pdf in it:
            vals = [None] * len(pdf)
            ok = pdf["_ok"].to_numpy()
            idx = [i for i in range(len(pdf)) if ok[i]]
            for s in range(0, len(idx), batch_size):
                chunk = idx[s:s + batch_size]
                c = [pdf[candidate].iat[i] for i in chunk]
                r = [pdf[reference].iat[i] for i in chunk]
                try:
                    res = scorer(c, r)
                except Exception:  # noqa: BLE001 - fall back to per-pair isolation
                    res = []
                    for ci, ri in zip(c, r):
                        try:
                            res.append(scorer([ci], [ri])[0])
                        except Exception:  # noqa: BLE001
                            res.append(None)
                for i, v in zip(chunk, res):
                    vals[i] = None if v is None else float(v)
            out = pdf[keys].copy()
            out[metric] = pd.Series(vals, dtype="float64")
            yield out

    return src.mapInPandas(run, out_schema)


def jaccard_scorer_factory():
    """Deterministic stand-in scorer: Jaccard of lowercase ``[a-z0-9]+`` token sets."""
    import re
    tok = re.compile(ROUGE_TOKEN)

    def score(cands, refs):
        out = []
        for c, r in zip(cands, refs):
            a, b = set(tok.findall(c.lower())), set(tok.findall(r.lower()))
            u = a | b
            out.append(len(a & b) / len(u) if u else 0.0)
        return out
    return score
