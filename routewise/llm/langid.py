"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed bigrams and trigrams of the lower-cased letters (word
edges marked) in every labelled text: each task adds its texts into one
languages x buckets count matrix, and the matrices are summed by Spark.  The
log-probability matrix (bounded by ``MAX_LANGS`` x ``2 * BUCKETS``) is broadcast
and every batch is scored with sparse gathers in numpy.

The posterior only compares the learned languages.  Whether a text is in one of
them at all is told by its ``fit``: its mean log probability per n-gram less
what the language's training texts reach on average, with a slack of
``SLACK_SDS`` standard errors for short texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
ties go to the smaller language name; repeated rows are scored alike; with no
training rows everything is ``und``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, ship, tidy, worker_cache

ship(__name__)

BUCKETS = 1 << 15
MAX_LANGS = 256
SMOOTHING = 0.5
UNKNOWN = "und"
SLACK_SDS = 3.0


def _is_letter() -> np.ndarray:
    return worker_cache("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def _text_runs(texts: list) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += 0 if t is None else len(t)
        if size >= CHUNK_BYTES // 4:  # n-gram arrays hold some 100 bytes per character
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def ngram_buckets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text each belongs to (ascending)."""
    low = [("" if t is None else t.lower()) + "\n" for t in texts]
    raw = "".join(low).encode("utf-32-le", "surrogatepass")
    cp = np.frombuffer(raw, np.uint32)
    c = np.where(_is_letter()[cp], cp, 0).astype(np.uint32)
    at = np.flatnonzero(c)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    row = np.searchsorted(ends, at, side="right")
    left = np.where(at > 0, c[at - 1], 0).astype(np.uint32)
    right = c[at + 1]  # every text ends with a line break
    mid = c[at]
    bi = (mid * np.uint32(0x9E3779B1) + right) * np.uint32(0x85EBCA6B)
    tri = ((left * np.uint32(0x9E3779B1) + mid) * np.uint32(0xC2B2AE35) + right) * np.uint32(0x27D4EB2F)
    out = np.empty(2 * len(at), np.int64)
    out[0::2] = bi >> np.uint32(17)
    out[1::2] = (tri >> np.uint32(17)).astype(np.int64) + BUCKETS
    return out, np.repeat(row, 2)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Fit on every row with a non-null language; returns ``{langs, logp, prior}``."""
    def count(batches):
        names: dict[str, int] = {}
        rows: list[np.ndarray] = []
        docs: list[int] = []
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in _text_runs(texts):
                bucket, row = ngram_buckets(texts[lo:hi])
                ids = np.empty(hi - lo, np.int64)
                for i, name in enumerate(langs[lo:hi]):
                    if name not in names:
                        if len(names) >= MAX_LANGS:
                            raise ValueError(f"more than {MAX_LANGS} languages")
                        names[name] = len(names)
                        rows.append(np.zeros(2 * BUCKETS, np.int64))
                        docs.append(0)
                    ids[i] = names[name]
                    docs[ids[i]] += 1
                of = ids[row]
                for k in np.unique(of):
                    rows[k] += np.bincount(bucket[of == k], minlength=2 * BUCKETS)
        for name, k in names.items():
            at = np.flatnonzero(rows[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(rows[k][at], docs[k]))],
                names=["lang", "bucket", "n"])

    src = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    counts = (src.mapInArrow(tidy(count), "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    got = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(MAX_LANGS + 1).collect()
    if len(got) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(r["lang"] for r in got)
    logp = np.zeros((2 * BUCKETS, len(langs)))
    docs = np.zeros(len(langs))
    for r in got:
        k = langs.index(r["lang"])
        for bucket, n in r["c"]:
            if bucket < 0:
                docs[k] = n
            else:
                logp[bucket, k] = n
    seen = logp.copy()
    if langs:
        logp += SMOOTHING
        for part in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
            logp[part] = np.log(logp[part] / logp[part].sum(0))
    total = np.maximum(seen.sum(0), 1)
    mean = (seen * logp).sum(0) / total
    sd = np.sqrt(np.maximum((seen * logp ** 2).sum(0) / total - mean ** 2, 0))
    return {"langs": langs, "logp": logp, "prior": np.log(docs / docs.sum()) if langs else docs, "mean": mean, "sd": sd}


def score_texts(model: dict, texts: list) -> tuple[list, np.ndarray]:
    """Best language and its posterior for each text."""
    return score_fits(model, texts)[:2]


def score_fits(model: dict, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Best language, its posterior and the best fit to any language (0 or more: as likely per
    n-gram as its training texts; minus infinity without a letter) for each text."""
    langs, n = model["langs"], len(texts)
    names, post, fit = [UNKNOWN] * n, np.zeros(n), np.full(n, -np.inf)
    if not langs:
        return names, post, fit
    for lo, hi in _text_runs(texts):
        bucket, row = ngram_buckets(texts[lo:hi])
        if not len(bucket):
            continue
        first = np.flatnonzero(np.diff(row, prepend=-1))
        some = row[first]
        ll = np.empty((len(some), len(langs)))
        for k in range(0, len(langs), 8):
            ll[:, k:k + 8] = np.add.reduceat(model["logp"][:, k:k + 8][bucket], first, axis=0)
        size = np.diff(np.append(first, len(row)))
        per = ll / size[:, None]
        ll += model["prior"]
        best = ll.argmax(1)
        p = np.exp(ll - ll.max(1, keepdims=True))
        p = p[np.arange(len(some)), best] / p.sum(1)
        for r, k, x in zip(some, best, p):
            names[lo + r], post[lo + r] = langs[k], x
        if "mean" in model:
            fit[lo + some] = (per - model["mean"] + SLACK_SDS * model["sd"] / np.sqrt(size)[:, None]).max(1)
    return names, post, fit


def predict(model: dict, docs: DataFrame, keep: list, text: str = "text", fit: str | None = None) -> DataFrame:
    """``keep`` columns of every row plus ``lang_pred`` and ``score``, and the fit in a column named ``fit``."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    if fit:
        schema = schema.add(fit, "double")

    def run(batches):
        m = model.value
        for b in batches:
            names, post, fits = score_fits(m, b.column(b.num_columns - 1).to_pylist())
            more = {fit: pa.array(fits)} if fit else {}
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(post), *more.values()],
                                             names=[*b.schema.names[:-1], "lang_pred", "score", *more])

    return src.mapInArrow(tidy(run), schema)
