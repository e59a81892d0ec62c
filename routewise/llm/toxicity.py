"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space becomes single spaces (one before and one
after it), and its n-grams of ``ORDERS`` code points are hashed to ``BUCKETS``.  A
feature is the n-gram's count per code point times its log-count ratio, the log of
its rate in texts of label 1 over that in texts of label 0 (Wang and Manning 2012);
a logistic unit weighs the features.

Training has two bounded parts.  Rates are summed by Spark over at most
``COUNT_PER_CLASS`` labelled ids of each class, as integers, so the order of tasks
changes nothing.  The weights are fitted, in one task, on at most ``FIT_PER_CLASS`` texts of each
class; a text's own share is taken out of the ratios that scale its features, since
an n-gram that only it holds would else tell its label.  Scoring is linear in the
counts: the sum of one table entry per n-gram, over the whole text, in windows of
``WINDOW`` code points.

A short text is shrunk to what texts of label 0 reach: ``PRIOR_CHARS`` code points of
their mean are added to it.  So null, empty and blank texts score like an ordinary
text of label 0.  Other defined results: repeated rows score alike; without labelled
rows of both classes every score is the share of label 1 (0 without any label); a
null id is never learned from, but scored; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, ship, write_shared

ship(__name__)

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 19
BUCKETS = 1 << BUCKET_BITS
COUNT_PER_CLASS = 20_000
FIT_PER_CLASS = 1_000
#: Integer rate of an n-gram that occurs once per code point.
UNIT = 1 << 24
WINDOW = 1 << 18
SMOOTHING = 0.01  # texts' worth of an average n-gram rate of one per code point
SCALE = 100.0
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.02, 1e-3
PRIOR_CHARS = 64
THRESHOLD = 0.5


def normal(text: str | None) -> str:
    return " " + " ".join((text or "").lower().split()) + " "


def runs(texts: list) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``CHUNK_BYTES / 4`` code points."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_BYTES // 4:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def ngrams(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, row)`` of all n-grams of the normal texts, window by window; rows ascend within one pair."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    cp = np.frombuffer(raw, np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    for lo in range(0, len(cp), WINDOW):
        part = cp[lo: lo + WINDOW + max(ORDERS) - 1]
        at = np.arange(lo, min(lo + WINDOW, len(cp)))
        row = np.searchsorted(ends, at, side="right")
        room = ends[row] - at
        h = part[: len(at)] * np.uint32(0x9E3779B1)
        for n in range(2, max(ORDERS) + 1):
            following = np.zeros(len(at), np.uint32)
            have = part[n - 1: n - 1 + len(at)]
            following[: len(have)] = have
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + following * np.uint32(0xC2B2AE35) + np.uint32(n)
            if n in ORDERS:
                inside = np.flatnonzero(room >= n)
                g = h[inside]
                g = ((g ^ (g >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> np.uint32(32 - BUCKET_BITS)
                yield g, row[inside]


def _lengths(texts: list) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _counts(chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Integer rates per bucket and class (``BUCKETS`` x 2), and texts per class, over ``chosen(doc_id, text, y)``."""
    def run(batches):
        total, docs = np.zeros((2, BUCKETS)), np.zeros(2, np.int64)
        for b in batches:
            texts, label = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), np.int64)
            docs += np.bincount(label, minlength=2)
            for lo, hi in runs(texts):
                some = [normal(t) for t in texts[lo:hi]]
                unit = UNIT // _lengths(some)
                for g, row in ngrams(some):
                    w, of = unit[row].astype(float), label[lo + row]
                    for k in (0, 1):
                        mine = of == k
                        total[k] += np.bincount(g[mine], w[mine], BUCKETS)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), *[pa.array(np.append(total[k][at], docs[k]).astype(np.int64)) for k in (0, 1)]],
            names=["bucket", "n0", "n1"])

    rows = (chosen.mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    got = rows.toArrow()  # at most BUCKETS + 1 rows of three numbers
    bucket, n = got.column("bucket").to_numpy(), np.stack([got.column(c).to_numpy() for c in ("n0", "n1")])
    out = np.zeros((2, BUCKETS))
    out[:, bucket[bucket >= 0]] = n[:, bucket >= 0]
    return out, n[:, bucket < 0].sum(1) if len(bucket) else np.zeros(2, np.int64)


def ratios(rate: np.ndarray, docs: np.ndarray, own: np.ndarray | float = 0.0, label: int | None = None) -> np.ndarray:
    """Log-count ratio of each column of ``rate`` (2 x n, in texts per class), without the share ``own`` of a text of ``label``."""
    rate = rate.copy()
    if label is not None:
        rate[label] = np.maximum(rate[label] - own, 0)
    share = docs / docs.sum()
    return np.log((rate[1] + SMOOTHING * share[1]) / docs[1]) - np.log((rate[0] + SMOOTHING * share[0]) / docs[0])


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets of a text's n-grams, their counts, and its code points."""
    t = normal(text)
    found = [np.unique(g, return_counts=True) for g, _ in ngrams([t])]
    g, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return g.astype(np.int32), np.bincount(back, np.concatenate([f[1] for f in found]), len(g)), len(t)


def _fitted(chosen: DataFrame, rate: np.ndarray, docs: np.ndarray) -> dict | None:
    """Fit in one task on at most ``FIT_PER_CLASS`` texts per class; only the table comes back."""
    order = ("__rank", "doc_id", F.xxhash64("text"))
    picked = [chosen.where(F.col("y") == k).orderBy(*order).limit(FIT_PER_CLASS).select("y", "text") for k in (0, 1)]
    known = chosen.sparkSession.sparkContext.broadcast((rate, docs))  # BUCKETS x 2 numbers

    def run(batches):
        texts = sorted((y, t or "") for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        texts = [(y, *features(t)) for y, t in texts]
        if not 0 < sum(t[0] for t in texts) < len(texts):
            return
        m = fit(texts, *known.value)
        at = np.flatnonzero(m["table"])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[m["bias"], m["clean"]], m["table"][at]]))],
                                         names=["bucket", "value"])

    got = picked[0].unionByName(picked[1]).coalesce(1).mapInArrow(run, "bucket long, value double").toArrow()  # at most BUCKETS + 2 rows
    known.destroy()
    if not got.num_rows:
        return None
    bucket, value = got.column("bucket").to_numpy(), got.column("value").to_numpy()
    table = np.zeros(BUCKETS)
    table[bucket[bucket >= 0]] = value[bucket >= 0]
    return {"table": table, "bias": float(value[bucket == -1][0]), "clean": float(value[bucket == -2][0])}


def fit(texts: list, rate: np.ndarray, docs: np.ndarray, seed: int = 0) -> dict:
    """Adam on the log loss (classes balanced) over mini-batches of ``(label, buckets, counts, size)``."""
    rng = np.random.default_rng(seed)
    y = np.array([t[0] for t in texts], float)
    rate = rate / UNIT
    at = [g for _, g, _, _ in texts]
    value = [(SCALE * n / size * ratios(rate[:, g], docs, n * (UNIT // size) / UNIT, label)).astype(np.float32) for label, g, n, size in texts]
    weight = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1))
    w, m1, m2 = np.zeros((3, BUCKETS + 1))
    step, total = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            take = order[lo: lo + BATCH]
            col = np.concatenate([at[i] for i in take])
            val = np.concatenate([value[i] for i in take])
            of = np.repeat(np.arange(len(take)), [len(at[i]) for i in take])
            z = np.bincount(of, val * w[col], len(take)) + w[-1]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) * weight[take] / len(take)
            grad = np.bincount(col, val * d[of], len(w)) + DECAY * w
            grad[-1] = d.sum()
            step += 1
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad * grad - m2)
            w -= RATE * (1 - (step - 1) / total) * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    table = SCALE * w[:-1] * ratios(rate, docs)
    clean = [float(n @ table[g]) / size for label, g, n, size in texts if label == 0]
    return {"table": table, "bias": float(w[-1]), "clean": float(np.mean(clean))}


def train(docs: DataFrame, labels: DataFrame, usable, label: str = "toxic") -> dict:
    """Fit on documents whose id passes ``usable`` (a column of ``doc_id``) and has a 0/1 label."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
             .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & usable).withColumn("__rank", F.xxhash64("doc_id")))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {"constant": sizes.get(1, 0) / max(sum(sizes.values()), 1)}
    if len(sizes) < 2:
        return share
    parts = [known.where(F.col("y") == k).orderBy("__rank", "doc_id").limit(COUNT_PER_CLASS) for k in (0, 1)]
    # at most 2 * COUNT_PER_CLASS narrow rows: broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    chosen = write_shared(chosen, "toxicity-texts")
    rate, n = _counts(chosen.select("doc_id", "text", "y"))
    return _fitted(chosen, rate, n) or share


def score_texts(model: dict, texts: list) -> np.ndarray:
    out = np.full(len(texts), model.get("constant", 0.0))
    if "table" not in model:
        return out
    for lo, hi in runs(texts):
        some = [normal(t) for t in texts[lo:hi]]
        got = np.zeros(hi - lo)
        for g, row in ngrams(some):
            got += np.bincount(row, model["table"][g], hi - lo)
        size = np.where(_lengths(some) > 2, _lengths(some), 0)  # blank: two spaces only
        z = (got * (size > 0) + PRIOR_CHARS * model["clean"]) / (size + PRIOR_CHARS) + model["bias"]
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score(model: dict, docs: DataFrame, keep: list, text: str = "text") -> DataFrame:
    """``keep`` columns of every row plus ``score`` (0 to 1, higher: label 1 likelier)."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").schema.add("score", "double")

    def run(batches):
        for b in batches:
            got = score_texts(model.value, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got)], names=[*b.schema.names[:-1], "score"])

    return src.mapInArrow(run, schema)
