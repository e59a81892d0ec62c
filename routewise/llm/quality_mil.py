"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE_WORDS`` words each, the whole text).
Every passage is encoded from its bytes and words (shape statistics and hashed
byte-trigram frequencies), projected to a hidden vector ``h``; gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages, and a logistic
unit scores the weighted sum (Ilse, Tomczak and Welling 2018).  Only document
labels are used.

The model is fitted on a bounded sample of labelled rows (at most
``SAMPLE_PER_CLASS`` ids of each class, chosen by a hash of the id, and where ids
repeat at most ``4 * SAMPLE_PER_CLASS`` texts, in the order of id and content; all
passages of a text count); class weights restore
the labelled proportions.  Scoring reads every passage of every text.

Defined results: null and empty texts are one all-zero passage; repeated rows
score alike; without labelled rows of both classes every score is the share of
label 1 (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, span_hashes, string_chunks, tidy, word_spans, worker_cache

ship(__name__)

PASSAGE_WORDS = 48
HASHED = 48
SHAPE = 16
WIDTH = HASHED + SHAPE
HIDDEN = 24
ATTENTION = 16
SAMPLE_PER_CLASS = 1500
EPOCHS = 60
RATE = 0.01
THRESHOLD = 0.3


def _byte_kinds() -> np.ndarray:
    """Per byte, one column per kind: upper, digit, punctuation, bar, symbol, mark, break, other alphabet."""
    def build():
        t = np.zeros((256, 8), np.float32)
        t[65:91, 0] = 1
        t[48:58, 1] = 1
        t[[i for i in range(33, 127) if not chr(i).isalnum()], 2] = 1
        t[ord("|"), 3] = 1
        t[[ord(c) for c in "#$%&*@^~"], 4] = 1
        t[ord("!"), 5] = 1
        t[10, 6] = 1
        t[128:, 7] = 1
        return t
    return worker_cache("byte_kinds", build)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of several texts and the text each belongs to (ascending; at least one per text)."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    words = np.bincount(rows, minlength=n)
    parts = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(parts)])
    bag = np.repeat(np.arange(n), parts)
    x = np.zeros((first[-1], WIDTH), np.float32)
    if not len(starts):
        return x, bag
    nth = np.arange(len(starts)) - np.concatenate([[0], np.cumsum(words)])[rows]
    of_word = first[rows] + nth // PASSAGE_WORDS
    heads = np.flatnonzero(np.diff(of_word, prepend=-1))
    used = of_word[heads]
    lo = starts[heads]
    hi = np.append(starts[heads[1:]], 0)
    last_of_row = np.append(np.diff(bag[used]) != 0, True)
    hi[last_of_row] = offsets[bag[used][last_of_row] + 1]
    size = (hi - lo).astype(np.float32)
    of_byte = np.repeat(np.arange(len(used)), hi - lo)
    take = np.arange(len(of_byte)) + np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)
    body = data[take]
    m = len(used)
    kinds = _byte_kinds()
    for k in range(kinds.shape[1]):
        hit = kinds[:, k][body] > 0
        x[used, k] = np.bincount(of_byte[hit], minlength=m) / size
    length = (ends - starts).astype(np.float32)
    h = span_hashes(data, starts, ends)
    local = np.repeat(np.arange(m), np.diff(np.append(heads, len(starts))))
    count = np.bincount(local, minlength=m).astype(np.float32)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (local[1:] == local[:-1])
    x[used, 8] = np.bincount(local, same, m) / count
    distinct = np.unique(h ^ (local.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    x[used, 9] = np.bincount(local[distinct], minlength=m) / count
    x[used, 10] = np.bincount(local, length, m) / count / 10
    x[used, 11] = np.sqrt(np.maximum(np.bincount(local, length * length, m) / count - (x[used, 10] * 10) ** 2, 0)) / 10
    x[used, 12] = np.bincount(local, length == 1, m) / count
    x[used, 13] = np.log1p(count) / 4
    upper = (data[starts] >= 65) & (data[starts] < 91) & (data[ends - 1] < 97)
    x[used, 14] = np.bincount(local, upper, m) / count
    x[used, 15] = 1
    low = body.astype(np.uint32)
    if len(low) > 2:
        tri = ((low[:-2] * np.uint32(0x9E3779B1) + low[1:-1]) * np.uint32(0x85EBCA6B) + low[2:]) * np.uint32(0xC2B2AE35)
        tri = ((tri >> np.uint32(16)) * np.uint32(HASHED)) >> np.uint32(16)
        inside = of_byte[:-2] == of_byte[2:]
        got = np.bincount(of_byte[:-2][inside] * HASHED + tri[inside], minlength=m * HASHED).reshape(m, HASHED)
        x[used, SHAPE:] = np.sqrt(got / np.maximum(size, 1)[:, None])
    return x, bag


def _forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
    """Attention-weighted passage representation and score of ``n`` bags (``bag`` ascending, none empty)."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    s = (t * g) @ p["w"]
    first = np.searchsorted(bag, np.arange(n))
    e = np.exp(s - np.maximum.reduceat(s, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "first": first}


def _gradient(p: dict, x: np.ndarray, bag: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
    n = len(label)
    f = _forward(p, x, bag, n)
    dy = (f["y"] - label) * weight / weight.sum()
    dz = dy[:, None] * p["c"]
    da = (f["h"] * dz[bag]).sum(1)
    ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[bag])
    dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
    du = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ du, "b": du.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds,
            "c": f["z"].T @ dy, "d": dy.sum()}


def fit(bags: list, labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> dict:
    """Adam on the weighted log loss over mini-batches of bags."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, std = every.mean(0), every.std(0) + 1e-3
    bags = [((b - mean) / std) for b in bags]
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION),
         "w": init(ATTENTION), "c": init(HIDDEN), "d": np.zeros(())}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            take = order[at:at + 64]
            x = np.concatenate([bags[i] for i in take])
            bag = np.repeat(np.arange(len(take)), [len(bags[i]) for i in take])
            grad = _gradient(p, x, bag, labels[take], weights[take])
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return p | {"mean": mean, "std": std}


def train(docs: DataFrame, labels: DataFrame, usable) -> dict:
    """Fit on documents whose id passes ``usable`` (a column of ``doc_id``) and has a 0/1 label."""
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("__q"))
             .where(F.col("__q").isin(0, 1) & F.col("doc_id").isNotNull() & usable))
    sizes = {r["__q"]: r["n"] for r in known.groupBy("__q").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return {"constant": sizes.get(1, 0) / total if total else 0.5}
    parts = [known.where(F.col("__q") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    # at most 2 * SAMPLE_PER_CLASS narrow rows: broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")

    def bags(batches):
        for b in batches:
            out = []
            for lo, hi, data, offs in string_chunks(b.column(1)):
                x, bag = encode(data, offs)
                for part in np.split(x, np.flatnonzero(np.diff(bag)) + 1):
                    out.append(part.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["doc_id", "q", "x"])

    got = sorted(chosen.mapInArrow(tidy(bags), "doc_id long, q int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(4 * SAMPLE_PER_CLASS).collect(),
                 key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["q"] for r in got], float)
    if not 0 < y.sum() < len(y):
        return {"constant": sizes.get(1, 0) / total}
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    return fit([np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in got], y, weight)


def score(model: dict, docs: DataFrame, keep: list, text: str = "text") -> DataFrame:
    """``keep`` columns of every row plus ``score`` (0 to 1, higher: label 1 likelier)."""
    model = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").schema.add("score", "double")

    def run(batches):
        p = model.value
        for b in batches:
            out = np.full(b.num_rows, p.get("constant", 0.5))
            if "W" in p:
                for lo, hi, data, offs in string_chunks(b.column(b.num_columns - 1)):
                    x, bag = encode(data, offs)
                    out[lo:hi] = _forward(p, (x - p["mean"]) / p["std"], bag, hi - lo)["y"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*b.schema.names[:-1], "score"])

    return src.mapInArrow(tidy(run), schema)
