"""Jaccard join, packing, exact and approximate search."""

from collections import Counter
from pathlib import Path
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routewise.llm import common, jaccard_join, packing, topk, vptree
from routewise.llm.common import string_chunks, table
from routewise.llm.queries import op9_vptree, vocabulary_path

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def _plain_components(rows):
    """Sizes and component ids by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d if d is not None else -1, len(s), -1 if least.get(find(i)) is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))))


def _joined(df):
    none = lambda x: -1 if x is None else x
    return sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"])) for r in jaccard_join.join(df).collect())


def _corpus(seed, families=6, passages=2):
    """Texts with exact copies, families of graded edits, chains and passages shared by most texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    shared = [[word() for _ in range(30)] for _ in range(passages)]
    rows = []
    for f in range(families):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        if rng.random() < 0.7:
            base = rng.choice(shared) + base
        now = base
        for _ in range(rng.randint(1, 14)):
            text = list(now)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                now = text  # a chain: later edits start here
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\n", "  "]).join(text).upper() if rng.random() < 0.2 else " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MARK_BITS", 18)
    monkeypatch.setattr(jaccard_join, "ID_BITS", 16)
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 256)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4 * seed)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_PARTNERS", 2)
    rows = _corpus(seed, families=14)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _joined(df) == _plain_components(rows)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_family_near_the_threshold(spark, seed, monkeypatch):
    """Members edited so much that some link with the text they come from, some only with one another, and
    most with nothing: the family is solved in blocks, and the index gives none of its pairs."""
    monkeypatch.setattr(jaccard_join, "MARK_BITS", 18)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK_PARTNERS", 10)
    given = []
    monkeypatch.setattr(jaccard_join, "_candidates", lambda *a, plain=jaccard_join._candidates: given.append(plain(*a)) or given[-1])
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(260)]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        return text

    texts = [base, *[edited(base, rng.choice([3, 6, 8, 9, 10, 12])) for _ in range(80)]]
    texts += [edited(texts[rng.randrange(40, 80)], 2) for _ in range(12)]  # linked with a member that is linked with nothing else
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = _plain_components(rows)
    assert 5 < len({c for _, _, c in want}) < 70
    assert _joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want
    assert given[0].count() <= 20


def test_jaccard_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert _joined(edge_docs) == _plain_components([(d, t) for d, t in rows])
    assert jaccard_join.join(no_docs).count() == 0


def test_jaccard_threshold_is_inclusive(spark):
    words = [f"w{i}" for i in range(18)]
    a, b = words[:11], words[:9] + ["p", "q"]  # 7 shingles each, 5 shared: 5/9
    c = words[:13]  # 9 shingles, 7 shared with a: 7/9
    d = words[:12]  # 8 shingles; with a 7/8, with c 8/9
    e = [f"v{i}" for i in range(8)]  # 4 shingles
    f = e[:7]  # 3 shingles, all shared: exactly 3/4
    rows = [(i, " ".join(t)) for i, t in enumerate([a, b, c, d, e, f])]
    assert _joined(spark.createDataFrame(rows, "doc_id long, text string")) == _plain_components(rows)
    assert dict((x[0], x[2]) for x in _plain_components(rows))[5] == 4


def test_list_pairs_keeps_every_possible_pair():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(2, 30)
        size = rng.integers(1, 60, n)
        pos = np.array([rng.integers(0, jaccard_join.prefix_length(int(s))) for s in size])
        hub = rng.integers(0, 4, n)
        want = set()
        for i in range(n):
            for j in range(i):
                need = jaccard_join.needed_overlap(int(size[i]), int(size[j])) - jaccard_join.shared_shingles(int(min(size[i], size[j]))) + 1
                if hub[i] != hub[j] and 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j]) and min(size[i] - pos[i], size[j] - pos[j]) >= need:
                    want.add((j, i))
        a, b = jaccard_join.list_pairs(size, pos, hub)
        assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want


def test_shingles_do_not_cross_texts():
    texts = ["a b c d e f", "", "g h", None, "i j k l m n o"]
    for _, _, data, offs in string_chunks(pa.array(texts)):
        assert [len(s) for s in jaccard_join.shingle_sets(data, offs)] == [2, 0, 1, 0, 3]


# ---- packing ----

def _check_pieces(pieces, docs, window=1024):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path())
    ids = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for d, x in docs}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
        part = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0
            at += p["length"]
        assert at == len(ids[d])
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_packing_covers_every_token_once(spark):
    docs = table(spark, SF001, "documents")
    _check_pieces(packing.pack(docs, vocabulary_path()).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing_small_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    docs = table(spark, SF001, "documents")
    _check_pieces(packing.pack(docs, vocabulary_path(), window=256).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 256)


def test_packing_edges(spark, edge_docs, no_docs):
    got = packing.pack(edge_docs, vocabulary_path()).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == sum(r["length"] for r in got if r["doc_id"] == 2) == 1
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 2 * sum(r["length"] for r in got if r["doc_id"] is None)
    assert packing.pack(no_docs, vocabulary_path()).count() == 0


def test_packing_neighbours_match_plain_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 60, rng.integers(3, 40)).astype(np.uint32) for _ in range(40)]
    index, n = packing.ShardIndex(docs), len(docs)
    mean = np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(60)}

    def gain(t, d):
        tf = (docs[d] == t).sum()
        return np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) if tf else 0.0

    for seed in range(5):
        terms = sorted((t for t in set(docs[seed].tolist()) if 1 < df[t] <= n // 2), key=lambda t: (-round(gain(t, seed), 9), t))[:packing.QUERY_TERMS]
        unused = np.ones(n, bool)
        unused[[seed, 7, 8]] = False
        score = {d: sum(gain(t, d) for t in terms) for d in range(n) if unused[d]}
        got = index.neighbours(seed, unused)
        assert [score[d] for d in got] == pytest.approx(sorted(score.values(), reverse=True)[:len(got)])


def test_packing_joins_related_documents():
    a, b = np.arange(100, 130, dtype=np.uint32), np.arange(200, 230, dtype=np.uint32)
    docs = [np.append(x, np.uint32(1000 + i)) for i, x in enumerate([a, b, a, b, a, b])]
    first = [d for d, _, _ in packing.plan(docs, 93)[0]]
    assert first == [0, 2, 4]


def test_packing_asks_until_no_neighbour_is_left():
    """30 documents share one weak term each with the seed's 40; every other one is unrelated."""
    strong = np.repeat(np.arange(100, 120, dtype=np.uint32), 3)
    seed = np.concatenate([strong, np.arange(200, 220, dtype=np.uint32)])
    docs = [seed, strong]
    for i in range(30):
        docs += [np.array([3000 + 2 * i, 3001 + 2 * i, 5000 + i % 5], np.uint32), np.array([200 + i % 20, 400 + i], np.uint32)]
    first = [d for d, _, _ in packing.plan(docs, len(seed) + len(strong) + 60)[0]]
    assert first[:2] == [0, 1] and sorted(first[2:]) == list(range(3, 62, 2))


def _shard_neighbours(docs, shard_docs, k=5):
    """Share of the k best corpus-wide BM25 neighbours that are in a document's own shard, and the same for shards dealt at random."""
    n = len(docs)
    df = np.zeros(max(int(d.max()) for d in docs) + 1, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    corpus = packing.Corpus(n, df, float(np.mean([len(d) for d in docs])))
    top = [corpus.strongest(d) for d in docs]
    member = np.bincount([t for x in top for t in x if t >= 0], minlength=len(df))
    own = [packing.keys(x, member) for x in top]
    pairs = Counter(k for k in own if k[0] >= 0)
    first = np.zeros(len(df), np.int64)
    for (a, _), c in pairs.items():
        first[a] += c
    links = {a: (a, b, c) for (a, b), c in sorted(pairs.items(), key=lambda x: x[1])}
    deal = packing.Deal(n, first, list(links.values()), {p: c for p, c in pairs.items() if c > shard_docs})
    shard = np.array([deal.of(k, i * 7919) for i, k in enumerate(own)])
    index, hits, total = packing.ShardIndex(docs, corpus), 0, 0
    for seed in range(0, n, max(1, n // 200)):
        unused = np.ones(n, bool)
        unused[seed] = False
        best = index.neighbours(seed, unused)[:k]
        hits, total = hits + int((shard[best] == shard[seed]).sum()), total + len(best)
    return hits / total, float(np.mean(np.bincount(shard)[shard] / n)), np.bincount(shard)


@pytest.mark.parametrize("n", [200, 800, 3200])
def test_packing_deals_related_documents_together(n, monkeypatch):
    """Topics of ten documents each; neighbours share the shard at every size."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    rng = np.random.default_rng(n)
    docs = []
    for i in range(n):
        topic = 5000 + 30 * (i % (n // 10))
        docs.append(np.concatenate([rng.integers(0, 3000, 60), rng.integers(topic, topic + 30, 25)]).astype(np.uint32))
    share, chance, sizes = _shard_neighbours(docs, 100)
    assert share > 0.6 and (n < 800 or share > 3 * chance) and sizes.max() <= 300


def test_packing_splits_hot_terms(monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    rng = np.random.default_rng(1)
    same = np.concatenate([np.arange(9000, 9030), np.arange(30)]).astype(np.uint32)
    docs = [same] * 900 + [rng.integers(0, 3000, 60).astype(np.uint32) for _ in range(1200)]
    _, _, sizes = _shard_neighbours(docs, 100)
    assert sizes.max() <= 300


def test_packing_query_shards_keep_related_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    few = table(spark, SF001, "documents").limit(150).select("doc_id", "text")
    docs = few.union(spark.createDataFrame([(10 ** 6 + i, "zebra quagga " * 30) for i in range(8)], "doc_id long, text string"))
    got = packing.pack(docs, vocabulary_path()).collect()
    assert len({p["sequence_id"] >> 32 for p in got}) > 1
    assert len({p["sequence_id"] >> 32 for p in got if p["doc_id"] >= 10 ** 6}) == 1


def test_packing_takes_terms_of_many_documents_at_once():
    """Strongest terms and keys of a batch, whatever its cuts, equal those of every document on its own."""
    rng = np.random.default_rng(5)
    docs = [np.append(rng.zipf(1.3, int(n)) % 900 + 1, 0).astype(np.uint32) for n in rng.integers(0, 300, 400)] + [np.zeros(1, np.uint32)] * 3
    n, size = len(docs), np.array([len(d) for d in docs])
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=901)
    doc, term, tf = packing.term_counts(np.concatenate(docs), size)
    assert [(a, b, c) for a, b, c in zip(doc.tolist(), term.tolist(), tf.tolist())] == [
        (i, t, c) for i, d in enumerate(docs) for t, c in sorted(Counter(d.tolist()).items())]
    corpus = packing.Corpus(n, df, float(size.mean()))
    want = []
    for d in docs:
        t, f = np.unique(d, return_counts=True)
        t, f = t[corpus.useful[t]], f[corpus.useful[t]]
        gain = corpus.idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / corpus.mean))
        want.append([x for _, x in sorted(zip((-gain).round(9).tolist(), t.tolist()))][:packing.KEY_TERMS])
    top = corpus.strongest_of(np.concatenate(docs), size)
    assert [[t for t in row if t >= 0] for row in top.tolist()] == want
    member = np.bincount(top[top >= 0], minlength=901)
    two = []
    for row in want:
        fit = sorted((t for t in row if member[t] > 1), key=lambda t: (-member[t] if member[t] <= packing.SHARD_DOCS else member[t], t))
        two.append([*fit, -1, -1][:2])
    assert packing.keys_of(top, member).tolist() == two
    raw = pa.array([d[:-1].astype("<u2").tobytes() for d in docs], pa.binary())
    parts = list(packing.token_chunks(raw.slice(3), "<u2", 0))
    assert np.concatenate([ids for ids, _ in parts]).tolist() == np.concatenate(docs[3:]).tolist()
    assert np.concatenate([k for _, k in parts]).tolist() == size[3:].tolist()


def test_packing_keys_of_hot_terms(monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 10)
    member = np.array([0, 1, 5, 10, 11, 900, 5])
    rows = np.array([[1, 2, 3, 4], [5, 4, -1, -1], [2, 6, 0, -1], [1, -1, -1, -1]])
    assert packing.keys_of(rows, member).tolist() == [[3, 2], [4, 5], [2, 6], [-1, -1]]


def test_packing_reads_postings_of_unused_documents_only(monkeypatch):
    """Used documents leave the postings while a shard is planned; sequences are those of the whole postings."""
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 400, rng.integers(5, 60)).astype(np.uint32) for _ in range(300)]
    read, scores = [], packing.ShardIndex.scores

    def counted(index, seed):
        read.append(len(index.post_doc))
        return scores(index, seed)

    monkeypatch.setattr(packing.ShardIndex, "scores", counted)
    got = packing.plan(docs, 100)
    lean, read = read, []
    monkeypatch.setattr(packing.ShardIndex, "forget", lambda index, unused: None)
    assert packing.plan(docs, 100) == got
    assert len(lean) == len(read) and sum(lean) < 0.65 * sum(read) and lean[-1] < 0.1 * read[-1]


# ---- search ----

def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, v int, g int, score double")


def _rows(x, start=0):
    return [(start + i, [float(c) for c in v], 0, "x", 1, 2, 0.0) for i, v in enumerate(x)]


ODD = [(900, None, 0, "", 0, 0, 0.0), (800, [1.0, None, 0.0], 0, "", 0, 0, 0.0), (700, [float("nan"), 0.0, 0.0], 0, "", 0, 0, 0.0),
       (600, [float("inf"), 0.0, 0.0], 0, "", 0, 0, 0.0), (500, [], 0, "", 0, 0, 0.0), (400, [1.0], 0, "", 0, 0, 0.0), (None, [1.0, 0.0, 0.0], 0, "", 0, 0, 0.0)]


def _plain_topk(rows, every, k):
    good = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(np.int64)) for i, v, *_ in rows]
    out = []
    for i, q in good:
        if i % every == 0:
            best = sorted((-int(q @ x), j) for j, x in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(set(out))


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_topk_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(topk, "PIVOTS", 5)
    monkeypatch.setattr(topk, "DATA_CHUNK", chunk)
    monkeypatch.setattr(topk, "QUERY_CHUNK", chunk)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(120, 3)), np.repeat(rng.normal(size=(2, 3)), 30, axis=0), np.zeros((3, 3))])
    rows = _rows(x)
    got = topk.top_k(_vectors(spark, rows + ODD), F.col("id") % 10 == 0, k=6).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == _plain_topk(rows, 10, 6)


@pytest.mark.parametrize("times,pivots,run", [(1, 2048, 2048), (2, 2048, 7), (11, 2048, 7), (12, 3, 5), (25, 2048, 2048)])
def test_topk_repeated_query_ids(spark, monkeypatch, times, pivots, run):
    """Rows of the query's own id never take the place of others."""
    monkeypatch.setattr(topk, "PIVOTS", pivots)
    monkeypatch.setattr(topk, "BOUND_ROWS", run)
    rng = np.random.default_rng(times)
    x = np.concatenate([np.tile(rng.normal(size=(1, 4)) * 9, (times, 1)), rng.normal(size=(2, 4)) * 9, rng.normal(size=(40, 4))]).astype(np.float32)
    ids = [0] * times + [0, 50] + list(range(1, 41))
    rows = [(i, [float(c) for c in v], 0, "x", 1, 2, 0.0) for i, v in zip(ids, x)]
    q = np.floor(x.astype(np.float64) * topk.SCALE)
    want = []  # every query row has ranks of its own
    for a in range(len(ids)):
        if ids[a] % 50 == 0:
            score = sorted((-int(q[a] @ q[b]), ids[b]) for b in range(len(ids)) if ids[a] != ids[b])
            want += [(ids[a], n + 1, i, -s) for n, (s, i) in enumerate(score[:10])]
    want.sort()
    got = topk.top_k(_vectors(spark, rows), F.col("id") % 50 == 0, k=10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


@pytest.mark.parametrize("top", [1e4, 1e5, 1e8, 1e20])
def test_topk_large_components(spark, top):
    """Components beyond what doubles multiply exactly, beside ordinary ones."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(40, 4)), rng.normal(size=(30, 4)) * top])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    ints = [[int(np.floor(1024 * c)) for c in v] for _, v in rows]
    want = []
    for i in range(0, 70, 10):
        best = sorted((-sum(a * b for a, b in zip(ints[i], ints[j])), j) for j in range(70) if j != i)[:6]
        want += [(i, n + 1, j, max(-2**63 + 1, min(2**63 - 1, -s))) for n, (s, j) in enumerate(best)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("id") % 10 == 0, k=6).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


@pytest.mark.parametrize("budget", [1 << 24, 100])
def test_topk_writes_no_copies_of_rows(spark, monkeypatch, budget):
    """Vectors without clusters, whose group bounds rule out next to nothing: what is written does not grow with rows times groups."""
    written = []

    def counted(df, name, write=topk.write_shared):
        out = write(df, name)
        written.append(out.count())
        return out
    monkeypatch.setattr(topk, "write_shared", counted)
    monkeypatch.setattr(topk, "PIVOTS", 10)
    if hasattr(topk, "QUERY_BYTES"):
        monkeypatch.setattr(topk, "QUERY_BYTES", budget)
    rows = _rows(np.random.default_rng(8).normal(size=(1500, 3)))
    got = topk.top_k(_vectors(spark, rows), F.col("id") % 50 == 0, k=4).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == _plain_topk(rows, 50, 4)
    tasks = 8
    assert sum(written) <= 30 + 30 * 4 * tasks


def test_topk_few_candidates_and_repeats(spark):
    rows = _rows([[1, 0, 0], [0.5, 0, 0], [0.5, 0, 0]])
    got = topk.top_k(_vectors(spark, rows), F.col("id") == 0, k=10).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 524288), (2, 2, 524288)]
    again = _vectors(spark, rows + rows[1:2])
    assert [r["vec_id"] for r in topk.top_k(again, F.col("id") == 0, k=10).orderBy("rank").collect()] == [1, 1, 2]
    assert topk.top_k(_vectors(spark, []), F.col("id") == 0).count() == 0
    assert topk.top_k(_vectors(spark, ODD[:3]), F.col("id") == 0).count() == 0


def _plain_nearest(ids, x, every, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in zip(ids, unit):
        if i % every == 0:
            best = sorted((-round(float(q @ y), 12), j) for j, y in zip(ids, unit) if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def test_vptree_exact_at_slack_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 64)
    monkeypatch.setattr(vptree, "LEAF", 4)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 3)), np.tile(rng.normal(size=(1, 3)), (25, 1))]).astype(np.float32)
    got = vptree.nearest(_vectors(spark, _rows(x) + ODD + [(1000, [0.0, 0.0, 0.0], 0, "", 0, 0, 0.0)]), F.col("id") % 20 == 0, slack=1.0).collect()
    want = _plain_nearest(range(len(x)), x.astype(float), 20, 5)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == set(want)
    for q, best in want.items():
        assert [by[q][k + 1][1] for k in range(5)] == pytest.approx([s for _, s in best], abs=1e-9)


def test_vptree_recall(spark):
    rows = table(spark, SF01, "embeddings").orderBy("vec_id").collect()
    want = _plain_nearest([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), 50, 5)
    got = {}
    for r in op9_vptree(spark, SF01).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert np.mean([len({j for j, _ in best} & set(got[q])) / 5 for q, best in want.items()]) >= 0.9


def test_vptree_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 60)
    monkeypatch.setattr(vptree, "LEAF", 8)
    rows = table(spark, SF01, "embeddings").orderBy("vec_id").collect()
    want = _plain_nearest([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), 50, 5)
    got = {}
    for r in op9_vptree(spark, SF01).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(rows) > 5 * 60 and set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({j for j, _ in best} & set(got[q])) / 5 for q, best in want.items()]) >= 0.9


def test_vptree_repeated_query_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 4))
    rows = _rows(np.concatenate([x[:1], x[:1], x]))
    rows = [(0, *r[1:]) for r in rows[:2]] + [(i, *r[1:]) for i, r in enumerate(rows[2:])]
    got = vptree.nearest(_vectors(spark, rows), F.col("id") == 0, k=5, slack=1.0).collect()
    assert sorted(r["rank"] for r in got) == sorted([1, 2, 3, 4, 5] * 3)
    assert all(len({r["vec_id"] for r in got if r["rank"] == k}) == 1 for k in range(1, 6)) and len({r["vec_id"] for r in got}) == 5


def test_vptree_edges(spark):
    assert vptree.nearest(_vectors(spark, []), F.col("id") == 0).count() == 0
    got = vptree.nearest(_vectors(spark, _rows([[1e30, 0, 0], [1e-30, 0, 0], [0, 1, 0]])), F.col("id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (2, 0.0)]


def test_tasks_give_their_memory_back():
    """A worker that waits for its next task holds none of what its last one freed."""
    code = """
from routewise.llm.common import tidy
rss = lambda: int(open('/proc/self/statm').read().split()[1]) * 4096 / 1e6
last = []
def run(batches):
    held = [bytes(1000) for _ in range(200_000)]
    last.append(bytes(1000))  # lies behind them
    yield len(held)
before = rss()
assert list(tidy(run)([])) == [200_000]
assert rss() < before + 50, (before, rss())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(jaccard_join.__file__).parents[2])


def test_jaccard_plans_stay_small(spark, monkeypatch):
    """Links of hubs and of families, and the blocks of both, are jobs of their own, and their workers are left tidy."""
    frame = type(spark.range(0))
    exchanges, write, apply, names = [], common.write_shared, frame.mapInArrow, set()

    def written(df, name):
        exchanges.append(str(df._jdf.queryExecution().executedPlan()).count("Exchange "))
        return write(df, name)

    def applied(df, run, *rest):
        names.add(run.__name__)
        return apply(df, run, *rest)

    monkeypatch.setattr(common, "write_shared", written)
    monkeypatch.setattr(jaccard_join, "write_shared", written)
    monkeypatch.setattr(frame, "mapInArrow", applied)
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, words.replace("w", "v")), (4, "alone")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert max(exchanges) <= 12 and names == {"tidied"}
