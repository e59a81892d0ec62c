"""Toxicity, conversation prefix trie and spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routewise.llm import prefix_trie, spelling, toxicity
from routewise.llm.common import table
from routewise.llm.queries import op11_toxicity, op12_prefix_trie, op13_spelling

SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# ---- toxicity ----

def test_toxicity_held_out(spark):
    got = op11_toxicity(spark, SF1).join(table(spark, SF1, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 1]) >= 0.85
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 0]) <= 0.02


def _plain_ngrams(text):
    t = " " + " ".join(text.lower().split()) + " "
    return Counter(t[i:i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)), len(t)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n😀İx", max_size=30), min_size=1, max_size=4))
def test_toxicity_ngrams(texts):
    """As many n-grams per text as counted one by one, equal strings in equal buckets, none over two texts."""
    some = [toxicity.normal(t) for t in texts]
    got = [Counter() for _ in texts]
    for g, row in toxicity.ngrams(some):
        for b, r in zip(g.tolist(), row.tolist()):
            got[r][b] += 1
    for t, mine in zip(texts, got):
        alone = Counter()
        for g, _ in toxicity.ngrams([toxicity.normal(t)]):
            alone.update(g.tolist())
        want, _ = _plain_ngrams(t)
        assert mine == alone and sum(mine.values()) == sum(want.values()) and len(mine) <= len(want)


def test_toxicity_windows(monkeypatch):
    text = toxicity.normal("you are a clown " * 50 + "é")
    whole = np.sort(np.concatenate([g for g, _ in toxicity.ngrams([text, text])]))
    monkeypatch.setattr(toxicity, "WINDOW", 37)
    assert (np.sort(np.concatenate([g for g, _ in toxicity.ngrams([text, text])])) == whole).all()


def test_toxicity_plain_scores(spark):
    """Rates by the operator equal counts over a dictionary of n-grams; scores equal the sum over n-grams."""
    rows = [(i, t, y) for i, (t, y) in enumerate([("you idiot", 1), ("a fine day", 0), ("such an idiot he is", 1), ("day by day", 0)])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    rate, n = toxicity._counts(docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("y")))
    assert n.tolist() == [2, 2]
    bucket = lambda s: int([g for g, _ in toxicity.ngrams([s])][toxicity.ORDERS.index(len(s))][0])
    want = np.zeros((2, toxicity.BUCKETS))
    for _, t, y in rows:
        grams, size = _plain_ngrams(t)
        for s, c in grams.items():
            want[y, bucket(s)] += c * (toxicity.UNIT // size)
    assert (rate == want).all()
    model = toxicity.train(docs, labels, F.lit(True))
    for text in ("what an idiot", "a day", ""):
        grams, size = _plain_ngrams(text)
        total = sum(c * model["table"][bucket(s)] for s, c in grams.items()) if text else 0.0
        size = size if text else 0
        z = (total + toxicity.PRIOR_CHARS * model["clean"]) / (size + toxicity.PRIOR_CHARS) + model["bias"]
        assert toxicity.score_texts(model, [text])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, 0), (2, 0, 0), (2, None, None), (None, 1, 1), (7, 1, 5)], "doc_id long, quality int, toxic int")
    model = toxicity.train(edge_docs, labels, F.lit(True))
    got = toxicity.score(model, edge_docs, ["doc_id"]).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1  # null, empty and blank alike
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (1, 2, 3))
    again = toxicity.train(edge_docs.repartition(5), labels, F.lit(True))
    assert (again["table"] == model["table"]).all() and again["bias"] == model["bias"]
    assert toxicity.train(edge_docs, labels.limit(0), F.lit(True)) == {"constant": 0}
    assert toxicity.score(model, no_docs, ["doc_id"]).count() == 0


# ---- conversation prefix trie ----

def _plain_trie(rows):
    """``rows``: (conv_id, turn, role, text).  Every prefix of every rebuilt conversation in a dictionary."""
    convs = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    trunc = lambda c: c - int(np.fmod(c, 5))
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = tuple(convs.get(trunc(c), [])[:h] + own[h:])
    members, ends = {}, {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _trie(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(rows))).collect()),
                  key=lambda r: tuple(-1 if v is None else v for v in r))


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple(-1 if v is None else v for v in r))


def test_trie_query(spark):
    rows = [tuple(r) for r in table(spark, SF01, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in op12_prefix_trie(spark, SF01).collect()]
    assert _sorted(got) == _sorted(_plain_trie(rows)) and len(got) > 100


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_random(spark, seed):
    """Few different turns, so prefixes of all lengths are shared; long conversations and copies."""
    rnd = random.Random(seed)
    rows = []
    for c in range(60):
        n = rnd.choice([1, 2, 5, 9, 9, 30])
        rows += [(c + (c > 40) * 7, t, rnd.choice(["user", "user", None]), rnd.choice(["x", "é"])) for t in range(n)]
    for c in range(200, 240):
        rows += [(c, t, "user", "same") for t in range(11)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert _trie(frame) == _sorted(_plain_trie(rows))


def test_trie_edges(spark):
    rows = [(None, 0, "user", "x"), (3, None, None, None), (3, None, None, ""), (3, 0, "user", ""), (3, 0, "user", ""), (-7, 1, "a", "b"), (-5, 1, "a", "b"),
            (4, 0, "user", "y" * 100000), (11, 0, "u", "t"), (11, 1, "u", "t"), (11, 2, "u", "t")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, pos int, digest string")
    assert _trie(frame) == _sorted(_plain_trie(rows))
    assert _trie(frame.limit(0)) == []


def test_trie_ends_stream(spark):
    """Ids of one node come through one running digest, in numeric order."""
    ids = list(range(5, 3000))
    random.Random(0).shuffle(ids)
    got = prefix_trie.ends_digests(spark.createDataFrame([(i, 1, 2) for i in ids] + [(7, 3, 4)], "conv_id long, x long, y long").repartition(6)).collect()
    assert {(r["x"], r["y"]): r["ends_sha256"] for r in got} == {
        (1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (3, 4): hashlib.sha256(b"7").hexdigest()}


# ---- spelling ----

def _is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _plain_words(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def _plain_forms(words, near=None):
    if near is None:
        # near words share one of the spellings with one letter left out (or are such a spelling)
        by = {}
        for w in words:
            for i in range(len(w)):
                by.setdefault(w[:i] + "*" + w[i + 1:], set()).add(w)
                by.setdefault(w[:i] + w[i + 1:], set()).add(w)
            by.setdefault(w, set()).add(w)
        near = {w: set() for w in words}
        for group in by.values():
            for a in group:
                near[a] |= {b for b in group if a != b and _is_near(a, b)}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


FORMS = ["word", "form", "root", "n", "n_near", "form_n"]


def _group(docs):
    got = [tuple(r[c] for c in FORMS) for r in spelling.group(docs).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_query(spark):
    words = _plain_words([(r["doc_id"], r["text"]) for r in table(spark, SF01, "documents").collect()])
    got = {tuple(r[c] for c in FORMS) for r in op13_spelling(spark, SF01).collect()}
    assert got == _plain_forms(words) and sum(r[1] is not None for r in got) > 10


@pytest.mark.parametrize("limit", [None, 6])
def test_spelling_random(spark, monkeypatch, limit):
    """Dense neighbourhoods; with a low limit every key is hot and halved to the end."""
    if limit:
        monkeypatch.setattr(spelling, "KEY_ROWS", limit)
        monkeypatch.setattr(spelling, "SHARD_ROWS", 64)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.choice([7, 8, 9])))
    rows = [(i, " ".join(rnd.choices([word() for _ in range(40)], k=300))) for i in range(40)]
    assert _group(spark.createDataFrame(rows, "doc_id long, text string")) == _plain_forms(_plain_words(rows))


def test_spelling_hot_prefix(spark, monkeypatch):
    """A third of all words share their first half."""
    monkeypatch.setattr(spelling, "KEY_ROWS", 50)
    rnd = random.Random(4)
    some = ["commonpart" + "".join(rnd.choice("xyz") for _ in range(rnd.choice([3, 4]))) for _ in range(150)]
    some += ["".join(rnd.choice("klmn") for _ in range(8)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(some, k=200))) for i in range(20)]
    assert _group(spark.createDataFrame(rows, "doc_id long, text string")) == _plain_forms(_plain_words(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÿ", min_size=1, max_size=6), min_size=1, max_size=80, unique=True), st.booleans())
def test_position_index(words, lazy):
    before, spelling.TABLE_WORDS = spelling.TABLE_WORDS, 0 if lazy else spelling.TABLE_WORDS
    rows = [(w, ask) for ask in (False, True) for w in words]
    got = {(rows[i][0], rows[j][0]) for q, w in spelling.near_in_shard(*zip(*rows)) for i, j in zip(q.tolist(), w.tolist())}
    spelling.TABLE_WORDS = before
    assert got == {(a, b) for a in words for b in words if a != b and len(b) >= len(a) and _is_near(a, b)}


def test_spelling_chain_and_edges(spark, edge_docs, no_docs):
    """Forms lead over several steps to a root; nulls, long runs and repeated rows."""
    many = [(100 + i, t) for i, t in enumerate(["abcdefghij"] * 300 + ["abcdefghijk"] * 30 + ["abcdefghijkl"] * 2 + ["É" * 20000 + "é"] * 2 + ["É" * 20001 + "é"] * 30)]
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()] + many
    docs = edge_docs.select("doc_id", "text", F.lit(1).alias("n"), F.lit("w").alias("word")).unionByName(
        spark.createDataFrame([(i, t, 1, "w") for i, t in many], "doc_id long, text string, n int, word string"))
    got = {r[0]: r for r in _group(docs)}
    words = _plain_words(rows)
    assert set(got) == set(words) and all(got[w][3] == n for w, n in words.items())
    near = {w: {x for x in words if x != w and _is_near(w, x)} for w in words}
    assert set(got.values()) == _plain_forms(words, near)
    assert _group(no_docs) == set()
