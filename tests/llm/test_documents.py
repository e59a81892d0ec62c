"""Quality classifier, language ID, PII and BPE."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routewise.llm import bpe, langid, pii, quality_mil
from routewise.llm.common import components, id_crc, string_chunks, table, worker_cache
from routewise.llm.queries import op1_quality, op6_langid, op10_bpe, vocabulary_path

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---- quality ----

def test_quality_held_out(spark):
    got = op1_quality(spark, SF01).join(table(spark, SF01, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, quality_mil.WIDTH))
    bag, y, w = np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    h, a = quality_mil.HIDDEN, quality_mil.ATTENTION
    p = {"W": rng.normal(size=(quality_mil.WIDTH, h)) * 0.2, "b": rng.normal(size=h), "V": rng.normal(size=(h, a)), "U": rng.normal(size=(h, a)),
         "w": rng.normal(size=a), "c": rng.normal(size=h), "d": np.array(0.1)}

    def loss(q):
        z = quality_mil._forward(q, x, bag, 3)["y"]
        return -(w * (y * np.log(z) + (1 - y) * np.log(1 - z))).sum() / w.sum()

    grad = quality_mil._gradient(p, x, bag, y, w)
    for k in p:
        flat = np.zeros(p[k].size)
        at = rng.integers(p[k].size)
        flat[at] = 1e-5
        step = flat.reshape(p[k].shape)
        numeric = (loss(p | {k: p[k] + step}) - loss(p | {k: p[k] - step})) / 2e-5
        assert numeric == pytest.approx(np.asarray(grad[k]).ravel()[at], abs=1e-6)


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_mil.train(edge_docs, labels, F.lit(True))
    got = quality_mil.score(model, edge_docs, ["doc_id"]).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1  # null, empty and blank alike
    assert quality_mil.train(edge_docs, labels.limit(0), F.lit(True)) == {"constant": 0.5}
    assert quality_mil.score({"constant": 0.5}, no_docs, ["doc_id"]).count() == 0


# ---- language ID ----

def test_langid_held_out(spark):
    got = op6_langid(spark, SF01).join(table(spark, SF01, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_langid_matches_plain_bayes(spark):
    """Sums of log probabilities over a dictionary of n-grams, no hashing tricks but the bucket function."""
    docs = [(0, "the cat and the dog", "en"), (1, "der hund und die katze", "de"), (2, "a dog", "en"), (3, "hund", "de"), (4, "x", None)]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model["langs"] == ["de", "en"]
    counts = {"de": np.zeros(2 * langid.BUCKETS), "en": np.zeros(2 * langid.BUCKETS)}
    for _, t, lang in docs[:4]:
        for k in langid.ngram_buckets([t])[0]:
            counts[lang][k] += 1
    for name, text in (("en", "the dog"), ("de", "die hunde")):
        score = {}
        for lang, c in counts.items():
            p = c + langid.SMOOTHING
            total = [p[:langid.BUCKETS].sum(), p[langid.BUCKETS:].sum()]
            score[lang] = np.log(0.5) + sum(np.log(p[k] / total[int(k >= langid.BUCKETS)]) for k in langid.ngram_buckets([text])[0])
        best = max(score, key=score.get)
        post = 1 / sum(np.exp(s - score[best]) for s in score.values())
        (got,), (value,) = langid.score_texts(model, [text])
        assert got == best == name and value == pytest.approx(post)


def test_langid_edges(spark, edge_docs, no_docs):
    empty = langid.train(edge_docs)  # no row has a language
    assert {r["lang_pred"] for r in langid.predict(empty, edge_docs, ["doc_id"]).collect()} == {"und"}
    model = langid.train(edge_docs.withColumn("lang", F.lit("en")))
    got = {r["doc_id"]: r for r in langid.predict(model, edge_docs, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert got[5]["lang_pred"] == got[6]["lang_pred"] == "en" and got[7]["score"] == 1
    assert langid.predict(model, no_docs, ["doc_id"]).count() == 0


# ---- PII ----

VALUES = ["a.bc+1@x-y.example.org", "4041894974608795", "4041-8949-7460-8795", "70.123.182.155", "+1 (988) 555-2485", "988-555-2485", "123-45-6789",
          "2024-02-29", "02/28/1999", "28.02.1999", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]


def test_pii_replaces_and_restores():
    text = "x " + " , ".join(VALUES) + ' token = "0641917ea4e9feb9cda83477b57ac2654884f485" password=8nz6qs91rc00061'
    new, spans = pii.pseudonymize(text)
    assert len(spans) == len(VALUES) + 2
    for v in [*VALUES, "0641917ea4e9feb9cda83477b57ac2654884f485", "8nz6qs91rc00061"]:
        assert v not in new
    back, again = pii.pseudonymize(new, decrypt=True)
    assert back == text and [s[2] for s in again] == [s[2] for s in spans]
    for lo, hi, kind in spans:
        one, found = pii.pseudonymize(" " + new[lo:hi] + " ") if kind != "secret" else (None, [0])
        assert len(found) == 1  # still valid in its format
    assert pii.pseudonymize(text)[0] == new and pii.pseudonymize(text, key=b"other")[0] != new


@pytest.mark.parametrize("text", ["4041894974608796", "300.1.1.1", "1.2.3.4.5", "2023-02-30", "000-12-3456", "DE89370400440532013001", "+1 (188) 555-2485",
                                  "0000000000000000", "version 12.5", "a@b", "token one", "Plain words 499 only."])
def test_pii_leaves_clean_text(text):
    assert pii.pseudonymize(text) == (text, [])


@pytest.mark.parametrize("text,value,kind", [
    ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"), ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111", "card"),
    ("Order 12 4111 1111 1111 1111", "4111 1111 1111 1111", "card"), ("Room 1234 123-45-6789", "123-45-6789", "ssn"),
    ("2023 988-555-2485", "988-555-2485", "phone"), ("555-223-4567 1234", "555-223-4567", "phone"),
    ("GB82 WEST 1234 5698 7654 32 BIC ABCDEF", "GB82 WEST 1234 5698 7654 32", "iban"), ("DE89 3704 0044 0532 0130 00 EUR 500", "DE89 3704 0044 0532 0130 00", "iban")])
def test_pii_values_beside_numbers(text, value, kind):
    new, spans = pii.pseudonymize(text)
    assert value not in new and [k for _, _, k in spans] == [kind]
    at = text.index(value)
    assert spans[0][:2] == (at, at + len(value)) and new[:at] + new[at + len(value):] == text[:at] + text[at + len(value):]
    assert pii.pseudonymize(new, decrypt=True)[0] == text


def test_pii_restores_crowded_numbers():
    import random
    rng = random.Random(4)
    parts = ["4111 1111 1111 1111", "4041894974608795", "123-45-6789", "555-223-4567", "DE89 3704 0044 0532 0130 00", "70.123.182.155", "2024-02-29", "EUR", "AB12", "a.b@c.org"]
    for _ in range(1500):
        text = " ".join(rng.choice([rng.choice(parts), str(rng.randrange(10 ** rng.randint(1, 6)))]) for _ in range(rng.randint(2, 9)))
        new, spans = pii.pseudonymize(text)
        back, again = pii.pseudonymize(new, decrypt=True)
        assert back == text and [s[2] for s in again] == [s[2] for s in spans]


def test_pii_links_equal_values():
    a, b = (pii.pseudonymize(f"{w} 70.123.182.155 end")[0] for w in ("one", "two"))
    assert a.split()[1] == b.split()[1]


@given(size=st.integers(2, 3000), key=st.binary(min_size=1, max_size=20))
@settings(max_examples=30, deadline=None)
def test_feistel_is_a_permutation(size, key):
    values = range(min(size, 200))
    out = [pii._walk(v, size, "t", key, False) for v in values]
    assert len(set(out)) == len(out) and all(0 <= x < size for x in out)
    assert [pii._walk(x, size, "t", key, True) for x in out] == list(values)


def test_pii_table(spark, edge_docs, no_docs):
    got = pii.replace(edge_docs, ["doc_id", "score"]).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((r["doc_id"] or 0, r["text"] or "") for r in edge_docs.collect())
    assert [r["text"] for r in got if r["doc_id"] == 1] == [None] and all(r["n_pii"] == len(r["pii"]) == 0 for r in got)
    long = spark.createDataFrame([(1, "w " * 50000 + "70.123.182.155 " * 50)], "doc_id long, text string")
    row = pii.replace(long, ["doc_id"]).first()
    assert row["n_pii"] == 50 and "70.123.182.155" not in row["text"]
    assert pii.replace(no_docs, ["doc_id"]).count() == 0


# ---- BPE ----

def _encode(texts):
    v, out = bpe.load_vocabulary(vocabulary_path()), []
    for _, _, data, offs in string_chunks(pa.array(texts, pa.string())):
        ids, size = bpe.encode_buffer(v, data, offs)
        at = np.concatenate([[0], np.cumsum(size)])
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(library):
    rng = random.Random(3)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "中", " ", "　", "\x85", "\x1c",
             "<|endoftext|>", "<|endof", "\U0001F600", "aaaa", "İ", "ß", "​", "́", "Ⅷ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["a" * 5000, " " * 999, "ab" * 3000, None]
    assert _encode(texts) == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_bpe_merges_words_in_columns(library, monkeypatch):
    """Words of every size up to and beyond the columns; few slots, so that words push each other out."""
    monkeypatch.setattr(bpe, "SLOTS", 64)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 300)
    monkeypatch.setattr(bpe, "worker_cache", lambda key, build: build() if key[0] == "bpe_words" else worker_cache(key, build))
    rng = random.Random(8)
    letters = ["th", "e", "in", "a", "aa", "tion", "x", "\u00e9", "q", "ing", "\u4e2d"]
    words = ["".join(rng.choices(letters, k=60))[:n] for n in range(1, 50) for _ in range(30)] + ["a" * n for n in range(1, 70)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(300)] + words
    assert _encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    v = bpe.load_vocabulary(vocabulary_path())
    cache = bpe.WordCache()
    for k in range(0, len(words), 50):
        some = [w.encode() for w in words[k:k + 50] * 2]
        data = np.frombuffer(b"".join(some), np.uint8)
        ends = np.cumsum([len(w) for w in some])
        starts = np.append(0, ends[:-1])
        start, size = cache.lookup(v, data, starts, ends, bpe.span_hashes(data, starts, ends))
        ids, count = bpe.merge_words(v, data, starts, ends)
        assert size.tolist() == count.tolist()
        assert np.concatenate([cache.ids[a:a + n] for a, n in zip(start, size)]).tolist() == ids.tolist()
        assert np.count_nonzero(cache.size) <= 64 and cache.words <= 350


def test_bpe_pair_table_finds_every_pair():
    v = bpe.load_vocabulary(vocabulary_path())
    pairs, of_bytes = bpe.pair_ranks(v)
    assert bpe.find_pairs(pairs, v["key"]).tolist() == v["rank"].tolist()
    assert np.count_nonzero(of_bytes < bpe._NONE) == np.count_nonzero(np.isin(v["key"] // v["size"], v["byte"]) & np.isin(v["key"] % v["size"], v["byte"]))
    none = np.setdiff1d(np.arange(0, v["size"] ** 2, 9973), v["key"])
    assert (bpe.find_pairs(pairs, none) == bpe._NONE).all()


@given(st.lists(st.text(), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_bpe_any_text(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path())
    ids = _encode(texts)
    assert ids == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    v = bpe.load_vocabulary(vocabulary_path())
    assert [bpe.decode(v, np.array(i, np.int64)) for i in ids] == texts


def test_bpe_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF001, "documents").collect()}
    for r in op10_bpe(spark, SF001).collect():
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_invalid_bytes_decode_with_replacement(library):
    v = bpe.load_vocabulary(vocabulary_path())
    half = _encode(["\U0001F600"])[0][:1]
    assert bpe.decode(v, np.array(half)) == library.decode(half, skip_special_tokens=False)


def test_bpe_edges(spark, edge_docs, no_docs):
    got = bpe.encode_rows(edge_docs, ["doc_id", "score"], vocabulary_path()).collect()
    assert len(got) == edge_docs.count()
    assert all(r["n_tokens"] == 0 and bytes(r["ids"]) == b"" for r in got if r["doc_id"] in (1, 2))
    assert bpe.round_trip(no_docs, ["doc_id"], vocabulary_path()).count() == 0


# ---- shared helpers ----

def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40) if i % 7] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges for y in e if e[0] != e[1]}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_id_crc(spark):
    rows = spark.createDataFrame([(0,), (123,), (None,)], "doc_id long").select("doc_id", id_crc().alias("c")).collect()
    assert [r["c"] for r in rows] == [zlib.crc32(b"0"), zlib.crc32(b"123"), 0]
