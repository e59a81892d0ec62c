"""Packing: lexical retrieval.

Documents become token ids plus a separator.  Document counts of terms and the
mean length are those of the whole corpus (one number per vocabulary id).
Documents are dealt to shards of about ``SHARD_DOCS`` by lexical keys: of a
document's ``KEY_TERMS`` strongest corpus-wide BM25 terms, its key is the one
that most documents have among theirs and that still fits a shard.  Keys whose
documents mostly have another key next are put together while they fit.  Where
all terms are hotter than a shard, the coldest is split by the next, and a pair
of terms of more than a shard by a hash.
A shard builds a BM25 inverted index over its documents' tokens.  A seed document opens a window of
``window`` tokens; the unused documents that score highest for the seed's
terms are appended until the window is full or none scores above zero; only
then the next unused document follows.  The document that
crosses the window's end is cut there, and its rest is the next seed, so
windows of a shard are full; what is left at a shard's end goes into sequences
of powers of two, which need no padding.

Memory per task: one shard, closed early at ``SHARD_TOKENS`` tokens, however
many rows a key holds.  Defined results: a null or empty text is one separator;
repeated rows are packed one by one; equal inputs give equal sequences; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import ship, string_chunks, tidy, write_shared

ship(__name__)

WINDOW = 1024
SHARD_DOCS = 1024
KEY_TERMS = 16
SHARD_TOKENS = 4_000_000
#: Tokens whose terms are counted at once inside a task.
CHUNK_TOKENS = 1 << 19
#: All terms of a seed are looked up.
QUERY_TERMS = None
#: Neighbours given at once; a window asks again until it is full.
NEIGHBOURS = 12
K1, B = 1.2, 0.75
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def term_counts(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of documents of ``size`` tokens that lie one after another: document, term and count, sorted."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    kind = np.uint32 if max(1, len(size)) << bits <= 1 << 32 else np.uint64
    key = np.repeat(np.arange(len(size), dtype=kind) << kind(bits), size)
    key |= ids.astype(kind)
    key.sort()
    head = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    tf = np.diff(np.append(head, len(key)))
    key = key[head]
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64), tf


def token_chunks(column: pa.Array, narrow: str, separator: int):
    """Ids of a binary column's rows, each with its separator: flat ids and ids per row, about ``CHUNK_TOKENS`` at once."""
    col, width = column.cast(pa.large_binary()), int(narrow[2])
    if not len(col):
        return
    bufs = col.buffers()
    at = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(at, at[lo] + width * CHUNK_TOKENS, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        size = np.diff(at[lo:hi + 1]) // width
        yield np.insert(data[at[lo]:at[hi]].view(narrow).astype(np.uint32), np.cumsum(size), np.uint32(separator)), size + 1
        lo = hi


class Corpus:
    """Number of documents, documents per term and mean length of all data."""

    def __init__(self, n: int, df: np.ndarray, mean: float):
        self.n, self.df, self.mean = n, df, mean
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.useful = (df > 1) & (df <= max(2, n // 2))

    def strongest_of(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row per document (with its separator): the terms with the highest gains, padded with -1."""
        doc, term, tf = term_counts(ids, size)
        good = self.useful[term]
        doc, term, tf = doc[good], term[good], tf[good]
        loss = -(self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / self.mean)))
        out = np.full((len(size), KEY_TERMS), -1, np.int64)
        ends = np.searchsorted(doc, np.arange(len(size) + 1)).tolist()
        for d, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
            own, at = loss[lo:hi], None
            if hi - lo > KEY_TERMS:
                at = np.flatnonzero(own <= np.partition(own, KEY_TERMS - 1)[KEY_TERMS - 1])
                own = own[at]
            best = np.argsort(own, kind="stable")[:KEY_TERMS]  # terms ascend
            out[d, :len(best)] = term[lo:hi][best if at is None else at[best]]
        return out

    def strongest(self, ids: np.ndarray) -> np.ndarray:
        """The terms of one document (with its separator) with the highest gains, padded with -1."""
        return self.strongest_of(ids, np.array([len(ids)]))[0]


def keys_of(strongest: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Each document's key and the next term for it: the most frequent that fit a shard, then the
    least frequent of the others (-1: none)."""
    size, none = member[strongest], np.iinfo(np.int64).max
    size = np.where((strongest >= 0) & (size > 1), size, 0)
    rank = np.where(size <= SHARD_DOCS, SHARD_DOCS - size, size) * len(member) + strongest
    rank[size == 0] = none
    rank = np.sort(rank, axis=1)[:, :2]
    return np.where(rank == none, -1, rank % len(member))


def keys(strongest: np.ndarray, member: np.ndarray) -> tuple[int, int]:
    """Key and next term of one document."""
    a, b = keys_of(strongest[None], member)[0].tolist()
    return a, b


class Deal:
    """Shards of keys: ``first`` counts documents per key, ``links`` has ``(key, next, documents)``
    with the commonest next term of every key, ``pairs`` the key and next term of more than a shard."""

    def __init__(self, n: int, first: np.ndarray, links: list, pairs: dict):
        rest = first.copy()
        for (a, _), c in pairs.items():
            rest[a] -= c
        self.base, self.parts, self.pairs = np.zeros(len(first), np.int64), np.ones(len(first), np.int64), {}
        group, size = list(range(len(first))), rest.tolist()

        def root(t):
            while group[t] != t:
                group[t] = t = group[group[t]]
            return t

        for a, b, _ in sorted(links, key=lambda x: (-x[2], x[0])):
            if b >= 0 and first[b] and (u := root(a)) != (v := root(b)) and size[u] + size[v] <= SHARD_DOCS:
                group[u], size[v] = v, size[u] + size[v]
        shard, full, home = 0, 0, {}
        for t in np.flatnonzero(first).tolist():
            g = root(t)
            if g not in home:
                if size[g] > SHARD_DOCS:
                    continue
                if full + size[g] > SHARD_DOCS:
                    shard, full = shard + 1, 0
                home[g], full = shard, full + size[g]
            self.base[t] = home[g]
        shard += full > 0
        for t in np.flatnonzero(rest > SHARD_DOCS).tolist():
            self.base[t], self.parts[t] = shard, -(-int(rest[t]) // SHARD_DOCS)
            shard += int(self.parts[t])
        for pair, c in sorted(pairs.items()):
            self.pairs[pair] = (shard, -(-c // SHARD_DOCS))
            shard += self.pairs[pair][1]
        self.n = max(shard, -(-n // SHARD_DOCS), 1)

    def of(self, pair: tuple[int, int], deal: int) -> int:
        """Shard of a document by its keys; a hash of it decides where they do not."""
        t, second = pair
        if t < 0:
            return deal % self.n
        if pair in self.pairs:
            base, parts = self.pairs[pair]
            return base + deal % parts
        return int(self.base[t]) + ((second + 1) * 0x9E3779B1 >> 7) % int(self.parts[t])


class ShardIndex:
    """BM25 postings of one shard, by term and by document; the corpus is the shard itself unless given."""

    def __init__(self, docs: list, corpus: Corpus | None = None):
        n = len(docs)
        size = np.fromiter(map(len, docs), np.int64, n)
        doc, term, tf = term_counts(np.concatenate(docs), size)
        df = np.bincount(term)
        corpus = corpus or Corpus(n, df, max(size.mean(), 1))
        gain = corpus.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / corpus.mean))
        useful = (df[term] > 1) & corpus.useful[term]
        doc, term, gain = doc[useful], term[useful], gain[useful]
        self.n = n
        self.kept = n
        # the last seed, the best of its neighbours still to give, best first, and the others with their scores, not yet in order
        self.scored: tuple = (-1, None, None, None)
        self.by_doc = np.searchsorted(doc, np.arange(n + 1))
        self.doc_term, self.doc_gain = term, gain
        order = np.argsort(term.astype(np.uint16) if len(df) <= 1 << 16 else term, kind="stable")
        self.post_doc, self.post_gain = doc[order], gain[order]
        self.by_term = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for the seed's terms."""
        terms = self.doc_term[self.by_doc[seed]:self.by_doc[seed + 1]]
        at, size = self.by_term[terms], self.by_term[terms + 1] - self.by_term[terms]
        take = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
        return np.bincount(self.post_doc[take], self.post_gain[take], self.n)

    def forget(self, unused: np.ndarray) -> None:
        """Drop the postings of used documents, once a fifth of those left is used."""
        left = int(np.count_nonzero(unused))
        if left < 0.8 * self.kept:
            stay = unused[self.post_doc]
            self.by_term = np.concatenate([[0], np.cumsum(stay)])[self.by_term]
            self.post_doc, self.post_gain, self.kept = self.post_doc[stay], self.post_gain[stay], left

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """The next unused documents with the highest BM25 score for the seed's terms, best first."""
        if self.scored[0] != seed:
            score = self.scores(seed)
            score[~unused] = 0
            found = np.flatnonzero(score)
            self.scored = (seed, found[:0], found, -score[found])
        _, best, found, loss = self.scored
        free = np.flatnonzero(unused[best])[:NEIGHBOURS]
        while len(free) < NEIGHBOURS and len(found):
            # the first in order at once, the others only if the seed asks again
            now = np.ones(len(found), bool)
            if not len(best) and len(found) > NEIGHBOURS:
                now = loss <= np.partition(loss, NEIGHBOURS - 1)[NEIGHBOURS - 1]
            best = np.append(best, found[now][np.argsort(loss[now], kind="stable")])
            found, loss = found[~now], loss[~now]
            free = np.flatnonzero(unused[best])[:NEIGHBOURS]
        self.scored = (seed, best[free[-1] + 1:] if len(free) else best[:0], found, loss)
        return best[free].tolist()


def plan(docs: list, window: int = WINDOW, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(document, start, length)`` over the token arrays of one shard."""
    index = ShardIndex(docs, corpus)
    unused = np.ones(len(docs), bool)
    sequences, now, room, queue, fresh = [], [], window, [], 0
    seed = None
    while True:
        while queue and not unused[queue[0]]:
            queue.pop(0)
        if queue:
            d = queue.pop(0)
        else:
            if seed is not None and unused.any():
                index.forget(unused)
                queue = index.neighbours(seed, unused)
                if queue:
                    continue
                seed = None
            while fresh < len(docs) and not unused[fresh]:
                fresh += 1
            if fresh == len(docs):
                break
            d = fresh
        unused[d] = False
        if not now:
            seed, queue = d, []
        at, left = 0, len(docs[d])
        while left:
            part = min(left, room)
            now.append((d, at, part))
            at, left, room = at + part, left - part, room - part
            if not room:
                sequences.append(now)
                now, room, queue = [], window, []
                seed = d if left else None
    # the rest: sequences of powers of two, largest first
    total = window - room
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        one = []
        while size:
            d, at, part = now.pop(0)
            take = min(part, size)
            one.append((d, at, take))
            size -= take
            if take < part:
                now.insert(0, (d, at + take, part - take))
        sequences.append(one)
    return sequences


def pack(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, separator: int = 0, text: str = "text") -> DataFrame:
    """One row per piece: document, start and length in its ids, checksum, sequence and offset in it."""
    spark = docs.sparkSession
    vocabulary = bpe.load_vocabulary(vocabulary_path)
    narrow = "<u2" if vocabulary["size"] <= 1 << 16 else "<u4"
    v = spark.sparkContext.broadcast(vocabulary)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("deal"), F.col(text).alias("text"))

    vocabulary_size = vocabulary["size"]
    names = ["doc_id", "deal", "ids", "term", "n"]

    def encode(batches):
        """Ids of every document; a last row lists the task's documents per term, its documents (-1) and tokens (-2)."""
        df, n, tokens = np.zeros(max(vocabulary_size, separator + 1), np.int64), 0, 0
        for b in batches:
            out = []
            for _, _, data, offs in string_chunks(b.column(2)):
                ids, size = bpe.encode_buffer(v.value, data, offs)
                at = np.concatenate([[0], np.cumsum(size)]).tolist()
                ids, w = ids.astype(narrow), int(narrow[2])
                raw = ids.tobytes()
                out += [raw[w * x: w * y] for x, y in zip(at[:-1], at[1:])]
                _, term, _ = term_counts(ids, size)
                df += np.bincount(term, minlength=len(df))
                # the separator is a term of every document
                df[separator] += len(size) - np.count_nonzero(term == separator)
                n, tokens = n + len(size), tokens + len(ids) + len(size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.nulls(len(out), pa.list_(pa.int64())),
                                              pa.nulls(len(out), pa.list_(pa.int64()))], names=names)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([[*at.tolist(), -1, -2]]), pa.array([[*df[at].tolist(), n, tokens]])], names=names)

    def fill(batches):
        shard, count, held, tokens, corpus = None, 0, [], 0, Corpus(*counted.value)

        def close():
            nonlocal count, held, tokens
            if not held:
                return None
            arrays = [np.append(np.frombuffer(ids, narrow).astype(np.uint32), np.uint32(separator)) for _, ids in held]
            rows = []
            for sequence in plan(arrays, window, corpus):
                offset = 0
                for d, start, size in sequence:
                    rows.append((held[d][0], start, size, zlib.crc32(arrays[d][start:start + size].astype("<u4").tobytes()),
                                 len(arrays[d]), (shard << 32) | count, offset))
                    offset += size
                count += 1
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PIECES)

        for b in batches:
            for s, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if s != shard or tokens >= SHARD_TOKENS or len(held) >= 4 * SHARD_DOCS:
                    if (done := close()) is not None:
                        yield done
                    if s != shard:
                        shard, count = s, 0
                held.append((doc, ids.as_py()))
                tokens += len(held[-1][1]) // int(narrow[2]) + 1
        if (done := close()) is not None:
            yield done

    def strongest(batches):
        corpus = Corpus(*counted.value)
        for b in batches:
            for ids, size in token_chunks(b.column(2), narrow, separator):
                top = corpus.strongest_of(ids, size)
                at = np.concatenate([[0], np.cumsum(np.count_nonzero(top >= 0, axis=1))])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(top[top >= 0]))], names=["terms"])

    def picks(batches):
        for b in batches:
            size = b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            terms = np.full((len(size), KEY_TERMS), -1, np.int64)
            terms[np.arange(KEY_TERMS) < size[:, None]] = b.column(0).flatten().to_numpy(zero_copy_only=False)
            top = keys_of(terms, common.value)
            yield pa.RecordBatch.from_arrays([pa.array(top[:, 0]), pa.array(top[:, 1])], names=["a", "b"])

    def hand_out(batches):
        corpus, deal = Corpus(*counted.value), Deal(*shared.value)
        for b in batches:
            own = [k for ids, size in token_chunks(b.column(2), narrow, separator)
                   for k in map(tuple, keys_of(corpus.strongest_of(ids, size), common.value).tolist())]
            to = np.array([(deal.of(k, h % (1 << 63)), k[0]) for k, h in zip(own, b.column(1).to_pylist())], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(to[:, 0]), pa.array(to[:, 1]), b.column(0), b.column(2), b.column(1)],
                                             names=["shard", "key", "doc_id", "ids", "deal"])

    written = write_shared(src.mapInArrow(tidy(encode), "doc_id long, deal long, ids binary, term array<long>, n array<long>"), "packing-ids")
    ids = written.where("term is null").select("doc_id", "deal", "ids")

    def per_term(rows):  # at most one row per vocabulary id
        return {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}

    def dense(count):
        out = np.zeros(max(vocabulary_size, separator + 1), np.int64)
        out[list(count)] = list(count.values())
        return out

    count = per_term(written.where("term is not null").select(F.inline(F.arrays_zip("term", "n"))))
    n, tokens = count.pop(-1, 0), count.pop(-2, 0)
    counted = spark.sparkContext.broadcast((n, dense(count), max(tokens / max(n, 1), 1)))
    top = write_shared(ids.mapInArrow(tidy(strongest), "terms array<long>"), "packing-terms")
    common = spark.sparkContext.broadcast(dense(per_term(top.select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n")))))
    picked = write_shared(top.mapInArrow(tidy(picks), "a long, b long").where("a >= 0").groupBy("a", "b").count(), "packing-picks")
    first = dense(per_term(picked.select(F.col("a").alias("term"), F.col("count").alias("n"))))
    # at most one row per vocabulary id, and one per SHARD_DOCS documents
    links = [(r["a"], -r["top"]["b"], r["top"]["count"]) for r in picked.where("b >= 0").groupBy("a").agg(
        F.max(F.struct("count", (-F.col("b")).alias("b"))).alias("top")).collect()]
    pairs = {(r["a"], r["b"]): r["count"] for r in picked.where(F.col("count") > SHARD_DOCS).collect()}
    shared = spark.sparkContext.broadcast((n, first, links, pairs))
    dealt = ids.mapInArrow(tidy(hand_out), "shard long, key long, doc_id long, ids binary, deal long")
    return (dealt.repartition("shard").sortWithinPartitions("shard", "key", "deal", "doc_id").select("shard", "doc_id", "ids")
            .mapInArrow(tidy(fill), _DDL))
