"""Spelling variant grouping by a bit-sliced position index.

Words and their counts come from the texts by SQL functions.  Near words (exactly one
inserted, deleted or replaced code point) are found in three steps.

1. Halving.  If two words are near, the error lies in one half of the longer word and
   the other half is the same in both.  Every word is put under the key of each half
   (``index`` rows, as the longer or equally long word) and asks for the keys that it
   would share with a word as long or one longer (``ask`` rows).  A key that more than
   ``KEY_ROWS`` rows share is hot: its rows halve the open part again, until the key is
   rare or one code point is open (then at most one alphabet of words shares it).  So
   no key is capped and no pairs of a hot key are written out.
2. Keys are dealt to shards of about ``SHARD_ROWS`` rows.
3. A shard holds one bitset over its index words per (position, letter).  Words are asked
   a block at a time, letter by letter: ``same`` is the set of words equal so far, and
   two sets hold the words with one error so far, read on at the same position (a letter
   was replaced) or one further (the index word has one more).  A step is an ``and``
   with the bitset of the letter at the set's position, so 64 words advance at once.
   The verdict is exact, so a pair met in two shards is merely counted once afterwards.

A word's form is its near word of largest count; roots follow forms by pointer doubling
(counts grow at least tenfold per step, so a handful of rounds ends it).

Defined results: null texts hold no words; a null document id counts as empty text before
the colon; repeated rows count again; empty tables have no words; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, write_shared

ship(__name__)

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
DROP_ONE_IN = 31
KEY_ROWS = 1 << 11
SHARD_ROWS = 1 << 14
#: Words asked at once, and index words per set of bitsets.
ASK_BLOCK, INDEX_BLOCK = 128, 1 << 13
#: 64-bit words of a table that is held whole (64 MB).
TABLE_WORDS = 1 << 23


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: the words of all texts with their counts."""
    # a maximal run of at least LEAST_LENGTH letters: greedy matches cannot end inside a run
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.explode(runs).alias("run"))
    run = run.select("__id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = F.crc32(F.concat_ws(":", "__id", "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % DROP_ONE_IN == 0, cut).otherwise(F.col("run"))
    return (run.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT))


def _keys(rows: DataFrame) -> DataFrame:
    """The two halvings of every row: ``l`` is the length of the longer word, ``a`` and ``b`` bound its open part."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    size = F.length("word")

    def child(a, b):
        # in a word that asks for longer words, the part after ``b`` starts one earlier
        return F.struct(a.alias("a"), b.alias("b"), F.xxhash64("l", a, b, F.substring("word", F.lit(1), a), F.substring("word", b + 1 - (F.col("l") - size), size)).alias("key"))

    halves = F.array(child(mid, F.col("b")), child(F.col("a"), mid))
    return rows.select("word", "n", "ask", "l", F.explode(halves).alias("k")).select("word", "n", "ask", "l", "k.a", "k.b", "k.key")


def _shards(vocabulary: DataFrame) -> DataFrame:
    """``shard, word, n, ask``: every two near words meet in a shard, one of them asking."""
    size = F.length("word")
    roles = F.array(*[F.struct(F.lit(ask).alias("ask"), (size + more).alias("l")) for ask, more in ((False, 0), (True, 0), (True, 1))])
    rows = vocabulary.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.ask", "r.l", F.lit(0).alias("a"), F.col("r.l").alias("b"))
    done = None
    while True:
        rows = write_shared(_keys(rows), "spelling-keys")
        size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("b") - F.col("a")).alias("open"))
        # at most rows / KEY_ROWS keys
        hot = size.where((F.col("m") > KEY_ROWS) & (F.col("open") > 1)).select("key")
        hot = write_shared(hot, "spelling-hot")
        few = rows.join(hot, "key", "left_anti")
        done = few if done is None else done.unionByName(few)
        if hot.isEmpty():
            break
        rows = rows.join(hot, "key", "left_semi").drop("key")
    shards = max(1, -(-done.count() // SHARD_ROWS))
    return done.select(F.pmod("key", F.lit(shards)).alias("shard"), "word", "n", "ask")


def _letters(words: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points (one row per word, 0 after its end) and lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(size.max()) + 2), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out, size


class PositionIndex:
    """Bitsets over words: bit ``i`` of ``bits[p, c]`` says that word ``i`` has letter ``c`` at position ``p``."""

    def __init__(self, words: list):
        code, self.size = _letters(words)
        self.width = -(-len(words) // 64)
        self.alphabet = np.unique(code)
        self.alphabet = self.alphabet[self.alphabet > 0]
        self.depth = code.shape[1]
        self.code = code.T
        # a table of few positions is built once, one of very long words position by position
        brief = self.depth * (len(self.alphabet) + 1) * self.width < TABLE_WORDS
        self.bits = [self._bits(p) for p in range(self.depth)] if brief else None
        self.of_size = {int(s): self._set(self.size == s) for s in np.unique(self.size)}

    def _bits(self, place: int) -> np.ndarray:
        """Bitsets of one position, a row per letter; the last row is that of any other letter and stays empty."""
        flags = np.zeros((len(self.alphabet) + 1, 64 * self.width), bool)
        here = self.code[place]
        word = np.flatnonzero(here)
        flags[np.searchsorted(self.alphabet, here[word]), word] = True
        return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)

    def at(self, place: int) -> np.ndarray:
        return self.bits[place] if self.bits else self._bits(place)

    def _set(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(64 * self.width, bool)
        out[: len(flags)] = flags
        return np.packbits(out, bitorder="little").view(np.uint64)

    def near(self, code: np.ndarray, size: int) -> np.ndarray:
        """Flags (asked words x index words): index words of the asked ``size`` with one letter
        replaced, or one longer with one letter inserted; ``code`` holds words of one size."""
        at = np.searchsorted(self.alphabet, code[:, :size])
        at[at == len(self.alphabet)] = 0
        at[self.alphabet[at] != code[:, :size]] = len(self.alphabet)
        none = np.zeros((len(code), self.width), np.uint64)
        same = ~none
        replaced, inserted, bits = none, none, self.at(0)
        for i in range(size):
            following = self.at(i + 1)
            here, ahead = bits[at[:, i]], following[at[:, i]]
            bits = following
            # words that end before ``i`` drop out at the end, by their size
            replaced = (replaced & here) | (same & ~here)
            # the extra letter of the index word sits at position i, or came before
            inserted = (inserted | same) & ahead
            same &= here
        inserted = inserted | same  # the extra letter is the last one
        ends = lambda s: self.of_size.get(s, none[0])
        hit = (replaced & ends(size)) | (inserted & ends(size + 1))
        return np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")[:, : len(self.size)].astype(bool)


def near_in_shard(words_: list, ask: list):
    """Near pairs ``(asked, index)`` (places in the lists) of one shard."""
    size = np.fromiter(map(len, words_), np.int64, len(words_))
    ask = np.array(ask, bool)
    index, asked = np.flatnonzero(~ask), np.flatnonzero(ask)
    index = index[np.argsort(size[index], kind="stable")]
    lo = 0
    while lo < len(index):
        # words of like size are indexed together: the longest one sets the depth of the table
        hi = min(lo + INDEX_BLOCK, int(np.searchsorted(size[index], 2 * size[index[lo]], side="right")))
        some = index[lo:hi]
        lo = hi
        table = PositionIndex([words_[i] for i in some])
        for s in range(int(table.size.min()) - 1, int(table.size.max()) + 1):
            mine = asked[size[asked] == s]
            for at in range(0, len(mine), ASK_BLOCK):
                block = mine[at: at + ASK_BLOCK]
                q, w = np.nonzero(table.near(_letters([words_[i] for i in block])[0], s))
                yield block[q], some[w]


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word, near, near_n``: all pairs of near words of ``vocabulary(word, n)``, both ways round."""
    def run(batches):
        key, held = None, []

        def close():
            table = pa.Table.from_batches(held)
            # a word may come by both its keys
            names, n, ask = zip(*dict.fromkeys(zip(*(table.column(c).to_pylist() for c in (1, 2, 3)))))
            for q, w in near_in_shard(names, ask):
                a, b = np.concatenate([q, w]).tolist(), np.concatenate([w, q]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()),
                                                  pa.array([n[i] for i in b], pa.int64())], names=["word", "near", "near_n"])

        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if lo == hi:
                    continue
                if shard[lo] != key:
                    if held:
                        yield from close()
                    key, held = shard[lo], []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from close()

    rows = _shards(vocabulary)
    dealt = rows.repartition("shard").sortWithinPartitions("shard")
    pairs = dealt.mapInArrow(run, "word string, near string, near_n long")
    # dealt by word: the distinct pairs and the groups by word need no further exchange
    return pairs.repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word of ``forms(word, form)``: the last word that forms lead to."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = write_shared(now, "spelling-roots")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = write_shared(step, "spelling-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def group(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``."""
    vocabulary = write_shared(words(docs, text), "spelling-words")
    pairs = near_pairs(vocabulary)
    # the least word among the largest counts: a struct of the negative count and the word has it as its minimum
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    out = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                       F.when(-F.col("b.less") >= FORM_RATIO * F.col("n"), F.col("b")).alias("b"))
    out = write_shared(out.select("word", "n", "n_near", F.col("b.near").alias("form"), (-F.col("b.less")).alias("form_n")), "spelling-forms")
    end = roots(out.where("form is not null").select("word", "form"))
    return out.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
