"""Byte-level BPE: batched numpy merge rounds.

Texts are split into words by the vocabulary's pattern, evaluated on arrays of
character classes; equal words of a batch are encoded once.  New words of up to
32 bytes stand in columns, one row per place; a round merges every word's
leftmost pair of lowest rank and looks up the two pairs beside it in a hash
table of pair keys.  The symbols of longer words lie in one flat array; a round
finds each word's lowest rank and merges that pair everywhere in the word.
Rounds end when no word has a known pair.

Words are keyed by a 64-bit hash; a worker keeps at most ``CACHE_WORDS`` encoded
words, one per slot of a table by the hash's low bits.  The vocabulary file's path is a parameter; the driver reads it once and
broadcasts its arrays (bounded by the vocabulary).

Defined results: null counts as empty (no ids, empty decoded text); texts of any
length are encoded whole; the vocabulary's special tokens in a text become their
ids, as the tokenizers library does by default; ids that are no UTF-8 decode
with replacement characters; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, span_hashes, string_chunks, worker_cache

ship(__name__)

CACHE_WORDS = 500_000
SLOTS = 1 << 19
#: Words of up to so many bytes are merged together in columns.
COLUMNS = (8, 16, 32)
_NONE = np.int32(1 << 25)  # rank of no pair; ranks times 32 fit 32 bits
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
# The code points with the White_Space property.
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE file: pair keys (sorted) with rank, merged id by rank, bytes of every id, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    a, b = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
    key = a * size + b
    order = np.argsort(key, kind="stable")
    of_char = {c: i for i, c in enumerate(byte_symbols())}
    pieces = [b""] * size
    for token, i in vocab.items():
        pieces[i] = bytes(of_char[c] for c in token)
    for token, i in special.items():
        pieces[i] = token.encode()
    length = np.fromiter(map(len, pieces), np.int64, size)
    return {"size": size, "key": key[order], "rank": order.astype(np.int64), "product": np.array([vocab[x + y] for x, y in merges], np.int32),
            "byte": np.array([vocab[c] for c in byte_symbols()], np.int64), "special": special,
            "bytes": np.frombuffer(b"".join(pieces), np.uint8), "start": np.cumsum(length) - length, "length": length}


def _home(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def pair_table(key: np.ndarray, rank: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Hash table of pair keys (sorted): bits of a home slot, key per slot (-1: none), rank per slot.

    A pair lies in the first free slot from its home on; the table goes on past the last home, so no walk wraps."""
    bits = max(4, (8 * len(key)).bit_length())
    home = _home(key, bits)
    order = np.argsort(home, kind="stable")
    # in the order of homes, each takes its home or the slot after the one before
    place = np.arange(len(key))
    slot = np.maximum.accumulate(home[order] - place) + place
    of_slot = np.full((1 << bits) + len(key) + 1, -1, np.int64)
    at = np.full(len(of_slot), _NONE)
    of_slot[slot], at[slot] = key[order], rank[order]
    return bits, of_slot, at


def find_pairs(table: tuple[int, np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    """Rank of every pair key."""
    bits, of_slot, at = table
    slot = _home(key, bits)
    there = of_slot[slot]
    found = np.where(there == key, at[slot], _NONE)
    walk = np.flatnonzero((there != key) & (there >= 0))
    while len(walk):
        slot[walk] += 1
        there = of_slot[slot[walk]]
        hit = there == key[walk]
        found[walk[hit]] = at[slot[walk[hit]]]
        walk = walk[~hit & (there >= 0)]
    return found


def _known(v: dict, what: str) -> tuple:
    """Name of what a worker keeps for a vocabulary."""
    return what, v["size"], int(v["key"][:64].sum())


def pair_ranks(v: dict) -> tuple[tuple[int, np.ndarray, np.ndarray], np.ndarray]:
    """The vocabulary's table of pairs and the ranks of all pairs of bytes, built once per worker."""
    def build():
        pairs = pair_table(v["key"], v["rank"])
        return pairs, find_pairs(pairs, (v["byte"][:, None] * v["size"] + v["byte"]).ravel()).reshape(256, 256)
    return worker_cache(_known(v, "bpe_pairs"), build)


def _classes() -> np.ndarray:
    def build():
        major = {"L": _LETTER, "N": _NUMBER}
        t = np.fromiter((major.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        t[list(_WHITE)] = _SPACE
        return t
    return worker_cache("char_classes", build)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte position of each."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.flatnonzero((data & 0xC0) != 0x80)


def word_starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin, by the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    ``ends``: index after the last code point of each text (ascending, texts non-empty)."""
    n = len(cp)
    kind = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    head = first[:n].copy()
    head[1:] |= kind[1:] != kind[:-1]  # begins a run of one class
    space = kind == _SPACE
    tail = np.empty(n, bool)  # ends a run
    tail[:-1] = head[1:]
    tail[-1] = True
    start = head.copy()
    # the last white space of a run before other text stands apart; a blank joins the word after it
    start |= space & tail & ~first[1:]
    joined = np.zeros(n, bool)
    joined[1:] = head[1:] & ~space[1:] & (cp[:-1] == 32) & ~first[1:n]
    start &= ~joined
    mark = np.flatnonzero((cp == 39) & head & tail & ~joined & ~first[1:])
    if len(mark):
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a, b = padded[mark + 1], padded[mark + 2]
        two_inside = ~first[np.minimum(mark + 2, n)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = two_inside & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((mark[one], 1), (mark[two], 2)):
            start[hit + 1] = False
            after = hit + 1 + size
            after = after[after < n]
            start[after] = True
    return np.flatnonzero(start)


def _merge_columns(v: dict, data: np.ndarray, starts: np.ndarray, size: np.ndarray, height: int):
    """Ids of words of 1 to ``height`` (at most 32) bytes, a column per word: yields ``(words, symbols, ids per word)``."""
    pairs, byte_pairs = pair_ranks(v)
    word, size = np.arange(len(starts)), size.copy()
    k = np.arange(height + 1)[:, None]
    byte = data[np.minimum(starts + k, len(data) - 1)]
    sym = np.where(k < size, v["byte"][byte], -1).astype(np.int32)
    # rank of the pair that begins at a place, times 32, plus the place: the least is the leftmost of lowest rank
    first = np.where(k[1:] < size, byte_pairs[byte[:-1], byte[1:]], _NONE)
    none = _NONE << 5
    best = (first << 5) + k[:-1].astype(np.int32)
    while len(word):
        top = int(size.max())
        low = best[:max(top - 1, 1)].min(axis=0)
        done = low >= none
        if done.any():
            yield word[done], sym[:top, done], size[done]
            live = np.flatnonzero(~done)
            if not len(live):
                return
            word, size, low = word[live], size[live], low[live]
            top = int(size.max())
            sym, best = sym[:top + 1].take(live, axis=1), best[:top].take(live, axis=1)
        at, col = (low & 31).astype(np.intp), np.arange(len(word))
        mid = v["product"][low >> 5]
        behind = at < k[1:top]
        sym[1:top] = np.where(behind, sym[2:top + 1], sym[1:top])
        best[1:top - 1] = np.where(behind[:-1], best[2:top] - 1, best[1:top - 1])
        best[top - 1] = none + 31
        sym[at, col] = mid
        size -= 1
        mid = mid.astype(np.int64)
        right = sym[at + 1, col]
        has = right >= 0
        pair = np.full(len(word), none)
        pair[has] = find_pairs(pairs, mid[has] * v["size"] + right[has]) << 5
        best[at, col] = pair + at
        has = np.flatnonzero(at)
        before = at[has] - 1
        best[before, has] = (find_pairs(pairs, sym[before, has] * np.int64(v["size"]) + mid[has]) << 5) + before


def _merge_flat(v: dict, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of any length: flat ids and ids per word."""
    n = len(starts)
    word = np.repeat(np.arange(n, dtype=np.int32), size)
    sym = v["byte"][data[np.arange(len(word)) + np.repeat(starts - (np.cumsum(size) - size), size)]]
    rank = np.full(len(sym), _NONE)
    pairs, _ = pair_ranks(v)

    def look(at):
        """Rank of the pairs that begin at the given symbols."""
        at = at[at < len(sym) - 1]
        at = at[word[at] == word[at + 1]]
        rank[at] = find_pairs(pairs, sym[at] * v["size"] + sym[at + 1])

    look(np.arange(len(sym)))
    done_sym, done_word = [], []
    while len(sym):
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        low = np.minimum.reduceat(rank, heads)
        size = np.diff(np.append(heads, len(word)))
        live = low < _NONE
        if not live.all():
            stay = np.repeat(live, size)
            done_sym.append(sym[~stay])
            done_word.append(word[~stay])
            sym, word, rank = sym[stay], word[stay], rank[stay]
            low, size = low[live], size[live]
            if not len(sym):
                break
        # in a chain of overlapping pairs (one symbol repeated) take every other pair from the left
        pos = np.flatnonzero(rank == np.repeat(low, size))
        chain = np.flatnonzero(np.diff(pos, prepend=-2) != 1)
        if len(chain) < len(pos):
            nth = np.arange(len(pos)) - np.repeat(chain, np.diff(np.append(chain, len(pos))))
            pos = pos[nth % 2 == 0]
        sym[pos] = v["product"][rank[pos]]
        fresh = np.zeros(len(sym), bool)
        fresh[pos] = True
        fresh[pos[pos > 0] - 1] = True
        stay = np.ones(len(sym), bool)
        stay[pos + 1] = False
        rank[pos] = _NONE
        sym, word, rank = sym[stay], word[stay], rank[stay]
        look(np.flatnonzero(fresh[stay]))
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n)


def merge_words(v: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words (non-empty byte spans): flat ids and ids per word."""
    size = ends - starts
    count, found = np.zeros(len(starts), np.int64), []
    group = np.searchsorted(COLUMNS, size)
    for g, height in enumerate(COLUMNS):
        own = np.flatnonzero(group == g)
        for word, sym, n in _merge_columns(v, data, starts[own], size[own], height):
            count[own[word]] = n
            found.append((own[word], sym, n))
    own = np.flatnonzero(group == len(COLUMNS))
    flat, n = _merge_flat(v, data, starts[own], size[own])
    count[own] = n
    ids = np.zeros(count.sum(), np.int64)
    start = np.cumsum(count) - count
    ids[np.arange(len(flat)) + np.repeat(start[own] - (np.cumsum(n) - n), n)] = flat
    for word, sym, n in found:
        place = np.arange(len(sym))[:, None]
        inside = place < n
        ids[(start[word] + place)[inside]] = sym[inside]
    return ids, count


class WordCache:
    """Encoded words of one worker: one per slot, the slot by the low bits of the word's hash."""

    def __init__(self):
        self.key = np.zeros(SLOTS, np.uint64)
        self.start = np.zeros(SLOTS, np.int64)
        self.size = np.zeros(SLOTS, np.int32)  # 0: empty, words have ids
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = self.words = 0

    def lookup(self, v: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size in ``ids`` of the given spans, by their hashes ``key``."""
        if self.words > CACHE_WORDS:
            self.__init__()
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        start, size = self.start[slot], self.size[slot]
        fresh = np.flatnonzero((self.key[slot] != key) | (size == 0))
        if len(fresh):
            new, one, back = np.unique(key[fresh], return_index=True, return_inverse=True)
            ids, count = merge_words(v, data, starts[fresh[one]], ends[fresh[one]])
            at = self.used + np.cumsum(count) - count
            self.used += len(ids)
            self.words += len(new)
            if self.used > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(2 * self.used - len(self.ids), np.uint32)])
            self.ids[self.used - len(ids):self.used] = ids
            start[fresh], size[fresh] = at[back], count[back]
            # of new words with the same slot one stays
            put, last = np.unique(slot[fresh[one]], return_index=True)
            self.key[put], self.start[put], self.size[put] = new[last], at[last], count[last]
        return start, size.astype(np.int64)


def _encode_plain(v: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
    cp, at = code_points(data)
    ends = np.searchsorted(at, offsets[1:][np.diff(offsets) > 0])
    first = at[word_starts(cp, ends)]
    last = np.append(first[1:], len(data))
    cache = worker_cache(_known(v, "bpe_words"), WordCache)
    start, size = cache.lookup(v, data, first, last, span_hashes(data, first, last))
    total = np.cumsum(size)
    ids = cache.ids[np.arange(total[-1]) + np.repeat(start - (total - size), size)]
    row = np.searchsorted(offsets, first, side="right") - 1
    return ids, np.bincount(row, size, rows).astype(np.int64)


def encode_buffer(v: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of several texts in one UTF-8 buffer: flat ids and ids per text."""
    raw = data.tobytes()
    marks = []
    for token, i in v["special"].items():
        t, p = token.encode(), -1
        while (p := raw.find(t, p + 1)) >= 0:
            row = int(np.searchsorted(offsets, p, side="right")) - 1
            if p + len(t) <= offsets[row + 1]:
                marks.append((p, p + len(t), i))
    if not marks:
        return _encode_plain(v, data, offsets)
    marks.sort()
    kept = [m for k, m in enumerate(marks) if not k or m[0] >= marks[k - 1][1]]
    cuts = np.unique(np.concatenate([offsets, [m[0] for m in kept], [m[1] for m in kept]]))
    ids, size = _encode_plain(v, data, cuts)
    for lo, _, i in kept:
        k = int(np.searchsorted(cuts, lo))
        at = int(size[:k].sum())
        ids = np.concatenate([ids[:at], np.array([i], np.uint32), ids[at + size[k]:]])
        size[k] = 1
    row = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    return ids, np.bincount(row, size, len(offsets) - 1).astype(np.int64)


def decode(v: dict, ids: np.ndarray) -> str:
    """Text of ids (special tokens included)."""
    size = v["length"][ids]
    total = int(size.sum())
    at = np.arange(total) + np.repeat(v["start"][ids] - (np.cumsum(size) - size), size)
    return v["bytes"][at].tobytes().decode("utf-8", "replace")


def encode_rows(docs: DataFrame, keep: list, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``keep`` columns of every row plus ``ids`` (little-endian unsigned 32-bit) and ``n_tokens``."""
    v = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").schema.add("ids", "binary").add("n_tokens", "long")

    def run(batches):
        for b in batches:
            out, count = [], []
            for _, _, data, offs in string_chunks(b.column(b.num_columns - 1)):
                ids, size = encode_buffer(v.value, data, offs)
                at = np.concatenate([[0], np.cumsum(size)])
                raw = ids.astype("<u4").tobytes()
                out += [raw[4 * x: 4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                count += size.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary()), pa.array(count, pa.int64())],
                                             names=[*b.schema.names[:-1], "ids", "n_tokens"])

    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, keep: list, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Encode and decode every text: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    v = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        for b in batches:
            count, one, two = [], [], []
            for _, _, data, offs in string_chunks(b.column(b.num_columns - 1)):
                ids, size = encode_buffer(v.value, data, offs)
                at = np.concatenate([[0], np.cumsum(size)]).tolist()
                count += size.tolist()
                for x, y in zip(at[:-1], at[1:]):
                    part = ids[x:y]
                    one.append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
                    two.append(hashlib.sha256(decode(v.value, part).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(count, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                                             names=[*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, schema)
