"""N-gram Jaccard join by set-relation skipping (exact, threshold 0.75).

A document's set holds its distinct word shingles as 64-bit hashes; a set is
identified by a 128-bit fingerprint, so exact copies are one set.  The join
finds the connected components of "Jaccard >= THRESHOLD" (Wang, Qin, Lin,
Zhang, Chang, "Leveraging set relations in exact set similarity join", 2017):

1. ``sets``: one pass over the texts writes size, fingerprint, a sketch (the least
   shingle hash in each of ``SKETCH`` ranges) and, once per set and batch, the text.
   It also reports shingles that several sets of the batch hold.
2. Highly similar sets share sketch values; each meets only the hub of that value,
   the set whose values are the most widespread (the text that others were
   edited from), so a group of m copies makes O(m) pairs.  Verified pairs label
   every set with a hub.
3. Prefix index: two linked sets share ``l`` shingles among the first
   ``n - ceil(0.75 n) + l`` of each (``l`` is that of the smaller set, about a
   fortieth of its size), in one global order: hash order, with
   shingles marked in a bitmap last.  The bitmap (``MARK_BITS`` bits whatever the
   corpus) holds the reported shingles, so prefixes consist of shingles that few
   sets have; which shingles are marked only changes the speed.
   Prefixes are dealt by shingle to buckets as packed arrays.  A shingle's list
   keeps, per hub and set size, the first position; it is ordered by size and
   position, and blocks whose size or position cannot reach the overlap are
   skipped whole.  What remains are pairs of hubs, counted over all shingles, and
   those with the ``l`` shared shingles may have linked members.
4. Verification: blocks hold members of one hub, and the sets of its partner hubs
   stream past.  A set's overlap with the hub is computed once; all members
   derive theirs from it by the few shingles in which they differ from the hub.
   Once two hubs are linked, their other members are skipped.

A link between different sets joins two sets with one label (already connected by
verified links) or two hubs that step 3 pairs, so components are exact; no list,
bucket or partner is capped, and the pairs of a group are never written out.

Defined results: a set with no words (null or empty text) has size 0, links
with nothing and is its own component; fewer words than ``SHINGLE`` make one
shingle of all words; repeated rows are exact copies; a null id joins its
component but never names it; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lower_ascii, ship, span_hashes, splitmix, string_chunks, tidy, word_spans, worker_cache, write_shared

ship(__name__)

SHINGLE = 5
#: Jaccard threshold as a fraction: 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
SKETCH = 16
_SKETCH_BITS = 4
#: Sketch values that a set shares with the hub whose family it joins.
RELATED = 6
#: The bitmap of shingles put last has ``2 ** MARK_BITS`` bits (broadcast: 8 MB), bitmaps of set ids
#: ``2 ** ID_BITS`` (2 MB).
MARK_BITS = 26
ID_BITS = 24
_BLOCK_BITS = 15  # bits of one row of Spark's bitmap aggregate
#: Prefix shingles per bucket aimed at.
BUCKET_TOKENS = 1 << 20
#: Lists up to this length are paired together in arrays, longer ones block by block.
SHORT_LIST = 32
LIST_ROWS = 1 << 15
#: Members of a hub, and partner hubs, per verification block aimed at.
BLOCK_MEMBERS, BLOCK_PARTNERS = 512, 256


def _multipliers() -> np.ndarray:
    return worker_cache("shingle_factors", lambda: splitmix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text in the buffer."""
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, offsets)
    n = len(offsets) - 1
    out = [np.zeros(0, np.uint64)] * n
    if not len(starts):
        return out
    w, f = span_hashes(data, starts, ends), _multipliers()
    size = np.bincount(rows, minlength=n)
    first = np.cumsum(size) - size
    if len(w) >= SHINGLE:
        m = len(w) - SHINGLE + 1
        h = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            h += w[k: k + m] * f[k]
        h = splitmix(h)
    for i in np.flatnonzero(size).tolist():
        lo, k = first[i], size[i]
        if k >= SHINGLE:
            one = np.sort(h[lo: lo + k - SHINGLE + 1])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out[i] = one[keep]
        else:
            out[i] = splitmix((w[lo: lo + k] * f[:k]).sum(keepdims=True) + np.uint64(k))
    return out


def shared_shingles(n):
    """Shingles that a set of this size must share, within the prefixes, with any linked set not smaller."""
    return 1 + n // 40


def prefix_length(n):
    return min(n, n - -(-NUM * n // DEN) + shared_shingles(n))


def needed_overlap(a, b):
    """Least intersection with DEN * i >= NUM * (a + b - i)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _fingerprint(tokens: np.ndarray) -> bytes:
    one = splitmix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = splitmix(tokens + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return one.tobytes() + two.tobytes()


def _sets(docs: DataFrame, text: str) -> DataFrame:
    edges = np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - _SKETCH_BITS)

    def run(batches):
        for b in batches:
            seen: set[bytes] = set()
            held: list[np.ndarray] = []
            for lo, hi, data, offs in string_chunks(b.column(1)):
                sets = shingle_sets(data, offs)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                mins, empty = np.zeros((len(sets), SKETCH), np.uint64), np.ones((len(sets), SKETCH), bool)
                for i in np.flatnonzero(size).tolist():
                    at = np.searchsorted(sets[i], edges)
                    inside = at < size[i]
                    mins[i, inside] = sets[i][at[inside]]
                    empty[i] = ~inside | (mins[i] >> np.uint64(64 - _SKETCH_BITS) != np.arange(SKETCH, dtype=np.uint64))
                ids, first = [], np.zeros(len(sets), bool)
                for i, s in enumerate(sets):
                    if not len(s):
                        ids.append(None)
                        continue
                    sid = _fingerprint(s)
                    ids.append(sid)
                    if sid not in seen:
                        seen.add(sid)
                        first[i] = True
                        held.append(s)
                column = b.column(1).take(pa.array(np.arange(lo, hi), mask=~first))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCH * len(sets) + 1, SKETCH, dtype=np.int32)),
                                                  pa.array(mins.ravel().view(np.int64), mask=empty.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(ids, pa.binary()), sketch,
                     column,
                     pa.nulls(len(sets), pa.int64())],
                    names=["doc_id", "n", "sid", "sketch", "text", "token"])
            if held:
                token = np.sort(np.concatenate(held))
                again = token[1:] == token[:-1]
                token = np.unique(token[1:][again] & np.uint64((1 << MARK_BITS) - 1)).view(np.int64)
                k = len(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())),
                     pa.nulls(k, b.schema.field(1).type), pa.array(token)],
                    names=["doc_id", "n", "sid", "sketch", "text", "token"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ddl = "doc_id long, n long, sid binary, sketch array<long>, text string, token long"
    return write_shared(src.mapInArrow(tidy(run), ddl), "jaccard-sets")


def _hub_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``(a = hub, b)`` of sets that share two or more sketch values with the hub of those values."""
    one = sets.where("text is not null").groupBy("sid").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    keys = one.select("sid", "n", F.explode("sketch").alias("value")).where("value is not null")
    shared = keys.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    keys = write_shared(keys.join(shared, "value"), "jaccard-keys")
    spread = keys.groupBy("sid").agg(F.sum("m").alias("spread"))
    keys = keys.join(spread, "sid")
    hubs = keys.groupBy("value").agg(F.max(F.struct("spread", "sid", "n")).alias("hub"))
    return (keys.join(hubs, "value").where((F.col("sid") != F.col("hub.sid"))
                                           & (DEN * F.least("n", "hub.n") >= NUM * F.greatest("n", "hub.n")))
            .groupBy(F.col("hub.sid").alias("hub"), F.col("sid").alias("other")).agg(F.count(F.lit(1)).alias("shared"))
            .where("shared > 1"))


def _families(pairs: DataFrame) -> DataFrame:
    """``sid, fam``: the hub that a set resembles most (at least ``RELATED`` sketch values), linked or not."""
    near = pairs.where(F.col("shared") >= RELATED).groupBy(F.col("other").alias("sid")).agg(F.max_by("hub", F.struct("shared", "hub")).alias("fam"))
    up = near.select(F.col("sid").alias("fam"), F.col("fam").alias("top"))
    return near.join(up, "fam", "left").select("sid", F.coalesce("top", "fam").alias("fam"))


class Family:
    """A hub's set and, for some of its members, what they lack and add."""

    def __init__(self, hub: np.ndarray, members: list[np.ndarray]):
        self.hub = hub
        self.size = np.fromiter(map(len, members), np.int64, len(members))
        lack, add = [], []
        for y in members:
            at = np.searchsorted(hub, y)
            at[at == len(hub)] = 0
            same = hub[at] == y if len(hub) else np.zeros(len(y), bool)
            gone = np.ones(len(hub), bool)
            gone[at[same]] = False
            lack.append(np.flatnonzero(gone))
            add.append(y[~same])
        row = np.arange(len(members))
        self.lack, self.lack_row = np.concatenate([np.zeros(0, np.int64), *lack]), np.repeat(row, [len(x) for x in lack])
        self.add, self.add_row = np.concatenate([np.zeros(0, np.uint64), *add]), np.repeat(row, [len(x) for x in add])

    def overlaps(self, z: np.ndarray) -> np.ndarray:
        """Intersection size of ``z`` with every member, derived from its intersection with the hub."""
        in_z = _contains(z, self.hub)
        n = len(self.size)
        return (in_z.sum() - np.bincount(self.lack_row[in_z[self.lack]], minlength=n)
                + np.bincount(self.add_row[_contains(z, self.add)], minlength=n))


class Labels:
    """Labels joined so far within a block."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def verify(pairs: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between members of paired hubs, at least one for each ``pairs(hub, other)``
    that has a link; ``members(sid, hub)`` names every set's hub."""
    # the larger family holds still in its blocks, the members of the smaller one stream past it
    count = members.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    pairs = (pairs.join(count, "hub").join(count.select(F.col("hub").alias("other"), F.col("m").alias("om")), "other")
             .select(F.when(F.col("m") >= F.col("om"), F.col("hub")).otherwise(F.col("other")).alias("hub"),
                     F.when(F.col("m") >= F.col("om"), F.col("other")).otherwise(F.col("hub")).alias("other")))
    return _past_blocks(write_shared(pairs, "jaccard-pairs"), members.select("sid", "hub", F.col("hub").alias("label")), members, texts)


def verify_families(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the hubs' groups of one family, of ``members(sid, hub, fam)``: the sets
    that are not linked to the family's hub stream past all of its members."""
    pairs = members.where("hub <> fam").select(F.col("fam").alias("hub"), F.col("hub").alias("other")).distinct()
    return _past_blocks(write_shared(pairs, "jaccard-relatives"), members.select("sid", F.col("fam").alias("hub"), F.col("hub").alias("label")),
                        members.select("sid", "hub"), texts)


def _past_blocks(pairs: DataFrame, held: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(u, v)`` of ``pairs(hub, other)``: blocks of ``held(sid, hub, label)``, past which the
    ``members(sid, hub)`` of the partners stream.  Per block, a link is given only where it joins two labels."""
    count = held.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    sizes = (pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("q"))
             .join(count, "hub")
             .select("hub", F.ceil(F.col("q") / BLOCK_PARTNERS).alias("zs"), F.ceil(F.col("m") / BLOCK_MEMBERS).alias("ms")))
    sizes = write_shared(sizes, "jaccard-blocks")  # three parts of the rows need it
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    none = F.lit(None).cast("binary").alias("other")
    own = (held.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("sid"), "ms").alias("mc"), "zs", "sid", "label")
           .select("hub", "mc", upto("zs").alias("zc"), "sid", none, "label"))
    centre = sizes.select("hub", upto("ms").alias("mc"), "zs").select("hub", "mc", upto("zs").alias("zc"), F.col("hub").alias("sid"), none,
                                                                     F.lit(None).cast("binary").alias("label"))
    partner = (pairs.join(sizes, "hub").select("hub", "other", F.pmod(F.xxhash64("other"), "zs").alias("zc"), "ms")
               .join(members.select("sid", F.col("hub").alias("other")), "other")
               .select("hub", upto("ms").alias("mc"), "zc", "sid", "other", F.col("other").alias("label")))
    rows = own.unionByName(centre).unionByName(partner).join(texts.select("sid", "text"), "sid")
    rows = (rows.select("hub", "mc", "zc", "sid", "other", "label", "text").repartition("hub", "mc", "zc")
            .sortWithinPartitions("hub", "mc", "zc", F.col("other").isNotNull(), "other", "sid"))

    def run(batches):
        key, held, family = None, {}, None
        for b in batches:
            u, v = [], []
            tokens = []
            for _, _, data, offs in string_chunks(b.column(6)):
                tokens += shingle_sets(data, offs)
            hub, mc, zc, sid, other, label = (b.column(c).to_pylist() for c in range(6))
            for i, z in enumerate(tokens):
                if (hub[i], mc[i], zc[i]) != key:
                    key, held, family = (hub[i], mc[i], zc[i]), {}, None
                if other[i] is None:
                    if sid[i] == key[0] and not held.get(None):
                        held[None] = (z, None)
                    if label[i] is not None:
                        held[sid[i]] = (z, label[i])
                    continue
                if family is None:
                    hub_set = held.pop(None)[0]
                    names, of = list(held), [x for _, x in held.values()]
                    kinds = {x: k for k, x in enumerate(dict.fromkeys(of))}
                    kind = np.array([kinds[x] for x in of], np.int64)
                    family, joined = Family(hub_set, [x for x, _ in held.values()]), Labels()
                # one label in the block, and joined with this one already
                if len(kinds) == 1 and joined.root(of[0]) == joined.root(label[i]):
                    continue
                hit = np.flatnonzero(family.overlaps(z) >= needed_overlap(family.size, len(z)))
                for at in hit[np.unique(kind[hit], return_index=True)[1]].tolist():
                    if joined.join(of[at], label[i]):
                        u.append(names[at])
                        v.append(sid[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return rows.mapInArrow(tidy(run), "u binary, v binary")


def _contains(a: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which ``values`` the sorted distinct array ``a`` holds."""
    if not len(a) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(a, values)
    at[at == len(a)] = 0
    return a[at] == values


def list_pairs(size: np.ndarray, pos: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in the list) of one shingle's list that pass the size and
    position bounds and belong to different families (``hub``).  Skips blocks of equal size by their bounds."""
    order = np.lexsort((pos, size))
    size, pos, hub = size[order], pos[order], hub[order]
    heads = np.flatnonzero(np.diff(size, prepend=-1))
    tails = np.append(heads[1:], len(size))
    left, right = [], []
    for i in range(len(size)):
        n, p = size[i], pos[i]
        # blocks of sets at most as large as this one (each pair is met from its larger side)
        lo = np.searchsorted(size[heads], -(-NUM * n // DEN))
        hi = np.searchsorted(size[heads], n, side="right")
        for j in range(lo, hi):
            m = size[heads[j]]
            # the first l shared shingles have at most l - 1 shared ones before them
            need = needed_overlap(int(n), int(m)) - (shared_shingles(int(m)) - 1)
            if n - p < need:
                continue
            last = min(tails[j], i) if m == n else tails[j]
            # positions ascend within a block: only a prefix of it can reach the overlap
            stop = heads[j] + np.searchsorted(pos[heads[j]:last], m - need, side="right")
            if stop > heads[j]:
                at = np.arange(heads[j], stop)
                at = at[hub[at] != hub[i]]
                left.append(np.full(len(at), i))
                right.append(at)
    if not left:
        z = np.zeros(0, np.int64)
        return z, z
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _marks(sets: DataFrame) -> np.ndarray:
    """Bitmap of the reported shingles."""
    return _bitmap(sets.where("token is not null"), MARK_BITS)


def _bitmap(tokens: DataFrame, width: int) -> np.ndarray:
    """Bitmap of a ``token`` column below ``2 ** width``: one row of 4 KB per block, merged by Spark."""
    block = F.shiftright("token", _BLOCK_BITS)
    bit = F.col("token").bitwiseAND((1 << _BLOCK_BITS) - 1)
    rows = tokens.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()
    out = np.zeros(1 << (width - 3), np.uint8)
    size = 1 << (_BLOCK_BITS - 3)
    for r in rows:  # at most 2 ** (width - _BLOCK_BITS) of them
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[:size]
        out[r["block"] * size: r["block"] * size + len(part)] = part
    return out


def marked(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


class PairCounts:
    """Per pair: in how many lists it occurred, and the least number of shingles its sets must share."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, token: np.ndarray, pair: np.ndarray, least: np.ndarray) -> None:
        """Occurrences of pairs in lists; several of one pair in one list (several sizes) count once."""
        if not len(pair):
            return
        order = np.lexsort((least, pair, token))
        token, pair, least = token[order], pair[order], least[order]
        first = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (pair[1:] != pair[:-1])))
        self.parts.append((pair[first], np.ones(len(first), np.int64), least[first]))
        self.size += len(first)
        if self.size > 1 << 18:
            self.parts = [self.result()]
            self.size = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        pair, shared, least = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(pair, kind="stable")
        head = np.flatnonzero(np.diff(pair[order], prepend=-1))
        return pair[order][head], np.add.reduceat(shared[order], head), np.minimum.reduceat(least[order], head)


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """Bitmap (``2 ** ID_BITS`` bits, bounded) of the ``sid`` values of a table, by their first bytes."""
    bits = F.conv(F.hex(F.substring("sid", 1, 4)), 16, 10).cast("long").bitwiseAND((1 << ID_BITS) - 1)
    return _bitmap(ids.select(bits.alias("token")), ID_BITS)


def _first_bytes(ids: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(s[:4] for s in ids.to_pylist()), ">u4").astype(np.uint64)


def only(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows of ``texts(sid, text)`` whose id the bitmap holds.  It may hold a few more ids than were put in; it keeps whole texts out of the joins that do not need them."""
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(marked(held.value, _first_bytes(b.column(0)))))

    return texts.select("sid", "text").mapInArrow(tidy(run), "sid binary, text string")


def _candidates(labelled: DataFrame, buckets: int, bitmap: np.ndarray, families: np.ndarray) -> DataFrame:
    """Pairs ``(hub, other)`` of hubs of different families that may have linked members, from the prefix index over ``labelled(sid, hub, fam, text)``;
    a row without a hub is its own, unless the ``families`` bitmap holds its id (it then comes with its hub)."""
    spark = labelled.sparkSession
    late, known = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(families)

    def index(batches):
        bits = late.value
        for b in batches:
            token, owner, pos, hubs, sizes = [], [], [], [], []
            alone = np.array([h is None for h in b.column(1).to_pylist()])
            b = b.filter(pa.array(~(alone & marked(known.value, _first_bytes(b.column(0))))))
            # 32 bytes: the family, then the hub
            hub = [(f or s) + (h or s) for s, h, f in zip(*(b.column(c).to_pylist() for c in range(3)))]
            for lo, _, data, offs in string_chunks(b.column(3)):
                for i, s in enumerate(shingle_sets(data, offs), lo):
                    if not len(s):
                        continue
                    last = marked(bits, s)
                    s = np.concatenate([s[~last], s[last]])
                    k = prefix_length(len(s))
                    token.append(s[:k])
                    owner.append(np.full(k, len(hubs)))
                    pos.append(np.arange(k))
                    hubs.append(hub[i])
                    sizes.append(len(s))
            if not hubs:
                continue
            token, owner, pos = np.concatenate(token), np.concatenate(owner).astype(np.uint32), np.concatenate(pos).astype(np.uint32)
            hubs = np.array(hubs, "V32")
            sizes = np.array(sizes, np.uint32)
            bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[k]:cut[k + 1]]
                own, back = np.unique(owner[at], return_inverse=True)
                out.append((k, (token[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), back.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes(),
                            pos[at].tobytes(), hubs[own].tobytes(), sizes[own].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                             names=["bucket", "token", "owner", "pos", "hubs", "sizes"])

    def meet(batches):
        key, held = None, []

        def close():
            parts = list(zip(*held))
            token = np.concatenate([np.frombuffer(x, "<u4") for x in parts[0]])
            hubs = np.frombuffer(b"".join(parts[3]), "V32")
            sizes = np.frombuffer(b"".join(parts[4]), np.uint32).astype(np.int64)
            count = [len(x) // 32 for x in parts[3]]
            shift = np.cumsum(count) - count
            owner = np.concatenate([np.frombuffer(x, "<u2" if c <= 1 << 16 else "<u4").astype(np.int64) + s
                                    for x, c, s in zip(parts[1], count, shift)])
            pos = np.concatenate([np.frombuffer(x, np.uint32) for x in parts[2]]).astype(np.int64)
            label, hub_no = np.unique(hubs.view([(c, "<u8") for c in "abcd"]), return_inverse=True)
            # hubs are numbered by family: the family of each hub is that of the run it lies in
            fam_no = np.cumsum(np.append(True, label[["a", "b"]][1:] != label[["a", "b"]][:-1])[: len(label)])
            hub, size = hub_no[owner], sizes[owner]
            order = np.argsort(token, kind="stable")
            token, hub, size, pos = token[order], hub[order], size[order], pos[order]
            head = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
            mixed = np.maximum.reduceat(fam_no[hub], head) != np.minimum.reduceat(fam_no[hub], head)
            at = np.flatnonzero(np.repeat(mixed, np.diff(np.append(head, len(token)))))
            # the first position per shingle, hub and size decides
            at = at[np.lexsort((pos[at], size[at], hub[at], token[at]))]
            token, hub, size, pos = token[at], hub[at], size[at], pos[at]
            same = (token[1:] == token[:-1]) & (hub[1:] == hub[:-1]) & (size[1:] == size[:-1])
            at = np.flatnonzero(np.append(True, ~same)[: len(token)])
            token, hub, size, pos = token[at], hub[at], size[at], pos[at]
            head = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
            length = np.diff(np.append(head, len(token)))
            found, width = PairCounts(), len(label)
            brief = np.flatnonzero(length <= SHORT_LIST)
            cut = np.flatnonzero(np.diff(np.cumsum(length[brief]) // LIST_ROWS, prepend=-1))
            for first, last in zip(cut.tolist(), [*cut[1:].tolist(), len(brief)]):
                lists = brief[first:last]
                rows = np.arange(length[lists].sum()) + np.repeat(head[lists] - (np.cumsum(length[lists]) - length[lists]), length[lists])
                t, h, n, p = token[rows], hub[rows], size[rows], pos[rows]
                hits = []
                for step in range(1, int(length[lists].max())):
                    i = np.flatnonzero(t[:-step] == t[step:])
                    j = i + step
                    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                    reach = np.minimum(n[i] - p[i], n[j] - p[j])
                    ok = (fam_no[h[i]] != fam_no[h[j]]) & (DEN * low >= NUM * high) & (reach >= needed_overlap(low, high) - (shared_shingles(low) - 1))
                    i, j = i[ok], j[ok]
                    hits.append((t[i].astype(np.int64), np.minimum(h[i], h[j]) * width + np.maximum(h[i], h[j]), shared_shingles(low[ok])))
                if hits:
                    found.add(*(np.concatenate(c) for c in zip(*hits)))
            for k in np.flatnonzero(length > SHORT_LIST).tolist():
                part = slice(head[k], head[k] + length[k])
                h = hub[part]
                n = size[part]
                a, b = list_pairs(n, pos[part], fam_no[h])
                found.add(token[part][a].astype(np.int64), np.minimum(h[a], h[b]) * width + np.maximum(h[a], h[b]),
                          shared_shingles(np.minimum(n[a], n[b])))
            pair, shared, least = found.result()
            if not len(pair):
                return None
            label = label.view("V16").reshape(-1, 2)[:, 1]
            return pa.RecordBatch.from_arrays([*[pa.array([bytes(z) for z in label[k]], pa.binary()) for k in (pair // width, pair % width)],
                                               pa.array(shared), pa.array(least)], names=["hub", "other", "shared", "least"])

        for b in batches:
            bucket = b.column(0).to_pylist()
            cols = [b.column(c) for c in range(1, 6)]
            for i, k in enumerate(bucket):
                if k != key:
                    if held and (done := close()) is not None:
                        yield done
                    key, held = k, []
                held.append(tuple(c[i].as_py() for c in cols))
        if held and (done := close()) is not None:
            yield done

    ddl = "bucket long, token binary, owner binary, pos binary, hubs binary, sizes binary"
    lists = labelled.select("sid", "hub", "fam", "text").mapInArrow(tidy(index), ddl)
    dealt = lists.repartition("bucket").sortWithinPartitions("bucket")
    pairs = dealt.mapInArrow(tidy(meet), "hub binary, other binary, shared long, least long")
    return (pairs.groupBy("hub", "other").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
            .where("shared >= least").select("hub", "other"))


def least_ids(rows: DataFrame) -> DataFrame:
    """Every set with the least id of its documents."""
    return rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("low"))


def join(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id`` (least id reachable by links)."""
    sets = _sets(docs, text)
    rows = sets.where("token is null").select("doc_id", "n", "sid")
    texts = sets.where("text is not null and sid is not null").select("sid", "text")
    # texts of one set may come once per batch: any of them will do, the set is the same
    lows = write_shared(least_ids(rows), "jaccard-ids")
    alone = lows.select("sid", F.col("sid").alias("hub"))
    pairs = write_shared(_hub_pairs(sets), "jaccard-hubs")
    wanted = pairs.select(F.explode(F.array("hub", "other")).alias("sid"))
    near = write_shared(_families(pairs), "jaccard-families")
    stars = write_shared(verify(pairs.select("hub", "other"), alone, only(texts, id_bitmap(wanted))), "jaccard-stars")
    hubs = stars.groupBy(F.col("v").alias("sid")).agg(F.min("u").alias("hub"))
    up = hubs.select(F.col("sid").alias("hub"), F.col("hub").alias("top"))
    hubs = hubs.join(up, "hub", "left").select("sid", F.coalesce("top", "hub").alias("hub"))
    members = lows.join(hubs, "sid", "left").select("sid", F.coalesce("hub", "sid").alias("hub"), "low")
    # a family is a set of hubs: all members of a hub have the family of the hub
    members = (members.join(near.select(F.col("sid").alias("hub"), "fam"), "hub", "left").select("sid", "hub", F.coalesce("fam", "hub").alias("fam"), "low"))
    members = write_shared(members, "jaccard-members")
    labels = members.where("hub <> sid or fam <> hub")
    families = id_bitmap(labels.select(F.explode(F.array("sid", "hub", "fam")).alias("sid")))
    texts_of_families = only(texts, families)
    # a set outside all families is its own hub and needs no join
    labelled = (texts_of_families.join(members, "sid").select("sid", "hub", "fam", "text")
                .unionByName(texts.select("sid", F.lit(None).cast("binary").alias("hub"), F.lit(None).cast("binary").alias("fam"), "text")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // (BUCKET_TOKENS * DEN // (DEN - NUM))))
    pairs = write_shared(_candidates(labelled, buckets, _marks(sets), families), "jaccard-candidates")
    paired = members.join(pairs.select(F.explode(F.array("hub", "other")).alias("hub")).distinct(), "hub", "left_semi")
    # each in a job of its own: one plan of both holds too much in the driver
    links = write_shared(verify(pairs, members.select("sid", "hub"), only(texts, id_bitmap(paired))), "jaccard-links")
    related = members.join(members.where("hub <> fam").select("fam").distinct(), "fam", "left_semi")
    links = links.unionByName(write_shared(verify_families(related.select("sid", "hub", "fam"), texts_of_families), "jaccard-links"))
    roots = components(stars.unionByName(links))
    named = members.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "low", F.coalesce("root", "sid").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = write_shared(named.join(lowest, "root").select("sid", "component_id"), "jaccard-components")
    return (rows.where("sid is not null").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .unionByName(rows.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))
