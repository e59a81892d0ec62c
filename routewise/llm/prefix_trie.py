"""Conversation prefix trie by fixed-length block hashing.

A conversation is a sequence of turns; its prefixes of every length are the nodes of
a trie, shared by all conversations that start alike.  Texts are read once: a turn
becomes a digest of role and text and the text's byte length, and a prefix is named
by 128 bits, the exclusive or of a hash of (place, digest) over its turns, so the
name of a longer prefix follows from that of a shorter one.

1. Blocks first.  A conversation is cut into blocks of ``BLOCK`` turns; the name of
   the prefix up to a block is a running aggregate over its blocks.  Conversations are
   grouped by (prefix before the block, block digest): one row per distinct block
   with its number of conversations, their least id and its at most ``BLOCK`` turns.
2. Turns only where siblings diverge.  Under a prefix with a single next block, all
   conversations that go on share its turns: its nodes are written as they are.  Under
   a prefix with several, the turns of the distinct blocks (not of the conversations)
   are grouped by the name of each prefix inside the block.
3. Sums over subtrees (leaves, saved bytes) by pointer doubling: in round k every
   node hands its sum to the node ``2 ** k`` turns above it, so there are as many
   rounds as the longest conversation has binary digits, and no row per (node, ancestor).
4. The ids that end at a node are sorted within its partition and stream through one
   running digest: no list of them is held.

A conversation's turns are numbered by a window, so one very long conversation is one
sorted run of narrow rows (no texts) that spills to disk.

Defined results: null role and text are empty; turns are ordered by number (null first),
turns of equal number by role and digest of the text; repeated rows are repeated turns;
rows without a conversation id belong to no conversation; an empty table has no nodes;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, write_shared

ship(__name__)

BLOCK = 4
ROOT = (0, 0)
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), ``digest, bytes`` of every turn, from ``rows(conv_id, turn, role, text)``."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("md5"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "md5")
    return turns.select("conv_id", (F.row_number().over(order).cast("long") - 1).alias("pos"),
                        F.concat_ws("\n", "md5", "role").alias("digest"), "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """``(convs(conv_id), turns)``: every conversation ``c`` starts with the first ``crc32(c) % most``
    turns of conversation ``c - c % group`` and goes on with its own turns after as many."""
    head = F.crc32(F.col("conv_id").cast("string")) % most
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = own.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lead = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lead, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("led"))
    convs = write_shared(convs, "trie-conversations")
    rest = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("led")).alias("pos"), "digest", "bytes")
    first = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    first = first.join(convs, "base").where("pos < h").select("conv_id", "pos", "digest", "bytes")
    return convs.select("conv_id"), rest.unionByName(first)


def _named(turns: DataFrame) -> DataFrame:
    """Turns with the two halves ``x``, ``y`` of the hash of (place, digest)."""
    return turns.select("conv_id", "pos", "bytes", F.xxhash64("pos", "digest", F.lit("x")).alias("x"), F.xxhash64(F.lit("y"), "digest", "pos").alias("y"))


def _nodes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(depth, x, y, px, py, conv_id, n_convs, bytes)`` without the root, and ``ends(conv_id, x, y)``."""
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    cut = turns.groupBy("conv_id", block).agg(
        F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"),
        F.sort_array(F.collect_list(F.struct("pos", "x", "y", "bytes"))).alias("turns"))  # at most BLOCK turns
    sofar = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.select("conv_id", "block", "bx", "by", "turns", F.bit_xor("bx").over(sofar).alias("x"), F.bit_xor("by").over(sofar).alias("y"))
    cut = write_shared(cut, "trie-blocks")
    ends = (cut.groupBy("conv_id").agg(F.max_by(F.struct("x", "y"), "block").alias("e"))
            .join(convs, "conv_id", "right").select("conv_id", *[F.coalesce(f"e.{c}", F.lit(r)).alias(c) for c, r in zip("xy", ROOT)]))

    blocks = (cut.groupBy("block", F.col("x").bitwiseXOR(F.col("bx")).alias("px"), F.col("y").bitwiseXOR(F.col("by")).alias("py"), "bx", "by")
              .agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")))
    blocks = write_shared(blocks, "trie-distinct-blocks")
    single = (blocks.groupBy("block", "px", "py").agg(F.count(F.lit(1)).alias("siblings")).where("siblings = 1").select("block", "px", "py"))

    def inside(df):
        """One row per turn of each block: the names of its prefix and of the prefix before it."""
        steps = F.expr("""transform(turns, (t, i) -> struct(t.pos + 1 as depth, t.bytes as bytes, t.x as tx, t.y as ty,
            aggregate(slice(turns, 1, i), px, (a, u) -> a ^ u.x) as px, aggregate(slice(turns, 1, i), py, (a, u) -> a ^ u.y) as py))""")
        df = df.select("n_convs", "conv_id", F.explode(steps).alias("s")).select("n_convs", "conv_id", "s.*")
        return df.select("depth", F.col("px").bitwiseXOR(F.col("tx")).alias("x"), F.col("py").bitwiseXOR(F.col("ty")).alias("y"),
                         "px", "py", "conv_id", "n_convs", "bytes")

    alike = inside(blocks.join(single, ["block", "px", "py"], "left_semi"))
    apart = (inside(blocks.join(single, ["block", "px", "py"], "left_anti")).groupBy("depth", "x", "y", "px", "py", "bytes")
             .agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")))
    return alike.unionByName(apart.select(*alike.columns)), ends


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """``x, y, leaves, saved`` summed over every node's subtree; ``nodes(x, y, px, py, depth, leaf, own)``."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = nodes.select("x", "y", F.col("px").alias("ux"), F.col("py").alias("uy"), F.col("depth").alias("below"),
                        F.col("leaf").alias("leaves"), F.col("own").alias("saved"))
    step = 1
    while True:
        # ``u`` is the node ``step`` above; ``below`` the depth, so nodes shallower than ``step`` hand on nothing
        sums = write_shared(sums, "trie-sums")
        if step > deepest:
            return sums.select("x", "y", "leaves", "saved")
        handed = (sums.where(F.col("below") >= step).groupBy(F.col("ux").alias("x"), F.col("uy").alias("y"))
                  .agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved")))
        above = sums.where(F.col("below") >= step).select(F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("ux").alias("nx"), F.col("uy").alias("ny"))
        low = sums.where(F.col("below") < 2 * step).withColumns({"ux": F.lit(None).cast("long"), "uy": F.lit(None).cast("long")})
        high = (sums.where(F.col("below") >= 2 * step).join(above, ["ux", "uy"])
                .select("x", "y", F.col("nx").alias("ux"), F.col("ny").alias("uy"), "below", "leaves", "saved"))
        sums = (low.unionByName(high).join(handed, ["x", "y"], "left")
                .select("x", "y", "ux", "uy", "below", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        step *= 2


def ends_digests(ends: DataFrame) -> DataFrame:
    """``x, y, ends_sha256``: digest of the decimal ids of each ``(x, y)``, ascending, comma-joined."""
    def run(batches):
        key, h = None, None
        for b in batches:
            out = []
            for x, y, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (x, y) == key:
                    h.update(b",%d" % c)
                    continue
                if key:
                    out.append((*key, h.hexdigest()))
                key, h = (x, y), hashlib.sha256(b"%d" % c)
            yield pa.RecordBatch.from_pylist([dict(zip(("x", "y", "ends_sha256"), r)) for r in out], schema)
        if key:
            yield pa.RecordBatch.from_pylist([{"x": key[0], "y": key[1], "ends_sha256": h.hexdigest()}], schema)

    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    rows = ends.select("x", "y", "conv_id").repartition("x", "y").sortWithinPartitions("x", "y", "conv_id")
    return rows.mapInArrow(run, "x long, y long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of ``turns(conv_id, pos, digest, bytes)``; ``convs(conv_id)`` names all
    conversations, also those without turns."""
    below, ends = _nodes(convs, _named(turns))
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT[0]).cast("long").alias("x"), F.lit(ROOT[1]).cast("long").alias("y"),
                    F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes")))
    nodes = write_shared(below.unionByName(root), "trie-nodes")
    children = nodes.where("px is not null").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    nodes = write_shared(nodes.join(children, ["x", "y"], "left").join(parents, ["px", "py"], "left")
                         .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-linked")
    sums = _subtree_sums(nodes.select("x", "y", "px", "py", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"),
                                      ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")))
    return (nodes.join(sums, ["x", "y"]).join(ends_digests(ends), ["x", "y"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256")))
