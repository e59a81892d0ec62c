"""Approximate nearest neighbours: a vantage-point tree per shard.

Unit vectors are dealt to shards by a hash of the id; each shard (at most
``SHARD_ROWS`` rows at once) builds a vantage-point tree.  All queries walk
every shard's tree together: at a node they measure the vantage point, go to
the nearer side first and enter the other side only if
``slack * |distance - radius| <= current k-th distance``.  ``slack = 1`` is the
triangle inequality and restores exact search; larger values prune more.  Every
row is indexed and the k nearest found per shard are merged per query.

The measure is the cosine of the original vectors in double precision.  A task
holds one shard; the queries stream past it in blocks of ``QUERY_BLOCK``.

Defined results: vectors that are null, empty, zero, of another length than
most, or hold null or non-finite components take no part; ties go to the
smaller id; repeated rows are candidates of their own, a repeated query row is a query of
its own with its own ranks; a query never meets rows of its own id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, write_shared
from .topk import matrix, usable

ship(__name__)

SHARD_ROWS = 4096
QUERY_BLOCK = 1024
LEAF = 64
SLACK = 1.25


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish (no rounding)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def build(unit: np.ndarray, rng: np.random.Generator) -> list:
    """Tree over the rows of ``unit``: leaves are arrays of row numbers, nodes are (vantage row, radius, inner, outer)."""
    def grow(rows):
        if len(rows) <= LEAF:
            return rows
        at = int(rng.integers(len(rows)))
        point, rest = rows[at], np.delete(rows, at)
        d = np.sqrt(np.maximum(((unit[rest] - unit[point]) ** 2).sum(1), 0))
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # many equal distances: no split helps
            return rows
        return (point, radius, grow(rest[inside]), grow(rest[~inside]))
    return grow(np.arange(len(unit)))


def search(tree, unit: np.ndarray, ids: np.ndarray, queries: np.ndarray, qids: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and row numbers (-1: none) of the k nearest found for every query, nearest first."""
    n = len(queries)
    best = np.full((n, k), np.inf)
    rows = np.full((n, k), -1, np.int64)

    def offer(q, cand):
        for lo in range(0, len(cand), 1024):
            part = cand[lo:lo + 1024]
            d = np.maximum(2 - 2 * (queries[q] @ unit[part].T), 0)
            d[qids[q][:, None] == ids[part][None, :]] = np.inf
            d = np.concatenate([best[q], d], axis=1)
            r = np.concatenate([rows[q], np.broadcast_to(part, (len(q), len(part)))], axis=1)
            tie = np.where(r < 0, np.iinfo(np.int64).max, ids[r])
            order = np.lexsort((tie, np.round(d, 13)), axis=1)[:, :k]
            best[q] = np.take_along_axis(d, order, 1)
            rows[q] = np.take_along_axis(r, order, 1)
        rows[q] = np.where(np.isfinite(best[q]), rows[q], -1)

    def walk(node, q):
        if not len(q):
            return
        if not isinstance(node, tuple):
            offer(q, node)
            return
        point, radius, inner, outer = node
        d = np.sqrt(np.maximum(2 - 2 * (queries[q] @ unit[point]), 0))
        offer(q, np.array([point]))
        near = d <= radius
        walk(inner, q[near])
        walk(outer, q[~near])
        reach = slack * np.abs(d - radius) <= np.sqrt(best[q, -1]) + 1e-7
        walk(outer, q[near & reach])
        walk(inner, q[~near & reach])

    walk(tree, np.arange(n))
    return best, rows


def nearest(data: DataFrame, is_query, k: int = 5, slack: float = SLACK, vec: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query`` (a column of ``id``), the k nearest others found."""
    rows = usable(data, vec, ident).where(F.exists("v", lambda x: x != 0))
    # every query row has its own place: rows of one id are queries of their own
    asked = write_shared(rows.where(is_query).withColumn("place", F.monotonically_increasing_id()), "vptree-queries")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    # query blocks meet shards: every query visits each shard once, after the shard's rows
    q = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "place", "v")
    # the row number keeps many rows of one id from meeting in one shard
    d = rows.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"),
                    F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("place"), "v")

    def solve(batches):
        shard, did, dv, trees = None, [], [], None

        def plant():
            x, ids = np.concatenate(dv), np.concatenate(did)
            out = []
            for lo in range(0, len(ids), SHARD_ROWS):
                part, own = scaled(x[lo:lo + SHARD_ROWS]), ids[lo:lo + SHARD_ROWS]
                norm = np.sqrt((part * part).sum(1))
                unit = part / norm[:, None]
                out.append((build(unit, np.random.default_rng(len(own))), part, norm, unit, own))
            return out

        def ask(qi, places, qs):
            qs = scaled(qs)
            qnorm = np.sqrt((qs * qs).sum(1))
            for tree, x, norm, unit, ids in trees:
                _, got = search(tree, unit, ids, qs / qnorm[:, None], qi, k, slack)
                a, place = np.nonzero(got >= 0)
                r = got[a, place]
                cos = (qs[a] * x[r]).sum(1) / (qnorm[a] * norm[r])
                yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(places[a]), pa.array(ids[r]), pa.array(cos)], names=["query_id", "place", "vec_id", "score"])

        for b in batches:
            s, kind, ids, places = (b.column(c).to_numpy() for c in range(4))
            v = matrix(b.column(4))
            cut = np.flatnonzero((np.diff(s) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(s)]):
                if s[lo] != shard:
                    shard, did, dv, trees = s[lo], [], [], None
                if kind[lo] == 0:
                    did.append(ids[lo:hi])
                    dv.append(v[lo:hi])
                elif did:
                    trees = trees or plant()
                    for at in range(lo, hi, QUERY_BLOCK):
                        some = slice(at, min(hi, at + QUERY_BLOCK))
                        yield from ask(ids[some], places[some], v[some])

    both = q.unionByName(d).repartition("shard").sortWithinPartitions("shard", "kind", "id")
    found = both.mapInArrow(solve, "query_id long, place long, vec_id long, score double")
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
