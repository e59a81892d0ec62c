"""Helpers shared by the operators: shared-folder tables, worker caches, Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Characters of text worked on at once inside a task (bounds numpy temporaries).
CHUNK_BYTES = 1 << 20


def ship(module_name: str) -> None:
    """Send this module's functions to Python workers by value, so executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def worker_cache(key, build: Callable):
    """A value built once per Python worker process (workers are reused by tasks)."""
    store = sys.modules.setdefault("_routewise_worker_cache", types.ModuleType("_routewise_worker_cache")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def give_back() -> None:
    """Return freed memory of this process to the system (without glibc, that of Arrow alone)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives its memory back when its rows end.

    Workers wait for later tasks with what earlier ones freed, and that would
    count against their executor while Spark's own joins need the room."""
    def tidied(batches):
        yield from run(batches)
        give_back()
    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the cluster's shared folder and read back (survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_crc(col: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def string_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of about ``chunk_bytes`` UTF-8 bytes.

    Yields ``(first_row, last_row, bytes, offsets)``; null counts as empty.  A
    single longer text is a run of its own and is never cut."""
    col = column.fill_null("").cast(pa.large_string())
    if len(col) == 0:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offs, offs[lo] + chunk_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi, data[offs[lo]: offs[hi]], (offs[lo: hi + 1] - offs[lo])
        lo = hi


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of the splitmix generator, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, at least ``n`` of each."""
    have = worker_cache("hash_powers", lambda: {})
    if have.get("n", 0) < n:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("p", _P), ("inv", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            have[key] = np.multiply.accumulate(a)
        have["n"] = size
    return have["p"], have["inv"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span ``data[starts:ends]`` (spans non-empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    byte = worker_cache("hash_bytes", lambda: splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    p, inv = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(byte[data] * p[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return splitmix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def ascii_white() -> np.ndarray:
    def build():
        t = np.zeros(256, bool)
        t[[0x20, 9, 10, 11, 12, 13]] = True
        return t
    return worker_cache("ascii_white", build)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than ASCII white space) of several texts in one
    buffer: ``(starts, ends, row of each word)``.  No word spans two texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    white = ascii_white()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = white[:-1]
    starts = np.flatnonzero(~white & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = white[1:]
    ends = np.flatnonzero(~white & (after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def lower_ascii(data: np.ndarray) -> np.ndarray:
    def build():
        t = np.arange(256, dtype=np.uint8)
        t[65:91] += 32
        return t
    return worker_cache("lower_ascii", build)[data]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)``: ``(node, root)`` for every node
    that has an edge, ``root`` the least node of its component.

    Alternating large-star and small-star rounds on the edge table; all
    grouping is a minimum (combined on the map side), the joins only meet a
    node's minimum with its edges, and each round is written to the shared
    folder.  Nothing is collected but one row per round."""
    def mark(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = write_shared(e, "cc")
    now = mark(e)
    for _ in range(max_rounds):
        if not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = write_shared(small, "cc")
        was, now = now, mark(e)
        if now == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
