"""Row order, exact quantiles, quantile filters and ordered splits.

The study aligns tables and splits train/test by file position.  Spark has
no implicit order, so every table carries a ``row_idx`` and position is the rank
of ``row_idx`` (NULLs first; rows of equal key in the order of their place in
the materialized table).  Nothing sorts a whole column in one task:

* ``order_statistics`` finds exact order statistics in two scans: a mergeable
  KLL sketch bounds the value of every requested rank, then one exact pass counts the
  values outside these ranges and groups the few inside by value (so a hot value costs
  one row), and a window over the small table picks the ranks.  If a rank is not
  in its range after all, histogram narrowing finds it.  Quantiles and the quantile
  filter build on it.
* ``among_first`` turns "the first k rows" into a row predicate: the k-th key,
  then, only among rows of that key, the k'-th place.  Splits, heads and row
  ranges are filters by it: exact sizes, no ranking, one path for every size.
* ``with_row_number`` deals rows to ranges of the key (hot keys cut by a hash), counts
  each range and adds the offsets to the ranks within ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_
from ..session import materialize

_FINISH_ROWS = 200_000
#: Size of the quantile sketches: ranks within some 0.13 % of the rows.
SKETCH_K = 4096
INF = float("inf")
#: Groups whose order statistics may be asked for at once (one driver row each).
MAX_GROUPS = 10_000
PLACE = "__place"


def grouped_order_statistics(df: DataFrame, group, column, ks_by_group: dict | None = None, qs=None,
                             buckets: int = 1024, finish_rows: int = _FINISH_ROWS, ks_fn=None, sketch_k: int = SKETCH_K):
    """Exact order statistics per group.

    Either ``ks_by_group`` ({group value: [1-based ranks]}), ``qs``
    (quantiles, ranks derived from each group's count) or ``ks_fn`` (count ->
    ranks) is given.  Returns
    ``{(g, k): value}`` and the per-group counts.  Two scans: one for counts,
    ends and a mergeable quantile sketch per group, one that counts exactly around
    the value ranges in which the sketch puts the ranks.  A group of at most
    ``finish_rows`` rows needs no ranges.  A rank that its range turns out not to
    hold is found by narrowing histograms.  Infinities and NaN (ordered last) are
    counted apart."""
    g_col = F.lit(0) if group is None else col_(group)
    vals = df.select(g_col.alias("g"), col_(column).alias("v")).where(F.col("v").isNotNull())
    floating = isinstance(vals.schema["v"].dataType, (T.DoubleType, T.FloatType))
    low, high, odd = ((F.col("v") == F.lit(-INF), F.col("v") == F.lit(INF), F.isnan("v")) if floating else [F.lit(False)] * 3)
    finite = F.when(~(low | high | odd), F.col("v"))
    summary = vals.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"),
                                    F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"), F.count_if(odd).alias("n_odd"),
                                    F.kll_sketch_agg_double(finite.cast("double"), F.lit(sketch_k)).alias("sketch"))
    # the sketches stay in the table; only counts come to the driver
    summary = materialize(summary)
    got = summary.drop("sketch").limit(MAX_GROUPS + 1).collect()
    if len(got) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    stats = {r["g"]: r for r in got}
    if ks_by_group is None and ks_fn is not None:
        ks_by_group = {gv: [k for k in ks_fn(r["n"]) if 1 <= k <= r["n"]] for gv, r in stats.items()}
    if ks_by_group is None:
        ks_by_group = {}
        for gv, r in stats.items():
            ks = set()
            for q in qs:
                j = math.floor((r["n"] - 1) * q)
                ks.update({j + 1, min(j + 2, r["n"])})
            ks_by_group[gv] = sorted(ks)
    out, pending = {}, {}
    for gv, ks in ks_by_group.items():
        for k in map(int, ks):
            r = stats.get(gv)
            if r is None or k < 1 or k > r["n"]:
                raise ValueError(f"k={k} outside 1..{r['n'] if r else 0} for group {gv!r}")
            inner = r["n"] - r["n_low"] - r["n_high"] - r["n_odd"]
            if k <= r["n_low"]:
                out[(gv, k)] = -INF
            elif k > r["n_low"] + inner:
                out[(gv, k)] = INF if k <= r["n"] - r["n_odd"] else float("nan")
            elif r["lo"] == r["hi"]:
                out[(gv, k)] = r["lo"]
            else:
                pending[(gv, k)] = k - r["n_low"]
    counts = {gv: r["n"] for gv, r in stats.items()}
    if not pending:
        return out, counts
    sizes = {gv: r["n"] - r["n_low"] - r["n_high"] - r["n_odd"] for gv, r in stats.items()}
    inside = vals.where(finite.isNotNull())
    small = {key: r for key, r in pending.items() if sizes[key[0]] <= finish_rows}
    if small:
        ends = {gv: [(stats[gv]["lo"], stats[gv]["hi"])] for gv, _ in small}
        out |= _pick(inside, ends, small, whole=True)
    large = {key: r for key, r in pending.items() if key not in small}
    if large:
        out |= _pick(inside, _sketch_ranges(summary, large, sizes, sketch_k), large, whole=False)
    missed = {key: r for key, r in large.items() if key not in out}
    if missed:
        out |= _narrowed(inside, stats, sizes, missed, buckets, finish_rows)
    return out, counts


def _sketch_ranges(summary: DataFrame, ranks: dict, sizes: dict, sketch_k: int) -> dict:
    """Per group, disjoint ascending ranges of values that hold the ranks with the sketch's confidence."""
    eps = 2.0 * 2.296 / sketch_k ** 0.9021  # twice the sketch's 99 % rank error
    pairs: dict = {}
    for (gv, _), r in sorted(ranks.items(), key=lambda x: x[1]):
        pairs.setdefault(gv, []).append((max(0.0, (r - 1) / sizes[gv] - eps), min(1.0, r / sizes[gv] + eps)))
    at = None
    for gv, ps in pairs.items():  # ranks must be literals
        mine, q = F.col("g").eqNullSafe(F.lit(gv)), F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(x) for p in ps for x in p]))
        at = F.when(mine, q) if at is None else at.when(mine, q)
    rows = summary.select("g", at.alias("q"), "lo", "hi").where(F.col("q").isNotNull()).collect()  # at most MAX_GROUPS rows
    out = {}
    for r in rows:
        merged = []
        for (a, b), x, y in zip(pairs[r["g"]], r["q"][0::2], r["q"][1::2]):
            a, b = (float(r["lo"]) if a == 0.0 else x), (float(r["hi"]) if b == 1.0 else y)
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out[r["g"]] = merged
    return out


def _pick(vals: DataFrame, ranges: dict, ranks: dict, whole: bool) -> dict:
    """Values of the ``ranks`` (among each group's finite values) that lie inside the group's ``ranges``,
    from one scan that counts the values between the ranges and groups those inside them.

    ``whole``: the single range of each group holds all its values."""
    v = F.col("v").cast("double")
    part = None
    numbers = {gv: i for i, gv in enumerate(ranges)}
    for gv, rs in ranges.items():
        at = F.lit(2 * len(rs))
        for i, (a, b) in reversed(list(enumerate(rs))):
            at = F.when(v < F.lit(float(a)), 2 * i).when(v <= F.lit(float(b)), 2 * i + 1).otherwise(at)
        mine = F.col("g").eqNullSafe(F.lit(gv))
        part = F.when(mine, F.struct(F.lit(numbers[gv]).alias("g"), at.alias("at"))) if part is None else \
            part.when(mine, F.struct(F.lit(numbers[gv]).alias("g"), at.alias("at")))
    rows = vals.select(part.alias("part"), "v").where(F.col("part").isNotNull()).select("part.g", "part.at", "v")
    # distinct values with counts: few rows, whatever their ties
    counts = rows.groupBy("g", "at", F.when(F.col("at") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    before: dict = {}
    if not whole:
        counts = materialize(counts)
        total = {(r["g"], r["at"]): r["n"] for r in counts.groupBy("g", "at").agg(F.sum("n").alias("n")).collect()}
        for gv, i in numbers.items():
            acc = 0
            for at in range(2 * len(ranges[gv]) + 1):
                before[(i, at)] = acc
                acc += total.get((i, at), 0)
    want: dict = {}
    for (gv, k), r in ranks.items():
        i = numbers[gv]
        for j in range(len(ranges[gv])):
            at = 2 * j + 1
            start = before.get((i, at), 0)
            if whole or start < r <= before[(i, at + 1)]:
                want.setdefault((i, at, r - start), []).append((gv, k))
    if not want:
        return {}
    upto = (counts.where(F.col("at") % 2 == 1)
            .withColumn("upto", F.sum("n").over(Window.partitionBy("g", "at").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))))
    hit = F.lit(False)
    for i, at, rel in want:
        hit = hit | ((F.col("g") == i) & (F.col("at") == at) & (F.col("upto") >= rel) & (F.col("upto") - F.col("n") < rel))
    out = {}
    for r in upto.where(hit).collect():
        for (i, at, rel), keys in want.items():
            if (i, at) == (r["g"], r["at"]) and r["upto"] - r["n"] < rel <= r["upto"]:
                out |= {key: r["v"] for key in keys}
    return out


def _narrowed(vals: DataFrame, stats: dict, sizes: dict, ranks: dict, buckets: int, finish_rows: int) -> dict:
    """Fallback for ranks that the sketch's ranges did not hold: histograms of ``buckets`` rows narrow
    each rank's range, a scan per pass, until it holds few rows or one value."""
    state = {key: (r, sizes[key[0]], stats[key[0]]["lo"], stats[key[0]]["hi"]) for key, r in ranks.items()}
    while True:
        open_ranges = sorted({(key[0], s[2], s[3]) for key, s in state.items() if s[2] != s[3] and s[1] > finish_rows},
                             key=lambda r: (str(r[0]), r[1]))
        if not open_ranges:
            break
        bucket = None
        for i, (gv, a, b) in enumerate(open_ranges):
            # halves keep the width of any finite range finite; the least value falls in the
            # first bucket and the largest in the last, so every pass narrows the range
            half = float(b) / 2 - float(a) / 2
            inner = F.least(F.floor((F.col("v").cast("double") / F.lit(2.0) - F.lit(float(a) / 2)) / F.lit(half) * F.lit(buckets)),
                            F.lit(buckets - 1)).cast("bigint") + F.lit(i * buckets)
            band = (F.col("g").eqNullSafe(F.lit(gv))) & F.col("v").between(F.lit(a), F.lit(b))
            bucket = F.when(band, inner) if bucket is None else bucket.when(band, inner)
        rows = (vals.select(bucket.alias("b"), "v").where(F.col("b").isNotNull()).groupBy("b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .orderBy("b").collect())
        per_range: dict[int, list] = {}
        for r in rows:
            per_range.setdefault(r["b"] // buckets, []).append(r)
        index = {rng: i for i, rng in enumerate(open_ranges)}
        moved = False
        for key, (rel, cnt, a, b) in list(state.items()):
            i = index.get((key[0], a, b))
            if i is None or cnt <= finish_rows:
                continue
            acc = 0
            for r in per_range[i]:
                if acc + r["n"] >= rel:
                    state[key] = (rel - acc, r["n"], r["lo"], r["hi"])
                    moved = moved or r["n"] < cnt
                    break
                acc += r["n"]
        if not moved:  # neighbouring doubles that share a bucket: nothing lies between them
            break
    out = {key: s[2] for key, s in state.items() if s[2] == s[3]}
    for key, (rel, _, a, b) in state.items():
        if key not in out:
            out |= _pick(vals.where(F.col("v").between(F.lit(a), F.lit(b))), {key[0]: [(a, b)]}, {key: rel}, whole=True)
    return out


def order_statistics(df: DataFrame, column, ks, **kw) -> dict:
    """Exact k-th smallest non-null values of ``column`` for every 1-based ``k`` in ``ks``."""
    out, _ = grouped_order_statistics(df.select(col_(column).alias("v")), None, "v",
                                      ks_by_group={0: sorted(set(int(k) for k in ks))}, **kw)
    return {k: v for (_, k), v in out.items()}


def grouped_quantiles(df: DataFrame, group, column, qs) -> dict:
    """Exact linear-interpolated quantiles per group: ``{(g, q): value}``."""
    vals, counts = grouped_order_statistics(df, group, column, qs=qs)
    out = {}
    for gv, n in counts.items():
        for q in qs:
            h = (n - 1) * q
            j = math.floor(h)
            frac = h - j
            va, vb = vals[(gv, j + 1)], vals[(gv, min(j + 2, n))]
            out[(gv, q)] = float(va) if (frac == 0 or va == vb) else float(va) + (float(vb) - float(va)) * frac
    return out


def kth_smallest(df: DataFrame, column, k: int, **kw):
    """Exact k-th smallest (1-based) non-null value of ``column``."""
    return order_statistics(df, column, [k], **kw)[k]


def exact_quantiles(df: DataFrame, column, qs) -> dict:
    """Exact quantiles with linear interpolation (pandas ``linear``, DuckDB
    ``quantile_cont``): ``v[j] + (v[j+1] - v[j]) * frac`` at ``h = (n-1) q``."""
    res = grouped_quantiles(df, None, column, qs)
    if not res:
        return {q: None for q in qs}
    return {q: v for (_, q), v in res.items()}


def exact_quantile(df: DataFrame, column, q: float) -> float | None:
    return exact_quantiles(df, column, [q])[q]


def python_round(x: float) -> int:
    """Python's ``round`` (half to even), as used for the split size."""
    return round(x)


def with_place(df: DataFrame) -> DataFrame:
    """The table written once with each row's place in it (the order of equal keys)."""
    return materialize(df.withColumn(PLACE, F.monotonically_increasing_id()))


def among_first(df: DataFrame, key: str, ks) -> dict:
    """Per requested size k, a never-null predicate that holds for the first k
    rows of ``df`` by (``key`` NULLs first, place); ``df`` comes from ``with_place``."""
    c, place = F.col(key), F.col(PLACE)
    head = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls")).first()
    n, nulls = head["n"], head["nulls"]
    out = {k: F.lit(k >= n) for k in ks if k <= 0 or k >= n}
    inner = sorted({k - nulls for k in ks if k not in out and k > nulls})
    keys = order_statistics(df, key, inner) if inner else {}
    cuts = sorted(set(keys.values()))
    if cuts:
        aggs = [F.struct(F.count_if(c < F.lit(v)).alias("below"), F.count_if(c == F.lit(v)).alias("ties")).alias(f"c{i}")
                for i, v in enumerate(cuts)]
        got = df.agg(*aggs).first()
        ties = {v: got[f"c{i}"] for i, v in enumerate(cuts)}
    for k in ks:
        if k in out:
            continue
        if k <= nulls:
            edge = kth_smallest(df.where(c.isNull()), PLACE, k) if k < nulls else None
            here = c.isNull() if edge is None else c.isNull() & (place <= F.lit(edge))
            out[k] = F.coalesce(here, F.lit(False))
            continue
        v = keys[k - nulls]
        rest = k - nulls - ties[v]["below"]
        at = c == F.lit(v)
        if rest < ties[v]["ties"]:
            at = at & (place <= F.lit(kth_smallest(df.where(c == F.lit(v)), PLACE, rest)))
        out[k] = c.isNull() | F.coalesce((c < F.lit(v)) | at, F.lit(False))
    return out


def mark_split(df: DataFrame, key: str = "row_idx", ratio: float = 0.9) -> DataFrame:
    """B7 as a column: ``is_train`` true for the first ``round(n * ratio)`` rows."""
    df = with_place(df)
    k = python_round(df.count() * ratio)
    return df.withColumn("is_train", among_first(df, key, [k])[k]).drop(PLACE)


def ordered_split(df: DataFrame, key: str = "row_idx", ratio: float = 0.9):
    """train = first ``round(n * ratio)`` rows in ``key`` order, test = the rest; every row is in one of them."""
    marked = mark_split(df, key, ratio)
    return marked.where("is_train").drop("is_train"), marked.where("NOT is_train").drop("is_train")


def row_range(df: DataFrame, key: str, start: int, num: int) -> DataFrame:
    """A4: rows ``[start, start + num)`` by 0-based position in ``key`` order (both ends in one search)."""
    start, num = max(start, 0), max(num, 0)
    df = with_place(df)
    first = among_first(df, key, [start, start + num])
    return df.where(first[start + num] & ~first[start]).drop(PLACE)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """R2: the first ``n`` rows in ``key`` order."""
    return row_range(df, key, 0, n)


def _below(v: Column, bounds: list, lo: int, hi: int) -> Column:
    """How many of the ascending ``bounds`` are at most ``v``, by halving."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(v < F.lit(bounds[mid]), _below(v, bounds, lo, mid)).otherwise(_below(v, bounds, mid + 1, hi))


def range_parts(df: DataFrame, key: str, rows_per_partition: int, least: int) -> tuple[Column, int]:
    """A column that numbers ranges of ``key`` (NULLs first, ascending) of about ``rows_per_partition`` rows
    each, and their number; it needs a column ``__tie``.

    The bounds come from one scan of the key (a mergeable quantile sketch), so every plan can
    compute a row's range from the row alone.  A value that fills several ranges is cut by the
    hash ``__tie``, and so are NULLs: a hot key is no single range."""
    v = F.col(key).cast("double")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("odd")).first()
    parts = max(least, math.ceil(row["n"] / rows_per_partition), 1)
    known = row["n"] - row["nulls"] - row["odd"]
    bounds: list = []
    if known:
        sketch = df.where(v.isNotNull() & ~F.isnan(v)).agg(F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("s"))
        cuts = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
        bounds = sketch.select(F.kll_sketch_get_quantile_double("s", cuts).alias("q")).first()["q"] if cuts is not None else []
    share = F.shiftrightunsigned(F.col("__tie"), 33)  # 31 bits

    def cut(first: int, pieces: int) -> Column:
        return F.lit(first) + F.shiftright(share * F.lit(pieces).cast("long"), 31).cast("int")

    pieces_of_null = max(1, math.ceil(row["nulls"] / max(row["n"], 1) * parts))
    out = F.when(v.isNull(), cut(0, pieces_of_null))
    distinct = sorted(set(bounds))
    start, hot, now = [pieces_of_null], [], pieces_of_null
    for b in distinct:
        times = bounds.count(b)
        if times > 1:
            hot.append((b, now + 1, times))
            now += times
        now += 1
        start.append(now)
    for b, first, times in hot:
        out = out.when(v == F.lit(b), cut(first, times))
    # NaN is larger than all bounds
    place = _below(v, distinct, 0, len(distinct))
    return out.otherwise(F.element_at(F.lit(start).cast("array<int>"), place + 1)), now + 1


def with_row_number(df: DataFrame, key: str = "row_idx", name: str = "row_no", rows_per_partition: int = 1_000_000, tie: Sequence[str] | None = None,
                    keep_range: bool = False) -> DataFrame:
    """1-based position of each row in the order of the numeric ``key`` (NULLs first; rows of equal
    key by a hash of the ``tie`` columns, by default of all).

    Rows go to ranges of about ``rows_per_partition`` rows (at least one per core), where a window ranks
    them; the ranges' sizes, counted from key and tie alone, become offsets (one driver row per range).
    So whole rows cross one exchange and are written nowhere.  ``keep_range``: keep the range in ``__part``."""
    least = df.sparkSession.sparkContext.defaultParallelism
    tied = df.withColumn("__tie", F.xxhash64(*(tie or df.columns)))
    part, n = range_parts(tied.select(key, "__tie"), key, rows_per_partition, least)
    marked = tied.withColumn("__part", part)
    counts = {r["__part"]: r["count"] for r in marked.select("__part").groupBy("__part").count().collect()}
    offsets, acc = [], 0
    for p in range(n):
        offsets.append(acc)
        acc += counts.get(p, 0)
    before = F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("__part") + 1)
    order = Window.partitionBy("__part").orderBy(F.col(key).asc_nulls_first(), F.shiftrightunsigned("__tie", 33), "__tie")
    out = marked.withColumn(name, before + F.row_number().over(order)).drop("__tie")
    return out if keep_range else out.drop("__part")
