"""Exact order statistics without holding a column in one buffer.

``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer -- fine for a few thousand values, not for a continuous
column of a 100 TB table.  ``kth_value`` finds the exact k-th smallest
value by narrowing: each pass is one distributed aggregate that counts the
rows of the current value range in ``buckets`` equal-width buckets (at most
``buckets`` result rows), keeps the bucket holding rank k, and stops when
that bucket holds a single value or few enough rows to return their
(value, count) pairs (at most ``limit`` rows).  Typical data needs 2-4
passes; every result the driver sees is bounded by ``buckets`` or ``limit``.
Each pass divides the finite value range by ``buckets``, so the passes end by
themselves; infinite values are counted apart.

``order_statistics`` finds ranks of many columns together: a double's bits in an
order-preserving form are 64-bit whole numbers, and each pass is one aggregate over
all columns that counts the next digit (DIGITS bits) behind the digits found so far.
Seven passes end it whatever the data; a pass returns at most 2^10 rows for each
rank asked for. ``exact_medians`` is that with the two middle ranks of each column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
LIMIT = 10_000
DIGITS = (10, 9, 9, 9, 9, 9, 9)  # bits of each pass, 64 in all


def _values(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col).cast("double")
    return df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))


def kth_value(values: DataFrame, k: int, lo: float, hi: float, below: int = 0,
              buckets: int = BUCKETS, limit: int = LIMIT) -> float:
    """Exact k-th smallest (0-based) of column ``x`` of ``values``, given
    that all candidates lie in [lo, hi] and ``below`` rows are < lo."""
    x = F.col("x")
    while lo != hi:
        rng = values.where((x >= lo) & (x <= hi))
        width = hi / buckets - lo / buckets
        if width <= 0 or lo + width == lo:
            break
        b = F.greatest(F.lit(0), F.least(F.floor(x / F.lit(width) - F.lit(lo / width)), F.lit(buckets - 1))).cast("int")
        hist = sorted((r["b"], r["n"], r["mn"], r["mx"]) for r in
                      rng.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"),
                                                    F.max("x").alias("mx")).collect())
        cum = below
        for _, n, mn, mx in hist:
            if cum + n > k:
                if mn == mx:
                    return mn
                if n <= limit:
                    pairs = (rng.where((x >= mn) & (x <= mx)).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
                             .orderBy("x").collect())
                    for r in pairs:
                        if cum + r["c"] > k:
                            return r["x"]
                        cum += r["c"]
                lo, hi, below = mn, mx, cum
                break
            cum += n
        else:
            raise ValueError("rank outside the value range")
    if lo == hi:
        return lo
    # Degenerate spacing: the range is narrower than ``buckets`` ulps of lo,
    # so it holds fewer than ``buckets`` distinct doubles -- count them all.
    pairs = values.where((x >= lo) & (x <= hi)).groupBy("x").agg(F.count(F.lit(1)).alias("c")) \
                  .orderBy("x").collect()
    cum = below
    for r in pairs:
        if cum + r["c"] > k:
            return r["x"]
        cum += r["c"]
    raise ValueError("rank not found")


def exact_median(df: DataFrame, col: str, buckets: int = BUCKETS, limit: int = LIMIT) -> float | None:
    """Median with interpolation between the two middle values (even count)."""
    from pyspark import StorageLevel
    # One column, persisted for the few passes (recomputable if an executor is lost).
    v = _values(df, col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        x, inf = F.col("x"), float("inf")
        finite = F.when(F.abs(x) < inf, x)
        st = v.agg(F.count(F.lit(1)).alias("n"), F.count_if(x == -inf).alias("low"), F.count(finite).alias("finite"),
                   F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
        n = st["n"]
        if not n:
            return None
        k1, k2 = (n - 1) // 2, n // 2

        def kth(k: int) -> float:
            if k < st["low"]:
                return -inf
            if k >= st["low"] + st["finite"]:
                return inf
            return kth_value(v, k, st["lo"], st["hi"], st["low"], buckets, limit)

        a = kth(k1)
        if k2 == k1:
            return a
        nxt = v.agg(F.count_if(x <= a).alias("le"), F.min(F.when(x > a, x)).alias("up")).first()
        b = a if nxt["le"] > k2 else nxt["up"]
        return (a + b) / 2.0
    finally:
        v.unpersist()


def sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of the doubles (-0.0 as 0.0, no NaN)."""
    bits = (x + 0.0).view("u8")
    return np.where(bits >> np.uint64(63) != 0, ~bits, bits | np.uint64(1 << 63))


def unsortable(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], "u8").view("f8")[0])


def _digit_counts(wanted: dict[int, list[int]], done: int, bits: int):
    """Per (column, prefix): rows by the next digit, with the least and the greatest key of each."""
    shift = np.uint64(64 - done - bits)
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {(c, p): np.zeros(size, "i8") for c, ps in wanted.items() for p in ps}
        low = {k: np.full(size, (1 << 64) - 1, "u8") for k in n}
        high = {k: np.zeros(size, "u8") for k in n}
        for batch in batches:
            for c, prefixes in wanted.items():
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                key = sortable(x[~np.isnan(x)])
                for p in prefixes:
                    own = key[key >> np.uint64(64 - done) == np.uint64(p)] if done else key
                    digit = (own >> shift & np.uint64(size - 1)).astype("i8")
                    n[c, p] += np.bincount(digit, minlength=size)
                    np.minimum.at(low[c, p], digit, own)
                    np.maximum.at(high[c, p], digit, own)
        rows = [(c, p, int(d), int(n[c, p][d]), int(low[c, p][d]) - (1 << 63), int(high[c, p][d]) - (1 << 63)) for c, p in n for d in np.nonzero(n[c, p])[0]]
        kinds = [pa.int32(), pa.decimal128(20), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["c", "p", "digit", "n", "low", "high"])

    return run


def order_statistics(df: DataFrame, cols: Sequence[str], ranks: Callable[[int], Sequence[int]]) -> dict[str, list[float]]:
    """Exact order statistics of every column: ``ranks(n)`` names the 0-based ranks for n values that are neither NULL nor NaN.

    A column without values gives an empty list. ``df`` is scanned once a pass, at most seven times, whatever the number of columns.
    """
    cols = list(cols)
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(cols)])
    found: dict[tuple[int, int], float] = {}          # (column, rank) -> value
    goals: dict[tuple[int, int], tuple[int, int]] = {}  # (column, rank) -> prefix, rank below it
    asked: dict[int, list[int]] = {}
    done = 0
    for number, bits in enumerate(DIGITS):
        wanted = {k: sorted({p for (c, _), (p, _) in goals.items() if c == k}) for k in range(len(cols))} if number else {k: [0] for k in range(len(cols))}
        wanted = {k: p for k, p in wanted.items() if p}
        if not wanted:
            break
        counts = values.mapInArrow(_digit_counts(wanted, done, bits), "c int, p decimal(20,0), digit int, n long, low long, high long")
        rows = counts.groupBy("c", "p", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
        table: dict[tuple[int, int], list] = {}
        for r in sorted(rows, key=lambda r: (r.c, r.p, r.digit)):
            table.setdefault((r.c, int(r.p)), []).append(r)
        if not number:
            for k in range(len(cols)):
                asked[k] = list(ranks(sum(r.n for r in table.get((k, 0), [])))) if table.get((k, 0)) else []
                goals |= {(k, rank): (0, rank) for rank in asked[k]}
        for (c, rank), (p, below) in list(goals.items()):
            for r in table[c, p]:
                if below < r.n:
                    break
                below -= r.n
            else:
                raise ValueError("rank outside the values")
            if r.low == r.high:
                found[c, rank] = unsortable(r.low + (1 << 63))
                del goals[c, rank]
            else:
                goals[c, rank] = (p << bits | r.digit, below)
        done += bits
    return {c: [found[k, rank] for rank in asked.get(k, [])] for k, c in enumerate(cols)}


def exact_medians(df: DataFrame, cols: Sequence[str]) -> Mapping[str, float | None]:
    """The median of every column, the two middle values averaged; None for a column without values."""
    from pyspark import StorageLevel
    if not cols:
        return {}
    held = df.select(*[F.col(f"`{c}`") for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)   # read once a pass
    try:
        middle = order_statistics(held, cols, lambda n: [(n - 1) // 2, n // 2])
    finally:
        held.unpersist()
    return {c: None if not v else v[0] if v[0] == v[-1] else (v[0] + v[-1]) / 2 for c, v in middle.items()}
