"""Exact running sums along a value order, computed in parallel buckets.

A window ``partitionBy(group).orderBy(x)`` puts every row of a group in one
task.  For drift (one group per feature) or ROC AUC (one group) that is the
whole column in a single task.  Instead:

1. cut each group's value range into ``n_buckets`` contiguous ranges using
   approximate quantiles (one mergeable-sketch aggregate);
2. total the weights per (group, bucket) -- a tiny table;
3. prefix-sum those totals per group (tiny window) to get each bucket's
   offset, plus the first value of the next bucket;
4. run the real window per (group, bucket) -- many tasks -- and add the
   offset.

Bucket boundaries only decide parallelism, never the result: every value
lands in exactly one bucket and buckets keep the order, so the sums are
exactly those of the single global window.  The two small tables have
(#groups x n_buckets) rows, so broadcasting them is bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucketed_running_sums(df: DataFrame, keys: Sequence[str], order_col: str, value_cols: Sequence[str],
                          n_buckets: int = 64, next_col: str | None = None, cut: bool = True) -> DataFrame:
    """Add ``cum_<v>`` (inclusive running sum of ``v`` ordered by ``order_col``
    within ``keys``) for each value column; optionally ``next_col`` = the next
    ``order_col`` value in the group (NULL for the last).

    ``order_col`` must be unique within a group (pre-aggregate first).
    The input feeds four branches, so it is checkpointed first (``cut``)
    unless the caller already did.
    """
    keys = list(keys)
    if cut:
        from cohortlens.session import cut_lineage
        df = cut_lineage(df)
    x = F.col(order_col)
    if n_buckets > 1:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        if keys:
            bounds = df.groupBy(*keys).agg(F.percentile_approx(order_col, probs, 10000).alias("__bounds"))
            with_b = df.join(F.broadcast(bounds), keys, "inner")
            with_b = with_b.withColumn("__bk", F.size(F.filter("__bounds", lambda b: b < x))).drop("__bounds")
        else:
            bounds = df.agg(F.percentile_approx(order_col, probs, 10000)).scalar()
            # (a subquery cannot sit inside a lambda: project it first)
            with_b = df.withColumn("__bounds", bounds)
            with_b = with_b.withColumn("__bk", F.size(F.filter("__bounds", lambda b: b < x))).drop("__bounds")
    else:
        with_b = df.withColumn("__bk", F.lit(0))

    tot = with_b.groupBy(*keys, "__bk").agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols],
                                            F.min(order_col).alias("__bmin"))
    # Bucket totals: (#groups x n_buckets) rows; a global window is fine there.
    wb = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__bk")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys, "__bk",
                      *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in value_cols],
                      F.lead("__bmin").over(wb).alias("__next_bmin"))

    joined = with_b.join(F.broadcast(offs), [*keys, "__bk"], "inner")
    w = Window.partitionBy(*keys, "__bk").orderBy(order_col)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exprs = {f"cum_{v}": F.col(f"__o_{v}") + F.sum(v).over(wr) for v in value_cols}
    if next_col:
        exprs[next_col] = F.coalesce(F.lead(order_col).over(w), F.col("__next_bmin"))
    out = joined.withColumns(exprs)
    return out.drop("__bk", "__next_bmin", *[f"__o_{v}" for v in value_cols])
