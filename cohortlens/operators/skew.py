"""Skew-safe per-entity running statistics (hot entities split into chunks).

``Window.partitionBy(id)`` sends every row of an entity to one task.  When
one entity holds a large share of all rows (a bot user, a default id), that
task holds that share.  Here entities are split by size:

* cold entities use the plain windows;
* hot entities are cut into ``n_chunks`` contiguous time ranges from
  per-entity approximate quantiles (more where an entity has more than
  ``CHUNK_ROWS`` rows a range, so a window does not grow with the entity); each (entity, chunk) is its own window
  partition, and per-chunk summaries (count, sum, min, max, last value)
  prefix-summed over the chunks -- a table of #hot x n_chunks rows -- carry
  the running state across chunk borders.

Results are identical to the plain windows: chunks are contiguous, rows
with equal time never straddle a border, and every running statistic here
(row number, previous value, running count / sum / mean / min / max) is
associative over consecutive chunks.  Whole-entity statistics (count,
regression slope) are grouped aggregates -- partial aggregation absorbs
the hot entity -- attached by a join for the hot ids and by the window for the
cold ones.  Rows without an id belong to no entity: they pass by with NULL
statistics and are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# An entity is hot when it holds more rows than one window task should sort,
# whatever its share of all rows. The hot tables grow with the data, so they
# are joined, not broadcast by a hint: Spark broadcasts them when they are small.
MIN_HOT_ROWS = 1_000_000
DEFAULT_CHUNKS = 1024
CHUNK_ROWS = 1 << 18  # rows in a chunk, about; an entity with more in ``n_chunks`` chunks gets more chunks


def numeric_time(df: DataFrame, time_col: str) -> Column:
    """Time as a number: fractional days since 1970-01-01 for timestamps and
    dates (independent of the session time zone for TIMESTAMP_NTZ), else
    the value itself."""
    typ = dict(df.dtypes)[time_col]
    if typ == "timestamp_ntz":
        us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time_col}`)")
        return us.cast("double") / F.lit(86_400_000_000.0)
    if typ == "timestamp":
        return F.unix_micros(F.col(time_col)).cast("double") / F.lit(86_400_000_000.0)
    if typ == "date":
        return F.unix_date(F.col(time_col)).cast("double")
    return F.col(time_col).cast("double")


def _plain(df: DataFrame, id_col: str, time_col: str, tiebreak: Sequence[str], value: str,
           slope: bool) -> DataFrame:
    w = Window.partitionBy(id_col).orderBy(time_col, *tiebreak)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wa = Window.partitionBy(id_col)
    cols = {
        "n_seq": F.row_number().over(w),
        f"delta_{value}": F.col(value) - F.lag(value).over(w),
        f"{value}_media_hist": F.avg(value).over(wr),
        f"{value}_min_hist": F.min(value).over(wr),
        f"{value}_max_hist": F.max(value).over(wr),
        f"{value}_soma_hist": F.sum(value).over(wr),
        "n_total": F.count(F.lit(1)).over(wa),
    }
    if slope:
        cols[f"tendencia_{value}"] = F.coalesce(
            F.regr_slope(F.col(value), numeric_time(df, time_col)).over(wa), F.lit(0.0))
    return df.withColumns(cols)


def _hot_ids(df: DataFrame, id_col: str, min_hot_rows: int) -> DataFrame:
    """One row per hot entity with its rows' number (``__n``), read several times -> checkpoint once."""
    from cohortlens.session import cut_lineage
    named = df.where(F.col(id_col).isNotNull())
    return cut_lineage(named.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > min_hot_rows))


def _by_size(df: DataFrame, id_col: str, min_hot_rows: int, hot_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without an id, of cold and of hot entities."""
    hot_ids = _hot_ids(df, id_col, min_hot_rows) if hot_ids is None else hot_ids
    tagged = df.where(F.col(id_col).isNotNull()).join(hot_ids.select(id_col, F.lit(True).alias("__hot")), id_col, "left")
    return (df.where(F.col(id_col).isNull()), tagged.where(F.col("__hot").isNull()).drop("__hot"),
            tagged.where(F.col("__hot")).drop("__hot"))


def _chunk_bounds(hot: DataFrame, hot_ids: DataFrame, id_col: str, t: Column, n_chunks: int, *more: Column) -> DataFrame:
    """A row for each hot entity: time bounds of its chunks (``__b``) and ``more`` aggregates."""
    def bounds(rows: DataFrame, n: int) -> DataFrame:
        return rows.groupBy(id_col).agg(F.percentile_approx(t, [i / n for i in range(1, n)], max(10000, 8 * n)).alias("__b"), *more)

    most = hot_ids.agg(F.max("__n")).first()[0] or 0
    if most <= n_chunks * CHUNK_ROWS:
        return bounds(hot, n_chunks)
    large = hot_ids.where(F.col("__n") > n_chunks * CHUNK_ROWS).select(id_col)
    return bounds(hot.join(large, id_col, "left_anti"), n_chunks).unionByName(bounds(hot.join(large, id_col, "left_semi"), -(-most // CHUNK_ROWS)))


def running_value_stats(df: DataFrame, id_col: str, time_col: str, value: str,
                        tiebreak: Sequence[str] = (), min_hot_rows: int = MIN_HOT_ROWS, n_chunks: int = DEFAULT_CHUNKS,
                        slope: bool = True) -> DataFrame:
    """Row number, delta to previous row, running mean/min/max/sum of
    ``value`` and whole-entity count (+ slope of value on time) per entity,
    ordered by ``(time_col, *tiebreak)`` -- skew-safe.

    Chunks are contiguous ranges of ``time_col``; rows of one entity that
    share a timestamp stay in one chunk (the order key beyond time is the
    tiebreak, which quantiles do not split).
    """
    from cohortlens.session import cut_lineage
    hot_ids = _hot_ids(df, id_col, min_hot_rows)
    nameless, cold, hot = _by_size(df, id_col, min_hot_rows, hot_ids)

    out_cold = _plain(cold, id_col, time_col, tiebreak, value, slope)

    # ---- hot entities: chunk by per-entity time quantiles
    t = numeric_time(df, time_col)
    bounds = _chunk_bounds(hot, hot_ids, id_col, t, n_chunks, F.count(F.lit(1)).alias("n_total"),
                           *([F.coalesce(F.regr_slope(F.col(value), t), F.lit(0.0))
                              .alias(f"tendencia_{value}")] if slope else []))
    bounds = cut_lineage(bounds)                              # a row for each hot entity, read twice
    h = hot.join(bounds, id_col)
    h = h.withColumn("__k", F.size(F.filter("__b", lambda b: b < t))).drop("__b")

    ordering = F.struct(F.col(time_col), *[F.col(c) for c in tiebreak])
    per_chunk = h.groupBy(id_col, "__k").agg(
        F.count(F.lit(1)).alias("__c"), F.sum(value).alias("__s"), F.count(value).alias("__cv"),
        F.min(value).alias("__mn"), F.max(value).alias("__mx"),
        F.max_by(F.col(value), ordering).alias("__last"))
    wk = Window.partitionBy(id_col).orderBy("__k")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    offs = per_chunk.select(
        id_col, "__k",
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__oc"),
        F.sum("__s").over(before).alias("__os"),
        F.coalesce(F.sum("__cv").over(before), F.lit(0)).alias("__ocv"),
        F.min("__mn").over(before).alias("__omn"),
        F.max("__mx").over(before).alias("__omx"),
        F.lag("__last").over(wk).alias("__prev_last"))
    h = h.join(offs, [id_col, "__k"])
    w = Window.partitionBy(id_col, "__k").orderBy(time_col, *tiebreak)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run_s = F.sum(value).over(wr)
    run_cv = F.count(value).over(wr)
    tot_s = F.when(F.col("__os").isNull(), run_s).when(run_s.isNull(), F.col("__os")).otherwise(F.col("__os") + run_s)
    tot_cv = F.col("__ocv") + run_cv
    prev = F.when(F.row_number().over(w) == 1, F.col("__prev_last")).otherwise(F.lag(value).over(w))
    out_hot = h.withColumns({
        "n_seq": F.col("__oc") + F.row_number().over(w),
        f"delta_{value}": F.col(value) - prev,
        f"{value}_soma_hist": tot_s,
        f"{value}_media_hist": F.when(tot_cv > 0, tot_s / tot_cv),
        f"{value}_min_hist": F.least(F.col("__omn"), F.min(value).over(wr)),
        f"{value}_max_hist": F.greatest(F.col("__omx"), F.max(value).over(wr)),
    }).drop("__k", "__oc", "__os", "__ocv", "__omn", "__omx", "__prev_last")
    cols = out_cold.columns
    return out_cold.unionByName(out_hot.select(*cols)).unionByName(nameless, allowMissingColumns=True)


# ------------------------------------------------- G2 as of a row, G4, G8 and G9
def _slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, low: Column, high: Column) -> Column:
    """OLS slope from moments; fewer than two points or one time only gives 0."""
    return F.when((n < 2) | (low == high), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0)))


def _plain_features(df: DataFrame, id_col: str, time_col: str, tiebreak: Sequence[str], y: str | None, code_col: str | None,
                    name_col: str | None) -> DataFrame:
    from cohortlens.operators import temporal as G
    out = df
    if y:
        w = Window.partitionBy(id_col).orderBy(time_col, *tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"tendencia_{y}_asof", F.coalesce(F.regr_slope(F.col(y), numeric_time(df, time_col)).over(w), F.lit(0.0)))
    if code_col:
        out = G.drop_target(G.level_changes(out, code_col, id_col, time_col, tiebreak), code_col, id_col, time_col, tiebreak=tiebreak)
    if name_col:
        w = Window.partitionBy(id_col).orderBy(time_col, *tiebreak).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumn(name_col, F.first(name_col, ignorenulls=True).over(w))
    return out


def entity_features(df: DataFrame, id_col: str, time_col: str, tiebreak: Sequence[str] = (), y: str | None = None, code_col: str | None = None,
                    name_col: str | None = None, min_hot_rows: int = MIN_HOT_ROWS, n_chunks: int = DEFAULT_CHUNKS) -> DataFrame:
    """The ordered features of hot entities without a window over a whole entity.

    * ``y``: slope of y on time as of each row (G2), from moments that merge: a chunk sends its number, sums, squares and
      products, their running sums over the chunks before enter each row's own;
    * ``code_col``: level changes and their running total (G4) and whether the next level is lower (G8): the last level
      of the chunk before and the first of the chunk after are carried over the borders, forwards and backwards;
    * ``name_col``: the entity's first known name (G9), a grouped aggregate.

    Same results as the plain windows (``temporal``), which cold entities use; rows without an id keep NULL features.
    """
    from cohortlens import constants as K
    from cohortlens.session import cut_lineage
    hot_ids = _hot_ids(df, id_col, min_hot_rows)
    nameless, cold, hot = _by_size(df, id_col, min_hot_rows, hot_ids)
    out_cold = _plain_features(cold, id_col, time_col, tiebreak, y, code_col, name_col)
    ordering = F.struct(F.col(time_col), *[F.col(c) for c in tiebreak])
    t = numeric_time(hot, time_col)
    known = [F.min_by(F.col(name_col), F.when(F.col(name_col).isNotNull(), ordering)).alias("__name")] if name_col else []
    bounds = cut_lineage(_chunk_bounds(hot, hot_ids, id_col, t, n_chunks, F.min(t).alias("__t0"), *known))
    h = hot.join(bounds, id_col).withColumn("__k", F.size(F.filter("__b", lambda b: b < t))).drop("__b")
    h = h.withColumn("__x", t - F.col("__t0"))                 # time since the entity's first: small numbers to square
    w = Window.partitionBy(id_col, "__k").orderBy(time_col, *tiebreak)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moments: dict[str, Column] = {}
    if y:
        x, v = F.when(F.col(y).isNotNull(), F.col("__x")), F.when(F.col("__x").isNotNull(), F.col(y))
        moments = {"n": F.count(F.when(x.isNotNull(), v)), "sx": F.sum(x), "sy": F.sum(v), "sxx": F.sum(x * x), "sxy": F.sum(x * v),
                   "low": F.min(x), "high": F.max(x)}
    if code_col:
        code = F.col(code_col)
        h = h.withColumns({"__first": F.row_number().over(w) == 1, "__lag": F.lag(code).over(w), "__lead": F.lead(code).over(w),
                           "__last": F.row_number().over(Window.partitionBy(id_col, "__k").orderBy(F.desc(time_col), *[F.desc(c) for c in tiebreak])) == 1})
        h = h.withColumn("__own", F.when(F.col("__first"), 0.0).otherwise(F.coalesce(F.abs(code - F.col("__lag")), F.lit(0.0))))
    sums = {f"__{k}": c for k, c in moments.items()}
    if code_col:
        sums |= {"__inner": F.sum("__own"), "__code0": F.min_by(code, ordering), "__code1": F.max_by(code, ordering)}
    wk = Window.partitionBy(id_col).orderBy("__k")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    if sums:
        chunks = h.groupBy(id_col, "__k").agg(*[c.alias(n) for n, c in sums.items()])
        carried = []
        if y:
            carried += [F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in ("n", "sx", "sy", "sxx", "sxy")]
            carried += [F.min("__low").over(before).alias("__o_low"), F.max("__high").over(before).alias("__o_high")]
        if code_col:
            border = F.coalesce(F.abs(F.col("__code0") - F.lag("__code1").over(wk)), F.lit(0.0))
            chunks = chunks.withColumn("__border", border)
            carried += ["__border", F.coalesce(F.sum(F.col("__inner") + F.col("__border")).over(before), F.lit(0.0)).alias("__o_total"),
                        F.lead("__code0").over(wk).alias("__next")]
        h = h.join(chunks.select(id_col, "__k", *carried), [id_col, "__k"])
    new: dict[str, Column] = {}
    if y:
        run = {k: F.coalesce(c.over(wr), F.lit(0)) + F.col(f"__o_{k}") for k, c in moments.items() if k not in ("low", "high")}
        new[f"tendencia_{y}_asof"] = _slope(run["n"], run["sx"], run["sy"], run["sxx"], run["sxy"],
                                            F.least(F.col("__o_low"), moments["low"].over(wr)), F.greatest(F.col("__o_high"), moments["high"].over(wr)))
    if code_col:
        new["pedras_mudadas"] = F.when(F.col("__first"), F.col("__border")).otherwise(F.col("__own"))
        new["pedras_mudadas_total"] = F.col("__o_total") + F.col("__border") + F.sum("__own").over(wr)
        new[K.TARGET_COL] = (F.when(F.col("__last"), F.col("__next")).otherwise(F.col("__lead")) < code).cast("double")
    if name_col:
        new[name_col] = F.col("__name")
    out_hot = h.withColumns(new)
    return out_cold.unionByName(out_hot.select(*out_cold.columns)).unionByName(nameless, allowMissingColumns=True)
