"""Per-entity ordered operators (survey section 2.G).

All operators are window expressions over ``partitionBy(id)``.  Composed in
``temporal_features`` they share one Exchange (hash on the id) and one Sort,
whatever the number of features.  Output row count always equals input.

Ordering: ``(time_col, *tiebreak)``.  ``(id, time)`` must be unique unless a
tiebreak is given -- Spark has no stable input order to fall back on.
A row without an id belongs to no entity: every feature of it is NULL. Null
ids still share one window partition, so quarantine them first
(``quality.split_valid``) where there are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cohortlens import constants as K

HIST_FEATURES = ["INDE", "IEG", "IDA", "IPS"]
DELTA_FEATURES = ["INDE", "IEG", "IDA"]


def ordered_window(id_col: str, time_col: str, tiebreak: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(id_col).orderBy(time_col, *tiebreak)


def running_window(id_col: str, time_col: str, tiebreak: Sequence[str] = ()) -> WindowSpec:
    return ordered_window(id_col, time_col, tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def entity_window(id_col: str) -> WindowSpec:
    return Window.partitionBy(id_col)


def of_entity(value: Column, id_col: str) -> Column:
    """The value for rows with an id, else NULL."""
    return F.when(F.col(id_col).isNotNull(), value)


# --------------------------------------------------------------------------- G1
def delta_exprs(df: DataFrame, features: Sequence[str], id_col: str = K.ID_COL,
                time_col: str = K.TIME_COL, tiebreak: Sequence[str] = ()) -> dict[str, Column]:
    w = ordered_window(id_col, time_col, tiebreak)
    return {f"delta_{f}": of_entity(F.col(f) - F.lag(f).over(w), id_col) for f in features if f in df.columns}


def deltas(df: DataFrame, features: Sequence[str], id_col: str = K.ID_COL,
           time_col: str = K.TIME_COL, tiebreak: Sequence[str] = ()) -> DataFrame:
    """G1: value minus the previous *row* of the same entity (first row NULL)."""
    return df.withColumns(delta_exprs(df, features, id_col, time_col, tiebreak))


# --------------------------------------------------------------------------- G2
def trend_expr(y: str = "INDE", id_col: str = K.ID_COL, time_col: str = K.TIME_COL,
               as_of: bool = False, tiebreak: Sequence[str] = ()) -> Column:
    """OLS slope of ``y`` on time over the entity's non-null history.

    Default uses the whole history on every row; ``as_of=True`` only the rows
    up to the current one (no look-ahead).  Fewer than two points, or a
    constant time, gives 0.0.
    """
    w = running_window(id_col, time_col, tiebreak) if as_of else entity_window(id_col)
    return of_entity(F.coalesce(F.regr_slope(F.col(y), F.col(time_col).cast("double")).over(w), F.lit(0.0)), id_col)


def trend_slope(df: DataFrame, y: str = "INDE", id_col: str = K.ID_COL,
                time_col: str = K.TIME_COL, as_of: bool = False, out: str | None = None,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """G2."""
    name = out or (f"tendencia_{y}" + ("_asof" if as_of else ""))
    return df.withColumn(name, trend_expr(y, id_col, time_col, as_of, tiebreak))


# --------------------------------------------------------------------------- G3
def years_in_program(df: DataFrame, id_col: str = K.ID_COL, time_col: str = K.TIME_COL,
                     tiebreak: Sequence[str] = (), out: str = "anos_no_programa") -> DataFrame:
    """1-based running row count per entity."""
    return df.withColumn(out, of_entity(F.row_number().over(ordered_window(id_col, time_col, tiebreak)), id_col))


# --------------------------------------------------------------------------- G4
def level_changes(df: DataFrame, code_col: str = "PEDRA_CODIGO", id_col: str = K.ID_COL,
                  time_col: str = K.TIME_COL, tiebreak: Sequence[str] = ()) -> DataFrame:
    """|code - previous code| (0 when either is NULL) and its running total.

    Two selects because a window cannot nest in another; the second reuses
    the first one's partitioning and ordering (no extra Exchange or Sort).
    """
    if code_col not in df.columns:
        return df.withColumns({"pedras_mudadas": F.lit(0.0), "pedras_mudadas_total": F.lit(0.0)})
    w = ordered_window(id_col, time_col, tiebreak)
    step = df.withColumn("pedras_mudadas",
                         of_entity(F.coalesce(F.abs(F.col(code_col) - F.lag(code_col).over(w)), F.lit(0.0)), id_col))
    return step.withColumn("pedras_mudadas_total",
                           F.sum("pedras_mudadas").over(running_window(id_col, time_col, tiebreak)))


# --------------------------------------------------------------------------- G5
def new_entities(df: DataFrame, id_col: str = K.ID_COL, out: str = "ingressante") -> DataFrame:
    """The entity has exactly one record."""
    return df.withColumn(out, of_entity(F.count(F.lit(1)).over(entity_window(id_col)) == 1, id_col))


# --------------------------------------------------------------------------- G6
def history_exprs(df: DataFrame, features: Sequence[str] = HIST_FEATURES, id_col: str = K.ID_COL,
                  time_col: str = K.TIME_COL, tiebreak: Sequence[str] = ()) -> dict[str, Column]:
    wr = running_window(id_col, time_col, tiebreak)
    out: dict[str, Column] = {}
    for f in features:
        if f in df.columns:
            out[f"{f}_media_hist"] = of_entity(F.avg(f).over(wr), id_col)
            out[f"{f}_min_hist"] = of_entity(F.min(f).over(wr), id_col)
            out[f"{f}_max_hist"] = of_entity(F.max(f).over(wr), id_col)
    return out


def history_stats(df: DataFrame, features: Sequence[str] = HIST_FEATURES, id_col: str = K.ID_COL,
                  time_col: str = K.TIME_COL, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Expanding mean / min / max (nulls skipped, current row included)."""
    return df.withColumns(history_exprs(df, features, id_col, time_col, tiebreak))


# --------------------------------------------------------------------------- G7
def temporal_features(df: DataFrame, id_col: str = K.ID_COL, time_col: str = K.TIME_COL,
                      code_col: str = "PEDRA_CODIGO", index_col: str = "INDE",
                      tiebreak: Sequence[str] = ()) -> DataFrame:
    """Deltas, trend, years in program, level changes, new flag, history.

    One pass of window expressions; Catalyst plans them under a single
    hash Exchange on ``id_col`` and a single Sort.
    """
    w = ordered_window(id_col, time_col, tiebreak)
    first: dict[str, Column] = {}
    first.update(delta_exprs(df, DELTA_FEATURES, id_col, time_col, tiebreak))
    if index_col in df.columns:
        first[f"tendencia_{index_col}"] = trend_expr(index_col, id_col, time_col)
    first["anos_no_programa"] = of_entity(F.row_number().over(w), id_col)
    if code_col in df.columns:
        first["pedras_mudadas"] = of_entity(F.coalesce(F.abs(F.col(code_col) - F.lag(code_col).over(w)), F.lit(0.0)), id_col)
    else:
        first["pedras_mudadas"] = F.lit(0.0)
    first["ingressante"] = of_entity(F.count(F.lit(1)).over(entity_window(id_col)) == 1, id_col)
    first.update(history_exprs(df, HIST_FEATURES, id_col, time_col, tiebreak))
    step = df.withColumns(first)
    return step.withColumn("pedras_mudadas_total",
                           F.sum("pedras_mudadas").over(running_window(id_col, time_col, tiebreak)))


# --------------------------------------------------------------------------- G8
def drop_target(df: DataFrame, code_col: str = "PEDRA_CODIGO", id_col: str = K.ID_COL,
                time_col: str = K.TIME_COL, out: str = K.TARGET_COL,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """1.0 when the next record's code is lower, 0.0 when not; NULL when
    either code is NULL or there is no next record (three-valued logic)."""
    if code_col not in df.columns:
        return df.withColumn(out, F.lit(None).cast("double"))
    w = ordered_window(id_col, time_col, tiebreak)
    return df.withColumn(out, of_entity((F.lead(code_col).over(w) < F.col(code_col)).cast("double"), id_col))
