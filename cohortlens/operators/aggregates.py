"""Dashboard aggregates and joins (survey F1-F8, F13-F14, F16, E1, E4, H2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import constants as K


def latest_nonnull(df: DataFrame, id_col: str = K.ID_COL, time_col: str = K.TIME_COL) -> DataFrame:
    """per entity, the last *non-null* value of every column in time order.

    ``max_by(c, time if c is not null)`` per column: one hash aggregate on the
    id (partial aggregation before the shuffle, so a hot entity costs one
    buffer per map task, not one giant group).  Null ids are dropped.
    """
    cols = [c for c in df.columns if c != id_col]
    aggs = []
    for c in cols:
        if c == time_col:
            aggs.append(F.max(time_col).alias(time_col))
        else:
            aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time_col))).alias(c))
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*aggs)


def latest_row(df: DataFrame, id_col: str = K.ID_COL, time_col: str = K.TIME_COL,
               tiebreak: Sequence[str] = ()) -> DataFrame:
    """The entity's whole last row (row_number over time descending = 1).

    Catalyst turns ``row_number() = 1`` into a WindowGroupLimit, which keeps
    only the top row per entity in each map task before the shuffle.
    """
    w = Window.partitionBy(id_col).orderBy(F.col(time_col).desc(), *[F.col(t).desc() for t in tiebreak])
    return (df.where(F.col(id_col).isNotNull()).withColumn("__rn", F.row_number().over(w))
            .where("__rn = 1").drop("__rn"))


def value_distribution(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Counts of the non-null values of ``col``."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))


def mean_by_period(df: DataFrame, col: str = "INDE", time_col: str = K.TIME_COL,
                   digits: int = 2) -> DataFrame:
    """mean per period; periods where the column is all-NULL are omitted."""
    return (df.where(F.col(col).isNotNull()).groupBy(time_col)
            .agg(F.round(F.avg(col), digits).alias(f"{col.lower()}_medio")))


def periods(df: DataFrame, time_col: str = K.TIME_COL) -> DataFrame:
    """F8 / H6: sorted distinct periods."""
    return df.select(time_col).distinct().orderBy(time_col)


def dashboard_kpis(panel: DataFrame, id_col: str = K.ID_COL, time_col: str = K.TIME_COL,
                   index_col: str = "INDE") -> DataFrame:
    """N3 (F1-F3, F8): entity count and mean index over each entity's latest
    non-null values, plus the available periods -- one row."""
    latest = latest_nonnull(panel.select(id_col, time_col, index_col), id_col, time_col)
    yrs = panel.agg(F.struct(
        F.array_join(F.array_sort(F.collect_set(F.col(time_col).cast("string"))), ",").alias("anos"),
        F.count_distinct(time_col).alias("n"))).scalar()
    return latest.agg(F.count(F.lit(1)).alias("total_alunos"),
                      F.round(F.avg(index_col), 2).alias("inde_medio")) \
                 .withColumn("__y", yrs) \
                 .select("total_alunos", "inde_medio", F.col("__y.anos").alias("anos_disponiveis"),
                         F.col("__y.n").alias("n_anos"))


def two_period_stats(df: DataFrame, features: Sequence[str], ref_year: int, cur_year: int,
                     time_col: str = K.TIME_COL) -> DataFrame:
    """per feature mean/std (2 decimals) for the reference and current
    periods over complete cases, with the complete-case counts."""
    sub = df.where(F.col(time_col).isin(ref_year, cur_year)).dropna(subset=list(features))
    long = sub.select(time_col, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features
    ])).alias("s")).select(time_col, "s.*")
    is_ref = F.col(time_col) == ref_year
    is_cur = F.col(time_col) == cur_year
    return long.groupBy("feature").agg(
        F.round(F.avg(F.when(is_ref, F.col("x"))), 2).alias("ref_mean"),
        F.round(F.stddev_samp(F.when(is_ref, F.col("x"))), 2).alias("ref_std"),
        F.round(F.avg(F.when(is_cur, F.col("x"))), 2).alias("cur_mean"),
        F.round(F.stddev_samp(F.when(is_cur, F.col("x"))), 2).alias("cur_std"),
        F.count_if(is_ref).alias("ref_count"), F.count_if(is_cur).alias("cur_count"))


# ------------------------------------------------------------------ E1 / E4 / N4
def propagate_first_name(df: DataFrame, name_col: str = "NOME", id_col: str = K.ID_COL,
                         time_col: str = K.TIME_COL) -> DataFrame:
    """Replace ``name_col`` by the entity's first non-null value (time order).

    A window over the id -- no join, so it rides on whatever hash
    partitioning on the id the input already has.
    """
    w = Window.partitionBy(id_col).orderBy(time_col).rowsBetween(Window.unboundedPreceding,
                                                                 Window.unboundedFollowing)
    return df.withColumn(name_col, F.first(name_col, ignorenulls=True).over(w))


def attach_names(df: DataFrame, dim: DataFrame, name_col: str = "NOME", id_col: str = K.ID_COL,
                 dim_name: str = "cluster_nome", dim_id: str = "cluster_id",
                 default_prefix: str = "Cluster ") -> DataFrame:
    """Id -> name through a small dimension; absent -> ``Cluster {id}``.

    The dimension has one row per cluster (k rows), so broadcasting it is
    bounded by the model, not by the data.
    """
    joined = df.join(F.broadcast(dim.select(dim_id, dim_name)), on=dim_id, how="left")
    return joined.withColumn(dim_name, F.coalesce(F.col(dim_name),
                                                  F.concat(F.lit(default_prefix), F.col(dim_id).cast("string"))))


def listing_order(df: DataFrame, name_col: str = "nome", id_col: str = "ra", time_col: str = K.TIME_COL) -> DataFrame:
    """H2: by name (or id when there is no name column), then period; nulls last.

    The id closes the key: the order is total, so the range partitioner can
    split any large tie group (e.g. many rows without a name) across tasks.
    """
    first = name_col if name_col in df.columns else id_col
    keys = [F.col(first).asc_nulls_last(), F.col(time_col).asc_nulls_last()]
    if first != id_col and id_col in df.columns:
        keys.append(F.col(id_col).asc_nulls_last())
    return df.orderBy(*keys)


def round_records(df: DataFrame, digits: int = 2) -> DataFrame:
    """Floats -> NaN/Inf to NULL, rounded to ``digits``."""
    from cohortlens.functions.scalars import round_record_value
    exprs: dict[str, Column] = {c: round_record_value(c, digits) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(exprs) if exprs else df


# ------------------------------------------------------------ D1 / D2 / D4 / D7 / I3
ALL_MARKERS = ("Todas", "Todos")


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    """``col == value``; a falsy value or the "all" marker keeps every row."""
    if value is None or value == 0 or value == "" or value in ALL_MARKERS:
        return df
    return df.where(F.col(col) == F.lit(value))


def complete_case_value(df: DataFrame, features: Sequence[str], value: Column, out: str) -> DataFrame:
    """Keep every row; ``out`` is computed only where all features are present."""
    cond = None
    for f in features:
        c = F.col(f).isNotNull()
        cond = c if cond is None else cond & c
    return df.withColumn(out, F.when(cond, value))


def lookup(df: DataFrame, id_col: str, value) -> DataFrame:
    """The first row of one id (by period, then all columns for determinism)."""
    val = value if isinstance(value, Column) else F.lit(value)
    cols = [c for c in df.columns if not c.startswith("__")]
    return df.where(F.col(id_col) == val).orderBy(*cols).limit(1)


def first_per_entity(df: DataFrame, id_col: str = K.ID_COL, time_col: str = K.TIME_COL,
                     require: str | None = None) -> DataFrame:
    """Keep-first dedup by id in time order (optionally among rows where
    ``require`` is not null) -- row_number, not dropDuplicates (arbitrary row)."""
    src = df.where(F.col(require).isNotNull()) if require else df
    w = Window.partitionBy(id_col).orderBy(time_col)
    return src.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
