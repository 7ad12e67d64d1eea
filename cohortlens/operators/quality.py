"""Validation and data-quality aggregates (survey C12, F9-F11, D3, D6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K

INDICATORS_OPTIONAL = ("ieg", "ida", "ips", "iaa", "ian", "ipp", "ipv",
                       "inde_anterior", "ieg_anterior", "ida_anterior")


def _opt(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None)


def request_errors(df: DataFrame, year_range: tuple[int, int] = (2020, 2030),
                   value_range: tuple[float, float] = (0.0, 10.0)) -> Column:
    """Array of rule violations of a scoring request (empty when valid)."""
    lo, hi = value_range
    checks: list[tuple[Column, str]] = [
        (_opt(df, "aluno_id").isNull() | (F.length(_opt(df, "aluno_id")) < 1), "aluno_id:obrigatorio"),
        (_opt(df, "ano").isNull(), "ano:obrigatorio"),
        (~_opt(df, "ano").between(*year_range), "ano:intervalo"),
        (_opt(df, "inde").isNull(), "inde:obrigatorio"),
        (~_opt(df, "inde").between(lo, hi), "inde:intervalo"),
    ]
    for c in INDICATORS_OPTIONAL:
        if c in df.columns:
            checks.append((~F.col(c).between(lo, hi), f"{c}:intervalo"))
    if "anos_no_programa" in df.columns:
        checks.append((F.col("anos_no_programa") < 1, "anos_no_programa:minimo"))
    if "pedras_mudadas_total" in df.columns:
        checks.append((F.col("pedras_mudadas_total") < 0, "pedras_mudadas_total:minimo"))
    if "pedra" in df.columns:
        checks.append((~F.col("pedra").isin(*K.LEVEL_NAMES), "pedra:dominio"))
    # report requests: name required when present, age 5-100, risk percentage 0-100
    if "nome" in df.columns:
        checks.append((F.col("nome").isNull() | (F.length("nome") < 1), "nome:obrigatorio"))
    if "idade" in df.columns:
        checks.append((~F.col("idade").between(5, 100), "idade:intervalo"))
    if "risco_percentual" in df.columns:
        checks.append((~F.col("risco_percentual").between(0, 100), "risco_percentual:intervalo"))
    # NULL comparisons stay NULL -> coalesce to "no violation" (optional fields).
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(msg))
                                     for cond, msg in checks]))


def validate(df: DataFrame, **rules) -> DataFrame:
    """Adds ``erros`` (array<string>) and ``valido`` (boolean)."""
    out = df.withColumn("erros", request_errors(df, **rules))
    return out.withColumn("valido", F.size("erros") == 0)


def split_valid(df: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """Valid rows and a quarantine table with their errors."""
    v = validate(df, **rules)
    return v.where("valido").drop("erros", "valido"), v.where(~F.col("valido"))


# ------------------------------------------------------------------------- F9
def quality_summary(df: DataFrame) -> DataFrame:
    """rows, columns, duplicate rows beyond the first (NULL = NULL),
    and the share of missing cells (4 decimals) -- one row, one shuffle.

    Group by all columns (identical rows share their null pattern), then
    sum over the groups: rows = sum(n), duplicates = sum(n - 1), missing
    cells = sum(n * nulls per row).  Partial aggregation collapses a hot
    duplicate group before the shuffle.
    """
    cols = df.columns
    row_nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    groups = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
    agg = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total_registros"),
                     F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicados"),
                     F.sum(F.col("__n") * row_nulls).alias("__missing"))
    rate = F.when(F.col("total_registros") > 0,
                  F.round(F.col("__missing") / (F.col("total_registros") * len(cols)), 4)).otherwise(0.0)
    return agg.select(F.col("total_registros").cast("bigint").alias("total_registros"),
                      F.lit(len(cols)).alias("n_colunas"),
                      F.col("n_duplicados").cast("bigint").alias("n_duplicados"),
                      rate.alias("missing_rate"))


# ------------------------------------------------------------------------ F10
def feature_stats(df: DataFrame, features: Sequence[str] = K.QUALITY_FEATURES) -> DataFrame:
    """per feature mean, std (n-1), min, max (2 decimals), missing share
    (4 decimals) and distinct non-null values; all-NULL feature -> zeros.

    Unpivot to (feature, x) and group by feature: partial aggregates before
    the shuffle, the distinct count is keyed on (feature, x).
    """
    feats = [f for f in features if f in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in feats
    ])).alias("s")).select("s.*")
    g = long.groupBy("feature").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), F.avg(F.col("x").isNull().cast("double")).alias("missing"),
        F.count_distinct("x").alias("n_unique"), F.count("x").alias("n"))

    def z(c: str) -> Column:
        return F.when(F.col("n") > 0, F.coalesce(F.round(c, 2), F.lit(0.0))).otherwise(F.lit(0.0))

    return g.select("feature", z("mean").alias("mean"), z("std").alias("std"), z("min").alias("min"),
                    z("max").alias("max"), F.round("missing", 4).alias("missing_pct"), "n_unique")


# ------------------------------------------------------------------------ F11
def rows_per_period(df: DataFrame, time_col: str = K.TIME_COL) -> DataFrame:
    return df.groupBy(time_col).agg(F.count(F.lit(1)).alias("n_registros"))
