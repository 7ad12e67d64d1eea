"""Missing-value handling and request preparation (survey C6, C9-C13, D3, D5).

Imputation is fit/transform like ``pyspark.ml.feature.Imputer``: one
distributed aggregate computes a single row of fill values (one number per
column, so the driver receives a bounded result), then ``fillna`` applies
them as literals inside the scan's codegen stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.sources.tables import nan_to_null

_NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes
            if (t in _NUMERIC_TYPES or t.startswith("decimal")) and c not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value per column (smallest value on ties), fully distributed.

    Unpivot to (column, value), count per pair with map-side combine, then
    keep the max of (count, -value) per column.  No per-column value map is
    ever held by one task.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "coluna string, valor double")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("coluna"), F.col(c).cast("double").alias("valor")) for c in cols
    ])).alias("s")).select("s.*").where(F.col("valor").isNotNull())
    counts = long.groupBy("coluna", "valor").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("coluna").agg(F.max(F.struct("n", (-F.col("valor")).alias("neg"))).alias("m"))
    return best.select("coluna", (-F.col("m.neg")).alias("valor"))


def fill_values(df: DataFrame, cols: Sequence[str], strategy: str) -> dict[str, float]:
    """Fit step: the fill value of each numeric column (None when all-null)."""
    if not cols:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy == "median":
        # Exact median (interpolated, like pandas), all columns in the same
        # few passes -- no per-column buffer of all distinct values.
        from cohortlens.operators.quantiles import exact_medians
        return dict(exact_medians(df, cols))
    if strategy == "approx_median":
        row = df.agg(*[F.percentile_approx(c, 0.5, 100000).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy == "mode":
        return {r["coluna"]: r["valor"] for r in column_modes(df, cols).collect()}
    if strategy == "zero":
        return {c: 0.0 for c in cols}
    raise ValueError(f"unknown strategy {strategy!r}")


def impute(df: DataFrame, strategy: str = "mean", exclude: Sequence[str] = (),
           text_fill: str = K.UNKNOWN_TEXT) -> DataFrame:
    """Numeric NULLs and NaNs <- mean / median / mode / 0; text NULLs <- fixed text."""
    df = nan_to_null(df)
    num = numeric_columns(df, exclude)
    txt = text_columns(df, exclude)
    # Only columns that contain NULLs need a fill value (one bounded aggregate).
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in num + txt]).first() if num + txt else {}
    num = [c for c in num if nulls[c]]
    txt = [c for c in txt if nulls[c]]
    vals = {c: v for c, v in fill_values(df, num, strategy).items() if v is not None}
    exprs: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(v).cast(dict(df.dtypes)[c]))
                                for c, v in vals.items()}
    exprs.update({c: F.coalesce(F.col(c), F.lit(text_fill)) for c in txt})
    return df.withColumns(exprs) if exprs else df


def drop_all_null_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop the columns that are entirely NULL (needs one aggregate action)."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    empty = [c for i, c in enumerate(cols) if row[f"c{i}"] == 0]
    return df.drop(*empty) if empty else df


# ----------------------------------------------------------------- C9 / C10 / C11
def risk_request_features(req: DataFrame, medians: Mapping[str, float] = K.FEATURE_MEDIANS) -> DataFrame:
    """C9 + C10: the 11 classifier features from scoring requests.

    Request columns: inde, ieg, ida, ips, iaa, *_anterior, delta_*,
    anos_no_programa, tendencia_inde, pedras_mudadas_total (all optional but
    inde).  Missing indicators take population medians, missing deltas are
    derived from the previous values when possible, else 0.
    """
    def opt(c: str) -> Column:
        return F.col(c) if c in req.columns else F.lit(None).cast("double")

    feats = {
        "INDE": opt("inde").cast("double"),
        "IEG": F.coalesce(opt("ieg"), F.lit(medians["IEG"])),
        "IDA": F.coalesce(opt("ida"), F.lit(medians["IDA"])),
        "IPS": F.coalesce(opt("ips"), F.lit(medians["IPS"])),
        "IAA": F.coalesce(opt("iaa"), F.lit(medians["IAA"])),
        "delta_INDE": F.coalesce(opt("delta_inde"), opt("inde") - opt("inde_anterior"), F.lit(0.0)),
        "delta_IEG": F.coalesce(opt("delta_ieg"), opt("ieg") - opt("ieg_anterior"), F.lit(0.0)),
        "delta_IDA": F.coalesce(opt("delta_ida"), opt("ida") - opt("ida_anterior"), F.lit(0.0)),
        "anos_no_programa": F.coalesce(opt("anos_no_programa").cast("double"), F.lit(1.0)),
        "tendencia_INDE": F.coalesce(opt("tendencia_inde"), F.lit(0.0)),
        "pedras_mudadas_total": F.coalesce(opt("pedras_mudadas_total"), F.lit(0.0)),
    }
    return req.withColumns({k: v.cast("double") for k, v in feats.items()})


def request_deltas(req: DataFrame) -> DataFrame:
    """C10 alone: given deltas win, else current - previous, else 0."""
    return risk_request_features(req).select(
        *[c for c in ("aluno_id", "ano") if c in req.columns], "delta_INDE", "delta_IEG", "delta_IDA")


def cluster_request_features(req: DataFrame) -> DataFrame:
    """C11: profile features; missing secondary indicators become 0."""
    return req.withColumns({
        "INDE": F.col("inde").cast("double"),
        **{u: F.coalesce(F.col(l_), F.lit(0.0)).cast("double")
           for u, l_ in (("IEG", "ieg"), ("IDA", "ida"), ("IPS", "ips"), ("IAA", "iaa"))},
    })


def report_defaults(df: DataFrame) -> DataFrame:
    """Defaults for report fields."""
    def opt(c: str, typ: str = "double") -> Column:
        return F.col(c) if c in df.columns else F.lit(None).cast(typ)

    zero = F.lit(0.0)
    return df.withColumns({
        "idade": F.coalesce(opt("idade", "int"), F.lit(0)),
        **{c: F.coalesce(opt(c), zero) for c in ("ieg", "ida", "ips", "iaa", "ian", "ipv", "ipp")},
        "anos_no_programa": F.coalesce(opt("anos_no_programa", "int"), F.lit(1)),
        "tendencia_inde": F.coalesce(opt("tendencia_inde", "string"), F.lit(K.TREND_LABELS[2])),
        "cluster_nome": F.coalesce(opt("cluster_nome", "string"), F.lit("Não identificado")),
        "risco_percentual": F.coalesce(opt("risco_percentual"), zero).cast("int"),
        "risco_classe": F.coalesce(opt("risco_classe", "string"), F.lit("N/A")),
        "feedback_texto": F.coalesce(opt("feedback_texto", "string"), F.lit("Não disponível")),
    })
