"""Projection and schema alignment (survey section 2.B, plus C3/C5).

Column-name work happens on the driver over schema metadata only; data
work is plain ``select`` / ``unionByName`` so Catalyst prunes and fuses it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import constants as K
from cohortlens.functions.scalars import clean_numeric, encode_level, extract_level

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def clean_name(name: str) -> str:
    name = str(name).strip().upper()
    return name.translate(str.maketrans(K.COLUMN_ACCENTS_FROM, K.COLUMN_ACCENTS_TO))


def clean_column_names(df: DataFrame) -> DataFrame:
    """B1: strip, upper-case, fold a fixed set of accents in column names.

    Positional ``toDF`` so duplicate names produced here never hit an
    ambiguous by-name reference.
    """
    return df.toDF(*[clean_name(c) for c in df.columns])


def apply_column_mapping(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename the mapped columns that exist; unknown keys are ignored.

    Positional as well, so it is safe in the presence of duplicate names.
    """
    mapping = K.COLUMN_MAP if mapping is None else mapping
    return df.toDF(*[mapping.get(c, c) for c in df.columns])


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first occurrence of each column name."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    tmp = [f"__c{i}" for i in range(len(names))]
    seen: dict[str, str] = {}
    for t, n in zip(tmp, names):
        seen.setdefault(n, t)
    return df.toDF(*tmp).select(*[F.col(t).alias(n) for n, t in seen.items()])


def add_year_column(df: DataFrame, year: int, time_col: str = K.TIME_COL) -> DataFrame:
    """B5."""
    return df.withColumn(time_col, F.lit(int(year)).cast("int"))


def year_column_map(year: int) -> dict[str, str]:
    """Per-year renames: the fixed map when the year has one, else the same rule
    (``INDE <yy>`` / ``INDE <yyyy>`` -> INDE, ``PEDRA ...`` -> PEDRA)."""
    if year in K.COLUMN_MAP_PER_YEAR:
        return dict(K.COLUMN_MAP_PER_YEAR[year])
    out = {}
    for suffix in (f"{year % 100:02d}", str(year)):
        out[f"INDE {suffix}"] = "INDE"
        out[f"PEDRA {suffix}"] = "PEDRA"
    return out


def coerce_numeric_text(df: DataFrame, candidates: Sequence[str] = K.NUMERIC_CANDIDATES) -> DataFrame:
    """Decimal-comma text -> double for candidate columns that are text."""
    types = dict(df.dtypes)
    todo = {c: clean_numeric(c) for c in candidates if types.get(c) == "string"}
    return df.withColumns(todo) if todo else df


def harmonize_year(df: DataFrame, year: int, mapping: Mapping[str, str] | None = None,
                   time_col: str = K.TIME_COL) -> DataFrame:
    """B1 -> B2 -> B3 -> B4 -> C5 -> B5."""
    out = clean_column_names(df)
    out = apply_column_mapping(out)
    out = apply_column_mapping(out, year_column_map(year) if mapping is None else mapping)
    out = drop_duplicate_columns(out)
    out = coerce_numeric_text(out)
    return add_year_column(out, year, time_col)


def _unify_types(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Give each column one type across frames: widest number, else string."""
    kinds: dict[str, set] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(type(f.dataType))
    target: dict[str, str] = {}
    for name, ks in kinds.items():
        ks.discard(T.NullType)  # a column without values takes the type the others give it
        if len(ks) <= 1:
            continue
        if all(issubclass(k, _NUMERIC) for k in ks):
            frac = any(issubclass(k, (T.FloatType, T.DoubleType, T.DecimalType)) for k in ks)
            target[name] = "double" if frac else "bigint"
        else:
            target[name] = "string"
    if not target:
        return list(frames)
    return [df.withColumns({c: F.col(c).cast(t) for c, t in target.items() if c in df.columns})
            for df in frames]


def harmonize(tables: Mapping[int, DataFrame], time_col: str = K.TIME_COL) -> DataFrame:
    """Harmonise each year and union by name; missing columns NULL."""
    if not tables:
        raise ValueError("at least one yearly table is required")
    frames = [harmonize_year(df, y, time_col=time_col) for y, df in sorted(tables.items())]
    frames = _unify_types(frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_features_only(df: DataFrame, id_col: str = K.ID_COL, time_col: str = K.TIME_COL) -> DataFrame:
    """B8."""
    keep = [c for c in [id_col, time_col, *K.COMMON_FEATURES] if c in df.columns]
    return df.select(*keep)


def listing_projection(df: DataFrame, mapping: Mapping[str, str] = K.LISTING_COLUMNS) -> DataFrame:
    """Select and rename the listed columns that exist, in listed order."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items() if src in df.columns])


def normalize_level_column(df: DataFrame, level_col: str = "PEDRA") -> DataFrame:
    """Canonical level (PEDRA) and its code (PEDRA_CODIGO); the source
    column is dropped when it has another name.  Absent column: unchanged."""
    if level_col not in df.columns:
        return df
    out = df.withColumn("PEDRA", extract_level(level_col))
    out = out.withColumn("PEDRA_CODIGO", encode_level("PEDRA"))
    return out.drop(level_col) if level_col != "PEDRA" else out


# ------------------------------------------------------------- B10 - B12, F12
def clean_numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C4 on a frame: listed columns that exist become doubles; others ignored."""
    todo = {c: clean_numeric(c) for c in columns if c in df.columns}
    return df.withColumns(todo) if todo else df


def _empty_matrix(time_col: str) -> DataFrame:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([], f"{time_col} int, coluna string, presente boolean, n_nao_nulos bigint")


def schema_matrix(tables: Mapping[int, DataFrame], time_col: str = K.TIME_COL) -> DataFrame:
    """One row per (column, year): declared in that year and its non-null count.

    One aggregate scan per yearly table; the per-year rows are unpivoted and
    unioned, so the result has (#columns x #years) rows.  No tables -> empty.
    """
    if not tables:
        return _empty_matrix(time_col)
    parts = []
    all_cols = sorted({c for df in tables.values() for c in df.columns})
    for year, df in sorted(tables.items()):
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
        idx = {c: i for i, c in enumerate(df.columns)}
        stack = F.explode(F.array(*[
            F.struct(F.lit(c).alias("coluna"),
                     F.lit(c in idx).alias("presente"),
                     (F.col(f"c{idx[c]}") if c in idx else F.lit(0)).cast("bigint").alias("n_nao_nulos"))
            for c in all_cols]))
        parts.append(counts.select(F.lit(int(year)).cast("int").alias(time_col), stack.alias("s"))
                     .select(time_col, "s.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def common_columns(tables: Mapping[int, DataFrame], time_col: str = K.TIME_COL) -> DataFrame:
    """Columns declared in every year."""
    m = schema_matrix(tables, time_col)
    n = len(tables)
    return (m.where("presente").groupBy("coluna").agg(F.count(F.lit(1)).alias("n_anos"))
            .where(F.col("n_anos") == n).select("coluna"))


def unique_columns(tables: Mapping[int, DataFrame], time_col: str = K.TIME_COL) -> DataFrame:
    """(year, column) for columns declared in exactly one year."""
    m = schema_matrix(tables, time_col).where("presente")
    once = m.groupBy("coluna").agg(F.count(F.lit(1)).alias("n_anos"),
                                   F.min(time_col).alias(time_col)).where("n_anos = 1")
    return once.select(time_col, "coluna")


def profile_table(df: DataFrame, id_col: str = K.ID_COL) -> DataFrame:
    """per column -- type, null count and %, rows, columns, distinct ids.

    One aggregate pass computes every column's null count (plus the distinct
    id count) and the single result row is unpivoted.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"__m{i}") for i, c in enumerate(cols)]
    has_id = id_col in cols
    if has_id:
        aggs.append(F.count_distinct(F.col(id_col)).alias("__ids"))
    one = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("coluna"), F.lit(dtypes[c]).alias("tipo"),
                 F.col(f"__m{i}").alias("n_nulos")) for i, c in enumerate(cols)]))
    out = one.select("__n", *(["__ids"] if has_id else []), rows.alias("r")).select(
        F.col("r.coluna").alias("coluna"), F.col("r.tipo").alias("tipo"),
        F.col("r.n_nulos").alias("n_nulos"),
        F.round(F.col("r.n_nulos") * 100.0 / F.col("__n"), 6).alias("pct_nulos"),
        F.col("__n").alias("n_linhas"), F.lit(len(cols)).alias("n_colunas"),
        (F.col("__ids") if has_id else F.lit(None).cast("bigint")).alias("n_ids_unicos"))
    return out
