"""Raw yearly tables derived from the panel (inputs of the B-operators).

Each order year becomes one "yearly file" with the quirks the harmonisation
has to undo: a two-digit suffix on the first year's index/level columns and
a four-digit one later, the index as decimal-comma text, an indicator that
is text in odd years, names under two different headers, first-year-only
columns, a second-year-only accented header, and in the last year a
duplicate header that collides after cleaning (kept: the first).

The panel is written once partitioned by year, so each "file" is one
partition folder; the list of years is a bounded driver-side list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.drift import years_of
from cohortlens.plans.panel import PANEL_SQL, orders_panel

TURMAS = ["A", "B", "C"]


def year_suffix(year: int, first: bool) -> str:
    return f"{year % 100:02d}" if first else str(year)


def comma_text(c) -> F.Column:
    return F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))


def raw_year_tables(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    """One DataFrame per year.  The panel is aggregated once and written
    partitioned by year to the shared checkpoint folder; each yearly table
    is then a partition-pruned read (one folder), not a new aggregation."""
    from cohortlens.session import materialize
    p = materialize(orders_panel(spark, sf_dir), "panel_by_year", partition_by="ano")
    years = years_of(p)
    out: dict[int, DataFrame] = {}
    for i, y in enumerate(years):
        d = p.where(F.col("ano") == y)
        first = i == 0
        sfx = year_suffix(y, first)
        name = F.concat(F.lit("Aluno-"), F.col("RA").cast("string"))
        cols = [F.col("RA")]
        if first:
            cols += [name.alias("Nome"), ((F.col("RA") % 8) + 1).cast("int").alias("Fase"),
                     F.element_at(F.array(*[F.lit(t) for t in TURMAS]), (F.col("RA") % 3 + 1).cast("int")).alias("Turma")]
        else:
            cols += [name.alias("Nome Anonimizado")]
        cols += [comma_text("INDE").alias(f"INDE {sfx}"), F.col("PEDRA_RAW").alias(f"Pedra {sfx}"),
                 F.col("IEG"), (comma_text("IDA") if y % 2 else F.col("IDA")).alias("IDA"),
                 F.col("IPS"), F.col("IAA"), F.col("IAN")]
        if i == 1:
            cols.append(F.concat(F.lit("Escola "), (F.col("RA") % 7).cast("string")).alias("Instituição de Ensino"))
        if i == len(years) - 1 and len(years) > 1:
            cols.append(F.lit(None).cast("double").alias("ieg "))
        out[y] = d.select(*cols)
    return out


# Same tables in SQL: year markers for the oracle.
YEARS_SQL = PANEL_SQL + """,
yrs AS (SELECT min(ano) AS y0, max(ano) AS yn FROM panel),
y1t AS (SELECT min(ano) AS y1 FROM panel WHERE ano > (SELECT y0 FROM yrs)),
py AS (SELECT p.*, y.y0, y.yn, t.y1 FROM panel p, yrs y, y1t t)"""

SFX_SQL = ("CASE WHEN ano = y0 THEN lpad(CAST(ano % 100 AS VARCHAR), 2, '0') ELSE CAST(ano AS VARCHAR) END")

# (column name SQL, non-null SQL, year condition) for every raw column.
RAW_COLUMNS_SQL = [
    ("'RA'", "RA IS NOT NULL", "TRUE"),
    ("'Nome'", "TRUE", "ano = y0"),
    ("'Fase'", "TRUE", "ano = y0"),
    ("'Turma'", "TRUE", "ano = y0"),
    ("'Nome Anonimizado'", "TRUE", "ano <> y0"),
    (f"'INDE ' || {SFX_SQL}", "INDE IS NOT NULL", "TRUE"),
    (f"'Pedra ' || {SFX_SQL}", "PEDRA_RAW IS NOT NULL", "TRUE"),
    ("'IEG'", "IEG IS NOT NULL", "TRUE"),
    ("'IDA'", "IDA IS NOT NULL", "TRUE"),
    ("'IPS'", "IPS IS NOT NULL", "TRUE"),
    ("'IAA'", "IAA IS NOT NULL", "TRUE"),
    ("'IAN'", "IAN IS NOT NULL", "TRUE"),
    ("'Instituição de Ensino'", "TRUE", "ano = y1"),
    ("'ieg '", "FALSE", "ano = yn AND y0 <> yn"),
]


def write_year_csvs(tables: dict[int, DataFrame], base: str, sep: str = ";") -> dict[int, str]:
    """Write each yearly table as a header CSV folder (text kept verbatim)."""
    paths = {}
    for y, df in tables.items():
        path = f"{base.rstrip('/')}/ano={y}.csv"
        (df.write.mode("overwrite").option("header", True).option("sep", sep)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))
        paths[y] = path
    return paths
