"""Panel views over the driver tables (survey section 7.2).

The cohort operators work on a panel ``(entity, period) -> indicators``.
No student data ships with the driver, so the panel is derived from
``orders`` -- one row per customer and order-year -- and the same definition
is written once as a SQL CTE (``PANEL_SQL``) for the DuckDB oracle:

* ``RA``   = ``o_custkey``; ``ano`` = ``year(o_orderdate)``
* ``INDE`` = mean order price / 49 999 (decimal sum, so it is order-free)
* ``IDA``  = max price / 49 999; ``IPS`` = min price / 49 999, NULL for a
  single order; ``IEG`` = least(10, 2 * orders); ``IAA`` = 10 * share of
  status 'F'; ``IAN`` = 10 * share of urgent/high priority
* ``PEDRA_RAW``: level text from INDE cut points, written in one of five
  spellings, with NULL and an unknown level mixed in deterministically.

Everything is a grouped aggregate of ``orders``, so the panel grows with
the table; its size per entity is bounded by the number of years, which
absorbs any hot customer in the partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.tables import read_table

PRICE_SCALE = 49999.0  # coprime with 10: derived means never end on a rounding tie
LEVEL_CUTS = (2.5, 5.0, 7.5)

# Spellings of each level as they appear in raw text (level order).
_SPELLINGS = [
    ["Quartzo", "Ágata", "Ametista", "Topázio"],
    ["QUARTZO", "AGATA", "AMETISTA", "TOPAZIO"],
    ["quartzo", "ágata", "ametista", "topázio"],
    ["Pedra: Quartzo nível 2", "Pedra: Ágata nível 2", "Pedra: Ametista nível 2",
     "Pedra: Topázio nível 2"],
    ["  Quartzo  ", "  Ágata  ", "  Ametista  ", "  Topázio  "],
]
_UNKNOWN_LEVEL = "Diamante"


def _level_idx(inde: Column) -> Column:
    a, b, c = LEVEL_CUTS
    return (F.when(inde < a, 0).when(inde < b, 1).when(inde < c, 2)
            .when(inde.isNotNull(), 3))


def _pedra_raw(ra: Column, ano: Column, inde: Column) -> Column:
    idx = _level_idx(inde)
    form = (ra + ano) % 5
    expr = F.when(((ra + ano) % 11) == 0, F.lit(None).cast("string")) \
            .when(((ra * 7 + ano) % 13) == 0, F.lit(_UNKNOWN_LEVEL))
    for v, names in enumerate(_SPELLINGS):
        for i, name in enumerate(names):
            expr = expr.when((form == v) & (idx == i), F.lit(name))
    return expr


def _sql_pedra_raw() -> str:
    a, b, c = LEVEL_CUTS
    idx = (f"(CASE WHEN INDE < {a} THEN 0 WHEN INDE < {b} THEN 1 "
           f"WHEN INDE < {c} THEN 2 WHEN INDE IS NOT NULL THEN 3 END)")
    parts = ["CASE WHEN (RA + ano) % 11 = 0 THEN NULL",
             f"WHEN (RA * 7 + ano) % 13 = 0 THEN '{_UNKNOWN_LEVEL}'"]
    for v, names in enumerate(_SPELLINGS):
        for i, name in enumerate(names):
            parts.append(f"WHEN (RA + ano) % 5 = {v} AND {idx} = {i} THEN '{name}'")
    return " ".join(parts) + " END"


def period_filter(df: DataFrame, col: str, years) -> Column:
    """``year(col) IN years`` written as date ranges, so Parquet can push it
    down and skip row groups by their min/max statistics."""
    typ = dict(df.dtypes)[col]
    kind = "TIMESTAMP_NTZ" if typ == "timestamp_ntz" else ("DATE" if typ == "date" else "TIMESTAMP")
    cond = None
    for y in sorted(set(int(v) for v in years)):
        c = (F.col(col) >= F.expr(f"{kind}'{y}-01-01'")) & (F.col(col) < F.expr(f"{kind}'{y + 1}-01-01'"))
        cond = c if cond is None else cond | c
    return cond


def panel_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """Sorted distinct order years straight from the scan (bounded list)."""
    o = read_table(spark, sf_dir, "orders")
    return [r[0] for r in o.select(F.year("o_orderdate").alias("y")).where("y IS NOT NULL").distinct()
            .orderBy("y").collect()]


def orders_panel(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Main panel: one row per (customer, order year); ``years`` restricts
    the scan itself (pushed-down date ranges)."""
    o = read_table(spark, sf_dir, "orders")
    if years is not None:
        o = o.where(period_filter(o, "o_orderdate", years))
    n = F.count(F.lit(1))
    price = F.col("o_totalprice")
    agg = (
        o.groupBy(F.col("o_custkey").alias("RA"),
                  F.year("o_orderdate").cast("int").alias("ano"))
        .agg(
            (F.sum(price.cast("decimal(18,2)")).cast("double") / n / F.lit(PRICE_SCALE)).alias("INDE"),
            (F.max(price) / F.lit(PRICE_SCALE)).alias("IDA"),
            F.when(n > 1, F.min(price) / F.lit(PRICE_SCALE)).alias("IPS"),
            F.least(F.lit(10.0), F.lit(2.0) * n).alias("IEG"),
            (F.lit(10.0) * F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)) / n).alias("IAA"),
            (F.lit(10.0) * F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1)
                                 .otherwise(0)) / n).alias("IAN"),
        )
    )
    return agg.withColumn("PEDRA_RAW", _pedra_raw(F.col("RA"), F.col("ano"), F.col("INDE")))


PANEL_SQL = f"""
panel_agg AS (
  SELECT o_custkey AS RA,
         CAST(year(o_orderdate) AS INTEGER) AS ano,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / {PRICE_SCALE} AS INDE,
         max(o_totalprice) / {PRICE_SCALE} AS IDA,
         CASE WHEN count(*) > 1 THEN min(o_totalprice) / {PRICE_SCALE} END AS IPS,
         CAST(least(10, 2 * count(*)) AS DOUBLE) AS IEG,
         CAST(10 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS IAA,
         CAST(10 * sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS DOUBLE)
           / count(*) AS IAN
  FROM orders
  GROUP BY 1, 2
),
panel AS (
  SELECT *, {_sql_pedra_raw()} AS PEDRA_RAW FROM panel_agg
)"""

# Level extraction + code in SQL (same rules as functions.extract_level/encode_level).
LEVEL_SQL = """
CASE WHEN contains(strip_accents(upper(trim(PEDRA_RAW))), 'QUARTZO') THEN 'Quartzo'
     WHEN contains(strip_accents(upper(trim(PEDRA_RAW))), 'AGATA') THEN 'Ágata'
     WHEN contains(strip_accents(upper(trim(PEDRA_RAW))), 'AMETISTA') THEN 'Ametista'
     WHEN contains(strip_accents(upper(trim(PEDRA_RAW))), 'TOPAZIO') THEN 'Topázio' END"""

CODE_SQL = """
CASE PEDRA WHEN 'Quartzo' THEN 0.0 WHEN 'Ágata' THEN 1.0 WHEN 'Ametista' THEN 2.0
           WHEN 'Topázio' THEN 3.0 END"""

# Panel with normalised level columns (PEDRA, PEDRA_CODIGO), raw text dropped.
LEVEL_PANEL_SQL = PANEL_SQL + f""",
panel_lvl0 AS (SELECT * EXCLUDE (PEDRA_RAW), {LEVEL_SQL} AS PEDRA FROM panel),
panel_lvl AS (SELECT *, CAST({CODE_SQL} AS DOUBLE) AS PEDRA_CODIGO FROM panel_lvl0)"""


def level_panel(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Panel after level normalisation (C3): PEDRA + PEDRA_CODIGO."""
    from cohortlens.operators.schema import normalize_level_column
    return normalize_level_column(orders_panel(spark, sf_dir, years), "PEDRA_RAW")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary panel: raw events, entity ``user_id``, ordered by ``ts`` then ``event_id``."""
    return read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


# Scoring requests: the 1995-2001 order years are moved into the scoring
# calendar accepted by validation (2020-2030).
REQUEST_YEAR_OFFSET = 26


def request_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests, one per panel row: current and previous indicators,
    years so far, trend and the raw level text (deltas are not supplied)."""
    from pyspark.sql import Window
    p = orders_panel(spark, sf_dir)
    w = Window.partitionBy("RA").orderBy("ano")
    wa = Window.partitionBy("RA")
    return p.select(
        F.col("RA").cast("string").alias("aluno_id"),
        (F.col("ano") + REQUEST_YEAR_OFFSET).alias("ano"),
        F.col("INDE").alias("inde"), F.col("IEG").alias("ieg"), F.col("IDA").alias("ida"),
        F.col("IPS").alias("ips"), F.col("IAA").alias("iaa"), F.col("IAN").alias("ian"),
        F.lag("INDE").over(w).alias("inde_anterior"), F.lag("IEG").over(w).alias("ieg_anterior"),
        F.lag("IDA").over(w).alias("ida_anterior"),
        F.row_number().over(w).alias("anos_no_programa"),
        F.coalesce(F.regr_slope(F.col("INDE"), F.col("ano").cast("double")).over(wa), F.lit(0.0))
        .alias("tendencia_inde"),
        F.col("PEDRA_RAW").alias("pedra"),
    )


REQUEST_SQL = PANEL_SQL + f""",
req AS (
  SELECT CAST(RA AS VARCHAR) AS aluno_id, ano + {REQUEST_YEAR_OFFSET} AS ano,
         INDE AS inde, IEG AS ieg, IDA AS ida, IPS AS ips, IAA AS iaa, IAN AS ian,
         lag(INDE) OVER w AS inde_anterior, lag(IEG) OVER w AS ieg_anterior,
         lag(IDA) OVER w AS ida_anterior, CAST(row_number() OVER w AS INTEGER) AS anos_no_programa,
         CASE WHEN count(INDE) OVER (PARTITION BY RA) < 2 THEN 0.0
              ELSE coalesce(regr_slope(INDE, CAST(ano AS DOUBLE)) OVER (PARTITION BY RA), 0.0) END
           AS tendencia_inde,
         PEDRA_RAW AS pedra
  FROM panel WINDOW w AS (PARTITION BY RA ORDER BY ano))"""


def named_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level panel with a name column that is only filled in some years
    (customer name when (RA + ano) % 3 = 0), like a name recorded in one
    yearly file only.  Equi-join on the id: its hash partitioning on RA is
    reused by every later window on RA."""
    cust = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("RA"), "c_name")
    p = level_panel(spark, sf_dir).join(cust, "RA", "left")
    return p.withColumn("NOME", F.when((F.col("RA") + F.col("ano")) % 3 == 0, F.col("c_name"))).drop("c_name")


NAMED_PANEL_SQL = LEVEL_PANEL_SQL + """,
panel_named AS (
  SELECT p.*, CASE WHEN (p.RA + p.ano) % 3 = 0 THEN c.c_name END AS NOME
  FROM panel_lvl p LEFT JOIN customer c ON c.c_custkey = p.RA)"""
