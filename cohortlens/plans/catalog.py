"""Registered queries: Spark callables and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  ``ORACLE`` holds, for the SQL-expressible ones, the
same computation as DuckDB SQL over the pre-registered views.  Float
aggregates (avg, stddev, regression) are rounded to 9 decimals on both
sides because their summation order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions import scalars as S
from cohortlens.operators import aggregates as A
from cohortlens.operators import cleaning as CL
from cohortlens.operators import drift as D
from cohortlens.operators import metrics as M
from cohortlens.operators import quality as Q
from cohortlens.operators import temporal as G
from cohortlens.plans.panel import (LEVEL_PANEL_SQL, LEVEL_SQL, NAMED_PANEL_SQL, PANEL_SQL, REQUEST_SQL,
                                    level_panel, named_panel, orders_panel, panel_years, request_view)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r9(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def r6(c) -> F.Column:
    """Regression slopes and z-scores: irrational-like values (no exact ties),
    rounded coarser so engine-specific float algorithms agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


W_SQL = "WINDOW w AS (PARTITION BY RA ORDER BY ano), " \
        "wr AS (PARTITION BY RA ORDER BY ano ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

TREND_SQL = ("CASE WHEN count(INDE) OVER (PARTITION BY RA) < 2 THEN 0.0 "
             "ELSE coalesce(regr_slope(INDE, CAST(ano AS DOUBLE)) OVER (PARTITION BY RA), 0.0) END")
TREND_ASOF_SQL = ("CASE WHEN count(INDE) OVER wr < 2 THEN 0.0 "
                  "ELSE coalesce(regr_slope(INDE, CAST(ano AS DOUBLE)) OVER wr, 0.0) END")

# ============================================================ 1. temporal


@register("deltas", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, INDE - lag(INDE) OVER w AS delta_INDE, IEG - lag(IEG) OVER w AS delta_IEG,
       IDA - lag(IDA) OVER w AS delta_IDA
FROM panel_lvl {W_SQL}""")
def q_deltas(spark, sf):
    return G.deltas(level_panel(spark, sf), G.DELTA_FEATURES).select(
        "RA", "ano", "delta_INDE", "delta_IEG", "delta_IDA")


@register("trend_slope", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, round({TREND_SQL}, 6) + 0.0 AS tendencia_INDE FROM panel_lvl {W_SQL}""")
def q_trend(spark, sf):
    return G.trend_slope(level_panel(spark, sf)).select("RA", "ano", r6("tendencia_INDE").alias("tendencia_INDE"))


@register("trend_slope_asof", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, round({TREND_ASOF_SQL}, 6) + 0.0 AS tendencia_INDE_asof FROM panel_lvl {W_SQL}""")
def q_trend_asof(spark, sf):
    return G.trend_slope(level_panel(spark, sf), as_of=True).select(
        "RA", "ano", r6("tendencia_INDE_asof").alias("tendencia_INDE_asof"))


@register("years_in_program", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, CAST(row_number() OVER w AS INTEGER) AS anos_no_programa FROM panel_lvl {W_SQL}""")
def q_years(spark, sf):
    return G.years_in_program(level_panel(spark, sf)).select("RA", "ano", "anos_no_programa")


LEVEL_CHANGE_SQL = "coalesce(abs(PEDRA_CODIGO - lag(PEDRA_CODIGO) OVER w), 0.0)"


@register("level_changes", f"""WITH {LEVEL_PANEL_SQL},
s AS (SELECT RA, ano, {LEVEL_CHANGE_SQL} AS pedras_mudadas FROM panel_lvl {W_SQL})
SELECT RA, ano, pedras_mudadas, sum(pedras_mudadas) OVER wr AS pedras_mudadas_total FROM s {W_SQL}""")
def q_level_changes(spark, sf):
    return G.level_changes(level_panel(spark, sf)).select("RA", "ano", "pedras_mudadas", "pedras_mudadas_total")


@register("new_entities", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, count(*) OVER (PARTITION BY RA) = 1 AS ingressante FROM panel_lvl""")
def q_new(spark, sf):
    return G.new_entities(level_panel(spark, sf)).select("RA", "ano", "ingressante")


def _hist_sql(features=G.HIST_FEATURES) -> str:
    parts = []
    for f in features:
        parts += [f"round(avg({f}) OVER wr, 9) AS {f}_media_hist",
                  f"min({f}) OVER wr AS {f}_min_hist", f"max({f}) OVER wr AS {f}_max_hist"]
    return ", ".join(parts)


def _hist_cols(features=G.HIST_FEATURES) -> list:
    out = []
    for f in features:
        out += [r9(f"{f}_media_hist").alias(f"{f}_media_hist"), f"{f}_min_hist", f"{f}_max_hist"]
    return out


@register("history_stats", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, {_hist_sql()} FROM panel_lvl {W_SQL}""")
def q_history(spark, sf):
    return G.history_stats(level_panel(spark, sf)).select("RA", "ano", *_hist_cols())


TEMPORAL_SQL = f"""WITH {LEVEL_PANEL_SQL},
t1 AS (
  SELECT *, INDE - lag(INDE) OVER w AS delta_INDE, IEG - lag(IEG) OVER w AS delta_IEG,
         IDA - lag(IDA) OVER w AS delta_IDA, {TREND_SQL} AS tendencia_INDE,
         CAST(row_number() OVER w AS INTEGER) AS anos_no_programa,
         {LEVEL_CHANGE_SQL} AS pedras_mudadas,
         count(*) OVER (PARTITION BY RA) = 1 AS ingressante, {_hist_sql()}
  FROM panel_lvl {W_SQL}),
t AS (SELECT *, sum(pedras_mudadas) OVER wr AS pedras_mudadas_total FROM t1 {W_SQL})"""

TEMPORAL_OUT = ("RA, ano, INDE, IDA, IPS, IEG, IAA, IAN, PEDRA, PEDRA_CODIGO, delta_INDE, delta_IEG, "
                "delta_IDA, round(tendencia_INDE, 6) + 0.0 AS tendencia_INDE, anos_no_programa, pedras_mudadas, "
                "pedras_mudadas_total, ingressante, "
                + ", ".join(f"{f}_media_hist, {f}_min_hist, {f}_max_hist" for f in G.HIST_FEATURES))


def temporal_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Level-normalised panel with every temporal feature."""
    return G.temporal_features(level_panel(spark, sf))


def _temporal_select(df: DataFrame) -> DataFrame:
    cols = ["RA", "ano", "INDE", "IDA", "IPS", "IEG", "IAA", "IAN", "PEDRA", "PEDRA_CODIGO",
            "delta_INDE", "delta_IEG", "delta_IDA", r6("tendencia_INDE").alias("tendencia_INDE"),
            "anos_no_programa", "pedras_mudadas", "pedras_mudadas_total", "ingressante"]
    return df.select(*cols, *_hist_cols())


@register("temporal_features", f"{TEMPORAL_SQL}\nSELECT {TEMPORAL_OUT} FROM t")
def q_temporal(spark, sf):
    return _temporal_select(temporal_panel(spark, sf))


@register("drop_target", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, CAST(lead(PEDRA_CODIGO) OVER w < PEDRA_CODIGO AS DOUBLE) AS {K.TARGET_COL}
FROM panel_lvl {W_SQL}""")
def q_target(spark, sf):
    return G.drop_target(level_panel(spark, sf)).select("RA", "ano", K.TARGET_COL)


# ============================================================ 2. scalar functions


@register("extract_level", f"""WITH {PANEL_SQL}
SELECT RA, ano, PEDRA_RAW, {LEVEL_SQL} AS PEDRA FROM panel""")
def q_extract_level(spark, sf):
    return orders_panel(spark, sf).select("RA", "ano", "PEDRA_RAW", S.extract_level("PEDRA_RAW").alias("PEDRA"))


@register("encode_level", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, PEDRA, PEDRA_CODIGO FROM panel_lvl""")
def q_encode_level(spark, sf):
    return level_panel(spark, sf).select("RA", "ano", "PEDRA", "PEDRA_CODIGO")


def _numeric_text(df):
    txt = F.replace(F.col("INDE").cast("string"), F.lit("."), F.lit(","))
    junk = (F.col("RA") + F.col("ano")) % 7
    return df.withColumn("INDE_TXT", F.when(junk == 0, F.lit("abc")).when(junk == 1, F.concat(F.lit(" "), txt, F.lit(" ")))
                         .otherwise(txt))


@register("clean_numeric", f"""WITH {PANEL_SQL},
t AS (SELECT RA, ano, CASE WHEN (RA + ano) % 7 = 0 THEN 'abc'
                           WHEN (RA + ano) % 7 = 1 THEN ' ' || replace(CAST(INDE AS VARCHAR), '.', ',') || ' '
                           ELSE replace(CAST(INDE AS VARCHAR), '.', ',') END AS INDE_TXT FROM panel)
SELECT RA, ano, TRY_CAST(replace(trim(INDE_TXT), ',', '.') AS DOUBLE) AS INDE FROM t""")
def q_clean_numeric(spark, sf):
    return _numeric_text(orders_panel(spark, sf)).select("RA", "ano", S.clean_numeric("INDE_TXT").alias("INDE"))


def _impute_query(strategy):
    def q(spark, sf):
        out = CL.impute(level_panel(spark, sf), strategy, exclude=("RA", "ano"))
        return out.select("RA", "ano", r9("IPS").alias("IPS"), r9("PEDRA_CODIGO").alias("PEDRA_CODIGO"), "PEDRA")
    return q


def _impute_sql(fill_ips: str, fill_code: str) -> str:
    return f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, round(coalesce(IPS, ({fill_ips})), 9) AS IPS,
       round(coalesce(PEDRA_CODIGO, ({fill_code})), 9) AS PEDRA_CODIGO,
       coalesce(PEDRA, '{K.UNKNOWN_TEXT}') AS PEDRA
FROM panel_lvl"""


def _mode_sql(c: str) -> str:
    return (f"SELECT x FROM (SELECT {c} AS x, count(*) AS n FROM panel_lvl WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, x ASC LIMIT 1")


register("impute_mean", _impute_sql("SELECT avg(IPS) FROM panel_lvl", "SELECT avg(PEDRA_CODIGO) FROM panel_lvl"))(
    _impute_query("mean"))
register("impute_median", _impute_sql("SELECT median(IPS) FROM panel_lvl",
                                      "SELECT median(PEDRA_CODIGO) FROM panel_lvl"))(_impute_query("median"))
register("impute_zero", _impute_sql("0.0", "0.0"))(_impute_query("zero"))
register("impute_mode", _impute_sql(_mode_sql("IPS"), _mode_sql("PEDRA_CODIGO")))(_impute_query("mode"))


@register("risk_tier", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, IAA / 10 AS p,
       CASE WHEN IAA / 10 >= {K.RISK_THRESHOLD_HIGH} THEN 'ALTO' WHEN IAA / 10 >= {K.RISK_THRESHOLD_MEDIUM} THEN 'MEDIO'
            WHEN IAA IS NOT NULL THEN 'BAIXO' END AS risco_classe
FROM panel_lvl""")
def q_risk_tier(spark, sf):
    p = level_panel(spark, sf).select("RA", "ano", (F.col("IAA") / 10).alias("p"))
    return p.withColumn("risco_classe", S.risk_tier("p"))


@register("trend_label", f"""{TEMPORAL_SQL}
SELECT RA, ano, CASE WHEN coalesce(tendencia_INDE, 0) > {K.TREND_THRESHOLD} THEN 'crescendo'
                     WHEN coalesce(tendencia_INDE, 0) < -{K.TREND_THRESHOLD} THEN 'decrescendo'
                     ELSE 'estável' END AS tendencia
FROM t""")
def q_trend_label(spark, sf):
    return temporal_panel(spark, sf).select("RA", "ano", S.trend_label("tendencia_INDE").alias("tendencia"))


_M = K.FEATURE_MEDIANS
COLD_START_SQL = f"""WITH {REQUEST_SQL}
SELECT aluno_id, ano, inde AS INDE, coalesce(ieg, {_M['IEG']}) AS IEG, coalesce(ida, {_M['IDA']}) AS IDA,
       coalesce(ips, {_M['IPS']}) AS IPS, coalesce(iaa, {_M['IAA']}) AS IAA,
       coalesce(inde - inde_anterior, 0.0) AS delta_INDE, coalesce(ieg - ieg_anterior, 0.0) AS delta_IEG,
       coalesce(ida - ida_anterior, 0.0) AS delta_IDA, CAST(coalesce(anos_no_programa, 1) AS DOUBLE) AS anos_no_programa,
       round(coalesce(tendencia_inde, 0.0), 6) + 0.0 AS tendencia_INDE, CAST(0.0 AS DOUBLE) AS pedras_mudadas_total
FROM req"""


@register("cold_start", COLD_START_SQL)
def q_cold_start(spark, sf):
    f = CL.risk_request_features(request_view(spark, sf))
    return f.select("aluno_id", "ano", *[r6(c).alias(c) if c == "tendencia_INDE" else c for c in K.RISK_FEATURES])


@register("request_deltas", f"""WITH {REQUEST_SQL}
SELECT aluno_id, ano, coalesce(inde - inde_anterior, 0.0) AS delta_INDE,
       coalesce(ieg - ieg_anterior, 0.0) AS delta_IEG, coalesce(ida - ida_anterior, 0.0) AS delta_IDA
FROM req""")
def q_request_deltas(spark, sf):
    return CL.request_deltas(request_view(spark, sf))


def _validate_sql() -> str:
    rng = lambda c: f"CASE WHEN NOT ({c} BETWEEN 0.0 AND 10.0) THEN '{c}:intervalo' END"
    names = ", ".join(f"'{n}'" for n in K.LEVEL_NAMES)
    parts = ["CASE WHEN aluno_id IS NULL OR length(aluno_id) < 1 THEN 'aluno_id:obrigatorio' END",
             "CASE WHEN ano IS NULL THEN 'ano:obrigatorio' END",
             "CASE WHEN NOT (ano BETWEEN 2020 AND 2030) THEN 'ano:intervalo' END",
             "CASE WHEN inde IS NULL THEN 'inde:obrigatorio' END", rng("inde")]
    parts += [rng(c) for c in ("ieg", "ida", "ips", "iaa", "ian", "inde_anterior", "ieg_anterior", "ida_anterior")]
    parts += ["CASE WHEN anos_no_programa < 1 THEN 'anos_no_programa:minimo' END",
              f"CASE WHEN NOT (pedra IN ({names})) THEN 'pedra:dominio' END"]
    return f"""WITH {REQUEST_SQL},
v AS (SELECT aluno_id, ano, concat_ws(';', {', '.join(parts)}) AS erros FROM req)
SELECT aluno_id, ano, erros, erros = '' AS valido FROM v"""


@register("validate_rows", _validate_sql())
def q_validate(spark, sf):
    v = Q.validate(request_view(spark, sf))
    return v.select("aluno_id", "ano", F.array_join("erros", ";").alias("erros"), "valido")


@register("request_profile_features", f"""WITH {REQUEST_SQL}
SELECT aluno_id, ano, inde AS INDE, {", ".join(f"coalesce({c.lower()}, 0.0) AS {c}" for c in ("IEG", "IDA", "IPS", "IAA"))} FROM req""")
def q_request_profile_features(spark, sf):
    """C11."""
    return CL.cluster_request_features(request_view(spark, sf)).select("aluno_id", "ano", "INDE", "IEG", "IDA", "IPS", "IAA")


@register("safe_numbers", """SELECT o_orderkey, coalesce(TRY_CAST(o_orderpriority AS DOUBLE), 0.0) AS texto,
  coalesce(TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE), -1.0) AS prioridade,
  CASE WHEN o_orderkey % 7 = 0 THEN 2.5 ELSE coalesce(o_totalprice, 2.5) END AS preco FROM orders""")
def q_safe_numbers(spark, sf):
    """Numbers out of texts and columns with holes, a default for the rest."""
    from cohortlens.sources.tables import read_table
    o = read_table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan")))
    return o.select("o_orderkey", S.safe_float("o_orderpriority").alias("texto"),
                    S.safe_float(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), -1.0).alias("prioridade"), S.safe_float(price, 2.5).alias("preco"))


@register("drop_empty_columns", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, INDE, CASE WHEN RA = (SELECT min(RA) FROM panel_lvl) THEN INDE END AS QUASE FROM panel_lvl""")
def q_drop_empty_columns(spark, sf):
    """A column without any value goes, one with a single entity's values stays."""
    p = level_panel(spark, sf)
    least = p.agg(F.min("RA")).scalar()
    holes = p.withColumn("__m", least).select("RA", "ano", "INDE", F.lit(None).cast("double").alias("VAZIA"), F.when(F.col("RA") < 0, F.col("INDE")).alias("NUNCA"),
                                              F.when(F.col("RA") == F.col("__m"), F.col("INDE")).alias("QUASE"))
    return CL.drop_all_null_columns(holes)


# ============================================================ 4. dashboard / quality aggregates

LATEST_COLS = ["INDE", "IDA", "IPS", "IEG", "IAA", "IAN", "PEDRA", "PEDRA_CODIGO"]


@register("latest_nonnull", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, max(ano) AS ano, {", ".join(f"arg_max({c}, ano) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in LATEST_COLS)}
FROM panel_lvl GROUP BY RA""")
def q_latest_nonnull(spark, sf):
    return A.latest_nonnull(level_panel(spark, sf).select("RA", "ano", *LATEST_COLS))


@register("latest_row", f"""WITH {LEVEL_PANEL_SQL}
SELECT * FROM panel_lvl QUALIFY row_number() OVER (PARTITION BY RA ORDER BY ano DESC) = 1""")
def q_latest_row(spark, sf):
    return A.latest_row(level_panel(spark, sf))


@register("level_distribution", f"""WITH {LEVEL_PANEL_SQL},
l AS (SELECT RA, arg_max(PEDRA, ano) FILTER (WHERE PEDRA IS NOT NULL) AS PEDRA FROM panel_lvl GROUP BY RA)
SELECT PEDRA, count(*) AS n FROM l WHERE PEDRA IS NOT NULL GROUP BY PEDRA""")
def q_level_distribution(spark, sf):
    latest = A.latest_nonnull(level_panel(spark, sf).select("RA", "ano", "PEDRA"))
    return A.value_distribution(latest, "PEDRA")


@register("index_by_year", f"""WITH {LEVEL_PANEL_SQL}
SELECT ano, round(avg(INDE), 2) AS inde_medio FROM panel_lvl WHERE INDE IS NOT NULL GROUP BY ano""")
def q_index_by_year(spark, sf):
    return A.mean_by_period(level_panel(spark, sf), "INDE")


@register("dashboard_kpis", f"""WITH {LEVEL_PANEL_SQL},
l AS (SELECT RA, arg_max(INDE, ano) FILTER (WHERE INDE IS NOT NULL) AS INDE FROM panel_lvl GROUP BY RA)
SELECT (SELECT count(*) FROM l) AS total_alunos, (SELECT round(avg(INDE), 2) FROM l) AS inde_medio,
       (SELECT string_agg(CAST(ano AS VARCHAR), ',' ORDER BY CAST(ano AS VARCHAR))
          FROM (SELECT DISTINCT ano FROM panel_lvl)) AS anos_disponiveis,
       (SELECT count(DISTINCT ano) FROM panel_lvl) AS n_anos""")
def q_dashboard(spark, sf):
    return A.dashboard_kpis(level_panel(spark, sf))


def _temporal_all_cols() -> list[str]:
    return ["RA", "ano", "INDE", "IDA", "IPS", "IEG", "IAA", "IAN", "PEDRA", "PEDRA_CODIGO", "delta_INDE",
            "delta_IEG", "delta_IDA", "tendencia_INDE", "anos_no_programa", "pedras_mudadas", "ingressante",
            *[f"{f}_{s}_hist" for f in G.HIST_FEATURES for s in ("media", "min", "max")],
            "pedras_mudadas_total"]


@register("quality_summary", f"""{TEMPORAL_SQL},
g AS (SELECT count(*) AS n, {" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _temporal_all_cols())} AS nn
      FROM t GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_registros, {len(_temporal_all_cols())} AS n_colunas,
       CAST(sum(n - 1) AS BIGINT) AS n_duplicados,
       round(sum(n * nn) / (sum(n) * {len(_temporal_all_cols())}), 4) AS missing_rate
FROM (SELECT {", ".join(_temporal_all_cols())}, count(*) AS n,
             {" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _temporal_all_cols())} AS nn
      FROM t GROUP BY {", ".join(_temporal_all_cols())})""")
def q_quality(spark, sf):
    return Q.quality_summary(temporal_panel(spark, sf).select(*_temporal_all_cols()))


def _feature_stats_sql() -> str:
    feats = [f for f in K.QUALITY_FEATURES if f in ("INDE", "IEG", "IDA", "IPS", "IAA", "IAN")]
    unions = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM panel_lvl" for f in feats)
    return f"""WITH {LEVEL_PANEL_SQL}, l AS ({unions})
SELECT feature, coalesce(round(avg(x), 2), 0.0) AS mean, coalesce(round(stddev_samp(x), 2), 0.0) AS std,
       coalesce(round(min(x), 2), 0.0) AS min, coalesce(round(max(x), 2), 0.0) AS max,
       round(avg(CAST(x IS NULL AS DOUBLE)), 4) AS missing_pct, count(DISTINCT x) AS n_unique
FROM l GROUP BY feature"""


@register("feature_stats", _feature_stats_sql())
def q_feature_stats(spark, sf):
    return Q.feature_stats(level_panel(spark, sf))


@register("rows_per_year", f"""WITH {LEVEL_PANEL_SQL}
SELECT ano, count(*) AS n_registros FROM panel_lvl GROUP BY ano""")
def q_rows_per_year(spark, sf):
    return Q.rows_per_period(level_panel(spark, sf))


@register("name_propagation", f"""WITH {NAMED_PANEL_SQL}
SELECT RA, ano, first(NOME IGNORE NULLS) OVER (PARTITION BY RA ORDER BY ano
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS NOME
FROM panel_named""")
def q_name_propagation(spark, sf):
    return A.propagate_first_name(named_panel(spark, sf)).select("RA", "ano", "NOME")


LISTING_OUT = ["ra", "nome", "ano", "inde", "ieg", "ida", "ips", "iaa", "ian", "pedra", "tendencia_inde",
               "pedras_mudadas_total", "anos_no_programa", "delta_inde", "delta_ieg", "delta_ida"]


def entity_listing(spark: SparkSession, sf: str, year: int | None = None) -> DataFrame:
    """Features -> optional period filter -> first-name propagation ->
    projection -> NaN/Inf-safe 2-decimal rounding -> name, period order."""
    df = G.temporal_features(named_panel(spark, sf))
    df = A.propagate_first_name(df)
    if year:
        df = df.where(F.col("ano") == year)
    from cohortlens.operators.schema import listing_projection
    return A.listing_order(A.round_records(listing_projection(df)))


@register("entity_listing", f"""WITH {NAMED_PANEL_SQL},
f AS (
  SELECT *, first(NOME IGNORE NULLS) OVER (PARTITION BY RA ORDER BY ano
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS NOME1,
         INDE - lag(INDE) OVER w AS delta_INDE, IEG - lag(IEG) OVER w AS delta_IEG,
         IDA - lag(IDA) OVER w AS delta_IDA, {TREND_SQL} AS tendencia_INDE,
         CAST(row_number() OVER w AS INTEGER) AS anos_no_programa,
         {LEVEL_CHANGE_SQL} AS pedras_mudadas
  FROM panel_named {W_SQL}),
t AS (SELECT *, sum(pedras_mudadas) OVER wr AS pedras_mudadas_total FROM f {W_SQL})
SELECT RA AS ra, NOME1 AS nome, ano, round(INDE, 2) AS inde, round(IEG, 2) AS ieg, round(IDA, 2) AS ida,
       round(IPS, 2) AS ips, round(IAA, 2) AS iaa, round(IAN, 2) AS ian, PEDRA AS pedra,
       round(tendencia_INDE, 2) + 0.0 AS tendencia_inde, round(pedras_mudadas_total, 2) AS pedras_mudadas_total,
       anos_no_programa, round(delta_INDE, 2) + 0.0 AS delta_inde, round(delta_IEG, 2) + 0.0 AS delta_ieg,
       round(delta_IDA, 2) + 0.0 AS delta_ida
FROM t""")
def q_entity_listing(spark, sf):
    return entity_listing(spark, sf).select(*LISTING_OUT)


# ============================================================ 5. drift


def _drift_long_sql(features, source="panel_lvl", last_only=False, complete=False) -> str:
    cc = " AND ".join(f"{f} IS NOT NULL" for f in features) if complete else "TRUE"
    last = " AND ano = (SELECT last FROM yrs)" if last_only else ""
    unions = " UNION ALL ".join(f"SELECT cmp, '{f}' AS feature, per, CAST({f} AS DOUBLE) AS x FROM lg"
                                for f in features)
    return f"""
yrs AS (SELECT min(ano) AS ref, max(ano) AS last FROM {source}),
curs AS (SELECT DISTINCT ano AS cur FROM {source} WHERE ano > (SELECT ref FROM yrs){last}),
src AS (SELECT * FROM {source} WHERE {cc}),
lg AS (
  SELECT CAST(y.ref AS VARCHAR) || '_vs_' || CAST(c.cur AS VARCHAR) AS cmp, 0 AS per, s.*
    FROM src s, yrs y, curs c WHERE s.ano = y.ref
  UNION ALL
  SELECT CAST(y.ref AS VARCHAR) || '_vs_' || CAST(s.ano AS VARCHAR) AS cmp, 1 AS per, s.*
    FROM src s, yrs y WHERE s.ano IN (SELECT cur FROM curs)),
lf0 AS ({unions}),
lf AS (SELECT * FROM lf0 WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))"""


# K4 written independently of the operator: textbook formulas (lgamma series for the chi-square survival).
_ERFC = ("(1.0 / (1.0 + 0.5 * abs({z}))) * exp(-({z}) * ({z}) - 1.26551223 + list_sum(list_transform("
         "[1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277], "
         "lambda c, i: c * pow(1.0 / (1.0 + 0.5 * abs({z})), i))))")
_SCORES = {
    "ks": ("CASE WHEN ks_d * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * list_sum(list_transform("
           "range(1, 41), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * ks_d * ks_d * n_ref::DOUBLE * n_cur / (n_ref + n_cur)))))) END"),
    "wasserstein": "w1 / greatest(coalesce(ref_std, 0.0), 0.001)",
    "jensenshannon": "sqrt(greatest((kl_p + kl_q) / 2, 0.0))",
    "chisquare": ("CASE WHEN chi_inf > 0 THEN 0.0 WHEN n_values = 1 OR chi_stat <= 0 THEN 1.0 WHEN n_values % 2 = 1 THEN "
                  "list_sum(list_transform(range(0, (n_values - 1) // 2), lambda i: exp(-chi_stat / 2 + i * ln(chi_stat / 2) - lgamma(i + 1)))) ELSE "
                  + _ERFC.replace("{z}", "sqrt(chi_stat / 2)") +
                  " + coalesce(list_sum(list_transform(range(1, (n_values - 2) // 2 + 1), lambda i: "
                  "exp(-chi_stat / 2 + (i - 0.5) * ln(chi_stat / 2) - lgamma(i + 0.5)))), 0.0) END"),
    "z": ("CASE WHEN a_mode + b_mode IN (0, n_ref + n_cur) THEN 1.0 ELSE "
          + _ERFC.replace("{z}", "(abs(a_mode::DOUBLE / n_ref - b_mode::DOUBLE / n_cur) / sqrt(2.0 * ((a_mode + b_mode)::DOUBLE / (n_ref + n_cur)) "
                          "* (1 - (a_mode + b_mode)::DOUBLE / (n_ref + n_cur)) * (1.0 / n_ref + 1.0 / n_cur)))") + " END"),
}


def _drift_table_sql(stattest: str, of: dict[str, str] | None = None) -> str:
    test = "ks" if stattest == "auto" else stattest   # the registered features are numeric, but for those in ``of``
    named = {**(of or {}), "": test}

    def case(choose) -> str:
        whens = " ".join(f"WHEN feature = '{f}' THEN {choose(t)}" for f, t in named.items() if f)
        return f"CASE {whens} ELSE {choose(test)} END" if whens else choose(test)

    detected = case(lambda t: "raw < 0.05" if t in ("ks", "chisquare", "z") else "raw >= 0.1")
    p, q = "(CAST(a AS DOUBLE) / n_ref)", "(CAST(b AS DOUBLE) / n_cur)"
    m = f"(({p} + {q}) / 2)"
    k = "(CAST(n_cur AS DOUBLE) / n_ref)"
    return f""",
counts AS (SELECT cmp, feature, x, count(*) FILTER (WHERE per = 0) AS a, count(*) FILTER (WHERE per = 1) AS b
           FROM lf GROUP BY cmp, feature, x),
sizes AS (SELECT cmp, feature, CAST(sum(a) AS BIGINT) AS n_ref, CAST(sum(b) AS BIGINT) AS n_cur,
                 count(*) AS n_values, first(x ORDER BY a DESC, x ASC) AS mode_ref
          FROM counts GROUP BY cmp, feature HAVING sum(a) > 0 AND sum(b) > 0),
run AS (SELECT c.*, s.n_ref, s.n_cur, s.n_values, s.mode_ref,
               sum(c.a) OVER (PARTITION BY c.cmp, c.feature ORDER BY c.x
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_a,
               sum(c.b) OVER (PARTITION BY c.cmp, c.feature ORDER BY c.x
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_b,
               lead(c.x) OVER (PARTITION BY c.cmp, c.feature ORDER BY c.x) AS x_next
        FROM counts c JOIN sizes s ON c.cmp = s.cmp AND c.feature = s.feature),
stats AS (SELECT cmp, feature, n_ref, n_cur, n_values,
                 max(abs(CAST(cum_a AS DOUBLE) / n_ref - CAST(cum_b AS DOUBLE) / n_cur)) AS ks_d,
                 sum(abs(CAST(cum_a AS DOUBLE) / n_ref - CAST(cum_b AS DOUBLE) / n_cur)
                     * coalesce(x_next - x, 0.0)) AS w1,
                 sum(CASE WHEN a > 0 THEN pow(b - a * {k}, 2) / (a * {k}) ELSE 0.0 END) AS chi_stat,
                 count(*) FILTER (WHERE a = 0 AND b > 0) AS chi_inf,
                 sum(CASE WHEN {p} > 0 THEN {p} * ln({p} / {m}) ELSE 0.0 END) AS kl_p,
                 sum(CASE WHEN {q} > 0 THEN {q} * ln({q} / {m}) ELSE 0.0 END) AS kl_q,
                 sum(CASE WHEN x = mode_ref THEN a ELSE 0 END) AS a_mode,
                 sum(CASE WHEN x = mode_ref THEN b ELSE 0 END) AS b_mode
          FROM run GROUP BY cmp, feature, n_ref, n_cur, n_values),
moments AS (SELECT cmp, feature, stddev_pop(x) AS ref_std FROM lf WHERE per = 0 GROUP BY cmp, feature),
both_ AS (SELECT s.*, ref_std FROM stats s LEFT JOIN moments m ON s.cmp = m.cmp AND s.feature = m.feature),
scored AS (SELECT cmp, feature, n_ref, n_cur, n_values, {case(lambda t: "'" + t + "'")} AS stattest, {case(lambda t: _SCORES[t])} AS raw FROM both_),
dt AS (SELECT cmp, feature, n_ref, n_cur, n_values, stattest, round(raw, 4) AS drift_score, {detected} AS drift_detected FROM scored)"""


DRIFT_SUMMARY_SQL = """
SELECT cmp, count(*) AS n_total_features, count(*) FILTER (WHERE drift_detected) AS n_drifted_features,
       round(CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*), 4) AS drift_share,
       CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) >= 0.5 AS dataset_drift,
       CAST(0.5 AS DOUBLE) AS drift_threshold,
       CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) > 0.5 AS above_threshold
FROM dt GROUP BY cmp"""


def _drift_long(spark, sf, features, last_only=False, complete=False):
    ys = panel_years(spark, sf)
    curs = [ys[-1]] if last_only else ys[1:]
    df = level_panel(spark, sf, years=[ys[0], *curs])   # only the compared periods are scanned
    return D.long_periods(df, features, ys[0], curs, complete_cases=complete)


def _register_drift_table(name, stattest, features, last_only=False, complete=False):
    sql = f"WITH {LEVEL_PANEL_SQL},{_drift_long_sql(features, last_only=last_only, complete=complete)}" \
          f"{_drift_table_sql(stattest)}\nSELECT * FROM dt"

    def q(spark, sf):
        return D.drift_table(_drift_long(spark, sf, features, last_only, complete), stattest)
    register(name, sql)(q)


_register_drift_table("drift_ks", "ks", K.DRIFT_FEATURES)
_register_drift_table("drift_wasserstein", "wasserstein", K.DRIFT_FEATURES)
_register_drift_table("drift_chisquare", "chisquare", K.DRIFT_FEATURES)
_register_drift_table("drift_jensenshannon", "jensenshannon", K.DRIFT_FEATURES)
_register_drift_table("drift_auto", "auto", K.DRIFT_FEATURES)


@register("drift_ztest", f"""WITH {LEVEL_PANEL_SQL},
panel_two AS (SELECT *, CASE WHEN INDE >= 3 THEN 1.0 WHEN INDE IS NOT NULL THEN 0.0 END AS ACIMA FROM panel_lvl),
{_drift_long_sql(["ACIMA"], source="panel_two")}{_drift_table_sql('z')}
SELECT * FROM dt""")
def q_drift_ztest(spark, sf):
    """K4 z-test on a two-value feature."""
    ys = panel_years(spark, sf)
    two = level_panel(spark, sf, years=ys).withColumn("ACIMA", F.when(F.col("INDE").isNotNull(), (F.col("INDE") >= 3).cast("double")))
    return D.drift_table(D.long_periods(two, ["ACIMA"], ys[0], ys[1:]), kinds={"ACIMA": "binary"})


# Per-year state: each year's rows are read once into its own tables, and the results come from these.
_PANEL_TYPES = {"RA": "bigint", "ano": "int", **dict.fromkeys(["INDE", "IDA", "IPS", "IEG", "IAA", "IAN"], "double"), "PEDRA": "string", "PEDRA_CODIGO": "double"}


def _year_state(spark, sf) -> str:
    import uuid
    from cohortlens.operators import year_state
    from cohortlens.session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/year-state-{uuid.uuid4().hex[:12]}"
    for year in panel_years(spark, sf):
        year_state.add_year(level_panel(spark, sf, years=[year]), base, year)
    return base


@register("year_state_profile", f"WITH {LEVEL_PANEL_SQL},"
          "n AS (SELECT ano, count(*) AS n, count(DISTINCT RA) AS ids FROM panel_lvl GROUP BY ano)"
          + " UNION ALL ".join(f"""
SELECT p.ano, '{c}' AS coluna, '{t}' AS tipo, count(*) FILTER (WHERE p.{c} IS NULL) AS n_nulos,
  round(count(*) FILTER (WHERE p.{c} IS NULL) * 100.0 / any_value(n.n), 6) AS pct_nulos, any_value(n.n) AS n_linhas, {len(_PANEL_TYPES)} AS n_colunas,
  any_value(n.ids) AS n_ids_unicos FROM panel_lvl p JOIN n ON p.ano = n.ano GROUP BY p.ano""" for c, t in _PANEL_TYPES.items()))
def q_year_state_profile(spark, sf):
    """F12 of every year, from the years' states."""
    from cohortlens.operators import year_state
    return year_state.profile_by_year(spark, _year_state(spark, sf))


@register("year_state_stats", _feature_stats_sql())
def q_year_state_stats(spark, sf):
    """F10 of all years together, from the years' value counts."""
    from cohortlens.operators import year_state
    return year_state.feature_stats(spark, _year_state(spark, sf))


@register("year_state_medians", f"WITH {LEVEL_PANEL_SQL}" + " UNION ALL ".join(
    f"\nSELECT '{c}' AS feature, median({c}) AS median FROM panel_lvl" for c in K.QUALITY_FEATURES if c in _PANEL_TYPES))
def q_year_state_medians(spark, sf):
    """C6's medians of all years together, from the years' value counts."""
    from cohortlens.operators import year_state
    return year_state.medians(spark, _year_state(spark, sf))


@register("year_state_drift", f"WITH {LEVEL_PANEL_SQL},"
          f"{_drift_long_sql(K.DRIFT_FEATURES)}{_drift_table_sql('auto')}{DRIFT_SUMMARY_SQL}")
def q_year_state_drift(spark, sf):
    """K3b from the years' value counts."""
    from cohortlens.operators import year_state
    return year_state.drift_vs_first(spark, _year_state(spark, sf))[0]


# K1 and K4 by kind: two frames of lineitem, the last ship year against all before it.
FRAME_KINDS = {"l_partkey": "categorical", "l_suppkey": "categorical", "l_quantity": "categorical", "l_extendedprice": "categorical", "FECHADO": "binary"}
FRAME_FEATURES = [*FRAME_KINDS, "l_discount"]
_FRAMES_SQL = """WITH li AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS FECHADO, year(l_shipdate) AS y FROM lineitem),
last AS (SELECT max(y) AS y FROM li),
lg AS (SELECT 'cur' AS cmp, CASE WHEN li.y = last.y THEN 1 ELSE 0 END AS per, li.* FROM li, last WHERE li.y IS NOT NULL),
lf0 AS (""" + " UNION ALL ".join(f"SELECT cmp, '{f}' AS feature, per, CAST({f} AS DOUBLE) AS x FROM lg" for f in FRAME_FEATURES) + """),
lf AS (SELECT * FROM lf0 WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))""" + _drift_table_sql(
    "auto", {f: D.KIND_TESTS[k] for f, k in FRAME_KINDS.items()})


def _two_frames(spark, sf):
    from cohortlens.sources.tables import read_table
    li = read_table(spark, sf, "lineitem").withColumn("FECHADO", F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0))
    last = li.agg(F.max(F.year("l_shipdate"))).first()[0]
    if last is None:
        return li, li
    return li.where(F.year("l_shipdate") < last), li.where(F.year("l_shipdate") == last)


@register("drift_two_frames", _FRAMES_SQL + "\nSELECT * FROM dt")
def q_drift_two_frames(spark, sf):
    """K1 / K4 on two frames: each feature by the test of its kind, features of thousands of values among them."""
    ref, cur = _two_frames(spark, sf)
    return D.check_drift(ref, cur, FRAME_FEATURES, kinds=FRAME_KINDS)[1]


@register("drift_two_frames_summary", _FRAMES_SQL + DRIFT_SUMMARY_SQL)
def q_drift_two_frames_summary(spark, sf):
    """K2 on two frames."""
    ref, cur = _two_frames(spark, sf)
    return D.check_drift(ref, cur, FRAME_FEATURES, kinds=FRAME_KINDS)[0]


@register("drift_summary", f"WITH {LEVEL_PANEL_SQL},"
          f"{_drift_long_sql(K.DRIFT_FEATURES, last_only=True, complete=True)}{_drift_table_sql('auto')}"
          f"{DRIFT_SUMMARY_SQL}")
def q_drift_summary(spark, sf):
    """K2 on first vs last period, complete cases (the text-analysis path)."""
    return D.drift_summary(D.drift_table(_drift_long(spark, sf, K.DRIFT_FEATURES, True, True)))


@register("drift_all_years", f"WITH {LEVEL_PANEL_SQL},"
          f"{_drift_long_sql(K.DRIFT_FEATURES)}{_drift_table_sql('auto')}{DRIFT_SUMMARY_SQL}")
def q_drift_all_years(spark, sf):
    """First period against every later one."""
    return D.drift_summary(D.drift_table(_drift_long(spark, sf, K.DRIFT_FEATURES)))


@register("drift_histogram", f"""WITH {LEVEL_PANEL_SQL},{_drift_long_sql(K.DRIFT_FEATURES, last_only=True)},
rng AS (SELECT cmp, feature, min(x) AS lo, max(x) AS hi FROM lf GROUP BY cmp, feature),
b AS (SELECT l.cmp, l.feature, l.per, r.lo, r.hi,
             CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((l.x - r.lo) / ((r.hi - r.lo) / 10)), 9) END
                  AS INTEGER) AS bin
      FROM lf l JOIN rng r ON l.cmp = r.cmp AND l.feature = r.feature)
SELECT cmp, feature, bin, lo, hi, count(*) FILTER (WHERE per = 0) AS n_ref, count(*) FILTER (WHERE per = 1) AS n_cur
FROM b GROUP BY cmp, feature, bin, lo, hi""")
def q_drift_histogram(spark, sf):
    return D.histogram(_drift_long(spark, sf, K.DRIFT_FEATURES, last_only=True), bins=10)


@register("period_stats", f"""WITH {LEVEL_PANEL_SQL},
yrs AS (SELECT min(ano) AS ref, max(ano) AS last FROM panel_lvl),
src AS (SELECT * FROM panel_lvl, yrs WHERE ano IN (ref, last) AND {" AND ".join(f"{f} IS NOT NULL" for f in K.DRIFT_FEATURES)}),
l AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, ano, ref, last, CAST({f} AS DOUBLE) AS x FROM src" for f in K.DRIFT_FEATURES)})
SELECT feature, round(avg(x) FILTER (WHERE ano = ref), 2) AS ref_mean,
       round(stddev_samp(x) FILTER (WHERE ano = ref), 2) AS ref_std,
       round(avg(x) FILTER (WHERE ano = last), 2) AS cur_mean,
       round(stddev_samp(x) FILTER (WHERE ano = last), 2) AS cur_std,
       count(*) FILTER (WHERE ano = ref) AS ref_count, count(*) FILTER (WHERE ano = last) AS cur_count
FROM l GROUP BY feature""")
def q_period_stats(spark, sf):
    ys = panel_years(spark, sf)
    df = level_panel(spark, sf, years=[ys[0], ys[-1]])
    return A.two_period_stats(df, K.DRIFT_FEATURES, ys[0], ys[-1])


@register("drift_text", f"WITH {LEVEL_PANEL_SQL},"
          f"{_drift_long_sql(K.DRIFT_FEATURES, last_only=True, complete=True)}{_drift_table_sql('auto')}" + """
SELECT cmp, string_agg(line, chr(10) ORDER BY line) AS texto
FROM (SELECT cmp, printf('- %s: %s (score=%.4f, teste=%s)', feature,
                         CASE WHEN drift_detected THEN 'DRIFT' ELSE 'estável' END, drift_score, stattest) AS line
      FROM dt)
GROUP BY cmp""")
def q_drift_text(spark, sf):
    return D.drift_lines(D.drift_table(_drift_long(spark, sf, K.DRIFT_FEATURES, True, True)))


@register("drift_text_means", f"WITH {LEVEL_PANEL_SQL},"
          f"{_drift_long_sql(K.DRIFT_FEATURES, last_only=True, complete=True)}{_drift_table_sql('auto')},"
          """
means AS (SELECT cmp, feature, round(avg(x) FILTER (WHERE per = 0), 2) AS ref_mean, round(avg(x) FILTER (WHERE per = 1), 2) AS cur_mean
          FROM lf GROUP BY cmp, feature)
SELECT cmp, string_agg(line, chr(10) ORDER BY line) AS texto
FROM (SELECT dt.cmp, printf('- %s: %s (score=%.4f, teste=%s) ref_mean=%.2f cur_mean=%.2f', dt.feature,
                            CASE WHEN drift_detected THEN 'DRIFT' ELSE 'estável' END, drift_score, stattest, ref_mean, cur_mean) AS line
      FROM dt JOIN means m ON m.cmp = dt.cmp AND m.feature = dt.feature)
GROUP BY cmp""")
def q_drift_text_means(spark, sf):
    """C17 with the periods' means."""
    ys = panel_years(spark, sf)
    df = level_panel(spark, sf, years=[ys[0], ys[-1]])
    stats = A.two_period_stats(df, K.DRIFT_FEATURES, ys[0], ys[-1])
    return D.drift_lines(D.drift_table(_drift_long(spark, sf, K.DRIFT_FEATURES, True, True)), stats)


# ============================================================ 6. evaluation metrics

TARGET_SQL = TEMPORAL_SQL + f""",
tt AS (SELECT *, CAST(lead(PEDRA_CODIGO) OVER (PARTITION BY RA ORDER BY ano) < PEDRA_CODIGO AS DOUBLE)
                   AS {K.TARGET_COL} FROM t)"""
_CC = " AND ".join(f"{c} IS NOT NULL" for c in [K.TARGET_COL, *K.RISK_FEATURES])
SPLIT_SQL = TARGET_SQL + f""",
sp AS (SELECT *, CASE WHEN md5(CAST(RA AS VARCHAR) || '|{M.SPLIT_SEED}') < '{M.TEST_HASH_BOUND}'
                      THEN 'test' ELSE 'train' END AS split FROM tt WHERE {_CC}),
scored AS (SELECT RA, ano, CAST({K.TARGET_COL} AS INTEGER) AS label, INDE / 10 AS score,
                  CAST(INDE / 10 >= 0.5 AS INTEGER) AS prediction FROM sp WHERE split = 'test')"""


def target_panel(spark, sf):
    return G.drop_target(temporal_panel(spark, sf))


def baseline_scored(spark, sf) -> DataFrame:
    """Test-side rows scored by a fixed rule (index / 10, class at 0.5): the
    metric operators' input when no trained model is involved."""
    sp = M.group_split(target_panel(spark, sf), K.RISK_FEATURES).where("split = 'test'")
    return sp.select("RA", "ano", F.col(K.TARGET_COL).cast("int").alias("label"),
                     (F.col("INDE") / 10).alias("score"),
                     ((F.col("INDE") / 10) >= 0.5).cast("int").alias("prediction"))


@register("group_split", f"{SPLIT_SQL}\nSELECT RA, ano, split FROM sp")
def q_group_split(spark, sf):
    return M.group_split(target_panel(spark, sf), K.RISK_FEATURES).select("RA", "ano", "split")


@register("confusion", f"{SPLIT_SQL}\nSELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction")
def q_confusion(spark, sf):
    return M.confusion(baseline_scored(spark, sf))


@register("weighted_metrics", f"""{SPLIT_SQL},
cf AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction),
cls AS (SELECT label AS c FROM cf UNION SELECT prediction FROM cf),
per AS (SELECT c.c,
          coalesce((SELECT sum(n) FROM cf WHERE label = c.c), 0) AS support,
          coalesce((SELECT sum(n) FROM cf WHERE prediction = c.c), 0) AS predicted,
          coalesce((SELECT sum(n) FROM cf WHERE label = c.c AND prediction = c.c), 0) AS tp
        FROM cls c),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS p,
                 CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)
SELECT round(sum(p * support) / sum(support), 9) AS precision, round(sum(r * support) / sum(support), 9) AS recall,
       round(sum(f1 * support) / sum(support), 9) AS f1,
       CAST(sum(CASE WHEN c = 1 THEN support ELSE 0 END) AS BIGINT) AS positive,
       CAST(sum(CASE WHEN c = 0 THEN support ELSE 0 END) AS BIGINT) AS negative
FROM f""")
def q_weighted_metrics(spark, sf):
    m = M.weighted_metrics(M.confusion(baseline_scored(spark, sf)))
    return m.select(*[r9(c).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("positive").cast("bigint").alias("positive"),
                    F.col("negative").cast("bigint").alias("negative"))


@register("roc_auc", f"""{SPLIT_SQL},
g AS (SELECT CAST(score AS DOUBLE) AS s, count(*) FILTER (WHERE label = 1) AS pos,
             count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY 1),
r AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM g)
SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                  THEN sum(pos * (cum_neg - neg + neg * 0.5)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END, 9) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM r""")
def q_roc_auc(spark, sf):
    a = M.roc_auc(baseline_scored(spark, sf))
    return a.select(r9("roc_auc").alias("roc_auc"), "n_pos", "n_neg")


LATEST_CC_SQL = LEVEL_PANEL_SQL + f""",
lat AS (SELECT RA, {", ".join(f"arg_max({c}, ano) FILTER (WHERE {c} IS NOT NULL) AS {c}"
                               for c in [*K.CLUSTER_FEATURES, "PEDRA_CODIGO"])}
        FROM panel_lvl GROUP BY RA),
latcc AS (SELECT * FROM lat WHERE {" AND ".join(f"{c} IS NOT NULL" for c in K.CLUSTER_FEATURES)})"""


def latest_complete(spark, sf) -> DataFrame:
    """Latest non-null record per entity, complete on the profile features."""
    lat = A.latest_nonnull(level_panel(spark, sf).select("RA", "ano", *K.CLUSTER_FEATURES, "PEDRA_CODIGO"))
    return lat.drop("ano").dropna(subset=K.CLUSTER_FEATURES)


@register("zscore", f"""WITH {LATEST_CC_SQL}
SELECT RA, {", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END, 6) + 0.0 AS {c}_z" for c in K.CLUSTER_FEATURES)}
FROM latcc""")
def q_zscore(spark, sf):
    z = M.zscore(latest_complete(spark, sf), K.CLUSTER_FEATURES)
    return z.select("RA", *[r6(f"{c}_z").alias(f"{c}_z") for c in K.CLUSTER_FEATURES])


EMB_SQL = """
pts AS (SELECT vec_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
pts2 AS (SELECT *, list_dot_product(v, v) AS sq FROM pts),
dims AS (SELECT cluster, i, avg(v[i]) AS ci FROM pts2, range(1, 65537) t(i) WHERE i <= len(v) GROUP BY cluster, i),
cents AS (SELECT d.cluster, list(d.ci ORDER BY d.i) AS c,
                 (SELECT count(*) FROM pts2 p WHERE p.cluster = d.cluster) AS n,
                 (SELECT avg(sq) FROM pts2 p WHERE p.cluster = d.cluster) AS msq
          FROM dims d GROUP BY d.cluster)"""


@register("silhouette_sq", f"""WITH {EMB_SQL},
pd AS (SELECT p.vec_id, p.cluster AS own, c.cluster AS other, c.n,
              p.sq - 2 * list_dot_product(p.v, c.c) + c.msq AS d
       FROM pts2 p, cents c),
pt AS (SELECT vec_id, own, max(CASE WHEN other = own AND n > 1 THEN n * d / (n - 1) END) AS a,
              min(CASE WHEN other <> own THEN d END) AS b
       FROM pd GROUP BY vec_id, own)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN greatest(a, b) > 0
                      THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS silhouette,
       count(*) AS n_points, count(DISTINCT own) AS n_clusters
FROM pt""")
def q_silhouette(spark, sf):
    from cohortlens.sources.tables import read_table
    e = read_table(spark, sf, "embeddings")
    s = M.silhouette_sq(e, "label", vec_col="embedding")
    return s.select(F.round("silhouette", 6).alias("silhouette"), "n_points", "n_clusters")


@register("silhouette_euclidean", """
WITH pts AS MATERIALIZED (SELECT vec_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
pd AS (SELECT p.vec_id, p.cluster AS own, q.cluster AS other, sum(list_distance(p.v, q.v)) AS s, count(*) AS n
       FROM pts p JOIN pts q ON p.vec_id <> q.vec_id GROUP BY ALL),
pt AS (SELECT vec_id, max(CASE WHEN other = own THEN s / n END) AS a, min(CASE WHEN other <> own THEN s / n END) AS b FROM pd GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS silhouette,
       0.0::DOUBLE AS std_error, count(*) AS n_points, (SELECT count(DISTINCT cluster) FROM pts) AS n_clusters
FROM pt""")
def q_silhouette_euclidean(spark, sf):
    """The reference sets hold whole clusters here up to 256 members, so the value is exact and its error 0."""
    from cohortlens.sources.tables import read_table
    s = M.silhouette_euclidean(read_table(spark, sf, "embeddings"), "label", vec_col="embedding", id_col="vec_id")
    return s.select(F.round("silhouette", 6).alias("silhouette"), "std_error", "n_points", "n_clusters")


@register("davies_bouldin", f"""WITH {EMB_SQL},
sp AS (SELECT p.cluster, avg(list_distance(p.v, c.c)) AS s FROM pts2 p JOIN cents c ON p.cluster = c.cluster
       GROUP BY p.cluster),
cl AS (SELECT c.cluster, c.c, s.s FROM cents c JOIN sp s ON c.cluster = s.cluster),
w AS (SELECT a.cluster, max(CASE WHEN list_distance(a.c, b.c) > 0 THEN (a.s + b.s) / list_distance(a.c, b.c)
                                 ELSE 0.0 END) AS worst
      FROM cl a JOIN cl b ON a.cluster <> b.cluster GROUP BY a.cluster)
SELECT round(avg(coalesce(worst, 0.0)), 6) AS davies_bouldin, count(*) AS n_clusters FROM w""")
def q_davies_bouldin(spark, sf):
    from cohortlens.sources.tables import read_table
    e = read_table(spark, sf, "embeddings")
    d = M.davies_bouldin(e, "label", vec_col="embedding")
    return d.select(F.round("davies_bouldin", 6).alias("davies_bouldin"), "n_clusters")


PROFILE_SQL = LATEST_CC_SQL + f""",
prof AS (SELECT CAST(PEDRA_CODIGO AS INTEGER) AS cluster_id, count(*) AS n_alunos,
                {", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in K.CLUSTER_FEATURES)},
                count(*) * 100.0 / (SELECT count(*) FROM latcc) AS percentual
         FROM latcc GROUP BY 1)"""


def _profile(spark, sf):
    lat = latest_complete(spark, sf).withColumn("cluster", F.col("PEDRA_CODIGO").cast("int"))
    return M.cluster_profile(lat, "cluster", K.CLUSTER_FEATURES)


@register("cluster_profile", f"""WITH {PROFILE_SQL}
SELECT cluster_id, n_alunos, round(percentual, 9) AS percentual,
       {", ".join(f"round({c}_mean, 9) AS {c}_mean, round({c}_std, 9) AS {c}_std" for c in K.CLUSTER_FEATURES)}
FROM prof""")
def q_cluster_profile(spark, sf):
    p = _profile(spark, sf)
    return p.select("cluster_id", "n_alunos", r9("percentual").alias("percentual"),
                    *[r9(f"{c}_{s}").alias(f"{c}_{s}") for c in K.CLUSTER_FEATURES for s in ("mean", "std")])


_NAMES_ARR = ", ".join(f"'{n}'" for n in K.CLUSTER_PROFILE_NAMES)


@register("cluster_names", f"""WITH {PROFILE_SQL},
nn AS (SELECT cluster_id,
              CASE WHEN max(INDE_mean) OVER () = min(INDE_mean) OVER () THEN 0.5
                   ELSE (INDE_mean - min(INDE_mean) OVER ()) / (max(INDE_mean) OVER () - min(INDE_mean) OVER ()) END AS ni,
              CASE WHEN max(IEG_mean) OVER () = min(IEG_mean) OVER () THEN 0.5
                   ELSE (IEG_mean - min(IEG_mean) OVER ()) / (max(IEG_mean) OVER () - min(IEG_mean) OVER ()) END AS ne
       FROM prof),
sc AS (SELECT cluster_id, {K.CLUSTER_SCORE_WEIGHTS[0]} * ni + {K.CLUSTER_SCORE_WEIGHTS[1]} * ne AS score FROM nn),
rk AS (SELECT *, row_number() OVER (ORDER BY score, cluster_id) - 1 AS rnk FROM sc)
SELECT cluster_id, round(score, 9) AS score,
       CASE WHEN rnk < {len(K.CLUSTER_PROFILE_NAMES)} THEN [{_NAMES_ARR}][rnk + 1]
            ELSE 'Cluster ' || CAST(cluster_id AS VARCHAR) END AS cluster_nome
FROM rk""")
def q_cluster_names(spark, sf):
    n = M.cluster_names(_profile(spark, sf))
    return n.select("cluster_id", r9("score").alias("score"), "cluster_nome")


# ============================================================ 3. schema alignment


def _raw(spark, sf):
    from cohortlens.plans.raw_years import raw_year_tables
    return raw_year_tables(spark, sf)


def _raw_long_sql() -> str:
    from cohortlens.plans.raw_years import RAW_COLUMNS_SQL, YEARS_SQL
    unions = " UNION ALL ".join(f"SELECT ano, {name} AS coluna, {nn} AS nn FROM py WHERE {cond}"
                                for name, nn, cond in RAW_COLUMNS_SQL)
    return f"""WITH {YEARS_SQL},
rl AS ({unions}),
present AS (SELECT ano, coluna, count(*) FILTER (WHERE nn) AS n FROM rl GROUP BY ano, coluna),
allc AS (SELECT DISTINCT coluna FROM present),
ally AS (SELECT DISTINCT ano FROM panel),
matrix AS (SELECT y.ano, c.coluna, p.n IS NOT NULL AS presente, CAST(coalesce(p.n, 0) AS BIGINT) AS n_nao_nulos
           FROM ally y CROSS JOIN allc c LEFT JOIN present p ON p.ano = y.ano AND p.coluna = c.coluna)"""


HARMONIZED_SQL = """
SELECT RA, ano, 'Aluno-' || CAST(RA AS VARCHAR) AS NOME,
       CASE WHEN ano = y0 THEN CAST(RA % 8 + 1 AS INTEGER) END AS FASE,
       CASE WHEN ano = y0 THEN ['A', 'B', 'C'][CAST(RA % 3 + 1 AS INTEGER)] END AS TURMA,
       INDE, PEDRA_RAW AS PEDRA, IEG, IDA, IPS, IAA, IAN,
       CASE WHEN ano = y1 THEN 'Escola ' || CAST(RA % 7 AS VARCHAR) END AS "INSTITUICAO DE ENSINO"
FROM py"""


@register("harmonize_union", None)
def q_harmonize(spark, sf):
    from cohortlens.operators.schema import harmonize
    return harmonize(_raw(spark, sf))


def _register_harmonize_sql():
    from cohortlens.plans.raw_years import YEARS_SQL
    ORACLE["harmonize_union"] = f"WITH {YEARS_SQL}{HARMONIZED_SQL}"


_register_harmonize_sql()


@register("common_features", None)
def q_common_features(spark, sf):
    """The harmonised union restricted to id, period and the shared indicators."""
    from cohortlens.operators.schema import common_features_only, harmonize
    return common_features_only(harmonize(_raw(spark, sf)))


def _register_common_features_sql():
    from cohortlens.plans.raw_years import YEARS_SQL
    ORACLE["common_features"] = f"""WITH {YEARS_SQL}
SELECT RA, ano, INDE, IAN, IDA, IEG, IAA, IPS FROM py"""


_register_common_features_sql()


@register("schema_matrix", _raw_long_sql() + "\nSELECT * FROM matrix")
def q_schema_matrix(spark, sf):
    from cohortlens.operators.schema import schema_matrix
    return schema_matrix(_raw(spark, sf))


@register("common_columns", _raw_long_sql() + """
SELECT coluna FROM matrix WHERE presente GROUP BY coluna
HAVING count(*) = (SELECT count(DISTINCT ano) FROM panel)""")
def q_common_columns(spark, sf):
    from cohortlens.operators.schema import common_columns
    return common_columns(_raw(spark, sf))


@register("unique_columns", _raw_long_sql() + """
SELECT min(ano) AS ano, coluna FROM matrix WHERE presente GROUP BY coluna HAVING count(*) = 1""")
def q_unique_columns(spark, sf):
    from cohortlens.operators.schema import unique_columns
    return unique_columns(_raw(spark, sf))


_FIRST_YEAR_TYPES = [("RA", "bigint", "RA"), ("Nome", "string", "'x'"), ("Fase", "int", "1"),
                     ("Turma", "string", "'x'"), ("INDE {sfx}", "string", "INDE"),
                     ("Pedra {sfx}", "string", "PEDRA_RAW"), ("IEG", "double", "IEG"),
                     ("IDA", "{ida_type}", "IDA"), ("IPS", "double", "IPS"), ("IAA", "double", "IAA"),
                     ("IAN", "double", "IAN")]


@register("profile_table", None)
def q_profile_table(spark, sf):
    """F12 on the first yearly table as loaded."""
    from cohortlens.operators.schema import profile_table
    raw = _raw(spark, sf)
    return profile_table(raw[min(raw)])


def _register_profile_sql():
    from cohortlens.plans.raw_years import YEARS_SQL
    sfx = "lpad(CAST((SELECT y0 FROM yrs) % 100 AS VARCHAR), 2, '0')"
    ida_type = "CASE WHEN (SELECT y0 FROM yrs) % 2 = 1 THEN 'string' ELSE 'double' END"
    rows = []
    for name, typ, expr in _FIRST_YEAR_TYPES:
        nm = f"'{name}'".replace("{sfx}", f"' || {sfx} || '")
        tp = ida_type if typ == "{ida_type}" else f"'{typ}'"
        rows.append(f"SELECT {nm} AS coluna, {tp} AS tipo, count(*) FILTER (WHERE ({expr}) IS NULL) AS n_nulos FROM f0")
    ORACLE["profile_table"] = f"""WITH {YEARS_SQL},
f0 AS (SELECT * FROM panel WHERE ano = (SELECT y0 FROM yrs)),
c AS ({" UNION ALL ".join(rows)})
SELECT coluna, tipo, n_nulos, round(n_nulos * 100.0 / (SELECT count(*) FROM f0), 6) AS pct_nulos,
       (SELECT count(*) FROM f0) AS n_linhas, {len(_FIRST_YEAR_TYPES)} AS n_colunas,
       (SELECT count(DISTINCT RA) FROM f0) AS n_ids_unicos
FROM c"""


_register_profile_sql()


# ============================================================ 8. reports


def _latest_report_fields(spark, sf) -> DataFrame:
    df = A.propagate_first_name(G.temporal_features(named_panel(spark, sf)))
    last = A.latest_row(df)
    return last.select("RA", F.col("NOME").alias("nome"), F.col("PEDRA").alias("pedra"),
                       F.col("INDE").alias("inde"), F.col("IEG").alias("ieg"), F.col("IDA").alias("ida"),
                       F.col("IPS").alias("ips"), F.col("IAA").alias("iaa"), F.col("IAN").alias("ian"),
                       "anos_no_programa", F.col("tendencia_INDE").alias("tendencia_num"))


def _report_sql(template: str) -> str:
    import re
    pieces, pos = [], 0
    defaults = {"idade": "'0'", "tendencia_inde": None, "cluster_nome": "'Não identificado'", "risco_classe": "'N/A'",
                "risco_percentual": "'0'", "feedback_texto": "'Não disponível'"}
    for m in re.finditer(r"\{(\w+)(?::\.(\d+)f)?\}", template):
        if m.start() > pos:
            pieces.append("'" + template[pos:m.start()].replace("'", "''") + "'")
        f, d = m.group(1), m.group(2)
        if f in defaults and defaults[f] is not None:
            pieces.append(defaults[f])
        elif f in ("ieg", "ida", "ips", "iaa", "ian", "ipv", "ipp"):
            pieces.append(f"printf('%.{d}f', coalesce({f}, 0.0))")
        elif d:
            pieces.append(f"coalesce(printf('%.{d}f', {f}), 'N/A')")
        else:
            pieces.append(f"coalesce(CAST({f} AS VARCHAR), 'N/A')")
        pos = m.end()
    if pos < len(template):
        pieces.append("'" + template[pos:].replace("'", "''") + "'")
    body = " || ".join(p.replace("\n", "' || chr(10) || '") for p in pieces)
    return f"""WITH {NAMED_PANEL_SQL},
f AS (
  SELECT *, first(NOME IGNORE NULLS) OVER (PARTITION BY RA ORDER BY ano
              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS NOME1,
         {TREND_SQL} AS tendencia_num,
         CAST(row_number() OVER (PARTITION BY RA ORDER BY ano) AS INTEGER) AS anos_no_programa
  FROM panel_named),
l AS (SELECT RA, NOME1 AS nome, PEDRA AS pedra, INDE AS inde, IEG AS ieg, IDA AS ida, IPS AS ips, IAA AS iaa, IAN AS ian, NULL::DOUBLE AS ipv,
             NULL::DOUBLE AS ipp, anos_no_programa,
             CASE WHEN coalesce(tendencia_num, 0) > {K.TREND_THRESHOLD} THEN 'crescendo'
                  WHEN coalesce(tendencia_num, 0) < -{K.TREND_THRESHOLD} THEN 'decrescendo'
                  ELSE 'estável' END AS tendencia_inde
      FROM f QUALIFY row_number() OVER (PARTITION BY RA ORDER BY ano DESC) = 1)
SELECT RA, {body} AS prompt FROM l"""


@register("report_prompts", None)
def q_report_prompts(spark, sf):
    """C8 -> C13 -> C14 from each entity's latest record (no model fields)."""
    from cohortlens.operators.reports import render_prompts, report_rows
    return render_prompts(report_rows(_latest_report_fields(spark, sf))).select("RA", "prompt")


@register("report_prompts_full", None)
def q_report_prompts_full(spark, sf):
    """C14 with the 17-field template; the panel has no IPV and IPP."""
    from cohortlens.operators.reports import FULL_TEMPLATE, render_prompts, report_rows
    return render_prompts(report_rows(_latest_report_fields(spark, sf)), FULL_TEMPLATE).select("RA", "prompt")


def _register_report_sql():
    from cohortlens.operators.reports import FULL_TEMPLATE, REPORT_TEMPLATE
    ORACLE["report_prompts"] = _report_sql(REPORT_TEMPLATE)
    ORACLE["report_prompts_full"] = _report_sql(FULL_TEMPLATE)


_register_report_sql()


@register("report_prompts_scored")
def q_report_prompts_scored(spark, sf):
    """Latest record + risk (N8) + profile (N9) -> defaults -> prompt."""
    from cohortlens.plans.pipelines import prompts_of_latest
    return prompts_of_latest(_latest_report_fields(spark, sf), risk_model(spark, sf), profile_model(spark, sf))


def _strip_sql() -> str:
    from cohortlens.functions.text import WS_CLASS
    ws = f"^{WS_CLASS}+|{WS_CLASS}+$"
    t = f"regexp_replace(l, '{ws}', '', 'g')"
    hdr = (f"({t} = '' OR {t} = '---' OR starts_with(lower({t}), '# relatório') "
           f"OR starts_with(lower({t}), '## relatório') "
           f"OR (starts_with(lower({t}), 'pedra:') AND contains(lower({t}), 'inde:')) "
           f"OR starts_with(lower({t}), '**pedra') OR starts_with(lower({t}), '> **pedra'))")
    return f"""WITH d AS (SELECT conv_id, turn, text,
                  string_split(regexp_replace(text, '{ws}', '', 'g'), chr(10)) AS lines
           FROM conversations),
f AS (SELECT conv_id, turn, text, lines, list_position(list_transform(lines, lambda l: {hdr}), false) AS first
      FROM d)
SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN first IS NULL OR first = 0 THEN ''
                    ELSE array_to_string(list_slice(lines, first, len(lines)), chr(10)) END AS texto
FROM f"""


@register("report_header_strip", _strip_sql())
def q_report_header_strip(spark, sf):
    """C16 over the whole text of every turn."""
    from cohortlens.functions.text import strip_report_header
    from cohortlens.sources.tables import read_table
    d = read_table(spark, sf, "conversations")
    return d.select("conv_id", "turn", strip_report_header(F.col("text")).alias("texto"))


# ============================================================ small operators


@register("target_distribution", f"""{TARGET_SQL}
SELECT {K.TARGET_COL}, count(*) AS n FROM tt WHERE {K.TARGET_COL} IS NOT NULL GROUP BY 1""")
def q_target_distribution(spark, sf):
    """F14."""
    return A.value_distribution(target_panel(spark, sf), K.TARGET_COL)


@register("target_by_split", f"""{SPLIT_SQL}
SELECT split, round(avg({K.TARGET_COL}), 9) AS taxa_alvo, count(*) AS n FROM sp GROUP BY split""")
def q_target_by_split(spark, sf):
    """F16: mean target per side of the entity split."""
    sp = M.group_split(target_panel(spark, sf), K.RISK_FEATURES)
    return sp.groupBy("split").agg(r9(F.avg(K.TARGET_COL)).alias("taxa_alvo"), F.count(F.lit(1)).alias("n"))


@register("listing_year", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA AS ra, ano, round(INDE, 2) AS inde, PEDRA AS pedra FROM panel_lvl
WHERE ano = (SELECT max(ano) FROM panel_lvl)""")
def q_listing_year(spark, sf):
    """One period (the latest one present)."""
    last = panel_years(spark, sf)[-1]
    out = A.filter_equals(level_panel(spark, sf, years=[last]), "ano", last)
    return out.select(F.col("RA").alias("ra"), "ano", F.round("INDE", 2).alias("inde"), F.col("PEDRA").alias("pedra"))


@register("listing_level", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA AS ra, ano, PEDRA AS pedra FROM panel_lvl WHERE PEDRA = 'Ametista'""")
def q_listing_level(spark, sf):
    """One level; the "all" marker would keep every row."""
    out = A.filter_equals(level_panel(spark, sf), "PEDRA", "Ametista")
    return out.select(F.col("RA").alias("ra"), "ano", F.col("PEDRA").alias("pedra"))


@register("complete_case_mask", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, CASE WHEN {" AND ".join(f"{c} IS NOT NULL" for c in K.CLUSTER_FEATURES)}
                THEN round(INDE + IPS, 9) END AS indice_composto
FROM panel_lvl""")
def q_complete_case_mask(spark, sf):
    """Value only on complete rows, other rows kept with NULL."""
    out = A.complete_case_value(level_panel(spark, sf), K.CLUSTER_FEATURES, F.col("INDE") + F.col("IPS"),
                                "indice_composto")
    return out.select("RA", "ano", r9("indice_composto").alias("indice_composto"))


@register("point_lookup", f"""WITH {LEVEL_PANEL_SQL}
SELECT * FROM panel_lvl WHERE RA = (SELECT max(RA) FROM panel_lvl)
ORDER BY ano LIMIT 1""")
def q_point_lookup(spark, sf):
    """First record of one id (the largest id present)."""
    from cohortlens.sources.tables import read_table
    df = level_panel(spark, sf)
    # The panel's ids are the order customers: take the largest straight from the scan.
    top = read_table(spark, sf, "orders").agg(F.max("o_custkey")).scalar()
    return A.lookup(df.withColumn("__top", top), "RA", F.col("__top")).drop("__top")


@register("level_options", f"""WITH {LEVEL_PANEL_SQL}
SELECT DISTINCT PEDRA FROM panel_lvl WHERE PEDRA IS NOT NULL""")
def q_level_options(spark, sf):
    """Sorted distinct options of a category."""
    df = level_panel(spark, sf)
    return df.where(F.col("PEDRA").isNotNull()).select("PEDRA").distinct().orderBy("PEDRA")


@register("first_named_record", f"""WITH {NAMED_PANEL_SQL}
SELECT RA, ano, NOME FROM panel_named WHERE NOME IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY RA ORDER BY ano) = 1""")
def q_first_named(spark, sf):
    """Keep-first dedup by id among named rows (the name lookup table)."""
    return A.first_per_entity(named_panel(spark, sf), require="NOME").select("RA", "ano", "NOME")


@register("compare_periods", f"WITH {LEVEL_PANEL_SQL},"
          f"{_drift_long_sql(K.DRIFT_FEATURES, last_only=True)}{_drift_table_sql('auto')}," + """
sm AS (SELECT cmp, count(*) AS n_total_features, count(*) FILTER (WHERE drift_detected) AS n_drifted_features,
              round(CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*), 4) AS drift_share,
              CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) >= 0.5 AS dataset_drift,
              CAST(0.5 AS DOUBLE) AS drift_threshold,
              CAST(count(*) FILTER (WHERE drift_detected) AS DOUBLE) / count(*) > 0.5 AS above_threshold
       FROM dt GROUP BY cmp),
sz AS (SELECT CAST((SELECT ref FROM yrs) AS VARCHAR) || '_vs_' || CAST((SELECT last FROM yrs) AS VARCHAR) AS cmp,
              count(*) FILTER (WHERE ano = (SELECT ref FROM yrs)) AS n_ref_rows,
              count(*) FILTER (WHERE ano = (SELECT last FROM yrs)) AS n_cur_rows
       FROM panel_lvl WHERE ano IN ((SELECT ref FROM yrs), (SELECT last FROM yrs)))
SELECT sz.cmp, n_ref_rows, n_cur_rows, n_total_features, n_drifted_features, drift_share, dataset_drift,
       drift_threshold, above_threshold,
       CASE WHEN n_ref_rows = 0 OR n_cur_rows = 0 THEN 'Dados insuficientes' END AS error
FROM sz LEFT JOIN sm ON sz.cmp = sm.cmp""")
def q_compare_periods(spark, sf):
    """K3: first vs last period with the insufficient-data guard."""
    ys = panel_years(spark, sf)
    df = level_panel(spark, sf, years=[ys[0], ys[-1]])
    return D.compare_periods(df, ys[0], ys[-1], K.DRIFT_FEATURES).select(
        "cmp", "n_ref_rows", "n_cur_rows", "n_total_features", "n_drifted_features", "drift_share",
        "dataset_drift", "drift_threshold", "above_threshold", "error")


@register("best_k")
def q_best_k(spark, sf):
    """H5: the k with the best silhouette from the k search."""
    ks = k_search_table(spark, sf)
    return ks.agg(F.max_by("k", "silhouette").alias("best_k"), F.max("silhouette").alias("silhouette"))


# ============================================================ secondary panel: events (G1, G3, G5, G6, skew-safe)

EVENT_MIN_HOT_ROWS = 64   # low, so that the test tables have hot users
EVENT_CHUNKS = 8


@register("event_running_stats", """
SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS n_seq, value - lag(value) OVER w AS delta_value,
       round(avg(value) OVER wr, 9) AS value_media_hist, min(value) OVER wr AS value_min_hist,
       max(value) OVER wr AS value_max_hist, round(sum(value) OVER wr, 9) AS value_soma_hist,
       count(*) OVER (PARTITION BY user_id) AS n_total,
       round(CASE WHEN count(value) OVER (PARTITION BY user_id) < 2 THEN 0.0
                  ELSE coalesce(regr_slope(value, epoch_us(ts) / 86400000000.0) OVER (PARTITION BY user_id), 0.0)
             END, 6) + 0.0 AS tendencia_value
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
       wr AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_event_running_stats(spark, sf):
    """Per-user running statistics and value trend (per day) of event values,
    hot users split in time chunks (G1, G2, G3, G5, G6 on the secondary panel)."""
    from cohortlens.operators.skew import running_value_stats
    from cohortlens.plans.panel import events_panel
    ev = events_panel(spark, sf)
    out = running_value_stats(ev, "user_id", "ts", "value", tiebreak=["event_id"], min_hot_rows=EVENT_MIN_HOT_ROWS,
                              n_chunks=EVENT_CHUNKS, slope=True)
    return out.select("user_id", "event_id", F.col("n_seq").cast("int").alias("n_seq"), "delta_value",
                      r9("value_media_hist").alias("value_media_hist"), "value_min_hist", "value_max_hist",
                      r9("value_soma_hist").alias("value_soma_hist"), "n_total",
                      r6("tendencia_value").alias("tendencia_value"))



_HALF_SQL = """
WITH half AS (SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id, event_id, ts, value, length(event_type) % 4 * 1.0::DOUBLE AS code,
  CASE WHEN event_id % 50 = 7 THEN event_type || event_id::VARCHAR END AS name FROM events),
steps AS (SELECT *, coalesce(abs(code - lag(code) OVER w), 0.0) AS pedras_mudadas FROM half WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(CASE WHEN count(value) OVER wr < 2 THEN 0.0 ELSE coalesce(regr_slope(value, epoch_us(ts) / 86400000000.0 - 8766) OVER wr, 0.0) END, 4) + 0.0
    AS tendencia_value_asof,
  pedras_mudadas, sum(pedras_mudadas) OVER wr AS pedras_mudadas_total, CASE WHEN lead(code) OVER w < code THEN 1.0::DOUBLE WHEN lead(code) OVER w >= code THEN 0.0 END AS {target},
  first_value(name IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS name
FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
  wr AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace("{target}", K.TARGET_COL)


@register("event_entity_features", _HALF_SQL)
def q_event_entity_features(spark, sf):
    """G2 as of a row, G4, G8 and G9 where one user has half of the rows: hot users in time chunks."""
    from cohortlens.operators.skew import entity_features
    from cohortlens.plans.panel import events_panel
    ev = events_panel(spark, sf).select(
        F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("long").alias("user_id"), "event_id", "ts", "value",
        (F.length("event_type") % 4).cast("double").alias("code"),
        F.when(F.col("event_id") % 50 == 7, F.concat("event_type", F.col("event_id").cast("string"))).alias("name"))
    out = entity_features(ev, "user_id", "ts", ["event_id"], "value", "code", "name", EVENT_MIN_HOT_ROWS, EVENT_CHUNKS)
    return out.select("user_id", "event_id", F.round("tendencia_value_asof", 4).alias("tendencia_value_asof"), "pedras_mudadas",
                      "pedras_mudadas_total", K.TARGET_COL, "name")


_LINE_SQL = """concat_ws(';', o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE '"' || o_orderpriority || ';x"' END,
  CASE WHEN o_orderkey % 89 = 3 THEN 'extra' END)"""


def _csv_orders(spark, sf) -> str:
    """``orders`` as a CSV folder with a quoted separator in a field, some lines with a field too few or too many."""
    import uuid
    from cohortlens.session import ensure_checkpoint_dir
    from cohortlens.sources.tables import read_table
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/orders-csv-{uuid.uuid4().hex[:12]}"
    lines = read_table(spark, sf, "orders").selectExpr(f"{_LINE_SQL} AS value")
    lines.withColumnRenamed("value", "PEDIDO;CLIENTE;PRIORIDADE").write.options(header=True, sep="\u0001", quote="", escapeQuotes=False).csv(path)
    return path


@register("csv_rejects", f"""WITH l AS (SELECT {_LINE_SQL} AS text, (o_orderkey % 97 = 5) AS few, (o_orderkey % 89 = 3) AS many FROM orders)
SELECT text, CASE WHEN few THEN 'too few fields: 2 of 3' ELSE 'too many fields: 4 of 3' END AS reason FROM l WHERE few <> many""")
def q_csv_rejects(spark, sf):
    """A1: records that do not fit the header."""
    from cohortlens.sources.csv_years import read_csv_checked
    return read_csv_checked(spark, _csv_orders(spark, sf), multi_line=False)[1].select("text", "reason")


@register("csv_checked_rows", """SELECT o_orderkey AS PEDIDO, o_custkey AS CLIENTE,
  CASE WHEN o_orderkey % 97 = 5 THEN 'extra' ELSE o_orderpriority || ';x' END AS PRIORIDADE FROM orders WHERE (o_orderkey % 97 = 5) = (o_orderkey % 89 = 3)""")
def q_csv_checked_rows(spark, sf):
    """A1: the other records with inferred types (a field too few and one too many make three again)."""
    from cohortlens.sources.csv_years import infer_types, read_csv_checked
    return infer_types(read_csv_checked(spark, _csv_orders(spark, sf), multi_line=False)[0])


@register("harmonize_from_csv", None)
def q_harmonize_from_csv(spark, sf):
    """A1-A3 + B7: yearly tables written as ';' CSV files, loaded back with
    type inference (missing files skipped), harmonised and unioned."""
    import uuid
    from cohortlens.operators.schema import harmonize
    from cohortlens.plans.raw_years import write_year_csvs
    from cohortlens.session import ensure_checkpoint_dir
    from cohortlens.sources.csv_years import load_years
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv_years-{uuid.uuid4().hex[:12]}"
    paths = write_year_csvs(_raw(spark, sf), base)
    return harmonize(load_years(spark, paths))


def _register_csv_sql():
    from cohortlens.plans.raw_years import YEARS_SQL
    ORACLE["harmonize_from_csv"] = f"WITH {YEARS_SQL}" + HARMONIZED_SQL.replace(
        "CAST(RA % 8 + 1 AS INTEGER)", "CAST(RA % 8 + 1 AS BIGINT)")


_register_csv_sql()



@register("modeling_matrix", f"""{TARGET_SQL}
SELECT {", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" if c != "tendencia_INDE"
                  else f"round(coalesce({c}, 0.0), 6) + 0.0 AS {c}" for c in K.RISK_FEATURES)}, {K.TARGET_COL}
FROM tt WHERE {K.TARGET_COL} IS NOT NULL""")
def q_modeling_matrix(spark, sf):
    """Rows with a target, all-NULL features dropped, remaining NULLs -> 0."""
    from cohortlens.operators.models import prepare_for_modeling
    m = prepare_for_modeling(target_panel(spark, sf), K.RISK_FEATURES)
    return m.select(*[F.col(c).cast("double").alias(c) if c != "tendencia_INDE" else r6(c).alias(c)
                      for c in K.RISK_FEATURES], K.TARGET_COL)


# ============================================================ 7. Spark ML (rows-only checks)

_MODELS: dict = {}


def _model_key(kind: str, spark: SparkSession, sf: str) -> tuple:
    """Kind, session and the state of the table that the panel reads: a table written anew is trained on anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/orders.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [fs.getFileStatus(path), *fs.listStatus(path)]
    return kind, id(spark), sf, max(f.getModificationTime() for f in files), sum(f.getLen() for f in files)


def risk_model(spark: SparkSession, sf: str):
    """Train once per session and table set."""
    from cohortlens.operators import models as ML
    key = _model_key("risk", spark, sf)
    if key not in _MODELS:
        _MODELS[key] = ML.train_risk_classifier(target_panel(spark, sf))
    return _MODELS[key]


def profile_model(spark: SparkSession, sf: str):
    """Train once per session and table set."""
    from cohortlens.operators import models as ML
    key = _model_key("profile", spark, sf)
    if key not in _MODELS:
        _MODELS[key] = ML.train_profiles(latest_complete(spark, sf))
    return _MODELS[key]


@register("risk_train_score")
def q_risk_train_score(spark, sf):
    return risk_model(spark, sf).metrics


@register("importance_topk")
def q_importance_topk(spark, sf):
    from cohortlens.operators import models as ML
    return ML.importance_topk(risk_model(spark, sf).importances, 10)


@register("importance_top3")
def q_importance_top3(spark, sf):
    """H4: the three most important features (as in a single-request response)."""
    from cohortlens.operators import models as ML
    return ML.importance_topk(risk_model(spark, sf).importances, 3)


@register("risk_scoring")
def q_risk_scoring(spark, sf):
    """Every valid request -> cold-start features -> probability, tier, class."""
    from cohortlens.operators import models as ML
    feats = CL.risk_request_features(Q.split_valid(request_view(spark, sf))[0])
    return ML.score_risk(risk_model(spark, sf), feats)


@register("risk_high_count")
def q_risk_high_count(spark, sf):
    """latest non-null record per entity, complete cases, p >= 0.7."""
    from cohortlens.operators import models as ML
    latest = A.latest_nonnull(temporal_panel(spark, sf).select("RA", "ano", *K.RISK_FEATURES))
    return ML.high_risk_count(risk_model(spark, sf), latest)


@register("kmeans_assign")
def q_kmeans_assign(spark, sf):
    from cohortlens.operators import models as ML
    pm = profile_model(spark, sf)
    return ML.assign_profiles(pm, latest_complete(spark, sf)).select("RA", "cluster_id", "cluster_nome")


@register("cluster_distribution")
def q_cluster_distribution(spark, sf):
    """named cluster counts over the latest complete records."""
    from cohortlens.operators import models as ML
    pm = profile_model(spark, sf)
    a = ML.assign_profiles(pm, latest_complete(spark, sf))
    return a.groupBy("cluster_nome").agg(F.count(F.lit(1)).alias("n"))


@register("profile_quality")
def q_profile_quality(spark, sf):
    from cohortlens.operators import models as ML
    return ML.profile_quality(profile_model(spark, sf))


def k_search_table(spark: SparkSession, sf: str) -> DataFrame:
    """J9 once per session and table set (shared by k_search and best_k)."""
    from cohortlens.operators import models as ML
    key = _model_key("k_search", spark, sf)
    if key not in _MODELS:
        _MODELS[key] = ML.k_search(latest_complete(spark, sf), max_k=10)
    return _MODELS[key]


@register("k_search")
def q_k_search(spark, sf):
    return k_search_table(spark, sf)


@register("profile_scoring")
def q_profile_scoring(spark, sf):
    """Every valid request -> zero-filled profile features -> cluster + name."""
    from cohortlens.operators import models as ML
    req = CL.cluster_request_features(Q.split_valid(request_view(spark, sf))[0])
    return ML.assign_profiles(profile_model(spark, sf), req).select("aluno_id", "ano", "cluster_id", "cluster_nome")


@register("listing_with_clusters")
def q_listing_with_clusters(spark, sf):
    """Listing rows with a profile name on complete cases, NULL otherwise."""
    from cohortlens.plans.pipelines import listing_of
    return listing_of(G.temporal_features(named_panel(spark, sf)), profile_model(spark, sf))


# Scoring from stored models whose numbers follow from the data, so that SQL can say the same.


def _stored(spark, model, name: str):
    """The model written to the shared folder and read again."""
    import uuid
    from cohortlens.session import ensure_checkpoint_dir
    from cohortlens.sources import sinks
    return sinks.load_model(spark, sinks.save_model(spark, model, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"))


def _stump_model(spark, sf):
    """Two trees of one split each, at the panel's mean index and engagement; a missing index goes left, a missing engagement right."""
    import numpy as np
    from cohortlens.operators.boosting import BoostedTrees, Tree
    from cohortlens.operators.models import RiskModel
    m = level_panel(spark, sf).agg(F.avg("INDE").alias("a"), F.avg("IEG").alias("e")).first()
    trees = [Tree(np.array([f, -1, -1]), np.zeros(3, "i8"), np.array([left, False, False]), np.array([0.0, lo, hi]), np.array([1.0, 0.0, 0.0]))
             for f, left, lo, hi in ((0, True, 1.1, -0.7), (1, False, -0.3, 0.25))]
    model = _stored(spark, BoostedTrees(["INDE", "IEG"], [np.array([round(m.a or 0.0, 6)]), np.array([round(m.e or 0.0, 6)])], trees, 1), "stumps")
    return RiskModel(model, model.features, None, None, None)


def _stump_sql(source: str) -> str:
    return f"""WITH {LEVEL_PANEL_SQL},
last AS (SELECT RA, arg_max(INDE, ano) FILTER (WHERE INDE IS NOT NULL) AS INDE, arg_max(IEG, ano) FILTER (WHERE IEG IS NOT NULL) AS IEG FROM panel_lvl GROUP BY RA),
means AS (SELECT round(avg(INDE), 6) AS a, round(avg(IEG), 6) AS e FROM panel_lvl),
scored AS (SELECT s.*, 1.0 / (1.0 + exp(-((CASE WHEN INDE > a THEN -0.7 ELSE 1.1 END) + (CASE WHEN IEG <= e THEN -0.3 ELSE 0.25 END)))) AS p FROM {source} s, means)"""


@register("stored_trees_scoring", f"""{_stump_sql("panel_lvl")}
SELECT RA, ano, round(p, 9) AS risco_probabilidade, CASE WHEN p >= {K.RISK_THRESHOLD_HIGH} THEN '{K.RISK_LABELS[0]}'
  WHEN p >= {K.RISK_THRESHOLD_MEDIUM} THEN '{K.RISK_LABELS[1]}' ELSE '{K.RISK_LABELS[2]}' END AS risco_classe, p >= 0.5 AS vai_cair FROM scored""")
def q_stored_trees_scoring(spark, sf):
    """Probability, tier and class by a stored tree model."""
    from cohortlens.operators import models as ML
    scored = ML.score_risk(_stump_model(spark, sf), level_panel(spark, sf), keep=("RA", "ano"))
    return scored.withColumn("risco_probabilidade", r9("risco_probabilidade"))


@register("stored_trees_high_count", f"""{_stump_sql("last")}
SELECT count(*) FILTER (WHERE p >= {K.RISK_THRESHOLD_HIGH}) AS risco_alto, count(*) AS n_avaliados FROM scored WHERE INDE IS NOT NULL AND IEG IS NOT NULL""")
def q_stored_trees_high_count(spark, sf):
    """F5 by the stored tree model."""
    from cohortlens.operators import models as ML
    latest = A.latest_nonnull(level_panel(spark, sf).select("RA", "ano", "INDE", "IEG"))
    return ML.high_risk_count(_stump_model(spark, sf), latest)


def _level_centres(spark, sf):
    """One centre a level: the mean of its entities' standardised latest records."""
    import numpy as np
    from cohortlens.operators.lloyd import Centres
    feats = K.CLUSTER_FEATURES
    lat = latest_complete(spark, sf)
    m = lat.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(feats)], *[F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(feats)]).first()
    means, devs = [[round(m[f"{x}{k}"] or 0.0, 6) for k in range(len(feats))] for x in "ms"]
    frame = Centres(feats, means, devs, np.zeros((0, len(feats))))
    rows = lat.where("PEDRA_CODIGO IS NOT NULL").groupBy("PEDRA_CODIGO").agg(*[F.round(F.avg(z), 6).alias(f"z{k}") for k, z in enumerate(frame.scaled())])
    centres = [[r[f"z{k}"] for k in range(len(feats))] for r in rows.orderBy("PEDRA_CODIGO").collect()]   # one row a level
    return _stored(spark, Centres(feats, means, devs, np.array(centres).reshape(-1, len(feats))), "centres")


def _centre_sql() -> str:
    feats = K.CLUSTER_FEATURES
    each = lambda form: ", ".join(form.format(k=k, c=c) for k, c in enumerate(feats))
    gap = " + ".join(f"(z{k} - c{k}) * (z{k} - c{k})" for k in range(len(feats)))
    return f"""WITH {LATEST_CC_SQL},
st AS (SELECT {each("round(avg({c}), 6) AS m{k}, round(stddev_samp({c}), 6) AS s{k}")} FROM latcc),
zs AS (SELECT RA, PEDRA_CODIGO, {each("(CASE WHEN s{k} > 0 THEN ({c} - m{k}) / s{k} ELSE 0.0 END) AS z{k}")} FROM latcc, st),
ce AS (SELECT CAST(row_number() OVER (ORDER BY PEDRA_CODIGO) - 1 AS INTEGER) AS cluster_id, * EXCLUDE (PEDRA_CODIGO) FROM (
  SELECT PEDRA_CODIGO, {each("round(avg(z{k}), 6) AS c{k}")} FROM zs WHERE PEDRA_CODIGO IS NOT NULL GROUP BY 1)),
near AS (SELECT RA, arg_min(cluster_id, {gap}) AS cluster_id FROM zs, ce GROUP BY RA)"""


@register("stored_centres_assign", _centre_sql() + "\nSELECT RA, cluster_id FROM near")
def q_stored_centres_assign(spark, sf):
    """The nearest of the stored centres."""
    return _level_centres(spark, sf).transform(latest_complete(spark, sf)).select("RA", "cluster_id")


@register("stored_centres_distribution", _centre_sql() + "\nSELECT cluster_id, count(*) AS n FROM near GROUP BY cluster_id")
def q_stored_centres_distribution(spark, sf):
    """F6 over the stored centres."""
    return _level_centres(spark, sf).transform(latest_complete(spark, sf)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


# Sinks, each written and read back.


@register("json_records", f"""WITH {LEVEL_PANEL_SQL}
SELECT RA, ano, round(INDE, 2) AS INDE, round(IEG, 2) AS IEG, PEDRA FROM panel_lvl""")
def q_json_records(spark, sf):
    """Records as JSON; floats have two digits."""
    import uuid
    from cohortlens.session import ensure_checkpoint_dir
    from cohortlens.sources import sinks
    rows = level_panel(spark, sf).select("RA", "ano", "INDE", "IEG", "PEDRA")
    path = sinks.write_records_json(rows, f"{ensure_checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex[:12]}")
    return spark.read.schema("RA long, ano int, INDE double, IEG double, PEDRA string").json(path)


@register("drift_report_tables", f"WITH {LEVEL_PANEL_SQL},{_drift_long_sql(K.DRIFT_FEATURES, last_only=True)}{_drift_table_sql('ks')}\nSELECT * FROM dt")
def q_drift_report_tables(spark, sf):
    """The report's feature table."""
    import uuid
    from cohortlens.session import ensure_checkpoint_dir, cut_lineage
    from cohortlens.sources import sinks
    table = cut_lineage(D.drift_table(_drift_long(spark, sf, K.DRIFT_FEATURES, last_only=True), "ks"))
    path = sinks.write_drift_report(D.drift_summary(table), table, f"{ensure_checkpoint_dir(spark).rstrip('/')}/drift-{uuid.uuid4().hex[:12]}")
    return spark.read.parquet(f"{path}/features")


@register("published_run", f"""WITH {LEVEL_PANEL_SQL},
m AS (SELECT count(*)::DOUBLE AS n, round(avg(INDE), 9) AS mean_inde FROM panel_lvl),
v AS (SELECT 'linhas' AS metric, n AS value FROM m UNION ALL SELECT 'inde_medio', mean_inde FROM m),
l AS (SELECT DISTINCT CAST(PEDRA_CODIGO AS INTEGER) AS cluster_id, PEDRA AS cluster_nome FROM panel_lvl WHERE PEDRA IS NOT NULL)
SELECT 'panel' AS run_name, metric, value, NULL::INTEGER AS cluster_id, NULL::VARCHAR AS cluster_nome FROM v
UNION ALL SELECT NULL, NULL, NULL, cluster_id, cluster_nome FROM l""")
def q_published_run(spark, sf):
    """A run published twice under one id; its metrics, which count once, and the current labels."""
    import uuid
    from cohortlens.session import cut_lineage, ensure_checkpoint_dir
    from cohortlens.sources import sinks
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/published-{uuid.uuid4().hex[:12]}"
    panel = level_panel(spark, sf)
    labels = cut_lineage(panel.where("PEDRA IS NOT NULL").select(F.col("PEDRA_CODIGO").cast("int").alias("cluster_id"), F.col("PEDRA").alias("cluster_nome")).distinct())
    m = panel.agg(F.count(F.lit(1)).alias("n"), r9(F.avg("INDE")).alias("mean")).first()
    model = _stump_model(spark, sf).model
    for _ in range(2):
        sinks.publish_run(spark, base, "r1", {"classifier": model}, {"cluster_labels": labels}, {"panel": {"linhas": m.n, "inde_medio": m.mean}})
    names = sinks.read_published_table(spark, base, "cluster_labels")
    return sinks.read_metrics(spark, base).select("run_name", "metric", "value").unionByName(names, allowMissingColumns=True)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Panel -> temporal features -> drop target -> per-year mean index and target rate."""
    df = G.drop_target(temporal_panel(spark, sf))
    return (df.groupBy("ano")
            .agg(F.count(F.lit(1)).alias("n_registros"),
                 F.round(F.avg("INDE"), 2).alias("inde_medio"),
                 F.round(F.avg("delta_INDE"), 4).alias("delta_inde_medio"),
                 F.round(F.avg(K.TARGET_COL), 4).alias("taxa_queda"))
            .orderBy("ano"))
