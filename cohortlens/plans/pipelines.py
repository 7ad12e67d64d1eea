"""User-level pipelines (survey N1-N10) as compositions of the operators.

Each returns DataFrames (lazy) or writes through the sinks; nothing is
collected except bounded model metadata.  ``source`` is the user's own data:
``{year: path}`` of yearly CSV files, or a panel DataFrame with one row per
entity and year.  A string is a folder of the tables the panel views read
(see ``plans.panel``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import aggregates as A
from cohortlens.operators import cleaning as CL
from cohortlens.operators import drift as D
from cohortlens.operators import models as ML
from cohortlens.operators import quality as Q
from cohortlens.operators import reports
from cohortlens.operators import schema as S
from cohortlens.operators import temporal as G
from cohortlens.plans import catalog
from cohortlens.sources import sinks
from cohortlens.sources.csv_years import load_years
from cohortlens.sources.tables import nan_to_null


Source = str | Mapping[int, str] | DataFrame


def processed_panel(spark: SparkSession, source: Source) -> DataFrame:
    """Yearly tables -> harmonise -> level normalisation -> temporal features."""
    if isinstance(source, str):
        return catalog.temporal_panel(spark, source)
    panel = source if isinstance(source, DataFrame) else S.harmonize(load_years(spark, source))
    return G.temporal_features(S.normalize_level_column(nan_to_null(panel)))


def latest_profiles(panel: DataFrame) -> DataFrame:
    """Latest non-null record per entity, complete on the profile features."""
    latest = A.latest_nonnull(panel.select(K.ID_COL, K.TIME_COL, *K.CLUSTER_FEATURES, "PEDRA_CODIGO"))
    return latest.drop(K.TIME_COL).dropna(subset=K.CLUSTER_FEATURES)


def train_all(spark: SparkSession, source: Source, out_dir: str, gbt_iter: int = 200,
              n_init: int = ML.KMEANS_N_INIT, run_id: str = "latest") -> dict:
    """Features + target -> risk classifier; latest records -> profiles;
    models, cluster labels and run metrics published together under ``out_dir``."""
    panel = processed_panel(spark, source)
    risk = ML.train_risk_classifier(G.drop_target(panel), max_iter=gbt_iter)
    prof = ML.train_profiles(latest_profiles(panel), n_init=n_init)
    rm = sinks.metrics_row_to_dict(risk.metrics)
    pq = sinks.metrics_row_to_dict(ML.profile_quality(prof))
    sinks.publish_run(spark, out_dir, run_id, {"classifier": risk.model, "profiles": prof.model},
                      {"cluster_labels": prof.names.join(prof.profile, "cluster_id", "left")},
                      {"risk_classifier": {k: rm.get(k) for k in ("f1", "precision", "recall", "roc_auc")},
                       "profiles": {"silhouette": pq.get("silhouette"), "davies_bouldin": pq.get("davies_bouldin")}})
    return {"risk": risk, "profiles": prof, "risk_metrics": rm, "profile_metrics": pq}


def dashboard(spark: SparkSession, source: Source) -> dict[str, DataFrame]:
    """KPIs, level distribution, mean index per year."""
    panel = processed_panel(spark, source)
    latest = A.latest_nonnull(panel.select("RA", "ano", "INDE", "PEDRA"))
    return {"kpis": A.dashboard_kpis(panel), "levels": A.value_distribution(latest, "PEDRA"),
            "index_by_year": A.mean_by_period(panel, "INDE")}


def listing_of(panel: DataFrame, profiles: ML.ProfileModel | None = None) -> DataFrame:
    """N4 / J15 of a processed panel: listing rows, with a profile name on complete cases (NULL otherwise) given a model."""
    out = A.propagate_first_name(panel) if "NOME" in panel.columns else panel
    if profiles is not None:
        out = ML.assign_profiles(profiles, out).withColumnRenamed("cluster_nome", "cluster").drop("scaled", "cluster_id")
    return A.listing_order(A.round_records(S.listing_projection(out)))


def listing(spark: SparkSession, source: Source, year: int | None = None, profiles: ML.ProfileModel | None = None) -> DataFrame:
    """Entity listing (optionally one period, optionally with profiles)."""
    if isinstance(source, str) and profiles is None:
        return catalog.entity_listing(spark, source, year)
    return listing_of(A.filter_equals(processed_panel(spark, source), K.TIME_COL, year), profiles)


def drift_across_years(spark: SparkSession, source: Source) -> tuple[DataFrame, DataFrame]:
    """First period against every later one."""
    return D.all_periods_vs_first(processed_panel(spark, source), K.DRIFT_FEATURES)


def data_quality(spark: SparkSession, source: Source, year: int | None = None) -> dict[str, DataFrame]:
    """Quality summary, feature stats, rows per period (optional period filter)."""
    panel = A.filter_equals(processed_panel(spark, source), "ano", year)
    return {"summary": Q.quality_summary(panel), "features": Q.feature_stats(panel),
            "per_year": Q.rows_per_period(panel)}


def drift_with_stats(spark: SparkSession, source: Source) -> dict[str, DataFrame]:
    """First vs last period on complete cases: drift, descriptive stats, text."""
    panel = processed_panel(spark, source)
    ys = D.years_of(panel)
    table = D.drift_table(D.long_periods(panel, K.DRIFT_FEATURES, ys[0], [ys[-1]], complete_cases=True))
    stats = A.two_period_stats(panel, K.DRIFT_FEATURES, ys[0], ys[-1])
    return {"summary": D.drift_summary(table), "features": table, "stats": stats,
            "text": D.drift_lines(table, stats)}


def score_risk_requests(requests: DataFrame, model: ML.RiskModel) -> DataFrame:
    """Validate -> cold-start features -> probability, tier, class."""
    ok, _ = Q.split_valid(requests)
    return ML.score_risk(model, CL.risk_request_features(ok))


def score_profile_requests(requests: DataFrame, model: ML.ProfileModel) -> DataFrame:
    """Validate -> zero-filled profile features -> cluster and name."""
    ok, _ = Q.split_valid(requests)
    return ML.assign_profiles(model, CL.cluster_request_features(ok))


def latest_report_fields(panel: DataFrame) -> DataFrame:
    """Each entity's latest record under the report's field names."""
    named = A.propagate_first_name(panel) if "NOME" in panel.columns else panel.withColumn("NOME", F.lit(None).cast("string"))
    last = A.latest_row(named)
    known = [F.col(c).alias(c.lower()) for c in ("INDE", "IEG", "IDA", "IPS", "IAA", "IAN", "IPV", "IPP") if c in panel.columns]
    return last.select(K.ID_COL, F.col("NOME").alias("nome"), F.col("PEDRA").alias("pedra"), *known, "anos_no_programa",
                       F.col("tendencia_INDE").alias("tendencia_num"))


def prompts_of_latest(latest: DataFrame, risk: ML.RiskModel, profiles: ML.ProfileModel, template: str = reports.REPORT_TEMPLATE) -> DataFrame:
    """Both models in one chain over the latest records, then defaults and the prompt."""
    scored = ML.score_requests(latest.withColumn("tendencia_inde", F.col("tendencia_num")), risk, profiles)
    rows = scored.withColumn("risco_percentual", F.col("risco_probabilidade") * 100)
    return reports.render_prompts(reports.report_rows(rows), template).select(K.ID_COL, "risco_classe", "cluster_nome", "prompt")


def report_dataset(spark: SparkSession, source: Source, risk: ML.RiskModel | None = None, profiles: ML.ProfileModel | None = None,
                   template: str = reports.REPORT_TEMPLATE) -> DataFrame:
    """Latest record + risk + profile -> defaults -> prompt per entity; models that are not given are trained on the source."""
    if isinstance(source, str) and risk is None and profiles is None:
        return catalog.q_report_prompts_scored(spark, source)
    panel = processed_panel(spark, source)
    risk = risk or ML.train_risk_classifier(G.drop_target(panel))
    profiles = profiles or ML.train_profiles(latest_profiles(panel))
    return prompts_of_latest(latest_report_fields(panel), risk, profiles, template)


__all__ = ["latest_profiles", "processed_panel", "train_all", "dashboard", "listing", "drift_across_years", "data_quality",
           "drift_with_stats", "score_risk_requests", "score_profile_requests", "report_dataset", "listing_of", "latest_report_fields", "prompts_of_latest"]
