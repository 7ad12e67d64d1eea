"""Risk classifier and cohort profiles (survey J1-J15, F5, F6).

* Risk: boosted trees (``boosting``) -- depth 4, step .05, row sampling .8,
  80 % of features per tree, positive-class weight 3, seed 42 -- trained on
  the entity-hash train side (no entity on both sides), evaluated with the
  DataFrame metrics of ``metrics``.
* Profiles: standardised k-means (``lloyd``) on each entity's latest complete
  record; best of ``n_init`` seeds by training cost, all of them in the same
  passes; clusters named from their profile (``metrics.cluster_names``).
* Scoring is ``model.transform`` over any number of request rows; the
  cluster-name dimension has k rows and is broadcast.

Neither model depends on the partitioning or on a number of rows. Split rows,
scored test rows, profile assignments and names are written once: evaluation
and later scoring read them instead of the training panel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.scalars import risk_tier
from cohortlens.operators import boosting, lloyd
from cohortlens.operators import metrics as M
from cohortlens.operators.aggregates import attach_names
from cohortlens.session import cut_lineage, materialize

# Classifier hyper-parameters.
BOOST_PARAMS = boosting.BoostParams(trees=200, depth=4, rate=0.05, rows=0.8, features=0.8, seed=42)
POSITIVE_WEIGHT = 3.0
# K-means parameters.
KMEANS_K = 4
KMEANS_MAX_ITER = 300
KMEANS_N_INIT = 20
KMEANS_SEED = 42


@dataclass
class RiskModel:
    model: boosting.BoostedTrees
    features: list[str]
    metrics: DataFrame          # one row: precision, recall, f1, positive, negative, roc_auc
    importances: DataFrame      # (feature, importance) sorted desc
    test_scored: DataFrame


@dataclass
class ProfileModel:
    model: lloyd.Centres
    features: list[str]
    names: DataFrame            # (cluster_id, score, cluster_nome) -- k rows
    profile: DataFrame          # F15 per cluster
    assigned: DataFrame         # training rows with cluster_id
    cost: float


def prepare_for_modeling(df: DataFrame, features: Sequence[str], target: str = K.TARGET_COL) -> DataFrame:
    """Rows with a target; features that are entirely NULL dropped; NULL -> 0."""
    from cohortlens.operators.cleaning import drop_all_null_columns
    sub = df.where(F.col(target).isNotNull()).select(*features, target)
    sub = drop_all_null_columns(sub, list(features))
    keep = [f for f in features if f in sub.columns]
    return sub.fillna(0.0, subset=keep)


def train_risk_classifier(df: DataFrame, features: Sequence[str] = K.RISK_FEATURES,
                          target: str = K.TARGET_COL, id_col: str = K.ID_COL,
                          max_iter: int = BOOST_PARAMS.trees) -> RiskModel:
    """J2 -> J3 -> J4 -> J5."""
    from dataclasses import replace

    feats = [f for f in features if f in df.columns]
    data = M.group_split(df, feats, target, id_col).select(
        id_col, *[F.col(f).cast("double").alias(f) for f in feats],
        F.col(target).cast("double").alias("label"), "split")
    data = materialize(data.withColumn("w", F.when(F.col("label") == 1.0, POSITIVE_WEIGHT).otherwise(1.0)), "risk-split")
    model = boosting.fit(data.where("split = 'train'"), feats, "label", "w", replace(BOOST_PARAMS, trees=max_iter))
    test = model.transform(data.where("split = 'test'"))
    scored = materialize(test.select(id_col, F.col("label").cast("int").alias("label"),
                                     F.col("prediction").cast("int").alias("prediction"), "score"), "risk-test")
    metrics = cut_lineage(M.weighted_metrics(M.confusion(scored)).withColumn("roc_auc", M.roc_auc(scored).select("roc_auc").scalar()))
    importances = df.sparkSession.createDataFrame(model.importances(), "feature string, importance double").orderBy(F.desc("importance"))
    return RiskModel(model, feats, metrics, importances, scored)


def importance_topk(importances: DataFrame, k: int = 10) -> DataFrame:
    """H3 / H4: the k most important features (TakeOrderedAndProject)."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def score_risk(model: RiskModel, features_df: DataFrame, keep: Sequence[str] = ("aluno_id", "ano")) -> DataFrame:
    """Probability of the positive class, tier (C7) and class at 0.5."""
    out = model.model.transform(features_df)
    p = F.col("score")
    return out.select(*[c for c in keep if c in features_df.columns],
                      p.alias("risco_probabilidade"), risk_tier(p).alias("risco_classe"),
                      (F.col("prediction") == 1.0).alias("vai_cair"))


def score_requests(requests: DataFrame, risk: RiskModel | None, profiles: ProfileModel | None) -> DataFrame:
    """J7, J14, J15 in one chain without a join of the requests with themselves: the requests' own columns, unchanged, with
    cluster_id and cluster_nome (features of C11) and risco_probabilidade, risco_classe and vai_cair (features of C9, C10)."""
    from cohortlens.operators import cleaning as CL

    def beside(df: DataFrame) -> DataFrame:
        return df.withColumn("__own", F.struct(*[F.col(f"`{c}`") for c in df.columns]))

    out = requests
    if profiles is not None:
        out = assign_profiles(profiles, CL.cluster_request_features(beside(out))).select("__own.*", "cluster_id", "cluster_nome")
    if risk is not None:
        scored = risk.model.transform(CL.risk_request_features(beside(out)))
        p = F.col("score")
        out = scored.select("__own.*", p.alias("risco_probabilidade"), risk_tier(p).alias("risco_classe"), (F.col("prediction") == 1.0).alias("vai_cair"))
    return out


def high_risk_count(model: RiskModel, latest: DataFrame, threshold: float = K.RISK_THRESHOLD_HIGH) -> DataFrame:
    """complete-case latest records with probability >= threshold."""
    feats = [f for f in model.features if f in latest.columns]
    cc = latest.dropna(subset=feats)
    for f in model.features:
        if f not in cc.columns:
            cc = cc.withColumn(f, F.lit(0.0))
    scored = model.model.transform(cc.select(*[F.col(f).cast("double").alias(f) for f in model.features]))
    return scored.agg(F.count_if(F.col("score") >= threshold).alias("risco_alto"),
                      F.count(F.lit(1)).alias("n_avaliados"))


# ------------------------------------------------------------------ profiles
def train_profiles(latest: DataFrame, features: Sequence[str] = K.CLUSTER_FEATURES, k: int = KMEANS_K,
                   max_iter: int = KMEANS_MAX_ITER, n_init: int = KMEANS_N_INIT, seed: int = KMEANS_SEED) -> ProfileModel:
    """J8 -> J10 -> F15 -> J12 (J13): best of ``n_init`` k-means starts by cost (ties: lowest seed), fitted together."""
    feats = list(features)
    points = lloyd.Points(latest, feats)
    starts = [(k, seed + i) for i in range(max(1, n_init))]
    best = lloyd.best_start(lloyd.fit_starts(points, starts, max_iter), starts, k)
    points.close()
    assigned = materialize(best.transform(latest.dropna(subset=feats)), "profiles")
    profile = cut_lineage(M.cluster_profile(assigned, "cluster_id", feats))
    return ProfileModel(best, feats, cut_lineage(M.cluster_names(profile)), profile, assigned, best.cost)


def assign_profiles(model: ProfileModel, df: DataFrame) -> DataFrame:
    """Scale with the fitted scaler, nearest centre, name."""
    out = model.model.transform(df)
    return attach_names(out, model.names.select("cluster_id", "cluster_nome"))


def profile_quality(model: ProfileModel) -> DataFrame:
    """J11 on the scaled training data: squared-Euclidean silhouette and
    Davies-Bouldin."""
    a = model.assigned
    sil = M.silhouette_sq(a, "cluster_id", vec_col="scaled", dim=len(model.features)).select("silhouette", "n_points")
    db = M.davies_bouldin(a, "cluster_id", vec_col="scaled", dim=len(model.features)).select(
        F.struct("davies_bouldin", "n_clusters")).scalar()
    return sil.withColumn("__db", db).select("silhouette", "n_points",
                                             F.col("__db.davies_bouldin").alias("davies_bouldin"),
                                             F.col("__db.n_clusters").alias("n_clusters"))


def k_search(latest: DataFrame, features: Sequence[str] = K.CLUSTER_FEATURES, max_k: int = 10,
             max_iter: int = KMEANS_MAX_ITER, seed: int = KMEANS_SEED, n_init: int = 10) -> DataFrame:
    """k = 2..max_k -> (k, silhouette, cost), each k the best of ``n_init`` starts by cost; all starts move in the same passes."""
    points = lloyd.Points(latest, features)
    starts = [(k, seed + i) for k in range(2, max_k + 1) for i in range(max(1, n_init))]
    fits = lloyd.fit_starts(points, starts, max_iter)
    ks = sorted({k for k, _ in starts}) if fits else []
    best = [lloyd.best_start(fits, starts, k) for k in ks]
    rated = lloyd.silhouettes(points, best)
    points.close()
    return latest.sparkSession.createDataFrame([(k, s, f.cost) for k, s, f in zip(ks, rated, best)], "k int, silhouette double, cost double")
