"""Spark ML invariants (ranges, no leakage, naming order, cost vs k)."""

import pytest
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import models as ML
from cohortlens.plans import catalog

from conftest import SF001


@pytest.fixture(scope="module")
def risk(spark):
    return ML.train_risk_classifier(catalog.target_panel(spark, SF001), max_iter=5)


def test_risk_metrics_ranges(risk):
    m = risk.metrics.first()
    for c in ("precision", "recall", "f1"):
        assert 0.0 <= m[c] <= 1.0
    assert m["roc_auc"] is None or 0.0 <= m["roc_auc"] <= 1.0
    assert m["positive"] + m["negative"] > 0


def test_no_entity_on_both_sides(spark):
    sp = catalog.q_group_split(spark, SF001)
    both = sp.groupBy("RA").agg(F.countDistinct("split").alias("n")).where("n > 1")
    assert both.count() == 0


def test_importances_sorted_topk(risk):
    top = ML.importance_topk(risk.importances, 3).collect()
    assert len(top) == 3
    assert [r["importance"] for r in top] == sorted([r["importance"] for r in top], reverse=True)
    assert {r["feature"] for r in top} <= set(K.RISK_FEATURES)


def test_batch_scoring_any_n(spark, risk):
    feats = catalog.CL.risk_request_features(catalog.request_view(spark, SF001))
    out = ML.score_risk(risk, feats)
    assert out.count() == feats.count()
    bad = out.where((F.col("risco_probabilidade") < 0) | (F.col("risco_probabilidade") > 1))
    assert bad.count() == 0
    tiers = {r["risco_classe"] for r in out.select("risco_classe").distinct().collect()}
    assert tiers <= {"ALTO", "MEDIO", "BAIXO"}


@pytest.fixture(scope="module")
def profiles(spark):
    return ML.train_profiles(catalog.latest_complete(spark, SF001), n_init=2, max_iter=50)


def test_profiles_named_in_score_order(profiles):
    names = profiles.names.orderBy("score").collect()
    assert [r["cluster_nome"] for r in names] == K.CLUSTER_PROFILE_NAMES
    q = ML.profile_quality(profiles).first()
    assert -1.0 <= q["silhouette"] <= 1.0 and q["davies_bouldin"] >= 0


def test_profile_scoring_covers_requests(spark, profiles):
    req = catalog.CL.cluster_request_features(catalog.request_view(spark, SF001))
    out = ML.assign_profiles(profiles, req)
    assert out.where(F.col("cluster_nome").isNull()).count() == 0
    assert out.count() == req.count()


def test_k_search_cost_decreases(spark):
    ks = ML.k_search(catalog.latest_complete(spark, SF001), max_k=5, max_iter=50, n_init=2).orderBy("k").collect()
    assert [r["k"] for r in ks] == [2, 3, 4, 5]
    assert ks[-1]["cost"] < ks[0]["cost"]
