"""Registered queries vs their DuckDB oracle SQL on sf0.01 (the driver's gate).

A representative subset runs by default; ``FULL_ORACLE=1`` runs all of them.
"""

import os

import pytest

import __spark_entry__ as E
from conftest import SF01

SUBSET = ["temporal_features", "drop_target", "trend_slope_asof", "extract_level", "clean_numeric",
          "impute_median", "impute_mode", "validate_rows", "latest_nonnull", "dashboard_kpis", "quality_summary",
          "feature_stats", "entity_listing", "harmonize_union", "schema_matrix", "drift_auto", "drift_summary",
          "roc_auc", "silhouette_sq", "davies_bouldin", "cluster_names", "report_prompts", "report_header_strip",
          "compare_periods"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("FULL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def duck():
    from scripts.check_oracle import duck as make
    return make(SF01)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    from scripts.check_oracle import compare
    ok, msg = compare(name, spark, duck, SF01)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
