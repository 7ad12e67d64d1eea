"""Plan properties the scale design relies on."""

import __spark_entry__ as E
from cohortlens.plans.panel import level_panel, panel_years

from conftest import SF001


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_pushed_to_parquet(spark):
    last = panel_years(spark, SF001)[-1]
    plan = plan_of(level_panel(spark, SF001, years=[last]))
    scan = [l for l in plan.split("\n") if "PushedFilters" in l][0]
    assert "GreaterThanOrEqual(o_orderdate" in scan and "LessThan(o_orderdate" in scan


def test_panel_scan_is_column_pruned(spark):
    plan = plan_of(E.queries()["temporal_features"](spark, SF001))
    scan = [l for l in plan.split("\n") if "ReadSchema" in l][0]
    assert "o_orderkey" not in scan


def test_no_python_or_cartesian_nodes(spark):
    for name in ["temporal_features", "drift_auto", "roc_auc", "silhouette_sq", "zscore", "compare_periods",
                 "event_running_stats", "quality_summary", "report_header_strip"]:
        plan = plan_of(E.queries()[name](spark, SF001))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_top_one_per_entity_limits_before_shuffle(spark):
    plan = plan_of(E.queries()["latest_row"](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_yearly_tables_read_pruned_partitions(spark):
    from cohortlens.plans.raw_years import raw_year_tables
    tables = raw_year_tables(spark, SF001)
    y = min(tables)
    plan = plan_of(tables[y])
    assert "PartitionFilters: [isnotnull(ano" in plan and "Exchange" not in plan


def test_no_upstream_recomputation_under_aqe(spark):
    """Scalar-struct fields and multi-branch inputs must not re-run the panel."""
    for name, max_scans in (("zscore", 2), ("drift_auto", 1), ("weighted_metrics", 1), ("event_running_stats", 4)):
        df = E.queries()[name](spark, SF001)
        df.write.format("noop").mode("overwrite").save()
        assert plan_of(df).count("FileScan parquet") <= max_scans, name


def test_lookup_first_row_of_one_id(spark):
    from pyspark.sql import functions as F
    from cohortlens.operators.aggregates import lookup
    df = spark.createDataFrame([("B", 2023), ("A", 2024), ("A", 2022)], "RA string, ano int")
    assert tuple(lookup(df, "RA", "A").first()) == ("A", 2022)
    assert tuple(lookup(df.withColumn("__v", F.lit("B")), "RA", F.col("__v")).drop("__v").first()) == ("B", 2023)
