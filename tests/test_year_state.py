"""State of single years: equal to a run over all rows, one year's rows read for a new year."""

import pytest
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import drift as D
from cohortlens.operators import quality as Q
from cohortlens.operators import schema as S
from cohortlens.operators import year_state as Y
from cohortlens.plans import catalog

from conftest import SF001


def _rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def panel(spark):
    return catalog.level_panel(spark, SF001).withColumn("IEG", F.when(F.col("RA") % 7 == 0, float("nan")).otherwise(F.col("IEG"))).cache()


def test_adding_a_year_equals_a_full_run(spark, panel, tmp_path):
    base = str(tmp_path / "state")
    years = [r[0] for r in panel.select("ano").distinct().orderBy("ano").collect()]
    clean = panel.withColumn("IEG", F.nanvl("IEG", F.lit(None).cast("double")))
    for n, y in enumerate(years, 1):
        Y.add_year(panel.where(F.col("ano") == y), base, y)
        if n not in (2, len(years)):
            continue
        so_far = clean.where(F.col("ano").isin(years[:n]))
        assert _rows(Y.feature_stats(spark, base)) == _rows(Q.feature_stats(so_far))
        want = D.all_periods_vs_first(so_far, K.DRIFT_FEATURES)
        got = Y.drift_vs_first(spark, base)
        assert _rows(got[1]) == _rows(want[1]) and _rows(got[0]) == _rows(want[0])
        for f, m in Y.medians(spark, base).collect():
            exact = so_far.select(F.median(f)).first()[0]
            assert m == pytest.approx(exact)
    assert _rows(Y.profile_by_year(spark, base).where(F.col("ano") == years[1]).drop("ano")) == _rows(S.profile_table(panel.where(F.col("ano") == years[1])))
    assert Y.distinct_ids(spark, base).first()[0] == pytest.approx(panel.select("RA").distinct().count(), rel=0.03)


def test_a_year_reads_its_own_rows_only(spark, tmp_path):
    """The counts of one year scan that year's date range, and statistics read no rows at all."""
    base = str(tmp_path / "state")
    rows = catalog.level_panel(spark, SF001, years=[1995])
    plan = Y.value_counts(rows, K.QUALITY_FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "1995-01-01" in plan and "1996-01-01" in plan and plan.count("FileScan") == 1
    Y.add_year(rows, base, 1995)
    Y.add_year(catalog.level_panel(spark, SF001, years=[1996]), base, 1996)
    assert "orders.parquet" not in Y.feature_stats(spark, base)._jdf.queryExecution().optimizedPlan().toString()
    assert all(base in f for f in Y.feature_stats(spark, base).inputFiles())


def test_a_year_that_fails_is_not_there_and_one_added_again_replaces_itself(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "state")
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 1.0)], "RA int, INDE double, IEG double")
    Y.add_year(df, base, 2022, ["INDE", "IEG"])
    with monkeypatch.context() as m:
        m.setattr(S, "profile_table", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            Y.add_year(df, base, 2023, ["INDE", "IEG"])
    assert list(Y.manifest(spark, base)) == [2022]
    Y.add_year(df.limit(1), base, 2022, ["INDE", "IEG"])
    assert Y.profile_by_year(spark, base).first()["n_linhas"] == 1
    with pytest.raises(ValueError):
        Y.drift_vs_first(spark, base)
