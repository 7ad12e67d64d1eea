"""Drift tests: detection cases and brute-force checks of the statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import special as S
from cohortlens.operators import drift as D
from cohortlens.operators.ordered import bucketed_running_sums


def frame(spark, xs, year):
    return spark.createDataFrame([(year, float(x)) for x in xs], "ano int, x double")


def table(spark, ref, cur, stattest="auto", kind="numeric"):
    df = frame(spark, ref, 2022).unionByName(frame(spark, cur, 2023))
    return D.drift_table(D.long_periods(df, ["x"], 2022, [2023]), stattest, n_buckets=7, kinds={"x": kind}).first()


def test_strong_shift_detected(spark):
    rng = np.random.default_rng(0)
    s, t = D.check_drift(frame(spark, rng.normal(3, .5, 200), 1), frame(spark, rng.normal(9, .5, 200), 2), ["x"])
    row = s.first()
    assert row["dataset_drift"] and row["n_drifted_features"] == 1
    assert t.first()["stattest"] == "ks" and t.first()["drift_score"] < 0.05


def test_same_law_returns_boolean(spark):
    rng = np.random.default_rng(1)
    s, _ = D.check_drift(frame(spark, rng.normal(6, 2, 500), 1), frame(spark, rng.normal(6, 2, 500), 2), ["x"])
    assert isinstance(s.first()["dataset_drift"], bool)


def test_absent_year_gives_error_record(spark):
    df = frame(spark, [1.0, 2.0, 3.0], 2022)
    r = D.compare_periods(df, 2022, 2025, ["x"]).first()
    assert r["error"] == "Dados insuficientes" and r["n_cur_rows"] == 0


def test_ks_statistic_and_pvalue_brute_force(spark):
    rng = np.random.default_rng(2)
    ref, cur = rng.normal(0, 1, 300).round(2), rng.normal(0.3, 1, 250).round(2)
    xs = np.union1d(ref, cur)
    d = max(abs((ref <= x).mean() - (cur <= x).mean()) for x in xs)
    lam = d * math.sqrt(len(ref) * len(cur) / (len(ref) + len(cur)))
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    r = table(spark, ref, cur, "ks")
    assert r["drift_score"] == pytest.approx(round(min(1, max(0, p)), 4), abs=1e-4)


def test_wasserstein_brute_force(spark):
    rng = np.random.default_rng(3)
    ref, cur = rng.normal(0, 1, 1200).round(3), rng.normal(0.5, 1.2, 900).round(3)
    xs = np.union1d(ref, cur)
    fr = np.searchsorted(np.sort(ref), xs, side="right") / len(ref)
    fc = np.searchsorted(np.sort(cur), xs, side="right") / len(cur)
    w = float(np.sum(np.abs(fr - fc)[:-1] * np.diff(xs)))
    r = table(spark, ref, cur, "wasserstein")
    assert r["drift_score"] == pytest.approx(round(w / max(ref.std(), 0.001), 4), abs=1e-4)


def test_categorical_tests(spark):
    ref = [2, 4, 4, 6, 6, 6, 8, 8, 10] * 20
    cur = [2, 2, 4, 4, 6, 8, 8, 10, 10] * 20
    r = table(spark, ref, cur, "auto", "categorical")
    assert r["stattest"] == "chisquare" and 0 <= r["drift_score"] <= 1
    # chi-square statistic with 4 degrees of freedom: closed form survival
    keys = sorted(set(ref) | set(cur))
    k = len(cur) / len(ref)
    stat = sum((cur.count(v) - ref.count(v) * k) ** 2 / (ref.count(v) * k) for v in keys)
    h = stat / 2
    assert r["drift_score"] == pytest.approx(round(math.exp(-h) * (1 + h), 4), abs=1e-4)
    big = table(spark, ref * 6, cur * 6, "jensenshannon")
    p = np.array([ref.count(v) for v in keys]) / len(ref)
    q = np.array([cur.count(v) for v in keys]) / len(cur)
    m = (p + q) / 2
    js = math.sqrt(0.5 * np.sum(p * np.log(p / m)) + 0.5 * np.sum(q * np.log(q / m)))
    assert big["drift_score"] == pytest.approx(round(js, 4), abs=1e-4)
    z = table(spark, [0, 1, 1, 1] * 50, [0, 0, 1, 1] * 50, "auto", "binary")
    assert z["stattest"] == "z" and z["drift_detected"]


def test_bucketed_running_sums_match_global_window(spark):
    rng = np.random.default_rng(4)
    data = [(int(g), float(x), int(w)) for g, x, w in zip(rng.integers(0, 3, 2000), rng.normal(0, 1, 2000).round(2),
                                                          rng.integers(1, 5, 2000))]
    df = spark.createDataFrame(data, "g int, x double, w int").groupBy("g", "x").sum("w").withColumnRenamed("sum(w)", "w")
    out = bucketed_running_sums(df, ["g"], "x", ["w"], n_buckets=16, next_col="nx").collect()
    by_g = {}
    for r in sorted(df.collect(), key=lambda r: (r["g"], r["x"])):
        by_g.setdefault(r["g"], []).append(r)
    expect = {}
    for g, rs in by_g.items():
        c = 0
        for i, r in enumerate(rs):
            c += r["w"]
            expect[(g, r["x"])] = (c, rs[i + 1]["x"] if i + 1 < len(rs) else None)
    assert {(r["g"], r["x"]): (r["cum_w"], r["nx"]) for r in out} == expect


def test_histogram_counts(spark):
    df = frame(spark, [0.0, 1.0, 2.0, 10.0], 1).unionByName(frame(spark, [5.0, 10.0], 2))
    h = D.histogram(D.long_periods(df, ["x"], 1, [2]), bins=10).collect()
    assert sum(r["n_ref"] for r in h) == 4 and sum(r["n_cur"] for r in h) == 2
    assert max(r["bin"] for r in h) == 9


def test_the_test_does_not_depend_on_the_number_of_rows(spark):
    for kind, want in (("numeric", "ks"), ("categorical", "chisquare"), ("binary", "z")):
        for n in (999, 1000, 1001, 5000):
            r = table(spark, [k % 2 for k in range(n)], [k % 2 for k in range(n)], "auto", kind)
            assert r["stattest"] == want and r["drift_detected"] is False


@pytest.mark.parametrize(("values", "x", "p"), [  # table values of the chi-square distribution
    (2, 3.841458820694124, 0.05), (3, 5.991464547107979, 0.05), (4, 7.814727903251179, 0.05), (7, 12.591587243743977, 0.05),
    (11, 18.307038053275146, 0.05), (31, 50.89218131151707, 0.01), (101, 124.34211340400407, 0.05), (5001, 5165.615, 0.05)])
def test_chi_square_survival_for_any_degrees_of_freedom(spark, values, x, p):
    df = spark.createDataFrame([(x, values)], "x double, n long")
    assert df.selectExpr(S.chi2_sf_sql("x", "(n - 1)")).first()[0] == pytest.approx(p, rel=2e-3 if values > 5000 else 1e-8)


def plain_survival(dof, x):
    """Simpson's rule over the density, far into the tail."""
    a, h = dof / 2, x / 2
    low = math.lgamma(a)
    width = (max(h, a) + 40 * math.sqrt(a) + 150 - h) / 200_000
    if width <= 0:
        return 0.0
    t = h + width * np.arange(200_001)
    y = np.exp((a - 1) * np.log(t) - t - low)
    return float(width / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def test_chi_square_survival_equals_integration(spark):
    dofs = [3, 4, 7, 20, 99, 200, 399, 400, 401, 450, 1000, 4001, 30_000, 10**6]
    cases = [(d, float(d + z * math.sqrt(2 * d))) for d in dofs for z in (-3, -1, -0.05, 0, 0.02, 1, 2, 4) if d + z * math.sqrt(2 * d) > 0]
    got = spark.createDataFrame(cases, "dof long, x double").selectExpr("dof", "x", S.chi2_sf_sql("x", "dof") + " AS p").collect()
    assert [(r.dof, r.x, r.p) for r in got if abs(r.p - plain_survival(r.dof, r.x)) > 2e-7] == []


def test_chi_square_survival_takes_constant_time(spark):
    """No array or loop that grows with the degrees of freedom; at 4 * 10^9 it is all but the normal law."""
    df = spark.createDataFrame([(4 * 10**9, 4e9 + z * math.sqrt(8e9)) for z in (-2.0, 0.0, 1.0)], "dof long, x double")
    got = [r[0] for r in df.selectExpr(S.chi2_sf_sql("x", "dof")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in (-2.0, 0.0, 1.0)], abs=1e-5)
    assert {part.split(")")[0] for part in S.chi2_sf_sql("x", "dof").split("sequence(")[1:]} == {f"1, {S.STEPS}"}


def test_chi_square_of_more_than_a_million_values(spark):
    n = 1_200_000
    counts = spark.range(n).selectExpr("'c' AS cmp", "'x' AS feature", "explode(array(0, 1)) AS per", "CAST(id AS DOUBLE) AS x", "id")
    long = counts.selectExpr("cmp", "feature", "per", "x", "CASE per WHEN 0 THEN 20 ELSE 20 + CASE id % 3 WHEN 0 THEN -4 WHEN 1 THEN 0 ELSE 5 END END AS n")
    cur = np.tile([16, 20, 25], n // 3)
    k = cur.sum() / (20 * n)
    stat = float(((cur - 20 * k) ** 2 / (20 * k)).sum())
    r = D.drift_table(long, "chisquare").first()
    assert r["n_values"] == n and r["drift_score"] == pytest.approx(plain_survival(n - 1, stat), abs=6e-5)
    near = long.withColumn("n", F.when(F.col("per") == 1, F.when(F.col("x") % 2 == 0, 20 + 4).otherwise(20 - 4) + F.when(F.col("x") % 40 == 7, 9).otherwise(0)).otherwise(20))
    cur = np.array([(24 if v % 2 == 0 else 16) + (9 if v % 40 == 7 else 0) for v in range(n)])
    k = cur.sum() / (20 * n)
    want = plain_survival(n - 1, float(((cur - 20 * k) ** 2 / (20 * k)).sum()))
    assert D.drift_table(near, "chisquare").first()["drift_score"] == pytest.approx(want, abs=6e-5)


def test_only_the_test_asked_for_is_in_the_plan(spark):
    df = frame(spark, [1, 2, 3], 2022).unionByName(frame(spark, [1, 2, 2], 2023))
    plan = lambda **a: D.drift_table(D.long_periods(df, ["x"], 2022, [2023]), **a)._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG1P" not in plan(stattest="ks") and "LOG1P" not in plan(kinds={"x": "binary"})
    assert "LOG1P" in plan(kinds={"x": "categorical"})


def test_seven_values_get_a_score_and_count_in_the_summary(spark):
    ref, cur = [k % 7 for k in range(700)], [min(k % 9, 6) for k in range(700)]
    df = frame(spark, ref, 2022).unionByName(frame(spark, cur, 2023))
    t = D.drift_table(D.long_periods(df, ["x"], 2022, [2023]), "chisquare")
    r = t.first()
    assert r["n_values"] == 7 and r["drift_score"] is not None and r["drift_detected"]
    assert D.drift_summary(t).first()["n_drifted_features"] == 1


def test_decision_on_the_unrounded_score_and_undecided_left_out(spark):
    from pyspark.sql import functions as F

    assert "round" not in D.score_sql(list(D.SCORES)) + D.detected_sql()
    t = spark.createDataFrame([("c", "a", True), ("c", "b", None), ("d", "a", None)], "cmp string, feature string, drift_detected boolean")
    rows = {r["cmp"]: r for r in D.drift_summary(t).withColumn("k", F.lit(1)).collect()}
    assert rows["c"]["drift_share"] == 1.0 and rows["d"]["dataset_drift"] is None


def test_tests_without_an_order_need_no_running_counts(spark):
    long = spark.createDataFrame([("c", "f", per, float(x), 1 + x * (1 + per)) for per in (0, 1) for x in range(5)], "cmp string, feature string, per int, x double, n long")
    for test, ordered in (("ks", True), ("wasserstein", True), ("chisquare", False), ("jensenshannon", False)):
        plan = D.drift_table(long, test)._jdf.queryExecution().optimizedPlan().toString()
        assert ("Window" in plan) == ordered
    (r,) = D.drift_table(long, "chisquare").collect()
    assert (r.n_ref, r.n_cur, r.n_values) == (15, 25, 5)
