"""Exact median / k-th value by histogram narrowing vs numpy."""

import numpy as np
import pytest

from cohortlens.operators import quantiles as Q

from cohortlens.operators.quantiles import exact_median, kth_value, _values


@pytest.mark.parametrize("case", ["odd", "even", "dupes", "hot", "ulp", "single"])
def test_exact_median(spark, case):
    rng = np.random.default_rng(9)
    if case == "odd":
        xs = rng.normal(0, 1, 2001)
    elif case == "even":
        xs = rng.exponential(3, 3000)
    elif case == "dupes":
        xs = rng.integers(0, 7, 5000).astype(float)
    elif case == "hot":
        xs = np.concatenate([np.full(1500, 4.2), rng.normal(4, 1, 3000)])
    elif case == "ulp":
        xs = 1.0 + np.arange(400) * np.finfo(float).eps
    else:
        xs = np.array([7.5])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float("nan"),)], "x double")
    assert exact_median(df, "x", buckets=16, limit=50) == pytest.approx(float(np.median(xs)), abs=0, rel=0)


def test_kth_value_every_rank_small(spark):
    xs = [3.0, 1.0, 2.0, 2.0, 9.0, -4.0, 2.0]
    v = _values(spark.createDataFrame([(x,) for x in xs], "x double"), "x")
    assert [kth_value(v, k, -4.0, 9.0, 0, buckets=2, limit=1) for k in range(len(xs))] == sorted(xs)


def test_median_of_empty_is_none(spark):
    assert exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_median_with_infinities_and_wide_ranges(spark):
    import math

    from cohortlens.operators.quantiles import exact_median

    inf = float("inf")
    for xs in ([1.0, 2.0, 3.0, inf], [-inf, -inf, -inf, 5.0], [inf, inf, 1.0], [1e308, -1e308, 3.0, 4.0, 5e-324], [float(k) for k in range(500)] + [inf] * 3):
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        s = sorted(xs)
        want = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        got = exact_median(df, "x", buckets=16, limit=4)
        assert got == want or math.isclose(got, want, rel_tol=1e-15)


def test_radix_order_statistics_equal_sorting(spark, monkeypatch):
    """All columns together, in at most seven scans: signs, infinities, tiny gaps, ties, NULL and NaN."""
    rng = np.random.default_rng(8)
    n = 2001
    data = {
        "normal": rng.normal(size=n), "ties": rng.integers(-3, 4, n).astype("f8"), "one": np.full(n, 7.25), "tiny": 1.0 + rng.integers(0, 50, n) * 2.0 ** -52,
        "wide": np.exp(rng.uniform(-600, 600, n)) * rng.choice([-1, 1], n), "inf": rng.choice([-np.inf, np.inf, 0.0, -0.0, 1e-310], n), "holes": rng.normal(size=n),
        "none": np.full(n, np.nan)}
    rows = [[float(data[c][k]) for c in data] for k in range(n)]
    for k in range(0, n, 3):
        rows[k][6] = None if k % 2 else float("nan")
        rows[k][7] = None
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} double" for c in data)).repartition(5).cache()
    passes = []
    inner = Q._digit_counts
    monkeypatch.setattr(Q, "_digit_counts", lambda wanted, done, bits: passes.append(sorted(wanted)) or inner(wanted, done, bits))
    got = Q.order_statistics(df, list(data), lambda m: sorted({0, m // 4, (m - 1) // 2, m // 2, m - 1}))
    assert len(passes) <= 7 and passes[0] == list(range(len(data)))
    for k, c in enumerate(data):
        x = np.sort([r[k] for r in rows if r[k] is not None and not np.isnan(r[k])])
        assert got[c] == [x[i] + 0.0 for i in sorted({0, len(x) // 4, (len(x) - 1) // 2, len(x) // 2, len(x) - 1})] if len(x) else got[c] == []
    medians = Q.exact_medians(df, list(data))
    assert medians["none"] is None
    for c in ("normal", "wide", "holes", "tiny"):
        assert medians[c] == Q.exact_median(df, c)
    assert Q.exact_medians(df, []) == {}


def test_sortable_keeps_the_order():
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1e-5, 2.0, np.inf])
    keys = Q.sortable(x)
    assert (np.diff(keys.astype(object)) > 0).all() and [Q.unsortable(int(k)) for k in keys] == x.tolist()
    assert Q.sortable(np.array([-0.0]))[0] == Q.sortable(np.array([0.0]))[0]
