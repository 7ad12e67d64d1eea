"""Many k-means starts in the same passes: equal to separate fits, whatever the partitioning."""

import numpy as np
import pytest

from cohortlens.operators import lloyd as L
from cohortlens.operators import metrics as M


def _frame(spark, parts=3, n=900):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(5, 3)) * 4
    x = centre[rng.integers(0, 5, n)] + rng.normal(size=(n, 3))
    rows = [tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "a double, b double, c double").repartition(parts), x


def _plain(x, centres, iterations):
    for _ in range(iterations):
        best = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[best == k].mean(0) if (best == k).any() else centres[k] for k in range(len(centres))])
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return centres, float(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum())


def test_equal_to_separate_fits_in_fewer_jobs(spark, monkeypatch):
    df, x = _frame(spark)
    points = L.Points(df, ["a", "b", "c"])
    starts = [(k, s) for k in (2, 3, 5) for s in (1, 2, 3)]
    passes = []
    inner = L._pass
    monkeypatch.setattr(L, "_pass", lambda p, c: passes.append(len(c)) or inner(p, c))
    fits = L.fit_starts(points, starts, 100)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    for (k, s), f in zip(starts, fits):
        centres, cost = _plain(z, points.first_centres(k, s), 100)
        assert f.centres == pytest.approx(centres, abs=1e-5) and f.cost == pytest.approx(cost, rel=1e-5)
    assert passes[0] == len(starts) and sorted(passes, reverse=True) == passes  # a pass is for all starts that still move
    together = len(passes)
    passes.clear()
    for start in starts:
        L.fit_starts(points, [start], 100)
    assert together < len(passes)
    for k in (2, 3, 5):
        assert L.best_start(fits, starts, k).cost == min(f.cost for f, (own, _) in zip(fits, starts) if own == k)


def test_same_centres_for_any_partitioning(spark, monkeypatch):
    found = []
    for parts, rows in ((1, 1 << 17), (40, 30)):
        monkeypatch.setattr(L, "TASK_ROWS", rows)
        f = L.fit_starts(L.Points(_frame(spark, parts)[0], ["a", "b", "c"]), [(4, 7)], 50)[0]
        found.append((f.centres.tolist(), f.cost, f.means))
    assert found[0][2] == pytest.approx(found[1][2]) and found[0][0] == found[1][0] and found[0][1] == found[1][1]


def test_silhouette_equals_the_metric_and_the_iterations_can_run_out(spark):
    df, _ = _frame(spark)
    points = L.Points(df, ["a", "b", "c"])
    fits = L.fit_starts(points, [(4, 3), (2, 1)], 2)
    for f, s in zip(fits, L.silhouettes(points, fits)):
        labelled = f.transform(df.dropna())
        want = M.silhouette_sq(labelled, "cluster_id", vec_col="scaled", dim=3).first().silhouette
        assert s == pytest.approx(want, abs=1e-5)
    again = L.Centres.of_table(fits[0].table(spark))
    assert again.transform(df).collect() == fits[0].transform(df).collect()


def test_empty_constant_and_fewer_rows_than_centres(spark):
    empty = L.Points(spark.createDataFrame([], "a double"), ["a"])
    assert L.fit_starts(empty, [(2, 1)], 5) == []
    few = L.Points(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double"), ["a", "b"])
    f = L.fit_starts(few, [(3, 1)], 5)[0]
    assert f.cost == 0.0 and f.centres.shape == (3, 2)


def test_nearest_and_sums_are_exact():
    draw = np.random.default_rng(5)
    x, c = np.round(draw.normal(size=(500, 5)), 1), np.round(draw.normal(size=(7, 5)), 1)
    gaps = ((x[:, None] - c[None]) ** 2).sum(2)
    best, gap = L.nearest(x, c)
    assert (best == gaps.argmin(1)).all() and (gap == gaps.min(1)).all()
    for high in (1 << 20, 1 << 58):
        whole, cell = draw.integers(-high, high, (31, 3)), draw.integers(0, 4, 31)
        plain = [[sum(int(v) for v in whole[cell == k, j]) for j in range(3)] for k in range(5)]
        assert L.sums_by_cell(whole, cell, 5).tolist() == plain
