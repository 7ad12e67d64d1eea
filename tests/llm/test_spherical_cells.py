import numpy as np
import pytest
from conftest_llm import clashing

from cohortlens.llm import spherical_cells as S


def _plain(rows, threshold=0.95):
    """n_links and component by all pairs."""
    def usable(v):
        return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)

    x = [S.unit(np.array([v]))[0] if usable(v) else None for _, v in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and float(x[i] @ x[j]) >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted(((i is None, i or 0, n[k], names.get(find(k)), i is not None and names.get(find(k)) == i) for k, (i, _) in enumerate(rows)), key=str)


def _got(spark, rows, kind="float", **sizes):
    df = clashing(spark, [(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in S.near_duplicates(df, **sizes).collect()), key=str)


def _vectors(n, d, seed, low=0.95):
    """Random vectors, and for a third of them partners at an angle up to the threshold's and a little beyond, in chains."""
    rng = np.random.default_rng(seed)
    x = list(S.unit(rng.normal(size=(n, d))))
    for k in range(n // 3):
        u = rng.normal(size=d)
        u -= (u @ x[k]) * x[k]
        c = rng.uniform(low - 0.02, 1)
        x.append(c * x[k] + np.sqrt(1 - c * c) * u / np.linalg.norm(u))
    x += [x[0]] * 20 + [x[1] + rng.normal(size=d) / 40 / np.sqrt(d) for _ in range(60)]
    return [[float(c) for c in np.float32(v * rng.uniform(0.1, 5))] for v in x]


@pytest.mark.parametrize(("d", "sizes"), [(3, {}), (8, {"cells": 12}), (8, {"cells": 12, "tile": 16}), (8, {"cells": 1, "tile": 10})])
def test_equals_brute_force_where_no_link_can_be_missed(spark, d, sizes):
    rows = [(k * 31 % 997 + 5, v) for k, v in enumerate(_vectors(240, d, d))]
    assert _got(spark, rows, **sizes) == _plain(rows)


def test_recall_against_brute_force_in_64_dimensions(spark):
    rows = list(enumerate(_vectors(1500, 64, 2)))
    got, want = _got(spark, rows, cells=64), _plain(rows)
    found, all_ = sum(r[2] for r in got), sum(r[2] for r in want)
    assert found <= all_ and found >= 0.99 * all_
    assert sum(a[3] == b[3] for a, b in zip(got, want)) >= 0.99 * len(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [3.0, 0.1]),
            (9, [1.0, 0.0, 0.0]), (10, [1e-200, 0.0]), (11, [1e300, 1e300]), (None, [-1.0, 0.0]), (12, [0.0, -0.0])]
    assert _got(spark, rows, "double") == _plain(rows)
    assert S.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_a_product_next_to_the_threshold_is_decided_by_the_components():
    raw = np.array([[20.0, 0.0], [19.0, np.sqrt(39.0)], [19.0, np.sqrt(39.0) * (1 + 1e-12)], [19.0, np.sqrt(39.0) * (1 - 1e-12)]])
    pairs = {(int(a), int(b)) for i, j in S.linked(S.unit(raw), raw, 4, True, 0.95) for a, b in zip(i, j)}
    assert (0, 2) not in pairs and (0, 3) in pairs and {(1, 2), (1, 3), (2, 3)} <= pairs


def test_cells_do_not_depend_on_the_partitioning(spark):
    df = spark.createDataFrame([(v,) for v in _vectors(200, 16, 5)], "embedding array<float>")
    a, b = (S.fit(df.repartition(n), 9) for n in (1, 7))
    assert (a == b).all()
