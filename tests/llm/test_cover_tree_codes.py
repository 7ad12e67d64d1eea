import hashlib

import numpy as np
import pytest
from conftest_llm import clashing

from cohortlens.llm import cover_tree_codes as C


def _plain(rows, rounds=4):
    """Codes by comparing every part with every entry; rows: (vec_id, integer components, label)."""
    width = len(rows[0][1]) // 4
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    parts = [np.array([r[1][p * width:(p + 1) * width] for r in rows], object) for p in range(4)]
    books = [np.array([r[1][p * width:(p + 1) * width] for r in first], object) for p in range(4)]

    def assign(x, book):
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        best = np.array([min(range(len(r)), key=lambda j: (r[j], j)) for r in d])
        return best, d[np.arange(len(d)), best]

    for _ in range(rounds):
        for p in range(4):
            best, _ = assign(parts[p], books[p])
            books[p] = np.array([[sum(c) // int((best == j).sum()) for c in parts[p][best == j].T] if (best == j).any() else list(books[p][j]) for j in range(len(books[p]))], object)
    found = [assign(parts[p], books[p]) for p in range(4)]
    error = sum(d for _, d in found)
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{b[k]:02x}" for b, _ in found), int(error[k]), by_label[r[2]], digest) for k, r in enumerate(rows))


def _got(spark, rows, kind="float"):
    df = clashing(spark, [(i, v, label) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return sorted(tuple(r) for r in C.codes(df).collect())


def _vectors(n, d, seed, copies=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype("f4") / 8
    if copies:  # exact and near copies, and components that tie
        x[n // 2:n // 2 + n // 8] = x[3]
        x[n // 2 + n // 8:n // 2 + n // 4] = x[4] + rng.normal(size=(n // 2 + n // 4 - n // 2 - n // 8, d)).astype("f4") / 500
        x[-n // 8:] = np.round(x[-n // 8:] * 8) / 8
    return x


@pytest.mark.parametrize(("n", "d", "rows"), [(900, 16, 1024), (700, 8, 64), (300, 4, 50)])
def test_equals_brute_force(spark, n, d, rows, monkeypatch):
    monkeypatch.setattr(C, "TREE_ROWS", rows)
    x = _vectors(n, d, n)
    rows = [(int(k * 7 % n), [float(c) for c in x[k]], None if k % 5 == 0 else k % 3) for k in range(n)]
    whole = [(i, [int(np.floor(c * 1024)) for c in v], label) for i, v, label in rows]
    assert _got(spark, rows) == _plain(whole)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [0.5] * 8, None), (3, [0.5] * 8, 1), (3, [-0.5] * 8, 1), (9, [100000.0] + [0.0] * 7, 2), (4, None, 1), (5, [nan] * 8, 1),
            (6, [inf] + [0.0] * 7, 1), (7, [None] + [0.0] * 7, 1), (8, [], 1), (10, [1.0, 2.0], 1), (11, [131072.0] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id if r.vec_id is not None else 99, r.code, r.error, r.label_error) for r in C.codes(df).collect()))
    assert got == [(3, "00000000", 0, 0), (3, "01010101", 0, 0), (9, "02020202", 0, 0), (99, "01010101", 0, 0)]
    assert C.codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert C.codes(spark.createDataFrame([(1, [nan], 1)], "vec_id long, embedding array<float>, label string")).collect() == []
    odd = C.codes(spark.createDataFrame([(1, [0.25] * 6, "a"), (2, [0.5] * 6, "a")], "vec_id long, embedding array<float>, label string")).collect()
    assert sorted(r.code for r in odd) == ["00000000", "01010100"]  # 6 components are filled up to 8; the last part is zeros, a tie


def test_tree_covers_and_separates():
    x = np.unique(np.floor(_vectors(500, 6, 1) * 1024).astype("i8"), axis=0)
    tree = C.Tree(x, np.ones(len(x), "i8"))
    assert sorted(tree.made) == list(range(len(x)))
    sums, n = C.cumulative(tree)
    children = {}
    for k, p in enumerate(tree.parent):
        children.setdefault(p, []).append(k)
    for k in range(len(x)):
        below = tree.points[k:tree.end[k]]
        gaps = np.sqrt(((below - tree.points[k]) ** 2).sum(1))
        assert gaps.max() == pytest.approx(tree.radius[k]) and n[k] == len(below) and (sums[k] == below.sum(0)).all()
        for c in children.get(k, []):  # a child's subtree is no wider than its own distance
            assert tree.radius[c] <= np.sqrt(((tree.points[c] - tree.points[k]) ** 2).sum()) + 1e-9


def test_whole_subtrees_are_placed_and_large_numbers_stay_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (20, 5))
    x = np.unique((centres[rng.integers(0, 20, 2000)] + rng.integers(-8, 9, (2000, 5))), axis=0).astype("i8")
    tree = C.Tree(x, np.ones(len(x), "i8"))
    flat = {"points": tree.points.ravel(), "radius": np.array(tree.radius), "parent": np.array(tree.parent), "depth": np.array(tree.depth), "ends": np.array(tree.end)}
    node, entry, whole, unseen = C.walk(flat, 5, centres.astype("i8"))
    assert unseen > len(x) // 2
    code = np.full(len(x), -1)
    code[node[~whole]] = entry[~whole]
    for a, e in zip(node[whole], entry[whole]):
        code[a:tree.end[a]] = e
    assert (code == C.nearest(tree.points, centres)[0]).all()
    big = rng.integers(-(1 << 27), 1 << 27, (50, 16))
    found, least, _ = C.nearest(big, big[::2])
    d = ((big[:, None].astype(object) - big[::2][None].astype(object)) ** 2).sum(2)
    assert found.tolist() == [min(range(25), key=lambda j: (r[j], j)) for r in d] and least.tolist() == [min(r) for r in d]
