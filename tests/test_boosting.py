"""Histogram boosting against a plain version, and its independence of the partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import boosting as B


def _data(n, seed, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 6, n), rng.uniform(size=n), rng.normal(size=n)])
    y = ((x[:, 0] + (x[:, 1] > 3) - x[:, 2] * 2 + rng.normal(size=n) / 2) > 0).astype("f8")
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


def _frame(spark, x, y, parts):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (float(t), 3.0 if t else 1.0) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, w double").repartition(parts)


def _plain(x, y, w, hashes, cuts, p):
    """Boosting by comparing every cut on the raw values; trees as nested tuples."""
    margin = np.zeros(len(y))
    trees = []
    for number in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (prob - y) * B.WHOLE) / B.WHOLE, np.rint(w * prob * (1 - prob) * B.WHOLE) / B.WHOLE
        stay = B.in_tree(hashes, number, p.seed, p.rows)
        chosen = B.tree_features(x.shape[1], number, p)

        def build(rows, depth):
            G, H = g[rows & stay].sum(), h[rows & stay].sum()
            best = (0.0,)
            for f in chosen if depth < p.depth else ():
                for right in (True, False):
                    for c in [*cuts[f], np.inf]:
                        left = rows & ((x[:, f] <= c) | (np.isnan(x[:, f]) & (not right)))
                        gl, hl = g[left & stay].sum(), h[left & stay].sum()
                        if hl < p.min_curvature or H - hl < p.min_curvature:
                            continue
                        gain = 0.5 * (gl ** 2 / (hl + p.l2) + (G - gl) ** 2 / (H - hl + p.l2) - G ** 2 / (H + p.l2))
                        if gain > best[0] + 1e-9:
                            best = (gain, f, c, not right, left)
            if len(best) == 1:
                margin[rows] += -p.rate * G / (H + p.l2)
                return round(-p.rate * G / (H + p.l2), 9)
            _, f, c, missing_left, left = best
            return int(f), float(c), bool(missing_left), build(left, depth + 1), build(rows & ~left, depth + 1)

        trees.append(build(np.ones(len(y), bool), 0))
    return trees, 1 / (1 + np.exp(-margin))


def _nested(model, tree, node=0):
    f = tree.feature[node]
    if f < 0:
        return round(float(tree.value[node]), 9)
    cut = model.cuts[f][tree.bin[node]] if tree.bin[node] < len(model.cuts[f]) else np.inf
    return int(f), float(cut), bool(tree.missing_left[node]), _nested(model, tree, 2 * node + 1), _nested(model, tree, 2 * node + 2)


def _hashes(spark, df):
    cols = [F.col(c).cast("double") for c in ("a", "b", "c", "d", "y", "w")]
    rows = df.select(*cols, F.xxhash64(*cols).alias("h")).collect()
    x = np.array([[np.nan if v is None else v for v in r[:4]] for r in rows])
    return x, np.array([r.y for r in rows]), np.array([r.w for r in rows]), np.array([r.h for r in rows], "i8")


@pytest.mark.parametrize("missing", [0.0, 0.15])
def test_equals_a_plain_version(spark, missing):
    p = B.BoostParams(trees=5, depth=3, rate=0.3, bins=16, write_every=2)
    df = _frame(spark, *_data(500, 3, missing), 4)
    model = B.fit(df, ["a", "b", "c", "d"], "y", "w", p)
    x, y, w, h = _hashes(spark, df)
    trees, prob = _plain(x, y, w, h, model.cuts, p)
    assert [_nested(model, t) for t in model.trees] == trees
    got = model.transform(df).select("score").toPandas().score.to_numpy()
    assert np.sort(got) == pytest.approx(np.sort(prob), abs=1e-9)


def test_same_trees_for_any_partitioning(spark, monkeypatch):
    """1 and 64 partitions, one task or many, sums met by the driver or in tasks of their own."""
    p = B.BoostParams(trees=4, depth=4, write_every=2, bins=32)
    x, y = _data(3000, 5)
    found = []
    for parts, task_rows, direct, block in ((1, 1 << 17, 64, 8192), (64, 100, 64, 8192), (64, 100, 4, 50)):
        monkeypatch.setattr(B, "TASK_ROWS", task_rows)
        monkeypatch.setattr(B, "DIRECT_TASKS", direct)
        monkeypatch.setattr(B, "BLOCK_ROWS", block)
        model = B.fit(_frame(spark, x, y, parts), ["a", "b", "c", "d"], "y", "w", p)
        found.append([_nested(model, t) for t in model.trees])
    assert found[0] == found[1] == found[2]


def test_a_model_survives_its_table_and_rates_unseen_values(spark):
    x, y = _data(800, 9)
    df = _frame(spark, x, y, 2)
    model = B.fit(df, ["a", "b", "c", "d"], "y", "w", B.BoostParams(trees=20, rate=0.3))
    again = B.BoostedTrees.of_table(model.table(spark))
    odd = spark.createDataFrame([(None, float("nan"), 1e9, -1e9), (0.0, 5.0, 0.5, None)], "a double, b double, c double, d double")
    assert again.features == model.features and again.transform(odd).select("score").collect() == model.transform(odd).select("score").collect()
    scored = model.transform(df).select("y", "score").toPandas()
    assert scored.score[scored.y == 1].mean() > scored.score[scored.y == 0].mean() + 0.3
    top = model.importances()
    assert sum(v for _, v in top) == pytest.approx(1.0) and top[-1][0] == "d"


def test_empty_single_class_and_constant(spark):
    empty = spark.createDataFrame([], "a double, y double, w double")
    model = B.fit(empty, ["a"], "y", "w", B.BoostParams(trees=2))
    assert model.probability(np.array([[1.0], [np.nan]])).tolist() == [0.5, 0.5]
    one = spark.createDataFrame([(1.0, 1.0, 1.0)] * 50 + [(None, 1.0, 1.0), (2.0, None, 1.0)], "a double, y double, w double")
    assert B.fit(one, ["a"], "y", "w", B.BoostParams(trees=3)).probability(np.array([[1.0]]))[0] > 0.5


def test_a_tree_is_added_to_the_margins_once_and_not_at_every_level(spark, monkeypatch):
    x, y = _data(300, 4)
    kept = []
    level_sums = B._level_sums

    def counted(*given):
        kept.append(given)
        return level_sums(*given)

    monkeypatch.setattr(B, "_level_sums", counted)
    sent = B.fit(_frame(spark, x, y, 6), ["a", "b", "c", "d"], "y", "w", B.BoostParams(trees=7, depth=2))
    assert len(sent.trees) == 7
    assert all(sum(isinstance(v, B.Tree) for v in given) == 1 and not any(isinstance(v, list) and v and isinstance(v[0], B.Tree) for v in given) for given in kept)
    assert B.DIRECT_TASKS <= 8  # what the driver gets does not grow with the tasks beyond these
