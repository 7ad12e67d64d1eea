"""Evaluation metrics against brute force on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import metrics as M


def test_roc_auc_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    score = rng.integers(0, 20, 400) / 20.0
    label = (rng.random(400) < 0.3 + 0.5 * score).astype(int)
    df = spark.createDataFrame([(int(l), float(s)) for l, s in zip(label, score)], "label int, score double")
    pos, neg = score[label == 1], score[label == 0]
    brute = np.mean([(p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)])
    r = M.roc_auc(df, n_buckets=8).first()
    assert r["roc_auc"] == pytest.approx(brute, abs=1e-12)


def test_roc_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, score double")
    assert M.roc_auc(df).first()["roc_auc"] is None


def test_weighted_metrics(spark):
    y = [0, 0, 0, 1, 1, 1, 1, 0]
    p = [0, 1, 0, 1, 1, 0, 1, 0]
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction int")
    r = M.weighted_metrics(M.confusion(df)).first()
    # per class: c0 tp=3 pred=4 sup=4; c1 tp=3 pred=4 sup=4
    assert r["precision"] == pytest.approx(0.75) and r["recall"] == pytest.approx(0.75)
    assert r["f1"] == pytest.approx(0.75) and (r["positive"], r["negative"]) == (4, 4)


def brute_silhouette_sq(X, lab):
    n = len(X)
    D2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(n):
        same = lab == lab[i]
        if same.sum() == 1:
            s.append(0.0)
            continue
        a = D2[i, same].sum() / (same.sum() - 1)
        b = min(D2[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def brute_db(X, lab):
    ks = sorted(set(lab))
    c = {k: X[lab == k].mean(0) for k in ks}
    s = {k: np.linalg.norm(X[lab == k] - c[k], axis=1).mean() for k in ks}
    return float(np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in ks if j != i) for i in ks]))


def test_silhouette_and_davies_bouldin_brute_force(spark):
    rng = np.random.default_rng(6)
    X = np.vstack([rng.normal(m, 1.0, (40, 3)) for m in (0, 3, 6)])
    lab = np.repeat([0, 1, 2], 40)
    lab[5] = 2  # some mixing
    df = spark.createDataFrame([(int(l), *map(float, x)) for l, x in zip(lab, X)], "c int, a double, b double, d double")
    s = M.silhouette_sq(df, "c", ["a", "b", "d"]).first()["silhouette"]
    assert s == pytest.approx(brute_silhouette_sq(X, lab), abs=1e-9)
    db = M.davies_bouldin(df, "c", ["a", "b", "d"]).first()["davies_bouldin"]
    assert db == pytest.approx(brute_db(X, lab), abs=1e-9)


def test_singleton_cluster_scores_zero(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 5.0)], "c int, x double")
    s = M.silhouette_sq(df, "c", ["x"]).first()["silhouette"]
    a0 = 1.0; b0 = 25.0; a1 = 1.0; b1 = 16.0
    assert s == pytest.approx(((b0 - a0) / b0 + (b1 - a1) / b1 + 0) / 3)


def test_zscore_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    z = [r["x_z"] for r in M.zscore(df, ["x"]).orderBy("x").collect()]
    assert z == pytest.approx([-1.224744871, 0.0, 1.224744871])


def test_group_split_no_leakage(spark):
    df = spark.createDataFrame([(f"RA-{i % 97}", 2020 + i // 97, 1.0, 0.0) for i in range(970)],
                               "RA string, ano int, f double, target_queda_prox_ano double")
    sp = M.group_split(df, ["f"])
    sides = sp.groupBy("RA").agg({"split": "count"}).join(
        sp.select("RA", "split").distinct().groupBy("RA").count(), "RA")
    assert sides.where("count > 1").count() == 0
    share = sp.where("split = 'test'").select("RA").distinct().count() / 97
    assert 0.05 < share < 0.4


def test_cluster_names_order_and_overflow(spark):
    prof = spark.createDataFrame([(0, 3.0, 2.5), (1, 5.0, 4.5), (2, 7.0, 6.5), (3, 9.0, 8.5), (4, 9.5, 9.0)],
                                 "cluster_id int, INDE_mean double, IEG_mean double")
    names = {r["cluster_id"]: r["cluster_nome"] for r in M.cluster_names(prof).collect()}
    assert names[0] == "Desmotivados Crônicos" and names[3] == "Alto Desempenho"
    assert names[4] == "Cluster 4"
    const = spark.createDataFrame([(0, 5.0, 5.0), (1, 5.0, 5.0)], "cluster_id int, INDE_mean double, IEG_mean double")
    assert [r["cluster_nome"] for r in M.cluster_names(const).orderBy("cluster_id").collect()] == \
        ["Desmotivados Crônicos", "Em Risco"]


def test_cluster_profile(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "c int, x double")
    p = {r["cluster_id"]: r for r in M.cluster_profile(df, "c", ["x"]).collect()}
    assert p[0]["n_alunos"] == 2 and p[0]["x_mean"] == 2.0 and p[0]["percentual"] == pytest.approx(200 / 3)


def _brute_silhouette(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        others = [d[i, label == c].mean() for c in set(label) if c != label[i]]
        if not own.any() or not others:
            s.append(0.0)
            continue
        a, b = d[i, own].mean(), min(others)
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def _clusters(spark, n, seed, copies=False):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + label[:, None] * 1.5
    if copies:
        x[: n // 4] = x[0]
        label[n - 1] = 9   # a cluster of one
    df = spark.createDataFrame([(k, int(c), [float(v) for v in r]) for k, (c, r) in enumerate(zip(label, x))], "id long, c int, v array<double>")
    return df, x, label


def test_euclidean_silhouette_is_exact_when_the_sets_hold_all_rows(spark):
    df, x, label = _clusters(spark, 150, 1, copies=True)
    df = df.unionByName(spark.createDataFrame([(900, None, [1.0, 2.0, 3.0, 4.0]), (901, 1, None), (902, 1, [1.0, None, 2.0, 3.0])], df.schema))
    for key in ("id", None):
        r = M.silhouette_euclidean(df, "c", vec_col="v", id_col=key, per_cluster=200).first()
        assert r.silhouette == pytest.approx(_brute_silhouette(x, label), abs=1e-9)
        assert r.std_error == 0.0 and (r.n_points, r.n_clusters) == (150, 4)
    assert M.silhouette_euclidean(df.limit(0), "c", vec_col="v").first().n_points == 0


def test_euclidean_silhouette_from_samples_lies_within_its_error(spark):
    inside = 0
    for seed in range(6):
        df, x, label = _clusters(spark, 900, 20 + seed)
        r = M.silhouette_euclidean(df, "c", vec_col="v", id_col="id", per_cluster=40).first()
        assert 0 < r.std_error < 0.05
        inside += abs(r.silhouette - _brute_silhouette(x, label)) <= 2 * r.std_error
    assert inside >= 5


def test_reference_sets_are_bounded_and_the_smallest_hashes(spark):
    df, _, _ = _clusters(spark, 900, 3)
    points = df.selectExpr("c AS cluster", "v", "xxhash64(id) AS h")
    got = {(r.cluster, r.h) for r in M.reference_sets(points, 25).collect()}
    want = {}
    for r in points.collect():
        want.setdefault(r.cluster, []).append(r.h)
    assert got == {(c, h) for c, hs in want.items() for h in sorted(hs)[:25]}


def test_metrics_take_the_vector_length_from_the_data(spark):
    df, x, label = _clusters(spark, 120, 5)
    wide = df.select("c", F.concat("v", F.array_repeat(F.lit(0.0), 90)).alias("v"))
    assert M.vector_length(wide, "v") == 94
    assert M.silhouette_sq(wide, "c", vec_col="v").first().silhouette == pytest.approx(M.silhouette_sq(df, "c", vec_col="v").first().silhouette)
