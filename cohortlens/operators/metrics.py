"""Model evaluation as DataFrame code (survey J2, J4, J8, J11, J12, F15).

Every metric is an aggregate over the scored rows; nothing is collected.
Pairwise work is avoided: ROC AUC uses score-grouped counts with exact
running sums, silhouette uses the squared-Euclidean closed form (mean
squared distance to a cluster = |x|^2 - 2 x.c + mean |y|^2), and
Davies-Bouldin needs only per-cluster centroids and spreads.  Per-cluster
tables have k rows (bounded by the model), so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators.ordered import bucketed_running_sums

SPLIT_SEED = 42
TEST_HASH_BOUND = "33333333"  # md5 prefix below this = first 20 % of the hash space


# ------------------------------------------------------------------------- J2
def split_column(id_col: str = K.ID_COL, seed: int = SPLIT_SEED) -> Column:
    """Deterministic 80/20 split *by entity*: every row of an id lands on
    the same side (no leakage), no shuffle, reproducible in any engine."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return F.when(h < F.lit(TEST_HASH_BOUND), F.lit("test")).otherwise(F.lit("train"))


def group_split(df: DataFrame, features: Sequence[str], target: str = K.TARGET_COL,
                id_col: str = K.ID_COL, seed: int = SPLIT_SEED) -> DataFrame:
    """Complete cases with a target, tagged train/test by entity hash."""
    sub = df.dropna(subset=[target, *features])
    return sub.withColumn("split", split_column(id_col, seed))


# ------------------------------------------------------------------------- J4
def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("prediction")) \
             .agg(F.count(F.lit(1)).alias("n"))


def weighted_metrics(conf: DataFrame) -> DataFrame:
    """Support-weighted precision / recall / F1 from a confusion table
    (classes = labels or predictions seen; 0 when a ratio is undefined)."""
    from cohortlens.session import cut_lineage
    conf = cut_lineage(conf)   # <= classes^2 rows, read by three branches
    by_label = conf.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"))
    by_pred = conf.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("predicted"))
    tp = conf.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("c"), F.col("n").alias("tp"))
    per = (by_label.join(by_pred, "c", "full").join(tp, "c", "left")
           .fillna(0, subset=["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumns({"p": prec, "r": rec})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    per = per.withColumn("f", f1)
    tot = F.sum("support")
    return per.agg((F.sum(F.col("p") * F.col("support")) / tot).alias("precision"),
                   (F.sum(F.col("r") * F.col("support")) / tot).alias("recall"),
                   (F.sum(F.col("f") * F.col("support")) / tot).alias("f1"),
                   F.sum(F.when(F.col("c") == 1, F.col("support")).otherwise(0)).alias("positive"),
                   F.sum(F.when(F.col("c") == 0, F.col("support")).otherwise(0)).alias("negative"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", n_buckets: int = 64) -> DataFrame:
    """Exact ROC AUC (ties count one half) = P(score+ > score-) + P(=)/2.

    Counts per distinct score, then exact running negative counts along the
    score in parallel buckets; NULL when a class is missing.
    """
    g = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
         .groupBy(F.col(score).cast("double").alias("s"))
         .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    run = bucketed_running_sums(g, [], "s", ["neg"], n_buckets=n_buckets)
    agg = run.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * 0.5)).alias("num"),
                  F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.col("num") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
                      "n_pos", "n_neg")


# ------------------------------------------------------------------------- J8
def zscore(df: DataFrame, features: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Standardise with population std (one aggregate, used as a scalar subquery)."""
    st = df.agg(F.struct(*[F.avg(f).alias(f"m_{f}") for f in features],
                         *[F.stddev_pop(f).alias(f"s_{f}") for f in features])).scalar()
    # Project the struct once: one subquery, not one per field.
    j = df.withColumn("__st", st)
    exprs = {f"{f}{suffix}": F.when(F.col(f"__st.s_{f}") > 0, (F.col(f) - F.col(f"__st.m_{f}")) / F.col(f"__st.s_{f}"))
             .otherwise(F.lit(0.0)) for f in features}
    return j.withColumns(exprs).drop("__st")


# ------------------------------------------------------------------------ J11
def _vec(df: DataFrame, features: Sequence[str] | None, vec_col: str | None) -> Column:
    if vec_col:
        return F.transform(F.col(vec_col), lambda v: v.cast("double"))
    return F.array(*[F.col(f).cast("double") for f in features])


def vector_length(df: DataFrame, vec_col: str) -> int:
    """The length of the longest vector (shorter ones have NULL components)."""
    return df.agg(F.max(F.size(vec_col))).first()[0] or 0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _centroids(points: DataFrame, dim: int) -> DataFrame:
    """Per cluster: n, centroid, mean squared norm (k rows)."""
    return points.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(F.col("v")[i]) for i in range(dim)]).alias("c"),
        F.avg("sq").alias("msq"))


def _points(df: DataFrame, cluster_col: str, features, vec_col) -> DataFrame:
    v = _vec(df, features, vec_col)
    p = df.select(F.col(cluster_col).alias("cluster"), v.alias("v"))
    return p.where(F.col("cluster").isNotNull()).withColumn("sq", _dot(F.col("v"), F.col("v")))


def _all_centroids(cents: DataFrame) -> Column:
    """The k centroids as one array value (scalar subquery, k x d numbers)."""
    return cents.agg(F.collect_list(F.struct("cluster", "n", "c", "msq"))).scalar()


def silhouette_sq(df: DataFrame, cluster_col: str, features: Sequence[str] | None = None,
                  vec_col: str | None = None, dim: int | None = None) -> DataFrame:
    """Mean silhouette with squared Euclidean distance (the scalable form).

    a(i) = n_A (|x|^2 - 2 x.c_A + m_A) / (n_A - 1); b(i) = min over B != A of
    |x|^2 - 2 x.c_B + m_B; s = (b - a) / max(a, b); singleton cluster -> 0.
    """
    d = dim if dim is not None else len(features) if features else vector_length(df, vec_col)
    pts = _points(df, cluster_col, features, vec_col)
    cents = _centroids(pts, d)
    j = pts.withColumn("__cents", _all_centroids(cents))  # projected: no subquery inside a lambda
    dist = F.transform("__cents", lambda c: F.struct(
        c["cluster"].alias("cluster"), c["n"].alias("n"),
        (F.col("sq") - 2 * _dot(F.col("v"), c["c"]) + c["msq"]).alias("d")))
    j = j.withColumn("ds", dist)
    own = F.filter("ds", lambda e: e["cluster"] == F.col("cluster"))[0]
    others = F.filter("ds", lambda e: e["cluster"] != F.col("cluster"))
    a = F.when(own["n"] > 1, own["n"] * own["d"] / (own["n"] - 1))
    b = F.array_min(F.transform(others, lambda e: e["d"]))
    j = j.withColumns({"a": a, "b": b})
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0))
    return j.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n_points"),
                 F.count_distinct("cluster").alias("n_clusters"))


def reference_sets(points: DataFrame, per_cluster: int) -> DataFrame:
    """The ``per_cluster`` points of each cluster with the smallest hash, with their place in it.

    Points above a bound that leaves about four times as many are dropped first, so no task orders a whole cluster.
    """
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"))   # one row a cluster
    share = F.least(F.lit(1.0), F.lit(4.0 * per_cluster) / F.col("__n"))
    near = (points.join(F.broadcast(sizes), "cluster")
            .where(F.col("h") <= F.lit(-(2.0 ** 63)) + share * F.lit(2.0 ** 64)))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("h", "v"))
    return near.withColumn("place", rank).where(F.col("place") <= per_cluster).select("cluster", "v", "h", "place", F.col("__n").alias("n"))


def silhouette_euclidean(df: DataFrame, cluster_col: str, features: Sequence[str] | None = None, vec_col: str | None = None,
                         id_col: str | None = None, per_cluster: int = 256, groups: int = 8) -> DataFrame:
    """Mean silhouette with Euclidean distance, every row against a bounded reference set of each cluster.

    A row's mean distance to a cluster is that to its reference set (the ``per_cluster`` members
    with the smallest hash of ``id_col``, or of the vector), itself left out. Sets that hold
    whole clusters give the exact value. Otherwise ``std_error`` is the delete-a-group jackknife
    over the sets cut into ``groups``, with the finite-population correction of the cluster that is
    sampled most thinly; about 95 % of the values lie within twice of it.
    One row: silhouette, std_error, n_points, n_clusters. NULL clusters, NULL vectors and vectors
    with a NULL component are left out. The sets (clusters x per_cluster vectors) go to all tasks.
    """
    import numpy as np
    import pyarrow as pa

    key = F.xxhash64(F.col(id_col)) if id_col else F.xxhash64(_vec(df, features, vec_col))
    points = df.select(F.col(cluster_col).alias("cluster"), _vec(df, features, vec_col).alias("v"), key.alias("h"))
    points = points.where(F.col("cluster").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    found = reference_sets(points, per_cluster).collect()
    if not found:
        return df.sparkSession.createDataFrame([(None, None, 0, 0)], "silhouette double, std_error double, n_points long, n_clusters long")
    names = sorted({r.cluster for r in found})
    order = {c: k for k, c in enumerate(names)}
    found.sort(key=lambda r: (order[r.cluster], r.place))
    own = np.array([order[r.cluster] for r in found], "i8")
    vectors = np.array([r.v for r in found], "f8").reshape(len(found), -1)
    hashes, part = np.array([r.h for r in found], "i8"), np.array([(r.place - 1) % groups for r in found], "i8")
    held = np.zeros((groups, len(names)))
    np.add.at(held, (part, own), 1)
    whole = {r.cluster: r.n for r in found}
    thin = max((1 - min(1.0, per_cluster / n) for n in whole.values()), default=0.0)
    kind = df.schema[cluster_col].dataType.simpleString()

    def score(sums, counts, mine):
        """Silhouettes from summed distances and numbers by (row, cluster)."""
        rows = np.arange(len(mine))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(counts > 0, sums / counts, np.nan)
        a = mean[rows, mine]
        mean[rows, mine] = np.nan
        b = np.where(np.isnan(mean).all(1), np.nan, np.fmin.reduce(mean, axis=1)) if mean.shape[1] else np.full(len(mine), np.nan)
        top = np.fmax(a, b)
        return np.where(np.isnan(a) | np.isnan(b) | ~(top > 0), 0.0, (b - a) / np.where(top > 0, top, 1))

    def run(batches):
        total, n, seen = np.zeros(groups + 1), 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                x = np.array(rows.column("v").to_pylist(), "f8").reshape(rows.num_rows, -1)
                h, mine = rows.column("h").to_numpy(), np.array([order[c] for c in rows.column("cluster").to_pylist()], "i8")
                gap = np.sqrt(np.stack([((x - v) ** 2).sum(1) for v in vectors], 1))
                sums, counts = np.zeros((groups, len(x), len(names))), np.repeat(held[:, None], len(x), 1)
                for k in range(len(vectors)):
                    sums[part[k], :, own[k]] += gap[:, k]
                i, k = np.nonzero((h[:, None] == hashes[None]) & (mine[:, None] == own[None]) & (gap == 0))
                first = np.unique(i, return_index=True)[1]  # a row of the set is not its own neighbour; of equal rows one goes
                counts[part[k[first]], i[first], mine[i[first]]] -= 1
                s_all, c_all = sums.sum(0), counts.sum(0)
                total[0] += score(s_all, c_all, mine).sum()
                for g in range(groups):
                    total[g + 1] += score(s_all - sums[g], c_all - counts[g], mine).sum()
                n += len(x)
                seen.update(mine.tolist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "s"])

    sums = points.withColumn("cluster", F.col("cluster").cast(kind)).mapInArrow(run, "n long, s array<double>")
    of_all = sums.agg(F.sum("n").alias("n_points"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(groups + 1)])
    left_out = F.array(*[F.col(f"s{k + 1}") / F.col("n_points") for k in range(groups)])
    mean = F.aggregate(left_out, F.lit(0.0), lambda a, v: a + v) / groups
    with_mean = of_all.select("n_points", (F.col("s0") / F.col("n_points")).alias("silhouette"), left_out.alias("__l"), mean.alias("__m"))
    spread = F.aggregate(F.transform("__l", lambda v: (v - F.col("__m")) * (v - F.col("__m"))), F.lit(0.0), lambda a, v: a + v)
    return with_mean.select("silhouette", F.sqrt(spread * F.lit(thin * (groups - 1) / groups)).alias("std_error"), "n_points",
                            F.lit(len(names)).cast("long").alias("n_clusters"))


def davies_bouldin(df: DataFrame, cluster_col: str, features: Sequence[str] | None = None,
                   vec_col: str | None = None, dim: int | None = None) -> DataFrame:
    """Davies-Bouldin index (Euclidean): mean over clusters of the max over
    other clusters of (S_i + S_j) / |c_i - c_j|; S = mean distance to centroid."""
    d = dim if dim is not None else len(features) if features else vector_length(df, vec_col)
    from cohortlens.session import cut_lineage
    pts = _points(df, cluster_col, features, vec_col)
    cents = cut_lineage(_centroids(pts, d))          # k rows, read twice
    own = pts.join(F.broadcast(cents.select("cluster", "c")), "cluster")
    diff = F.zip_with("v", "c", lambda x, y: (x - y) * (x - y))
    spread = own.groupBy("cluster").agg(
        F.avg(F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v))).alias("s"))
    cl = cut_lineage(cents.join(spread, "cluster").select("cluster", "c", "s"))   # k rows, read twice
    allc = cl.agg(F.collect_list(F.struct(F.col("cluster").alias("k"), F.col("c").alias("cc"),
                                          F.col("s").alias("ss")))).scalar()
    j = cl.withColumn("__all", allc)  # projected: no subquery inside a lambda

    def ratio(o):
        dist = F.sqrt(F.aggregate(F.zip_with(F.col("c"), o["cc"], lambda x, y: (x - y) * (x - y)),
                                  F.lit(0.0), lambda acc, v: acc + v))
        return F.when(dist > 0, (F.col("s") + o["ss"]) / dist).otherwise(F.lit(0.0))

    worst = F.array_max(F.transform(F.filter("__all", lambda o: o["k"] != F.col("cluster")), ratio))
    return j.agg(F.avg(F.coalesce(worst, F.lit(0.0))).alias("davies_bouldin"),
                 F.count(F.lit(1)).alias("n_clusters"))


# ------------------------------------------------------------------------ F15
def cluster_profile(df: DataFrame, cluster_col: str, features: Sequence[str]) -> DataFrame:
    """per cluster n, % of all rows, per-feature mean and std (n-1)."""
    g = df.groupBy(F.col(cluster_col).alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n_alunos"),
        *[F.avg(f).alias(f"{f}_mean") for f in features],
        *[F.stddev_samp(f).alias(f"{f}_std") for f in features])
    # Total from the k-row group table itself (a window over k rows), not a second pass.
    total = F.sum("n_alunos").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("percentual", F.col("n_alunos") * 100.0 / total)


# ------------------------------------------------------------------------ J12
def cluster_names(profile: DataFrame, index_mean: str = "INDE_mean", engagement_mean: str = "IEG_mean",
                  names: Sequence[str] = K.CLUSTER_PROFILE_NAMES) -> DataFrame:
    """Min-max normalise the index and engagement means across clusters
    (0.5 when constant, 5.0 when absent), score = 0.6 idx + 0.4 eng, name by
    ascending score (ties by id); clusters past the name list -> ``Cluster {id}``.

    A global window over the profile table: it has one row per cluster.
    """
    w_all = Window.partitionBy(F.lit(1))
    wi, we = K.CLUSTER_SCORE_WEIGHTS

    def norm(c: str) -> Column:
        v = F.coalesce(F.col(c), F.lit(5.0)) if c in profile.columns else F.lit(5.0)
        lo, hi = F.min(v).over(w_all), F.max(v).over(w_all)
        return F.when(hi == lo, F.lit(0.5)).otherwise((v - lo) / (hi - lo))

    scored = profile.withColumn("score", wi * norm(index_mean) + we * norm(engagement_mean))
    ranked = scored.withColumn("rank", F.row_number().over(w_all.orderBy("score", "cluster_id")) - 1)
    name_arr = F.array(*[F.lit(n) for n in names])
    return ranked.select("cluster_id", "score",
                         F.when(F.col("rank") < len(names), F.element_at(name_arr, F.col("rank") + 1))
                         .otherwise(F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
                         .alias("cluster_nome"))
