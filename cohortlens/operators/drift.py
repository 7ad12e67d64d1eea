"""Distribution drift between periods (survey section 2.K).

Two-sample tests per (comparison, feature) as DataFrame code:

* rows are unpivoted to ``(cmp, feature, per, x)`` (per 0 = reference,
  1 = current), NULL/NaN/Inf dropped per feature;
* counts per distinct value ``(cmp, feature, x) -> (a, b)`` -- a hot value
  collapses to one row in the map-side partial aggregate;
* exact running counts along x via ``ordered.bucketed_running_sums``, so a
  feature is spread over many tasks instead of one window partition;
* one aggregate per (cmp, feature) gives every statistic. ``stattest`` names
  the test; "auto" takes it from the feature's declared kind ("numeric", the
  default: KS; "categorical": chi-square; "binary": z). Neither the number
  of rows nor of distinct values changes the test, so a table that grows
  keeps its test.

p-values (p < .05 is drift) use closed forms: the asymptotic Kolmogorov series
for KS, the regularised incomplete gamma function for chi-square (constant time
for any degrees of freedom) and a Chebyshev erfc (relative error < 1.2e-7). Distances (>= .1 is drift):
Wasserstein over the reference's deviation, and Jensen-Shannon. The decision
is made on the unrounded score; a score that cannot be computed is undecided
(NULL) and left out of the drifted share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.special import chi2_sf_sql, erfc_sql
from cohortlens.operators.ordered import bucketed_running_sums

# Default test thresholds.
KS_ALPHA = 0.05
DISTANCE_THRESHOLD = 0.1
# The test of each kind of feature.
KIND_TESTS = {"numeric": "ks", "categorical": "chisquare", "binary": "z"}


# ------------------------------------------------------------- SQL formulas
# Each formula reads plain columns produced by an earlier projection, so
# every generated expression stays small enough for whole-stage codegen.
def ks_pvalue_sql(lam: str, terms: int = 40) -> str:
    """Asymptotic Kolmogorov survival at ``lam``: 2 sum (-1)^(k-1) exp(-2 k^2 lam^2)."""
    series = " ".join(f"{'+' if k % 2 else '-'} exp(-2.0 * {k * k} * {lam} * {lam})" for k in range(1, terms + 1))
    return (f"(CASE WHEN {lam} < 0.2 THEN 1.0 "
            f"ELSE least(1.0, greatest(0.0, 2.0 * (0.0 {series}))) END)")


# Staged projections: (name, expression).
STAGES = [
    [("lam", "ks_d * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur))"),
     ("pool", "CAST(coalesce(a_mode, 0) + coalesce(b_mode, 0) AS DOUBLE) / (n_ref + n_cur)"),
     ("dof", "n_values - 1")],
    [("zarg", "CASE WHEN pool <= 0 OR pool >= 1 THEN NULL ELSE "
              "abs(CAST(coalesce(a_mode, 0) AS DOUBLE) / n_ref - CAST(coalesce(b_mode, 0) AS DOUBLE) / n_cur) / "
              "sqrt(2.0 * pool * (1.0 - pool) * (1.0 / n_ref + 1.0 / n_cur)) END")],
]
# The score of each test; only the formula that a feature's test names is evaluated for it.
SCORES = {
    "ks": ks_pvalue_sql("lam"),
    "wasserstein": "w1 / greatest(coalesce(ref_std, 0.0), 0.001)",
    "jensenshannon": "sqrt(greatest(0.5 * kl_p + 0.5 * kl_q, 0.0))",
    "chisquare": f"CASE WHEN chi_inf > 0 THEN 0.0 ELSE {chi2_sf_sql('chi_stat', 'dof')} END",
    "z": f"CASE WHEN zarg IS NULL THEN 1.0 ELSE {erfc_sql('zarg')} END",
}


# ---------------------------------------------------------------- long form
def long_pairs(ref: DataFrame, cur: DataFrame, features: Sequence[str], cmp: str = "cur") -> DataFrame:
    """K1: ``(cmp, feature, per, x, n)`` for the features both frames have; n rows hold the value."""
    feats = [f for f in features if f in ref.columns and f in cur.columns]

    def unpivot(df: DataFrame, per: int) -> DataFrame:
        s = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                                for f in feats])).alias("s")
        return df.select(F.lit(cmp).alias("cmp"), F.lit(per).alias("per"), s).select("cmp", "s.feature", "per", "s.x")

    return _finite(unpivot(ref, 0).unionByName(unpivot(cur, 1))).groupBy("cmp", "feature", "per", "x").agg(F.count(F.lit(1)).alias("n"))


def long_periods(df: DataFrame, features: Sequence[str], ref_period, cur_periods: Sequence,
                 time_col: str = K.TIME_COL, complete_cases: bool = False) -> DataFrame:
    """Reference period against each current period in one job.

    Rows are first counted per (period, feature, value); only those counts of
    the reference are replicated once per comparison, with ``explode`` over
    the (short) list of current periods -- no join -- and the comparison
    label ``"<ref>_vs_<cur>"`` becomes the group key.
    """
    feats = [f for f in features if f in df.columns]
    src = df.where(F.col(time_col).isin(ref_period, *cur_periods))
    if complete_cases:
        src = src.dropna(subset=feats)
    label = {c: f"{ref_period}_vs_{c}" for c in cur_periods}
    cmp_of_cur = F.element_at(F.create_map(*[x for c, lab in label.items() for x in (F.lit(c), F.lit(lab))]),
                              F.col(time_col))
    cmp = F.when(F.col(time_col) == ref_period,
                 F.array(*[F.lit(lab) for lab in label.values()])).otherwise(F.array(cmp_of_cur))
    per = F.when(F.col(time_col) == ref_period, F.lit(0)).otherwise(F.lit(1))
    vals = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in feats])
    counts = (_finite(src.select(F.col(time_col), F.explode(vals).alias("s")).select(time_col, "s.feature", "s.x"))
              .groupBy(time_col, "feature", "x").agg(F.count(F.lit(1)).alias("n")))
    return counts.select(F.explode(cmp).alias("cmp"), "feature", per.alias("per"), "x", "n")


def _finite(long: DataFrame) -> DataFrame:
    x = F.col("x")
    return long.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _sides() -> list:
    """Rows of the reference (a) and of the current period (b)."""
    return [F.sum(F.when(F.col("per") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((0, "a"), (1, "b"))]


# -------------------------------------------------------------------- tests
def choose_test_sql(stattest: str = "auto", kinds: Mapping[str, str] | None = None) -> str:
    """The test's name: ``stattest`` itself, or that of each feature's kind (numeric unless ``kinds`` says otherwise)."""
    if stattest != "auto":
        return f"'{stattest}'"
    named = " ".join(f"WHEN '{f}' THEN '{KIND_TESTS[k]}'" for f, k in (kinds or {}).items())
    return f"CASE feature {named} ELSE '{KIND_TESTS['numeric']}' END" if named else f"'{KIND_TESTS['numeric']}'"


def tests_used(stattest: str = "auto", kinds: Mapping[str, str] | None = None) -> list[str]:
    """The tests that a table can ask for; no other formula enters its plan."""
    if stattest != "auto":
        return [stattest]
    return sorted({KIND_TESTS["numeric"], *(KIND_TESTS[k] for k in (kinds or {}).values())})


def score_sql(tests: Sequence[str]) -> str:
    return "CASE {t} " + " ".join(f"WHEN '{t}' THEN {SCORES[t]}" for t in tests) + " END"


def detected_sql() -> str:
    return ("CASE WHEN {t} IN ('ks', 'chisquare', 'z') THEN {s} < " + str(KS_ALPHA) +
            " ELSE {s} >= " + str(DISTANCE_THRESHOLD) + " END")


def _finish(stats: DataFrame, stattest: str, kinds: Mapping[str, str] | None) -> DataFrame:
    t = stats
    for stage in STAGES:
        t = t.withColumns({n: F.expr(e) for n, e in stage})
    t = t.withColumn("stattest", F.expr(choose_test_sql(stattest, kinds)))
    t = t.withColumn("raw_score", F.expr(score_sql(tests_used(stattest, kinds)).replace("{t}", "stattest")))
    t = t.withColumn("drift_detected", F.expr(detected_sql().replace("{t}", "stattest").replace("{s}", "raw_score")))
    return t.withColumn("drift_score", F.round("raw_score", 4))


def drift_table(long: DataFrame, stattest: str = "auto", n_buckets: int | None = None,
                kinds: Mapping[str, str] | None = None) -> DataFrame:
    """K4 result: (cmp, feature, n_ref, n_cur, n_values, stattest, drift_score, drift_detected).

    ``kinds`` gives features' kinds for ``stattest="auto"``; ``n_buckets``
    (default: the number of shuffle partitions) only spreads the work.
    """
    keys = ["cmp", "feature"]
    n_buckets = n_buckets or int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from cohortlens.session import cut_lineage
    # Per-value counts feed five branches: checkpoint them once so the panel
    # upstream is scanned and aggregated a single time.
    counts = cut_lineage(long.groupBy(*keys, "x").agg(*_sides()))
    # Only KS and Wasserstein read running counts; the other tests need no order.
    if {"ks", "wasserstein"} & set(tests_used(stattest, kinds)):
        run = bucketed_running_sums(counts, keys, "x", ["a", "b"], n_buckets=n_buckets, next_col="x_next", cut=False)
    else:
        unused = F.lit(None).cast("long")
        run = counts.withColumns({"cum_a": unused, "cum_b": unused, "x_next": F.lit(None).cast("double")})
    sizes = counts.groupBy(*keys).agg(F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur"),
                                      F.count(F.lit(1)).alias("n_values"),
                                      (F.sum(F.col("a") * F.col("x")) / F.sum("a")).alias("ref_mean"),
                                      F.max_by(F.col("x"), F.struct(F.col("a"), -F.col("x"))).alias("mode_ref"))
    # Both sides must have values: an empty side has no distribution to test
    # (the comparison then reports the insufficient-data error instead).
    sizes = sizes.where((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
    r = run.join(F.broadcast(sizes), keys)  # sizes: one row per (cmp, feature) -- bounded
    fr = F.col("cum_a") / F.col("n_ref")
    fc = F.col("cum_b") / F.col("n_cur")
    p = F.col("a") / F.col("n_ref")
    q = F.col("b") / F.col("n_cur")
    m = (p + q) / 2
    k = F.col("n_cur") / F.col("n_ref")
    is_mode = F.col("x") == F.col("mode_ref")
    stats = r.groupBy(*keys, "n_ref", "n_cur", "n_values").agg(
        F.max(F.abs(fr - fc)).alias("ks_d"),
        F.sum(F.abs(fr - fc) * F.coalesce(F.col("x_next") - F.col("x"), F.lit(0.0))).alias("w1"),
        F.sum(F.when(F.col("a") > 0, F.pow(F.col("b") - F.col("a") * k, 2) / (F.col("a") * k))
              .otherwise(0.0)).alias("chi_stat"),
        F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("chi_inf"),
        F.sum(F.when(p > 0, p * F.log(p / m)).otherwise(0.0)).alias("kl_p"),
        F.sum(F.when(q > 0, q * F.log(q / m)).otherwise(0.0)).alias("kl_q"),
        F.sum(F.when(is_mode, F.col("a")).otherwise(0)).alias("a_mode"),
        F.sum(F.when(is_mode, F.col("b")).otherwise(0)).alias("b_mode"),
        # population std of the reference, two-pass over the value counts
        F.sqrt(F.sum(F.col("a") * F.pow(F.col("x") - F.col("ref_mean"), 2)) / F.first("n_ref")).alias("ref_std"),
    )
    out = _finish(stats, stattest, kinds)
    return out.select(*keys, "n_ref", "n_cur", "n_values", "stattest", "drift_score", "drift_detected")


def drift_summary(table: DataFrame, drift_threshold: float = 0.5,
                  dataset_share: float = K.DATASET_DRIFT_SHARE) -> DataFrame:
    """K2: per comparison -- drifted / total features, share (4 decimals) of the
    decided features, dataset drift (share >= the fixed .5) and
    above_threshold (share > threshold); all three NULL when none is decided."""
    g = table.groupBy("cmp").agg(F.count(F.lit(1)).alias("n_total_features"),
                                 F.count_if("drift_detected").alias("n_drifted_features"),
                                 F.count("drift_detected").alias("decided"))
    share = F.try_divide(F.col("n_drifted_features"), F.col("decided"))
    return g.select("cmp", "n_total_features", "n_drifted_features",
                    F.round(share, 4).alias("drift_share"),
                    (share >= dataset_share).alias("dataset_drift"),
                    F.lit(float(drift_threshold)).alias("drift_threshold"),
                    (share > drift_threshold).alias("above_threshold"))


def check_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None,
                drift_threshold: float = 0.5, stattest: str = "auto",
                kinds: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """K2 for two frames: (summary row, per-feature table)."""
    if features is None:
        num = {c for c, t in ref.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")}
        features = [c for c, t in cur.dtypes if c in num]
    table = drift_table(long_pairs(ref, cur, features), stattest, kinds=kinds)
    return drift_summary(table, drift_threshold), table


def compare_periods(df: DataFrame, ref_period, cur_period, features: Sequence[str],
                    time_col: str = K.TIME_COL, stattest: str = "auto",
                    complete_cases: bool = False) -> DataFrame:
    """K3: one comparison; when either side is empty the summary carries an
    ``error`` ("Dados insuficientes") instead of a result."""
    table = drift_table(long_periods(df, features, ref_period, [cur_period], time_col, complete_cases), stattest)
    summary = drift_summary(table)
    sizes = (df.where(F.col(time_col).isin(ref_period, cur_period))
             .agg(F.count_if(F.col(time_col) == ref_period).alias("n_ref_rows"),
                  F.count_if(F.col(time_col) == cur_period).alias("n_cur_rows"))
             .withColumn("cmp", F.lit(f"{ref_period}_vs_{cur_period}")))
    # The summary has 0 or 1 row for this comparison: a scalar subquery, no join.
    fields = [c for c in summary.columns if c != "cmp"]
    sm = summary.select(F.struct(*fields)).scalar()
    out = sizes.withColumn("__sm", sm).select("cmp", "n_ref_rows", "n_cur_rows",
                                              *[F.col(f"__sm.{c}").alias(c) for c in fields])
    return out.withColumn("error", F.when((F.col("n_ref_rows") == 0) | (F.col("n_cur_rows") == 0),
                                          F.lit("Dados insuficientes")))


def histogram(long: DataFrame, bins: int = 10) -> DataFrame:
    """K5: shared equal-width bins per (cmp, feature) and counts per period."""
    from cohortlens.session import cut_lineage
    keys = ["cmp", "feature"]
    # Work on per-value counts (checkpointed, read twice), not on the rows.
    counts = cut_lineage(long.groupBy(*keys, "x").agg(*_sides()))
    rng = counts.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = counts.join(F.broadcast(rng), keys)  # one row per (cmp, feature) -- bounded
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return (j.withColumn("bin", b).groupBy(*keys, "bin", "lo", "hi")
            .agg(F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur")))


def drift_lines(table: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """C17: one text line per feature, all features of a comparison joined."""
    t = table if stats is None else table.join(stats, "feature", "left")
    line = F.format_string("- %s: %s (score=%.4f, teste=%s)", F.col("feature"),
                           F.when(F.col("drift_detected"), F.lit("DRIFT")).otherwise(F.lit("estável")),
                           F.col("drift_score"), F.col("stattest"))
    if stats is not None:
        line = F.concat(line, F.format_string(" ref_mean=%.2f cur_mean=%.2f", F.col("ref_mean"), F.col("cur_mean")))
    return (t.groupBy("cmp").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("texto")))


def years_of(df: DataFrame, time_col: str = K.TIME_COL) -> list:
    """Distinct periods, sorted (a bounded driver-side list, like the reference)."""
    return [r[0] for r in df.select(time_col).distinct().orderBy(time_col).collect()]


def all_periods_vs_first(df: DataFrame, features: Sequence[str], time_col: str = K.TIME_COL,
                         stattest: str = "auto", years: Sequence | None = None) -> tuple[DataFrame, DataFrame]:
    """First period against every later one, in one job."""
    ys = list(years) if years is not None else years_of(df, time_col)
    if len(ys) < 2:
        raise ValueError("need at least two periods")
    table = drift_table(long_periods(df, features, ys[0], ys[1:], time_col), stattest)
    return drift_summary(table), table

