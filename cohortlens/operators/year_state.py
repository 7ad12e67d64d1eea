"""Per-year state: profiles, statistics, medians and drift after a new year without reading the former years.

A year's state is two small Parquet tables in a folder of its own:

* ``counts`` (feature, x, n): rows of each value of each numeric feature, NULL
  (and NaN) among them -- everything below is a sum over these rows;
* ``columns`` (coluna, tipo, n_nulos, n_linhas, n_colunas, n_ids_unicos): the
  year's own profile, and ``ids`` a HyperLogLog sketch of its ids, which merges.

``add_year`` reads one year's rows and names its folder in the manifest, renamed
last: a year that fails half-way is not there, one added again replaces itself.
Statistics of any years are those of a run over all their rows, since counts add
up; only the number of distinct ids over several years is an estimate (about
0.8 % at the sketch's 2^14 registers).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.operators import drift as D
from cohortlens.operators.ordered import bucketed_running_sums

ID_REGISTERS = 14  # log2 of the id sketch's registers


def manifest(spark: SparkSession, base: str) -> dict[int, str]:
    """Year -> folder of its state."""
    from cohortlens.sources.csv_years import path_exists
    path = f"{base.rstrip('/')}/years.json"
    if not path_exists(spark, path):
        return {}
    return {int(y): f for y, f in json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect())).items()}


def value_counts(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, x, n); NaN counts as NULL."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("x")) for f in features if f in rows.columns]))
    return rows.select(cells.alias("c")).groupBy("c.feature", "c.x").agg(F.count(F.lit(1)).alias("n"))


def add_year(rows: DataFrame, base: str, year: int, features: Sequence[str] = K.QUALITY_FEATURES, id_col: str = K.ID_COL) -> str:
    """Write the state of one year's ``rows`` (persisted for the passes over them) and publish it."""
    from pyspark import StorageLevel

    from cohortlens.operators.schema import profile_table
    from cohortlens.sources.sinks import _replace_file
    spark = rows.sparkSession
    folder = f"{base.rstrip('/')}/{year}-{uuid.uuid4().hex[:12]}"
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        value_counts(rows, features).write.parquet(f"{folder}/counts")
        profile_table(rows, id_col).coalesce(1).write.parquet(f"{folder}/columns")
        if id_col in rows.columns:
            rows.agg(F.hll_sketch_agg(F.col(id_col).cast("string"), F.lit(ID_REGISTERS)).alias("ids")).coalesce(1).write.parquet(f"{folder}/ids")
    finally:
        rows.unpersist()
    years = manifest(spark, base) | {int(year): folder}
    _replace_file(spark, f"{base.rstrip('/')}/years.json", json.dumps({str(y): f for y, f in sorted(years.items())}))
    return folder


def _tables(spark: SparkSession, base: str, name: str, years: Iterable[int] | None = None) -> DataFrame:
    """A table of the named years (default: all), with the year as ``ano``."""
    held = manifest(spark, base)
    wanted = sorted(held) if years is None else [y for y in years if y in held]
    if not wanted:
        raise ValueError(f"no state of the years asked for under {base}")
    out = None
    for y in wanted:
        t = spark.read.parquet(f"{held[y]}/{name}").withColumn(K.TIME_COL, F.lit(y))
        out = t if out is None else out.unionByName(t)
    return out


def profile_by_year(spark: SparkSession, base: str) -> DataFrame:
    """F12 of every year."""
    return _tables(spark, base, "columns").select(K.TIME_COL, "coluna", "tipo", "n_nulos", "pct_nulos", "n_linhas", "n_colunas", "n_ids_unicos")


def distinct_ids(spark: SparkSession, base: str, years: Iterable[int] | None = None) -> DataFrame:
    """One row: the estimated number of distinct ids over the years."""
    return _tables(spark, base, "ids", years).agg(F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("n_ids_unicos"))


def feature_stats(spark: SparkSession, base: str, years: Iterable[int] | None = None) -> DataFrame:
    """F10 of the years together: as ``quality.feature_stats`` over their rows."""
    counts = _tables(spark, base, "counts", years).groupBy("feature", "x").agg(F.sum("n").alias("n"))
    known = F.when(F.col("x").isNotNull(), F.col("n"))
    first = counts.groupBy("feature").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(known), F.lit(0)).alias("known"), F.count("x").alias("n_unique"),
                                          (F.sum(F.col("x") * known) / F.sum(known)).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    spread = (counts.join(F.broadcast(first.select("feature", "mean")), "feature")   # one row a feature
              .groupBy("feature").agg(F.sum(known * F.pow(F.col("x") - F.col("mean"), 2)).alias("ss")))
    both = first.join(spread, "feature").withColumn("std", F.when(F.col("known") > 1, F.sqrt(F.col("ss") / (F.col("known") - 1))))
    two = {c: F.coalesce(F.round(c, 2), F.lit(0.0)) for c in ("mean", "std", "min", "max")}
    return both.select("feature", *[c.alias(n) for n, c in two.items()], F.round((F.col("rows") - F.col("known")) / F.col("rows"), 4).alias("missing_pct"), "n_unique")


def medians(spark: SparkSession, base: str, years: Iterable[int] | None = None) -> DataFrame:
    """(feature, median) of the years together, the two middle values averaged; exact, from running counts in parallel buckets."""
    counts = _tables(spark, base, "counts", years).where("x IS NOT NULL").groupBy("feature", "x").agg(F.sum("n").alias("n"))
    run = bucketed_running_sums(counts, ["feature"], "x", ["n"])
    total = run.groupBy("feature").agg(F.sum("n").alias("rows"))
    near = run.join(F.broadcast(total), "feature")                                   # one row a feature
    low, high = F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)
    holds = lambda k: (F.col("cum_n") > k) & (F.col("cum_n") - F.col("n") <= k)
    return near.groupBy("feature").agg(((F.max(F.when(holds(low), F.col("x"))) + F.max(F.when(holds(high), F.col("x")))) / 2).alias("median"))


def drift_vs_first(spark: SparkSession, base: str, features: Sequence[str] = K.DRIFT_FEATURES, stattest: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The first year against every later one, from the counts alone: (summary, table)."""
    years = sorted(manifest(spark, base))
    if len(years) < 2:
        raise ValueError("need at least two periods")
    counts = _tables(spark, base, "counts").where(F.col("feature").isin(list(features)))
    counts = counts.where(F.col("x").isNotNull() & (F.abs("x") < float("inf")))
    label = F.array(*[F.lit(f"{years[0]}_vs_{y}") for y in years[1:]])
    is_first = F.col(K.TIME_COL) == years[0]
    own = F.array(F.concat(F.lit(f"{years[0]}_vs_"), F.col(K.TIME_COL).cast("string")))
    long = counts.select(F.explode(F.when(is_first, label).otherwise(own)).alias("cmp"), "feature", F.when(is_first, 0).otherwise(1).alias("per"), "x", "n")
    table = D.drift_table(long, stattest)
    return D.drift_summary(table), table
