"""Sinks and model stores (survey A4-A8).

Everything is written with Spark writers to a path the caller chooses
(typically the shared folder of the cluster); small dimension tables are
Parquet, and so are models.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.aggregates import round_records
from cohortlens.operators.boosting import BoostedTrees
from cohortlens.operators.lloyd import Centres


Model = BoostedTrees | Centres


def save_model(spark: SparkSession, model: Model, path: str) -> str:
    """A4: a model is a small table."""
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_model(spark: SparkSession, path: str) -> Model:
    """A4: the kind of model follows from the table's columns."""
    table = spark.read.parquet(path)
    return BoostedTrees.of_table(table) if "tree" in table.columns else Centres.of_table(table)


def write_cluster_labels(names: DataFrame, profile: DataFrame, path: str) -> str:
    """A5: cluster id -> name and per-cluster profile as one small table."""
    names.join(profile, "cluster_id", "left").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def read_cluster_labels(spark: SparkSession, path: str) -> DataFrame:
    """A5: the label table, or an empty one when nothing was written yet."""
    from cohortlens.sources.csv_years import path_exists
    if not path_exists(spark, path):
        return spark.createDataFrame([], "cluster_id int, cluster_nome string")
    return spark.read.parquet(path)


def write_drift_report(summary: DataFrame, table: DataFrame, path: str) -> str:
    """The drift numbers (dataset-level and per-feature) as Parquet."""
    summary.write.mode("overwrite").parquet(f"{path.rstrip('/')}/summary")
    table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/features")
    return path


def write_records_json(df: DataFrame, path: str, digits: int = 2) -> str:
    """JSON records with NaN/Inf -> null and floats rounded."""
    round_records(df, digits).write.mode("overwrite").json(path)
    return path


def log_run_metrics(spark: SparkSession, run_name: str, metrics: Mapping[str, float], path: str) -> str:
    """Append (run, metric, value, ts) rows to a metrics table."""
    ts = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_name, k, None if v is None else float(v), ts) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run_name string, metric string, value double, ts timestamp") \
        .write.mode("append").parquet(path)
    return path


def _replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside ``path`` and rename it over ``path`` in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh, target = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}"), jvm.org.apache.hadoop.fs.Path(path)
    out = fresh.getFileSystem(conf).create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, over)


def read_manifest(spark: SparkSession, base: str) -> dict:
    """{"current": run id, "runs": {run id: folder}} of the published runs; empty before the first."""
    from cohortlens.sources.csv_years import path_exists
    path = f"{base.rstrip('/')}/manifest.json"
    if not path_exists(spark, path):
        return {"current": None, "runs": {}}
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def publish_run(spark: SparkSession, base: str, run_id: str, models: Mapping[str, Model], tables: Mapping[str, DataFrame],
                metrics: Mapping[str, Mapping[str, float]]) -> str:
    """A4, A5 and A8 as one set: models, tables and metrics under a run's own folder, made visible together.

    Everything is written to a new folder first; the manifest, renamed last, names
    it. A run that fails before leaves the former set as it was, and a run id that
    is published again replaces its own entry, so its metrics count once. One
    writer at a time: of two, the last manifest holds.
    """
    folder = f"{base.rstrip('/')}/runs/{run_id}-{uuid.uuid4().hex[:12]}"
    for name, model in models.items():
        save_model(spark, model, f"{folder}/models/{name}")
    for name, table in tables.items():
        table.write.parquet(f"{folder}/tables/{name}")
    for name, values in metrics.items():
        log_run_metrics(spark, name, values, f"{folder}/metrics")
    manifest = read_manifest(spark, base)
    manifest["runs"][run_id] = folder
    manifest["current"] = run_id
    _replace_file(spark, f"{base.rstrip('/')}/manifest.json", json.dumps(manifest, sort_keys=True))
    return folder


def _folder(spark: SparkSession, base: str, run_id: str | None) -> str:
    manifest = read_manifest(spark, base)
    run = run_id or manifest["current"]
    if run not in manifest["runs"]:
        raise KeyError(f"no published run {run!r} under {base}")
    return manifest["runs"][run]


def load_published_model(spark: SparkSession, base: str, name: str, run_id: str | None = None) -> Model:
    """A model of the current run, or of ``run_id``."""
    return load_model(spark, f"{_folder(spark, base, run_id)}/models/{name}")


def read_published_table(spark: SparkSession, base: str, name: str, run_id: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{_folder(spark, base, run_id)}/tables/{name}")


def read_metrics(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, run_name, metric, value, ts) of every published run."""
    runs = read_manifest(spark, base)["runs"]
    out = spark.createDataFrame([], "run_id string, run_name string, metric string, value double, ts timestamp")
    for run_id, folder in sorted(runs.items()):
        out = out.unionByName(spark.read.parquet(f"{folder}/metrics").withColumn("run_id", F.lit(run_id)))
    return out


def metrics_row_to_dict(df: DataFrame) -> dict:
    """One-row metrics DataFrame -> dict (bounded: one row)."""
    r = df.first()
    return {} if r is None else r.asDict()


def unpivot_metrics(df: DataFrame) -> DataFrame:
    """One-row metrics table -> (metric, value) rows."""
    num = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                         for c in num])).alias("m")).select("m.*")
