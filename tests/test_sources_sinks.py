"""CSV yearly sources, sinks and the streaming scoring path."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import lloyd
from cohortlens.operators import models as ML
from cohortlens.plans import catalog
from cohortlens.sources import csv_years as C
from cohortlens.sources import sinks as SK
from cohortlens.streaming.scoring import start_scoring_stream

from conftest import SF001


def tmpdir():
    return tempfile.mkdtemp(prefix="cohortlens-test-", dir="/tmp")


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_types_and_na_tokens(spark):
    d = tmpdir()
    p = write(os.path.join(d, "y2023.csv"),
              "RA;INDE 2023;IEG;FASE;PEDRA 2023;Obs\n"
              "RA-1;7,5;8.25;1;Quartzo;NA\n"
              "RA-2;n/a;6;2;;x\n"
              "RA-3;6,0;NaN;3;Ágata;null\n")
    df = C.load_csv(spark, p)
    types = dict(df.dtypes)
    assert types["IEG"] == "double" and types["FASE"] == "bigint" and types["INDE 2023"] == "string"
    rows = df.orderBy("RA").collect()
    assert rows[1]["INDE 2023"] is None and rows[1]["PEDRA 2023"] is None and rows[2]["IEG"] is None
    assert rows[0]["Obs"] is None and rows[1]["Obs"] == "x"


def test_load_years_skips_missing(spark):
    d = tmpdir()
    p = write(os.path.join(d, "a.csv"), "RA;X\nRA-1;1\n")
    got = C.load_years(spark, {2022: p, 2023: os.path.join(d, "missing.csv")})
    assert list(got) == [2022]
    try:
        C.load_csv(spark, os.path.join(d, "missing.csv"))
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_model_and_label_sinks(spark):
    d = tmpdir()
    df = spark.createDataFrame([(float(i % 5), float(i % 3)) for i in range(50)], "a double, b double")
    points = lloyd.Points(df, ["a", "b"])
    model = lloyd.fit_starts(points, [(2, 1)], 10)[0]
    path = SK.save_model(spark, model, os.path.join(d, "model"))
    again = SK.load_model(spark, path)
    assert again.transform(df).collect() == model.transform(df).collect()
    names = spark.createDataFrame([(0, "A"), (1, "B")], "cluster_id int, cluster_nome string")
    prof = spark.createDataFrame([(0, 10), (1, 5)], "cluster_id int, n_alunos long")
    SK.write_cluster_labels(names, prof, os.path.join(d, "labels"))
    assert SK.read_cluster_labels(spark, os.path.join(d, "labels")).count() == 2
    assert SK.read_cluster_labels(spark, os.path.join(d, "nothing")).count() == 0


def test_records_json_and_metrics_log(spark):
    d = tmpdir()
    df = spark.createDataFrame([("a", 1.23456), ("b", float("nan"))], "k string, v double")
    SK.write_records_json(df, os.path.join(d, "rec"))
    back = {r["k"]: r["v"] for r in spark.read.json(os.path.join(d, "rec")).collect()}
    assert back == {"a": 1.23, "b": None}
    for _ in range(2):
        SK.log_run_metrics(spark, "risk", {"f1": 0.5, "auc": None}, os.path.join(d, "metrics"))
    assert spark.read.parquet(os.path.join(d, "metrics")).count() == 4


def test_streaming_scoring(spark):
    d = tmpdir()
    src, sink = os.path.join(d, "in"), os.path.join(d, "out")
    req = catalog.request_view(spark, SF001)
    req.write.parquet(src)
    risk = ML.train_risk_classifier(catalog.target_panel(spark, SF001), max_iter=3)
    prof = ML.train_profiles(catalog.latest_complete(spark, SF001), n_init=1, max_iter=20)
    q = start_scoring_stream(spark, src, sink, risk, name="test_stream_" + os.path.basename(d), profile_model=prof)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == req.count()
    assert out.where(F.col("valido") & F.col("risco_classe").isNull()).count() == 0
    assert out.where(F.col("cluster_nome").isNull()).count() == 0


def test_quoted_fields_line_breaks_and_empty_columns(spark, tmp_path):
    from cohortlens.operators.schema import _unify_types
    from cohortlens.sources.csv_years import load_csv, load_years

    (tmp_path / "a.csv").write_text('RA;FASE;TEXTO\n1;2;"ele disse ""oi""; ontem"\n2;3;"linha um\nlinha dois"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("RA;FASE;TEXTO\n3;;x\n4;NA;y\n", encoding="utf-8")
    a = load_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in a.orderBy("RA").collect()] == [(1, 2, 'ele disse "oi"; ontem'), (2, 3, "linha um\nlinha dois")]
    years = load_years(spark, {2022: str(tmp_path / "a.csv"), 2023: str(tmp_path / "b.csv"), 2024: str(tmp_path / "none.csv")})
    assert sorted(years) == [2022, 2023] and dict(years[2023].dtypes)["FASE"] == "void"
    one, two = _unify_types(list(years.values()))
    assert dict(one.unionByName(two).dtypes)["FASE"] == "bigint"


def test_a_broken_file_is_not_skipped(spark, tmp_path, monkeypatch):
    import pytest

    from cohortlens.sources import csv_years

    (tmp_path / "a.csv").write_text("RA\n1\n", encoding="utf-8")
    monkeypatch.setattr(csv_years, "infer_types", lambda df: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        csv_years.load_years(spark, {2022: str(tmp_path / "a.csv")})


def test_nan_is_missing(spark):
    from cohortlens.operators.cleaning import impute
    from cohortlens.sources.tables import nan_to_null

    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert sorted(r["x"] for r in impute(df, "mean").collect()) == [1.0, 2.0, 2.0, 3.0]
    assert [r["x"] for r in nan_to_null(df).collect()].count(None) == 2


def _model(shift):
    return lloyd.Centres(["a"], [0.0], [1.0], np.array([[shift], [shift + 1.0]]))


def test_a_set_is_published_as_a_whole(spark, monkeypatch):
    """A run that fails leaves the former set readable; a run id published again has its metrics once."""
    base = tmpdir()
    labels = spark.createDataFrame([(0, "A")], "cluster_id int, cluster_nome string")
    assert SK.read_manifest(spark, base) == {"current": None, "runs": {}} and SK.read_metrics(spark, base).count() == 0
    with pytest.raises(KeyError):
        SK.load_published_model(spark, base, "profiles")
    SK.publish_run(spark, base, "r1", {"profiles": _model(0.0)}, {"labels": labels}, {"m": {"f1": 0.5}})
    for part in ("log_run_metrics", "_replace_file"):
        with monkeypatch.context() as m:
            m.setattr(SK, part, lambda *a, **k: (_ for _ in ()).throw(OSError("disk")))
            with pytest.raises(OSError):
                SK.publish_run(spark, base, "r2", {"profiles": _model(5.0)}, {"labels": labels}, {"m": {"f1": 0.9}})
        assert SK.load_published_model(spark, base, "profiles").centres[0, 0] == 0.0
        assert [tuple(r) for r in SK.read_metrics(spark, base).select("run_id", "value").collect()] == [("r1", 0.5)]
    for value in (0.6, 0.7):
        SK.publish_run(spark, base, "r2", {"profiles": _model(value)}, {"labels": labels}, {"m": {"f1": value}})
    assert sorted(tuple(r) for r in SK.read_metrics(spark, base).select("run_id", "value").collect()) == [("r1", 0.5), ("r2", 0.7)]
    assert SK.load_published_model(spark, base, "profiles").centres[0, 0] == 0.7
    assert SK.load_published_model(spark, base, "profiles", "r1").centres[0, 0] == 0.0
    assert SK.read_published_table(spark, base, "labels").collect() == labels.collect()


@pytest.mark.parametrize("multi_line", [True, False])
def test_malformed_rows_are_in_the_reject_table_not_in_the_panel(spark, multi_line):
    d = tmpdir()
    text = 'RA;X;Obs\n1;2;ok\n2;3\n3;4;ok;more\n4;5;"a;b"\n5;6;"quote ""x"" ; y";7\n6;NA;\n'
    paths = {2022: write(os.path.join(d, "a.csv"), text), 2023: write(os.path.join(d, "b.csv"), "RA;X\n1;2\n9\n")}
    rejects = os.path.join(d, "rejects")
    got = C.load_years(spark, paths, multi_line=multi_line, reject_table=rejects)
    assert [tuple(r) for r in got[2022].orderBy("RA").collect()] == [(1, 2, "ok"), (4, 5, "a;b"), (6, None, None)]
    assert dict(got[2022].dtypes)["X"] == "bigint" and got[2022].select("RA").count() == 3 and got[2023].count() == 1
    rows = sorted((os.path.basename(r.file), r.text, r.reason, r.first_field) for r in spark.read.parquet(rejects).collect())
    assert rows == [("a.csv", "2;3", "too few fields: 2 of 3", "2"), ("a.csv", "3;4;ok;more", "too many fields: 4 of 3", "3"),
                    ("a.csv", '5;6;"quote ""x"" ; y";7', "too many fields: 4 of 3", "5"), ("b.csv", "9", "too few fields: 1 of 2", "9")]
    assert C.load_csv(spark, paths[2022]).count() == 6   # without a reject table nothing is left out


def test_fields_with_line_breaks_reach_load_years(spark):
    d = tmpdir()
    paths = {2022: write(os.path.join(d, "a.csv"), 'RA;Obs\n1;"two\nlines"\n2;one\n')}
    assert [r.Obs for r in C.load_years(spark, paths)[2022].orderBy("RA").collect()] == ["two\nlines", "one"]
    whole, rejects = C.read_csv_checked(spark, paths[2022])
    assert whole.count() == 2 and rejects.count() == 0
    assert C.load_years(spark, paths, multi_line=False)[2022].count() == 3
