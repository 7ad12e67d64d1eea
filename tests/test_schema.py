"""Schema alignment on yearly tables shaped like the reference fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import schema as B

IND = ["IEG", "IDA", "IPS", "IAA", "IAN", "IPP", "IPV"]


def year_table(spark, year, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(1, n + 1):
        vals = [float(x) for x in rng.uniform(2, 10, len(IND))]
        inde = float(rng.uniform(3, 10))
        pedra = ["Quartzo", "Ágata", "Ametista", "Topázio"][i % 4]
        if year == 2022:
            rows.append((f"RA-{i}", f"Aluno-{i}", inde, *vals, pedra, 1 + i % 8, "ABC"[i % 3]))
        else:
            rows.append((f"RA-{i}", str(round(inde, 2)).replace(".", ","), *vals, pedra))
    if year == 2022:
        cols = ["RA", "Nome", "INDE 22", *IND, "PEDRA 22", "FASE", "TURMA"]
        schema = ("RA string, Nome string, `INDE 22` double, " + ", ".join(f"{c} double" for c in IND)
                  + ", `PEDRA 22` string, FASE int, TURMA string")
    else:
        cols = ["RA", f"INDE {year}", *IND, f"PEDRA {year}"]
        schema = (f"RA string, `INDE {year}` string, " + ", ".join(f"{c} double" for c in IND)
                  + f", `PEDRA {year}` string")
    return spark.createDataFrame(rows, schema).toDF(*cols)


@pytest.fixture(scope="module")
def years(spark):
    return {2022: year_table(spark, 2022, 50, 42), 2023: year_table(spark, 2023, 60, 43),
            2024: year_table(spark, 2024, 70, 44)}


def test_clean_and_map_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(" Instituição de Ensino ", "Nome Anonimizado", "Inglês")
    out = B.apply_column_mapping(B.clean_column_names(df))
    assert out.columns == ["INSTITUICAO DE ENSINO", "NOME", "INGLêS".upper()]


def test_drop_duplicate_columns_keeps_first(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("ieg ", "IEG")
    out = B.drop_duplicate_columns(B.clean_column_names(df))
    assert out.columns == ["IEG"] and out.first()["IEG"] == 1


def test_harmonize_union(years):
    out = B.harmonize(years)
    assert out.count() == 180
    assert {r["ano"] for r in out.select("ano").distinct().collect()} == {2022, 2023, 2024}
    assert dict(out.dtypes)["INDE"] == "double"
    assert out.where("ano = 2023").where(F.col("INDE").isNull()).count() == 0
    assert out.where("ano = 2022").where(F.col("NOME").isNull()).count() == 0
    assert out.where("ano = 2024").where(F.col("FASE").isNotNull()).count() == 0
    assert "PEDRA" in out.columns


def test_harmonize_requires_input():
    with pytest.raises(ValueError):
        B.harmonize({})


def test_schema_matrix_common_unique(spark):
    d = {2022: spark.createDataFrame([(1, 2)], "A int, B int"), 2023: spark.createDataFrame([(1, None)], "B int, C int")}
    m = {(r["coluna"], r["ano"]): r["presente"] for r in B.schema_matrix(d).collect()}
    assert m == {("A", 2022): True, ("A", 2023): False, ("B", 2022): True, ("B", 2023): True,
                 ("C", 2022): False, ("C", 2023): True}
    assert [r["coluna"] for r in B.common_columns(d).collect()] == ["B"]
    assert sorted((r["ano"], r["coluna"]) for r in B.unique_columns(d).collect()) == [(2022, "A"), (2023, "C")]
    nn = {(r["coluna"], r["ano"]): r["n_nao_nulos"] for r in B.schema_matrix(d).collect()}
    assert nn[("C", 2023)] == 0 and nn[("B", 2023)] == 1


def test_profile_table(spark):
    df = spark.createDataFrame([("RA-1", 1.0), ("RA-1", None), ("RA-2", 3.0)], "RA string, x double")
    p = {r["coluna"]: r for r in B.profile_table(df).collect()}
    assert p["x"]["n_nulos"] == 1 and p["RA"]["n_ids_unicos"] == 2 and p["x"]["n_linhas"] == 3


def test_normalize_level_column(spark):
    df = spark.createDataFrame([("QUARTZO",), (None,)], "PEDRA_RAW string")
    out = B.normalize_level_column(df, "PEDRA_RAW")
    assert out.columns == ["PEDRA", "PEDRA_CODIGO"]
    assert [tuple(r) for r in out.collect()] == [("Quartzo", 0.0), (None, None)]


def test_common_columns_empty_and_single(spark):
    assert B.common_columns({}).count() == 0
    one = {2022: spark.createDataFrame([(1, 2)], "B int, A int")}
    assert sorted(r["coluna"] for r in B.common_columns(one).collect()) == ["A", "B"]
    assert B.unique_columns(one).count() == 2


def test_filter_common_features_only(spark):
    df = spark.createDataFrame([("RA-1", 2022, 1.0, 2.0, "x")], "RA string, ano int, INDE double, IEG double, NOME string")
    assert B.common_features_only(df).columns == ["RA", "ano", "INDE", "IEG"]


def test_clean_numeric_columns_ignores_missing(spark):
    df = spark.createDataFrame([("7,5", "a")], "x string, y string")
    out = B.clean_numeric_columns(df, ["x", "missing"])
    assert out.first()["x"] == 7.5 and out.columns == ["x", "y"]
