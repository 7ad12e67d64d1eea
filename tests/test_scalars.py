"""Scalar functions, cleaning and request preparation (golden values)."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S
from cohortlens.functions.text import render_template, strip_report_header
from cohortlens.operators import cleaning as CL
from cohortlens.operators import quality as Q


def test_extract_and_encode_level(spark):
    data = [("Quartzo",), ("QUARTZO",), ("topázio",), ("Pedra: Ametista nível 2",), ("Diamante",), (None,),
            ("  Ágata ",), ("AGATA",)]
    df = spark.createDataFrame(data, "t string").select(S.extract_level("t").alias("p"))
    got = [r["p"] for r in df.collect()]
    assert got == ["Quartzo", "Quartzo", "Topázio", "Ametista", None, None, "Ágata", "Ágata"]
    codes = spark.createDataFrame([("Quartzo",), ("Ágata",), ("Ametista",), ("Topázio",), ("Diamante",), (None,)],
                                  "p string").select(S.encode_level("p").alias("c"))
    assert [r["c"] for r in codes.collect()] == [0.0, 1.0, 2.0, 3.0, None, None]


def test_clean_numeric(spark):
    df = spark.createDataFrame([("7,5",), ("abc",), (" 3.25 ",), ("7.5d",), ("NaN",), (None,), ("1e2",)], "t string")
    got = [r["x"] for r in df.select(S.clean_numeric("t").alias("x")).collect()]
    assert got == [7.5, None, 3.25, None, None, None, 100.0]


@pytest.mark.parametrize("strategy,expected", [("mean", 6.0), ("zero", 0.0), ("median", 6.0), ("mode", 4.0)])
def test_impute_numeric(spark, strategy, expected):
    df = spark.createDataFrame([(4.0, "Quartzo"), (None, None), (8.0, "Ágata")], "x double, p string")
    out = CL.impute(df, strategy).collect()
    assert out[1]["x"] == expected
    assert out[1]["p"] == "Desconhecido"


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (None,)], "x double")
    assert CL.impute(df, "mode").collect()[4]["x"] == 1.0


def test_risk_tier_and_trend_label(spark):
    df = spark.createDataFrame([(0.7, 0.2), (0.4, -0.2), (0.39, 0.1), (None, None)], "p double, t double")
    got = [tuple(r) for r in df.select(S.risk_tier("p"), S.trend_label("t")).collect()]
    assert got == [("ALTO", "crescendo"), ("MEDIO", "decrescendo"), ("BAIXO", "estável"), (None, "estável")]


def test_safe_float_and_record_rounding(spark):
    df = spark.createDataFrame([("2.5", 2.675), ("x", float("nan")), (None, float("inf"))], "s string, v double")
    got = [tuple(r) for r in df.select(S.safe_float("s", 1.0), S.round_record_value("v")).collect()]
    assert got == [(2.5, 2.68), (1.0, None), (1.0, None)]


def test_cold_start_and_request_deltas(spark):
    req = spark.createDataFrame(
        [("1", 2024, 7.0, None, 6.0, None, None, 4.5, None, None, None, None, None, None)],
        "aluno_id string, ano int, inde double, ieg double, ida double, ips double, iaa double, "
        "inde_anterior double, ieg_anterior double, ida_anterior double, delta_inde double, "
        "anos_no_programa int, tendencia_inde double, pedras_mudadas_total double")
    r = CL.risk_request_features(req).first()
    assert r["IEG"] == 6.472 and r["IPS"] == 5.893 and r["IAA"] == 6.123
    assert r["delta_INDE"] == 2.5 and r["delta_IEG"] == 0.0 and r["delta_IDA"] == 0.0
    assert r["anos_no_programa"] == 1.0 and r["tendencia_INDE"] == 0.0 and r["pedras_mudadas_total"] == 0.0
    given = req.withColumn("delta_inde", F.lit(1.0))
    assert CL.risk_request_features(given).first()["delta_INDE"] == 1.0


def test_cluster_request_zero_fill(spark):
    req = spark.createDataFrame([(7.0, None, 5.0, None, None)], "inde double, ieg double, ida double, ips double, iaa double")
    r = CL.cluster_request_features(req).first()
    assert (r["INDE"], r["IEG"], r["IDA"], r["IPS"], r["IAA"]) == (7.0, 0.0, 5.0, 0.0, 0.0)


def test_validation(spark):
    df = spark.createDataFrame(
        [("1", 2024, 7.0, 5.0, "Quartzo"), ("", 2019, 11.0, None, "Diamante"), (None, None, None, -1.0, None)],
        "aluno_id string, ano int, inde double, ieg double, pedra string")
    out = Q.validate(df).collect()
    assert out[0]["valido"] and out[0]["erros"] == []
    assert set(out[1]["erros"]) == {"aluno_id:obrigatorio", "ano:intervalo", "inde:intervalo", "pedra:dominio"}
    assert set(out[2]["erros"]) == {"aluno_id:obrigatorio", "ano:obrigatorio", "inde:obrigatorio", "ieg:intervalo"}
    ok, bad = Q.split_valid(df)
    assert ok.count() == 1 and bad.count() == 2


def test_report_header_strip(spark):
    text = "\n# Relatório do aluno\nPedra: Ágata | INDE: 7.1\n---\n\n## Resumo\nTexto\n\n---\nfim"
    df = spark.createDataFrame([(text,), ("  \n---\n",), (None,), ("**Pedra** x\n> **Pedra**\nok",)], "t string")
    got = [r["s"] for r in df.select(strip_report_header(F.col("t")).alias("s")).collect()]
    assert got == ["## Resumo\nTexto\n\n---\nfim", "", None, "ok"]


def test_render_template(spark):
    df = spark.createDataFrame([("Ana", 7.25, 3, None)], "nome string, inde double, anos int, fb string")
    got = df.select(render_template("{nome} ({inde:.1f}) anos={anos} fb={fb}").alias("p")).first()["p"]
    assert got == "Ana (7.3) anos=3 fb=N/A"


def test_report_defaults(spark):
    df = spark.createDataFrame([("Ana", None, 42.9)], "nome string, ieg double, risco_percentual double")
    r = CL.report_defaults(df).first()
    assert r["idade"] == 0 and r["ieg"] == 0.0 and r["risco_percentual"] == 42
    assert r["cluster_nome"] == "Não identificado" and r["risco_classe"] == "N/A"
    assert r["feedback_texto"] == "Não disponível" and r["tendencia_inde"] == "estável"


HEADER_CASES = [
    (None, None),
    ("", ""),
    ("Resumo do perfil", "Resumo do perfil"),
    ("# RELATÓRIO Pedagógico\n---\nResumo\n---\nfim", "Resumo\n---\nfim"),
    ("## relatório\n\n  \nPedra: Ágata | INDE: 7\n**Pedra** Quartzo\n> **PEDRA** y\nTexto", "Texto"),
    ("PEDRA: x\n---", "PEDRA: x\n---"),
    ("inde: 5 pedra:", "inde: 5 pedra:"),
    ("#relatório\nx", "#relatório\nx"),
    ("---\r\n\ttexto\r\n# relatório", "\ttexto\r\n# relatório"),
    (" --- \n# Relatório\n\n", ""),
    ("\n" * 100_000 + "fim", "fim"),
    ("# relatório\n" + "\n" * 100_000 + "a\n\nb", "a\n\nb"),
    ("---\n" * 50_000 + "x", "x"),
    (" " * 100_000 + "x" + " " * 100_000 + "y", "x" + " " * 100_000 + "y"),
    ("---\n" + " " * 100_000 + "linha", " " * 100_000 + "linha"),
]


def test_report_header_strip_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADER_CASES)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", strip_report_header(F.col("t")).alias("s")).collect()}
    assert [i for i, (_, want) in enumerate(HEADER_CASES) if got[i] != want] == []


def test_report_request_rules(spark):
    df = spark.createDataFrame([("1", 2024, 7.0, "", 3, 150.0), ("2", 2024, 7.0, "Ana", 12, 40.0)],
                               "aluno_id string, ano int, inde double, nome string, idade int, risco_percentual double")
    out = {r["aluno_id"]: set(r["erros"]) for r in Q.validate(df).collect()}
    assert out["1"] == {"nome:obrigatorio", "idade:intervalo", "risco_percentual:intervalo"}
    assert out["2"] == set()
