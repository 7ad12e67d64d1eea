"""Golden rows for the per-entity window operators (hand-computed)."""

import pytest

from cohortlens.operators import temporal as G


def panel(spark, data, cols="RA string, ano int, INDE double"):
    return spark.createDataFrame(data, cols)


def by_key(df, col):
    return {(r["RA"], r["ano"]): r[col] for r in df.collect()}


def test_deltas_two_entities(spark):
    df = panel(spark, [("A", 2022, 5.0), ("A", 2023, 7.0), ("B", 2022, 6.0), ("B", 2023, 4.0)])
    d = by_key(G.deltas(df, ["INDE"]), "delta_INDE")
    assert d[("A", 2022)] is None and d[("A", 2023)] == pytest.approx(2.0)
    assert d[("B", 2022)] is None and d[("B", 2023)] == pytest.approx(-2.0)


def test_deltas_one_year_and_unknown_feature(spark):
    df = panel(spark, [("A", 2022, 5.0)])
    out = G.deltas(df, ["INDE", "MISSING"])
    assert "delta_MISSING" not in out.columns
    assert out.first()["delta_INDE"] is None


def test_delta_across_gap_uses_previous_row(spark):
    df = panel(spark, [("A", 2022, 5.0), ("A", 2024, 8.0)])
    assert by_key(G.deltas(df, ["INDE"]), "delta_INDE")[("A", 2024)] == pytest.approx(3.0)


@pytest.mark.parametrize("vals,expected", [([4.0, 6.0, 8.0], 2.0), ([8.0, 6.0, 4.0], -2.0), ([5.0], 0.0)])
def test_trend(spark, vals, expected):
    df = panel(spark, [("A", 2022 + i, v) for i, v in enumerate(vals)])
    out = G.trend_slope(df)
    assert all(r["tendencia_INDE"] == pytest.approx(expected) for r in out.collect())


def test_trend_ignores_null_points_and_asof(spark):
    df = panel(spark, [("A", 2022, 4.0), ("A", 2023, None), ("A", 2024, 8.0)])
    whole = by_key(G.trend_slope(df), "tendencia_INDE")
    assert whole[("A", 2022)] == pytest.approx(2.0)
    asof = by_key(G.trend_slope(df, as_of=True), "tendencia_INDE_asof")
    assert asof[("A", 2022)] == 0.0 and asof[("A", 2024)] == pytest.approx(2.0)


def test_years_in_program(spark):
    df = panel(spark, [("A", 2022, 1.0), ("A", 2023, 1.0), ("A", 2024, 1.0), ("B", 2023, 1.0), ("B", 2024, 1.0)])
    y = by_key(G.years_in_program(df), "anos_no_programa")
    assert [y[("A", a)] for a in (2022, 2023, 2024)] == [1, 2, 3]
    assert [y[("B", a)] for a in (2023, 2024)] == [1, 2]


def code_panel(spark, codes):
    return spark.createDataFrame([("A", 2022 + i, c) for i, c in enumerate(codes)],
                                 "RA string, ano int, PEDRA_CODIGO double")


def test_level_changes(spark):
    out = by_key(G.level_changes(code_panel(spark, [0.0, 1.0, 2.0])), "pedras_mudadas_total")
    assert out[("A", 2024)] == 2.0
    out = by_key(G.level_changes(code_panel(spark, [1.0, 1.0])), "pedras_mudadas_total")
    assert out[("A", 2023)] == 0.0


def test_level_changes_null_does_not_inflate(spark):
    out = G.level_changes(code_panel(spark, [2.0, None, 1.0]))
    assert [r["pedras_mudadas"] for r in out.orderBy("ano").collect()] == [0.0, 0.0, 0.0]
    assert max(r["pedras_mudadas_total"] for r in out.collect()) <= 1


def test_level_changes_without_code_column(spark):
    out = G.level_changes(panel(spark, [("A", 2022, 1.0)]))
    r = out.first()
    assert r["pedras_mudadas"] == 0.0 and r["pedras_mudadas_total"] == 0.0


def test_new_entities(spark):
    df = panel(spark, [("A", 2022, 1.0), ("A", 2023, 1.0), ("B", 2022, 1.0)])
    out = {r["RA"]: r["ingressante"] for r in G.new_entities(df).collect()}
    assert out == {"A": False, "B": True}


@pytest.mark.parametrize("codes,expected", [
    ([2.0, 1.0, 0.0], [1.0, 1.0, None]),
    ([1.0, 2.0], [0.0, None]),
    ([2.0, None, 1.0], [None, None, None]),
])
def test_drop_target(spark, codes, expected):
    out = G.drop_target(code_panel(spark, codes)).orderBy("ano")
    assert [r["target_queda_prox_ano"] for r in out.collect()] == expected


def test_history_stats_expanding(spark):
    df = spark.createDataFrame([("A", 2022, 4.0), ("A", 2023, None), ("A", 2024, 8.0)],
                               "RA string, ano int, INDE double")
    out = G.history_stats(df, ["INDE"]).orderBy("ano").collect()
    assert [r["INDE_media_hist"] for r in out] == [4.0, 4.0, 6.0]
    assert [r["INDE_min_hist"] for r in out] == [4.0, 4.0, 4.0]
    assert [r["INDE_max_hist"] for r in out] == [4.0, 4.0, 8.0]


def test_temporal_features_preserves_rows_and_single_exchange(spark):
    df = spark.createDataFrame([(f"E{i % 7}", 2020 + i // 7, float(i % 10), float(i % 4))
                                for i in range(70)], "RA string, ano int, INDE double, PEDRA_CODIGO double")
    out = G.temporal_features(df)
    assert out.count() == 70
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tiebreak_orders_within_same_time(spark):
    df = spark.createDataFrame([(1, 10, 2, 5.0), (1, 10, 1, 3.0), (1, 11, 3, 4.0)],
                               "user_id long, ts long, event_id long, value double")
    out = G.deltas(df, ["value"], "user_id", "ts", tiebreak=["event_id"]).orderBy("ts", "event_id").collect()
    assert [r["delta_value"] for r in out] == [None, 2.0, -1.0]


def test_rows_without_an_id_have_no_features(spark):
    rows = [(None, 2022, 5.0, 1.0, 1.0, 1.0, 2.0), (None, 2023, 7.0, 1.0, 1.0, 1.0, 1.0), (1, 2022, 5.0, 1.0, 1.0, 1.0, 2.0), (1, 2023, 7.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "RA int, ano int, INDE double, IEG double, IDA double, IPS double, PEDRA_CODIGO double")
    from cohortlens.operators import temporal as T

    out = T.drop_target(T.temporal_features(df)).collect()
    made = set(out[0].asDict()) - set(df.columns)
    assert len(made) > 10
    for r in out:
        if r["RA"] is None:
            assert all(r[c] is None for c in made)
    last = next(r for r in out if r["RA"] == 1 and r["ano"] == 2023)
    assert last["delta_INDE"] == 2.0 and last["anos_no_programa"] == 2 and last["pedras_mudadas_total"] == 1.0
