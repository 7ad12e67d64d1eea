"""End-to-end pipelines on sf0.001."""

import tempfile

from cohortlens.plans import pipelines as P
from cohortlens.sources import sinks as SK

from conftest import SF001


def test_train_all_writes_artifacts(spark):
    out = tempfile.mkdtemp(prefix="cohortlens-train-", dir="/tmp")
    res = P.train_all(spark, SF001, out, gbt_iter=3, n_init=2)
    assert SK.read_published_table(spark, out, "cluster_labels").count() == res["profiles"].names.count()
    assert 0 <= res["risk_metrics"]["f1"] <= 1
    assert SK.read_metrics(spark, out).count() == 6
    again = SK.load_published_model(spark, out, "classifier")
    rows = res["risk"].test_scored.limit(5).collect()
    assert rows and [t.value.tolist() for t in again.trees] == [t.value.tolist() for t in res["risk"].model.trees]
    assert (SK.load_published_model(spark, out, "profiles").centres == res["profiles"].model.centres).all()


def test_dashboard_quality_drift(spark):
    d = P.dashboard(spark, SF001)
    assert d["kpis"].first()["total_alunos"] > 0
    q = P.data_quality(spark, SF001, year=1996)
    assert q["per_year"].count() == 1
    n7 = P.drift_with_stats(spark, SF001)
    assert n7["summary"].count() == 1 and n7["text"].first()["texto"].startswith("- ")


def test_pipelines_on_the_users_own_files_and_frames(spark, tmp_path):
    from cohortlens.plans import catalog
    from cohortlens.plans.raw_years import raw_year_tables, write_year_csvs

    paths = write_year_csvs(raw_year_tables(spark, SF001), str(tmp_path / "csv"))
    panel = P.processed_panel(spark, paths)
    cols = ["RA", "ano", "INDE", "IEG", "PEDRA", "delta_INDE", "tendencia_INDE", "anos_no_programa", "ingressante"]
    key = lambda r: (r[0], r[1])
    got = sorted((tuple(r) for r in panel.select(*cols).collect()), key=key)
    want = sorted((tuple(r) for r in catalog.temporal_panel(spark, SF001).select(*cols).collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[4] == b[4] and a[7:] == b[7:]
        for x, y in zip(a[2:4] + a[5:7], b[2:4] + b[5:7]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)
    res = P.train_all(spark, paths, str(tmp_path / "out"), gbt_iter=2, n_init=1)
    assert res["profiles"].names.count() >= 2
    frame = spark.createDataFrame([(1, 2022, 5.0, "Ágata"), (1, 2023, float("nan"), "Quartzo")], "RA int, ano int, INDE double, PEDRA string")
    rows = P.processed_panel(spark, frame).orderBy("ano").collect()
    assert rows[1]["INDE"] is None and rows[1]["anos_no_programa"] == 2 and rows[1]["pedras_mudadas"] == 1.0


def test_listing_and_prompts_of_the_users_own_frame_in_one_chain(spark):
    from cohortlens.operators import models as ML
    from cohortlens.operators.reports import FULL_TEMPLATE
    from cohortlens.plans import catalog

    frame = catalog.named_panel(spark, SF001)
    panel = P.processed_panel(spark, frame)
    risk = ML.train_risk_classifier(P.G.drop_target(panel), max_iter=3)
    prof = ML.train_profiles(P.latest_profiles(panel), n_init=1)
    rows = P.listing(spark, frame, 1996, prof).collect()
    want = {r.RA: r.cluster_nome for r in ML.assign_profiles(prof, panel.where("ano = 1996").dropna(subset=prof.features)).collect()}
    assert len(rows) == panel.where("ano = 1996").count() and {r.ra: r.cluster for r in rows if r.cluster} == want
    prompts = P.report_dataset(spark, frame, risk, prof, FULL_TEMPLATE)
    first = prompts.where("risco_classe is not null").first()
    assert prompts.count() == panel.select("RA").distinct().count()
    assert f"Risco de Queda: {first.risco_classe} (" in first.prompt and f"Comportamental): {first.cluster_nome}" in first.prompt and "IPV (Ponto de Virada): 0.0" in first.prompt
    requests = spark.createDataFrame([("a", 2022, 5.0, None), ("b", 2022, 6.0, 7.0)], "aluno_id string, ano int, inde double, ieg double")
    requests = requests.withColumns({c: P.F.lit(None).cast("double") for c in ("ida", "ips", "iaa")})
    both = ML.score_requests(requests, risk, prof)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastHashJoin") <= 1
    got = {r.aluno_id: r for r in both.collect()}
    alone = {r.aluno_id: r.risco_probabilidade for r in ML.score_risk(risk, P.CL.risk_request_features(requests)).collect()}
    assert got["a"].ieg is None and {k: r.risco_probabilidade for k, r in got.items()} == alone  # medians, not the zeros of the profile features
    own = {r.aluno_id: r.cluster_id for r in ML.assign_profiles(prof, P.CL.cluster_request_features(requests)).collect()}
    assert {k: r.cluster_id for k, r in got.items()} == own
