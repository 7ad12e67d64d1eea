"""Hot-entity split: identical results to plain windows, hot rows spread out."""

import numpy as np

from cohortlens.operators.skew import entity_features, running_value_stats

COLS = ["user_id", "event_id", "n_seq", "delta_value", "value_media_hist", "value_min_hist",
        "value_max_hist", "value_soma_hist", "n_total", "tendencia_value"]


def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    users = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 200, n))   # user 0 holds ~1/3
    ts = rng.integers(0, 500, n)                                           # many time ties
    vals = rng.normal(5, 2, n).round(2)
    vals[rng.random(n) < 0.05] = np.nan
    rows = [(int(u), int(t), i, None if np.isnan(v) else float(v)) for i, (u, t, v) in enumerate(zip(users, ts, vals))]
    return spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double")


def collect(df):
    out = {}
    for r in df.select(*COLS).collect():
        out[r["event_id"]] = tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    return out


def test_chunked_equals_plain(spark):
    df = skewed(spark)
    plain = collect(running_value_stats(df, "user_id", "ts", "value", ["event_id"], min_hot_rows=10**9))
    chunked = collect(running_value_stats(df, "user_id", "ts", "value", ["event_id"],
                                          min_hot_rows=10, n_chunks=16))
    assert plain.keys() == chunked.keys()
    diff = [k for k in plain if plain[k] != chunked[k]]
    assert not diff, (plain[diff[0]], chunked[diff[0]])


def test_hot_entity_is_split_across_window_partitions(spark):
    df = skewed(spark)
    out = running_value_stats(df, "user_id", "ts", "value", ["event_id"], min_hot_rows=100, n_chunks=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__k" in plan  # hot rows are windowed per (entity, chunk)


def test_rows_without_an_id_pass_by(spark):
    from pyspark.sql import functions as F
    df = skewed(spark)
    nameless = df.withColumn("user_id", F.when(F.col("event_id") % 3 > 0, F.col("user_id")))
    rows = collect(running_value_stats(nameless, "user_id", "ts", "value", ["event_id"], min_hot_rows=50, n_chunks=8))
    want = collect(running_value_stats(nameless.where("user_id is not null"), "user_id", "ts", "value", ["event_id"], min_hot_rows=10**9))
    assert len(rows) == df.count()
    near = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1e-8
    assert [(v, rows[k]) for k, v in want.items() if not all(map(near, v, rows[k]))] == [] and len(want) < len(rows)
    assert all(v[2:] == (None,) * len(v[2:]) for v in rows.values() if v[0] is None)


def half_in_one(spark, n=3000, nameless=False):
    """One user with half of the rows, many equal times, NULL levels, values and names."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.5 else int(rng.integers(1, 60))
        rows.append((None if nameless and rng.random() < 0.1 else user, int(rng.integers(0, 200)), i,
                     None if rng.random() < 0.1 else float(np.round(rng.normal(5, 2), 2)),
                     None if rng.random() < 0.2 else float(rng.integers(0, 4)), f"n{i}" if rng.random() < 0.02 else None))
    return spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double, code double, name string")


FEATURES = ["tendencia_value_asof", "pedras_mudadas", "pedras_mudadas_total", "vai_cair", "name"]


def features(df, **sizes):
    from cohortlens import constants as K
    out = entity_features(df, "user_id", "ts", ["event_id"], y="value", code_col="code", name_col="name", **sizes)
    return {r["event_id"]: [r[c if c != "vai_cair" else K.TARGET_COL] for c in FEATURES] for r in out.collect()}


def near(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9 for x, y in zip(a, b))


def test_ordered_features_of_a_hot_entity_equal_the_plain_windows(spark):
    df = half_in_one(spark)
    plain = features(df, min_hot_rows=10**9)
    for sizes in ({"min_hot_rows": 100, "n_chunks": 16}, {"min_hot_rows": 5, "n_chunks": 300}, {"min_hot_rows": 20, "n_chunks": 2}):
        chunked = features(df, **sizes)
        assert chunked.keys() == plain.keys()
        assert [(k, v, plain[k]) for k, v in chunked.items() if not near(v, plain[k])][:3] == []


def test_no_window_holds_a_whole_hot_entity(spark):
    """Windows on the hot side are by (entity, chunk), or over the chunks of an entity."""
    from cohortlens.operators import skew
    df = half_in_one(spark, 400)
    _, cold, hot = skew._by_size(df, "user_id", 100)
    assert hot.select("user_id").distinct().count() == 1 and cold.where("user_id = 0").count() == 0


def test_ordered_features_without_an_id_one_time_and_nulls(spark):
    df = half_in_one(spark, 1200, nameless=True)
    rows = features(df, min_hot_rows=50, n_chunks=8)
    named = features(df.where("user_id is not null"), min_hot_rows=10**9)
    assert len(rows) == 1200 and [(k, v, rows[k]) for k, v in named.items() if not near(v, rows[k])] == []
    assert all(rows[k][:4] == [None] * 4 for k in rows.keys() - named.keys())
    same = spark.createDataFrame([(1, 7, i, float(i), None, None) for i in range(40)], "user_id long, ts long, event_id long, value double, code double, name string")
    got = features(same, min_hot_rows=5, n_chunks=4)
    assert all(v == [0.0, 0.0, 0.0, None, None] for v in got.values())


def test_a_large_entity_gets_more_chunks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cohortlens.operators import skew

    monkeypatch.setattr(skew, "CHUNK_ROWS", 50)
    rows = [(0 if i % 2 else 1 + i % 9, i, float(i), float(i * 7 % 13)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double, v double")
    ids = skew._hot_ids(df, "user_id", 20)
    _, _, hot = skew._by_size(df, "user_id", 20, ids)
    bounds = {r.user_id: len(r["__b"]) for r in skew._chunk_bounds(hot, ids, "user_id", F.col("t"), 4).collect()}
    assert bounds.pop(0) == 19 and set(bounds.values()) == {3}
    got = {r.event_id: (r.n_seq, r.v_soma_hist, r.delta_v) for r in skew.running_value_stats(df, "user_id", "t", "v", ["event_id"], 20, 4, slope=False).collect()}
    want, state = {}, {}
    for user, event, _, v in rows:
        n, total, last = state.get(user, (0, 0.0, None))
        state[user] = (n + 1, total + v, v)
        want[event] = (n + 1, total + v, None if last is None else v - last)
    assert got == want
