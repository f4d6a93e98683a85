"""Hand-made cases: bucket edges, tails, null paths, point-in-time invariance."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as E
from tidemark.functions import scores as C
from tidemark.operators import folds, series, stats
from tidemark.sources import storage


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_bucket_edges(spark):
    edges = [(0, 25, "CALM"), (25, 45, "ELEVATED"), (45, 101, "STRESS")]
    df = spark.createDataFrame([(v,) for v in (10.0, 24.99, 25.0, 44.99, 45.0, 90.0)], "x double")
    assert [r[0] for r in df.select(E.bucket("x", edges)).collect()] == ["CALM", "CALM", "ELEVATED", "ELEVATED", "STRESS", "STRESS"]


def test_scalars(spark):
    null = F.lit(None).cast("double")
    r = one(spark, a=E.clamp(null, 0, 1), b=E.clamp(F.lit(5.0), 0, 1), c=E.z_fixed(null, 1, 2), d=E.ratio(F.lit(1.0), F.lit(0.0)), e=E.finite(F.lit(float("nan"))), f=E.normal_cdf(F.lit(1.96)), g=E.squash(F.lit(0.0), 0, 1), h=E.decay(F.lit(6.0), 3))
    assert (r.a, r.b, r.c, r.d, r.e, r.g, r.h) == (None, 1.0, 0.0, None, None, 0.0, 0.25)
    assert math.isclose(r.f, 0.9750021, abs_tol=1e-6)


def test_weighted_mean_renormalises(spark):
    df = spark.createDataFrame([(0.2, None, 0.8), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(E.weighted_mean([("a", 0.5), ("b", 0.3), ("c", 0.2)])).collect()]
    assert math.isclose(got[0], (0.1 + 0.16) / 0.7) and got[1] is None


def test_interpolation(spark):
    df = spark.createDataFrame([(-9.0,), (-4.0,), (3.0,), (None,)], "x double")
    got = [r[0] for r in df.select(E.interpolate("x", C.QUANTILE_ANCHORS)).collect()]
    assert got[0] == 0.95 and math.isclose(got[1], 0.625) and got[2] == 0.01 and got[3] is None


def test_blend_weights():
    assert math.isclose(sum(C.BLEND.values()), 1.0)


def test_forward_return_tail(spark):
    df = spark.createDataFrame([("a", i, 100.0 + i) for i in range(10)], "k string, t int, p double")
    got = [r[0] for r in df.select(series.forward_return("p", series.over("k", "t"), 3)).collect()]
    assert math.isclose(got[0], 0.03) and got[-3:] == [None, None, None]


def test_asof_lookback(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    left = spark.createDataFrame([("a", day(9)), ("a", day(10)), ("b", day(9))], "k string, d date")
    right = spark.createDataFrame([("a", day(0), 7.0)], "k string, d date, v double")
    got = {(r.k, r.d): r.v for r in series.asof(left, right, "k", "d", "v", "v", 10).collect()}
    assert got == {("a", day(9)): 7.0, ("a", day(10)): None, ("b", day(9)): None}


def test_nearest_prefers_earlier_on_ties(spark):
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    left = spark.createDataFrame([("a", at(10)), ("a", at(40))], "k string, t timestamp")
    right = spark.createDataFrame([("a", at(5), 1.0), ("a", at(15), 2.0)], "k string, t timestamp, v double")
    got = [r.v for r in series.nearest(left, right, "k", "t", "v", "v", 600).orderBy("t").collect()]
    assert got == [1.0, None]


def test_robust_z_point_in_time(spark):
    x = np.random.default_rng(1).normal(size=60)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t int, x double")
    run = lambda d: {r.t: r.z for r in series.robust_z(d, "x", "z", "k", "t", 20, 5).collect()}
    whole, cut = run(df), run(df.where("t < 40"))
    assert all(whole[t] == cut[t] for t in cut)
    seg = x[21:41]
    med = np.median(seg)
    assert math.isclose(whole[40], (x[40] - med) / (1.4826 * np.median(abs(seg - med))), rel_tol=1e-9)


def test_bootstrap_brackets_the_mean(spark):
    x = np.random.default_rng(2).normal(-2, 5, 200)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t int, x double")
    r = stats.bootstrap_mean(df, "k", "x", "t").first()
    assert r.low < r.mean < r.high and math.isclose(r.mean, x.mean(), rel_tol=1e-9)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1)], "k string, y int, p double")
    assert stats.auc(df, "k", "y", "p").first().auc == 0.875


def test_purged_folds_keep_their_distance(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)], "k string, t int")
    f = stats.purged_folds(df, "k", "t", 5, 3).toPandas()
    for _, g in f.groupby("fold"):
        test, train = g[g.role == "test"].t.to_numpy(), g[g.role == "train"].t.to_numpy()
        assert abs(test[:, None] - train[None]).min() > 3


def test_folds():
    x = np.array([1.0, 2.0, 3.0, 2.0, 4.0])
    assert np.allclose(folds.ema(x, 0.5), [1, 1.5, 2.25, 2.125, 3.0625])
    assert folds.rsi_first(np.arange(20.0)) == 100.0
    assert np.isnan(folds.rsi_wilder(x)).all()
    k = folds.kalman(np.array([1.0, np.nan, np.nan, 2.0]))
    assert k[0] == k[1] == k[2] == 1.0 and 1 < k[3] < 2
    assert folds.episodes(np.array([5.0, 4, 1, 9, 8]), 2, 1).tolist() == [True, False, False, True, False]
    p = folds.hmm_filter(np.concatenate([np.full(30, 1.0), np.full(30, -1.0)]) + np.random.default_rng(0).normal(0, 0.1, 60), 2)
    assert p[10, 0] > 0.9 and p[50, 1] > 0.9


def test_trade_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,10.5,2,1,1,1700000000000,true,true\n2,11,1,2,2,1700000000000000,false,true\n")
    got = storage.read_trades(spark, f"file://{tmp_path}/t.csv").collect()
    assert got[0]["at"] == got[1]["at"] and got[0]["is_buyer_maker"]


def test_series_sentinel_and_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"series_id":"A","date":"2024-01-01","value":"."}\n{"series_id":"A","date":"2024-01-02","value":"1.5"}\n')
    assert [r.value for r in storage.read_series(spark, f"file://{tmp_path}/s.json").orderBy("date").collect()] == [None, 1.5]
    (tmp_path / "m.json").write_text('{"2024-01-01": 1.0, "2024-01-02": 2.0}\n')
    assert storage.read_date_map(spark, f"file://{tmp_path}/m.json").count() == 2
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert json.loads(storage.json_rows(df).first().value) == {"a": 1, "b": None}


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/u"
    storage.publish(old, path, 1)
    storage.upsert(storage.published(spark, path), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"], path, 2)
    assert sorted((r.k, r.v) for r in storage.published(spark, path).collect()) == [(1, "a"), (2, "z"), (3, "w")]


def test_reads_of_one_partition_skip_the_others(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    storage.write_bars(spark.createDataFrame([("A", 1.0), ("B", 2.0)], "asset string, close double"), path)
    one = spark.read.parquet(path).where("asset = 'A'").select("close")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(asset" in plan and "ReadSchema: struct<close:double>" in plan


@pytest.mark.parametrize("n", [0, 1])
def test_latest_of_few(spark, n):
    df = spark.createDataFrame([(1, i) for i in range(n)], "k int, t int")
    assert storage.latest(df, ["k"], ["t"]).count() == n


def test_average_linkage_joins_the_nearest_first():
    from tidemark.plans.linear import average_linkage

    rho = np.array([[1, 0.9, 0.1, 0.0], [0.9, 1, 0.2, 0.1], [0.1, 0.2, 1, -0.8], [0.0, 0.1, -0.8, 1]])
    assert average_linkage(rho, 0.5).tolist() == [0, 0, 1, 1] and average_linkage(rho, 0.05).tolist() == [0, 1, 2, 3] and average_linkage(rho, 2).tolist() == [0] * 4


def test_regime_filter_gives_chances_and_minds_the_breaker():
    from tidemark.plans.layers import CENTRES, regime_filter

    rng = np.random.default_rng(1)
    x = np.clip(CENTRES[np.repeat([0, 3, 0], 130)] + rng.normal(0, 8, (390, 5)), 0, 100)
    x[350:353, 3] = 90
    p = regime_filter(x, window=200)
    assert np.isnan(p[:200]).all() and np.allclose(p[200:].sum(axis=1), 1) and (p[200:] >= 0).all()
    assert (p[351, 2] + p[351, 3]) >= 0.7 - 1e-9 and p[220:250].argmax(axis=1).tolist().count(3) > 20
