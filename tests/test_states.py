"""State clusters, mixtures, stability, components and the residual stage against numpy."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import mixtures as mx
from wattloom.operators import models, spectral


def frame(spark, n=240):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(n):
        far = i % 3 == 0
        room = rnd.normal(8 if far else 0)
        rows.append((i, dt.date(2024, 1, 1) + dt.timedelta(days=i // 8), room, room * 2 + 1, float(rnd.normal(-4 if far else 4)), 7.0, float(rnd.normal(3 if far else 0)) if i % 11 else None, None if i % 20 else 1.0, int(far)))
    return spark.createDataFrame(rows, "i int, day date, room double, copy double, flow double, fixed double, pressure double, sparse double, truth int")


GROUPS = {"network": ["room", "copy", "flow", "fixed"], "constraint": ["pressure", "sparse"]}


def test_states(spark):
    d = frame(spark)
    model = mx.fit_states(d, GROUPS, 2, "mixture", restarts=2, steps=15)
    assert model.features == ["room", "flow", "pressure"]
    assert model.dropped == {"copy": "near_duplicate of room", "fixed": "constant", "sparse": "too_missing"}
    assert model.weights == [1 / math.sqrt(2)] * 2 + [1.0]
    p = np.array([r.pressure for r in d.orderBy("i").collect()], dtype=float)
    filled = np.where(np.isnan(p), np.nanmedian(p), p)
    assert model.medians[2] == pytest.approx(np.nanmedian(p)) and model.spreads[2] == pytest.approx(np.quantile(filled, .75) - np.quantile(filled, .25))
    out = mx.assign(d, model).orderBy("i").collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.distance >= 0 for r in out)
    agree = np.mean([r.cluster == r.truth for r in out])
    assert max(agree, 1 - agree) > .97 and sum(r.out_of_range for r in out) <= .01 * len(out) + 1
    assert sorted(model.means.tolist()) == model.means.tolist()
    far = mx.assign(d.limit(2).withColumns({"room": F.lit(1e12), "pressure": F.lit(1e12)}), model)
    assert all(r.out_of_range for r in far.collect())
    one = mx.fit_states(d, GROUPS, 1, "mixture")
    assert all(r.cluster == 0 and r.probabilities == [1.0] for r in mx.assign(d, one).collect())
    with pytest.raises(ValueError):
        mx.fit_states(d, {"a": ["fixed"]}, 2)


def test_em_and_lloyd_by_hand(spark):
    rnd = np.random.default_rng(4)
    z = np.concatenate([rnd.normal(size=(60, 2)), rnd.normal(size=(30, 2)) + 4])
    rows = spark.createDataFrame([(v.tolist(), float(i % 3)) for i, v in enumerate(z)], "z array<double>, w double")
    m, v, p = np.array([[0., 1.], [3., 3.]]), np.array([[1., 2.], [2., 1.]]), np.array([.4, .6])
    model = mx.States([], {}, means=m, variances=v, shares=p)
    got, history = mx.em_steps(rows, model, 3)
    for step in range(3):
        logs = np.log(p) - .5 * (np.log(2 * np.pi * v).sum(1) + ((z[:, None] - m) ** 2 / v).sum(2))
        norm = np.log(np.exp(logs).sum(1))
        assert history[step] == pytest.approx(norm.mean())
        r = np.exp(logs - norm[:, None])
        n = r.sum(0)
        m, v, p = r.T @ z / n[:, None], r.T @ z ** 2 / n[:, None] - (r.T @ z / n[:, None]) ** 2 + 1e-6, n / len(z)
    assert np.allclose(got.means, m) and np.allclose(got.variances, v) and np.allclose(got.shares, p)
    starts = np.array([[[0., 0.], [1., 1.]], [[5., 5.], [0., 3.]]])
    centres, _ = mx.lloyd(rows, starts, 2, [F.lit(1.0), F.col("w")])
    for k, w in enumerate((np.ones(90), np.arange(90) % 3.0)):
        c = starts[k].copy()
        for _ in range(2):
            lab = ((z[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([np.average(z[lab == j], axis=0, weights=w[lab == j]) if w[lab == j].sum() else c[j] for j in range(2)])
        assert np.allclose(centres[k], c)


def test_stability(spark):
    d = frame(spark)
    got = mx.stability(d, GROUPS, 2, "day", seeds=(1, 2), steps=10).collect()
    assert sorted((r.leg, r.a, r.b) for r in got) == [("block", "block_1", "block_2"), ("seed", "seed_1", "seed_2")]
    assert all(r.ari > .9 for r in got)
    labels = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 1, 0), (1, 0, 0)], "x int, y int, q int")
    pairs = {(r.a, r.b): r.ari for r in mx.pairwise_rand(labels, ["x", "y", "q"]).collect()}
    assert pairs["x", "q"] == pytest.approx(1.0) and pairs["x", "y"] == pytest.approx(0.0) and len(pairs) == 3


def test_components_are_a_dense_decomposition(spark):
    rnd = np.random.default_rng(17)
    x = rnd.normal(size=(10, 30)) * (rnd.random((10, 30)) < .6)
    x[0] *= 4
    x[1] *= 3
    rows = [(f"D{i:02d}", f"e{j}", float(x[i, j])) for i in range(10) for j in range(30)] + [("D00", "e0", None), (None, "e1", 1.0)]
    df = spark.createDataFrame(rows, "unit string, eq string, x double")
    got = spectral.signed_components(df, "unit", "eq", "x", 2, rounds=15).collect()
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    for k in range(2):
        mine = {r.unit: r for r in got if r.component == k}
        load = u[:, k] * np.sign(u[np.abs(u[:, k]).argmax(), k])
        assert np.allclose([mine[f"D{i:02d}"].loading for i in range(10)], load, atol=1e-4)
        assert all(r.singular_value == pytest.approx(s[k], rel=1e-6) for r in mine.values())
    assert spectral.signed_components(df.limit(0), "unit", "eq", "x", 2).count() == 0
    groups = spectral.manual_groups(df.filter("unit is not null"), spark.createDataFrame([("D00", "b"), ("D00", "a"), ("D01", "c")], "unit string, g string"), "unit", "g")
    assert {r.unit: r.g for r in groups.collect()} == {f"D{i:02d}": {0: "a", 1: "c"}.get(i, "other") for i in range(10)}


def test_residual_stage_by_hand(spark):
    rnd = np.random.default_rng(5)
    day = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 2) for i in range(120)]
    x, h = rnd.normal(size=120), rnd.normal(size=120)
    y = 2 * x + 1 + np.where(np.arange(120) >= 90, 3 * h, 0)
    df = spark.createDataFrame([(d, float(a), float(b) if i != 5 else None, float(c)) for i, (d, a, b, c) in enumerate(zip(day, x, h, y))], "o timestamp_ntz, x double, h double, y double")
    got = models.residual_stage(df, df, "o", ["x"], ["h"], "y", 0.3).collect()

    def line(a, b):
        s = ((a - a.mean()) * (b - b.mean())).sum() / (((a - a.mean()) ** 2).sum() + .3)
        return s, b.mean() - s * a.mean()
    split = sorted(set(day))[45]
    first = np.array([d < split - dt.timedelta(days=8) for d in day])
    late = np.array([d >= split for d in day])
    s, c = line(x[first], y[first])
    s2, c2 = line(h[late], y[late] - s * x[late] - c)
    s3, c3 = line(x, y)
    want = s3 * x + c3 + s2 * h + c2
    assert got[5].prediction is None
    assert np.allclose([r.prediction for i, r in enumerate(got) if i != 5], np.delete(want, 5))
