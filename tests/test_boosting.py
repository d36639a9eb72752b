"""Boosted quantile trees against brute force and against plain residual quantiles."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import boosting as bo


def split_by_hand(x, g, rows, leaf_rows, penalty):
    """The best (feature, threshold) of the rows by trying every value."""
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[rows, f])[:-1]:
            left = rows[x[rows, f] <= v]
            right = rows[x[rows, f] > v]
            if min(len(left), len(right)) < leaf_rows:
                continue
            gain = g[left].sum() ** 2 / (len(left) + penalty) + g[right].sum() ** 2 / (len(right) + penalty) - g[rows].sum() ** 2 / (len(rows) + penalty)
            if round(gain, 9) > round(best[0], 9):
                best = (gain, (f, v))
    return best[1]


@pytest.mark.parametrize("share", [0.5, 0.1])
def test_two_level_tree_by_hand(spark, share):
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 8, size=(300, 2)).astype(float)
    y = 3 * (x[:, 0] > 3) + x[:, 1] * (x[:, 0] > 3) + rnd.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    model = bo.fit(df, ["a", "b"], [bo.Target("p", "y", share)], trees=1, rate=1.0, depth=2, leaves=4, leaf_rows=20, penalty=1.0)
    f = np.full(300, np.quantile(y, share))
    g = np.where(f > y, 1 - share, np.where(f < y, -share, 0.0))
    want = f.copy()
    todo = [(np.arange(300), 0)]
    while todo:
        rows, level = todo.pop()
        s = split_by_hand(x, g, rows, 20, 1.0) if level < 2 else None
        if s is None:
            want[rows] = f[rows] + np.quantile(y[rows] - f[rows], share)
        else:
            todo += [(rows[x[rows, s[0]] <= s[1]], level + 1), (rows[x[rows, s[0]] > s[1]], level + 1)]
    got = bo.predict(df, model).collect()
    assert np.allclose([r.p for r in got], want) and [r.y for r in got] == y.tolist()


def test_quantiles_beat_residual_quantiles(spark):
    """Several shares and a second target in one fit; unknown features and targets; held-out loss and coverage."""
    rnd = np.random.default_rng(2)
    n = 3000
    a, b = rnd.random(n), rnd.random(n)
    token = rnd.random(n) < .3
    y = 4 * a + (1 + 3 * b) * rnd.normal(size=n) + 5 * token
    rows = [(i, float(a[i]) if i % 50 else None, float(b[i]), ["out", "x"] if token[i] else [], float(y[i]) if i % 70 else None, float(a[i] > .5)) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, a double, b double, tokens array<string>, y double, z double")
    train, test = df.filter("i < 2000"), df.filter("i >= 2000")
    found = bo.token_flags(train, "tokens")
    assert set(found) == {"out", "x"}
    train, flags = bo.with_flags(train, "tokens", found)
    test, _ = bo.with_flags(test, "tokens", found)
    shares = {"p10": .1, "p50": .5, "p90": .9}
    targets = [bo.Target(k, "y", v) for k, v in shares.items()] + [bo.Target("z_", "z")]
    model = bo.fit(train, ["a", "b", *flags], targets, trees=14, rate=.3, leaf_rows=40)
    got = bo.predict(test, model, ordered=list(shares)).filter("y is not null").collect()
    t = np.array([r.y for r in got])
    loss = plain = 0.0
    known = y[:2000][np.arange(2000) % 70 > 0]
    for k, s in shares.items():
        p = np.array([r[k] for r in got])
        loss += np.maximum(s * (t - p), (s - 1) * (t - p)).mean()
        q = np.quantile(known, s)
        plain += np.maximum(s * (t - q), (s - 1) * (t - q)).mean()
    cover = np.mean([r.p10 <= r.y <= r.p90 for r in got])
    assert loss < .75 * plain and abs(cover - .8) < .05
    assert all(r.p10 <= r.p50 <= r.p90 for r in got)
    assert np.mean([abs(r.z_ - r.z) for r in got]) < .1
    after = bo.calibrated(bo.predict(test, model), bo.predict(test, model), "y", shares).filter("y is not null").collect()
    assert abs(np.mean([r.p10 <= r.y <= r.p90 for r in after]) - .8) < .02


def test_no_rows(spark):
    none = spark.createDataFrame([], "a double, y double")
    model = bo.fit(none, ["a"], [bo.Target("p", "y")], trees=2)
    assert [r.p for r in bo.predict(spark.createDataFrame([(1.0, 2.0)], "a double, y double"), model).collect()] == [0.0]
