"""Worked examples, as-of properties, and the split paths against brute force."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.functions import maths
from wattloom.operators import clusters, cleaning, events, forecast, lookups, market, models, outages, ranks, regimes, sequence

NTZ = "timestamp_ntz"


def times(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast(NTZ) for c in cols})


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    g = np.r_[np.zeros(3000), rng.integers(1, 6, 1500)].astype(int)
    v = np.round(rng.gamma(2, 50, len(g)), 1)
    v[:900] = 77.7                                     # a third of the hot group is one value
    return pd.DataFrame({"g": g, "v": v, "w": rng.integers(1, 9, len(g)).astype(float), "i": np.arange(len(g)), "y": np.round(v + rng.normal(0, 60, len(g)), 0)})


def test_quantiles_split_hot_group(spark, skewed):
    d = spark.createDataFrame(skewed)
    got = ranks.quantiles(d, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}, split_from=50).toPandas().set_index("g")
    ranged = ranks.value_ranges(d.select("g", "v").distinct(), ["g"], "v", split_from=50)
    assert ranged.filter("g = 0").select("_range").distinct().count() > 20
    for g, x in skewed.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(x.v, [0.1, 0.5, 0.99]))


def test_split_and_whole_prefix_agree(spark, skewed):
    d = spark.createDataFrame(skewed)
    a = ranks.prefix_weights(d, ["g"], ["v"], F.col("w"), split_from=50).orderBy("g", "v").toPandas()
    b = ranks.prefix_weights(d, ["g"], ["v"], F.col("w")).orderBy("g", "v").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_weighted_quantiles(spark, skewed):
    d = spark.createDataFrame(skewed)
    got = ranks.weighted_quantiles(d, ["g"], "v", "w", "i", {"a": 0.1, "b": 0.5}, split_from=50).toPandas().set_index("g")
    for g, x in skewed.sort_values(["v", "i"]).groupby("g"):
        mid = (x.w.cumsum() - x.w / 2) / x.w.sum()
        assert np.allclose(got.loc[g, ["a", "b"]].astype(float), np.interp([0.1, 0.5], mid, x.v))


def test_analogue_weights_are_summed_in_the_order_of_values(spark):
    """Rows that are lost in the sum share a mid-point, and where it meets a probability the total's last digit decides: it may not depend on the layout."""
    rng = np.random.default_rng(3)
    panel, shares = [], {}
    for g in range(120):
        v = [float(x) for x in rng.permutation(1000)[:40]]
        for day in range(8):
            near = rng.integers(5) if rng.random() < 0.4 else None     # far rows share a day equally, or a near one holds it all
            for slot in range(5):
                n = 5 * day + slot
                panel.append((g, slot, 31.0 if slot == near else 1e6, v[n], f"d{day}", n))
                shares.setdefault(g, []).append((v[n], 0.2 if near is None else 1.0 if slot == near else 1e-60))
    h = spark.createDataFrame(panel, "key int, slot int, k double, v double, day string, rid int").repartition(7)
    c = spark.range(120).select(F.col("id").alias("cid"), F.col("id").cast("int").alias("key"), F.lit(2).alias("q_slot"), F.lit(0.0).alias("q_k"))
    probs = {"a": 0.1, "b": 0.5, "c": 0.9}
    got = regimes.select_analogues(c, h, "cid", ["key"], "slot", 24, 2, {"k": 30.0}, "v", "day", "rid", neighbour_days=8, min_days=3, threshold=20.0, probs=probs).collect()
    assert len(got) == 120
    for r in got:
        v, w = np.array(sorted(shares[r.cid])).T
        end = np.cumsum(w)
        mid = (np.r_[0.0, end[:-1]] + w / 2) / end[-1]
        for name, p in probs.items():
            (l, a), (u, b) = max(y for y in zip(mid, v) if y[0] <= p), min(y for y in zip(mid, v) if y[0] >= p)
            assert r[name] == pytest.approx(b if l == u else a + (b - a) * (p - l) / (u - l), abs=1e-6)


def test_rank_correlation(spark, skewed):
    got = ranks.rank_correlation(spark.createDataFrame(skewed), ["g"], "v", "y", split_from=50).toPandas().set_index("g")
    for g, x in skewed.groupby("g"):
        assert got.loc[g, "rho"] == pytest.approx(x.v.rank().corr(x.y.rank()))


def test_quantile_grid_and_exceedance(spark, skewed):
    d = spark.createDataFrame(skewed)
    k = ranks.quantile_grid(d, ["g"], "v", 500, split_from=50).filter("g = 0").orderBy("knot").toPandas()
    want = np.quantile(skewed.v[skewed.g == 0], np.linspace(0, 1, 501))
    assert np.allclose(k.v, want)
    rows = d.select("g", F.lit(0.0).alias("f"), F.col("v").alias("threshold")).filter("g = 0").limit(50)
    train = d.select("g", F.col("v").alias("a"), F.lit(0.0).alias("f"))
    p = forecast.exceedance_probability(rows, train, ["g"], "a", "f", "threshold").toPandas()
    assert np.allclose(p.probability, np.interp(p.threshold, want, np.linspace(0, 1, 501)), atol=1e-9)


def test_running_and_previous_cross_chunks(spark):
    rng = np.random.default_rng(3)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 90 * 86400, 400)), unit="s")
    p = pd.DataFrame({"k": rng.integers(0, 2, 400), "t": t, "i": np.arange(400), "v": rng.integers(-5, 9, 400).astype(float)})
    d = spark.createDataFrame(p.assign(t=p.t.astype(str)), "k long, t string, i long, v double").withColumn("t", F.col("t").cast(NTZ))
    r = sequence.running(d, ["k"], ["t", "i"], "v", "s", hours=36)
    r = sequence.previous(r, ["k"], ["t", "i"], {"pv": "v"}, hours=36)
    r = sequence.previous(r, ["k"], ["t", "i"], {"nv": "v"}, hours=36, forward=True).orderBy("i").toPandas()
    g = p.groupby("k").v
    assert np.allclose(r.s, g.cumsum())
    assert np.allclose(r.pv.fillna(99), g.shift(1).fillna(99)) and np.allclose(r.nv.fillna(99), g.shift(-1).fillna(99))


def test_asof_ignores_the_future(spark):
    left = times(spark, [("a", "2024-01-03"), ("a", "2024-03-01"), ("b", "2024-01-03")], "k string, t string", "t")
    facts = [("a", "2024-01-01", 1.0), ("a", "2024-02-01", 2.0), ("b", "2024-01-04", 3.0)]
    def run(rows):
        r = times(spark, rows, "k string, e string, v double", "e")
        return {(x["k"], str(x["t"])): x["v"] for x in lookups.asof_backward(left, r, ["k"], "t", "e", ["v"], hours=48).collect()}
    before = run(facts)
    assert before == {("a", "2024-01-03 00:00:00"): 1.0, ("a", "2024-03-01 00:00:00"): 2.0, ("b", "2024-01-03 00:00:00"): None}
    assert run(facts + [("a", "2024-06-01", 9.0), ("b", "2025-01-01", 9.0)]) == before


def test_coherent_run_is_never_mixed_and_waits_for_completion(spark):
    rows = times(spark, [("g", "old", "2024-01-01 00:00:00", "2024-01-01 01:00:00", "demand"), ("g", "old", "2024-01-01 00:00:00", "2024-01-01 01:00:00", "wind"),
                         ("g", "new", "2024-01-01 06:00:00", "2024-01-01 07:00:00", "demand")], "grp string, run string, issue string, received string, variable string", "issue", "received")
    runs = lookups.run_index(rows, ["grp"], ["run"], "issue", "received")
    req = times(spark, [("g", "2024-01-01 08:00:00"), ("g", "2024-01-01 06:30:00"), ("g", "2024-01-09 00:00:00")], "grp string, origin string", "origin")
    got = {str(r["origin"]): r["run"] for r in lookups.coherent_run_asof(req, runs, ["grp"], "origin", "issue", ["run"], "48 hours").collect()}
    assert got == {"2024-01-01 08:00:00": "new", "2024-01-01 06:30:00": "old"}


def test_residue_examples(spark):
    d = spark.createDataFrame([(10.0, 15.0, 76.0, 10.0, 0.4), (50.0, 80.0, 100.0, 0.0, 0.5), (50.0, 80.0, -100.0, 0.0, 0.5)], "a double, b double, f double, l double, s double")
    got = [r[0] for r in d.select(market.residue(F.col("a"), F.col("b"), F.col("f"), F.col("l"), F.col("s")) * 12).collect()]
    assert got == pytest.approx([250.0, 3000.0, -3000.0])


@pytest.mark.parametrize("prices, flows, alloc, want", [
    ((30, 40, 50), (50, 100, 200), (-500, 1000, 4000), {"loop_NSWSA": 3000, "loop_VICSA": 1500, "loop_VICNSW": 0, "net_loop": 4500}),
    ((55, 10, 40), (10, 110, 40), (450, 3300, -600), {"loop_VICSA": 3150, "loop_NSWSA": 0, "amount_VS": 3600, "amount_NS": -450}),
    ((55, 10, 40), (10, 110, 40), (-450, 100, -600), {"loop_VICSA": 0, "loop_NSWSA": 0, "loop_VICNSW": 0}),
    ((30, 35, 60), (-200, 200, 0), (1000, 5000, 0), {"loop_NSWSA": 6000, "loop_NSWVIC": 0, "loop_VICSA": 0, "sq_NSWVIC": 1000, "sq_VICSA": 5000}),
])
def test_net_trade_examples(spark, prices, flows, alloc, want):
    cols = [f"p_{r}" for r in ("NSW", "VIC", "SA")] + [f"f_{k}" for k in ("VN", "VS", "NS")] + [f"a_{k}" for k in ("VN", "VS", "NS")]
    r = market.net_trade(spark.createDataFrame([tuple(map(float, prices + flows + alloc))], cols)).first()
    for k, v in want.items():
        assert r[k] == pytest.approx(v), k


def test_cap_and_ordinary_price(spark):
    d = times(spark, [("2025-06-30 23:55:00",), ("2025-07-01",), ("2026-07-01",)], "t string", "t")
    cap = cleaning.dated_step(F.col("t"), [("1990-01-01", 17500), ("2025-07-01", 20300), ("2026-07-01", 23200)])
    assert [r[0] for r in d.select(cap).collect()] == [17500, 20300, 23200]
    f = spark.createDataFrame([(x, 0) for x in (0, 4, 1, 5, 8, 16)] + [(None, 0)], "f int, s int")
    assert [r[0] for r in f.select(cleaning.ordinary_price(F.col("f"), F.col("s"))).collect()] == [True, True, False, False, False, True, False]


def landmark(spark, values, base=1000.0):
    rows = [(1, i, f"2024-01-01 00:{5 * i:02d}:00", v, base) for i, v in enumerate(values)]
    d = times(spark, rows, "ev int, offset int, t string, v double, base double", "t")
    return events.landmarks(d, ["ev"], "base", "t", "v").first()


def test_landmarks(spark):
    r = landmark(spark, [700.0, 650.0, 975.0, 980.0, 990.0, 200.0, 100.0])
    assert (r.trough, r.trough_time.minute, r.recovery.minute) == (650.0, 5, 10)
    r = landmark(spark, [700.0, 650.0, None, 1000.0, 1000.0, 1000.0])
    assert r.trough == 650.0 and r.recovery is None


def test_gap_blocks_detection(spark):
    v = [500.0] * 12 + [None] + [0.0] * 3
    rows = [("k", f"2024-01-01 {i // 12:02d}:{5 * (i % 12):02d}:00", x) for i, x in enumerate(v)]
    d = times(spark, rows, "key string, t string, v double", "t").withColumn("m", F.lit(1))
    got = events.contractions(d, ["key"], "t", "v", "m", lag=6, reach="30 minutes", minimum=1)
    assert got.filter("sharp").count() == 0


def test_matched_effect_recovers_built_in_change(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2024-01-01", periods=240)
    on = rng.random(240) < 0.2
    p = pd.DataFrame({"link": 1, "time": days.astype(str), "v": np.where(on, 400.0, 500.0) + rng.normal(0, 1, 240), "on": on.astype(int), "slot": days.dayofweek, "season": (days.month % 12 // 3)})
    d = spark.createDataFrame(p).withColumns({"time": F.col("time").cast(NTZ), "fams": F.when(F.col("on") == 1, "1").otherwise("")})
    tr = d.filter("on = 1").withColumns({"f": F.lit(1), "sig": F.lit("")}).drop("fams")
    ct = d.withColumns({"sig": F.col("fams"), "control_time": F.col("time")})
    free = ~F.array_contains(F.split("_c_fams", r"\|"), F.col("f").cast("string"))
    pairs = outages.matched_pairs(tr, ct, ["f", "link", "time"], "link", "time", 30, {"exact": ["season", "sig"]}, "slot", 7, 5, 17, free)
    u = outages.unit_effects(pairs, d, ["f"], "link", "time", "v").toPandas()
    assert len(u) == on.sum() and abs(u.effect.median() + 100) < 2


def test_bachelier(spark):
    rows = [(-3.0, 2.0), (0.0, 1.0), (5.0, 4.0), (2.0, 0.0), (-2.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "m double, s double").select(maths.bachelier_call(F.col("m"), F.col("s"))).collect()]
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    want = [s * math.exp(-(m / s) ** 2 / 2) / math.sqrt(2 * math.pi) + m * cdf(m / s) if s else max(m, 0) for m, s in rows]
    assert got == pytest.approx(want, abs=1e-6)


def test_regime_option_brute_force(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"k": 1, "reg": rng.integers(0, 3, 400), "q": rng.integers(0, 8, 400), "x": rng.normal(2, 9, 400), "f": rng.normal(5, 20, 400)})
    got = market.regime_option(spark.createDataFrame(p), ["k"], "reg", "q", "x", "f", 4).toPandas().set_index("q")
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    for q in range(4, 8):
        past, total = p[(p.q < q) & (p.q >= q - 4)], 0.0
        for reg, now in p[p.q == q].groupby("reg"):
            h = past[past.reg == reg]
            m, s = h.x.mean(), h.x.std()
            total += len(now) * h.f.clip(lower=0).mean() * (s * math.exp(-(m / s) ** 2 / 2) / math.sqrt(2 * math.pi) + m * cdf(m / s)) / 12
        assert got.loc[q, "option_value"] == pytest.approx(total, rel=1e-5)


def test_crps_matches_pairs(spark):
    m = [3.0, -1.0, 4.5, 2.2]
    got = spark.createDataFrame([(m, 1.5)], "m array<double>, y double").select(maths.crps(F.col("m"), F.col("y"))).first()[0]
    a = np.array(m)
    assert got == pytest.approx(np.abs(a - 1.5).mean() - 0.5 * np.abs(a[:, None] - a[None, :]).mean())


def test_chain_cycle_is_null(spark):
    d = spark.createDataFrame([(1, 2), (2, 3), (3, None), (7, 8), (8, 7), (9, None)], "id long, nxt long")
    got = {r["id"]: r["final_id"] for r in lookups.final_of_chain(d, "id", "nxt").collect()}
    assert got == {1: 3, 2: 3, 3: 3, 7: None, 8: None, 9: 9}


def test_state_clusters_find_separate_groups(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(30, 1, (60, 2))]
    d = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "truth": [0] * 60 + [1] * 60}))
    out = clusters.state_clusters(d, d, ["a", "b"], 2)
    assert clusters.adjusted_rand(out, "truth", "cluster").first()[0] == pytest.approx(1.0)
    assert out.filter("out_of_range = 1").count() <= 3


def test_fits_beat_the_mean(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"x": rng.normal(0, 1, 300), "z": rng.normal(0, 1, 300)})
    p["y"] = 3 * p.x + rng.normal(0, 0.3, 300)
    p["lab"] = (p.y > 0).astype(float)
    d = spark.createDataFrame(p)
    for out in (models.ridge(d, d, ["x", "z"], "y", 0.01), models.boosted_regressor(d, d, ["x", "z"], "y", 10, 3)):
        assert out.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.6 * p.y.abs().mean()
    pr = models.event_probability(d, d, d, ["x", "z"], "lab")
    assert pr.agg(F.avg((F.col("probability") - F.col("lab")) ** 2)).first()[0] < 0.1
    one = models.event_probability(d.withColumn("lab", F.lit(1.0)), d, d, ["x"], "lab")
    assert one.select("probability").distinct().collect() == [(1.0,)]


def test_analogue_never_relaxes_outage_state(spark):
    h = times(spark, [("k", s, 10, f"2024-01-{i + 1:02d}", float(100 * i), 5.0) for i, s in enumerate(["on", "on", "off"])], "key string, state string, slot int, rid string, v double, x double", "rid").withColumn("day", F.to_date("rid").cast("string"))
    c = spark.createDataFrame([("a", "k", "on", 10, 5.0), ("b", "k", "gone", 10, 5.0)], "cid string, key string, state string, q_slot int, q_x double")
    r = {x["cid"]: x for x in regimes.select_analogues(c, h, "cid", ["key", "state"], "slot", 24, 1, {"x": 1.0}, "v", "day", "rid", neighbour_days=5, min_days=2, threshold=50, probs={"p50": 0.5}).collect()}
    assert r["b"]["status"] == "unavailable" and r["a"]["status"] == "supported_analogue" and r["a"]["p50"] == 50.0


def test_merge_intervals_with_equal_spells(spark):
    rows = [("a", "2024-01-01", "2024-01-05"), ("a", "2024-01-01", "2024-01-05"), ("a", "2024-01-04", "2024-03-09"), ("a", "2024-03-09", "2024-03-10"), ("a", "2024-04-01", "2024-04-02")]
    d = times(spark, rows, "k string, s string, e string", "s", "e")
    got = sequence.merge_intervals(d, ["k"], "s", "e", hours=48).orderBy("s").collect()
    assert [(str(r.s)[:10], str(r.e)[:10]) for r in got] == [("2024-01-01", "2024-03-10"), ("2024-04-01", "2024-04-02")]


def test_records_of_any_width(spark, tmp_path):
    wide = [f"F{i}" for i in range(200)]
    lines = ["C,SETTLE,PREDISPATCHIS,A,B,2024/01/02,03:30:00", "I,T,X,1," + ",".join(wide), "I,T,Y,1,A,B", "D,T,X,1," + ",".join(str(i) for i in range(200)),
             'D,T,Y,1,"a ""b"", c",2', "I,T,Y,1,B,A", "D,T,Y,1,,9", "C,END"]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    from wattloom.sources import records
    got = records.tagged_scan(records.tagged_lines(spark, str(tmp_path)), "T_X", ["F0", "F76", "F199", "NONE"], "PREDISPATCHIS").collect()
    assert [(r.F0, r.F76, r.F199, r.NONE, r.ISSUED_AT) for r in got] == [("0", "76", "199", None, "2024/01/02 03:30:00")]
    # the last header of a table version stands
    got = records.tagged_scan(records.tagged_lines(spark, str(tmp_path)), "T_Y", ["A", "B"]).collect()
    assert sorted((r.A, r.B) for r in got if r.B) == [("2", 'a "b", c')] and [(r.A, r.B) for r in got if not r.B] == [("9", None)]


def test_archives_of_any_depth_in_parts(spark):
    import io
    import zipfile

    from wattloom.sources import records
    blob = ("line\n" * 1000).encode()
    name = "a.txt"
    for depth in range(6):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, blob)
        blob, name = b.getvalue(), f"z{depth}.zip"
    d = spark.createDataFrame([("p", bytearray(blob))], "path string, content binary")
    rows = records.expand_archives(d, piece=700).orderBy("part").collect()
    assert len(rows) > 3 and "".join(r.text for r in rows) == "line\n" * 1000 and all(r.text.endswith("\n") for r in rows)
    assert rows[0].member == "z4.zip/z3.zip/z2.zip/z1.zip/z0.zip/a.txt"


def test_chains_of_any_length_and_cycles(spark):
    from wattloom.operators.lookups import final_of_chain
    links = [(i, i + 1) for i in range(500)] + [(500, None), (900, 901), (901, 902), (902, 900), (899, 900), (950, 950)] + [(1000 + i, 1000 + (i + 1) % 37) for i in range(37)]
    d = spark.createDataFrame(links, "id long, nxt long")
    got = {r.id: r.final_id for r in final_of_chain(d, "id", "nxt").collect()}
    assert got == {**{i: 500 for i in range(501)}, **{i: None for i in (899, 900, 901, 902, 950)}, **{1000 + i: None for i in range(37)}}
    got = {r.id: r.final_id for r in final_of_chain(d, "id", "nxt", cycle="member").collect()}
    assert got == {**{i: 500 for i in range(501)}, **{i: 900 for i in (899, 900, 901, 902)}, 950: 950, **{1000 + i: 1000 for i in range(37)}}


def test_points_near_anywhere(spark):
    import itertools
    import math
    import random

    from wattloom.operators.lookups import nearest_place, nearest_within

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 12742 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))
    rnd = random.Random(1)
    places = [(65.0, 10.0), (65.2, 11.0), (-30.0, 179.99), (-30.0, -179.95), (89.9, 0.0), (89.9, 180.0), (0.0, 0.0)]
    places += [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(places)], "i int, lat double, lon double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(places)], "j int, slat double, slon double")
    for reach in (30.0, 500.0, 6000.0, 21000.0):
        got = sorted((r.i, r.j) for r in nearest_within(p, s, "lat", "lon", "slat", "slon", reach).collect())
        assert got == sorted((i, j) for i, j in itertools.product(range(len(places)), repeat=2) if km(*places[i], *places[j]) <= reach), reach
    towns = spark.createDataFrame([("Alpha", 0.0, 0.0, "R1"), ("Beta", 10.0, 0.0, "R2")], "name string, plat double, plon double, region string")
    at = spark.createDataFrame([(1, 0.05, 0.0), (2, 3.0, 0.0), (3, 10.0, 60.0)], "i int, lat double, lon double")
    got = {r.i: (r.label, r.area) for r in nearest_place(at, towns, "i", "lat", "lon", "name", "plat", "plon", "region").collect()}
    empty = nearest_place(at, towns.limit(0), "i", "lat", "lon", "name", "plat", "plon", "region").collect()
    assert [(r.place, r.label, r.km) for r in empty] == [(None, None, None)] * 3
    grid = spark.range(12_000).selectExpr("concat('p', id) as name", "-60 + (id % 120) as plat", "-50 + cast(id / 120 as int) as plon", "'R' as region")
    odd = spark.createDataFrame([(1, 0.4, 0.3), (2, 85.0, 175.0), (3, None, 1.0), (1, 0.4, 0.3)], "i int, lat double, lon double")
    want = {i: min((km(a, b, -60 + k % 120, -50 + k // 120), f"p{k}") for k in range(12_000))[1] for i, a, b in ((1, .4, .3), (2, 85., 175.))}
    assert sorted((r.i, r.place) for r in nearest_place(odd, grid, "i", "lat", "lon", "name", "plat", "plon", "region").collect()) == [(1, want[1])] * 2 + [(2, want[2]), (3, None)]
    assert got[1] == ("central Alpha", "R1:Alpha") and got[2] == ("north of Alpha (334 km)", "R1:north Alpha") and got[3][1] == "R2:east Beta"


def test_null_stamps_and_keys_stay(spark):
    from pyspark.sql import functions as F

    from wattloom.operators import sequence
    d = spark.createDataFrame([(1, "a", "2024-01-01", 1), (2, "a", None, 2), (3, None, "2024-01-02", 4), (4, None, "2024-03-02", 8)], "i int, k string, t string, v int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert {r.i: r.s for r in sequence.running(d, ["k"], ["t", "i"], "v", "s").collect()} == {2: 2, 1: 3, 3: 4, 4: 12}
    assert sequence.previous(d, ["k"], ["t", "i"], {"p": "v"}).count() == 4
    assert sequence.windowed(d, ["k"], "t", lambda w: {"p": F.lag("v").over(w)}, before="1 day").count() == 4
    assert {r.i: r.x for r in sequence.last_known(d, ["k"], ["t", "i"], {"x": F.col("v")}).collect()} == {1: 1, 2: 2, 3: 4, 4: 8}


def test_event_probability_keeps_unknown_features(spark):
    rows = [(k, float(k % 7), int(k % 7 > 3)) for k in range(70)]
    train = spark.createDataFrame(rows, "k int, x double, y int")
    asked = spark.createDataFrame([(1, 2.0, 0), (2, None, 0), (3, float("nan"), 1), (3, float("nan"), 1)], "k int, x double, y int")
    got = sorted((r.k, r.probability is None) for r in models.event_probability(train, train, asked, ["x"], "y").collect())
    assert got == [(1, False), (2, True), (3, True), (3, True)]
