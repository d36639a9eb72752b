"""Steps whose shuffles and broadcasts must not grow faster than their input."""
import datetime as dt
import hashlib
import random
from types import SimpleNamespace

import duckdb
from pyspark.sql import functions as F

from tests.oracle import compare
from wattloom.operators import clusters, constraints, lookups, market, mixtures, outages, ranks, resample
from wattloom.operators.forecast import draw_below, uniform
from wattloom.plans import ORACLE, feeds, outages as outage_plans, regimes, reshaping
from wattloom.session import Tables, cut
from wattloom.sources import records


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stamp(text):
    return dt.datetime.fromisoformat(text)


def equation_frames(spark):
    months = [stamp(f"2024-{m:02d}-01") for m in (1, 2, 3)]
    present = spark.createDataFrame([(e, m) for e in (1, 2) for m in months if (e, m.month) != (2, 2)], "eq long, month timestamp_ntz")
    sens = spark.createDataFrame([(1, 7, 2.0), (1, 8, -1.0), (2, 7, 0.5), (2, 9, 0.0), (3, 7, 1.0)], "eq long, unit long, sensitivity double")
    return months, present, sens


def test_pressure_shuffles_no_product(spark):
    months, present, sens = equation_frames(spark)
    delta = {(7, 1): 4.0, (7, 2): -2.0, (7, 3): None, (8, 2): 3.0, (8, 3): 5.0}
    moves = spark.createDataFrame([(u, months[m - 1], d) for (u, m), d in delta.items()], "unit long, month timestamp_ntz, delta double")
    got = constraints.pressure(present, sens, moves, ["eq"], "unit", "month", "delta")
    plan = plan_of(got)
    assert "Exchange" not in plan[:plan.index("inline")]
    want = {(1, 1): (8.0, 0.0, 8.0, 0), (1, 2): (-7.0, 7.0, 0.0, 1), (1, 3): (-5.0, 5.0, 0.0, 0), (2, 1): (2.0, 0.0, 2.0, 1), (2, 3): (None, None, None, 0)}
    rows = {(r.eq, r.month.month): (r.bound_move, r.upper_tightening, r.upper_relief, r.complete) for r in got.collect()}
    assert {k: v if v[0] is not None else (None, None, None, v[3]) for k, v in rows.items()} == want


def test_relief_shuffles_no_product(spark):
    months, present, sens = equation_frames(spark)
    units = spark.createDataFrame([(7, months[0], 10.0, 40.0, 0.5), (7, months[2], 20.0, 21.0, 2.0), (8, months[0], 5.0, 6.0, 1.0)],
                                  "unit long, month timestamp_ntz, mw double, availability double, ramp_up double").withColumn("ramp_down", F.col("ramp_up"))
    got = constraints.available_relief(present, sens, units, ["eq"], "unit", "month")
    plan = plan_of(got)
    assert "Exchange" not in plan[:plan.index("inline")]
    rows = {(r.eq, r.month.month): (r.upper_relief_mw, r.lower_relief_mw) for r in got.collect()}
    assert rows == {(1, 1): (30.0 + 5.0, 20.0 + 1.0), (1, 3): (2.0, 40.0), (2, 1): (7.5, 5.0), (2, 3): (0.5, 10.0)}


def test_anchors_with_offsets_are_not_broadcast(spark):
    a = spark.createDataFrame([(1, "start", stamp("2024-01-05"))], "link long, anchor string, anchor_time timestamp_ntz")
    s = spark.createDataFrame([(1, stamp("2024-01-04"), 0.25), (1, stamp("2024-01-05"), 0.5)], "link long, time timestamp_ntz, share double")
    d = outages.offset_profile(a, s, ["link"], "time", "share", -5, 5, "1 day", ["anchor"])
    assert "BroadcastExchange" not in plan_of(d)
    assert sorted((r.offset, r.share, r.n) for r in d.collect()) == [(-1, 0.25, 1), (0, 0.5, 1)]


def test_levels_of_matches_share_one_ranking(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)     # noqa: E731
    tr = spark.createDataFrame([(1, 5, day(0), 0, "a", 1), (1, 5, day(7), 0, "b", 1), (1, 5, day(70), 0, "z", 9)], "f int, link int, time timestamp_ntz, slot int, sig string, cnt int")
    ct = spark.createDataFrame([(5, day(14), 0, "a", 1, ""), (5, day(8), 1, "a", 1, ""), (5, day(6), 6, "c", 1, ""), (5, day(2), 2, "a", 1, ""), (6, day(1), 0, "a", 1, ""), (5, day(61), 0, "a", 1, "")],
                               "link int, control_time timestamp_ntz, slot int, sig string, cnt int, fams string")
    d = outages.matched_pairs(tr, ct, ["f", "link", "time"], "link", "time", 30, {"exact": ["sig", "cnt"], "coarse": ["cnt"]}, "slot", 7, 5, 17, F.lit(True))
    assert plan_of(d).count("Join") == 1
    got = sorted((r.time, r.match_type, r.control_time) for r in d.collect())
    assert got == [(day(0), "exact", day(8)), (day(0), "exact", day(14)), (day(7), "coarse", day(6)), (day(7), "coarse", day(8)), (day(7), "coarse", day(14))]


def test_matches_are_ranked_where_they_are_joined(spark):
    rng = random.Random(4)
    days = sorted(rng.sample(range(400), 170)) + [1000, 1030, 1061]
    rows = [(link, stamp("2024-01-01") + dt.timedelta(days=n), n % 7, rng.choice("ab"), 1, "", float(rng.randrange(90))) for link in (1, 2) for n in days]
    ct = spark.createDataFrame(rows, "link int, control_time timestamp_ntz, slot int, sig string, cnt int, fams string, v double")
    tr = ct.withColumnRenamed("control_time", "time").drop("fams").withColumn("f", F.lit(3))
    args = (tr, ct, ["f", "link", "time"], "link", "time", 30, {"exact": ["sig", "cnt"], "coarse": ["cnt"]}, "slot", 7, 5, 17, F.col("time") != F.col("control_time"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, units = outages.matched_pairs(*args), outages.matched_effects(*args, "v")
        assert [plan_of(d).count("Exchange hashpartitioning") for d in (pairs, units)] == [2, 2]
        got = sorted((r.link, r.time, r.control_time, r.match_type) for r in pairs.collect())
        effects = {(r.link, r.time): (r.control, r.n_controls, r.match_type, r.treated, r.effect) for r in units.collect()}
        old = {(r.link, r.time): (r.control, r.n_controls, r.match_type, r.treated, r.effect) for r in outages.unit_effects(pairs, tr, ["f"], "link", "time", "v").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = []
    for link, t, slot, sig, *_ in rows:
        near = [(c[3] != sig, c[2] != slot, hashlib.md5(f"3|{link}|{t}|{c[1]}|17".encode()).hexdigest(), c[1]) for c in rows
                if c[0] == link and c[1] != t and abs((c[1] - t).days) <= 30 and (c[2] - slot) % 7 in (0, 1, 6)]
        want += [(link, t, c[3], "coarse" if c[0] else "exact") for c in sorted(near)[:5] if c[0] == min(near)[0]]
    assert got == sorted(want) and effects == old and len(effects) > 300


def test_panel_collects_no_sets(spark):
    rows = [(1, 9, 10, "R"), (1, 9, 2, "R"), (1, 9, 2, "R"), (1, 9, 3, "A"), (1, None, 7, "R"), (2, 9, 5, "N"), (2, 9, None, "R"), (2, 8, -4, "R")]
    lines = spark.createDataFrame([(s, stamp(f"2024-01-{d:02d}") if d else None, n, f, 1.0, 2.0) for s, d, n, f in rows],
                                  "l_suppkey int, l_shipdate timestamp_ntz, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double")
    d = outage_plans._panel(SimpleNamespace(lineitem=lines))
    assert "collect_set" not in plan_of(d)
    assert {(r.link, r.time and r.time.day): (r.fams, r.v) for r in d.collect()} == {(1, 9): ("10|2", 4.0), (1, None): ("7", 1.0), (2, 9): ("", 2.0), (2, 8): ("-4", 1.0)}


def test_draws_by_text_equal_draws_by_number(spark):
    p = [-0.5, 0.0, 1e-12, 0.25, 0.3, 1 - 1e-12, 1.0, 1.5, None]
    d = spark.range(400).withColumn("p", F.explode(F.array(*[F.lit(x) for x in p])))
    same = draw_below(F.concat_ws("|", "id", F.lit(7)), F.col("p")).eqNullSafe(uniform(F.col("id"), F.lit(7)) < F.col("p"))
    assert d.filter(~same).count() == 0


def test_draws_are_dealt_over_tasks(spark):
    e = spark.createDataFrame([("a", 50, 20), ("b", 3, 3)], "key string, n int, hits int")
    d = resample.numbered_draws(e, ["key"], "n", 40, 7)
    assert d.count() == 40 * 53
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_runs_of_one_moment_are_reduced_before_the_search(spark):
    t0 = stamp("2024-01-01")
    runs = spark.range(1000).select(F.lit(1).alias("k"), F.when(F.col("id") < 900, "O").otherwise("F").alias("product"), F.lit(t0).cast("timestamp_ntz").alias("available"), F.col("id").alias("run"))
    req = spark.createDataFrame([(1, stamp("2024-01-02")), (1, stamp("2023-01-02"))], "k int, origin timestamp_ntz")
    d = lookups.preferred_product(req, runs, ["k"], "product", ["O", "F"], "origin", "available", ["run"])
    assert [(r.product, r.run) for r in d.collect()] == [("O", 899)]
    plan = plan_of(d)
    assert "max(struct" in plan or "max(named_struct" in plan


def test_points_are_dealt_by_cell(spark):
    p = spark.range(300).select("id", (F.col("id") / 10 - 40).alias("lat"), (F.col("id") % 7 + 140.0).alias("lon"))
    s = spark.range(5).select(F.col("id").alias("sid"), (F.col("id") * 5 - 40.0).alias("slat"), (F.col("id") + 140.0).alias("slon"))
    d = lookups.nearest_within(p, s, "lat", "lon", "slat", "slon", 50.0)
    plan = plan_of(d)
    assert "BroadcastExchange" not in plan and "REPARTITION_BY_NUM" in plan


def test_forecasts_are_made_once_for_auctions_of_a_day(spark):
    q = [stamp(f"20{y}-{m:02d}-01") for y in (21, 22) for m in (1, 4, 7, 10)]
    h = spark.createDataFrame([("d", t, (t.month - 1) // 3 + 1, float(i)) for i, t in enumerate(q)], "dir string, quarter_end timestamp_ntz, season int, per_unit double")
    a = spark.range(500).select(F.col("id").alias("auction_id"), F.lit("d").alias("dir"), F.lit(stamp("2022-08-15")).cast("timestamp_ntz").alias("auction_date"), (F.col("id") % 2 + 1).cast("int").alias("season"))
    d = market.walk_forward(a, h, ["dir"], "28 days")
    rows = d.collect()
    assert len(rows) == 500 and {(r.season, r.history, r.last_quarter, r.trailing_4q, r.same_season) for r in rows} == {(1, 7, 6.0, 4.5, 2.0), (2, 7, 6.0, 4.5, 3.0)}
    assert "auction_id" not in "".join(x for x in plan_of(d).split("\n") if "Window [row_number" in x)


def test_tagged_files_are_cut_by_lines(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    lines = records.tagged_lines(spark, feeds.tagged_folder(t, lines_per_file=500))
    size = lines.groupBy("file").count().agg(F.count("count").alias("n"), F.max("count").alias("top")).first()
    assert size["n"] >= 12 and size["top"] < 1000
    d = records.tagged_scan(lines, "DISPATCH_LINE", ["ORDERKEY"])
    assert d.filter("ORDERKEY is not null").count() == t.lineitem.count()


def test_lost_weights_take_the_same_value_in_sql(spark):
    rows = [("a", 1.0, 1, 1.0), ("a", 2.0, 2, 2.0), ("a", 3.0, 3, 1e-40), ("a", 4.0, 4, 1e-40), ("a", 9.0, 5, 1.0)]
    want = ranks.weighted_quantiles(spark.createDataFrame(rows, "cid string, v double, rid int, w double"), ["cid"], "v", "w", "rid", regimes.PROBS).first()
    con = duckdb.connect()
    for order in (rows, rows[::-1]):
        con.execute("create or replace table t as select * from (values " + ", ".join(f"('{c}', {v}::double, {i}, {w}::double)" for c, v, i, w in order) + ") x(cid, v, rid, w)")
        assert con.execute(f"with {regimes.wq('t', 'q', ties=True)} select p10, p50, p90 from q").fetchone() == (want.p10, want.p50, want.p90)


def test_months_of_a_fit_are_written_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    train, every = regimes.months(t)
    assert "Aggregate" not in plan_of(train) and "Aggregate" not in plan_of(every) and every.count() > train.count() > 0


def test_distances_of_a_fit_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(mixtures, "cut", lambda df, purpose="cut", codec=None: written.append(purpose) or cut(df, purpose, codec))
    d = spark.range(60).select((F.col("id") % 7 + F.when(F.col("id") % 2 == 0, 100).otherwise(0)).cast("double").alias("x"))
    model = mixtures.fit_states(d, {"g": ["x"]}, 2)
    assert written.count("distances") == 1 and model.limit > 0


def test_unit_groups_do_not_make_their_rows_again(spark):
    sens = spark.createDataFrame([(e, u, float(e * (u % 3) + 1)) for e in range(6) for u in range(30)], "eq long, unit long, sensitivity double")
    d = clusters.unit_groups(sens, spark.range(6).select(F.col("id").alias("eq"), F.lit(2.0).alias("weight")), "unit", "eq", 16, 3)
    assert "Aggregate" not in plan_of(d)
    groups = {}
    for r in d.collect():
        groups.setdefault(r["unit"] % 3, set()).add(r["group"])
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1] and len(set.union(*groups.values())) == 3


def shuffled_rows(spark, run):
    """Result of run and the rows that its stages wrote for shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    before = {s.stageId() for s in _stages(store, none)}
    out = run()
    return out, sum(s.shuffleWriteRecords() for s in _stages(store, none) if s.stageId() not in before)


def _stages(store, none):
    found = store.stageList(None, False, False, none, None)
    return [found.apply(i) for i in range(found.size())]


def test_windows_of_bookings_are_not_shuffled_by_the_step(spark):
    rng, zero = random.Random(8), stamp("2024-01-01")
    hour = lambda n: zero + dt.timedelta(hours=n)     # noqa: E731
    books = [(i, key, hour(6 * n + (i % 3 == 0)), hour(6 * n + 30)) for i, (key, n) in enumerate((k, n) for k in (1, 2, 3) for n in rng.sample(range(1200), 25))]
    books += [(900, 1, None, hour(4)), (901, None, hour(8), hour(9))]
    series = [(key, hour(6 * n + off), float(rng.randrange(50))) for key in (1, 2) for n in range(-300, 1200) for off in (0, 1) if rng.random() < 0.6] + [(1, hour(2), None), (2, None, 4.0)]
    b = spark.createDataFrame(books, "id int, key int, s timestamp_ntz, e timestamp_ntz")
    sr = spark.createDataFrame(series, "key int, time timestamp_ntz, v double")
    for before, after, cycle, cycles in ((8, 6, 96, 7), (8, 8, 30, 9), (4, 5, 39, 8)):      # the second has windows that overlap, the third cycles off the step
        d = outages.isolated_effects(b, sr, "id", ["key"], "s", "e", "time", "v", "6 hours", before, after, f"{cycle} hours", cycles, 3)
        got, moved = shuffled_rows(spark, d.collect)
        at, want, lone = {(k, m): v for k, m, v in series}, {}, 0
        for i, key, s, _ in books[:-2]:
            lo, hi = s - dt.timedelta(hours=6 * before), s + dt.timedelta(hours=6 * after)
            if any(j != i and k == key and x and lo < y and x < hi for j, k, x, y in books):
                continue
            lone, change = lone + 1, []
            for lag in range(cycles + 1):
                vs = [[v for o in side if (v := at.get((key, s + dt.timedelta(hours=6 * o - cycle * lag)))) is not None] for side in (range(-before, 0), range(after))]
                change.append(sum(vs[1]) / len(vs[1]) - sum(vs[0]) / len(vs[0]) if all(vs) else None)
            ctl = [c for c in change[1:] if c is not None]
            if change[0] is not None and len(ctl) >= 3:
                want[i] = (change[0], sum(ctl) / len(ctl), len(ctl))
        assert {r.id: (round(r.change, 9), round(r.control_change, 9), r.controls) for r in got} == {i: (round(a, 9), round(c, 9), n) for i, (a, c, n) in want.items()} and len(want) > 8
        steps = lone * (cycles + 1) * (before + after)
        assert moved < len(series) + 8 * len(books) + 3 * lone * (cycles + 1) and moved - len(series) < steps


def test_requests_of_levels_are_shuffled_once(spark):
    rng = random.Random(5)
    rows = [(i // 4, rng.randrange(200), rng.choice([1, 2, 3, None]), i % 4, rng.choice([None, float(rng.randrange(1, 51))]), rng.choice("ANRX") if i % 50 else None, rng.choice("OF")) for i in range(3000)]
    rows += [(9000 + i, 7, 5, 1, None, "A", "O") for i in range(4)] + rows[:300]        # a finest key without any value, and repeats
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string")
    d = reshaping.fallback_levels(SimpleNamespace(lineitem=lines))
    con = duckdb.connect()
    con.register("lineitem", lines.toPandas().astype({"l_partkey": "Int64", "l_suppkey": "Int64"}))
    assert compare(d, con, ORACLE["t4_fallback_levels"]) == ""
    assert {r.level for r in d.collect()} == {"K1", "K2", "K3", "none"}
    _, moved = shuffled_rows(spark, d.collect)
    assert moved < 2 * len(rows)
