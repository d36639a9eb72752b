"""As-of and interval joins as equi-joins and windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .revisions import latest, top_k
from .sequence import CHUNK_HOURS, last_known, merge_intervals, previous, running, time_chunk


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], t: str, effective: str,
                  payload: list[str], *, tie: list[str] = (), strict: bool = False,
                  tolerance: str | None = None, hours: int = CHUNK_HOURS) -> DataFrame:
    """Attach the last right row effective at (or, strict, before) each left row.

    Both sides are unioned into (key, time chunk) groups; the last right row of
    earlier chunks enters as one extra row at the head of the chunk.  One shuffle
    of either side, no pair is ever formed, and a hot key is spread over chunks.
    """
    pack = F.struct(F.col(effective).alias("_eff"), *[F.col(p) for p in payload])
    facts = right.select(*keys, F.col(effective).alias("_t"), pack.alias("_p"),
                         F.struct(F.col(effective), *[F.col(c) for c in tie]).alias("_tie"))
    facts = facts.withColumn("_chunk", time_chunk(F.col("_t"), hours))
    rows = left.select(*keys, F.col(t).alias("_t"), F.struct(*left.columns).alias("_row")
                       ).withColumn("_chunk", time_chunk(F.col("_t"), hours))
    ends = (facts.groupBy(*keys, "_chunk").agg(F.max_by("_p", "_tie").alias("_p"))
            .unionByName(rows.select(*keys, "_chunk").distinct(), allowMissingColumns=True)
            .groupBy(*keys, "_chunk").agg(F.max("_p").alias("_p")))
    heads = ends.select(*keys, "_chunk", F.last("_p", True).over(
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_p")
    ).filter(F.col("_p").isNotNull()).withColumn("_side", F.lit(-1))
    # at equal stamps facts come first unless strict
    both = (facts.withColumn("_side", F.lit(1 if strict else 0))
            .unionByName(rows.withColumn("_side", F.lit(0 if strict else 1)), allowMissingColumns=True)
            .unionByName(heads, allowMissingColumns=True))
    w = (Window.partitionBy(*keys, "_chunk")
         .orderBy(F.col("_side") != -1, F.col("_t"), F.col("_side"), F.col("_tie"))
         .rowsBetween(Window.unboundedPreceding, 0))
    out = (both.withColumn("_hit", F.last("_p", True).over(w)).filter(F.col("_row").isNotNull()))
    hit = F.col("_hit")
    if tolerance:
        hit = F.when(F.col("_hit._eff") >= F.col("_t") - F.expr(f"interval {tolerance}"), F.col("_hit"))
    return out.select(hit.alias("_hit"), "_row").select(
        "_row.*", F.col("_hit._eff").alias(f"{effective}_asof" if effective in left.columns else effective),
        *[F.col(f"_hit.{p}").alias(p) for p in payload])


def recently(rows: DataFrame, facts: DataFrame, t: str, at: str, limit_us: int, name: str) -> DataFrame:
    """Adds whether a fact stands at most ``limit`` before each row; an existence test without a key.

    Buckets are as wide as the limit: a row has one if its bucket's first fact is not after it, or if the last fact of
    the bucket before is recent enough.  A bucket's facts are reduced to these two before they meet the
    rows, so a busy bucket costs a plain equi-join and no window."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))     # noqa: E731
    edge = facts.groupBy(F.floor(micros(at) / limit_us).alias("_b")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    own = edge.select("_b", "_first")
    before = edge.select((F.col("_b") + 1).alias("_b"), "_last")
    d = rows.withColumn("_b", F.floor(micros(t) / limit_us)).join(own, "_b", "left").join(before, "_b", "left")
    hit = F.coalesce(F.col("_first") <= F.col(t), F.lit(False)) | F.coalesce(micros("_last") >= micros(t) - limit_us, F.lit(False))
    return d.withColumn(name, hit).drop("_b", "_first", "_last")


def _buckets(start: Column, end: Column, hours: int) -> Column:
    return F.explode(F.sequence(time_chunk(start, hours), time_chunk(end, hours)))


def points_in_intervals(points: DataFrame, spells: DataFrame, keys: list[str], t: str, start: str, end: str,
                        *, hours: int = 24, right_open: bool = False, how: str = "inner") -> DataFrame:
    """Range join as an equi-join on (keys, time bucket) plus the exact test.
    Spells must be clipped to the studied span before they are bucketed."""
    p = points.withColumn("__bucket", time_chunk(F.col(t), hours))
    s = spells.filter(F.col(start) <= F.col(end)).withColumn("__bucket", _buckets(F.col(start), F.col(end), hours))
    s = s.select(*[F.col(c).alias(f"_s_{c}") if c in keys + ["__bucket"] else F.col(c) for c in s.columns])
    on = F.col("__bucket") == F.col("_s___bucket")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_s_{k}"))
    upper = F.col(t) < F.col(end) if right_open else F.col(t) <= F.col(end)
    out = p.join(s, on & (F.col(t) >= F.col(start)) & upper, how)
    return out.drop("__bucket", "_s___bucket", *[f"_s_{k}" for k in keys])


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str],
                *, hours: int = 24 * 7, strict: bool = True, extra: Column | None = None) -> DataFrame:
    """Pairs of overlapping intervals.  Either side is spread over time buckets
    and a pair is taken only in the bucket where the later one starts, so it
    appears once without a distinct.  Columns of a and b must differ but for keys."""
    x = a.withColumn("__bucket", _buckets(F.col(a_span[0]), F.col(a_span[1]), hours))
    y = b.withColumn("__bucket", _buckets(F.col(b_span[0]), F.col(b_span[1]), hours))
    y = y.select(*[F.col(c).alias(f"_y_{c}") if c in keys + ["__bucket"] else F.col(c) for c in y.columns])
    on = F.col("__bucket") == F.col("_y___bucket")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_y_{k}"))
    (s1, e1), (s2, e2) = a_span, b_span
    touch = ((F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1))) if strict else (
        (F.col(s1) <= F.col(e2)) & (F.col(s2) <= F.col(e1)))
    home = F.col("__bucket") == time_chunk(F.greatest(F.col(s1), F.col(s2)), hours)
    out = x.join(y, on & touch & home & (extra if extra is not None else F.lit(True)))
    return out.drop("__bucket", "_y___bucket", *[f"_y_{k}" for k in keys])


def bracket(requests: DataFrame, facts: DataFrame, keys: list[str], t: str, at: str, value: str, *,
            hours: int = CHUNK_HOURS) -> DataFrame:
    """Nearest fact at or before and nearest fact after each request, as structs
    ``before`` and ``after`` of (at, value)."""
    f = facts.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"),
                     F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("_f"))
    r = requests.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*requests.columns).alias("_row"))
    both = f.unionByName(r, allowMissingColumns=True)
    both = last_known(both, keys, ["_t", "_side"], {"before": F.col("_f")}, hours=hours)
    both = last_known(both, keys, ["_t", "_side"], {"after": F.col("_f")}, hours=hours, forward=True)
    return both.filter(F.col("_row").isNotNull()).select("_row.*", "before", "after")


def run_index(rows: DataFrame, group: list[str], run: list[str], issue: str, received: str) -> DataFrame:
    """One row per forecast run with the time its last record arrived."""
    return rows.groupBy(*group, *run, issue).agg(F.max(received).alias("completed"))


def coherent_run_asof(requests: DataFrame, runs: DataFrame, group: list[str], origin: str, issue: str, run: list[str],
                      max_age: str, *, hours: int = CHUNK_HOURS) -> DataFrame:
    """Newest run per group that is complete at each origin and not too old.

    The choice is made at run grain: in order of completion the best issue so far
    is a running maximum, so one as-of lookup gives the run.  Rows of different
    runs are never mixed."""
    best = F.struct(issue, "completed", *run)
    d = running(runs.withColumn("_best", best), group, ["completed", issue, *run], "_best", "_top", how="max",
                hours=hours).select(*group, "completed", "_top")
    hit = asof_backward(requests, d, group, origin, "completed", ["_top"], tie=["_top"], hours=hours)
    fresh = F.col(f"_top.{issue}") >= F.col(origin) - F.expr(f"interval {max_age}")
    return hit.filter(fresh).select(*requests.columns, *[F.col(f"_top.{c}").alias(c) for c in [issue, *run]],
                                    F.col("_top.completed").alias("completed"))


def complete_runs(rows: DataFrame, run: list[str], region: str, n_regions: int) -> DataFrame:
    """Runs that carry every region."""
    return rows.groupBy(*run).agg(F.countDistinct(region).alias("_n")).filter(F.col("_n") == n_regions).drop("_n")


def preferred_product(requests: DataFrame, runs: DataFrame, keys: list[str], product: str, order: list[str],
                      origin: str, available: str, payload: list[str], *, hours: int = CHUNK_HOURS) -> DataFrame:
    """Newest available run of the first product in ``order`` that has one.  Of runs available at one moment only the
    highest can be taken, so the others are dropped before the search: a key then holds as many rows as moments."""
    best = runs.groupBy(*keys, product, available).agg(F.max(F.struct(*payload)).alias("_best")).select(*keys, product, available, "_best.*")
    ranked = F.array(*[F.struct(F.lit(i).alias("_rank"), F.lit(p).alias(product)) for i, p in enumerate(order)])
    r = requests.withColumn("_p", F.explode(ranked)).select(*requests.columns, "_p.*")
    hit = asof_backward(r, best, [*keys, product], origin, available, payload, tie=payload, hours=hours)
    hit = hit.filter(F.col(available).isNotNull())
    return top_k(hit, requests.columns, [F.col("_rank")], 1).drop("_rank")


def known_intervals(revisions: DataFrame, key: str, known: list[str], newest: list[str], payload: list[str], *,
                    hours: int = CHUNK_HOURS) -> DataFrame:
    """Revisions to (key, payload, known_from, known_to): the revision in force at
    every moment is the newest by ``newest`` among those already known."""
    d = revisions.withColumn("known_from", F.greatest(*known) if len(known) > 1 else F.col(known[0]))
    d = d.withColumn("_best", F.struct(*newest, *[p for p in payload if p not in newest]))
    d = d.groupBy(key, "known_from").agg(F.max("_best").alias("_best"))
    d = running(d, [key], ["known_from"], "_best", "_top", how="max", hours=hours)
    d = previous(d, [key], ["known_from"], {"known_to": "known_from"}, hours=hours, forward=True)
    return d.select(key, "known_from", "known_to", *[F.col(f"_top.{p}").alias(p) for p in payload])


def asof_revision(revisions: DataFrame, key: list[str], origin: Column, known: list[str], newest: list[str]) -> DataFrame:
    """Newest revision per key known at one origin."""
    ok = F.lit(True)
    for c in known:
        ok = ok & (F.col(c) <= origin)
    return latest(revisions.filter(ok), key, newest)


def covered(points: DataFrame, spells: DataFrame, keys: list[str], t: str, start: str, end: str, *,
            gap: str = "5 minutes", name: str = "covered", hours: int = CHUNK_HOURS) -> DataFrame:
    """Is t inside any spell (both ends inclusive): merge, then look up the last start."""
    merged = merge_intervals(spells.select(*keys, start, end), keys, start, end, gap=gap, hours=hours)
    merged = merged.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    hit = asof_backward(points, merged, keys, t, "_s", ["_e"], hours=hours)
    return hit.withColumn(name, F.coalesce(F.col(t) <= F.col("_e"), F.lit(False)).cast("int")).drop("_s", "_e")


def many_to_one_violations(right: DataFrame, keys: list[str]) -> DataFrame:
    return right.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def valid_else_latest(rows: DataFrame, versions: DataFrame, key: str, t: str, start: str, end: str, rid: list[str],
                      payload: list[str], *, hours: int = 24 * 30) -> DataFrame:
    """Newest version valid at t, else the newest version of the key at all."""
    v = versions.select(key, F.col(start).alias("_vs"), F.col(end).alias("_ve"), *payload)
    hits = points_in_intervals(rows.select(*rid, key, t).distinct(), v, [key], t, "_vs", "_ve", hours=hours, right_open=True)
    best = top_k(hits, rid, [F.desc("_vs"), *[F.desc(p) for p in payload]], 1).select(
        *rid, *[F.col(p).alias(f"_a_{p}") for p in payload], F.lit("valid").alias("_m"))
    newest = latest(v, [key], ["_vs", *payload]).select(key, *[F.col(p).alias(f"_b_{p}") for p in payload],
                                                        F.lit("latest").alias("_n"))
    out = rows.join(best, rid, "left").join(newest, key, "left")
    return out.select(*rows.columns, F.coalesce("_m", "_n").alias("method"), *[
        F.when(F.col("_m").isNotNull(), F.col(f"_a_{p}")).otherwise(F.col(f"_b_{p}")).alias(p) for p in payload])


def final_of_chain(links: DataFrame, key: str, successor: str, *, cycle: str = "null") -> DataFrame:
    """Follow successor ids to the last one, however far.

    Ids that lead into a cycle get null, or with cycle="member" the least id of that cycle.  Pointer doubling:
    each round joins the map with itself, so after round r an id is open only if its chain has more than 2^r
    hops.  A round that closes no id has only cycles left.  The map is written out between rounds."""
    d = links.filter(F.col(successor).isNotNull()).select(F.col(key).alias("_k"), F.col(successor).alias("_to"))
    d = cut(d.withColumns({"_least": F.least("_k", "_to"), "_open": F.lit(True)}), "chain")
    before, done = None, 0
    while True:
        nxt = d.select(F.col("_k").alias("_to"), F.col("_to").alias("_next"), F.col("_least").alias("_l2"))
        d = cut(d.drop("_open").join(nxt, "_to", "left").select("_k", F.coalesce("_next", "_to").alias("_to"), F.least("_least", F.coalesce("_l2", "_least")).alias("_least"),
                                                               F.col("_next").isNotNull().alias("_open")), "chain")
        still = d.filter("_open").count()
        # once no id closes, the pointers stand inside cycles; as many rounds again let each pointer pass its whole cycle
        if still == 0:
            break
        if before == still:
            if cycle == "null" or done >= still.bit_length():
                break
            done += 1
        before = still
    ends = d.select("_k", "_to", "_open")
    if cycle == "member":
        # a pointer that stands in a cycle has its whole cycle ahead of it
        inside = d.select(F.col("_k").alias("_to"), F.col("_least").alias("_m"))
        ends = ends.join(inside, "_to", "left").select("_k", F.when(F.col("_open"), F.col("_m")).otherwise(F.col("_to")).alias("_final"))
    else:
        ends = ends.select("_k", F.when(~F.col("_open"), F.col("_to")).alias("_final"))
    ends = ends.withColumn("_linked", F.lit(True))
    return links.join(ends, F.col(key) == F.col("_k"), "left").select(
        *links.columns, F.when(F.col("_linked"), F.col("_final")).otherwise(F.col(key)).alias("final_id"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Full outer comparison row by row; null equals null."""
    x = a.select(*keys, F.lit(True).alias("_a"), *[F.col(v).alias(f"a_{v}") for v in values])
    y = b.select(*keys, F.lit(True).alias("_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    d = x.join(y, keys, "full_outer")
    same = F.lit(True)
    for v in values:
        p, q = F.col(f"a_{v}"), F.col(f"b_{v}")
        same = same & (p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= tolerance, F.lit(False)))
    status = (F.when(F.col("_b").isNull(), "left only").when(F.col("_a").isNull(), "right only")
              .when(same, "equal").otherwise("different"))
    return d.withColumn("status", status).drop("_a", "_b")


def nearest_within(points: DataFrame, sites: DataFrame, lat: str, lon: str, slat: str, slon: str, km: float) -> DataFrame:
    """Pairs within km at any latitude, as an equi-join on grid cells.

    Cells are about as high as km.  A site is sent to the row above and below and, since a degree of
    longitude shrinks towards the poles, to as many cells to either side as km spans at the nearer pole end of
    its reach; longitudes wrap, and a reach over a pole takes the whole ring.  The work is the pairs and not the bytes read, so the
    points are dealt by cell over a given number of tasks, and the sites, sized without their cells, are never broadcast."""
    from ..functions.maths import great_circle_km
    per_degree = 111.0                                   # a little under a degree of latitude, so that reach errs to the far side
    reach = km / per_degree
    ring = max(1, min(480, int(360 // max(reach, 1e-9))))
    size = 360.0 / ring
    around = lambda c: F.pmod(F.floor((F.col(c) + 180) / size), F.lit(ring)).cast("long")     # noqa: E731
    p = points.withColumns({"_cy": F.floor(F.col(lat) / size), "_cx": around(lon)})
    edge = F.abs(F.col(slat)) + reach
    span = F.when(edge >= 89.9, F.lit(ring)).otherwise(F.least(F.ceil(reach / F.cos(F.radians(F.least(edge, F.lit(89.9)))) / size) + 1, F.lit(ring))).cast("long")
    rows = F.sequence(F.floor((F.col(slat) - reach) / size), F.floor((F.col(slat) + reach) / size))
    cols = F.when(2 * span + 1 >= ring, F.sequence(F.lit(0).cast("long"), F.lit(ring - 1).cast("long"))).otherwise(
        F.transform(F.sequence(-span, span), lambda i: F.pmod(F.col("_sx") + i, F.lit(ring))))
    s = sites.withColumn("_sx", around(slon)).withColumn("_cy", F.explode(rows)).withColumn("_cx", F.explode(cols)).drop("_sx")
    d = great_circle_km(F.col(lat), F.col(lon), F.col(slat), F.col(slon))
    p = p.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cy", "_cx")
    return p.join(s.hint("merge"), ["_cy", "_cx"]).withColumn("km", d).filter(F.col("km") <= km).drop("_cy", "_cx")


def nearest_place(points: DataFrame, places: DataFrame, pid: str, lat: str, lon: str, name: str, plat: str, plon: str, region: str) -> DataFrame:
    """Points with the nearest reference place at any distance, its label and area.

    The search goes outward: different coordinates meet the places of the cells within a reach, and those that find none go on
    with twice the reach, up to half the globe.  The first reach follows the number of places, so that a point meets a few of them whatever
    their number.  Ties go to the first name, then region and place.  Within 15 km a point is central.  A point without coordinates, or
    without any place, has nulls."""
    from ..functions.maths import great_circle_km, octant
    sites = cut(places.filter(F.col(plat).isNotNull() & F.col(plon).isNotNull()).select(
        F.col(name).alias("_sn"), F.col(region).alias("_sr"), F.col(plat).cast("double").alias("_sy"), F.col(plon).cast("double").alias("_sx0")).distinct(), "places")
    at = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(lat).cast("double").alias("_y"), F.col(lon).cast("double").alias("_x")).distinct()
    at = cut(at, "places-at")
    n, found = sites.count(), None
    reach = min(max((5.1e8 / max(n, 1)) ** 0.5, 1.0), 20_100.0)          # km; about one place in a square of this size
    while n:
        near = nearest_within(at, sites, "_y", "_x", "_sy", "_sx0", reach)
        best = cut(near.groupBy("_y", "_x").agg(F.min(F.struct(F.col("km"), F.col("_sn").alias("n"), F.col("_sr").alias("r"), F.col("_sy").alias("y"), F.col("_sx0").alias("x"))).alias("_n")), "places-found")
        found = best if found is None else found.unionByName(best)
        at = cut(at.join(best.select("_y", "_x"), ["_y", "_x"], "left_anti"), "places-at")
        if reach >= 20_100.0 or at.isEmpty():
            break
        reach = min(2 * reach, 20_100.0)
    if found is None:
        found = at.sparkSession.createDataFrame([], "_y double, _x double, _n struct<km: double, n: string, r: string, y: double, x: double>")
    d = points.join(found, (F.col(lat).cast("double") == F.col("_y")) & (F.col(lon).cast("double") == F.col("_x")), "left")
    where = octant(F.pmod(F.degrees(F.atan2((F.col(lon) - F.col("_n.x")) * F.cos(F.radians(F.col("_n.y"))), F.col(lat) - F.col("_n.y"))), F.lit(360.0)))
    far = F.col("_n.km") >= 15
    label = F.when(far, F.concat(where, F.lit(" of "), F.col("_n.n"), F.lit(" ("), F.format_string("%.0f", F.col("_n.km")), F.lit(" km)"))).when(~far, F.concat(F.lit("central "), F.col("_n.n")))
    area = F.when(far, F.concat(F.col("_n.r"), F.lit(":"), where, F.lit(" "), F.col("_n.n"))).when(~far, F.concat(F.col("_n.r"), F.lit(":"), F.col("_n.n")))
    return d.select(*points.columns, F.col("_n.n").alias("place"), label.alias("label"), area.alias("area"), F.col("_n.km").alias("km"))


def name_match(left: DataFrame, points: DataFrame, keys: list[str], order: list[str], lat: str, lon: str, pid: str,
               max_km: float) -> DataFrame:
    """Match on normalised name and region; the best-ranked candidate is taken and the
    match refused when any candidate lies further than max_km from it.  Candidates are
    reduced per key before the join, so a common name costs one row."""
    from ..functions.maths import great_circle_km
    best = top_k(points, keys, [F.col(c) for c in order], 1).select(
        *keys, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.col(pid).alias("_pid"))
    spread = points.join(best, keys).groupBy(*keys).agg(
        F.max(great_circle_km(F.col(lat), F.col(lon), F.col("_lat"), F.col("_lon"))).alias("spread"),
        F.max("_lat").alias("match_lat"), F.max("_lon").alias("match_lon"), F.max("_pid").alias("match_id"))
    ok = F.col("spread") <= max_km
    return left.join(spread, keys, "left").withColumns(
        {c: F.when(ok, F.col(c)) for c in ("match_id", "match_lat", "match_lon")}).withColumn(
        "method", F.when(ok, "name_match").otherwise("unmatched")).drop("spread")
