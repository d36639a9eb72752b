"""State clusters: screened, imputed and group-weighted features, k-means or a diagonal Gaussian mixture, and their stability.

All fits are grouped sums.  A step of k-means or of the mixture's expectation and maximisation is one aggregate over the
rows, whose result is a few numbers a cluster; labels, probabilities and distances are expressions.  Restarts and
resampled fits are replicates of one keyed job: a row is compared with the centres of every replicate and counts in each with its own weight.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .ranks import quantiles
from .resample import block_draws


@dataclass
class States:
    """Fitted states: features kept and why others were not, their medians, centres, spreads and weights; clusters in canonical order."""
    features: list[str]
    dropped: dict[str, str]
    medians: list[float] = field(default_factory=list)
    centres: list[float] = field(default_factory=list)
    spreads: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    clip: float = 10.0
    means: np.ndarray | None = None
    variances: np.ndarray | None = None        # None: k-means
    shares: np.ndarray | None = None
    limit: float | None = None


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _exact(df: DataFrame, columns: dict[str, Column], probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """Exact quantiles of several expressions, a row each."""
    names = list(columns)
    long = df.select(*[c.alias(n) for n, c in columns.items()]).unpivot([], names, "name", "x").filter("x is not null")
    return {r["name"]: r.asDict() for r in quantiles(long, ["name"], "x", probs).collect()}


def prepare(train: DataFrame, groups: dict[str, list[str]], *, most_missing: float = 0.8, duplicate: float = 0.9995, constant: float = 1e-12, clip: float = 10.0) -> States:
    """Screens features (too often missing, constant, nearly a copy of an earlier one) and fits medians, centres and spreads (quartile
    ranges of the imputed values) exactly.  A feature weighs 1 / sqrt(number of its group's features that are kept)."""
    names = [f for g in groups.values() for f in g]
    if len(set(names)) != len(names):
        raise ValueError("a feature is in two groups")
    x = {f: _number(f) for f in names}
    got = train.agg(F.count("*").alias("n"), *[g(x[f]).alias(f"{k}{i}") for i, f in enumerate(names) for k, g in (("c", F.count), ("a", F.min), ("z", F.max))]).first()
    dropped, kept = {}, []
    for i, f in enumerate(names):
        count, low, high = got[f"c{i}"], got[f"a{i}"], got[f"z{i}"]
        if not got["n"] or 1 - count / got["n"] > most_missing:
            dropped[f] = "too_missing"
        elif not count:
            dropped[f] = "all_missing"
        elif high - low <= constant * max(1.0, abs(low), abs(high)):
            dropped[f] = "constant"
        else:
            kept.append(f)
    if not kept:
        raise ValueError("no usable features")
    median = {f: r["m"] for f, r in _exact(train, {f: x[f] for f in kept}, {"m": 0.5}).items()}
    filled = {f: F.coalesce(x[f], F.lit(median[f])) for f in kept}
    pairs = list(combinations(kept, 2))
    corr = train.agg(F.lit(0).alias("_"), *[F.corr(filled[a], filled[b]).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]).first()
    close = {p for k, p in enumerate(pairs) if corr[f"r{k}"] is not None and abs(corr[f"r{k}"]) >= duplicate}
    final: list[str] = []
    for f in kept:
        twin = next((g for g in final if (g, f) in close), None)
        if twin is None:
            final.append(f)
        else:
            dropped[f] = f"near_duplicate of {twin}"
    q = _exact(train, {f: filled[f] for f in final}, {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    weight = {f: 1 / math.sqrt(sum(g in final for g in own)) for own in groups.values() for f in own if f in final}
    return States(final, dropped, [median[f] for f in final], [q[f]["mid"] for f in final], [(q[f]["hi"] - q[f]["lo"]) or 1.0 for f in final], [weight[f] for f in final], clip)


def scaled(model: States) -> Column:
    """The prepared features of a row as an array."""
    out = []
    for f, m, c, s, w in zip(model.features, model.medians, model.centres, model.spreads, model.weights):
        v = (F.coalesce(_number(f), F.lit(m)) - c) / s
        out.append(F.greatest(F.least(v, F.lit(model.clip)), F.lit(-model.clip)) * w)
    return F.array(*out)


def _squares(z: Column, centre, scale=None) -> Column:
    terms = [(F.get(z, d) - float(c)) * (F.get(z, d) - float(c)) / (float(scale[d]) if scale is not None else 1.0) for d, c in enumerate(centre)]
    return sum(terms[1:], terms[0])


def _first(values: list[Column], best: Column) -> Column:
    """The place of the first value equal to best."""
    out = F.lit(len(values) - 1)
    for k in range(len(values) - 2, -1, -1):
        out = F.when(values[k] == best, k).otherwise(out)
    return out


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _most(values: list[Column]) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def lloyd(rows: DataFrame, starts: np.ndarray, steps: int, weights: list[Column] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres (replicate, cluster, component) after at most ``steps`` rounds of k-means from starts, and each replicate's inertia before the last one.

    rows has the array column z.  An empty cluster keeps its centre; rounds end when nothing moves."""
    centres, inertia = starts.astype(float).copy(), np.zeros(len(starts))
    many, clusters, width = centres.shape
    weights = weights or [F.lit(1.0)] * many
    z = F.col("z")
    for _ in range(steps):
        d = rows.select("z", *[w.alias(f"w{r}") for r, w in enumerate(weights)], *[F.array(*[_squares(z, c) for c in centres[r]]).alias(f"d{r}") for r in range(many)])
        near = {f"b{r}": F.array_min(f"d{r}") for r in range(many)}
        d = d.withColumns(near).withColumns({f"l{r}": F.array_position(f"d{r}", F.col(f"b{r}")) - 1 for r in range(many)})
        sums = []
        for r in range(many):
            sums.append(F.sum(F.col(f"w{r}") * F.col(f"b{r}")).alias(f"i{r}"))
            for k in range(clusters):
                mine = F.when(F.col(f"l{r}") == k, F.col(f"w{r}"))
                sums += [F.sum(mine).alias(f"n{r}_{k}"), *[F.sum(mine * F.get(z, c)).alias(f"s{r}_{k}_{c}") for c in range(width)]]
        got = d.agg(*sums).first()
        before = centres.copy()
        for r in range(many):
            inertia[r] = got[f"i{r}"] or 0.0
            for k in range(clusters):
                n = got[f"n{r}_{k}"]
                if n:
                    centres[r, k] = [got[f"s{r}_{k}_{c}"] / n for c in range(width)]
        if np.allclose(before, centres, rtol=0, atol=1e-12):
            break
    return centres, inertia


def _starts(rows: DataFrame, k: int, seeds: list[int]) -> np.ndarray:
    """For each seed k different rows: those of the least hash of their values."""
    out = []
    for s in seeds:
        got = rows.select("z").distinct().orderBy(F.xxhash64(F.lit(s), "z"), "z").limit(k).collect()      # k rows
        z = [list(r["z"]) for r in got] or [[0.0]]
        out.append((z * k)[:k] if len(z) < k else z)
    return np.array(out, dtype=float)


def _log_densities(model: States, z: Column) -> list[Column]:
    out = []
    for m, v, p in zip(model.means, model.variances, model.shares):
        out.append(F.lit(math.log(max(p, 1e-300)) - 0.5 * float(np.log(2 * np.pi * v).sum())) - 0.5 * _squares(z, m, v))
    return out


def em_steps(rows: DataFrame, model: States, steps: int, *, ridge: float = 1e-6, tolerance: float = 0.0) -> tuple[States, list[float]]:
    """The mixture after ``steps`` rounds from the model's means, variances and shares, or fewer once the mean log likelihood gains at
    most ``tolerance``; and the mean log likelihood before each round.  rows has the array column z."""
    k, width = model.means.shape
    history: list[float] = []
    for _ in range(steps):
        logs = [f"l{j}" for j in range(k)]
        d = rows.select("z", *[x.alias(n) for n, x in zip(logs, _log_densities(model, F.col("z")))])
        d = d.withColumn("top", _most([F.col(n) for n in logs]))
        d = d.withColumn("norm", F.col("top") + F.log(sum((F.exp(F.col(n) - F.col("top")) for n in logs), F.lit(0.0))))
        r = [F.exp(F.col(n) - F.col("norm")) for n in logs]
        z = [F.get("z", c) for c in range(width)]
        got = d.agg(F.count("*").alias("n"), F.avg("norm").alias("ll"), *[F.sum(r[j]).alias(f"n{j}") for j in range(k)],
                    *[F.sum(r[j] * z[c]).alias(f"s{j}_{c}") for j in range(k) for c in range(width)], *[F.sum(r[j] * z[c] * z[c]).alias(f"q{j}_{c}") for j in range(k) for c in range(width)]).first()
        if not got["n"]:
            return model, history
        n = np.array([got[f"n{j}"] for j in range(k)]) + 10 * np.finfo(float).eps
        means = np.array([[got[f"s{j}_{c}"] for c in range(width)] for j in range(k)]) / n[:, None]
        squares = np.array([[got[f"q{j}_{c}"] for c in range(width)] for j in range(k)]) / n[:, None]
        model = replace(model, means=means, variances=np.maximum(squares - means ** 2, 0.0) + ridge, shares=n / n.sum())
        history.append(float(got["ll"]))
        if len(history) > 1 and history[-1] - history[-2] <= tolerance:
            break
    return model, history


def _canonical(model: States) -> States:
    order = sorted(range(len(model.means)), key=lambda j: tuple(model.means[j].tolist()))
    take = lambda a: None if a is None else a[order]      # noqa: E731
    return replace(model, means=model.means[order], variances=take(model.variances), shares=take(model.shares))


def assign(rows: DataFrame, model: States) -> DataFrame:
    """rows with cluster, probabilities (an array that sums to 1), distance (to the cluster's mean; by its variances in a mixture)
    and, where the model has a limit, out_of_range."""
    d = rows.withColumn("_z", scaled(model))
    z, k = F.col("_z"), len(model.means)
    if model.variances is None:
        apart = [_squares(z, m) for m in model.means]
        d = d.withColumn("_d", F.array(*apart))
        own = [F.get("_d", j) for j in range(k)]
        d = d.withColumn("cluster", _first(own, _least(own)))
        d = d.withColumns({"probabilities": F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (j == F.col("cluster")).cast("double")), "distance": F.sqrt(F.get("_d", "cluster"))})
    else:
        d = d.withColumn("_d", F.array(*_log_densities(model, z)))
        d = d.withColumn("_t", F.array_max("_d")).withColumn("_e", F.transform("_d", lambda x: F.exp(x - F.col("_t"))))
        d = d.withColumn("probabilities", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y)))
        own = [F.get("_d", j) for j in range(k)]
        d = d.withColumn("cluster", _first(own, F.col("_t")))
        d = d.withColumn("distance", F.sqrt(F.get(F.array(*[_squares(z, m, v) for m, v in zip(model.means, model.variances)]), "cluster"))).drop("_t", "_e")
    d = d.drop("_z", "_d")
    return d if model.limit is None else d.withColumn("out_of_range", (F.col("distance") > model.limit).cast("int"))


def fit_states(train: DataFrame, groups: dict[str, list[str]], k: int, method: str = "kmeans", *, seed: int = 741, restarts: int = 3, steps: int = 50, far: float = 0.99, **screening) -> States:
    """The best of ``restarts`` k-means fits, or a diagonal mixture that starts from it; k = 1 is the mean of all rows.  Clusters are ordered
    by their means; the limit is the training distance at the rank of ``far``, rounded up."""
    if method not in ("kmeans", "mixture") or k < 1:
        raise ValueError("method is kmeans or mixture, k at least 1")
    model = prepare(train, groups, **screening)
    rows = cut(train.select(scaled(model).alias("z")), "states")
    if k == 1:
        centres, _ = lloyd(rows, np.zeros((1, 1, len(model.features))), 1)
        model = replace(model, means=centres[0])
    else:
        centres, inertia = lloyd(rows, _starts(rows, k, [seed + r for r in range(restarts)]), steps)
        model = replace(model, means=centres[int(np.argmin(inertia))])
        if method == "mixture":
            # the first maximisation is over the rows of each k-means cluster
            z, width = F.col("z"), len(model.features)
            d = rows.select("z", F.array(*[_squares(z, m) for m in model.means]).alias("d")).withColumn("l", F.array_position("d", F.array_min("d")) - 1)
            got = {r["l"]: r for r in d.groupBy("l").agg(F.count("*").alias("n"), *[F.avg(F.get("z", c)).alias(f"m{c}") for c in range(width)], *[F.var_pop(F.get("z", c)).alias(f"v{c}") for c in range(width)]).collect()}
            total = sum(r["n"] for r in got.values())
            model = replace(model, means=np.array([[got[j][f"m{c}"] for c in range(width)] if j in got else model.means[j] for j in range(k)]),
                            variances=np.array([[got[j][f"v{c}"] if j in got else 1.0 for c in range(width)] for j in range(k)]) + 1e-6,
                            shares=np.array([got[j]["n"] / total if j in got else 1e-12 for j in range(k)]))
            model, _ = em_steps(rows, model, steps, tolerance=1e-3)
    model = _canonical(model)
    apart = cut(assign(train, model).select("distance"), "distances")      # read by the count, the ranks and the limit
    n = apart.count()
    at = math.ceil(far * (n - 1))
    near = quantiles(apart.withColumn("_g", F.lit(0)), ["_g"], "distance", {"p": at / max(n - 1, 1)}).first()["p"]
    # the rank's own value, without the last digits of an interpolation
    return replace(model, limit=float(apart.filter(F.col("distance") >= near - 1e-9 * max(1.0, abs(near))).agg(F.min("distance")).first()[0]))


def pairwise_rand(labels: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, ari) for all pairs of label columns, by contingency counts."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(columns, 2)])
    c = labels.select(*columns).groupBy(*columns).agg(F.count("*").cast("double").alias("n")).select(F.explode(pairs).alias("p"), "n")
    c = c.groupBy("p.a", "p.b", "p.x", "p.y").agg(F.sum("n").alias("n"))
    two = lambda n: F.sum(n * (n - 1) / 2)      # noqa: E731
    ra = c.groupBy("a", "b", "x").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(two(F.col("n")).alias("sa"))
    rb = c.groupBy("a", "b", "y").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(two(F.col("n")).alias("sb"))
    s = c.groupBy("a", "b").agg(two(F.col("n")).alias("s"), F.sum("n").alias("n")).join(ra, ["a", "b"]).join(rb, ["a", "b"])
    expected, top = F.col("sa") * F.col("sb") / (F.col("n") * (F.col("n") - 1) / 2), (F.col("sa") + F.col("sb")) / 2
    return s.select("a", "b", F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))


def stability(train: DataFrame, groups: dict[str, list[str]], k: int, day: str, *, seeds: tuple[int, ...] = (741, 742, 743), block: int = 1, steps: int = 50, starts: np.ndarray | None = None, **screening) -> DataFrame:
    """(leg, a, b, ari): agreement of k-means labelings of all training rows between seeds, and between refits on day blocks drawn with replacement.

    All fits are replicates of one keyed job over features prepared once on the training rows; a row counts in a resampled fit as often as its day was drawn.
    starts (seed, cluster, component) replaces the rows drawn to start from."""
    model = prepare(train, groups, **screening)
    days = cut(train.select(F.col(day).alias("_day")).distinct(), "days")
    n = days.count()
    order = days.withColumn("_g", F.lit(0))
    from .ranks import prefix_weights
    index = prefix_weights(order, ["_g"], ["_day"]).select("_day", F.col("below").cast("int").alias("idx"))
    sizes = train.sparkSession.createDataFrame([(s, n) for s in seeds], "seed int, n int")
    drawn = None
    for j, s in enumerate(seeds):
        d = block_draws(sizes.filter(F.col("seed") == s), ["seed"], "n", block, 1, s).groupBy("seed", "idx").agg(F.count("*").cast("double").alias(f"w{j}")).drop("seed")
        drawn = d if drawn is None else drawn.join(d, "idx", "full")
    weight = index.join(drawn, "idx", "left")
    rows = train.withColumn("z", scaled(model)).withColumn("_day", F.col(day)).join(weight, "_day", "left")
    rows = cut(rows.select("z", *[F.coalesce(f"w{j}", F.lit(0.0)).alias(f"w{j}") for j in range(len(seeds))]), "replicates")
    begin = _starts(rows, k, list(seeds)) if starts is None else starts
    both = np.concatenate([begin, begin])
    centres, _ = lloyd(rows, both, steps, [F.lit(1.0)] * len(seeds) + [F.col(f"w{j}") for j in range(len(seeds))])
    z = F.col("z")
    names = [f"{leg}_{s}" for leg in ("seed", "block") for s in seeds]
    apart = rows.select(*[F.array(*[_squares(z, c) for c in centres[r]]).alias(n) for r, n in enumerate(names)])
    labels = cut(apart.select(*[(F.array_position(n, F.array_min(n)) - 1).alias(n) for n in names]), "labels")
    out = None
    for leg in ("seed", "block"):
        mine = [x for x in names if x.startswith(leg)]
        if len(mine) > 1:
            d = pairwise_rand(labels, mine).select(F.lit(leg).alias("leg"), "a", "b", "ari")
            out = d if out is None else out.unionByName(d)
    return out if out is not None else train.sparkSession.createDataFrame([], "leg string, a string, b string, ari double")
