"""Boosted trees for quantile loss, several targets and shares at once, on histograms that Spark sums.

Each model has a target column and a share: 0.5 is the absolute loss (the median), 0.1 and 0.9 the ends of an 80 % interval.  All
models grow in the same jobs:

* features are put into bins between exact quantiles of the training rows (bin 0: unknown, kept to the left of every cut);
* a tree grows level by level: tasks sum gradients and rows by (model, leaf, feature, bin), one grouped sum gives the
  histograms of the whole level, and the driver picks splits from models x leaves x features x bins numbers;
* a leaf's value is the exact quantile of its residuals, by the order statistics of ``ranks``, times the learning rate.

Rows with an unknown target take no part in that model.  The score so far is written every REFRESH trees; in between tasks
apply the trees since then.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .ranks import quantiles

REFRESH = 10


@dataclass(frozen=True)
class Target:
    """A model: the column it is written to, what it is fitted to, and the share of the quantile."""
    name: str
    column: str
    share: float = 0.5


@dataclass
class Tree:
    """Splits by node (feature, bin): children of node i are 2 i + 1 (bin at most the split's) and 2 i + 2; leaves have values."""
    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        at = np.zeros(len(bins), dtype=np.int64)
        for i in sorted(self.splits):
            f, b = self.splits[i]
            mine = np.nonzero(at == i)[0]
            at[mine] = np.where(bins[mine, f] <= b, 2 * i + 1, 2 * i + 2)
        return at

    def score(self, bins: np.ndarray) -> np.ndarray:
        at = self.nodes(bins)
        out = np.zeros(len(bins))
        for i, v in self.values.items():
            out[at == i] = v
        return out


@dataclass
class Boosted:
    """Trees of every model, oldest first; edges are the upper ends of all bins but the last of each feature."""
    targets: list[Target]
    features: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[list[Tree]]

    def bins(self, columns) -> np.ndarray:
        out = np.zeros((len(columns[0]), len(self.features)), dtype=np.uint8)
        for k, (x, e) in enumerate(zip(columns, self.edges)):
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "left"))
        return out


def _numbers(b: pa.RecordBatch, names) -> list[np.ndarray]:
    return [b.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]


def _edges(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    long = train.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "x").filter("x is not null and not isnan(x)")
    cuts = {f"q{i}": i / bins for i in range(1, bins)}
    got = {r["feature"]: [r[q] for q in cuts] for r in quantiles(long, ["feature"], "x", cuts).collect()}       # a row a feature
    return [np.unique(np.array(got.get(f, []), dtype=np.float64)) for f in features]


def _best_splits(hist: np.ndarray, open_: list[int], leaf_rows: int, penalty: float) -> dict[int, tuple[float, int, int]]:
    """(gain, feature, bin) by leaf from hist(leaf, feature, bin, (gradient, rows)); ties to the first feature and bin."""
    out = {}
    for k, node in enumerate(open_):
        left = np.cumsum(hist[k], axis=1)
        whole = left[:, -1:, :]
        right = whole - left
        gain = left[..., 0] ** 2 / (left[..., 1] + penalty) + right[..., 0] ** 2 / (right[..., 1] + penalty) - whole[..., 0] ** 2 / (whole[..., 1] + penalty)
        gain[(left[..., 1] < leaf_rows) | (right[..., 1] < leaf_rows)] = -np.inf
        best = int(np.argmax(np.round(gain, 9)))
        f, b = divmod(best, gain.shape[1])
        if gain[f, b] > 1e-9:
            out[node] = (float(gain[f, b]), f, b)
    return out


def fit(train: DataFrame, features: list[str], targets: list[Target], *, trees: int = 100, rate: float = 0.05, depth: int = 3, leaves: int = 7,
        leaf_rows: int = 60, penalty: float = 10.0, bins: int = 64) -> Boosted:
    """One model a target.  leaves bounds the leaves of a tree, which grows by its best gains; leaf_rows is the least rows of a leaf."""
    assert 2 <= bins <= 255 and trees >= 0
    edges, columns = _edges(train, features, bins), [t.column for t in targets]
    known = {c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in dict.fromkeys(columns)}
    long = train.select(*[known[t.column].alias(f"m{m}") for m, t in enumerate(targets)]).unpivot([], [f"m{m}" for m in range(len(targets))], "m", "y").filter("y is not null")
    shares = {f"s{k}": s for k, s in enumerate(sorted({t.share for t in targets}))}
    which = [next(n for n, s in shares.items() if s == t.share) for t in targets]
    base = np.zeros(len(targets))
    for r in quantiles(long, ["m"], "y", shares).collect():                                                       # a row a model
        base[int(r["m"][1:])] = r[which[int(r["m"][1:])]]
    model = Boosted(targets, features, edges, base, [[] for _ in targets])
    share = np.array([t.share for t in targets])

    def start(batches):
        for b in batches:
            x = model.bins(_numbers(b, features)).tobytes()
            y = np.stack(_numbers(b, [f"_y{m}" for m in range(len(targets))]), axis=1)
            yield pack(x, y, np.tile(base, (b.num_rows, 1)))

    def pack(x: bytes, y: np.ndarray, f: np.ndarray):
        w, v = len(features), 8 * len(targets)
        y, f = y.tobytes(), f.tobytes()
        n = len(x) // w
        parts = [pa.array([z[i * k:(i + 1) * k] for i in range(n)], pa.binary()) for z, k in ((x, w), (y, v), (f, v))]
        return pa.RecordBatch.from_arrays(parts, names=["x", "y", "f"])

    def unpack(b):
        x, y, f = (b"".join(b.column(c).to_pylist()) for c in ("x", "y", "f"))
        n = b.num_rows
        return (np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(y).reshape(n, -1), np.frombuffer(f).reshape(n, -1))

    def scored(b, since: int):
        """Bins, targets and scores of a batch, with the trees since the scores were written."""
        x, y, f = unpack(b)
        f = f.copy()
        for m, grown in enumerate(done):
            for t in grown[since:]:
                f[:, m] += t.score(x)
        return x, y, f

    done: list[list[Tree]] = model.trees
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features], *[known[t.column].alias(f"_y{m}") for m, t in enumerate(targets)])
    state, since = cut(rows.mapInArrow(start, "x binary, y binary, f binary"), "boosting"), 0

    for k in range(trees):
        grown = [Tree() for _ in targets]
        open_ = [[0] for _ in targets]
        for _ in range(depth):
            if not any(open_):
                break

            def sums(batches, grown=grown, open_=open_, since=since):
                size = len(features) * (bins + 1)
                total = [np.zeros((len(o), size, 2)) for o in open_]
                for b in batches:
                    if not b.num_rows:
                        continue
                    x, y, f = scored(b, since)
                    cell = x.astype(np.int64) + np.arange(len(features)) * (bins + 1)
                    for m, o in enumerate(open_):
                        at = grown[m].nodes(x)
                        g = np.where(f[:, m] > y[:, m], 1 - share[m], np.where(f[:, m] < y[:, m], -share[m], 0.0))
                        for j, node in enumerate(o):
                            mine = np.nonzero((at == node) & ~np.isnan(y[:, m]))[0]
                            flat = cell[mine].ravel()
                            total[m][j, :, 0] += np.bincount(flat, np.repeat(g[mine], len(features)), minlength=size)
                            total[m][j, :, 1] += np.bincount(flat, minlength=size)
                for m, t in enumerate(total):
                    j, c = np.nonzero(t[..., 1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), m)), pa.array(j), pa.array(c), pa.array(t[j, c, 0]), pa.array(t[j, c, 1])], names=["m", "j", "c", "g", "n"])

            got = state.mapInArrow(sums, "m long, j long, c long, g double, n double").groupBy("m", "j", "c").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
            m_, j_, c_, g_, n_ = (got.column(c).to_numpy() for c in ("m", "j", "c", "g", "n"))
            for m, o in enumerate(open_):
                mine = m_ == m
                hist = np.zeros((len(o), len(features) * (bins + 1), 2))
                hist[j_[mine], c_[mine]] = np.stack([g_[mine], n_[mine]], axis=1)
                best = _best_splits(hist.reshape(len(o), len(features), bins + 1, 2), o, leaf_rows, penalty)
                room = leaves - 1 - len(grown[m].splits)
                split = sorted(best, key=lambda i: (-best[i][0], i))[:max(room, 0)]
                for i in split:
                    grown[m].splits[i] = best[i][1:]
                open_[m] = [c for i in sorted(split) for c in (2 * i + 1, 2 * i + 2)]

        def residuals(batches, grown=grown, since=since):
            for b in batches:
                if b.num_rows:
                    x, y, f = scored(b, since)
                    for m, t in enumerate(grown):
                        ok = ~np.isnan(y[:, m])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), m)), pa.array(t.nodes(x)[ok]), pa.array((y - f)[ok, m])], names=["m", "node", "r"])

        ends = quantiles(state.mapInArrow(residuals, "m long, node long, r double"), ["m", "node"], "r", shares).collect()     # a row a leaf
        for r in ends:
            grown[r["m"]].values[r["node"]] = rate * r[which[r["m"]]]
        for m, t in enumerate(grown):
            done[m].append(t)
        if k + 1 - since >= REFRESH and k + 1 < trees:
            def refresh(batches, since=since):
                for b in batches:
                    if b.num_rows:
                        x, y, f = scored(b, since)
                        yield pack(x.tobytes(), y, f)
            state, since = cut(state.mapInArrow(refresh, "x binary, y binary, f binary"), "boosting"), k + 1
    return model


def predict(rows: DataFrame, model: Boosted, *, ordered: list[str] | None = None) -> DataFrame:
    """rows with a column for each model; the columns named in ``ordered`` are sorted within each row.  Unknown features are
    known to the trees as such, so that every row gets values."""
    names = [t.name for t in model.targets]
    place = [names.index(n) for n in ordered or []]
    carried = [f for f in rows.schema.fields if f.name not in names]
    feats = [f"_x{k}" for k in range(len(model.features))]

    def run(batches):
        for b in batches:
            out = np.tile(model.base, (b.num_rows, 1))
            if b.num_rows:
                x = model.bins(_numbers(b, feats))
                for m, grown in enumerate(model.trees):
                    for t in grown:
                        out[:, m] += t.score(x)
                out[:, place] = np.sort(out[:, place], axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in carried), *(pa.array(out[:, m]) for m in range(len(names)))], names=[*(f.name for f in carried), *names])

    d = rows.select(*[f.name for f in carried], *[F.col(f).cast("double").alias(x) for f, x in zip(model.features, feats)])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), *(f"`{n}` double" for n in names)])
    return d.mapInArrow(run, fields)


def calibrated(predicted: DataFrame, held_out: DataFrame, target: str, shares: dict[str, float]) -> DataFrame:
    """Adds to each column of shares the exact quantile of its residuals on held-out predictions, then sorts them within the row."""
    names = list(shares)
    long = held_out.filter(F.col(target).isNotNull()).select(*[(F.col(target) - F.col(n)).alias(n) for n in names]).unpivot([], names, "name", "r").filter("r is not null")
    got = quantiles(long, ["name"], "r", {f"_q{k}": shares[n] for k, n in enumerate(names)}).collect()            # a row a share
    add = {r["name"]: r[f"_q{names.index(r['name'])}"] for r in got}
    both = F.array_sort(F.array(*[F.col(n) + F.lit(add.get(n, 0.0)) for n in names]))
    order = sorted(names, key=lambda n: shares[n])
    return predicted.withColumn("_both", both).withColumns({n: F.get("_both", k) for k, n in enumerate(order)}).drop("_both")


def token_flags(train: DataFrame, tokens: str, most: int = 20) -> list[str]:
    """The tokens of an array column found most often in the training rows, ties by name."""
    got = train.select(F.explode(tokens).alias("t")).filter("t is not null and t <> ''").groupBy("t").count().orderBy(F.desc("count"), "t").limit(most).collect()
    return [r["t"] for r in got]


def with_flags(df: DataFrame, tokens: str, found: list[str], prefix: str = "token_") -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each token found, and their names."""
    names = [f"{prefix}{k}" for k in range(len(found))]
    return df.withColumns({n: F.coalesce(F.array_contains(tokens, t), F.lit(False)).cast("int") for n, t in zip(names, found)}), names
