"""Vector code compression: product codebooks fitted by ball k-means in whole numbers.

A vector's components become floor(SCALE * x) and are cut into PARTS equal parts; each part position has a codebook of up to ENTRIES
entries, at first those of the smallest ids.  In each round every part goes to its nearest entry (squared distance, ties to the lower index),
then each entry becomes the floor of its parts' mean; unused ones stay.  A last assignment gives the codes.

A part is looked at from the entry it belonged to before (its ball).  An entry at distance D from that one can be nearer, or tie, only where
D <= 2 d for a part at distance d from its own:

* the ball's radius (the largest d among the parts at hand) leaves its neighbour entries; a ball that has not moved, and whose
  neighbours have not, keeps its parts without work;
* parts in the stable core (2 d below the nearest neighbour's D) stay;
* the other parts lie in rings between the neighbours' D / 2, and one in ring k is compared with the k nearest neighbours only.

Rows carry their codes from round to round in a written table; tasks give back one sum for each entry they used, so that a
cluster with a third of all rows is summed before the exchange, and the driver sees ENTRIES sums for each part position and no rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * float(most) ** 2 < 2 ** 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


class Balls:
    """One part position's entries, their distances, and which of them moved in the last round."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray):
        self.entries, self.moved = entries, moved
        apart = squared(entries, entries)
        np.fill_diagonal(apart, -1)                      # an entry is its own first neighbour
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.apart[:, 0] = 0

    def assign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(codes, squared distances, exact comparisons made) of parts x that were nearest to ``code`` before the entries moved."""
        code, made = code.copy(), len(x)
        gap = x - self.entries[code]
        dist = (gap * gap).sum(1)
        by = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[by], np.arange(len(self.entries) + 1))
        for i in np.nonzero(np.diff(edges))[0]:
            mine = by[edges[i]:edges[i + 1]]
            d = dist[mine]
            near = np.searchsorted(self.apart[i], 4 * d.max(), "right")        # neighbours of the ball, itself first
            if near <= 1 or not self.moved[self.order[i, :near]].any():
                continue
            ring = np.searchsorted(self.apart[i, :near], 4 * d, "right")
            low = 1
            while low < near:
                # rings up to each power of two are compared together
                high = min(2 * low, near)
                at = (ring > low) & (ring <= high)
                if at.any():
                    some = mine[at]
                    cand = np.sort(self.order[i, :high])                       # ties go to the lower index
                    all_ = squared(x[some], self.entries[cand])
                    best = all_.argmin(1)
                    code[some], dist[some] = cand[best], all_[np.arange(len(some)), best]
                    made += all_.size
                low = high
        return code, dist, made


def _nearest(x: np.ndarray, entries: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([squared(x[i:i + block], entries).argmin(1) for i in range(0, len(x), block)] or [np.zeros(0, np.int64)])


def _integers(vector: Column, scale: int, most: int) -> Column:
    return F.transform(vector, lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(v.cast("double") * scale))).cast("long"))


def _round(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, sums: bool) -> DataFrame:
    """rows with new codes and errors; with sums, rows with a ``stat`` (part, entry, count, sums...) stand among them.

    Without moved it is the first assignment, which starts from no ball."""
    parts, entries, width = books.shape
    keep = [f for f in rows.schema.fields if f.name not in ("code", "error", "stat")]

    def run(batches):
        balls = None if moved is None else [Balls(books[p], moved[p]) for p in range(parts)]
        total = np.zeros((parts, entries, width), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        names = [*(f.name for f in keep), "code", "error", "stat"]
        kinds = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
            old = None if balls is None else np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts)
            code, error = np.zeros((n, parts), dtype=np.int64), np.zeros(n, dtype=np.int64)
            for p in range(parts):
                mine = np.ascontiguousarray(x[:, p])
                if balls is None:
                    code[:, p] = _nearest(mine, books[p])
                    gap = mine - books[p][code[:, p]]
                    error += (gap * gap).sum(1)
                else:
                    code[:, p], dist, _ = balls[p].assign(mine, old[:, p].astype(np.int64))
                    error += dist
                np.add.at(total[p], code[:, p], mine)
                count[p] += np.bincount(code[:, p], minlength=entries)
            flat = code.astype(np.uint8).tobytes()
            codes = pa.array([flat[i:i + parts] for i in range(0, len(flat), parts)], pa.binary())
            kinds = [b.column(f.name).type for f in keep]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), codes, pa.array(error), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        if sums and kinds is not None:
            stat = [[p, e, int(count[p, e]), *total[p, e].tolist()] for p, e in zip(*np.nonzero(count))]
            stat = [[int(v) for v in s] for s in stat]
            m = len(stat)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, k) for k in kinds), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(stat, pa.list_(pa.int64()))], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(run, f"{fields}, code binary, error long, stat array<long>")


def compress(vectors: DataFrame, *, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of vectors(vec_id, label, <vector>), and the codebooks (parts x entries x components; None without rows).

    code has a byte for each part.  Rows whose vector is null or has a null or non-finite component are dropped, and so are those that
    are not as long as the longest one, whose length ``parts`` must divide.  Equal rows and rows of equal vec_id all stay; among equal ids the
    first entries go by the vector, a null id comes last.  Components are held within what keeps all sums of squares in 63 bits
    (about 94,900,000 for 64 components)."""
    assert 1 <= entries <= 256 and parts >= 1 and rounds >= 0
    v = F.col(vector)
    good = F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    kept = vectors.filter(good)
    long = kept.agg(F.max(F.size(v))).first()[0]
    none = kept.sparkSession.createDataFrame([], "vec_id long, label int, code binary, error long")
    if not long:
        return (none if long is None else kept.select("vec_id", "label", F.unhex(F.lit("00" * parts)).alias("code"), F.lit(0).cast("long").alias("error"))), None
    if long % parts:
        raise ValueError(f"{parts} parts do not divide {long} components")
    most = int((2 ** 63 / (16 * long)) ** 0.5) - 1
    rows = cut(kept.filter(F.size(v) == long).select("vec_id", "label", _integers(v, scale, most).alias("x")), "integers")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()       # at most ``entries`` rows
    books = np.array([r.x for r in first], dtype=np.int64).reshape(len(first), parts, long // parts).transpose(1, 0, 2).copy()
    moved, state, width = None, rows, long // parts
    for _ in range(rounds):
        state = cut(_round(state, books, moved, True), "assigned")
        stat = state.filter("stat is not null").groupBy(F.col("stat")[0].alias("p"), F.col("stat")[1].alias("e"))
        got = stat.agg(F.sum(F.col("stat")[2]).alias("n"), *[F.sum(F.col("stat")[3 + k]).alias(f"s{k}") for k in range(width)]).collect()   # a row an entry
        before = books.copy()
        for r in got:
            books[r.p, r.e] = [r[f"s{k}"] // r.n for k in range(width)]
        moved = (books != before).any(axis=2)
        state = state.filter("stat is null")
    out = _round(state, books, moved, False)
    return out.select("vec_id", "label", "code", "error"), books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (hex), error, label_error (summed over equal labels, nulls together) and codebooks_sha256."""
    found, books = compress(vectors, **options)
    found = cut(found, "codes")
    whole = found.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return found.join(whole, F.col("label").eqNullSafe(F.col("_l"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
