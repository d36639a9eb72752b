"""Exact top-k inner products by aggregation over sorted lists without random access.

Vectors are turned to integers, floor(scale x component).  Candidates are dealt into blocks; a block keeps
one list for each dimension, its candidates sorted by that component.  A block of queries reads all lists
from the end that its weight's sign asks for, to the given DEPTHS in turn.  What has been read gives
each candidate a lower bound (unread components at the far end of their list) and an upper bound (unread
components at the list's frontier).  A query stops reading when no candidate outside its best k by lower
bound can still reach the k-th lower bound; only the candidates whose upper bound reaches it are resolved to
their final scores, and the best k of each block meet in one ranking by query.

For a weight w the bound on w * x is w * max(x, frontier) on the list read from the top and
w * min(x, frontier) on the one read from the bottom, so the bounds of a whole block of queries are one
matrix product with what the block has read so far.

The (query block, candidate block) grid deals every query to all candidate blocks and every candidate
to all query blocks; a task holds one cell of bounded size.  Each block sends at most k rows a query.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

K = 20
SCALE = 64
DEPTHS = (0.5, 0.75, 1.0)
QUERIES, CANDIDATES = 1024, 2048     # rows of a block, about, of up to DIMENSIONS components
DIMENSIONS = 128


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors.  Null ids, null vectors and vectors with a null or non-finite component take no
    part; rows of one id all stay."""
    x = F.col("embedding")
    fit = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.filter(fit).select("vec_id", v.alias("v"))


class Lists:
    """Sorted lists of a candidate block: for each dimension the candidates in ascending order of its component."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        dims = np.arange(x.shape[1])
        # read so far from the top and the bottom: values, and for unread ones the frontier or the far end
        self.top_upper, self.top_lower = np.tile(self.high, (self.n, 1)), np.tile(self.low, (self.n, 1))
        self.bottom_upper, self.bottom_lower = np.tile(self.low, (self.n, 1)), np.tile(self.high, (self.n, 1))
        self.dims, self.depth = dims, 0

    def read_to(self, depth: int) -> None:
        """Goes on reading every list from both ends down to ``depth`` entries; the last value read is the frontier."""
        for a, read, ends in ((self.order[self.depth:depth], "top_lower", False), (self.order[self.depth:depth], "bottom_lower", True)):
            at = a if ends else self.order[self.n - depth:self.n - self.depth]
            got = self.x[at, self.dims]
            getattr(self, read)[at, self.dims] = got
        top, bottom = self.x[self.order[self.n - depth], self.dims], self.x[self.order[depth - 1], self.dims]
        # read values lie at or beyond the frontier, unread ones short of it
        rank_top = self.top_lower >= top
        rank_bottom = self.bottom_lower <= bottom
        self.top_upper = np.where(rank_top, self.top_lower, top)
        self.bottom_upper = np.where(rank_bottom, self.bottom_lower, bottom)
        self.depth = depth


def _exact(kind, w, x):
    return (w.astype(kind) @ x.astype(kind).T)


def best_of_block(qkey: np.ndarray, q: np.ndarray, ckey: np.ndarray, cid: np.ndarray, x: np.ndarray, k: int = K, depths=DEPTHS):
    """(query place, candidate place, score) of the best k of a block for each query, ties to the smaller id; keys name rows,
    and a query does not meet the row of its own key."""
    order = np.lexsort((ckey, cid))
    ckey, x = ckey[order], x[order]
    n = len(x)
    largest = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(x).max(initial=0))) * max(1, x.shape[1])
    # sums below 2**53 are exact in doubles; beyond them 64-bit integers, which wrap past 2**63
    kind = np.float64 if largest < 2 ** 53 else np.int64
    lists = Lists(x)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    todo = np.arange(len(q))
    out_q, out_c, out_s = [], [], []
    far = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    by_key = np.argsort(ckey, kind="stable")
    own = by_key[np.minimum(np.searchsorted(ckey[by_key], qkey), n - 1)]
    own = np.where(ckey[own] == qkey, own, -1)
    for share in depths:
        lists.read_to(max(min(n, k + 1), math.ceil(share * n)))
        upper = _exact(kind, up[todo], lists.top_upper) + _exact(kind, down[todo], lists.bottom_upper)
        lower = upper if lists.depth == n else _exact(kind, up[todo], lists.top_lower) + _exact(kind, down[todo], lists.bottom_lower)
        mine = np.nonzero(own[todo] >= 0)[0]
        upper[mine, own[todo][mine]] = far
        lower[mine, own[todo][mine]] = far
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(todo), far)
        reach = (upper >= kth[:, None]) & (upper > far)
        # a query stops when few beside its k best can still qualify, or all has been read
        stop = (reach.sum(axis=1) <= 4 * k) | (lists.depth == n)
        for r in np.nonzero(stop)[0]:
            at = np.nonzero(reach[r])[0]
            final = x[at].astype(kind) @ q[todo[r]].astype(kind) if lists.depth < n else upper[r, at]
            top = np.lexsort((at, -final))[:k]
            out_q.append(np.full(len(top), todo[r]))
            out_c.append(order[at[top]])
            out_s.append(final[top].astype(np.int64))
        todo = todo[~stop]
        if not len(todo):
            break
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_q or none), np.concatenate(out_c or none), np.concatenate(out_s or none)


def _matrix(column, width):
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, scale: int = SCALE, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with all other vectors of its length
    (all, if fewer), ties to the smaller vec_id.  Every row is a candidate of every query but its own, rows of the same vec_id
    too; queries of one vec_id give k rows each.  No query or no candidate gives no rows."""
    v = quantised(vectors, scale).withColumn("width", F.size("v")).filter("width > 0")
    v = cut(v.withColumn("key", F.monotonically_increasing_id()), "vectors")
    nq, nc, width = v.agg(F.count(F.when(is_query, 1)), F.count("*"), F.max("width")).first()
    share = max(1.0, (width or 1) / DIMENSIONS)         # longer vectors, smaller blocks
    rows, cols = max(1, math.ceil(nq * share / queries)), max(1, math.ceil(nc * share / candidates))
    mine = F.xxhash64("key")
    q = v.filter(is_query).withColumn("row", F.pmod(mine, F.lit(rows)).cast("int")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    c = v.withColumn("col", F.pmod(mine, F.lit(cols)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["key", "query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        width = a.column("width")[0].as_py()
        qid, cid = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        qkey = a.column("key").to_numpy()
        i, j, s = best_of_block(qkey, _matrix(a.column("v"), width), b.column("key").to_numpy(), cid, _matrix(b.column("v"), width), k)
        return pa.table([pa.array(qkey[i]), pa.array(qid[i]), pa.array(cid[j]), pa.array(s)], names=names)

    key = ["width", "row", "col"]
    found = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(cell, "key long, query_id long, vec_id long, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
