"""Removal of repeated passages by a distributed difference-cover suffix sort.

A byte goes when some string of LENGTH bytes that covers it also starts anywhere else, in its own text or in another one.
Strings are judged on the input, matches never cross texts, and what is left is concatenated.

1. Equal texts are one row of their own; a text that occurs twice goes as a whole.
2. Only bytes that can be in a repeat are sorted.  Each string of LENGTH bytes has an anchor, the place of its least
   hash of ANCHOR bytes.  Equal strings have equal anchors, so a string whose anchor's bytes stand nowhere else is unique:
   this loses nothing.  Anchors are about one place in 120, and their counts are summed before the shuffle.
3. What is left is parsed into phrases: a phrase runs from one place whose next TRIGGER bytes have a hash divisible by EVERY to the
   end of the next such trigger.  No phrase is the start of another one, so that the order of phrase sequences is
   the order of bytes (prefix-free parsing).  Phrases are named by their rank.
4. The difference-cover sort (modulo 3) of the phrase strings: triples at places 1 and 2 modulo 3 are sorted and named by their ranks;
   while names repeat within LENGTH bytes, the strings of names are sorted by recursion; suffixes at places 0 modulo 3
   follow from their first name and the rank behind it, and are merged by counting in two sorts.  Ranks count the smaller suffixes.
5. Places between triggers are sorted by (the bytes up to the next trigger, that trigger's rank): equal strings stand next to each other, and
   adjacent ones are compared by a 64-bit digest.  The first round does so with whole stretches of starts between finer triggers
   (FINE), and with the CORE of bytes behind each of these that all the strings of its stretch share.  Only stretches that are not
   repeated whole but have a repeated core, and the first of those that are repeated, go on start by start.

All sorts are range partitioned with the place itself as the last key, so that one string that makes up a third of all
rows is dealt over tasks; the two rows at the ends of each partition are compared in a small table of their own.

Empty, null and short texts are left whole; repeated rows count as copies; a null doc_id is kept.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut as _cut
from .common import free_names


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Texts and sorted keys are written by zstd, which halves them."""
    return _cut(df, purpose, "zstd")


LENGTH = 400
ANCHOR = 160
TRIGGER = 12
EVERY, FINE = 96, 24     # one place in so many starts a phrase; the first is a multiple of the second
MOST_KEYS = 2_000_000    # texts with candidates that are broadcast as two hashes each; beyond that the same semi-join shuffles
PIECE = 1 << 19          # places hashed at one time; fewer than 2 ** SHIFT with what follows them
SHIFT = 20

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2 ** 64)


def _mix(h):
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_TABLES: dict[str, np.ndarray] = {}


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each place on; equal bytes have equal hashes."""
    n = len(data)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    if len(_TABLES.get("up", ())) < n:
        _TABLES["up"], _TABLES["down"] = _powers(_STEP, 2 * n), _powers(_BACK, 2 * n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _TABLES["up"][:n], out=total[1:])
    return _mix((total[width:] - total[:-width]) * _TABLES["down"][:n - width + 1])


def pieces(texts, length: int):
    """(bytes, [(row, place in the text, place in the bytes, size)]): short texts together, long ones in parts that overlap by length - 1."""
    held, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for a in range(0, max(len(text) - length + 1, 0), PIECE):
            part = text[a:a + PIECE + length - 1]
            parts.append((row, a, size, len(part)))
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(held), dtype=np.uint8), parts
                held, parts, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), parts


def anchors(data: np.ndarray, parts, length: int = LENGTH, anchor: int = ANCHOR):
    """(part, place, hash, first, last): the anchors, and the first and last start of the strings that each one stands for."""
    h = rolling(data, anchor)
    low = np.uint64(2 ** SHIFT - 1)
    least, span, wide = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - anchor + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[:len(least) - (wide - span)], least[wide - span:])
    at = (least & low).astype(np.int64)
    begin = np.array([p[2] for p in parts])
    starts = np.concatenate([np.arange(b, b + p[3] - length + 1) for b, p in zip(begin, parts)])
    part = np.repeat(np.arange(len(parts)), [p[3] - length + 1 for p in parts])
    mine = at[starts]
    edge = np.nonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (part[1:] != part[:-1])]))[0]
    last = np.append(edge[1:], len(starts)) - 1
    own = part[edge]
    back = np.array([p[1] for p in parts])[own] - begin[own]
    return own, mine[edge] + back, h[mine[edge]].view(np.int64), starts[edge] + back, starts[last] + back


def _anchor_rows(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches):
        for b in batches:
            k1 = b.column("k1").to_numpy(zero_copy_only=False)
            body = (x.as_py() for x in b.column("text"))
            for data, parts in pieces(body, length):
                own, place, h, _, _ = anchors(data, parts, length, anchor)
                row = np.array([p[0] for p in parts])[own]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], place, h)], names=["k1", "place", "h"])

    return texts.select("k1", "text").mapInArrow(run, "k1 long, place long, h long")


def _runs(first, last):
    """Starts of candidate strings as disjoint ranges [from, to]."""
    order = np.argsort(first, kind="stable")
    a, z = np.asarray(first)[order], np.maximum.accumulate(np.asarray(last)[order])
    new = np.concatenate([[True], a[1:] > z[:-1] + 1])
    return a[new], z[np.append(np.nonzero(new)[0][1:] - 1, len(a) - 1)]


def _merged(first, last, length: int):
    """Stretches [from, to) of bytes from the starts of strings."""
    order = np.argsort(first, kind="stable")
    a, z = np.asarray(first)[order], np.maximum.accumulate(np.asarray(last)[order]) + length
    new = np.concatenate([[True], a[1:] > z[:-1]])
    return a[new], z[np.append(np.nonzero(new)[0][1:] - 1, len(a) - 1)]


def _shared(marks: DataFrame) -> DataFrame:
    """The rows of marks whose hash another place has too; those at the ends of tasks stay, where that is not known.

    Copies of one text stand next to each other and say nothing about one another: one row of them at least stays."""
    order = ("h", "k1", "place")

    def run(batches):
        held, met = None, True                      # the last row so far, and whether it is known to stay
        for b in batches:
            if not b.num_rows:
                continue
            x = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            h, *who = (x.column(c).to_numpy() for c in order)
            same = (h[1:] == h[:-1]) & np.logical_or.reduce([w[1:] != w[:-1] for w in who])
            keep = np.concatenate([[met], same]) | np.append(same, False)
            yield from x.filter(pa.array(np.append(keep[:-1], False))).to_batches()
            held, met = x.slice(len(h) - 1).to_batches()[0], bool(keep[-1])
        if held is not None:
            yield held

    return marks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, marks.schema)


def triggers(text: bytes, trigger: int, every: int) -> np.ndarray:
    out = []
    for a in range(0, len(text), PIECE):
        h = rolling(np.frombuffer(text[a:a + PIECE + trigger - 1], dtype=np.uint8), trigger)
        out.append(np.nonzero((h >> np.uint64(24)) % np.uint64(every) == 0)[0] + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _stretches(found: DataFrame, length: int, anchor: int) -> DataFrame:
    """(u, start, body, lo, hi): candidate bytes of each text in disjoint stretches, and in each the ranges of candidate starts."""
    def run(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            for i in range(b.num_rows):
                u, text, shared = b.column("u")[i].as_py(), b.column("text")[i].as_py(), b.column("places")[i].values.to_numpy()
                first, last = [], []
                for data, parts in pieces([text], length):
                    _, place, _, a, z = anchors(data, parts, length, anchor)
                    mine = np.isin(place, shared)
                    first.append(a[mine])
                    last.append(z[mine])
                if not sum(map(len, first)):
                    continue
                a, z = _runs(np.concatenate(first), np.concatenate(last))
                begin, end = _merged(a, z, length)
                cuts = np.searchsorted(a, begin).tolist() + [len(a)]
                for k, (x, y) in enumerate(zip(begin.tolist(), end.tolist())):
                    for o, v in zip(out, (u, x, text[x:y], a[cuts[k]:cuts[k + 1]] - x, z[cuts[k]:cuts[k + 1]] - x)):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["u", "start", "body", "lo", "hi"])

    return found.select("u", "text", "places").mapInArrow(run, "u long, start long, body binary, lo array<long>, hi array<long>")


def _phrases(parts: DataFrame, length: int, trigger: int, every: int) -> DataFrame:
    """(u, t, phrase, n): the phrases of each stretch (u is its number here), at most ``length`` bytes of each."""
    def run(batches):
        for b in batches:
            held, size = [], 0
            for i in range(b.num_rows):
                u, body = b.column("v")[i].as_py(), b.column("body")[i].as_py()
                at = triggers(body, trigger, every)
                n = np.minimum(np.append(at[1:], len(body))[:len(at)] - at, length)
                at = at.tolist()
                ends = [*(x + trigger for x in at[1:]), len(body)]
                for k in range(0, len(at), 65_536):
                    more = at[k:k + 65_536]
                    held.append((u, k, [body[p:min(q, p + length)] for p, q in zip(more, ends[k:])], n[k:k + 65_536]))
                    size += len(more)
                    if size >= 65_536:
                        yield batch(held)
                        held, size = [], 0
            if held:
                yield batch(held)

    def batch(held):
        sizes = [len(h[2]) for h in held]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat([h[0] for h in held], sizes)), pa.array(np.concatenate([np.arange(h[1], h[1] + m) for h, m in zip(held, sizes)])),
            pa.array([x for h in held for x in h[2]], pa.binary()), pa.array(np.concatenate([h[3] for h in held]))], names=["u", "t", "phrase", "n"])

    return parts.select("v", "body").mapInArrow(run, "u long, t long, phrase binary, n long")


def running(keys: DataFrame, order: list[str], sums: list[str], purpose: str) -> DataFrame:
    """Distinct keys with, for each column of sums, its sum over all smaller keys in place of its value."""
    fixed = cut(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), purpose)
    whole = fixed.groupBy("_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)           # a row for each partition
    before = whole.select("_part", *[F.coalesce(F.sum(f"_{s}").over(ahead), F.lit(0)).alias(f"_{s}") for s in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = fixed.withColumns({s: F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    return out.join(F.broadcast(before), "_part").withColumns({s: F.col(s) + F.col(f"_{s}") for s in sums}).drop("_part", *[f"_{s}" for s in sums])


def suffix_ranks(strings: DataFrame, limit: int) -> DataFrame:
    """(u, t, rank) for strings(u, t, c, n): how many suffixes are smaller than the one at place t of string u.

    c >= 0 are names in order, n the length each stands for; suffixes alike over ``limit`` of length may tie.
    """
    along = Window.partitionBy("u").orderBy("t")
    nxt = lambda c, k, end: F.lead(c, k, end).over(along)      # noqa: E731
    s = cut(strings.select("u", "t", "c", nxt("c", 1, -1).alias("c1"), nxt("c", 2, -1).alias("c2"), (F.col("n") + nxt("n", 1, 0) + nxt("n", 2, 0)).alias("n3")), "triples")
    sampled = s.filter("t % 3 <> 0")
    keys = sampled.groupBy("c", "c1", "c2").agg(F.count("*").alias("name"), F.count("*").alias("k"), F.min("n3").alias("least"))
    names = cut(running(keys, ["c", "c1", "c2"], ["name"], "sorted-triples"), "names")
    named = sampled.join(names, ["c", "c1", "c2"])
    if names.filter((F.col("k") > 1) & (F.col("least") < limit) & (F.col("c2") >= 0)).isEmpty():
        ranks = named.select("u", "t", F.col("name").alias("r"))
    else:
        inner = suffix_ranks(named.select((F.col("u") * 2 + F.col("t") % 3 - 1).alias("u"), F.floor(F.col("t") / 3).alias("t"), F.col("name").alias("c"), F.col("n3").alias("n")), limit)
        ranks = inner.select(F.shiftright("u", 1).alias("u"), (F.col("t") * 3 + 1 + F.pmod("u", F.lit(2))).alias("t"), F.col("rank").alias("r"))
    every = s.join(ranks, ["u", "t"], "left").select("u", "t", "c", "c1", "r", (F.col("t") % 3).alias("m"))
    every = cut(every.withColumns({"r1": nxt("r", 1, -1), "r2": nxt("r", 2, -1)}), "ranked")
    count = lambda m: F.count(F.when(F.col("m") == m, 1))      # noqa: E731
    one = running(every.filter("m <> 2").groupBy("c", "r1").agg(count(0).alias("a0"), count(1).alias("a1")), ["c", "r1"], ["a0", "a1"], "merge-1")
    two = running(every.filter("m <> 1").groupBy("c", "c1", "r2").agg(count(0).alias("b0"), count(2).alias("b2")), ["c", "c1", "r2"], ["b0", "b2"], "merge-2")
    rest = every.filter("m = 0").join(one, ["c", "r1"]).join(two, ["c", "c1", "r2"]).select("u", "t", (F.col("a0") + F.col("a1") + F.col("b2")).alias("rank"))
    first = every.filter("m = 1").join(one, ["c", "r1"]).select("u", "t", (F.col("r") + F.col("a0")).alias("rank"))
    second = every.filter("m = 2").join(two, ["c", "c1", "r2"]).select("u", "t", (F.col("r") + F.col("b0")).alias("rank"))
    return cut(rest.unionByName(first).unionByName(second), "ranks")


class Digests:
    """Hashes of any stretch of data from tables of stretches of 1, 2, 4 ... bytes."""

    def __init__(self, data: np.ndarray, most: int):
        self.tables = [_BYTES[data]]
        for k in range(most.bit_length() - 1):
            h = self.tables[-1]
            half = 1 << k
            self.tables.append(_mix(h[:-half] * np.uint64(5) + _mix(h[half:] * np.uint64(7) + np.uint64(k))) if len(h) > half else h[:0])

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        at, out = at.astype(np.int64), size.astype(np.uint64) * np.uint64(_STEP)
        for k in range(len(self.tables) - 1, -1, -1):
            has = np.nonzero(size >> k & 1)[0]
            if len(has):
                out[has] = _mix(out[has] * np.uint64(3) + self.tables[k][at[has]])
                at[has] += 1 << k
        return out


class Pack:
    """Stretches one after the other, with their candidate starts and triggers in the places of the joined bytes."""

    def __init__(self, pieces_, length: int, trigger: int, every: int, fine: int):
        sizes = np.array([len(p[2]) for p in pieces_])
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.data = np.frombuffer(b"".join(p[2] for p in pieces_), dtype=np.uint8)
        self.v, self.off = np.array([p[0] for p in pieces_]), np.array([p[1] for p in pieces_])
        lo, hi = (np.concatenate([p[k] + b for p, b in zip(pieces_, self.begin)]) for k in (3, 4))
        n = hi - lo + 1
        self.q = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.piece = np.searchsorted(self.end, self.q, "right")
        h = rolling(self.data, trigger) >> np.uint64(24)
        at = np.nonzero(h % np.uint64(fine) == 0)[0]
        at = at[at + trigger <= self.end[np.searchsorted(self.end, at, "right")]]
        coarse = at[h[at] % np.uint64(every) == 0]
        ranks = np.concatenate([p[5] for p in pieces_])
        assert len(ranks) == len(coarse)
        self.fine, self.coarse, self.rank = np.append(at, len(self.data)), np.append(coarse, len(self.data)), np.append(ranks, 0)
        self.trigger, self.digests = trigger, Digests(self.data, 2 * length)

    def behind(self, q, piece):
        """The next fine trigger of each place; the end of its piece where there is none."""
        return np.minimum(self.fine[np.searchsorted(self.fine, q)], self.end[piece])

    def keyed(self, at, size):
        """(tail, rank, digest) of the ``size`` bytes from each place on, all within a piece; the tail holds the size, so that only
        strings of one length are neighbours."""
        k = np.searchsorted(self.coarse, at)
        to = self.coarse[k]
        inside = to + self.trigger <= at + size
        tail = _mix(self.digests.of(at, np.where(inside, to - at, size)) + size.astype(np.uint64) * np.uint64(_STEP))
        return tail.view(np.int64), np.where(inside, self.rank[k], 0), self.digests.of(at, size).view(np.int64)

    def place(self, at, piece):
        return at - self.begin[piece] + self.off[piece]


def _packs(b, length: int, trigger: int, every: int, fine: int):
    """(pack, the row of each of its pieces); long stretches go in pieces of PIECE starts."""
    held, rows, size = [], [], 0
    for i in range(b.num_rows):
        v, body = b.column("v")[i].as_py(), b.column("body")[i].as_py()
        lo, hi, ranks = (b.column(c)[i].values.to_numpy() for c in ("lo", "hi", "ranks"))
        at = triggers(body, trigger, every) if len(body) > PIECE else None
        for p in range(0, max(len(body) - length + 1, 1), PIECE):
            e = min(p + PIECE + 2 * length, len(body))
            k = slice(bisect_left(hi, p), bisect_right(lo, p + PIECE - 1))
            if k.start >= k.stop:
                continue
            own = ranks if at is None else ranks[np.searchsorted(at, p):np.searchsorted(at, e - trigger, "right")]
            held.append((v, p, body[p:e], np.maximum(lo[k], p) - p, np.minimum(hi[k], p + PIECE - 1) - p, own))
            rows.append(i)
            size += e - p
            if size >= PIECE:
                yield Pack(held, length, trigger, every, fine), np.array(rows)
                held, rows, size = [], [], 0
    if held:
        yield Pack(held, length, trigger, every, fine), np.array(rows)


def _shares(length: int, fine: int) -> list[int]:
    """How far before a fine trigger strings may start that are judged by one core behind it, ascending."""
    return [x for x in (fine, 2 * fine, 4 * fine) if x <= length // 2]


_KEYS = "tail long, rank long, digest long, u long, at long, last long"
_NAMES = ["tail", "rank", "digest", "u", "at", "last"]


def _sliced(*columns):
    for i in range(0, len(columns[0]), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 65_536]) for c in columns], names=_NAMES)


def _stretch_keys(ranked: DataFrame, length: int, trigger: int, every: int, fine: int) -> DataFrame:
    """Rows to sort for ranges of starts with the same next fine trigger: one with the bytes of all their strings (at, last), and for each class of distances
    to that trigger one with the core behind it that strings of the class hold (at is the trigger, last is -2 less four times the range's first start less the class)."""
    shares = _shares(length, fine)

    def run(batches):
        for b in batches:
            for pack, _ in _packs(b, length, trigger, every, fine):
                q, piece = pack.q, pack.piece
                to = pack.behind(q, piece)
                new = np.concatenate([[True], (to[1:] != to[:-1]) | (q[1:] != q[:-1] + 1) | (piece[1:] != piece[:-1])])
                end = np.append(np.nonzero(new)[0][1:], len(q)) - 1
                a, z, w = q[new], q[end], piece[new]
                ok = z - a < length
                yield from _sliced(*pack.keyed(a[ok], (z - a)[ok] + length), pack.v[w[ok]], pack.place(a[ok], w[ok]), pack.place(z[ok], w[ok]))
                t, least = to[new], -1
                for kind, share in enumerate(shares):
                    # ranges with a start whose distance is above the smaller share and at most this one
                    has = np.maximum(t - z, least + 1) <= np.minimum(t - a, share)
                    at, w_ = t[has], w[has]
                    yield from _sliced(*pack.keyed(at, np.full(len(at), length - share)), pack.v[w_], pack.place(at, w_), -2 - 4 * pack.place(a[has], w_) - kind)
                    least = share

    return ranked.mapInArrow(run, _KEYS)


def _single_keys(left: DataFrame, length: int, trigger: int, every: int, fine: int) -> DataFrame:
    """Rows to sort for single starts: those outside the settled ranges whose core, if they have one, is in ``cores`` (trigger * 4 + class)."""
    shares = np.array(_shares(length, fine))

    def run(batches):
        for b in batches:
            settled = [(c[i].values.to_numpy() if c[i].is_valid else np.zeros(0, np.int64)) for c in (b.column("from"), b.column("to"), b.column("cores")) for i in range(b.num_rows)]
            n = b.num_rows
            for pack, rows in _packs(b, length, trigger, every, fine):
                # places of all rows on one line
                wide = np.int64(4) * np.int64(max((int(x[-1]) for x in settled if len(x)), default=0) + int(pack.off.max()) + len(pack.data) + 1)
                shift = np.unique(rows)
                line = lambda k: np.concatenate([settled[k * n + r] + j * wide for j, r in enumerate(shift)])      # noqa: E731
                base = np.searchsorted(shift, rows) * wide
                lo, hi, cores = line(0), line(1), line(2)
                q, piece = pack.q, pack.piece
                own = pack.place(q, piece) + base[piece]
                k = np.searchsorted(lo, own, "right")
                done = (k > 0) & (np.append(hi, -1)[k - 1] >= own)
                to = pack.behind(q, piece)
                kind = np.searchsorted(shares, to - q)                        # the class of the distance
                core = 4 * (pack.place(q, piece) + to - q) + kind + base[piece]
                at = np.searchsorted(cores, core)
                go = ~done & ((kind == len(shares)) | (np.append(cores, -1)[at] == core))
                q, piece = q[go], piece[go]
                at = pack.place(q, piece)
                yield from _sliced(*pack.keyed(q, np.full(len(q), length)), pack.v[piece], at, at)

    return left.mapInArrow(run, _KEYS)


def adjacent(rows: DataFrame, purpose: str) -> DataFrame:
    """(u, at, last, first, key) of the rows whose neighbour in the order of (tail, rank) has the same digest; first: none like it before it;
    key: for cores one hash of tail and digest, else 0.

    Equal rows stand together, and the place is the last key, so that many equal ones are dealt over partitions.  Rows at
    the ends of a partition are compared with those of the next one afterwards."""
    order = ["tail", "rank", "digest", "u", "at"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["u", "at", "last", "first", "kind", "key", "tail", "rank", "digest"]

    def run(batches):
        held, begun = None, False

        def out(x, same_before, same_after, kind):
            keep = same_before | same_after | (kind > 0)
            x = [c[keep] for c in x]
            lone = ~(same_before | same_after)[keep]
            k = np.where(lone, kind[keep] | 4, kind[keep])         # 1: first of a partition, 2: last, 4: not yet repeated
            key = _mix(x[0].view(np.uint64) * np.uint64(3) + _mix(x[2].view(np.uint64))).view(np.int64)
            # what rows are sorted by is of use at the ends of tasks only, the key for cores
            use = [np.where(x[5] < 0, key, 0), *(np.where(k > 0, c, 0) for c in (x[0], x[1], x[2]))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[3], x[4], x[5], ~same_before[keep], k, *use)], names=names)

        def flags(x):
            same = (x[0][1:] == x[0][:-1]) & (x[2][1:] == x[2][:-1])
            return same

        prev = None                          # the last row of the batch before and whether it equals the one before it
        for b in batches:
            if not b.num_rows:
                continue
            x = [b.column(c).to_numpy(zero_copy_only=False) for c in ("tail", "rank", "digest", "u", "at", "last")]
            if prev is not None:
                x = [np.concatenate([p, c]) for p, c in zip(prev[0], x)]
            same = flags(x)
            before = np.concatenate([[prev[1] if prev is not None else False], same])
            after = np.append(same, False)
            kind = np.zeros(len(before), dtype=np.int64)
            if prev is None:
                kind[0] = 1
            else:
                kind[0] = prev[2]
            if len(before) > 1:
                yield out([c[:-1] for c in x], before[:-1], after[:-1], kind[:-1])
            prev = ([c[-1:] for c in x], bool(before[-1]), int(kind[-1]))
        if prev is not None:
            yield out(prev[0], np.array([prev[1]]), np.array([False]), np.array([prev[2] | 2]))

    found = cut(sorted_.mapInArrow(run, "u long, at long, last long, first boolean, kind long, key long, tail long, rank long, digest long"), purpose)
    ends = found.filter("kind > 0")          # two rows for each partition at most
    w = Window.orderBy(*order)
    like = lambda c: (F.col(f"{c}.tail") == F.col("tail")) & (F.col(f"{c}.digest") == F.col("digest"))      # noqa: E731
    row = F.struct("tail", "digest")
    met = ends.withColumns({"p": F.lag(row).over(w), "n": F.lead(row).over(w)}).filter("kind >= 4")
    met = met.filter(F.coalesce(like("p"), F.lit(False)) | F.coalesce(like("n"), F.lit(False)))
    out = ["u", "at", "last", "first", "key"]
    return found.filter("kind < 4").select(*out).unionByName(cut(met.select(*out), f"{purpose}-ends"))


def _joined_runs(rows: DataFrame) -> DataFrame:
    """(u, at, last): ranges of starts merged where they meet."""
    def run(batches):
        u = a = z = None
        for b in batches:
            if not b.num_rows:
                continue
            x = [b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "at", "more")]
            x[2] = x[1] + x[2]
            if u is not None:
                x = [np.concatenate([[p], c]) for p, c in zip((u, a, z), x)]
            new = np.concatenate([[True], (x[0][1:] != x[0][:-1])])
            # a running maximum inside each text: texts are kept apart by their number in the batch
            group = np.cumsum(new) - 1
            wide = np.int64(x[2].max() + 2)
            reach = np.maximum.accumulate(x[2] + group * wide) - group * wide
            new[1:] |= x[1][1:] > reach[:-1] + 1
            at = np.nonzero(new)[0]
            end = reach[np.append(at[1:], len(new)) - 1]
            if len(at) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x[0][at[:-1]]), pa.array(x[1][at[:-1]]), pa.array(end[:-1])], names=["u", "at", "last"])
            u, a, z = int(x[0][at[-1]]), int(x[1][at[-1]]), int(end[-1])
        if u is not None:
            yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([a]), pa.array([z])], names=["u", "at", "last"])

    # most are single starts, and zeros pack better than a place told twice
    return rows.select("u", "at", (F.col("last") - F.col("at")).alias("more")).repartition("u").sortWithinPartitions("u", "at").mapInArrow(run, "u long, at long, last long")


def _ranges(rows: DataFrame) -> DataFrame:
    merged = F.array_sort(F.collect_list(F.struct("at", "last")))
    return rows.groupBy("u").agg(merged.alias("_r")).select("u", F.col("_r.at").alias("from"), F.col("_r.last").alias("to"))


def _hashes(column: str = "text", names=("k1", "k2")) -> dict:
    """Two hashes that stand for the bytes of a column."""
    body = F.col(column).cast("binary")
    return {names[0]: F.xxhash64(body), names[1]: F.xxhash64(F.lit(1), body)}


def repeats(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, trigger: int = TRIGGER, every: int = EVERY, fine: int = FINE, most_keys: int = MOST_KEYS) -> DataFrame:
    """(k1, k2, text, from, to): for each different text with repeated strings, the ranges of their starts."""
    assert every % fine == 0 and trigger < length // 2 and anchor < length
    texts = docs.filter(F.octet_length("text") >= length).select(_hashes()["k1"].alias("k1"), F.col("text").cast("binary").alias("text"))
    marks = cut(_anchor_rows(texts, length, anchor), "anchors")
    # a text that shares its first hash with another one only gets more candidates than it has
    wanted = cut(_shared(marks).groupBy("k1").agg(F.array_sort(F.collect_set("place")).alias("places")), "wanted")
    if wanted.count() <= most_keys:
        texts = texts.join(F.broadcast(wanted.select("k1")), "k1", "left_semi")
    # copies go where they are read; by the first hash alone texts lie as the join needs them and move once
    once = texts.groupBy("k1").agg(F.collect_set("text").alias("_t"))
    found = once.join(wanted.hint("merge"), "k1").select("k1", F.explode("_t").alias("text"), "places").withColumn("k2", _hashes()["k2"])
    found = cut(found.withColumn("u", F.monotonically_increasing_id()), "candidates")
    parts = cut(_stretches(found, length, anchor).withColumn("v", F.monotonically_increasing_id()), "parts")

    phrases = cut(_phrases(parts, length, trigger, every), "phrases")
    names = running(phrases.groupBy("phrase").agg(F.count("*").alias("c")), ["phrase"], ["c"], "sorted-phrases")
    p = ("p1", "p2")            # names go back to their phrases by two hashes, so that the bytes of phrases move for the sort only
    hashes = _hashes("phrase", p)
    ranks = suffix_ranks(phrases.withColumns(hashes).drop("phrase").join(names.withColumns(hashes).select(*p, "c"), [*p]).select("u", "t", "c", "n"), length)
    listed = ranks.groupBy(F.col("u").alias("v")).agg(F.array_sort(F.collect_list(F.struct("t", "rank"))).alias("_l")).select("v", F.col("_l.rank").alias("ranks"))
    none = F.array().cast("array<long>")
    ranked = cut(parts.select("v", "body", "lo", "hi").join(listed, "v", "left").withColumn("ranks", F.coalesce("ranks", none)), "ranked-parts")

    met = adjacent(_stretch_keys(ranked, length, trigger, every, fine), "stretches")
    whole = met.filter("last >= 0")
    settled = _ranges(_joined_runs(whole.filter("not first").select("u", "at", "last"))).withColumnRenamed("u", "v")
    # cores that a stretch has which is not repeated whole: its starts, and those of the stretches that share its core, go on
    # (a chance match of keys lets a core go on that need not)
    cores = met.filter("last < 0").select("u", "key", F.col("at").alias("trigger"), F.floor((-2 - F.col("last")) / 4).alias("at"), F.pmod(-2 - F.col("last"), F.lit(4)).alias("kind"))
    known = whole.select("u", "at").withColumn("whole", F.lit(True))
    cores = cut(cores.join(known, ["u", "at"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))), "cores")
    # written, so that both sides of the join are plain exchanges and adaptive execution can split a key with very many cores
    unsettled = cut(cores.filter("not whole").select("key").distinct(), "unsettled")
    cores = cores.join(unsettled.hint("merge"), "key", "left_semi")
    cores = cores.groupBy(F.col("u").alias("v")).agg(F.array_sort(F.collect_set(F.col("trigger") * 4 + F.col("kind"))).alias("cores"))
    left = ranked.join(settled, "v", "left").join(cores, "v", "left")
    single = adjacent(_single_keys(left, length, trigger, every, fine), "singles")
    runs = _joined_runs(whole.select("u", "at", "last").unionByName(single.select("u", "at", "last"))).withColumnRenamed("u", "v")
    runs = runs.join(parts.select("v", "u", "start"), "v").select("u", (F.col("at") + F.col("start")).alias("at"), (F.col("last") + F.col("start")).alias("last"))
    return found.select("u", "k1", "k2", "text").join(_ranges(runs), "u")


def dedup(docs: DataFrame, *, length: int = LENGTH, keep_text: bool = True, **options) -> DataFrame:
    """docs(doc_id, text, ...) with n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (the bytes left, binary); without
    keep_text the column text goes.  Columns of docs that have one of these names are replaced, all others stay."""
    k1, k2, sha, kept = free_names(docs, "_k1", "_k2", "_sha", "_kept")
    found = repeats(docs.select("text"), length=length, **options)

    def run(batches):
        for b in batches:
            cols = {n: [] for n in ("n", "s", "d", "t")}
            for i in range(b.num_rows):
                text = b.column("text")[i].as_py()
                a, z = _merged(b.column("from")[i].values.to_numpy(), b.column("to")[i].values.to_numpy(), length)
                keep = b"".join(text[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(text)]))
                cols["n"].append(int((z - a).sum()))
                cols["s"].append(len(a))
                cols["d"].append(hashlib.sha256(keep).hexdigest())
                cols["t"].append(keep if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(cols["n"], pa.int64()), pa.array(cols["s"], pa.int64()), pa.array(cols["d"], pa.string()), pa.array(cols["t"], pa.binary())],
                                             names=["k1", "k2", "_n", "_s", "_d", kept])

    cuts = found.select("k1", "k2", "text", "from", "to").mapInArrow(run, f"k1 long, k2 long, _n long, _s long, _d string, `{kept}` binary")
    text = F.col("text").cast("binary")
    body = F.coalesce(text, F.lit(b""))
    rows = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(1), text), "n_bytes": F.length(body).cast("long"), sha: F.sha2(body, 256)})
    many = rows.filter(F.col("n_bytes") >= length).groupBy(k1, k2).agg(F.count("*").alias("_c")).filter("_c > 1").select(F.struct(F.col(k1).alias("k1"), F.col(k2).alias("k2")).alias("_k"), F.lit(True).alias("_gone"))
    marks = cut(cuts, "cuts").select(F.struct("k1", "k2").alias("_k"), "_n", "_s", "_d", kept).join(many, "_k", "full")
    mark, = free_names(rows, "_mark")
    marks = marks.select(F.col("_k.k1").alias("_k1"), F.col("_k.k2").alias("_k2"), F.struct(F.coalesce("_gone", F.lit(False)).alias("gone"), "_n", "_s", "_d", F.col(kept).alias("kept")).alias(mark))
    left, right = rows.alias("l") if keep_text else rows.drop("text").alias("l"), marks.alias("r")
    out = left.join(right, (F.col(f"l.{k1}") == F.col("r._k1")) & (F.col(f"l.{k2}") == F.col("r._k2")), "left").select("l.*", f"r.{mark}")
    gone, m = F.coalesce(F.col(f"{mark}.gone"), F.lit(False)), lambda c: F.col(f"{mark}.{c}")      # noqa: E731
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    out = out.withColumns({
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(m("_n"), zero)),
        "n_spans": F.when(gone, one).otherwise(F.coalesce(m("_s"), zero)),
        "kept_sha256": F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce(m("_d"), F.col(sha))),
        **({"kept": F.when(gone, F.lit(b"")).otherwise(F.coalesce(m("kept"), F.col("text").cast("binary"), F.lit(b"")))} if keep_text else {})})
    return out.drop(k1, k2, sha, mark)
