"""One document of each group of near copies: SimHash and least hashes first, then every other pair of the exact similarity.

A text's shingles are the XXH64 values of its runs of SHINGLE words, as a set (ASCII case aside; a shorter text is one
shingle).  Texts whose sets have a Jaccard similarity of at least SHARE are linked, and linked texts form groups.

A fingerprint of 64 bits cannot find them all: at a similarity of 0.8 two SimHashes differ in 10 bits on average and in 15
at times, which no banding covers without comparing about everything.  So the work goes in three rounds, and no link is lost:

1. Fingerprints within simhash.RADIUS bits (bit-sliced comparison), equal ones, and neighbours in the order of each of MINS least
   hashes of the sets (one is shared with the probability of the similarity itself) are verified on their whole sets.  A group of
   thousands of edited copies collapses here, with at most MINS + 2 pairs a text.
2. Pairs of texts in different groups: under one order of all shingles, two similar sets of a and b shingles share one among the first
   a - ceil(0.8 a) + 1 and b - ceil(0.8 b) + 1.  The order has frequent shingles last (by a table of 2 ** COUNTERS counts), so that common
   passages are seldom in a prefix.  Shingles of one group only are left out; a bucket is cut into blocks that meet pairwise;
   a pair is handed on if sizes, places and a SKETCH of the sets leave the similarity possible: the parities of the
   sets' counts in SKETCH cells differ in no more cells than the sets differ in shingles.  Of these pairs tasks hand on spanning forests of
   the groups, so that a large group of copies collapses by fewer pairs than it has rows.  Then pairs are verified.
3. The same once more with the groups that are left, and with all their pairs.

Null, empty and blank texts are copies of each other.  Repeated rows count as copies.  An empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut
from .common import free_names
from .graph import components
from .simhash import SEED, _hashes, least_reached, links

SHINGLE = 5
SHARE = (4, 5)           # least similarity, as a fraction
COUNTERS = 18
MINS = 4
SKETCH = 512
BLOCK = 1024
EARLY = 16               # first shared shingles of a prefix that travel with its rows
ROWS = 65_536            # rows of buckets a task holds at one time, at least
MOST_KEYS = 2_000_000    # texts that are broadcast as two hashes each; beyond that the same join shuffles

_SALT = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % 2 ** 64) for k in range(MINS)]


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    out = np.zeros(0, dtype=np.uint64)
    for h in _hashes(text or b"", shingle):
        out = np.union1d(out, h)
    return out


def prefix_length(n: int, share: tuple[int, int] = SHARE) -> int:
    return n - -(-share[0] * n // share[1]) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * share[1] >= (len(a) + len(b) - both) * share[0]


def signature(h: np.ndarray) -> tuple[int, list[int], bytes]:
    """(fingerprint, least hashes, sketch) of a set of shingles; zeros without shingles."""
    ones, mins = np.zeros(64, dtype=np.int64), np.full(MINS, 2 ** 64 - 1 if len(h) else 0, dtype=np.uint64)
    cells = np.zeros(SKETCH, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at:at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for k, salt in enumerate(_SALT):
            x = (part ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            mins[k] = min(mins[k], ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)).min())
        cells += np.bincount((part >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH)
    fp = np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]
    return int(fp), mins.view(np.int64).tolist(), np.packbits((cells & 1).astype(np.uint8)).tobytes()


def _counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many rows' shingles fall to each counter."""
    shift = np.uint64(64 - COUNTERS)

    def run(batches):
        total = np.zeros(2 ** COUNTERS, dtype=np.int64)
        for b in batches:
            for t in b.column("_text"):
                np.add.at(total, (shingles(t.as_py(), shingle) >> shift).astype(np.int64), 1)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["place", "n"])

    got = texts.select("_text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 ** COUNTERS, dtype=np.int64)
    out[got.column("place").to_numpy()] = got.column("n").to_numpy()
    return out


def prefixes(docs: DataFrame, keys: tuple[str, ...], *, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """The key columns of docs, s1 and s2 (name the set of shingles), n (its size), fp, mins, sketch and prefix (shingles in the common order)."""
    d = docs.select(*keys, F.col("text").cast("binary").alias("_text"))
    counts, shift = _counts(d, shingle), np.uint64(64 - COUNTERS)

    def run(batches):
        for b in batches:
            out, first = [[] for _ in range(6)], []
            for t in b.column("_text"):
                h = shingles(t.as_py(), shingle)
                order = np.lexsort((h, counts[(h >> shift).astype(np.int64)]))
                raw = h.tobytes()
                both = np.array([xxhash.xxh64_intdigest(raw, s) for s in (SEED, SEED + 1)], dtype=np.uint64).view(np.int64).tolist()
                for o, v in zip(out, (*both, len(h), *signature(h))):
                    o.append(v)
                first.append(h[order[:prefix_length(len(h), share)]].view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*first, np.zeros(0, np.int64)])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(o, k) for o, k in zip(out, kinds)), lists],
                                             names=[*keys, "s1", "s2", "n", "fp", "mins", "sketch", "prefix"])

    long, many = T.LongType(), T.ArrayType(T.LongType())
    more = [T.StructField(n, t) for n, t in zip(("s1", "s2", "n", "fp", "mins", "sketch", "prefix"), (long, long, long, long, many, T.BinaryType(), many))]
    return d.mapInArrow(run, T.StructType([*d.schema.fields[:-1], *more]))


def _possible(n, m, first, second, share) -> np.ndarray:
    """Where sizes n, m and sketches of two sets leave the similarity possible."""
    p, q = share
    low = np.minimum(n, m) * q >= np.maximum(n, m) * p
    apart = np.bitwise_count(first ^ second).sum(axis=1, dtype=np.int64)
    # sets that differ in d shingles have a similarity of (n + m - d) / (n + m + d)
    return low & ((n + m - apart) * q >= (n + m + apart) * p)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), SKETCH // 64)


def neighbours(sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """(u, v): sets(id, n, mins, sketch) next to each other in the order of one of their least hashes, where they may be similar.

    The order goes over all tasks with the id as its last key, so that thousands of sets with one least hash are dealt over tasks; a pair cut by
    the end of a task is left to the later rounds."""
    rows = sets.select("id", "n", "sketch", "mins", F.posexplode("mins").alias("k", "m"))
    rows = rows.select("k", "m", F.get("mins", (F.col("k") + 1) % MINS).alias("o"), "id", "n", "sketch")
    order = ("k", "m", "o", "id")

    def run(batches):
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k, m, i, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "m", "id", "n"))
            s = _sketches(b.column("sketch"))
            if last is not None:
                k, m, i, n, s = (np.concatenate([x, y]) for x, y in zip(last, (k, m, i, n, s)))
            good = (k[1:] == k[:-1]) & (m[1:] == m[:-1]) & _possible(n[1:], n[:-1], s[1:], s[:-1], share)
            yield pa.RecordBatch.from_arrays([pa.array(i[:-1][good]), pa.array(i[1:][good])], names=["u", "v"])
            last = [x[-1:] for x in (k, m, i, n, s)]

    return rows.filter("n > 0").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "u long, v long")


def fingerprint_links(sets: DataFrame) -> DataFrame:
    """(u, v): a chain through sets(id, fp) of equal fingerprints, and links between fingerprints within the radius."""
    least = cut(sets.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    same = sets.join(least.hint("merge"), "fp").select(F.col("least").alias("u"), F.col("id").alias("v"))
    near = links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(f), F.col("least").alias(n)) for f, n in (("u", "a"), ("v", "b")))
    return same.unionByName(near.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))).filter("u <> v")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """The rows(token, root, id, place) whose token others have too, and those at the ends of tasks, where that is not known."""
    order = ("token", "id")

    def run(batches):
        held, met = None, True                      # the last row so far, and whether it is known to stay
        for b in batches:
            if not b.num_rows:
                continue
            x = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            t = x.column("token").to_numpy()
            same = t[1:] == t[:-1]
            keep = np.concatenate([[met], same]) | np.append(same, False)
            yield from x.filter(pa.array(np.append(keep[:-1], False))).to_batches()
            held, met = x.slice(len(t) - 1).to_batches()[0], bool(keep[-1])
        if held is not None:
            yield held

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, rows.schema)


def best_links(weight: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of a spanning forest of the links (u, v), u <> v, of least weight (ties by u, v and place), by Boruvka's rounds."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.lexsort((v, u, weight))
    i, j = at[:len(u)][order], at[len(u):][order]
    label, live, chosen = np.arange(len(nodes)), np.arange(len(order)), np.zeros(0, dtype=np.int64)
    while len(live):
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, label[i[live]], live)
        np.minimum.at(best, label[j[live]], live)
        chosen = np.union1d(chosen, best[best < len(order)])
        label = least_reached(len(nodes), i[chosen], j[chosen])
        live = live[label[i[live]] != label[j[live]]]
    return order[chosen]


def candidates(rows: DataFrame, sets: DataFrame, *, forest: bool, share: tuple[int, int] = SHARE, block: int = BLOCK) -> DataFrame:
    """(u, v): pairs of sets(id, root, n, sketch) of different roots that share a shingle of their prefixes, rows(token, root, id, place), and may be similar.

    With ``forest`` a task gives back, of the pairs of each ROWS rows, a spanning forest of the roots by those that look most similar: fewer links than
    rows, whatever the size of a group.  Else all pairs, each one where its first common shingle is, if that is among the first EARLY of both."""
    p, q = share
    full = rows.groupBy(F.col("token").alias("_t")).agg(F.min("root").alias("_a"), F.max("root").alias("_z"), F.count("*").alias("_m")).filter("_a <> _z")
    rows = rows.join(full.hint("merge"), F.col("token") == F.col("_t")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "token", "_m"))).alias("_l"))
    rows = rows.join(sets.select(F.col("id").alias("_i"), "root", "n", "sketch").hint("merge"), F.col("id") == F.col("_i"))
    few = F.slice(F.concat(F.col("_l.token"), F.array_repeat(F.lit(0).cast("long"), EARLY)), 1, EARLY)
    rows = rows.select("id", "root", "n", "sketch", *([] if forest else [few.alias("early")]), F.posexplode("_l").alias("nth", "_p"))
    rows = rows.select("*", "_p.*").drop("_p")
    parts = F.ceil(F.col("_m") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    cells = F.when(parts == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != own), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"))))
    more = ["sketch"] if forest else ["sketch", "nth", "early"]
    rows = rows.select("token", "n", "id", "root", "place", own.alias("own"), parts.alias("parts"), *more, F.explode(cells).alias("_c"))
    rows = rows.select("token", "_c.i", "_c.j", "n", "id", "root", "place", "own", "parts", *more)
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "id")

    def pairs(x):
        """Places a, b in the rows x of the pairs, and in how many cells their sketches differ, one distance in the order at a time."""
        token, i, j, n, ids, root, place, own, parts, sketch = x[:10]
        cell = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        at, lag = np.arange(1, len(token)), 1
        while len(at):
            # sizes ascend in a cell: a row whose neighbour at this lag is too small has no larger one further off
            at = at[at >= lag]
            before = at - lag
            go = (cell[before] == cell[at]) & (n[before] * q >= n[at] * p)
            at, before = at[go], before[go]
            left = np.minimum(n[before] - place[before], n[at] - place[at])        # shingles in common, at most
            good = (root[before] != root[at]) & (left * (p + q) >= (n[before] + n[at]) * p)
            # rows of one part meet in its cell with the next part only
            after = (own[at] + 1) % np.maximum(parts[at], 1)
            good &= (own[before] != own[at]) | (parts[at] == 1) | ((i[at] == np.minimum(own[at], after)) & (j[at] == np.maximum(own[at], after)))
            a, b = before[good], at[good]
            ok = _possible(n[a], n[b], sketch[a], sketch[b], share)
            if ok.any():
                yield a[ok], b[ok]
            lag += 1

    def links_of(x):
        n, ids, root, sketch = x[3], x[4], x[5], x[9]
        held = [np.zeros(0, dtype=np.int64)] * 2
        for a, b in pairs(x):
            if forest:
                held = [np.concatenate(y) for y in zip(held, (a, b))]
                if len(held[0]) >= 2 * len(ids):
                    held = least(held, n, root, sketch)
                continue
            # a pair stands at its first common shingle, as far as the first ones of both are at hand
            for c in range(0, len(a), 4096):
                k, m = a[c:c + 4096], b[c:c + 4096]
                nth, early, place = x[10], x[11], np.arange(EARLY)
                known = (place < nth[k][:, None])[:, :, None] & (place < nth[m][:, None])[:, None, :]
                new = ~((early[k][:, :, None] == early[m][:, None, :]) & known).any(axis=(1, 2))
                yield ids[k[new]], ids[m[new]]
        if len(held[0]):
            a, b = least(held, n, root, sketch)
            yield ids[a], ids[b]

    def least(held, n, root, sketch):
        a, b = held
        weight = np.zeros(len(a))
        for c in range(0, len(a), ROWS):
            k, m = a[c:c + ROWS], b[c:c + ROWS]
            weight[c:c + ROWS] = np.bitwise_count(sketch[k] ^ sketch[m]).sum(axis=1, dtype=np.int64) / (n[k] + n[m])
        chosen = best_links(weight, np.minimum(root[a], root[b]), np.maximum(root[a], root[b]))
        return [a[chosen], b[chosen]]

    def given(x):
        for a, b in links_of(x):
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

    def run(batches):
        names, held, size = ("token", "i", "j", "n", "id", "root", "place", "own", "parts"), [], 0
        for b in batches:
            if not b.num_rows:
                continue
            more = [] if forest else [b.column("nth").to_numpy(zero_copy_only=False).astype(np.int64), b.column("early").flatten().to_numpy(zero_copy_only=False).reshape(-1, EARLY)]
            held.append([*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names), _sketches(b.column("sketch")), *more])
            size += b.num_rows
            if size >= ROWS:
                x = [np.concatenate(c) for c in zip(*held)]
                # the last cell, of at most about two blocks, may go on
                other = np.nonzero((x[0] != x[0][-1]) | (x[1] != x[1][-1]) | (x[2] != x[2][-1]))[0]
                end = int(other[-1]) + 1 if len(other) else 0
                yield from given([c[:end] for c in x])
                held, size = [[c[end:] for c in x]], len(x[0]) - end
        if held:
            yield from given([np.concatenate(c) for c in zip(*held)])

    return rows.mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, *, shingle: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs (u, v) whose texts(id, text) are similar.  The joins merge: pairs are never broadcast."""
    a = texts.select(F.col("id").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("id").alias("v"), F.col("text").alias("b"))

    def run(batches):
        for x in batches:
            good, last, mine = [], None, None
            for u, s, t in zip(x.column("u").to_pylist(), x.column("a"), x.column("b")):
                if u != last:
                    last, mine = u, shingles(s.as_py(), shingle)
                good.append(similar(mine, shingles(t.as_py(), shingle), share))
            yield x.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.hint("merge").join(b, "v").join(a.hint("merge"), "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def among(rows: DataFrame, keys: DataFrame, columns: list[str], how: str, most: int = MOST_KEYS) -> DataFrame:
    """Semi- or anti-join of wide rows with few keys: broadcast up to ``most`` of them, else by merging."""
    few = keys.count() <= most
    return rows.join(F.broadcast(keys) if few else keys.hint("merge"), [F.col(f"{c}").eqNullSafe(keys[f"_{c}"]) for c in columns], how)


def one_of_each(docs: DataFrame, *, shingle: int = SHINGLE, share: tuple[int, int] = SHARE, most_keys: int = MOST_KEYS) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id, nulls first, then of the least text hash; all columns as they are."""
    k1, k2 = free_names(docs, "k1", "k2")
    body = F.col("text").cast("binary")
    keyed = docs.withColumns({k1: F.xxhash64(body), k2: F.xxhash64(F.lit(1), body)})
    found = cut(prefixes(keyed, ("doc_id", k1, k2), shingle=shingle, share=share), "shingled")
    rest = ("n", "fp", "mins", "sketch", "prefix")
    first = F.struct("doc_id", k1, k2)
    once = found.groupBy("s1", "s2").agg(F.min(first).alias("_k"), F.first(F.struct(*rest)).alias("_r"))
    once = cut(once.select("s1", "s2", "_k", *[f"_r.{c}" for c in rest]).withColumn("id", F.monotonically_increasing_id()), "sets")

    def handed(near, name):
        return cut(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-pairs")

    def links_of(near, name):
        ids = near.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        wanted = cut(once.join(ids.hint("merge"), "id").select("id", F.col(f"_k.{k1}").alias(f"_{k1}"), F.col(f"_k.{k2}").alias(f"_{k2}")), f"{name}-wanted")
        rows = among(keyed.select(k1, k2, body.alias("text")), wanted, [k1, k2], "left_semi", most_keys)
        texts = rows.groupBy(k1, k2).agg(F.first("text").alias("text")).join(wanted.hint("merge"), (F.col(k1) == F.col(f"_{k1}")) & (F.col(k2) == F.col(f"_{k2}")))
        return cut(verified(near, texts.select("id", "text"), shingle=shingle, share=share), f"{name}-links")

    def rooted(edges):
        label = components(edges).withColumnRenamed("node", "id")
        return once.join(label, "id", "left").withColumn("root", F.coalesce("root", "id"))

    edges = links_of(handed(neighbours(once, share).unionByName(fingerprint_links(once.filter("n > 0"))), "first"), "first")
    sets = cut(rooted(edges).select("id", "root", "n", "sketch", "prefix"), "rooted")
    rows = sets.select("root", "id", F.posexplode("prefix").alias("place", "token")).select("token", "root", "id", "place")
    rows = cut(shared_tokens(rows), "shared")
    near = handed(candidates(rows, sets, forest=True, share=share), "second")
    if not near.isEmpty():          # without a forest there are no pairs either
        edges = edges.unionByName(links_of(near, "second"))
        sets = cut(rooted(edges).select("id", "root", "n", "sketch"), "rooted")
        rows = rows.drop("root").join(sets.select("id", "root").hint("merge"), "id")
        edges = edges.unionByName(links_of(handed(candidates(rows, sets, forest=False, share=share), "third"), "third"))
    group = cut(rooted(edges).select("s1", "s2", "root", "_k"), "groups")
    best = group.groupBy(F.col("root").alias("_root")).agg(F.min("_k").alias("_b"))
    # the keys of all rows that go, and of rows that stay but are repeated
    rows = found.select("doc_id", k1, k2, "s1", "s2").join(group.select("s1", "s2", "root").join(best, F.col("root") == F.col("_root")).select("s1", "s2", "_b"), ["s1", "s2"])
    marks = rows.groupBy("doc_id", k1, k2).agg(F.count("*").alias("_n"), F.first("_b").alias("_b"))
    stays = F.col("_b.doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"_b.{k1}") == F.col(k1)) & (F.col(f"_b.{k2}") == F.col(k2))
    marks = cut(marks.withColumn("_stays", stays).filter("_n > 1 or not _stays"), "marks")
    names = [F.col(c).alias(f"_{c}") for c in ("doc_id", k1, k2)]
    kept = among(keyed, marks.select(*names), ["doc_id", k1, k2], "left_anti", most_keys)
    again = among(keyed, marks.filter("_stays").select(*names), ["doc_id", k1, k2], "left_semi", most_keys).dropDuplicates(["doc_id", k1, k2])
    return kept.unionByName(again).drop(k1, k2)
