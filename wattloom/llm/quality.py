"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating has ordered grades 0 .. top.  One weight vector over hashed text features is shared by all
grades, and ordered thresholds cut its score: P(grade >= k) = sigmoid(score - threshold k).  The model
gives the expected grade and, for selection, the tail probability of the grade asked for.

Features of a text, hashed to DIM places:
* presence of each word, of its first four and of its first five letters; lower case, without the signs at its ends;
* shares (the first SHARES places) of the words that end in each run of signs, are all capitals, or repeat an earlier word.

A presence takes part if it is in at least RARE rows of the sample and its frequency differs between
grades by over Z standard errors; its value is the size of the log ratio, so that a long text's many common words do
not drown a telling one.  The fit takes full gradients: the features of at most SAMPLE rated rows are written
once, each step sums the gradient in tasks, and the driver holds a few vectors of DIM numbers.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut

DIM = 2 ** 17
SHARES = 2 ** 12
SAMPLE = 30_000          # rated rows the fit may use, those of the least hash of the id
PARTS = 8
STEPS = 80
RATE = 0.1
PENALTY = 1e-3
RARE = 8
Z = 4.0
SHARE = 18.0             # value of a share of 1, beside presences of about 1
LETTERS = (4, 5)
LONG = 4_000_000         # characters
CACHE = 200_000          # words whose places a task remembers
ROWS = 1_000             # rows whose features a task holds at one time
KEEP = 0.3               # least P(grade >= 2) of a row that selection keeps


WORD, PREFIX = zlib.crc32(b"w"), {k: zlib.crc32(b"p%d" % k) for k in LETTERS}


def _presence(kind: int, s: bytes) -> int:
    return SHARES + zlib.crc32(s, kind) % (DIM - SHARES)


def _share(kind: bytes, s: bytes) -> int:
    return zlib.crc32(s, zlib.crc32(kind)) % SHARES


def _word_places(w: str, cache: dict, mask: bytes | None):
    """Places of a raw word's presences, the signs at its end, and whether it is all capitals; None if there is nothing of
    these.  With mask, only places that it marks.  Prefixes are kept in the cache under (letters, prefix)."""
    start, end = 0, len(w)
    if not w.isalnum():
        while end and not w[end - 1].isalnum():
            end -= 1
        while start < end and not w[start].isalnum():
            start += 1
    core = w[start:end].lower()
    places = [_presence(WORD, core.encode())] if core else []
    for k in LETTERS:
        if len(core) > k:
            prefix = (k, core[:k])
            p = cache.get(prefix)
            if p is None:
                p = cache[prefix] = _presence(PREFIX[k], core[:k].encode())
            places.append(p)
    if mask is not None:
        places = [p for p in places if mask[p]]
    capitals = core != "" and w.isupper()
    return (tuple(places), w[end:], capitals) if places or end < len(w) or capitals else None


def features(text: str | None, cache: dict, scale: np.ndarray | None = None, mask: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text; a null text has those of an empty one.  With scale and its mask (a byte for each place,
    1 where scale is above 0), only places of the mask, and their values times the scale.  cache belongs to one mask."""
    text = text or ""
    # the words of a very long text are not held as a list
    words = Counter(text.split() if len(text) < LONG else (m.group() for m in re.finditer(r"\S+", text)))
    total, present, signs, capitals, look = sum(words.values()), set(), Counter(), 0, cache.get
    for w, c in words.items():
        got = look(w, 0)
        if got is None:                     # nothing to count in this word
            continue
        if got == 0:
            if len(cache) >= CACHE:
                cache.clear()
            got = _word_places(w, cache, mask)
            if len(w) <= 200:               # longer words are read whole too, only not remembered
                cache[w] = got
            if got is None:
                continue
        places, sign, upper = got
        if places:
            present.update(places)
        if sign:
            signs[sign] += c
        if upper:
            capitals += c
    shares: dict[int, int] = {_share(b"x", b"capitals"): capitals, _share(b"x", b"repeats"): total - len(words)}
    for s, c in signs.items():
        p = _share(b"s", s.encode())
        shares[p] = shares.get(p, 0) + c
    at = np.concatenate([np.fromiter(present, dtype=np.int32, count=len(present)), np.fromiter(shares, dtype=np.int32, count=len(shares))])
    value = np.concatenate([np.ones(len(present)), np.fromiter(shares.values(), dtype=np.float64, count=len(shares)) * SHARE / max(total, 1)])
    if scale is not None:
        value = value * scale[at]
    return at, value


@dataclass
class Ordinal:
    """Weights of the places and ascending thresholds of grades 1 .. top; scale holds the places' values."""
    weights: np.ndarray
    thresholds: np.ndarray
    scale: np.ndarray


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def gradient(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the negative log likelihood: by score (one for each row) and by threshold, and its sum."""
    n, top, rows = len(score), len(thresholds), np.arange(len(score))
    tail = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - thresholds), np.zeros((n, 1))], axis=1)
    slope = tail * (1 - tail)
    p = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-12)
    up, down = slope[rows, grade] / p, slope[rows, grade + 1] / p
    by_threshold = np.zeros(top + 2)
    np.add.at(by_threshold, grade, up)
    np.add.at(by_threshold, grade + 1, -down)
    return down - up, by_threshold[1:top + 1], float(-np.log(p).sum())


def scales(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Values of the places from counts (grade, place) of the rows that have them: the largest log ratio of
    frequencies over the cuts between grades that is beyond Z standard errors, over 3; 0 if none; shares 1."""
    out = np.zeros(counts.shape[1])
    groups = [(slice(k, None), slice(0, k)) for k in range(1, len(rows))] + [(slice(k, k + 1), slice(k - 1, k)) for k in range(1, len(rows))]
    for upper, lower in groups:
        a, b, na, nb = counts[upper].sum(axis=0), counts[lower].sum(axis=0), rows[upper].sum(), rows[lower].sum()
        pa_, pb, p = (a + 1) / (na + 2), (b + 1) / (nb + 2), (a + b + 1) / (na + nb + 2)
        error = np.sqrt(p * (1 - p) * (1 / max(na, 1) + 1 / max(nb, 1)))
        out = np.maximum(out, np.where(np.abs(pa_ - pb) > Z * error, np.abs(np.log(pa_ / pb)), 0.0))
    out = np.where(counts.sum(axis=0) >= RARE, out / 3, 0.0)
    out[:SHARES] = 1.0
    return out


def fit(docs: DataFrame, ratings: DataFrame, top: int, *, sample: int = SAMPLE, steps: int = STEPS) -> Ordinal:
    """A model from the texts of docs(doc_id, text) and ratings(doc_id, grade), one grade 0 .. top an id.

    Ratings with a null or another grade are left out.  Uses at most ``sample`` ratings (a documented
    bound).  Without rows all weights are 0.
    """
    spark = docs.sparkSession
    chosen = ratings.filter(F.col("grade").between(0, top) & F.col("doc_id").isNotNull()).select("doc_id", F.col("grade").cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")       # at most ``sample`` ids

    def encode(batches):
        cache: dict = {}
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            both = [features(t.as_py(), cache) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([x[0] for x in both], pa.list_(pa.int32())), pa.array([x[1] for x in both], pa.list_(pa.float64()))],
                                             names=["grade", "at", "value"])

    coded = cut(rows.mapInArrow(encode, "grade int, at array<int>, value array<double>"), "rated")

    def count(batches):
        out = np.zeros((top + 1, DIM + 1))
        for b in batches:
            at, grade = b.column("at"), b.column("grade").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(grade)), at.value_lengths().to_numpy())
            np.add.at(out, (grade[row], at.flatten().to_numpy()), 1)
            np.add.at(out, (grade, DIM), 1)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["c"])

    counts = np.zeros((top + 1, DIM + 1))
    for r in coded.coalesce(PARTS).mapInArrow(count, "c binary").collect():        # one table from each of PARTS tasks
        counts += np.frombuffer(r[0]).reshape(counts.shape)
    scale, n = scales(counts[:, :DIM], counts[:, DIM]), counts[:, DIM].sum()
    thresholds = np.linspace(-1.0, 1.0, top)
    if not n:
        return Ordinal(np.zeros(DIM), thresholds, scale)
    # the fit is over the places that take part, numbered anew, so that a step's sums are small
    active = np.nonzero(scale > 0)[0]
    weights, number = np.zeros(len(active)), np.cumsum(scale > 0, dtype=np.int32) - 1
    size = len(active)

    def select(batches):
        for b in batches:
            at, value = b.column("at"), b.column("value").flatten().to_numpy()
            flat, length = at.flatten().to_numpy(), at.value_lengths().to_numpy()
            keep = scale[flat] > 0
            row = np.repeat(np.arange(len(length)), length)[keep]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(length)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (number[flat[keep]], (value * scale[flat])[keep])]
            yield pa.RecordBatch.from_arrays([b.column("grade"), *lists], names=["grade", "at", "value"])

    few = cut(coded.coalesce(PARTS).mapInArrow(select, "grade int, at array<int>, value array<double>"), "rated")
    mean, square = np.zeros(size + top), np.zeros(size + top)
    for i in range(1, steps + 1):
        state = spark.sparkContext.broadcast((weights, thresholds))                # at most DIM + top doubles

        def step(batches):
            w, t = state.value
            total = np.zeros(size + top)
            for b in batches:
                if b.num_rows:
                    at, value = b.column("at"), b.column("value").flatten().to_numpy()
                    flat = at.flatten().to_numpy()
                    row = np.repeat(np.arange(b.num_rows), at.value_lengths().to_numpy())
                    score = np.bincount(row, w[flat] * value, minlength=b.num_rows)
                    by_score, by_t, _ = gradient(score, b.column("grade").to_numpy().astype(np.int64), t)
                    total[:size] += np.bincount(flat, by_score[row] * value, minlength=size)
                    total[size:] += by_t
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["g"])

        g = sum(np.frombuffer(r[0]) for r in few.coalesce(PARTS).mapInArrow(step, "g binary").collect()) / n
        g[:size] += PENALTY * weights
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = RATE * mean / (1 - 0.9 ** i) / (np.sqrt(square / (1 - 0.99 ** i)) + 1e-8)
        weights, thresholds = weights - move[:size], np.sort(thresholds - move[size:])
        state.destroy()
    whole = np.zeros(DIM)
    whole[active] = weights
    return Ordinal(whole, thresholds, scale)


def rate(docs: DataFrame, model: Ordinal, tail: int, names: tuple[str, str] = ("expected_grade", "tail")) -> DataFrame:
    """docs with the expected grade and P(grade >= tail) of ``text``; every other column is carried along."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.scale))        # 2 x DIM doubles
    columns = docs.columns

    def run(batches):
        cache: dict = {}
        weights, thresholds, scale = shared.value
        mask = (scale > 0).astype(np.uint8).tobytes()
        for b in batches:
            score = np.empty(b.num_rows)
            for i, text in enumerate(b.column("text")):
                at, value = features(text.as_py(), cache, scale, mask)
                score[i] = weights[at] @ value
            p = _sigmoid(score[:, None] - thresholds[None, :])      # column k - 1: P(grade >= k)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(p.sum(axis=1)), pa.array(p[:, tail - 1])], names=[*columns, *names])

    added = [T.StructField(n, T.DoubleType()) for n in names]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels(doc_id, quality, toxic): 0 poor, 1 sound but toxic, 2 sound; the least where an id
    has several, null where quality is null."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2))
    return labels.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def quality_model(docs: DataFrame, labels: DataFrame, **options) -> Ordinal:
    """The three-grade model of a documents table and its labels."""
    return fit(docs, grades(labels), 2, **options)
