"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit for each of the 64 bits of its shingles' XXH64 values, set where over
half of them have it.  Fingerprints differing in at most RADIUS bits are linked, and linked documents
form groups.

Distinct fingerprints are compared once.  Two of them within radius 2 agree in two of four 16-bit bands,
so each goes to six buckets by a pair of bands; a bucket over BLOCK is cut into blocks that meet
pairwise in tasks of their own, so that no bucket is ever one task.  A task packs whole buckets to blocks
of about BLOCK fingerprints and stores their 64 bit planes vertically: one word of a plane holds that bit
of 64 fingerprints.  Distances from a fingerprint to the 64 of a word grow together, plane by plane, in
bitwise carry-save counters, and a word is abandoned as soon as all its distances exceed the radius.

A task gives back a spanning forest of the links it finds, not the pairs; groups are connected components.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut
from .common import free_names
from .graph import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCK = 1024
BANDS = 4
WORDS_AT_ONCE = 100_000      # words held as objects at one time, so that a very long text needs little memory


def _word_blocks(text: bytes, keep: int):
    """Words of a text in blocks that overlap by ``keep`` words."""
    if len(text) < 8 * WORDS_AT_ONCE:
        yield text.split()
        return
    held, first = [], True
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", text):
        held.append(m.group())
        if len(held) == WORDS_AT_ONCE:
            yield held
            held, first = held[-keep:] if keep else [], False
    if first or len(held) > keep:        # few words are a block of their own if nothing came before them
        yield held


def _hashes(text: bytes, shingle: int):
    """Blocks of the shingles' hash values; repeats included."""
    digest = xxhash.xxh64_intdigest
    for i, words in enumerate(_word_blocks(text.lower(), shingle - 1)):      # bytes.lower changes A-Z only
        if len(words) >= shingle:
            yield np.array([digest(s, SEED) for s in map(b" ".join, zip(*[words[k:] for k in range(shingle)]))], dtype=np.uint64)
        elif words and i == 0:
            yield np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in _hashes(text or b"", shingle):
        for at in range(0, len(h), 4096):
            part = h[at:at + 4096]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), *, shingle: int = SHINGLE) -> DataFrame:
    """The key columns of docs and fp, the 64 bits of text's fingerprint as a long."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("_text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(fp, pa.int64())], names=[*keys, "fp"])
    d = docs.select(*keys, F.col("text").cast("binary").alias("_text"))
    return d.mapInArrow(run, T.StructType([*d.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def pairs_within(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all pairs of uint64 fingerprints that differ in at most ``radius`` bits, bit-sliced."""
    n = len(fps)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = (n + 63) // 64
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")           # n x 64
    lanes = np.zeros((64, words * 64), dtype=np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)                      # 64 x words
    flip = (0 - bits.astype(np.uint64))                                                         # all ones where the bit is set
    row, word = np.divmod(np.arange(n * words), words)
    keep = word * 64 + 63 > row
    row, word = row[keep], word[keep]
    # lanes up to the row itself, and those past the end, count as too far from the start
    shift = np.clip(row + 1 - word * 64, 0, 63).astype(np.uint64)
    ones = np.uint64(2 ** 64 - 1)
    dead = ~(ones << shift)
    if n % 64:
        dead[word == words - 1] |= ones << np.uint64(n % 64)
    depth = radius.bit_length() + 1
    counts = [np.zeros(len(row), dtype=np.uint64) for _ in range(depth)]
    for p in range(64):
        carry = planes[p][word] ^ flip[row, p]
        for c in counts:
            c ^= carry                    # sum bit; a carry is where the counter had a one and lost it
            carry = carry & ~c
        dead |= carry                     # past the largest count
        if p % 8 == 7 and p >= 15:
            more, same = np.zeros_like(dead), np.full_like(dead, ones)
            for k in range(depth - 1, -1, -1):
                if radius >> k & 1:
                    same &= counts[k]
                else:
                    more |= same & counts[k]
                    same &= ~counts[k]
            dead |= more
            alive = dead != ones
            if not alive.all():
                row, word, dead = row[alive], word[alive], dead[alive]
                counts = [c[alive] for c in counts]
            if not len(row):
                break
    near = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, lane = np.nonzero(near) if len(row) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return row[cell], word[cell] * 64 + lane


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least one reached over the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (label == before).all():
            return label


def links(distinct: DataFrame, *, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): a spanning forest, bucket by bucket, of the pairs of the distinct long column fp within the radius (at most BANDS - 2)."""
    assert 0 <= radius <= BANDS - 2
    width = 64 // BANDS
    band = [F.shiftrightunsigned("fp", width * b).bitwiseAND(2 ** width - 1) for b in range(BANDS)]
    pairs = [(a, b) for a in range(BANDS) for b in range(a + 1, BANDS)]
    keys = [F.shiftleft(F.lit(k).cast("long"), 2 * width) + F.shiftleft(band[a], width) + band[b] for k, (a, b) in enumerate(pairs)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("bucket", "_b")
    rows = rows.join(full, F.col("bucket") == F.col("_b")).drop("_b")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    other = F.sequence(F.lit(0), parts - 1)
    cells = F.when(parts == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(other, lambda x: x != own), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"))))
    rows = rows.select("bucket", "fp", F.explode(cells).alias("cell")).select("bucket", "cell.i", "cell.j", "fp")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        held, size = [], 0

        def found(parts):
            fps = np.unique(np.concatenate(parts))
            i, j = pairs_within(fps.view(np.uint64), radius)
            root = least_reached(len(fps), i, j)
            at = np.nonzero(root != np.arange(len(fps)))[0]
            return pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[root[at]])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "i", "j")])
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1, [len(fps)]])
            for a, z in zip(starts[:-1], starts[1:]):
                mine = tuple(key[:, a])
                # a block ends only between buckets
                if size >= block and mine != last:
                    yield found(held)
                    held, size = [], 0
                held.append(fps[a:z])
                size += z - a
                last = mine
        if held:
            yield found(held)

    return rows.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), *, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The keys (doc_id among them), fp, root and component_id for each row of docs; root is the least fp (as a
    long) of its group and component_id the least doc_id.

    Texts without words, null and empty ones have fingerprint 0 and are linked like any other.  Repeated
    rows are in one group.  A null doc_id counts as none in the minimum.  An empty table gives no rows.
    """
    f = cut(fingerprints(docs, keys, shingle=shingle), "simhash")
    once = f.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = components(links(once.select("fp"), radius=radius, block=block))
    rooted = once.join(label, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    group = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("_fp"), "root", "component_id")
    return f.join(group, F.col("fp") == F.col("_fp")).drop("_fp")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the least (doc_id, text digest), nulls first; all columns as they are."""
    digest, d, g = free_names(docs, "_digest", "_d", "_g")
    keyed = docs.withColumn(digest, F.md5("text"))
    found = near_duplicates(keyed, ("doc_id", digest), **options)
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", digest)).alias("_b")).select(F.col("_b.doc_id").alias(d), F.col(f"_b.{digest}").alias(g))
    kept = keyed.join(best, F.col("doc_id").eqNullSafe(F.col(d)) & F.col(digest).eqNullSafe(F.col(g)), "left_semi")
    return kept.dropDuplicates(["doc_id", digest]).drop(digest)


def hex_digits(fp):
    """16 lowercase hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
