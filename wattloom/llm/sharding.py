"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to 2**BITS levels, a document's place on the Hilbert curve of
that grid is its index, and the documents sorted by (index, id) are cut into runs of equal row counts.
Near documents on the curve are near in every dimension, so a shard covers a narrow range of each one
and min/max statistics prune files by any of them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_names, positions

SHARDS = 16
BITS = 6
LEVELS = 2 ** BITS


def _rotl(x: int, k: int, n: int) -> int:
    k %= n
    return ((x << k) | (x >> (n - k))) & (2 ** n - 1)


def curve_steps(n: int) -> list[int]:
    """One step of the curve in n dimensions: at (entry e, direction d) and the cell bits l, entry
    (e * n + d) * 2**n + l holds w * 256 + the next e * n + d, w being the cell's place among the 2**n."""
    gray = [i ^ (i >> 1) for i in range(2 ** n)]
    place = {g: i for i, g in enumerate(gray)}

    def trailing(i):
        return ((i ^ (i + 1)).bit_length() - 1) % n

    def entry(w):
        return 0 if w == 0 else gray[2 * ((w - 1) // 2)]

    def turn(w):
        return 0 if w == 0 else trailing(w - 1) if w % 2 == 0 else trailing(w)

    out = []
    for e in range(2 ** n):
        for d in range(n):
            for cell in range(2 ** n):
                w = place[_rotl(cell ^ e, n - (d + 1) % n, n)]
                out.append(w * 256 + (e ^ _rotl(entry(w), d + 1, n)) * n + (d + turn(w) + 1) % n)
    return out


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of non-negative integer axes below 2**bits (at most 5 axes)."""
    n = len(axes)
    table = F.array(*[F.lit(v) for v in curve_steps(n)])

    def step(acc, level):
        cell = F.lit(0)
        for a in axes:
            cell = cell * 2 + F.call_function("shiftright", a.cast("int"), level.cast("int")).bitwiseAND(1)
        at = F.element_at(table, ((acc % 256) * 2 ** n + cell + 1).cast("int"))
        return ((F.floor(acc / 256) * 2 ** n + F.floor(at / 256)) * 256 + at % 256).cast("long")

    levels = F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)])
    return F.aggregate(levels, F.lit(0).cast("long"), step, lambda acc: F.floor(acc / 256).cast("long"))


def size_level(size: Column) -> Column:
    """Four levels for each doubling: the bit length and the next two bits of size >= 1."""
    n = F.length(F.bin(size))
    top = F.when(n >= 3, F.floor(size / F.pow(F.lit(2), n - 3))).otherwise(size * F.pow(F.lit(2), 3 - n))
    return F.least((n - 1) * 4 + (top.cast("int") - 4), F.lit(LEVELS - 1)).cast("int")


def coded(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the level of a category: its place among the distinct values (null first), spread over LEVELS."""
    code, value, count = free_names(df, "_code", "_value", "_count")
    values = positions(df.select(F.col(column).alias(value)).distinct(), [F.col(value).asc_nulls_first()], code, "codes")
    n = values.agg(F.greatest(F.count("*"), F.lit(LEVELS)).alias(count))    # one row
    values = values.join(F.broadcast(n)).select(value, F.floor(F.col(code) * LEVELS / F.col(count)).cast("int").alias(name))
    return df.join(values, F.col(column).eqNullSafe(F.col(value)), "left").drop(value)


def hilbert_shards(df: DataFrame, axes: list[Column], tie: list[Column], *, shards: int = SHARDS) -> DataFrame:
    """Adds ``curve``, ``shard`` and ``slot`` to every row: the rows in the order (curve index, tie) are cut into
    ``shards`` runs whose counts differ by at most one.

    Keep df narrow: it is written once in curve order.  Rows equal in tie are interchangeable; an empty
    table gives no rows; an axis must not be null (give nulls a level of their own).
    """
    pos, total = free_names(df, "_pos", "_total")
    ordered = positions(df.withColumn("curve", hilbert_index(axes)), [F.col("curve"), *tie], pos, "curve")
    n = ordered.agg(F.count("*").alias(total))                              # one row
    shard = F.floor(F.col(pos) * shards / F.col(total))
    first = F.ceil(F.col("shard") * F.col(total) / shards)
    return (ordered.join(F.broadcast(n)).withColumn("shard", shard.cast("int"))
            .withColumn("slot", (F.col(pos) - first).cast("long")).drop(pos, total))


def text_facts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, size (UTF-8 bytes plus 1; null text: 1) and text_crc32 (null text: 0)."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", "lang", (F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).cast("long").alias("text_crc32"))


def shard_documents(docs: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """Shards of a documents table by source, language and size; one row for each row.  Null sources and
    languages have levels of their own; extra columns are ignored; equal texts get no special place."""
    facts = coded(coded(text_facts(docs), "source", "_source"), "lang", "_lang")
    tie = [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size")]
    out = hilbert_shards(facts, [F.col("_source"), F.col("_lang"), size_level(F.col("size"))], tie, shards=shards)
    return out.select("doc_id", "source", "lang", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")
