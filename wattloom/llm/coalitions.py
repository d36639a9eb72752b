"""Interaction audit of document filters by the potential of their removal game.

In the removal game of a part of the table a coalition of filters is worth the number of documents that fail at least
one of them.  Its Hart-Mas-Colell potential is P({}) = 0 and P(S) = (v(S) + sum of P(S without i) over i in S) / |S|;
a filter's Shapley value is P(all) - P(all without it).  What a filter removes at its place in an order is the difference of
two coalitions, and so is everything else that is reported: no order is ever run over the documents.

Documents are reduced to one failure mask each and counted by (part, mask) before anything else, so that a part with most
rows costs no more than the others; from then on there are at most 2 ** n rows a part.
"""
from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, UPPER, free_names, words_of


def standard_filters(text: Column, repeated: Column) -> dict[str, Column]:
    """The failure conditions A to E; text without nulls."""
    words = words_of(text, SPACES)
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": repeated,
    }


def failure_masks(docs: DataFrame, part: Column) -> DataFrame:
    """(part, doc_id, mask): bit k is set where the k-th filter fails.

    Only narrow rows are exchanged.  Equal texts are found by two 64-bit hashes; a null doc_id is neither smaller nor larger
    than any other, a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    own = standard_filters(text, F.lit(False))
    bits = sum((F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0) for k, c in enumerate(own.values())), F.lit(0))
    rows = docs.select(part.alias("part"), "doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), bits.alias("mask"))
    first = docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")).groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, ["k1", "k2"], "left").select("part", "doc_id", (F.col("mask") + F.when(repeated, 1 << (len(own) - 1)).otherwise(0)).alias("mask"))


def worth(counts: Column, n: int) -> Column:
    """For each coalition (as bits) how many of the documents counted by failure mask fail one of its filters."""
    every = F.sequence(F.lit(0), F.lit(2 ** n - 1))

    def lost(s):
        hit = F.filter(every, lambda m: m.bitwiseAND(s) != 0)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda acc, m: acc + F.get(counts, m))
    return F.transform(every, lost)


def potential(v: Column, n: int) -> Column:
    """n! times the potential of every coalition, in whole numbers: coalitions ascend, so that all subsets come first."""
    def step(acc, s):
        inside = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(s, i) == 1)
        smaller = F.aggregate(inside, F.lit(0).cast("long"), lambda a, i: a + F.get(acc, s - F.pow(F.lit(2), i).cast("int")))
        p = F.call_function("div", F.get(v, s) * factorial(n) + smaller, F.size(inside).cast("long"))      # leaves no rest
        return F.concat(acc, F.array(p))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 ** n - 1)), F.array(F.lit(0).cast("long")), step)


def audit(masks: DataFrame, names: str, flags: dict[str, Column]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <flag>_lost..., shapley) for every order of the filters.

    masks: (part, mask) and what flags use; bit k of mask is the k-th letter of names.  A flag is a condition on a row; null is
    false.  shapley is the sum over all orders of what the step's filter removes.  Parts are those of the rows; no rows, no parts."""
    n = len(names)
    assert 1 <= n <= 8
    games = {"all": F.lit(1), **{f: F.when(c, 1).otherwise(0) for f, c in flags.items()}}
    counted = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(f"_{g}") for g, c in games.items()])
    at = lambda g, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(f"_{g}"))), F.lit(0))      # noqa: E731
    tables = counted.groupBy("part").agg(*[F.array(*[at(g, m) for m in range(2 ** n)]).alias(f"_{g}") for g in games])
    tables = tables.select("part", F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"), *[worth(F.col(f"_{g}"), n).alias(f"_{g}") for g in games])
    tables = tables.withColumn("_p", potential(F.col("_all"), n))
    bit = {c: 1 << k for k, c in enumerate(names)}
    steps = []
    for order in permutations(names):
        done = 0
        for k, c in enumerate(order):
            steps.append(("".join(order), k + 1, done, done | bit[c], bit[c]))
            done |= bit[c]
    spark = masks.sparkSession
    steps = spark.createDataFrame(steps, "filter_order string, step int, _s int, _t int, _i int")       # n! * n rows
    out = tables.crossJoin(F.broadcast(steps))
    full = 2 ** n - 1
    v = lambda g, s: F.get(F.col(f"_{g}"), s)                      # noqa: E731
    here = lambda g: v(g, F.col("_t")) - v(g, F.col("_s"))         # noqa: E731
    without = F.lit(full) - F.col("_i")
    return out.select(
        "part", "filter_order", "step",
        (F.col("_n") - v("all", F.col("_t"))).alias("kept"),
        here("all").alias("removed"),
        (v("all", F.col("_i")) - here("all")).alias("redundant"),
        (v("all", F.lit(full)) - v("all", without)).alias("unique_fails"),
        *[here(f).alias(f"{f}_lost") for f in flags],
        (F.get("_p", F.lit(full)) - F.get("_p", without)).alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E by language (null: empty), with the good and toxic documents of labels that a step loses.

    A document with several labels counts where any of them says so; other columns of docs are not read."""
    rated = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    masks = failure_masks(docs, F.coalesce(F.col("lang"), F.lit("")))
    rows = masks.join(rated, F.col("doc_id") == F.col("_id"), "left")
    return audit(rows, "ABCDE", {"good": F.col("good"), "toxic": F.col("toxic")})
