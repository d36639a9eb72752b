"""Benchmark decontamination by word windows.

Every run of WINDOW consecutive words of a benchmark item is a window; an item of fewer words, but not
none, is one window as a whole.  The hashes of all windows are a broadcast set that every training-text
window is probed against; hits are verified word by word before they count.

The hashes are broadcast only while there are at most ``broadcast_windows`` of them (16 bytes each);
beyond that the same semi-join shuffles places and hashes, not texts, and the texts with hits are joined back to verify them.  Null texts have no words; repeated rows are answered alike.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import NO_ALNUM, ascii_lower, free_names, words_of

WINDOW = 13
BROADCAST_WINDOWS = 2_000_000
RAW_WORD = NO_ALNUM.replace("[", "[^")


def _window(words: Column, start: Column, length: Column | int) -> Column:
    return F.xxhash64(F.slice(words, start + 1, length))


def item_windows(benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(item_id, length, hash, words) of every window; words joined by spaces."""
    w = benchmark.select("item_id", words_of(ascii_lower(F.col("text")), NO_ALNUM).alias("w")).withColumn("n", F.size("w"))
    w = w.withColumn("length", F.least("n", F.lit(window))).withColumn("i", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - F.col("length")))))
    return w.select("item_id", "length", _window(F.col("w"), F.col("i"), F.col("length")).alias("hash"), F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ").alias("words")).distinct()


def occurrences(docs: DataFrame, windows: DataFrame, *, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, digest, start, length, item_id): each place of docs(doc_id, text) at which an item's window stands.
    digest is the text's MD5; rows equal in id and text give one set of places."""
    lengths = [r[0] for r in windows.select("length").distinct().collect()]     # at most ``window`` numbers
    if not lengths:
        lengths = [1]
    hashes = windows.select("hash").distinct()
    few = hashes.count() <= broadcast_windows
    # the digest is taken once a text, here: above the explode it would be taken once a window
    d = docs.select("doc_id", F.md5("text").alias("digest"), words_of(ascii_lower(F.col("text")), NO_ALNUM).alias("w")).withColumn("n", F.size("w"))
    # no filter on n: it would be pushed below the split and split every text twice
    d = d.withColumn("i", F.explode(F.when(F.col("n") >= min(lengths), F.sequence(F.lit(0), F.col("n") - min(lengths)))))
    length = F.lit(lengths[0])
    if len(lengths) > 1:
        length = F.explode(F.array(*[F.lit(k) for k in sorted(lengths)]))
    d = d.withColumn("length", length)
    if len(lengths) > 1:
        d = d.withColumn("length", F.when(F.col("i") + F.col("length") <= F.col("n"), F.col("length")))   # else a null hash
    d = d.withColumn("hash", _window(F.col("w"), F.col("i"), F.col("length")))
    words = F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ").alias("words")
    if few:
        hit = d.join(F.broadcast(hashes), "hash", "left_semi").withColumn("start", F.col("i")).select("doc_id", "digest", "start", "length", "hash", words).distinct()
    else:
        key, own = ["doc_id", "digest"], ["_d", "_g"]
        thin = d.select("doc_id", "digest", F.col("i").alias("start"), "length", "hash").filter("hash is not null and length is not null")
        places = thin.join(hashes.hint("merge"), "hash", "left_semi").distinct()
        places = places.groupBy(*key).agg(F.collect_list(F.struct("start", "length", "hash")).alias("_at")).toDF(*own, "_at")
        again = docs.select("doc_id", F.md5("text").alias("digest"), "text")
        again = again.join(places.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g"))).dropDuplicates(key)
        # words below the explode, so that a text is split once and not once a place
        again = again.select(*key, words_of(ascii_lower(F.col("text")), NO_ALNUM).alias("w"), "_at").select(*key, "w", F.explode("_at").alias("_p"))
        hit = again.select(*key, "_p.*", "w").select(*key, "start", "length", "hash", words)
    return hit.join(windows, ["length", "hash", "words"]).select("doc_id", "digest", "start", "length", "item_id")


def covered(spans: Column) -> Column:
    """Number of places in the union of spans, a sorted array of (start, length)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    def step(a, s):
        end = s["start"] + s["length"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], end).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = 20,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_words, n_hit, spans, items and contaminated, which holds
    where any word is hit and at least one in ``share`` of them."""
    windows = item_windows(benchmark, window=window)
    at = occurrences(docs, windows, broadcast_windows=broadcast_windows)
    per = at.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
                                             F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per = per.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "spans", "items")
    d = docs.select("doc_id", F.md5("text").alias("digest"), F.size(words_of(F.col("text"), NO_ALNUM)).cast("long").alias("n_words"))
    out = d.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g")), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    out = out.select("doc_id", "digest", "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows; all columns as they are."""
    bad = contamination(docs.select("doc_id", "text"), benchmark, **options).filter("contaminated").select("doc_id", "digest").distinct()
    d, g, key = free_names(docs, "_d", "_g", "_digest")
    bad = bad.toDF(d, g)
    kept = docs.withColumn(key, F.md5("text")).join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(g)), "left_anti")
    return kept.drop(key)


def cut_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with every hit word and the separators before it cut out of the text."""
    found = contamination(docs.select("doc_id", "text"), benchmark, **options).filter("n_hit > 0").select("doc_id", "digest", "spans").distinct()
    d, g, spans, key = free_names(docs, "_d", "_g", "_spans", "_digest")
    found = found.toDF(d, g, spans)
    both = docs.withColumn(key, F.md5("text")).join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(g)), "left")
    pieces = F.regexp_extract_all("text", F.lit(f"({NO_ALNUM[:-1]}*{RAW_WORD})"), F.lit(1))
    kept = F.filter(pieces, lambda x, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["start"] + s["length"])))
    tail = F.regexp_extract("text", f"({NO_ALNUM[:-1]}*)$", 1)
    return both.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))).drop(d, g, spans, key)
