"""The operators applied to their whole tables: op<N>_<name> queries and, where SQL can say it, their oracles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Tables
from . import ballcodes, coalitions, decontaminate, html, licences, linededup, mixing, quality, sharding, simhash, suffixdedup, tokencount, topk
from .oracles import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


@query
def op1_quality(t):
    model = quality.quality_model(t.documents, t.labels)
    out = quality.rate(t.documents.select("doc_id", "text"), model, 2)
    return out.select("doc_id", "expected_grade", F.col("tail").alias("p_sound"), (F.col("tail") >= quality.KEEP).alias("kept"))


@query
def op2_main_text(t):
    return html.extract(t.pages)


@query
def op3_licence_scan(t):
    out = licences.licence_scan(t.documents)
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), "status")


@query
def op4_hilbert_shards(t):
    return sharding.shard_documents(t.documents).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


@query
def op5_line_dedup(t):
    return linededup.line_dedup(t.documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op6_token_counts(t):
    """Counts before and after masking the personal data of every document, by edits."""
    trees = tokencount.build(tokencount.with_edits(t.documents.select("doc_id", "text"), tokencount.MASKS))
    out = tokencount.edit(trees)
    return out.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_encoded", F.length("text").cast("long").alias("n_chars_after"))


@query
def op7_simhash(t):
    out = simhash.near_duplicates(t.documents)
    return out.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_fair_mix(t):
    sized = t.documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.fair_queue(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@query
def op9_decontaminate(t):
    out = decontaminate.contamination(t.documents, t.benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op10_top_k(t):
    return topk.top_k(t.embeddings, F.col("vec_id") % 20 == 0)


@query
def op11_suffix_dedup(t):
    out = suffixdedup.dedup(t.documents.select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op12_filter_audit(t):
    return coalitions.audit_documents(t.documents, t.labels)


@query
def op13_ball_codes(t):
    return ballcodes.coded(t.embeddings)
