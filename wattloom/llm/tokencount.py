"""Edit-aware token counts.

A document's text is kept as a segment tree: leaves are runs of whole pre-tokens with their length and token
count, inner nodes hold sums.  An edit touches the leaves it overlaps and a few characters of context; only
their text is encoded again, the leaves take the new counts, and the sums on their paths to the root
are updated.  All other leaves keep theirs.

Leaves are cut before a space that follows and is followed by a character other than white space.  The
pre-token pattern of the byte-pair vocabularies never crosses such a place, so the counts of leaves add
up to the count of the text; a place keeps that property unless an edit reaches within MARGIN of it.

Edits of a document are (start, length, insert) in characters of the text before any of them, sorted and
disjoint; an edit that overlaps its forerunner or lies outside the text is left out.  A null text has no
tokens and a null result text; a null list has no edits.
"""
from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

LEAF = 512          # characters of a leaf, at least, but for the last
MARGIN = 3          # characters beyond an edit that may belong to a changed pre-token
RANKS = "byte_bpe_50k.tiktoken"

# What the example query masks, in this order of preference.
MASKS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"(?<![\d.])\+?\d[\d ()-]{7,}\d(?![\d.])", "<number>"),
]


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path(RANKS)


def encoder(path: str):
    """The byte-pair encoder of a rank file (see the public tokenizers' notes); a task loads it once."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cut(text: str, least: int) -> int:
    """The first safe place at or after ``least``, or the end."""
    n = len(text)
    at = text.find(" ", max(least, 1))
    while 0 <= at < n - 1:
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at = text.find(" ", at + 1)
    return n


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    out, pos = [], 0
    while pos < len(text):
        end = _cut(text, pos + leaf)
        out.append(text[pos:end])
        pos = end
    return out


def tree_of(values) -> np.ndarray:
    """Sums of a binary tree over the values: node 1 is the root, node i has 2i and 2i + 1."""
    size = 1 << max(0, len(values) - 1).bit_length()
    tree = np.zeros(2 * size, dtype=np.int64)
    tree[size:size + len(values)] = values
    for level in range(size.bit_length() - 1, 0, -1):
        a, z = 1 << (level - 1), 1 << level
        tree[a:z] = tree[2 * a:2 * z:2] + tree[2 * a + 1:2 * z:2]
    return tree


def put(tree: np.ndarray, leaf: int, value: int) -> None:
    """Sets a leaf and the sums on its path to the root."""
    at = len(tree) // 2 + leaf
    change = value - tree[at]
    while at:
        tree[at] += change
        at //= 2


def find(tree: np.ndarray, place: int) -> tuple[int, int]:
    """(leaf, sum of the leaves before it) of the leaf that holds a place of the running sum."""
    at, size, before = 1, len(tree) // 2, 0
    while at < size:
        at *= 2
        if place >= before + tree[at] and tree[at + 1] > 0:
            before += int(tree[at])
            at += 1
    return at - size, before


def count(enc, text: str) -> int:
    return len(enc.encode_ordinary(text))


def valid(edits, n: int) -> list[tuple[int, int, str]]:
    out, end = [], 0
    for e in edits or []:
        start, length, insert = e["start"], e["length"], e["insert"] or ""
        if start is not None and length is not None and length >= 0 and start >= end and start + length <= n:
            out.append((start, length, insert))
            end = start + length
    return out


def apply(enc, text: str, chars: np.ndarray, tokens: np.ndarray, edits) -> tuple[str, int]:
    """Applies valid edits; updates both trees in place; gives the new text and the number of characters encoded.

    Edits whose touched leaves meet are one region.  A region's new text goes to its first leaf; the
    others become empty, so that no leaf moves.
    """
    size, encoded = len(chars) // 2, 0
    regions: list[list] = []                    # first leaf, last leaf, their start, their end, edits
    for start, length, insert in edits:
        first, begin = find(chars, max(0, start - MARGIN))
        last, before = find(chars, max(0, min(len(text), start + length + MARGIN) - 1))
        end = before + int(chars[size + last])
        if regions and first <= regions[-1][1] + 1:
            regions[-1][1], regions[-1][3] = max(regions[-1][1], last), max(regions[-1][3], end)
            regions[-1][4].append((start, length, insert))
        else:
            regions.append([first, last, begin, end, [(start, length, insert)]])
    out, done, changes = [], 0, []
    for first, last, begin, end, own in regions:
        piece, at = [], begin
        for start, length, insert in own:
            piece += [text[at:start], insert]
            at = start + length
        piece = "".join([*piece, text[at:end]])
        out += [text[done:begin], piece]
        done = end
        encoded += len(piece)
        changes.append((first, last, len(piece), count(enc, piece)))
    for first, last, n, t in changes:
        for k in range(first, last + 1):
            put(chars, k, n if k == first else 0)
            put(tokens, k, t if k == first else 0)
    return "".join([*out, text[done:]]), encoded


def with_edits(docs: DataFrame, masks) -> DataFrame:
    """docs with ``edits``: the places of the masks' patterns in text and what to put there; where matches overlap, the
    first to start, then the first of the masks."""
    def run(batches):
        either = re.compile("|".join(f"({p})" for p, _ in masks))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("insert", pa.string())]))
        for b in batches:
            found = [None if t is None else [{"start": m.start(), "length": m.end() - m.start(), "insert": masks[m.lastindex - 1][1]} for m in either.finditer(t)]
                     for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "edits"])
    edits = StructType.fromDDL("edits array<struct<start:int,length:int,insert:string>>")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *edits.fields]))


def gather(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with the rows of edits(doc_id, start, length, insert) as the sorted list ``edits``."""
    per = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"), F.col("insert").alias("insert")))).alias("edits"))
    return docs.join(per, "doc_id", "left")


def build(docs: DataFrame, *, ranks: str | None = None, leaf: int = LEAF) -> DataFrame:
    """docs with the trees ``chars`` and ``tokens`` of text and their root ``n_tokens``; write this table once and edit on it."""
    path = ranks or default_ranks()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            chars, tokens = [], []
            for t in b.column("text"):
                parts = leaves(t.as_py() or "", leaf)
                chars.append(tree_of([len(p) for p in parts]))
                tokens.append(tree_of([count(enc, p) for p in parts]))
            total = pa.array([int(t[1]) for t in tokens], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chars, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64())), total],
                                             names=[*b.schema.names, "chars", "tokens", "n_tokens"])
    added = StructType.fromDDL("chars array<bigint>, tokens array<bigint>, n_tokens bigint")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def edit(trees: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """The table of ``build``, with a column ``edits``, after these: new text and trees, n_edits, n_tokens_after and
    n_chars_encoded; n_tokens stays the count before."""
    path = ranks or default_ranks()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts, n_edits, after, encoded, chars, tokens = [], [], [], [], [], []
            for t, e, c, k in zip(b.column("text"), b.column("edits"), b.column("chars"), b.column("tokens")):
                t, c, k = t.as_py(), c.values.to_numpy(zero_copy_only=False).copy(), k.values.to_numpy(zero_copy_only=False).copy()
                own = valid(e.as_py(), len(t)) if t is not None else []
                new, n = apply(enc, t, c, k, own) if own else (t, 0)
                texts.append(new), n_edits.append(len(own)), after.append(int(k[1])), encoded.append(n), chars.append(c), tokens.append(k)
            fresh = {"text": pa.array(texts, pa.string()), "chars": pa.array(chars, pa.list_(pa.int64())), "tokens": pa.array(tokens, pa.list_(pa.int64()))}
            columns = [fresh.get(name, b.column(name)) for name in b.schema.names]
            counts = [pa.array(x, pa.int64()) for x in (n_edits, after, encoded)]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*b.schema.names, "n_edits", "n_tokens_after", "n_chars_encoded"])
    added = StructType.fromDDL("n_edits bigint, n_tokens_after bigint, n_chars_encoded bigint")
    return trees.mapInArrow(run, StructType([*trees.schema.fields, *added.fields]))
