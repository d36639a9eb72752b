"""Suffix-sort dedup against brute force."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import empty, table
from wattloom import session
from wattloom.llm import suffixdedup


def by_hand(texts, length):
    """(n_bytes, n_removed, n_spans, sha of the rest) for each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice("abcdefghé") for _ in range(k))       # noqa: E731
    some = lambda n: " ".join(word(rnd.randint(1, 9)) for _ in range(n))      # noqa: E731
    common = some(40)
    texts = [None, "", "x", some(5), common, common]
    for g in range(8):
        base = some(rnd.randint(20, 200))
        for k in range(rnd.randint(1, 6)):
            t = list(base)
            for _ in range(k):
                t[rnd.randrange(len(t))] = "X"
            texts.append("".join(t))
        a = rnd.randrange(len(base) // 2)
        texts.append(some(30) + base[a:a + rnd.randint(50, 400)] + some(9))
    texts += [some(20) + common + some(20) for _ in range(10)]
    texts += ["a" * 900, "a" * 130 + "b" + "a" * 300, "ab" * 400, "abc" * 150 + some(10) + "abc" * 150, some(3) + "a" * 127]
    texts += [common[5:] + some(3), some(3) + common[:-7]]
    return texts


@pytest.mark.parametrize("seed,length,anchor,trigger,every,fine,most_keys", [(1, 128, 24, 6, 8, 4, 9999), (3, 60, 20, 4, 6, 3, 0), (4, 100, 90, 8, 32, 32, 9999)])
def test_by_hand(spark, seed, length, anchor, trigger, every, fine, most_keys):
    texts = corpus(seed)
    docs = table(spark, list(enumerate(texts)))
    got = suffixdedup.dedup(docs, length=length, anchor=anchor, trigger=trigger, every=every, fine=fine, most_keys=most_keys)
    rows = {r.doc_id: r for r in got.collect()}
    want = by_hand(texts, length)
    assert len(rows) == len(texts)
    for i, w in enumerate(want):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, (i, texts[i])
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == w[3]
    assert set(docs.columns) < set(got.columns)


def test_suffix_ranks(spark):
    """Ranks of all suffixes of several strings of names, to their ends."""
    rnd = random.Random(5)
    strings = [[rnd.randrange(3) for _ in range(n)] for n in (1, 2, 3, 4, 5, 17, 40)] + [[1] * 30, [0, 1] * 12, [2] * 7]
    rows = [(u, t, c, 1) for u, s in enumerate(strings) for t, c in enumerate(s)]
    got = {(r.u, r.t): r["rank"] for r in suffixdedup.suffix_ranks(spark.createDataFrame(rows, "u long, t long, c long, n long"), 1000).collect()}
    suffixes = sorted((s[t:], u, t) for u, s in enumerate(strings) for t in range(len(s)))
    smaller = {}
    for i, (s, _, _) in enumerate(suffixes):
        smaller.setdefault(tuple(s), i)
    assert got == {(u, t): smaller[tuple(s)] for s, u, t in suffixes}


def test_edges(spark):
    got = suffixdedup.dedup(table(spark, [(None, "x" * 500), (None, "x" * 500), (1, None), (1, "y")])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(0, 0, 0), (1, 0, 0), (500, 500, 1), (500, 500, 1)]
    assert suffixdedup.dedup(empty(spark)).count() == 0


def test_long_text(spark, monkeypatch):
    """Texts of many pieces, with the repeat across the ends of pieces."""
    rnd = random.Random(6)
    base = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(1_400_000))
    texts = [base, base[300_000:800_123] + "!", "?" + base[900_000:900_399] + "?", "?" + base[524_100:524_500] + "?"]
    got = {r.doc_id: r for r in suffixdedup.dedup(table(spark, list(enumerate(texts)))).collect()}
    assert (got[0].n_removed, got[0].n_spans) == (500_123, 1)
    assert got[1].n_removed == 500_123 and got[1].n_spans == 1 and bytes(got[1].kept) == b"!"
    assert got[2].n_removed == 0 and (got[3].n_removed, bytes(got[3].kept)) == (400, b"??")


def test_disk(spark, tmp_path, monkeypatch):
    """What is shuffled and written: texts, phrases and sorted rows are not moved or written more often than needed."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))      # noqa: E731
    shared = [some(400) for _ in range(150)]
    texts = [some(100) + " " + rnd.choice(shared) + " " + some(100) for _ in range(600)]
    table(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: str(tmp_path / "shared" / f"{purpose}-{rnd.random()}"))
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}

    begun = max(stages(), default=-1)
    suffixdedup.dedup(spark.read.parquet(str(tmp_path / "docs")).select("doc_id", "text"), keep_text=False).write.parquet(str(tmp_path / "out"))
    moved = sum(n for k, n in stages().items() if k > begun)
    kept = sum(f.stat().st_size for f in (tmp_path / "shared").rglob("*.parquet"))
    size = sum(map(len, texts))
    assert moved + kept < 10.8 * size
