"""Filter audit and vector codes against brute force."""
import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, table
from wattloom.llm import ballcodes, coalitions


def fails_by_hand(rows):
    """The failed letters of each (doc_id, text)."""
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        f += "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * any(j is not None and i is not None and j < i and (u or "") == t for j, u in rows)
        out.append(f)
    return out


def audit_by_hand(parts, fails, good, toxic, names):
    out = {}
    for part in set(parts):
        own = [k for k, p in enumerate(parts) if p == part]
        total = dict.fromkeys(names, 0)
        for order in permutations(names):
            left = list(own)
            for step, c in enumerate(order, 1):
                hit = [k for k in left if c in fails[k]]
                gone = [k for k in own if k not in left]
                left = [k for k in left if c not in fails[k]]
                total[c] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), sum(c in fails[k] for k in gone), sum(fails[k] == c for k in own),
                                                   sum(good[k] for k in hit), sum(toxic[k] for k in hit), c]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_hand(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))      # noqa: E731
    texts = []
    for i in range(120):
        w = [word() for _ in range(rnd.choice([0, 3, 99, 100, 101, 150]))]
        if rnd.random() < .3 and w:
            w = w[:max(1, len(w) // 3)] * 3
        t = " ".join(w)
        if rnd.random() < .3:
            t = t.upper()
        if rnd.random() < .2:
            t += rnd.choice("#$%&*| é")
        texts.append((i, t))
    texts += [(200 + k, texts[k % 7][1]) for k in range(30)] + [(None, texts[0][1]), (5, texts[5][1]), (500, None), (501, ""), (502, "A b" * 40), (503, "x\ty" * 30_000)]
    docs = table(spark, texts)
    lang = [r.lang for r in docs.collect()]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(150)] + [(None, 1, 1), (3, 1, 1), (3, 0, 0)]
    good, toxic = [], []
    for i, _ in texts:
        mine = [(q, x) for j, q, x in labels if i is not None and j == i]
        good.append(any(q == 1 for q, _ in mine))
        toxic.append(any(x == 1 for _, x in mine))
    want = audit_by_hand([x or "" for x in lang], fails_by_hand(texts), good, toxic, "ABCDE")
    got = coalitions.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()} == want
    assert coalitions.audit_documents(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("names", ["X", "XYZ"])
def test_other_numbers_of_filters(spark, names):
    rnd = random.Random(2)
    masks = [rnd.randrange(2 ** len(names)) for _ in range(50)]
    fails = ["".join(c for k, c in enumerate(names) if m >> k & 1) for m in masks]
    df = spark.createDataFrame([("p", m) for m in masks], "part string, mask int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, 0, 0, r.shapley) for r in coalitions.audit(df, names, {}).collect()}
    assert got == audit_by_hand(["p"] * 50, fails, [0] * 50, [0] * 50, names)


def codes_by_hand(rows, entries, rounds, parts, scale):
    kept = [(i, lab, [int(np.floor(np.float64(scale) * np.float64(np.float32(c)))) for c in v]) for i, lab, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = len(kept[0][2]) // parts
    x = np.array([v for _, _, v in kept]).reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [x[first, p].copy() for p in range(parts)]

    def nearest(p):
        return [min(range(len(books[p])), key=lambda e: (int(((v - books[p][e]) ** 2).sum()), e)) for v in x[:, p]]
    for _ in range(rounds):
        for p in range(parts):
            a = nearest(p)
            for e in set(a):
                mine = [v for v, b in zip(x[:, p], a) if b == e]
                books[p][e] = [sum(int(v[k]) for v in mine) // len(mine) for k in range(width)]
    code = [nearest(p) for p in range(parts)]
    out = []
    for k, (i, lab, _) in enumerate(kept):
        out.append((i, lab, "".join(f"{code[p][k]:02x}" for p in range(parts)), sum(int(((x[k, p] - books[p][code[p][k]]) ** 2).sum()) for p in range(parts))))
    sha = hashlib.sha256(",".join(str(c) for p in range(parts) for e in books[p] for c in e).encode()).hexdigest()
    return out, sha


@pytest.mark.parametrize("entries,rounds,spread", [(256, 4, .4), (5, 3, .02), (40, 0, 1.), (9, 6, 30_000.)])
def test_codes_by_hand(spark, entries, rounds, spread):
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=(12, 16)) * spread
    rows = []
    for i in range(300):
        v = (centre[rnd.integers(12)] + rnd.normal(size=16) * spread / 5).astype(np.float32).tolist()
        rows.append((int(i), int(rnd.integers(4)) if rnd.random() < .9 else None, v))
    rows += [(rows[k][0], rows[k][1], rows[k][2]) for k in range(40)] + [(7, 1, rows[9][2]), (None, None, rows[3][2])]
    rows += [(900, 1, None), (901, 1, [None] + [0.] * 15), (902, 1, [float("nan")] * 16), (903, None, [float("inf")] + [0.] * 15)]
    rnd.shuffle(rows)
    rows = [tuple(r) for r in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("code", F.lit("x")).withColumn("stat", F.lit(1))
    got = ballcodes.coded(df, entries=entries, rounds=rounds).collect()
    want, sha = codes_by_hand(rows, entries, rounds, 4, 1024)
    labels = {}
    for _, lab, _, e in want:
        labels[lab] = labels.get(lab, 0) + e
    assert {r.codebooks_sha256 for r in got} == {sha}
    key = lambda t: tuple((c is None, c or 0) for c in t)      # noqa: E731
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key) == sorted([(i, c, e, labels[lab]) for i, lab, c, e in want], key=key)


def test_balls_spare_work(spark):
    """Codes are those of a whole comparison, and far fewer distances are made on separated balls."""
    rnd = np.random.default_rng(4)
    entries = rnd.integers(-10_000, 10_000, size=(64, 8))
    x = entries[rnd.integers(64, size=5000)] + rnd.integers(-40, 40, size=(5000, 8))
    old = ballcodes._nearest(x, entries)
    moved = entries + rnd.integers(-20, 20, size=entries.shape)
    code, dist, made = ballcodes.Balls(moved, np.ones(64, bool)).assign(x, old)
    every = ballcodes.squared(x, moved)
    assert (code == every.argmin(1)).all() and (dist == every.min(1)).all() and made < every.size / 20
    x = rnd.integers(-50, 50, size=(3000, 8))
    entries = rnd.integers(-50, 50, size=(64, 8))
    entries[10] = entries[3]
    for _ in range(3):
        old = ballcodes._nearest(x, entries)
        moved = entries.copy()
        moved[::5] += rnd.integers(-6, 6, size=moved[::5].shape)
        code, dist, _ = ballcodes.Balls(moved, (moved != entries).any(1)).assign(x, old)
        assert (code == ballcodes.squared(x, moved).argmin(1)).all()
        entries = moved


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert ballcodes.coded(none).count() == 0
    short = spark.createDataFrame([(1, 2, [1.0] * 8), (2, None, []), (3, None, [2.0] * 4)], "vec_id long, label int, embedding array<float>")
    assert [(r.vec_id, r.code, r.error) for r in ballcodes.coded(short).collect()] == [(1, "00000000", 0)]
