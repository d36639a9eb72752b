"""SimHash, mixing, sharding, top-k, token counts, quality and the pipeline, against plain Python."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import empty, table
from wattloom.llm import graph, mixing, nearcopies, quality, sharding, simhash, tokencount, topk


def print_by_hand(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups_by_hand(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_pairs_within_all_sizes():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 129, 700):
        base = rnd.integers(0, 2 ** 63, size=max(1, n // 6), dtype=np.uint64)
        f = base[rnd.integers(0, len(base), n)]
        for _ in range(2):
            f = np.where(rnd.random(n) < .6, f ^ (np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64)), f)
        f = np.unique(f)
        i, j = simhash.pairs_within(f)
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
        assert set(zip(i.tolist(), j.tolist())) == set(map(tuple, np.argwhere(np.triu(near, 1)).tolist()))


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_by_hand(spark, block):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(4))     # noqa: E731
    texts = [(None, "null id"), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "É é"), (8, "é é")]
    for g in range(12):
        base = [word() for _ in range(300)]
        for k in range(8):
            own = list(base)
            for _ in range(k % 4):
                own[rnd.randrange(300)] = word()
            texts.append((100 + g * 10 + k, " ".join(own)))
    texts.append((100, texts[9][1]))
    prints = [print_by_hand(t) for _, t in texts]
    root = groups_by_hand(prints)
    least = {r: min((t[0] for t, q in zip(texts, root) if q == r and t[0] is not None), default=None) for r in set(root)}
    docs = table(spark, texts)
    got = Counter((r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in simhash.near_duplicates(docs, block=block).collect())
    assert got == Counter((t[0], p, least[r]) for t, p, r in zip(texts, prints, root))
    kept = simhash.one_of_each(docs, block=block)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root))


def test_hot_ball_is_split(spark):
    """All fingerprints within two bits of one: over one block, in every bucket that keeps the other bits."""
    fps = [0] + [1 << a for a in range(63)] + [1 << a | 1 << b for a in range(63) for b in range(a)]
    d = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    out = graph.components(simhash.links(d, block=32))
    rows = out.collect()
    assert len(rows) == len(fps) and {r.root for r in rows} == {0}


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 100)
    assert simhash.fingerprint(text) == whole


def test_long_texts_of_few_words():
    """Over 800,000 bytes in one, two and three words: read in blocks, hashed like any other."""
    a, b = "A" * 900_000, "b" * 800_001
    for text in (a, b, f" {a} ", f"{a} {b}", f"{b}\n{a}", f"{a} {b} c", " " * 900_000):
        assert simhash.fingerprint(text.encode()) == print_by_hand(text), len(text)
    assert len({simhash.fingerprint(t.encode()) for t in ("", a, b, f"{a} {b}")}) == 4


def test_near_duplicates_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(empty(spark)).count() == 0


def shingles_by_hand(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_copies_by_hand(spark, monkeypatch):
    """The pipeline's stage against all pairs: edited copies on both sides of 0.8, common passages, a chain, short and odd texts."""
    monkeypatch.setattr(nearcopies, "ROWS", 500)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))     # noqa: E731
    common = [word() for _ in range(30)]
    texts = [(None, "null id"), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two three four"), (7, "one two three four five"), (8, "A b c d e f"), (9, "a B c d e g")]
    for g in range(40):
        base = [word() for _ in range(rnd.choice((12, 40, 150, 400)))] + common * (g % 2)
        for k in range(6):
            own = list(base)
            for _ in range(k * len(base) // 200 + (k > 0)):
                own[rnd.randrange(len(own))] = word()
            texts.append((100 + 10 * g + k, " ".join(own)))
    chain = [word() for _ in range(60)]
    for k in range(12):
        texts.append((1000 - k, " ".join(chain[3 * k:3 * k + 40])))
    texts.append((100, texts[10][1]))
    sets = [shingles_by_hand(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    linked = far = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
                linked += a != sets[j]
                far += (print_by_hand(texts[i][1]) ^ print_by_hand(texts[j][1])).bit_count() > 2
    assert linked > 100 and far > 80
    least = {}
    for i, (k, _) in enumerate(texts):
        r = find(i)
        least[r] = min(least.get(r, 10 ** 9), -1 if k is None else k)
    docs = table(spark, texts)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())
    assert nearcopies.one_of_each(empty(spark)).count() == 0


def test_large_group_of_edited_copies(spark, monkeypatch):
    """Pairs handed on in both rounds stay a small number a copy, long texts and one very long word included."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))     # noqa: E731
    base = [word() for _ in range(300)]
    texts = []
    for k in range(400):
        own = list(base)
        for _ in range(2):
            own[rnd.randrange(300)] = word()
        texts.append((k, " ".join(own)))
    long = " ".join(word() for _ in range(150_000))
    texts += [(1000, long), (1001, long[:-9] + "different"), (1002, "x" * 900_000), (1003, "X" * 900_000), (1004, "y" * 900_000)]
    handed, old = [], nearcopies.cut

    def counted(df, purpose="cut"):
        out = old(df, purpose)
        if purpose.endswith("-pairs"):
            handed.append(out.count())
        return out
    monkeypatch.setattr(nearcopies, "cut", counted)
    kept = sorted(r.doc_id for r in nearcopies.one_of_each(table(spark, texts)).collect())
    sets = [shingles_by_hand(t) for _, t in texts[:400]]
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(400):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    assert kept == sorted({min(j for j in range(400) if find(j) == find(i)) for i in range(400)}) + [1000, 1002, 1004]
    assert len(handed) == 2 and sum(handed) < 20 * 400


def test_copies_left_to_the_later_rounds(spark, monkeypatch):
    """A group that the first round leaves apart collapses by a few pairs a copy, not by all of them, and loses no link."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))     # noqa: E731
    base, texts = [word() for _ in range(120)], []
    for k in range(150):
        own = list(base)
        own[rnd.randrange(120)] = word()
        texts.append((k, " ".join(own)))
    texts += [(200, " ".join(base[:108])), (201, " ".join(base[:60]))]
    monkeypatch.setattr(nearcopies, "neighbours", lambda sets, share: sets.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0))
    handed, old = [], nearcopies.cut

    def counted(df, purpose="cut"):
        out = old(df, purpose)
        if purpose.endswith("-pairs"):
            handed.append(out.count())
        return out
    monkeypatch.setattr(nearcopies, "cut", counted)
    kept = sorted(r.doc_id for r in nearcopies.one_of_each(table(spark, texts)).collect())
    assert kept == [0, 201]
    assert sum(handed) < 5 * 152


def features_by_hand(text):
    """Presence of words and their first letters, and shares of end signs, capitals and repeats."""
    words = (text or "").split()
    out = {}
    for w in set(words):
        core = w
        while core and not core[-1].isalnum():
            core = core[:-1]
        end = w[len(core):]
        while core and not core[0].isalnum():
            core = core[1:]
        low = core.lower()
        if low:
            out[quality._presence(quality.WORD, low.encode())] = 1.0
        for k in (4, 5):
            if len(low) > k:
                out[quality._presence(quality.PREFIX[k], low[:k].encode())] = 1.0
        n = words.count(w) * quality.SHARE / len(words)
        if end:
            at = quality._share(b"s", end.encode())
            out[at] = out.get(at, 0) + n
        if core and w.isupper():
            at = quality._share(b"x", b"capitals")
            out[at] = out.get(at, 0) + n
    for at, n in ((quality._share(b"x", b"repeats"), len(words) - len(set(words))), (quality._share(b"x", b"capitals"), 0)):
        out[at] = out.get(at, 0) + n * quality.SHARE / max(len(words), 1)
    return {k: v for k, v in out.items() if v}


def test_quality_features_and_rates_by_hand(spark):
    texts = [None, "", "One word, TWO words! two (three) four; five?! five?!", "x" * 200 + "!!!", "x" * 200 + "abc", "Ünder ÄÖÜ 12.5 ... --- élan's", "A b C d " * 50]
    for t in texts:
        at, value = quality.features(t, {})
        assert {int(a): round(float(v), 9) for a, v in zip(at, value) if v} == {k: round(v, 9) for k, v in features_by_hand(t).items()}, t
    assert features_by_hand(texts[3]) != features_by_hand(texts[4])
    rnd = np.random.default_rng(9)
    model = quality.Ordinal(rnd.normal(size=quality.DIM), np.array([-.5, .7]), rnd.random(quality.DIM) * (rnd.random(quality.DIM) < .7))
    docs = table(spark, list(enumerate(texts))).withColumn("tail", F.lit("mine"))
    got = {r.doc_id: (r.g, r.p) for r in quality.rate(docs, model, 2, ("g", "p")).collect()}
    for i, t in enumerate(texts):
        score = sum(model.weights[k] * model.scale[k] * v for k, v in features_by_hand(t).items())
        p = [1 / (1 + np.exp(x - score)) for x in model.thresholds]
        assert np.allclose(got[i], (sum(p), p[1]))


def test_components_of_a_chain(spark):
    e = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (5, 6)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(e, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def targets_by_hand(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full, level = 1.5 * sum(sizes.values()), set(), 0.0
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        more = {s for s in rest if 2 * sizes[s] <= weight[s] * level}
        if not more:
            return {s: 2 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def test_mix_by_hand(spark):
    rnd = random.Random(3)
    texts, sources = [], []
    for i in range(900):
        texts.append((i if i % 97 else None, None if i % 53 == 0 else "w " * rnd.randint(0, 30)))
        sources.append(rnd.choice(["src0"] * 6 + ["a", "Z", "é", None]))
    docs = table(spark, texts, sources)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.fair_queue(sized).collect()
    assert len(rows) == len(texts)
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for (i, t), s in zip(texts, sources):
        sizes[s] += len((t or "").split())
        largest[s] = max(largest[s], len((t or "").split()))
    want = targets_by_hand(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.copies in (0, 1, 2)
        taken[r.source] += r.copies * r.size
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) < sum(taken.values()) + max(largest.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.size, r.copies)       # noqa: E731
    again = mixing.fair_queue(sized.repartition(7)).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert [(r.target, r.copies) for r in mixing.fair_queue(spark.createDataFrame([(1, "a", 0)], "doc_id bigint, source string, size bigint")).collect()] == [(0.0, 0)]


def test_curve_is_continuous(spark):
    cells = spark.range(4096).selectExpr("cast(id % 16 as int) a", "cast(floor(id / 16) % 16 as int) b", "cast(floor(id / 256) as int) c")
    r = cells.withColumn("h", sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 4)).orderBy("h").collect()
    assert [x.h for x in r] == list(range(4096))
    assert {sum(abs(p[k] - q[k]) for k in range(3)) for p, q in zip(r, r[1:])} == {1}


def test_shards(spark):
    texts = [(i, "é" * (i % 700)) for i in range(500)] + [(None, None), (None, ""), (7, "copy"), (7, "copy"), (9, "x" * 300000)]
    rows = sharding.shard_documents(table(spark, texts)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert all(r.law == "rows" and r.grown_shard is None for r in rs)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard_documents(empty(spark)).count() == 0
    few = sharding.shard_documents(table(spark, [(1, "a"), (2, "b")])).collect()
    assert sorted(r.slot for r in few) == [0, 0]


def test_top_k_by_hand(spark):
    rnd = np.random.default_rng(5)
    vec = [(i, [float(x) for x in rnd.normal(0, 0.2, 12).astype(np.float32)]) for i in range(400)]
    vec += [(400 + i, vec[20][1]) for i in range(60)]                                      # ties
    vec += [(1000, None), (1001, [1.0, None] + [0.0] * 10), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (None, vec[0][1]), (1020, []), (1040, [1.0] * 3), (1041, [2.0] * 3),
            (20, vec[20][1]), (20, vec[21][1]), (3, vec[9][1])]                                        # other rows of one id
    t = spark.createDataFrame([(i, v, 1) for i, v in vec], "vec_id bigint, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(t, F.col("vec_id") % 20 == 0, queries=7, candidates=50).collect())
    use = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in vec if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for k, (i, q) in enumerate(use):
        if i % 20 == 0:
            s = sorted((-int(q @ x), c) for j, (c, x) in enumerate(use) if j != k and len(x) == len(q))[:20]
            want += [(i, n + 1, c, -a) for n, (a, c) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(t.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_equal_ids(spark):
    t = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (20, [1.0]), (3, [0.5])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(t, F.col("vec_id") % 20 == 0).collect()) == [(20, 1, 1, 8192), (20, 2, 1, 4096), (20, 3, 3, 2048)]


def test_lists_stop_early():
    """Skewed vectors: a query with one strong weight needs only the head of the lists."""
    rnd = np.random.default_rng(7)
    x = np.zeros((2000, 8), dtype=np.int64)
    x[:, 0] = rnd.permutation(2000)
    reads = []
    old = topk.Lists.read_to
    topk.Lists.read_to = lambda self, depth: (reads.append(depth), old(self, depth))[1]
    try:
        q = np.array([[3, 0, 0, 0, 0, 0, 0, 0]])
        i, j, s = topk.best_of_block(np.array([-1]), q, np.arange(2000), np.arange(2000), x, 5, depths=(0.01, 0.1, 1.0))
    finally:
        topk.Lists.read_to = old
    assert sorted(s.tolist(), reverse=True) == [3 * v for v in range(1999, 1994, -1)] and reads == [20]


def test_large_scores_stay_exact():
    x = np.array([[2 ** 30, 1], [2 ** 30, 2], [2 ** 30, 3]])
    i, j, s = topk.best_of_block(np.array([-1]), x[:1], np.arange(3), np.arange(3), x, 2)
    assert s.tolist() == [2 ** 60 + 3, 2 ** 60 + 2]


def test_edits_by_hand():
    enc = tokencount.encoder(tokencount.default_ranks())
    rnd = random.Random(3)
    alphabet = ["word", " ", "  ", "\n", "'s", "12", "é", "!", " the", "ing"]
    for n in (0, 1, 5, 80, 600):
        for _ in range(6):
            x = "".join(rnd.choice(alphabet) for _ in range(n))
            parts = tokencount.leaves(x, 16)
            assert "".join(parts) == x
            chars, tokens = tokencount.tree_of([len(p) for p in parts]), tokencount.tree_of([tokencount.count(enc, p) for p in parts])
            assert tokens[1] == tokencount.count(enc, x)
            for _ in range(3):                      # edits upon edits
                edits, pos = [], 0
                for _ in range(rnd.randint(0, 6)):
                    s = rnd.randint(pos, pos + 60)
                    edits.append({"start": s, "length": rnd.choice([0, 1, 2, 5, 90]), "insert": rnd.choice(["", None, " ", "x", "'", "  \n", "hello world", "'s"])})
                    pos = s + edits[-1]["length"]
                own = tokencount.valid(edits, len(x))
                y = x
                for s, length, insert in reversed(own):
                    y = y[:s] + insert + y[s + length:]
                new, _ = tokencount.apply(enc, x, chars, tokens, own)
                assert new == y and tokens[1] == tokencount.count(enc, y) and chars[1] == len(y)
                size = len(tokens) // 2
                assert all(tokens[i] == tokens[2 * i] + tokens[2 * i + 1] for i in range(1, size))
                x = y


def test_token_counts_table(spark):
    enc = tokencount.encoder(tokencount.default_ranks())
    long = "some words of prose, " * 3000 + "mail me@example.org now " + "and more of them " * 3000
    docs = table(spark, [(1, None), (2, ""), (3, "call +1 555 123 4567 or 10.0.0.1"), (4, long), (4, long), (None, "a@b.co")])
    out = tokencount.edit(tokencount.build(tokencount.with_edits(docs, tokencount.MASKS)))
    for r in out.collect():
        assert r.n_tokens_after == len(enc.encode_ordinary(r.text or ""))
        assert r._digest == "x"
        if r.doc_id == 4:
            assert r.n_edits == 1 and "<email>" in r.text and r.n_chars_encoded < 3000
    assert tokencount.build(tokencount.with_edits(empty(spark), tokencount.MASKS)).count() == 0
    edits = spark.createDataFrame([(2, 0, 0, "new"), (3, 5, 2, None), (3, 0, 4, "ring"), (3, 1, 4, "late")], "doc_id bigint, start int, length int, insert string")
    got = {r.doc_id: (r.text, r.n_edits) for r in tokencount.edit(tokencount.build(tokencount.gather(docs.filter("doc_id < 4"), edits))).collect()}
    assert got == {1: (None, 0), 2: ("new", 1), 3: ("ring  555 123 4567 or 10.0.0.1", 2)}


def test_gradient_by_differences():
    rnd = np.random.default_rng(1)
    score, grade, t = rnd.normal(size=9), rnd.integers(0, 4, 9), np.array([-1.0, 0.2, 0.9])
    by_score, by_t, loss = quality.gradient(score, grade, t)
    e = 1e-6
    for k in range(9):
        up = score.copy()
        up[k] += e
        assert (quality.gradient(up, grade, t)[2] - loss) / e == pytest.approx(by_score[k], abs=1e-4)
    for k in range(3):
        up = t.copy()
        up[k] += e
        assert (quality.gradient(score, grade, up)[2] - loss) / e == pytest.approx(by_t[k], abs=1e-4)


def test_quality_held_out(spark):
    """Grades by junk signs and by one bad word; fitted on some rows, judged on others."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7)))       # noqa: E731
    texts, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rnd.randint(20, 120))]
        grade = i % 3
        if grade == 0:
            w = [x.upper() + "!!" for x in w]
        if grade == 1:
            w[rnd.randrange(len(w))] = "vile"
        texts.append((i, " ".join(w)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    labels += [(0, 0, None), (2000, 1, 0), (5, None, None), (None, 1, 1)]
    docs = table(spark, texts + [(None, None), (9000, ""), (9001, "x " * 100000)])
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.quality_model(docs.filter("doc_id < 400 or doc_id is null"), lab)
    out = quality.rate(docs, model, 2, ("_e", "_t"))
    assert out.columns == [*docs.columns, "_e", "_t"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r._t <= 1 and r._t <= r._e <= 2 for r in rows)
    held = [((r._t >= 0.5), r.doc_id % 3 == 2) for r in rows if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    again = quality.quality_model(docs.filter("doc_id < 400 or doc_id is null").repartition(5), lab)
    assert np.allclose(model.weights, again.weights)


def test_quality_without_rows(spark):
    lab = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.quality_model(table(spark, [(1, "a")]), lab)
    assert [r.tail for r in quality.rate(table(spark, [(1, "a")]), model, 2).collect()] == [pytest.approx(1 / (1 + np.e))]
    assert quality.rate(empty(spark), model, 2).count() == 0


def test_bounded_sample(spark):
    docs = table(spark, [(i, f"word{i % 5} and more") for i in range(200)])
    rated = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, grade int")
    model = quality.fit(docs, rated, 1, sample=20, steps=2)
    assert model.thresholds.shape == (1,)
